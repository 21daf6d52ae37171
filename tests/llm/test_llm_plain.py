"""Parts without Spark: permutation, code, splitter, parser, models."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm import bpe, dom, feistel, fingerprints, golay, html_text, language_id, sharding, simhash, training_order

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.integers(1, 3000), st.integers(0, 2**64))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    out = feistel.permute(np.arange(n), n, key)
    assert sorted(out) == list(range(n))
    assert (feistel.permute(out, n, key, inverse=True) == np.arange(n)).all()


def test_permutation_of_large_numbers():
    n = 2**45 + 17
    x = np.array([0, 1, 12345, n - 1])
    out = feistel.permute(x, n, 5)
    assert (out < n).all() and (feistel.permute(out, n, 5, inverse=True) == x).all()
    assert not (out == feistel.permute(x, n, 6)).all()


def test_golay_keys():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 500).astype(np.uint32)
    a = golay.keys(words)
    assert set((a >= 0).sum(axis=1)) <= {1, 6}
    for e in (1, 2):
        other = words.copy()
        for _ in range(e):
            other ^= np.uint32(1) << rng.integers(0, 23, len(words)).astype(np.uint32)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, golay.keys(other)))


def test_bucket_keys_miss_no_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for fp in (a, b):
        own = [set() for _ in fp]
        for i, k in zip(*simhash.bucket_keys(fp)):
            own[i].add(k)
        keys.append(own)
    assert all(x & y for x, y in zip(*keys))


def test_forest_is_spanning():
    rng = np.random.default_rng(2)
    fp = (np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    edges = simhash.forest(fp)
    up = list(range(len(fp)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(fp)):
        for j in range(i):
            if bin(int(fp[i] ^ fp[j])).count("1") <= 4 and root(i) != root(j):
                up[root(i)] = root(j)
    want = len({root(i) for i in range(len(fp))})
    assert len(edges) == len(fp) - want


@given(st.lists(st.sampled_from([*" \n\tab.'s1é中", "  ", "\u00a0", "\x1c", "<|endoftext|>", "😀", "\r\n"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_words_encode_like_texts(parts):
    text = "".join(parts)
    t = Tokenizer.from_file(PATH) if not hasattr(test_words_encode_like_texts, "t") else test_words_encode_like_texts.t
    test_words_encode_like_texts.t = t
    words = bpe.split_words(text)
    ids = [i for w in words for i in t.encode(w, add_special_tokens=False).ids]
    assert "".join(words) == text and ids == t.encode(text, add_special_tokens=False).ids
    assert b"".join(bpe.pieces(PATH)[i] for i in ids).decode("utf-8", "replace") == t.decode(ids, skip_special_tokens=False)


def test_parser_survives_anything():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "<br>", "text &amp; more", "<!-- x", "-->", "<script>var a='<p>'", "</script>", "<", ">", '<a title="x>', "<li>", "</ul>", "&#x41;", "&bad"]
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        root = dom.parse(page)
        html_text.blocks(root)
        dom.Shapes().of(root)


def test_tree_matching():
    shapes = dom.Shapes()
    a, b = (shapes.of(dom.parse(p)) for p in ("<div><p>1</p><ul><li>x</li></ul></div>", "<div><h1>0</h1><p>2</p><ul><li>y</li><li>z</li></ul></div>"))
    assert shapes.score(a, a) == shapes.sizes[a] == 5
    assert shapes.score(a, b) == 5  # root, div, p, ul, li


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""), ("plain  text", "plain text"), ("<body><nav>menu</nav><article><h1>T</h1><p>a  b<br>c</p><aside>no</aside><p>d<b>e</b></article><footer>f</footer>", "T a b c de"),
        ("<div class='sidebar'>s</div><div class='post'>x &lt;y&gt;</div><div id='comments'><p>c</p></div><form>f</form>", "x <y>"), ("<main><div class='cookie-notice'>n</div><p>m</p></main>", "m"),
        ("<article><p>one<p>two<script>if (a</b) {}</script></article>", "one two"), ("<style>p{}</style><p>t</p><!-- c -->", "t"), ("<article class='comment'>c</article><article><p>x</p></article>", "x"),
    ],
)
def test_blocks(page, text):
    assert " ".join(t for _, t in html_text.blocks(dom.parse(page))) == text


def test_language_models():
    rng = random.Random(4)
    vocab = {"aa": ["the", "of", "and", "ther", "ing"], "bb": ["der", "die", "und", "über", "schön"]}
    make = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    model = language_id.train([(lang, make(lang, 60)) for _ in range(40) for lang in vocab])
    texts = [make("aa", 8), make("bb", 8), "", "123 !", "русский текст совсем другой", "a" * 3_000_000]
    logs, sizes = model.score(texts)
    best, score, _, rejected = model.decide(logs, sizes)
    assert [model.languages[b] for b in best[:2]] == ["aa", "bb"] and (score[:2] > 0.9).all() and not rejected[:2].any()
    assert list(sizes[2:4]) == [0, 0] and rejected[2:5].all()
    # a text scores the same alone as among others, and whole or in pieces
    assert np.allclose(model.score(texts[:1])[0][0], logs[0])
    # probabilities of all symbols after a context sum to one, seen context or not
    symbols = [language_id.BOUNDARY, language_id.BLANK, language_id.UNSEEN, *model.alphabet.tolist()]
    for lead in ([language_id.BOUNDARY] * 4, [ord(c) for c in "ther"], [language_id.UNSEEN] * 4):
        p = [np.exp(model.log_probs(np.array([*lead, s], dtype=np.uint64))[0]) for s in symbols]
        assert np.allclose(np.sum(p, axis=0), 1, atol=1e-4)


def test_no_training_rows():
    assert language_id.train([]).languages == []


def test_clashing_columns_of_narrow_operators(docs, spark, tmp_path):
    """op2, op4 and op8 read doc_id and text alone: columns with the names of theirs change nothing."""
    rows = docs([(i, f"some words {i} " * (i + 3)) for i in range(12)] + [(3, "some words 3 " * 6)])
    clash = rows.selectExpr("*", "1 as shard", "2 as slot", "'x' as fingerprint", "3 as block", "4 as size", "5 as row_no", "6 as n_tokens", "7 as start")
    same = lambda f: sorted(map(repr, f(rows).collect())) == sorted(map(repr, f(clash).collect()))
    assert same(fingerprints.fingerprint_pairs) and same(sharding.shard_documents)
    for name, df in (("a", rows), ("b", clash)):
        training_order.materialise(df, str(tmp_path / name), stride=16, per_shard=4)
    read = lambda name: [(r.slot, bytes(r.ids)) for r in training_order.read_slots(spark, str(tmp_path / name), stride=16, per_shard=4).collect()]
    assert read("a") == read("b")
