"""Each operator on edge cases and against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import bpe, feistel, fingerprints, html_text, language_id, mixing, quality, queries, sharding, shingle_join, simhash, training_order, url_filters
from marginalia.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 997} x{i}" for i in range(12_000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "same text here again and more"), (6, "same text here again and more"), (7, LONG), (8, "ünï ¢ödé 😀 " * 9), (None, "no id"), (8, "ünï ¢ödé 😀 " * 9), (9, "nospace" * 60)]


@pytest.fixture(scope="module")
def edge(docs):
    return docs(EDGE)


@pytest.fixture(scope="module")
def empty(docs):
    return docs([])


def by_id(df, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in df.collect()), key=repr)


# 1


def test_url_rules(spark):
    urls = {
        1: "http://WWW.Example.com/en/x?q#f", 2: "https://a.example.com/en/", 3: "http://example.com/de/", 4: "https://x.net/es/1", 5: "http://x.net/en/1", 6: None, 7: "nothing", 8: "http://a.com", 9: "ftp://notexample.com/en/a", 10: "http://x.org/a://b",
    }
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    got = {r.page_id: r for r in url_filters.filter_urls(pages, spark.createDataFrame([], "page_id long, good boolean")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and (got[3].rule, got[3].verdict) == ("com/", "allow")
    assert got[4].verdict == "block" and (got[5].rule, got[5].verdict) == (None, "allow")
    assert [(got[k].host, got[k].path, got[k].rule) for k in (6, 7, 8)] == [("", "", None), ("", "", None), ("a.com", "", None)]
    assert got[9].rule == "com/" and (got[10].host, got[10].path) == ("x.org", "/a://b")


def test_reputation(spark):
    rows = [(f"bad.x.org", i % 20 == 0) for i in range(60)] + [("good.x.org", i % 20 != 0) for i in range(60)] + [("new.x.org", None), ("one.y.org", False)] + [("ok.y.org", True)] * 40
    rep = {r.host: r for r in url_filters.host_reputation(spark.createDataFrame(rows, "host string, good boolean")).collect()}
    assert rep["bad.x.org"].post_mean < 0.2 < 0.8 < rep["good.x.org"].post_mean
    assert rep["new.x.org"].n_labelled == 0 and rep["new.x.org"].post_mean == pytest.approx(rep["new.x.org"].prior_mean)
    assert rep["one.y.org"].post_mean > 0.15  # one bad page does not condemn a host
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, (h, _) in enumerate(rows)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows) if g is not None], "page_id long, good boolean")
    verdict = {r.host: r.verdict for r in url_filters.filter_urls(pages, outcomes).collect()}
    assert verdict["bad.x.org"] == "block" and verdict["good.x.org"] == verdict["one.y.org"] == verdict["new.x.org"] == "allow"


def test_domains(spark):
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "x.com.cn": ("x.com.cn", "com.cn"), "me.github.io": ("me.github.io", "github.io"), "www.a.org:8080": ("a.org", "org"),
        "u@a.org": ("a.org", "org"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"), "[::1]:80": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r[0]: (r[1], r[2]) for r in hosts.select("host", url_filters.domain_of(F.col("host")), url_filters.suffix_of(F.col("host"))).collect()} == want


def test_url_filters_of_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, good boolean")
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string"), none).isEmpty()
    far = "http://h.org/" + "a" * 200_000
    rows = [(1, far, "x", 0.5), (1, far, "x", 0.5), (None, "http://h.org/b", None, None)]
    got = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, post_mean double"), none).collect()
    assert [(r.host, r.verdict) for r in got] == [("h.org", "allow")] * 3 and sum(r.path == far[12:] for r in got) == 2


def test_op1_equals_its_sql(spark, tmp_path):
    """Hosts that fall both ways, so the posterior decides, not the rules alone."""
    import duckdb

    rows, labels = [], []
    for i in range(400):
        host = ["bad.shop.org", "www.good.org", "x.co.uk", "1.2.3.4:80", f"h{i % 7}.site.com.cn", "a.example.com", "z.net"][i % 7]
        rows.append((i, f"http://{host}/en/{i}.html"))
        if i % 3:
            labels.append((i, int(host != "bad.shop.org" and i % 11 > 0), 0))
    spark.createDataFrame([*rows, (400, None), (401, "no url")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [tuple(r) for r in queries.op1_url_filters(spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        for t in ("pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        assert sorted(got, key=repr) == sorted(con.execute(queries.ORACLE_SQL["op1_url_filters"]).fetchall(), key=repr)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_labels_by_path(spark):
    pages = spark.createDataFrame([(1, "http://a/en/5?x"), (2, "http://a/en/6.html"), (3, "http://a/en/7/"), (4, "http://a/x"), (5, None)], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r.page_id, r.good) for r in url_filters.labelled_pages(pages, labels).collect()) == [(1, True), (2, False), (3, False)]


# 2


def test_fingerprints(edge, empty, docs):
    got = fingerprints.fingerprint_pairs(edge).collect()
    assert len(got) == len(EDGE) and fingerprints.fingerprint_pairs(empty).isEmpty()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 256 and by[5].fingerprint == by[6].fingerprint and by[5].near_next == 1.0
    order = sorted({d: t for d, t in EDGE}.items(), key=lambda x: (x[0] is not None, x[0] or 0))
    for k, (d, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        q = len(text) // 4
        assert by[d].n_chars == len(text) and by[d].edited_sha256 == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
    assert 0.2 < by[7].near_edited < 0.9
    one = fingerprints.fingerprint_pairs(docs([(3, "a b c d e f g h")])).first()
    assert one.near_next == 1.0


def brute_order_minhash(text):
    """The fingerprint by its definition, with Spark's hash: XXH64 chained by seeds from 42 on."""
    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tokens = [t.encode() for w in words for t in ([w] if len(w) <= 16 else w)]
    if not tokens:
        return "0" * 256
    grams = [h(*tokens[i : i + 3]) & ((1 << 38) - 1) for i in range(max(1, len(tokens) - 2))]
    seen, ring = Counter(), []
    for place, g in enumerate(grams):
        seen[g] += 1
        signed = g - (1 << 38) if g >> 37 else g
        x = h(signed.to_bytes(8, "little", signed=True), seen[g].to_bytes(4, "little")) & ((1 << 37) - 1)
        ring.append((x >> 31, x & ((1 << 31) - 1), place))
    ring.sort()
    out = ""
    for b in range(64):
        two = sorted(ring, key=lambda r: ((r[0] - b) % 64, r[1], r[2]))[:2]
        first, second = sorted([two[0], two[-1]], key=lambda r: r[2])
        out += f"{h(first[1].to_bytes(8, 'little'), second[1].to_bytes(8, 'little')) & 65535:04x}"
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def likeness(x, y):
    return sum(x[i : i + 4] == y[i : i + 4] for i in range(0, 256, 4)) / 64


def prints(docs, texts):
    rows = docs(list(enumerate(texts))).select("doc_id", fingerprints.fingerprint(F.col("text")).alias("fp")).collect()
    return [r.fp for r in sorted(rows, key=lambda r: r.doc_id)]


def test_fingerprints_by_brute_force(docs):
    rng = np.random.default_rng(3)
    texts = [t for _, t in EDGE] + [" ".join(rng.choice(["a", "b", "cc", "d" * 16, "e" * 17, "é😀"], n)) for n in (1, 2, 3, 4, 5, 9, 40, 200)] + ["漢字仮名" * 30 + " x", "ab" * 300]
    assert prints(docs, texts) == [brute_order_minhash(t) for t in texts]


def test_likeness_follows_edits_without_blanks(docs):
    rng = np.random.default_rng(4)
    text = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 400))
    same, front, middle, other = prints(docs, [text, "x" + text, text[:200] + "yz" + text[200:], text[::-1]])
    assert likeness(same, front) > 0.9 and likeness(same, middle) > 0.85 and likeness(same, other) < 0.1


def test_likeness_falls_with_edit_distance(docs):
    rng, moves = np.random.default_rng(6), {}
    for n in (20, 40, 70, 130, 250):
        words = [f"w{x}" for x in rng.integers(0, 10 * n, n)]
        versions = [words, words[n // 2 :] + words[: n // 2]]
        for share in (0.03, 0.1, 0.2, 0.4, 0.8):
            versions.append([f"n{i}" if rng.random() < share else w for i, w in enumerate(words)])
        first, moved, *edited = prints(docs, [" ".join(v) for v in versions])
        moves[n] = likeness(first, moved)
        # Of replaced words, more of them never look nearer.
        far, near = [edit_distance(words, v) for v in versions[2:]], [likeness(first, f) for f in edited]
        assert all(x >= y for (_, x), (_, y) in zip(sorted(zip(far, near)), sorted(zip(far, near))[1:])) and near[-1] < 0.1
    # Halves that change places keep nearly all k-mers, but about half of the tuples lose their order, in short texts too.
    assert all(0.1 < x < 0.7 for x in moves.values()), moves
    print("likeness after a swap of halves, by words:", moves)


def test_order_counts(docs):
    words = [f"t{i}" for i in range(400)]
    texts = [words, words[200:] + words[:200], words[:390] + ["new"] * 10, [w for w in words for _ in range(1)][::-1]]
    rows = docs([(i, " ".join(t)) for i, t in enumerate(texts)]).select("doc_id", fingerprints.fingerprint(F.col("text")).alias("fp"))
    a, b, c, d = (r.fp for r in rows.orderBy("doc_id").collect())
    like = lambda x, y: sum(x[i : i + 4] == y[i : i + 4] for i in range(0, 256, 4)) / 64
    assert like(a, c) > 0.8 and like(a, d) < 0.1 and like(a, b) < like(a, c)  # moved halves share k-mers, but not their order


# 3


def brute_fingerprint(text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [(d, brute_fingerprint(t)) for d, t in rows]
    up = list(range(len(fp)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i][1] ^ fp[j][1]).count("1") <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fp):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, x, least.get(root(i))) for i, (d, x) in enumerate(fp)), key=repr)


def test_simhash(docs, edge, empty):
    rng = np.random.default_rng(5)
    base = [" ".join(f"k{x}" for x in rng.integers(0, 5000, 300)) for _ in range(12)]
    rows = [(100 + i, base[i % 12]) for i in range(24)]
    for i in range(150):
        w = base[i % 12].split()
        for _ in range(rng.integers(1, 4)):
            w[rng.integers(0, len(w))] = f"z{i}"
        rows.append((200 + i, " ".join(w)))
    rows += EDGE
    got = simhash.near_duplicates(docs(rows).select("doc_id", "text"))
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()), key=repr) == brute_components(rows)
    assert simhash.near_duplicates(empty.select("doc_id", "text")).isEmpty()


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(6)
    fp = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    parts = [Counter(r.root for r in components(simhash.links(df, large=n)).collect()) for n in (3, 100_000)]
    assert parts[0] == parts[1]


def test_large_buckets_honour_a_larger_reach(spark):
    rng = np.random.default_rng(6)
    near = np.uint64(0x123456789ABCDEF0) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 6)).astype(np.uint64), axis=1)
    df = spark.createDataFrame([(int(x),) for x in np.unique(near).view(np.int64)], "fp long")
    parts = [Counter(r.root for r in components(simhash.links(df, large=n, reach=6)).collect()) for n in (3, 100_000)]
    assert parts[0] == parts[1]


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_shingle_hashes():
    rng = np.random.default_rng(2)
    texts = ["a b c d e f", "A  b\tc d e", "a", "", None, "x" * 200_000 + " y z " + "é" * 70_000 + " a b c d e f", " ".join(f"w{x}" for x in rng.integers(0, 50, 60_000)), "ä b c d e f a b c d e f"]
    seen = {}
    for t in texts:
        own = shingle_join._hashes(t, 5)
        assert len(own) == len(shingles(t))
        for s in shingles(t):
            (h,) = shingle_join._hashes(s, 5)
            assert h in own and seen.setdefault(int(h), s) == s


def test_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(14)
    sets = []
    for n in (1, 3, 40, 60, 70, 250, 260, 500):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for share in (0.0, 0.05, 0.1, 0.12, 0.3, 1.0):
            new = base.copy()
            new[: int(share * n)] = rng.integers(0, 2**63, int(share * n))
            sets.append(np.unique(np.concatenate([new, rng.integers(0, 2**63, int(share * n / 4)).astype(np.uint64)])))
    size = np.array([len(s) for s in sets])
    i, j = shingle_join.possible(size, [shingle_join.bitmap(s) for s in sets], lambda a, b: a != b)
    left = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    close = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if like(sets[a], sets[b]) >= 0.8}
    assert close <= left and len(left) < len(close) + 20


def test_keep_one(docs):
    text = " ".join(f"v{i}" for i in range(100))
    rows = [(1, text), (2, text), (2, text), (3, text.replace("v50", "other")), (4, "something else entirely, of other words"), (5, None), (6, "")]
    kept = simhash.keep_one(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_keep_one_links_what_reaches_the_similarity(docs):
    rng = np.random.default_rng(12)
    texts = []
    for n in (30, 120, 300):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 4000, n)]
            for edits in (0, 1, 2, n // 60, n // 45, n // 30):
                w = list(base)
                for at in rng.integers(0, n, edits):
                    w[at] = f"e{rng.integers(0, 10**6)}"
                texts.append(" ".join(w))
    texts += ["a b c", "A  b c", "a b", "", None]
    sets = [frozenset(shingles(t)) for t in texts]
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b) > 0:
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    kept = simhash.keep_one(docs(list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up))


def test_shingle_join_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = [f"w{x}" for x in range(120)]
    texts = sorted({" ".join("e%d" % rng.integers(0, 99) if rng.random() < 0.02 else w for w in base) for _ in range(150)})
    rows = [(t, shingle_join.set_id(shingle_join._hashes(t, 5))) for t in texts]
    nodes = spark.createDataFrame(rows, "text string, sid long")
    hashes = [shingle_join._hashes(t, 5) for t in texts]
    want = components(spark.createDataFrame([(rows[i][1], rows[j][1]) for i, j in shingle_join.similar(hashes)], "a long, b long"))
    sets = [set(h.tolist()) for h in hashes]
    close = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert 100 < len(close) < len(sets) * (len(sets) - 1) / 2
    own = components(spark.createDataFrame([(rows[i][1], rows[j][1]) for i, j in close], "a long, b long"))
    sets = shingle_join.with_set(nodes.select("text"), 5, *shingle_join.frequent(nodes, 5))
    for closest, many in ((None, 4), (simhash.close_pairs, 4), (None, 10**6)):
        monkeypatch.setattr(shingle_join, "MANY_PAIRS", many)
        got = components(shingle_join.links(sets, lambda sids: nodes.join(sids, "sid", "left_semi"), block=1024, closest=closest))
        assert sorted(got.collect()) == sorted(own.collect()) == sorted(want.collect())


def test_shingle_join_in_rounds_without_stored_sets(spark, monkeypatch):
    """Members of tiles and sets of dense tiles are dealt out in rounds, with the links of one; no table holds the sets of all texts, only of those that are compared."""
    rng = np.random.default_rng(21)
    base = [f"w{x}" for x in range(120)]
    texts = sorted({" ".join("e%d" % rng.integers(0, 99) if rng.random() < 0.02 else w for w in base) for _ in range(60)} | {" ".join(f"w{x} w{x + 1} w{x + 2} w{x + 3} w{x + 4} z{i}" for x in range(i % 100)) for i in range(300)})
    nodes = spark.createDataFrame([(t, shingle_join.set_id(shingle_join._hashes(t, 5))) for t in texts], "text string, sid long").dropDuplicates(["sid"]).localCheckpoint()
    sets = shingle_join.with_set(nodes.select("text"), 5, *shingle_join.frequent(nodes, 5))
    want = components(shingle_join.links(sets, lambda sids: nodes.join(sids, "sid", "left_semi"), block=1024)).collect()
    made = []
    monkeypatch.setattr(shingle_join, "materialize", lambda df, label, f=shingle_join.materialize, **k: made.append((label, df.columns, df.count())) or f(df, label, **k))
    monkeypatch.setattr(shingle_join, "ROUND_BYTES", 1)
    got = components(shingle_join.links(sets, lambda sids: nodes.join(sids, "sid", "left_semi"), block=1024)).collect()
    assert sorted(got) == sorted(want) and len(want) > 20
    assert sum(label == "left" for label, *_ in made) > 1
    assert all(label == "compared" and n < nodes.count() for label, columns, n in made if "hashes" in columns)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 200), (102, 100)] + [(300, i) for i in range(301, 360)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and got[359] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 4 and 8


def test_training_order(spark, edge, empty, tmp_path):
    n = training_order.materialise(edge.select("doc_id", "text"), str(tmp_path / "s"), stride=64, per_shard=10, block_bytes=4096)
    got = training_order.sequence_at(training_order.read_slots(spark, str(tmp_path / "s"), stride=64, per_shard=10), n).orderBy("sequence").collect()
    assert [r.sequence for r in got] == list(range(n)) and sorted(r.slot for r in got) == list(range(n)) and {len(r.ids) for r in got} == {128}
    stream = np.frombuffer(b"".join(bytes(r.ids) for r in got), dtype="<u2")
    assert (stream[stream.size - (stream == 257).sum() :] == 257).all()
    cut = np.split(stream[stream != 257], np.nonzero(stream[stream != 257] == 256)[0] + 1)[:-1]
    assert sorted(bytes(x[:-1].astype(np.uint8)) for x in cut) == sorted((t or "").encode() for _, t in EDGE)
    part = training_order.read_slots(spark, str(tmp_path / "s"), 7, 33, stride=64, per_shard=10)
    assert [r.slot for r in part.collect()] == list(range(7, 33))
    assert training_order.materialise(empty.select("doc_id", "text"), str(tmp_path / "e")) == 0


def test_training_order_files(spark, docs, tmp_path):
    """Files are ranges of slots: a run that resumes reads only the later ones, and the order is that of a plain permutation of the plain stream."""
    texts = [(i, f"text {i} " * (i % 7)) for i in range(200)]
    path = str(tmp_path / "s")
    n = training_order.materialise(docs(texts).select("doc_id", "text"), path, stride=32, per_shard=10, block_bytes=1 << 30, per_range=2)
    files = sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("part-"))
    assert len(files) == -(-n // 20) and all(f.startswith(training_order.file_of(20 * k, 10, 2)) for k, f in enumerate(files))
    for k, f in enumerate(files):
        rows = spark.read.parquet(f"{path}/{f}").collect()
        assert [r.shard for r in rows] == [s for s in (2 * k, 2 * k + 1) if 10 * s < n] and all(len(r.payload) == r.slots * 64 for r in rows)
    stream = np.array([b for _, t in texts for b in (*t.encode(), 256)], dtype="<u2")
    stream = np.concatenate([stream, np.full(n * 32 - len(stream), 257, dtype="<u2")]).reshape(n, 32)
    order = feistel.permute(np.arange(n), n, training_order.KEY)
    want = {int(slot): stream[s].tobytes() for s, slot in enumerate(order)}
    read = lambda first: [(r.slot, bytes(r.ids)) for r in training_order.read_slots(spark, path, first, stride=32, per_shard=10, per_range=2).collect()]
    assert read(0) == sorted(want.items())
    for f in files[:2]:
        (tmp_path / "s" / f).unlink()
    assert read(47) == [x for x in sorted(want.items()) if x[0] >= 47]


def test_training_order_of_token_ids(spark, docs, tmp_path):
    docs([(1, "One two three"), (2, None), (3, "ünï 😀 " * 500)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op4_training_order(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(PATH)
    total = sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in ("One two three", "", "ünï 😀 " * 500))
    assert len(rows) == -(-total // training_order.STRIDE) and {r.sequence for r in rows} == set(range(len(rows)))


def test_sharding(edge, empty, docs):
    got = sharding.shard_documents(edge.select("doc_id", "text")).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in EDGE), key=repr)
    many = sharding.shard_documents(docs([(i * 3, f"t{i}") for i in range(205)]).select("doc_id", "text"))
    slots = {}
    for r in many.collect():
        slots.setdefault(r.shard, []).append(r.slot)
        assert sharding.row_of(r.shard, r.slot, 205) == r.row_no == r.doc_id // 3 and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 16
    assert sharding.shard_documents(empty.select("doc_id", "text")).isEmpty()


def test_training_order_deals_out_packed_ids(spark, docs, tmp_path):
    """Documents are encoded where they are read, their ids are dealt out packed, and no table that is read again is left behind."""
    texts = [(i, f"text {i % 9} ünï " * (i % 40)) for i in range(300)]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    t, seen = Tokenizer.from_file(PATH), []
    end = bpe.vocabulary_size(PATH)
    n = training_order.materialise(docs(texts), str(tmp_path / "s"), stride=32, per_shard=10, block_bytes=4096, end=end, pad=end + 1, encode=partial(bpe.encode_texts, path=PATH))
    got = training_order.sequence_at(training_order.read_slots(spark, str(tmp_path / "s"), stride=32, per_shard=10), n).orderBy("sequence").collect()
    stream = np.frombuffer(b"".join(bytes(r.ids) for r in got), dtype="<u2")
    stream = stream[stream != end + 1]
    for part in np.split(stream, np.nonzero(stream == end)[0] + 1)[:-1]:
        seen.append(part[:-1].tolist())
    assert sorted(seen) == sorted(t.encode(x, add_special_tokens=False).ids for _, x in texts)


# 5


def test_bpe(edge, empty, docs):
    t = Tokenizer.from_file(PATH)
    want = sorted(((d, t.encode(x or "", add_special_tokens=False).ids) for d, x in EDGE), key=repr)
    got = bpe.encode_documents(edge.select("doc_id", "text", F.lit("x").alias("ids"), F.lit(1).alias("block")), PATH, block_bytes=2000)
    assert got.columns == ["doc_id", "block", "n_tokens", "ids", "decoded"]
    rows = got.collect()
    assert sorted(((r.doc_id, np.frombuffer(bytes(r.ids), dtype="<u4").tolist()) for r in rows), key=repr) == want
    assert sorted((r.decoded for r in rows)) == sorted(x or "" for _, x in EDGE)
    assert bpe.encode_documents(empty.select("doc_id", "text"), PATH, digests=True).isEmpty()


def test_bpe_of_much_white_space():
    for text in (" " * 300_000 + "x", "x" + "\t" * 300_000 + "y  z", "a " * 30_000):
        assert list(bpe._encode([text], PATH)[0]) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_bpe_blocks_hold_no_batches():
    """The rows that a block keeps are copies: a slice of a batch keeps its texts too."""
    batch = pa.record_batch({"k0": pa.array(range(100)), "text": pa.array(["x" * 10_000] * 100)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    read = pa.ipc.open_stream(sink.getvalue()).read_next_batch()
    kept = bpe._own_rows(pa.Table.from_batches([read]), ["k0"], 10, 20)
    assert kept["k0"].to_pylist() == list(range(10, 20)) and kept.get_total_buffer_size() < 1000


# 6


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_statistics(docs, edge, empty):
    rng = np.random.default_rng(7)
    rows = EDGE + [(1000 + i, "".join(rng.choice(list("ab \n#é"), rng.integers(0, 400)))) for i in range(60)]
    rows += [(2000, "one two three four five six seven eight nine " * 5), (2001, "a " * 40), (2002, ("x y z\n" * 3 + "q #\n") * 9)]
    got = quality.judge(docs(rows))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_id(got, *cols) == sorted(((d, *brute_statistics(t)) for d, t in rows), key=repr)
    assert got.where("base_failed and kept").isEmpty() and quality.judge(empty).isEmpty()


def test_outliers(docs):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    good = [(i, " ".join(word() for _ in range(80)), "en", f"s{i % 2}") for i in range(300)]
    bad = [(1000 + i, " ".join(word() + "%%%" for _ in range(80)), "en", f"s{i % 2}") for i in range(40)]
    lone = [(2000, " ".join(word() for _ in range(30)), None, None)]
    kept = {r.doc_id: r.kept for r in quality.judge(docs(good + bad + lone)).collect()}
    assert all(kept[d[0]] for d in good + lone) and not any(kept[d[0]] for d in bad)
    left = quality.keep(docs(good + bad + lone))
    assert sorted(r.doc_id for r in left.collect()) == sorted(d[0] for d in good + lone) and left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("share", [0.3, 0.4, 0.45])
def test_outliers_in_a_group_full_of_junk(docs, share):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    good = [(i, " ".join(word() for _ in range(80))) for i in range(200)]
    bad = [(1000 + i, " ".join(word() + "%%%" * rng.integers(1, 3) for _ in range(80))) for i in range(int(200 * share / (1 - share)))]
    kept = {r.doc_id: r.kept for r in quality.judge(docs(good + bad)).collect()}
    assert all(kept[d] for d, _ in good) and not any(kept[d] for d, _ in bad)


def test_null_sources_are_groups_of_their_own(docs):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    plain = [(i, " ".join(word() for _ in range(60)), "en", None) for i in range(80)]
    marked = [(1000 + i, " ".join(word() + "%%%" for _ in range(60)), "en", f"s{i}") for i in range(70)]
    rare = [(2000 + i, " ".join(word() for _ in range(60)), "xx", "s") for i in range(8)] + [(2100, " ".join(word() + "#" * 40 for _ in range(60)), "xx", "s")]
    kept = {r.doc_id: r.kept for r in quality.judge(docs(plain + marked + rare)).collect()}
    assert all(kept[d[0]] for d in plain + rare[:-1]) and not kept[2100]


def brute_mcd(x):
    """The least determinant of the half of a few points, by all their halves."""
    from itertools import combinations

    best = None
    for half in combinations(range(len(x)), len(x) // 2):
        c = np.cov(x[list(half)].T, bias=True) * quality.HALF / quality.chi2_cdf(quality.chi2_quantile(quality.HALF, 4), 6) + np.diag(np.square(quality.FLOOR))
        d = np.linalg.slogdet(c)[1]
        best = min(best or (d, half), (d, half))
    return best


def test_least_determinant(spark):
    rng = np.random.default_rng(11)
    for shift in (0, 8):
        x = rng.normal(size=(14, 4)) * [0.2, 0.6, 1.2, 0.2]
        x[10:] += shift
        df = spark.createDataFrame([("g", *map(float, r)) for r in x], "gid string, x_len double, x_sym double, x_line double, x_rep double")
        fit, _ = quality.robust_fit(df)
        got, (least, half) = fit.first(), brute_mcd(x)
        # The nearest half is cut at a bin of the distance, so the found one may differ by a point from the least.
        assert got.log_det <= least + 1.0
        if shift:
            assert max(abs(got[f"m{i}"] - x[:10, i].mean()) for i in range(4)) < 1.0


def test_estimates_have_settled(spark):
    """Further steps lower no determinant, and no verdict changes."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(300, 4)) * [0.2, 0.6, 1.2, 0.2], rng.normal(size=(140, 4)) * [0.3, 0.6, 1.2, 0.1] + 3])
    df = spark.createDataFrame([(f"g{i % 2}", *map(float, r)) for i, r in enumerate(x)], "gid string, x_len double, x_sym double, x_line double, x_rep double")
    fit, _ = quality.robust_fit(df)
    cut = quality.chi2_quantile(quality.HALF, 4)
    on, points = fit, quality.points(df)
    for _ in range(6):
        on = queries.materialize(quality._step(points, on, True, quality.HALF / quality.chi2_cdf(cut, 6)), "more")
    was, now = ({r.gid: r for r in f.collect()} for f in (fit, on))
    assert all(now[g].log_det >= was[g].log_det - 2 * quality.SETTLED for g in was)
    limit = quality.chi2_quantile(1 - quality.TAIL, 4)
    verdict = lambda f: sorted((r.gid, r.x_len, r.d2 <= limit) for r in quality._distance(df.join(f, "gid")).collect())
    assert verdict(fit) == verdict(on)


def test_chi_square():
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and quality.chi2_cdf(12.5916, 6) == pytest.approx(0.95, abs=1e-4)


# 7


def test_template(spark):
    frame = "<html><body><div><p>Same words everywhere</p></div><section><p>{}</p><p>{}</p></section><div>Share this</div></body></html>"
    pages = [(i, f"http://h/{i}", frame.format(f"story {i}", f"more {i * i}") + ("<p>tail</p>" if i == 3 else "")) for i in range(12)] + [(50, None, None), (51, "http://h/x", ""), (52, "http://lone/", "<p>Same words everywhere</p>")]
    pages += [(60 + i, "http://mirror/", "<p>all alike</p>") for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[5] == "story 5 more 25" and got[3] == "story 3 more 9 tail"
    assert got[50] == got[51] == "" and got[52] == "Same words everywhere" and got[63] == "all alike"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_induction_decides_without_telling_names(spark):
    """Names that say nothing: menus, adverts and footers that vary from page to page are told by their slots alone."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    rows, want = [], {}
    for i in range(40):
        title, paragraphs = words(4), [words(int(n)) for n in rng.integers(15, 60, rng.integers(1, 9))]
        menu = "".join(f"<li>{words(1)}</li>" for _ in range(rng.integers(3, 7)))
        note = "<div class='comments'><p>" + words(9) + "</p></div>" if i % 4 == 0 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        html = f"<html><body><div class='q1'><ul>{menu}</ul></div><div class='z7'><h1>{title}</h1><div class='z8'>{body}</div>{note}</div><div class='q2'>{words(8)}</div><div class='q3'>{words(5)}</div></body></html>"
        rows.append((i, "http://plain.org/a", html))
        want[i] = " ".join([title, *paragraphs])
    # Few pages of a host: only names are left.
    rows.append((100, "http://few.org/a", "<div class='menu'>m</div><div class='post'>text</div>"))
    want[100] = "text"
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:2]], "page_id long, url string, html string, text string, host int")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) + 2 and {r.page_id: r.text for r in got} == want


def test_long_and_deep_pages(spark):
    long = "<article><p>" + "word " * 100_000 + "</p></article>"
    rows = [(i, "http://h/", long) for i in range(6)] + [(9, "http://h/", "<div>" * 3000 + "deep")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got[0]) == 499_999 and got[9] == "deep"


def test_articles_of_the_pages_by_a_pattern(spark):
    """Every page of the smallest table against a plain reading of its fixed frame: what its one article holds, without marks."""
    import html
    from pathlib import Path

    path = Path("/root/testdata/sf0.001/pages.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    pages = spark.read.parquet(str(path)).select("page_id", "url", "html")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    articles = {r.page_id: re.findall(r"(?s)<article>(.*?)</article>", r.html or "") for r in pages.collect()}
    plain = {k: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", a[0])).split()) for k, a in articles.items() if len(a) == 1}
    assert len(plain) > 0.9 * len(got) and all(" ".join(got[k].split()) == t for k, t in plain.items())


# 9


def leaf_plan(leaves, budget, weights):
    """Water levels by bisection, from the root down."""
    def share(children, total):
        caps = {k: c for k, (w, c) in children.items() if w > 0}
        if total >= sum(caps.values()):
            return {k: caps.get(k, 0) for k in children}
        low, high = 0.0, 1e12
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(c, mid * children[k][0]) for k, c in caps.items()) < total else (low, mid)
        return {k: min(caps[k], high * children[k][0]) if k in caps else 0 for k in children}

    out, level = {}, {(): budget}
    for depth in (1, 2, 3):
        following = {}
        for path, total in level.items():
            kids = {}
            for leaf, tokens in leaves.items():
                if leaf[: depth - 1] == path:
                    w, c = kids.get(leaf[:depth], (weights.get(leaf[:depth], 1.0), 0))
                    kids[leaf[:depth]] = (w, c + 4 * tokens)
            following |= share(kids, total)
        level = following
    return level


def test_budgets(spark):
    leaves = {("a", "en", "s1"): 1000, ("a", "en", "s2"): 10, ("a", "de", "s1"): 50, ("b", "en", "s3"): 5000, ("b", "en", None): 40, ("b", None, "s4"): 7, ("c", "en", "s5"): 900}
    weights = {("a",): 3.0, ("b",): 1.0, ("c",): 0.0, ("a", "de"): 5.0, ("b", "en", "s3"): 2.0}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    for budget in (10, 500, 3000, 9000, 10**6):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, budget, weights).collect()}
        want = leaf_plan(leaves, budget, weights)
        assert all(abs(got[k] - want[k]) <= 1 for k in leaves), budget


def test_mix(docs, empty):
    rows = [(i, "w " * (1 + i % 7), ["en", "de", None][i % 3], f"src{i % 5}") for i in range(400)] + [(None, "x", "en", "src1"), (1000, None, "en", "src1"), (3, "w w", "en", None)]
    tokens = sum(len((r[1] or "").split()) for r in rows)
    out = mixing.mix(docs(rows), budget=900.0)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "domain", "n_tokens", "epoch"]
    used = sum(r.n_tokens for r in got)
    assert 900 - 8 * 15 <= used <= 900
    assert sum(r.n_tokens for r in mixing.mix(docs(rows), budget=1e9).collect()) == 4 * tokens
    assert mixing.mix(empty).isEmpty()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs(rows), budget=900.0).repartition(3).collect()))


# 10


def test_language_id(docs, empty):
    rng = np.random.default_rng(9)
    vocab = {"en": ["the", "of", "thing", "that"], "de": ["der", "und", "schön", "nicht"]}
    rows = [(i, " ".join(rng.choice(vocab[lang], 30)), lang) for i in range(300) for lang in [["en", "de"][i % 2]]]
    full = docs(rows + [(900, None, "en"), (901, "", None), (902, "42 !", "de"), (903, "the thing that", None)])
    model = language_id.learn(full)
    out = language_id.predict(full.select("doc_id", "text", F.lit(1).alias("score_")), model)
    got = {r.doc_id: r for r in out.collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) == 1.0 and not any(got[i].rejected for i, _, _ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 and got[i].rejected and got[i].cross_entropy is None for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(empty, model).isEmpty()
    none = language_id.predict(docs([(1, "text")]), language_id.train([])).first()
    assert none.lang_pred == "und" and none.rejected
    held = {r.doc_id: r.h for r in full.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())


def test_language_models_know_every_letter():
    """Thousands of Han and Hangul letters beside Latin ones: all are known, and each language keeps its own."""
    rng = np.random.default_rng(3)
    scripts = {"zh": (0x4E00, 9000), "ko": (0xAC00, 9000), "en": (0x61, 26), "math": (0x1D400, 50)}
    text = lambda lang, n: " ".join("".join(chr(scripts[lang][0] + int(x)) for x in rng.integers(0, scripts[lang][1], 6)) for _ in range(n))
    model = language_id.train([(lang, text(lang, 60)) for _ in range(100) for lang in scripts])
    assert sum(0xAC00 <= c <= 0xD7A3 for c in model.alphabet) > 7000 and sum(0x4E00 <= c <= 0x9FFF for c in model.alphabet) > 7000
    for lang in scripts:
        best, score, _, out = model.decide(*model.score([text(lang, 40) for _ in range(20)]))
        assert {model.languages[b] for b in best} == {lang} and not out.any() and (score > 0.9).all()
    # Of each context that was seen, the probabilities of all symbols sum to one.
    small = language_id.train([(lang, text("en", 30)) for _ in range(20) for lang in ("a", "b")])
    symbols = np.concatenate([[language_id.BOUNDARY, language_id.BLANK, language_id.UNSEEN], small.alphabet]).astype(np.uint64)
    for context in ("abcd", "the ", "zzzz"):
        lead = np.array([language_id.BLANK if c == " " else ord(c) for c in context], dtype=np.uint64)
        logs = np.concatenate([small.log_probs(np.concatenate([lead, [x]]).astype(np.uint64)) for x in symbols])
        assert np.exp(logs.astype(np.float64)).sum(axis=0) == pytest.approx(1.0, abs=1e-4)


def test_training_sample(docs):
    rows = [(i, f"text {i} " * 5, f"l{i % 300}") for i in range(900)] + [(1000, "x " * 5000, "l0"), (None, "no id", "l1"), (5, "text 5 " * 5, "l5")]
    got = language_id.training_rows(docs(rows), rows=2, size=4000)
    assert {g for g, _ in got} == {f"l{i}" for i in range(300)} and max(Counter(g for g, _ in got).values()) == 2 and all(len(t) < 4000 for _, t in got)


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.predict(table, language_id.learn(table)).where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    rows = out.select("lang", "lang_pred").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.99


# all


def test_results_take_the_place_of_clashing_columns(docs):
    full = docs([(i, f"the thing that {i} of the thing", "en", "src1") for i in range(30)])
    for c in ("lang_pred", "score", "kept", "n_words", "fp", "component_id", "n_tokens", "epoch", "domain", "D2"):
        full = full.withColumn(c, F.lit("old"))
    model = language_id.learn(full)
    assert language_id.predict(full, model).where("lang_pred = 'en'").count() == 30
    assert quality.judge(full).where("n_words = 7 and not kept").count() == 30
    assert simhash.near_duplicates(full).where("component_id >= 0").count() == 30
    assert mixing.mix(full, budget=1e6).where("epoch < 4 and n_tokens = 7 and domain = 'news'").count() == 120
