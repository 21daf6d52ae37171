"""Fill-in-the-middle: against a brute-force version in Python, and its edge cases."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import fim, queries

EDGE = [
    (1, None), (2, ""), (3, "plain <P> inside"), (4, "a<S"), (5, "<M>"), (6, "\u0001\u0002\u00021\u00010\u0002 0"), (7, "ünï 😀 word\r\n two"), (8, "x" * 100_000 + " 9" * 100_000), (8, "ünï"), (9, "abc"), (9, "abc"), (None, "no id at all"),
    *[(i, "One <P two> S> <M three, four; five " * (i % 4)) for i in range(10, 90)],
]


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_against_brute_force(docs):
    rows = fim.transform(docs(EDGE)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = [(r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in rows]
    assert sorted(got, key=repr) == sorted([brute(*r) for r in EDGE], key=repr)
    assert sorted((r.doc_id or -1, r.back) for r in rows) == sorted((i or -1, t or "") for i, t in EDGE)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_query_digests(spark, docs, tmp_path):
    docs(EDGE).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op11_fim(spark, str(tmp_path)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()]
    want = [(*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t or "")) for i, t in EDGE]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_odd_tables(spark, docs):
    assert fim.transform(docs([])).isEmpty()
    clash = docs([(1, "one two three")]).selectExpr("*", "'x' as form", "7 as N", "'y' as output", "array(1) as other")
    out = fim.transform(clash)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "other", "n", "form", "prefix", "middle", "suffix", "output"]
    assert out.first().n == 5 and out.first().other == [1]
    renamed = fim.transform(spark.createDataFrame([("k", "a b")], "output string, body string"), "output", "body")
    assert renamed.columns[:2] == ["output", "body"] and renamed.first()[0] == "k"


def test_shares(spark):
    """About 90 % of texts are transformed, a fifth of them in the order suffix, prefix, middle; other shares can be asked for."""
    many = spark.range(4000).selectExpr("id as doc_id", "'some words to cut' as text")
    count = {r.form: r["count"] for r in fim.transform(many).groupBy("form").count().collect()}
    assert 300 < count["plain"] < 500 and 0.17 < count["spm"] / (count["spm"] + count["psm"]) < 0.23
    assert fim.transform(many, plain_percent=0, spm_percent=100).where("form <> 'spm'").isEmpty()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab\u0001\u000201 <PSM>\né", max_size=40), min_size=20, max_size=40))
def test_any_text(spark, texts):
    rows = list(enumerate(texts))
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    out = [(r.doc_id, r.n, r.form, r.output, r.back) for r in got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()]
    assert sorted(out) == [(i, (b := brute(i, t))[1], b[2], b[5], t) for i, t in rows]
