import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import density, evaluation, grounding, index, listing, search, vectors
from marginalia.plans import queries, testdata
from marginalia.sources import jsonl, manifest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(
    "target,text,total,uniques",
    [
        ("ip", "10.0.0.1 10.0.0.1 999.1.1.1 1.2.3", 2, 1), ("email", "A@b.com a@B.com x@y", 2, 1), ("url", "see http://a.b/c). and https://x.y, http://a.b/c", 3, 2),
        ("api_key", "sk-" + "a" * 16 + " AKIA" + "A" * 16 + " ghp_" + "b" * 20 + " xoxb-" + "1" * 10 + " AIza" + "c" * 35 + " sk-short", 5, 5),
        ("credit_card", "4111 1111 1111 1111, 4111-1111-1111-1111 and 4111 1111 1111 1112", 2, 1),
        ("sql", "x\nSELECT a\nFROM t\n FROM u;\nselect 1;\ndelete from t\nWith regards to you", 2, 2),
    ],
)
def test_density(spark, target, text, total, uniques):
    notes = spark.createDataFrame([("a.md", text), ("b.md", "nothing"), ("c.md", "")], "rel_path string, text string")
    assert rows(density.density(notes, target), "rel_path", "total", "uniques") == [("a.md", total, uniques)]


def test_density_report(spark):
    notes = spark.createDataFrame([(f"n{i:02d}.md", "1.1.1.1 " * (i % 3 + 1)) for i in range(12)], "rel_path string, text string")
    lines = density.report(notes, "ip").split("\n")
    assert lines[0].startswith("Top files by IPv4 address count (12 file(s)") and lines[1] == "- n11.md: 3 match(es), 1 unique" and lines[-1] == "... (2 more)"
    assert density.report(notes, "url") == "No indexed files contain URLs."


def test_rerank_and_budget(spark):
    q = spark.createDataFrame([(0, "alpha beta", [0.0, 0.0])], "query_id long, query string, embedding array<double>")
    v = spark.createDataFrame([(i, [float(i), 0.0], t) for i, t in enumerate(["x", "alpha", "alpha beta", "y"])], "id long, embedding array<double>, text string")
    near = vectors.nearest(q, v, 4)
    assert rows(near, "rank", "id") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    best = vectors.hybrid_rerank(q, near, 3)
    assert [(r.id, round(r.score, 6)) for r in best.orderBy("new_rank").collect()] == [(0, 0.75), (1, 0.625), (2, 0.5)]
    assert [r.text for r in vectors.within_budget(best, 4).orderBy("new_rank").collect()] == ["x", "alp"]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = {
        "Docker.txt": "Docker basics\nrun with --network host\n", "net/hosts.md": "# Hosts\n- use network host mode for speed\nend", "SQL Dev.txt": "joins", "empty.md": "",
    }
    notes = spark.createDataFrame([(p, t, 1.0, len(t)) for p, t in docs.items()], "rel_path string, text string, mtime double, size long")
    chunks = spark.createDataFrame([(str(i), p, 0, 1, 2, None, t.split("\n")[0], t, [float(i), 1.0]) for i, (p, t) in enumerate(docs.items()) if t], "id string, rel_path string, chunk_index int, start_line int, end_line int, heading string, first_line string, text string, embedding array<double>")
    return notes, chunks


def test_search(spark, corpus):
    q = spark.createDataFrame([(0, "find my note about docker", [0.0, 1.0]), (1, "where did I mention network host mode", [0.0, 1.0])], "query_id long, query string, embedding array<double>")
    hits = search.search(q, *corpus, limit=3)
    first = {r.query_id: r for r in hits.where("rank = 1").collect()}
    named = search.filename_channel(search.with_features(q), corpus[0]).where("query_id = 0").first()
    assert (named.rel_path, round(named.score, 5), named.reasons, named.snippet) == ("Docker.txt", 0.98955, ["filename"], "Docker basics")
    assert first[0].rel_path == "Docker.txt" and round(first[0].score, 6) == 0.998 and first[0].query_type == "filename_focus"
    assert first[1].rel_path == "net/hosts.md" and "use network host mode" in first[1].snippet and (first[1].start_line, first[1].end_line) == (1, 3)
    assert hits.groupBy("query_id", "rel_path").count().where("count > 1").isEmpty()
    text = search.format_results("q", hits.where("query_id = 0").orderBy("rank").collect())
    assert text.startswith("Top matches for: q\n1. Docker.txt:1-2\n   reasons: filename, phrase, heading, text, keyword, semantic\n")


def test_search_deals_out_no_texts(spark, corpus):
    """Texts are read where they are: neighbours are found without them, and text hits get snippets when the best are known."""
    q = search.with_features(spark.createDataFrame([(0, "find my note about docker", [0.0, 1.0]), (1, "where did I mention network host mode", [0.0, 1.0])], "query_id long, query string, embedding array<double>"))
    hits, whole = search.text_hits(q, corpus[0]), search.text_channel(q, corpus[0])
    rest = [c for c in search.HIT if c != "snippet"]
    assert rows(hits, *rest) == rows(whole, *rest) and whole.count() > 0 and hits.where("snippet is not null").isEmpty()
    assert rows(search.with_snippets(hits, corpus[0]), *search.HIT) == rows(whole, *search.HIT)
    near = vectors.nearest(q, corpus[1], 2)
    found = [r for r in near.select("query_id", "id", "rank", "text").collect()]
    assert sorted((r.query_id, r.id, r["rank"]) for r in found) == sorted(map(tuple, vectors.nearest(q, corpus[1].select("id", "embedding"), 2).select("query_id", "id", "rank").collect()))
    assert {r.id: r.text for r in found}.items() <= {r.id: r.text for r in corpus[1].collect()}.items()


def test_listing(spark, corpus):
    notes, _ = corpus
    assert rows(listing.find_files(notes, "HOST", "both"), "rel_path", "filename_match", "text_match") == [("Docker.txt", False, True), ("net/hosts.md", True, True)]
    assert rows(listing.find_files(notes, "host", "filename"), "rel_path", "text_match") == [("net/hosts.md", False)]
    assert listing.find_files(notes, "  ").isEmpty()
    with pytest.raises(ValueError):
        listing.find_files(notes, "x", "all")
    assert [(r.rel_path, r.total, r.has_more) for r in listing.page(notes, 2, 1).orderBy("rel_path").collect()] == [("SQL Dev.txt", 4, True), ("empty.md", 4, True)]
    asked = spark.createDataFrame([("net/hosts.md", 3, 2), ("net/hosts.md", 9, None), ("empty.md", None, None)], "rel_path string, start_line int, end_line int")
    got = rows(listing.excerpts(asked, notes), "rel_path", "start_line", "end_line", "text")
    assert got == [("empty.md", 0, 1, ""), ("net/hosts.md", 2, 3, "- use network host mode for speed\nend"), ("net/hosts.md", 3, 9, "end")]
    files = spark.createDataFrame([("a/b/c.md",), ("d/c.md",), ("b/c.md",)], "rel_path string")
    hint = spark.createDataFrame([("b/c.md",), ("C.md",), ("x/b/c.md",)], "hint string")
    got = rows(listing.resolve(hint, files), "hint", "rel_path", "tier")
    assert ("b/c.md", "b/c.md", 1) in got and len([g for g in got if g[0] == "C.md"]) == 3
    assert {g[1] for g in got if g[0] == "x/b/c.md"} == {"a/b/c.md", "b/c.md", "d/c.md"}


def test_validate(spark):
    want = [
        "OK", "Missing required sections.", "No evidence bullets.", "Evidence bullet missing quotes.", "Evidence bullet missing valid citation format.", "Citation not in provided sources: c/d.md:1-3",
        "Citation not in provided sources: a/b.md:4-9", "OK",
    ]
    df = spark.createDataFrame(list(enumerate(testdata.ANSWERS)), "i int, t string").select("i", grounding.validate_answer(F.col("t"), F.array(F.lit("a/b.md:1-3"))).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == want


def test_sources_block(spark):
    ranked = spark.createDataFrame([(0, 1, "a.md", 1, 2, " one "), (0, 2, "b.md", 3, 4, "two" * 50), (0, 3, "c.md", 1, 1, "x")], "query_id long, new_rank int, rel_path string, start_line int, end_line int, text string")
    packed = grounding.packed_sources(ranked, 60)
    assert grounding.sources_block(packed).first().sources == "[SOURCE 1] a.md:1-2\none"
    assert grounding.allowed_citations(packed).first().allowed == ["a.md:1-2"]


def test_index_lifecycle(spark, tmp_path):
    schema = "rel_path string, mtime double, size long, text string"
    make = lambda *r: spark.createDataFrame([(p, m, len(t), t) for p, m, t in r], schema)
    at = str(tmp_path / "index")
    assert index.index_once(spark, make(("a.md", 1.0, "# A\nx"), ("b.md", 1.0, "y" * 5000)), at) == {"scanned": 2, "updated": 2, "deleted": 0, "errors": 0}
    assert index.index_once(spark, make(("a.md", 1.0, "# A\nx"), ("b.md", 1.0, "y" * 5000)), at)["updated"] == 0
    got = index.index_once(spark, make(("a.md", 2.0, "# A\nz"), ("c.md", 1.0, "c")), at)
    assert got == {"scanned": 2, "updated": 2, "deleted": 1, "errors": 0}
    now = manifest.current(spark, at)
    assert rows(now.chunks, "rel_path", "text") == [("a.md", "# A\nz"), ("c.md", "c")] and rows(now.files, "rel_path", "mtime") == [("a.md", 2.0), ("c.md", 1.0)]
    before = now.buckets
    assert index.index_once(spark, make(("a.md", 2.0, "# A\nz"), ("c.md", 5.0, "cc")), at)["updated"] == 1
    now = manifest.current(spark, at)
    assert len({*now.buckets.values()} & {*before.values()}) == 1  # the bucket of a.md is where it was
    assert rows(now.chunks, "rel_path", "text") == [("a.md", "# A\nz"), ("c.md", "cc")]
    assert index.index_once(spark, make(("a.md", 2.0, "# A\nz"), ("c.md", 5.0, "cc")), at, force=True)["updated"] == 2
    big = index.index_once(spark, make(("a.md", 2.0, "# A\nz"), ("c.md", 3.0, "c" * 100)), at, index.IndexConfig(max_file_size_mb=0.00001))
    assert big["errors"] == 1


def test_log_round_trip(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    hit = {"rel_path": "a.md", "snippet": "s", "score": 0.5}
    lines = [json.dumps({"ts": 1, "query": " q1 ", "top_hits": [hit]}), "", "not json", "[1]", json.dumps({"ts": 2, "query": "  "}), json.dumps({"ts": 3, "query": "q2", "query_type": "odd", "top_hits": []}), json.dumps({"query": "q3", "top_hits": [hit]}), json.dumps({"ts": 5, "query": "q1", "query_type": "snippet_focus", "top_hits": [hit]})]
    path.write_text("\n".join(lines) + "\n")
    log = jsonl.read_log(spark, str(path))
    assert sorted((r.query, r.ts, r.query_type) for r in log.collect()) == [("q1", 1.0, "mixed"), ("q1", 5.0, "snippet_focus"), ("q2", 3.0, "odd"), ("q3", 0.0, "mixed")]
    found = evaluation.candidates(log, spark.createDataFrame([], "query string"))
    assert [(r.n, r.query, r.expected_paths, r.expected_query_type) for r in found.orderBy("n").collect()] == [(1, "q3", ["a.md"], "mixed"), (2, "q1", ["a.md"], "snippet_focus")]
    cases, left = evaluation.promote(found, spark.createDataFrame([("q3",)], "query string"), [1, 2])
    assert rows(cases, "query") == [("q1",), ("q3",)] and left.isEmpty()
    out = tmp_path / "c" / "candidates.json"
    assert jsonl.write_candidates(found, str(out)) == 2
    assert rows(jsonl.read_candidates(spark, str(out)), "n", "query") == [(1, "q3"), (2, "q1")]


def test_cases_are_strict(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps([{"query": "q", "expected_paths": ["a"], "expected_snippet_terms": ["X"]}]))
    assert jsonl.read_cases(spark, str(good)).first().expected_snippet_terms == ["x"]
    for bad in ({"query": "q", "expected_paths": []}, {"expected_paths": ["a"]}, {"query": "q", "expected_paths": ["a"], "expected_query_type": "odd"}):
        p = tmp_path / "bad.json"
        p.write_text(json.dumps([bad]))
        with pytest.raises(Exception, match="case needs|unknown expected"):
            jsonl.read_cases(spark, str(p)).collect()


def test_selections():
    assert evaluation.parse_selections(["1", "8-5", "2", "1"], 6) == [1, 5, 6, 2]
    assert evaluation.parse_selections([], 5) is None and evaluation.parse_selections(["ALL"], 5) is None
    with pytest.raises(ValueError):
        evaluation.parse_selections(["x"], 5)


def test_rates(spark):
    cases = spark.createDataFrame([(0, ["a", "b"], ["term"], "mixed"), (1, ["z"], [], None)], "query_id long, expected_paths array<string>, expected_snippet_terms array<string>, expected_query_type string")
    hits = spark.createDataFrame([(0, 1, "x", "term", "mixed"), (0, 2, "b", "no", "mixed"), (0, 4, "a", "The  TERM", "mixed")], "query_id long, rank int, rel_path string, snippet string, query_type string")
    ranked = evaluation.case_ranks(cases, hits)
    assert rows(ranked.where("query_id = 0"), "rank", "snippet_rank") == [(2, 4)]
    r = evaluation.rates(ranked).first()
    assert (r.cases, r.hit_1, r.hit_3, r.hit_limit, r.type_hits, r.snippet_cases, r.snippet_3, r.snippet_limit) == (2, 0, 1, 1, 1, 1, 0, 1)
    assert evaluation.summary(r).startswith("Summary: hit@1=0/2 (0.0%), hit@3=1/2 (50.0%)")


def test_read_through(spark, tmp_path):
    cache = manifest.embedding_cache(spark, str(tmp_path / "cache"))
    cache.upsert(spark.createDataFrame([("k1", "m", "t1", [1.0])], manifest.CACHE))
    wanted = spark.createDataFrame([("k1", "m", "t1", 1), ("k2", "m", "t2", 2), ("k2", "m", "t2", 3)], "cache_key string, model string, query_text string, query_id int")
    asked = []

    def embed(df):
        asked.extend(r.cache_key for r in df.collect())
        return df.withColumn("embedding", F.array(F.lit(2.0).cast("float")))

    for _ in range(2):  # the second time all is there
        got = manifest.read_through(wanted, cache, embed)
        assert sorted((r.query_id, r.embedding) for r in got.collect()) == [(1, [1.0]), (2, [2.0]), (3, [2.0])]
    assert asked == ["k2"] and cache.read().count() == 2 and cache.version == 2


def test_metadata_score_of_texts_without_lines(spark, tmp_path):
    """An empty text has no first line, and neither has a null one: name and path alone are scored, as in the SQL."""
    docs = [(1, "", "en", "src11"), (2, None, "en", "src11"), (3, "\n", "en", "src11"), (4, "note about src11\nb", "en", "src11"), (5, "", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["metadata_score"](spark, str(tmp_path)).where("query_id = 1")
    assert sorted((r.rel_path or "", r.score) for r in got.collect()) == [("", 0.0), *((f"en/src11/doc_{i}.txt", s) for i, s in ((1, 0.0), (2, 0.0), (3, 0.0), (4, 1.0)))]
