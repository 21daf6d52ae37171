"""The inverted index lets through every line that matters: the same best lines as a scan of all lines, on texts and queries made to mislead it."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import scores
from marginalia.operators import postings, scan, search
from marginalia.sources import scratch

WORDS = ("aab", "aabc", "baab", "cab", "cabb", "abcab", "o'aab", "that", "thatt", "Sthat", "the", "ab", "b.aab", "x_y-z", "a/b.c", "...-", "AAB", "Kaab", "İcab", "caféaab", "12", "345")
GAPS = (" ", "  ", "\t", ", ", ". ", "-", " ", "\n", "\r\n")


def made(rng, n_words):
    out = ""
    for _ in range(n_words):
        out += rng.choice(WORDS) + rng.choice(GAPS)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_best_lines_as_a_scan(spark, seed):
    rng = random.Random(seed)
    notes = spark.createDataFrame([(f"n{i}.md", made(rng, rng.randint(0, 60))) for i in range(60)] + [("null.md", None), ("empty.md", "")], "rel_path string, text string")
    texts = [made(rng, k).replace("\n", " ") for k in (1, 1, 1, 2, 2, 3, 3, 3, 4, 5, 6, 8, 12, 20, 40)] + ["", "the", "...-", "x_y-z", "a/b.c 345", "aab aab aab cab"]
    queries = search.with_features(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"))
    index = postings.build(notes)
    cols = ["query_id", "rel_path", "line", "score", "literal", "phrase", "ordered", "text", "keyword", "quality"]
    matters = F.col("score") >= postings.LEAST / 100
    got = sorted(map(tuple, postings.best_lines(index, queries).where(matters).select(*cols).collect()))
    want = sorted(map(tuple, search.best_lines(queries, notes).where(matters).select(*cols).collect()))
    assert got == want and len(want) > 100


def every_line(queries, notes):
    """The best lines by scoring every line for every query."""
    lines = postings.line_rows(notes).withColumn("d", scores.text_features(F.col("content")))
    return scores.best_of_lines(lines.crossJoin(queries.select("query_id", "q")))


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_one_pass_and_pruned_scan_against_every_line(spark, seed, monkeypatch):
    monkeypatch.setattr(scan, "CELLS", 100)
    monkeypatch.setattr(scan, "LINES", 7)
    rng = random.Random(seed)
    words = [*WORDS, "\u0130cab", "\u212aaab", "aab\u212a"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(GAPS) for _ in range(n))
    notes = spark.createDataFrame([(f"n{i}.md", text(rng.randint(0, 60))) for i in range(60)] + [("null.md", None), ("empty.md", "")], "rel_path string, text string")
    texts = [text(k).replace("\n", " ") for k in (1, 1, 1, 2, 2, 3, 3, 3, 4, 5, 6, 8, 12, 20, 40)] + ["", "the", "...-", "x_y-z", "a/b.c 345", "aab aab aab cab"]
    queries = search.with_features(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"))
    cols = ["query_id", "rel_path", "line", "score", "literal", "phrase", "ordered", "text", "keyword", "quality"]
    brute = every_line(queries, notes)
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(search.best_lines(queries, notes)) == rows(brute)
    matters = F.col("score") >= postings.LEAST / 100
    found = rows(postings.best_of(scan.candidate_lines(notes, queries), queries).where(matters))
    assert found == rows(brute.where(matters)) and len(found) > 100


def test_one_batch_writes_no_index(spark, monkeypatch):
    """Without an index the channel looks up the batch in one pass: it builds and writes nothing."""
    queries = search.with_features(spark.createDataFrame([(1, "find the passage rare7 words here"), (2, "where did I mention that"), (3, "snippet with x_y-z")], "query_id long, query string"))
    notes = spark.createDataFrame([(f"n{i}", "\n".join(f"common words rare{i} words here {j}" for j in range(20))) for i in range(30)], "rel_path string, text string")
    made = []
    monkeypatch.setattr(scratch, "new_path", lambda *a, f=scratch.new_path: made.append(a[1]) or f(*a))
    monkeypatch.setattr(postings, "new_path", scratch.new_path)
    assert {r.rel_path for r in search.text_channel(queries, notes).where("query_id = 1").collect()} >= {"n7"}
    assert made == []
    assert scan.candidate_lines(notes, queries.where("query_id = 3")).isEmpty()


def test_few_lines_are_scored(spark):
    """A query of rare words reads few lines; no word of the index, no line."""
    notes = spark.createDataFrame([(f"n{i}", "\n".join(f"common words and number{i}x{j} here" for j in range(50))) for i in range(40)], "rel_path string, text string")
    index = postings.build(notes)
    ask = lambda *texts: search.with_features(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"))
    assert index.lines.count() == 2000
    assert postings.candidate_lines(index, ask("number7x9")).count() == 1
    assert postings.candidate_lines(index, ask("unknown things entirely")).isEmpty()
    assert postings.candidate_lines(index, ask("number7x9 number8x9 elsewhere")).count() <= 2


def test_neighbours(spark):
    notes = spark.createDataFrame([("a", "One two, three\nthree two one")], "rel_path string, text string")
    rows = sorted((r.line, r.word, r.before or "", r.after or "") for r in postings.build(notes).postings.collect())
    assert rows == [(0, "one", "", "two"), (0, "three", "two", ""), (0, "two", "one", "three"), (1, "one", "two", ""), (1, "three", "", "two"), (1, "two", "three", "one")]


def test_features_of_a_line_come_with_it(spark):
    """A line that several queries may find is read once for all of them: its features and quality come with it."""
    queries = search.with_features(spark.createDataFrame([(i, f"find the passage rare7 words number{i}") for i in range(5)], "query_id long, query string"))
    notes = spark.createDataFrame([("a", "rare7 words here\nnothing"), ("b", "- rare7 words:")], "rel_path string, text string")
    found = scan.candidate_lines(notes, queries)
    assert sorted((r.query_id, r.rel_path, r.content, tuple(r.d.tokens)) for r in found.collect()) == sorted((i, p, c, t) for i in range(5) for p, c, t in (("a", "rare7 words here", ("rare7", "words", "here")), ("b", "- rare7 words:", ("rare7", "words"))))
    assert found.where("rel_path = 'b' and quality <= 0.18").isEmpty()
