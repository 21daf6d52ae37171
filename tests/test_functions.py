import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.operators import router as R
from marginalia.operators.chunks import cut


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in cols.items())).select(expr).first()[0]


@pytest.mark.parametrize("query,kind", [("find my note about docker", "filename_focus"), ("where did I mention network host mode", "snippet_focus"), ("how can QA engineers use Docker", "mixed"), ("entitled", "filename_focus")])
def test_query_type(spark, query, kind):
    assert one(spark, T.query_type(F.col("q")), q=query) == kind


@pytest.mark.parametrize("query,tokens", [("notes with sql in the title", ["sql"]), ("where did I note restart apache2.service", ["restart", "apache2", "service"]), ("find the note", ["find", "the", "note"]), ("", [])])
def test_content_tokens(spark, query, tokens):
    assert one(spark, T.content_tokens(F.col("q")), q=query) == tokens


def test_literal_terms(spark):
    assert one(spark, T.literal_terms(F.col("q")), q="where did I note restart (apache2.service), a.b /x/ ok") == ["apache2.service"]


@pytest.mark.parametrize(
    "query,path,score",
    [
        ("find my note about docker", "Docker.txt", 0.995), ("find my note about docker", "Docker in QA.md", 0.988), ("notes with sql in the title", "SQL Dev.txt", 0.949667), ("find the note", "x/The Note.md", 0.85),
        ("find my note about docker", "docker.config.txt", 0.753667), ("find my note about backups", "zzz qqq.md", 0.2), ("find my note about dock", "Docker.txt", 0.794), ("", "a.md", 0.0),
    ],
)
def test_filename_match(spark, query, path, score):
    got = one(spark, S.filename_match(S.query_features(F.col("q")), S.path_features(F.col("p"))), q=query, p=path)
    assert round(got, 6) == score


def test_line_scores(spark):
    q, d = S.query_features(F.col("q")), S.text_features(F.col("t"))
    row = spark.createDataFrame([("where did I say switch to someplace.xyz", "- switch to someplace.xyz")], "q string, t string").select(
        S.phrase_match(q, d["norm"]), S.text_match(q["phrase"], q["toks"], d["lower"], d["tokens"]), S.keyword(q["toks"], d["tokens"]), S.ordered_match(q["toks"], d["norm"]),
        S.literal_match(q["terms"], d["lower"]), F.round(S.line_quality(F.col("t"), d["tokens"], d["norm"]), 6),
    ).first()
    assert list(row) == [0.0, 1.0, 1.0, 1.0, 1.0, 0.283333]


def test_rank_score(spark):
    assert [r[0] for r in spark.range(1, 6).select(S.rank_score(F.col("id"), F.lit(5))).collect()] == [1.0, 0.75, 0.5, 0.25, 0.0]
    assert spark.range(1).select(S.rank_score(F.lit(1), F.lit(1))).first()[0] == 1.0


def test_lines_and_decoding(spark):
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\rc\x0bd e\n") == ["a", "b", "c", "d", "e"]
    assert one(spark, T.lines(F.col("t")), t="") == []
    assert one(spark, T.trim_snippet(F.col("t")), t="x " * 300) == ("x " * 300)[:217].rstrip() + "..."
    raw = spark.createDataFrame([(bytearray(b"a\r\nb\xffc\rd"),)], "b binary")
    assert raw.select(T.decode(F.col("b"))).first()[0] == "a\nb�c\nd"


@pytest.mark.parametrize("path,stem", [("a/b/c.md", "c"), ("a.tar.md", "a.tar"), (".hidden", ".hidden"), ("x/.h.md", ".h"), ("plain", "plain")])
def test_stem(spark, path, stem):
    assert one(spark, T.stem(F.col("p")), p=path) == stem


@pytest.mark.parametrize("start,heading", [(1, None), (2, "Top"), (4, "Two"), (5, "Two"), (6, "!"), (7, None)])
def test_heading_before(spark, start, heading):
    assert one(spark, T.heading_before(T.lines(F.lit("# Top\na\n## Two\nb\n#!\n###\nc")), F.col("s")), s=start) == heading


@pytest.mark.parametrize("seconds,text", [(5.0, "00:05"), (3725.0, "1:02:05"), (-1.0, "--:--"), (float("inf"), "--:--")])
def test_clock(spark, seconds, text):
    assert one(spark, T.clock(F.col("s")), s=seconds) == text


@pytest.mark.parametrize(
    "text,mode,extra",
    [
        ("/help", "command", "help"), ("/eval-promote 1 2", "command", "eval_promote"), ("Reindex  NOW", "command", "reindex"), ("promote eval candidates 3", "command", "eval_promote"),
        ("what files have been indexed?", "notes_search", None), ("what files have been indexed", "command", "indexed"), ("open docker.md", "note_open", "docker.md"),
        ("show me the contents of a/b/c.md", "note_open", "a/b/c.md"), ("show me the second result", "note_open", 2), ("open result #3", "note_open", 3), ("where did i put the keys", "notes_search", None),
        ("list documents about spark", "notes_search", None), ("hello there", "general_chat", None), ("", "general_chat", None),
    ],
)
def test_route(spark, text, mode, extra):
    r = one(spark, R.route(F.col("t")), t=text)
    assert r["mode"] == mode
    assert extra in (None, r["command_name"], r["note_path_hint"], r["note_result_index"])


@pytest.mark.parametrize("text,target", [("Which files have the most IP addresses", "ip"), ("what files contain many links", "url"), ("which file has lots of api keys", "api_key"), ("what file has the most SQL statements", "sql"), ("how many emails", None)])
def test_density_target(spark, text, target):
    assert one(spark, R.density_target(F.col("t")), t=text) == target


def test_cut_golden():
    assert len(cut("x" * 4000)) == 1
    assert [c[0] for c in cut("x" * 4001)] == [0, 1] and len(cut("x" * 4001)[1][3]) == 501
    assert cut("") == [] and cut("   \n ") == []
    assert [c[3] for c in cut("a" * 70 + "\n\n" + "b" * 60, 100, 0)] == ["a" * 70, "b" * 60]
    # a blank line before 60 % of the window, or within the overlap, does not end a chunk
    assert len(cut("a" * 30 + "\n\n" + "b" * 60, 100, 0)) == 1
    assert len(cut("a" * 70 + "\n\n" + "b" * 20, 100, 80)) == 1


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 60), st.integers(0, 70))
def test_cut_covers_everything(text, size, overlap):
    chunks = cut(text, size, overlap)
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    assert all(c[1] <= c[2] and len(c[3]) <= size and c[3] == c[3].strip() != "" for c in chunks)
    at = 0
    for c in chunks:  # chunks appear in order, and together hold every non-blank character
        at = text.index(c[3], max(0, at - size - overlap))
    assert set("".join(text.split())) == set("".join("".join(c[3].split()) for c in chunks))
