"""Keyed tables, pointers, error channels, listing of folders, JSON files, answers in batches and kept state."""

import json
import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunks, grounding, index
from marginalia.providers import BatchEmbedding
from marginalia.sources import files, jsonl, manifest, pointers
from marginalia.sources.keyed import KeyedTable
from marginalia.streaming.index_stream import keep_changes

SCHEMA = "k string, v int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=8)
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert t.read().isEmpty() and t.lookup("a").isEmpty() and t.version == 0
    assert t.upsert(make(*[(f"k{i}", i) for i in range(40)])) == 1
    before = t._state()[1]
    assert t.merge(make(("k3", 300), ("new", 1)), make(("k4", 0)).select("k")) == 2
    assert rows(t.read()) == sorted([(f"k{i}", 300 if i == 3 else i) for i in range(40) if i != 4] + [("new", 1)])
    assert rows(t.lookup("k3")) == [("k3", 300)] and t.lookup("k4").isEmpty()
    now = t._state()[1]
    assert sum(now.get(b) == before[b] for b in before) >= 5  # untouched buckets are where they were
    assert t.delete(t.read().select("k")) == 3 and t.read().isEmpty()
    t.upsert(make(("z", 9)))
    assert t.vacuum(1) >= 2 and rows(t.read()) == [("z", 9)]
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=9).read()


def test_writers_that_race_or_die(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    one, two = (KeyedTable(spark, at, SCHEMA, "k") for _ in range(2))
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    one.upsert(make(("a", 1)))
    real = pointers.publish
    # A writer that dies after its data and before its pointer: the old version stays, and the next writer goes on.
    monkeypatch.setattr(pointers, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        one.upsert(make(("a", 2)))
    monkeypatch.setattr(pointers, "publish", real)
    assert rows(two.read()) == [("a", 1)]
    # One that dies while it writes the pointer: what it left is passed over.
    (tmp_path / "t" / "pointers" / "000000000002.json").write_text('{"buckets": 32, "fold')
    assert rows(two.read()) == [("a", 1)] and two.upsert(make(("b", 2))) == 3 and rows(one.read()) == [("a", 1), ("b", 2)]
    # Two writers from one version: the second gets a conflict, and nothing of it is seen.
    seen = two._state()
    one.upsert(make(("c", 3)))
    monkeypatch.setattr(two, "_state", lambda: seen)
    with pytest.raises(pointers.Conflict):
        two.upsert(make(("d", 4)))
    assert rows(one.read()) == [("a", 1), ("b", 2), ("c", 3)]


def note_rows(spark, *r):
    return spark.createDataFrame([(p, m, len(t), t) for p, m, t in r], "rel_path string, mtime double, size long, text string")


def test_index_survives_a_crash(spark, tmp_path, monkeypatch):
    at, real = str(tmp_path / "i"), pointers.publish
    index.index_once(spark, note_rows(spark, ("a.md", 1.0, "one")), at)
    monkeypatch.setattr(pointers, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        index.index_once(spark, note_rows(spark, ("a.md", 2.0, "two")), at)
    monkeypatch.setattr(pointers, "publish", real)
    assert rows(manifest.current(spark, at).chunks, "rel_path", "text") == [("a.md", "one")]
    index.index_once(spark, note_rows(spark, ("a.md", 2.0, "two")), at)
    assert rows(manifest.current(spark, at).chunks, "rel_path", "text") == [("a.md", "two")]


def poisoned(text, size, overlap):
    if "poison" in text:
        raise ValueError("cannot cut this")
    return chunks.cut(text, size, overlap)


def test_a_failing_note_costs_no_other(spark, tmp_path):
    at, seen = str(tmp_path / "i"), []
    config = index.IndexConfig(cutter=poisoned)
    assert index.index_once(spark, note_rows(spark, ("a.md", 1.0, "fine"), ("b.md", 1.0, "poison")), at, config, progress=lambda **x: seen.append(x)) == {"scanned": 2, "updated": 1, "deleted": 0, "errors": 1}
    assert [x["phase"] for x in seen] == ["scan", "chunk", "commit", "done"] and (seen[1]["chunks"], seen[1]["failed"]) == (1, 1)
    now = manifest.current(spark, at)
    assert rows(now.files, "rel_path") == [("a.md",)] and rows(now.chunks, "rel_path") == [("a.md",)]
    # A note that was indexed keeps its chunks when it fails later, and is tried again.
    assert index.index_once(spark, note_rows(spark, ("a.md", 2.0, "poison"), ("b.md", 1.0, "good")), at, config) == {"scanned": 2, "updated": 1, "deleted": 0, "errors": 1}
    now = manifest.current(spark, at)
    assert rows(now.files, "rel_path", "mtime") == [("a.md", 1.0), ("b.md", 1.0)] and rows(now.chunks, "rel_path", "text") == [("a.md", "fine"), ("b.md", "good")]
    assert index.index_once(spark, note_rows(spark, ("a.md", 2.0, "healed"), ("b.md", 1.0, "good")), at, config)["updated"] == 1


def make_client():
    def client(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts]

    return client


def test_failing_embeddings(spark, tmp_path):
    embed = BatchEmbedding(make_client, batch=2)
    got = embed(spark.createDataFrame([("a",), ("bad",), ("ccc",)], "text string").coalesce(1))
    assert [(r.text, r.embedding, r.error) for r in got.collect()] == [("a", [1.0], None), ("bad", None, "RuntimeError: refused"), ("ccc", [3.0], None)]
    at = str(tmp_path / "i")
    counters = index.index_once(spark, note_rows(spark, ("a.md", 1.0, "x"), ("b.md", 1.0, "bad")), at, index.IndexConfig(embed=embed))
    assert counters == {"scanned": 2, "updated": 1, "deleted": 0, "errors": 1} and rows(manifest.current(spark, at).files, "rel_path") == [("a.md",)]


def test_hidden_names_are_listed(spark, tmp_path):
    names = (".hidden.md", "_x.md", "a/b/c.md", "a/_d/.e/f.TXT", "a.tar.md", "skip.log", ".md", "g.md")
    for n in names:
        p = tmp_path / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(n.encode() + b"\r\n\xff")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.md")
    found = files.discover(spark, str(tmp_path))
    assert rows(found, "rel_path") == [(n,) for n in sorted(names) if n not in ("skip.log", ".md")]
    assert found.where("size <> length(rel_path) + 3 or mtime < 1e9").isEmpty()
    notes = files.read_notes(spark, str(tmp_path))
    assert notes.where("text <> concat(rel_path, '\n\ufffd')").isEmpty() and notes.count() == 6
    assert {r.rel_path for r in files.discover(spark, f"file:{tmp_path}").collect()} <= set(names)


def test_json_files(spark, tmp_path):
    turns = spark.createDataFrame([("user", "hi", 1.0, 0), ("assistant", "yo", 1.0, 1)], "role string, content string, ts double, place long")
    at = str(tmp_path / "history")
    for _ in range(2):
        jsonl.append_turns(turns, at)
    assert jsonl.read_history(spark, at).count() == 4 and jsonl.clear(spark, at) and not jsonl.clear(spark, at) and not jsonl.exists(spark, at)
    hits = spark.createDataFrame([(0, "mixed", 1, "a.md", 1, 2, "s", 0.5, ["x"])], "query_id long, query_type string, rank int, rel_path string, start_line int, end_line int, snippet string, score double, reasons array<string>")
    queries = spark.createDataFrame([(0, "one"), (1, "where did i put it")], "query_id long, query string")
    jsonl.append(jsonl.log_rows(queries, hits, F.lit(7.0)), str(tmp_path / "log"))
    log = jsonl.read_log(spark, str(tmp_path / "log"))
    assert sorted((r.query, r.query_type, len(r.top_hits)) for r in log.collect()) == [("one", "mixed", 1), ("where did i put it", "snippet_focus", 0)]
    cases = spark.createDataFrame([("q\u00e9", ["a"], [], "mixed", None)], jsonl.CASE)
    out = str(tmp_path / "cases.json")
    assert jsonl.write_cases(cases, out) == 1 and jsonl.write_cases(cases.union(cases.withColumn("query", F.lit("b"))), out) == 2
    assert rows(jsonl.read_cases(spark, out), "query") == [("b",), ("q\u00e9",)] and len(json.loads((tmp_path / "cases.json").read_text())) == 2
    assert jsonl.write_cases(cases.where("false"), out) == 0 and jsonl.read_cases(spark, out).isEmpty()


def model(system, prompt):
    if "explode" in prompt:
        raise RuntimeError("no answer")
    if "stubborn" in prompt or ("second" in prompt and "failed:" not in prompt):
        return "nonsense"
    return 'Answer:\nYes.\nEvidence:\n- "x" (a.md: 1-2)'


def test_answers_in_batches(spark):
    asked = ["good", "second try", "stubborn", "explode", "no sources"]
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    packed = spark.createDataFrame([(i, 1, "a.md", 1, 2, "text x") for i in range(4)], "query_id long, new_rank int, rel_path string, start_line int, end_line int, text string")
    got = {r.query: r for r in grounding.answers(questions, grounding.packed_sources(packed), model).collect()}
    assert {q: (r.ok, r.rounds) for q, r in got.items()} == {"good": (True, 1), "second try": (True, 2), "stubborn": (False, 2), "explode": (False, 2), "no sources": (True, 0)}
    assert got["no sources"].answer == got["stubborn"].answer == grounding.REFUSAL and got["stubborn"].reason == "Missing required sections." and got["explode"].reason == "RuntimeError: no answer"


def test_kept_state_of_notes(spark, tmp_path):
    source, table = tmp_path / "seen", str(tmp_path / "changes")
    source.mkdir()
    batches = [[("a", 1.0, 5, 1), ("b", 1.0, 5, 1)], [("a", 1.0, 5, 2), ("b", 2.0, 6, 2), ("c", 1.0, 1, 2)], [("a", None, None, 3), ("zz", None, None, 3), ("c", 1.0, 1, 3)]]
    want = [[("a", "new"), ("b", "new")], [("b", "changed"), ("c", "new")], [("a", "deleted")]]
    for k, (batch, expected) in enumerate(zip(batches, want)):
        lines = [json.dumps(dict(zip(("rel_path", "mtime", "size", "sweep"), r))) for r in batch]
        (source / f"{k}.json").write_text("\n".join(lines))
        seen = spark.readStream.schema("rel_path string, mtime double, size bigint, sweep bigint").json(str(source))
        keep_changes(seen, table, str(tmp_path / "checkpoint")).awaitTermination()
        assert rows(spark.read.parquet(f"{table}/batch={k}"), "rel_path", "status") == expected
