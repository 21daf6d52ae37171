import io
import json

import pytest

from marginalia import server
from marginalia.engine import Engine, ToolError
from marginalia.sources.config import Config, load_config
from marginalia.streaming.index_stream import watch
from marginalia.streaming.log_stream import keep_latest, read_log_stream, windowed_counts
from marginalia.sources import jsonl, manifest


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")
    (root / "sub").mkdir()
    (root / "Docker.txt").write_text("Docker basics\r\nrun with --network host 10.0.0.1\r\n")
    (root / "sub" / "hosts.md").write_text("# Hosts\nuse network host mode 10.0.0.2 10.0.0.3\n")
    (root / "skip.log").write_text("no")
    data = tmp_path_factory.mktemp("data")
    config = Config(str(root), str(data), str(data / "index"), str(data / "manifest"), str(data / "history"))
    cases = data / "cases.json"
    cases.write_text(json.dumps([{"query": "find my note about docker", "expected_paths": ["Docker.txt"], "expected_query_type": "filename_focus"}]))
    return Engine(spark, config, llm=lambda s, p, temperature=0.1: 'Answer:\nYes.\nEvidence:\n- "x" (Docker.txt: 1-2)', eval_path=str(cases))


def test_tools(engine):
    with pytest.raises(ToolError):
        engine.list_indexed_files()
    assert engine.reindex_now()["last"] == {"scanned": 2, "updated": 2, "deleted": 0, "errors": 0}
    assert [r.rel_path for r in engine.list_indexed_files().collect()] == ["Docker.txt", "sub/hosts.md"]
    assert engine.query_notes("find my note about docker").where("rank = 1").first().rel_path == "Docker.txt"
    assert engine.search_notes("network host").count() == 2
    assert engine.get_note("sub/hosts.md", 1, 1).first().text == "# Hosts"
    assert engine.get_note("../x").isEmpty()
    assert engine.open_note("open hosts.md").first().rel_path == "sub/hosts.md"
    assert engine.open_note("show me the first result", ["Docker.txt"]).first().rel_path == "Docker.txt"
    assert engine.open_note("open nothing.md").startswith("No indexed file")
    assert "sub/hosts.md: 2 match(es)" in engine.density("which files have the most ip addresses")
    assert engine.answer_from_notes("network host?")["ok"]
    assert engine.list_large_files(0).count() == 2 and engine.find_files("mode").count() == 1
    assert engine.run_eval().startswith("Summary: hit@1=1/1 (100.0%)")
    assert engine.eval_candidates().isEmpty()  # the only logged query is a case already
    each = []
    assert engine.run_eval(each=each.append).startswith("Summary") and [(r.query, r["rank"]) for r in each] == [("find my note about docker", 1)]
    status = engine.reindex_status()
    assert status["phase"] == "done" if "phase" in status else status["last"]["scanned"] == 2
    assert engine.reindex_now(force_reindex=True, lock_timeout_seconds=5)["last"]["updated"] == 2
    with pytest.raises(ToolError):
        engine.find_files(" ")
    with pytest.raises(ToolError):
        engine.call("drop_everything")


def test_candidates_are_promoted(engine):
    engine.query_notes("network host mode", "zzzz qqqq in no note at all")
    log = jsonl.read_log(engine.spark, engine.log_path)
    assert {r.query for r in log.collect()} >= {"network host mode", "zzzz qqqq in no note at all"}
    found = engine.eval_candidates(refresh=True)
    assert "network host mode" in {r.query for r in found.collect()}
    n = found.where("query = 'network host mode'").first().n
    assert {r.query for r in engine.eval_promote([n]).collect()} == {"find my note about docker", "network host mode"}
    assert "network host mode" not in {r.query for r in engine.eval_candidates().collect()}
    with open(engine.eval_path) as f:
        assert len(json.load(f)) == 2


def test_indexes_belong_to_a_generation(engine):
    one = engine.postings().path, engine.cells().path
    assert (engine.postings().path, engine.cells().path) == one and engine.cells().vectors == engine.chunks().count()
    engine.reindex_now(force=True)
    assert not set(one) & {engine.postings().path, engine.cells().path}


def test_chat_history(engine):
    assert engine.history() == [] and not engine.clear_history()
    said = []
    engine.llm, kept = (lambda s, p, temperature=0.1: said.append(p) or f"answer {len(said)}"), engine.llm
    try:
        engine.chat("one")
        engine.chat("two")
        engine.chat("apart", history=[])
    finally:
        engine.llm = kept
    assert engine.history() == [("user", "one"), ("assistant", "answer 1"), ("user", "two"), ("assistant", "answer 2")]
    assert "answer 1" in said[1] and "one" not in said[2] and engine.clear_history() and engine.history() == []


def test_query_embeddings_are_cached(engine):
    asked, real = [], engine.embed

    class Counting:
        model = "counting"

        def __call__(self, rows, text="text"):
            asked.append(rows.count())
            return real(rows, text)

    engine.embed = Counting()
    try:
        for _ in range(2):
            assert engine.queries("alpha", "beta", "alpha").count() == 3
    finally:
        engine.embed = real
    assert asked == [2, 0]


def test_server(engine):
    ask = lambda **m: server.handle(engine, {"jsonrpc": "2.0", "id": 1, **m})
    assert len(ask(method="tools/list")["result"]["tools"]) == 13
    got = ask(method="tools/call", params={"name": "list_indexed_files", "arguments": {}})
    assert json.loads(got["result"]["content"][0]["text"])[0]["rel_path"] == "Docker.txt"
    assert ask(method="nope")["error"]["code"] == -32601 and ask(method="tools/call", params={"name": "nope"})["error"]["code"] == -32602
    assert server.handle(engine, {"method": "ping"}) is None
    out = io.BytesIO()
    server.write_message(out, {"id": 7, "method": "ping"})
    answer = io.BytesIO()
    server.serve(engine, io.BytesIO(out.getvalue()), answer)
    answer.seek(0)
    assert server.read_message(answer) == {"jsonrpc": "2.0", "id": 7, "result": {}}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("doc_root: notes\ndata_dir: d\nindex_dir: i\nmanifest_path: m\nchat_history_path: /h\ntop_k: 5\n")
    c = load_config(str(tmp_path / "c.yaml"))
    assert c.doc_root == str(tmp_path / "notes") and c.chat_history_path == "/h" and c.top_k == 5 and c.include_ext == (".md", ".txt")
    (tmp_path / "bad.yaml").write_text("doc_root: x\n")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "bad.yaml"))


def test_index_stream(spark, tmp_path):
    root = tmp_path / "n"
    root.mkdir()
    (root / "a.md").write_text("one")
    for text in ("one", "two"):
        (root / f"{text}.md").write_text(text)
        watch(spark, str(root), str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.rel_path for r in manifest.current(spark, str(tmp_path / "i")).files.collect()) == ["a.md", "one.md", "two.md"]


def test_log_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    row = lambda ts, q: json.dumps({"ts": ts, "query": q, "query_type": "mixed", "top_hits": []})
    for k, batch in enumerate(([(1.0, "a"), (2.0, "b")], [(3.0, "a"), (0.5, "b")])):
        (log / f"{k}.json").write_text("\n".join(row(*r) for r in batch) + "\nbroken\n")
        keep_latest(read_log_stream(spark, str(log)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "t" / "gen=1"))
    assert sorted((r.query, r.ts) for r in last.collect()) == [("a", 3.0), ("b", 2.0)]
    counts = windowed_counts(read_log_stream(spark, str(log)))
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").agg({"searches": "sum"}).first()[0] == 4
