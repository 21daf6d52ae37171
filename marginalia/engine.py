"""The engine's methods: one for each tool, over an index folder. Arguments are clamped to their ranges; blank required strings are errors."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import cells, density, evaluation, grounding, index, listing, postings, router, search, vectors
from marginalia.providers import HashedEmbedding, NoLanguageModel
from marginalia.sources import files, jsonl, manifest, pointers
from marginalia.sources.config import Config
from marginalia.sources.scratch import kept


class ToolError(ValueError):
    """A call with arguments that cannot be served."""


def clamp(value, low, high):
    return max(low, min(high, type(low)(value)))


def required(value: str | None, name: str) -> str:
    if not value or not str(value).strip():
        raise ToolError(f"{name} must not be blank")
    return str(value)


class Engine:
    def __init__(self, spark: SparkSession, config: Config, embed=None, llm=None, log_path: str | None = None, eval_path: str | None = None, candidates_path: str | None = None):
        self.spark, self.config = spark, config
        self.embed, self.llm = embed or HashedEmbedding(), llm or NoLanguageModel()
        self.log_path, self.eval_path = log_path or f"{config.data_dir}/search_log", eval_path
        self.candidates_path = candidates_path or f"{config.data_dir}/eval_candidates.json"
        self.group = f"marginalia-index-{id(self)}"
        self.lock, self.state = threading.Lock(), {"running": False, "last": None, "error": None}

    # Tables.

    def notes(self) -> DataFrame:
        return files.read_notes(self.spark, self.config.doc_root, self.config.include_ext)

    def indexed(self) -> manifest.Generation:
        found = manifest.current(self.spark, self.config.index_dir)
        if found is None:
            raise ToolError("nothing is indexed yet")
        return found

    def chunks(self) -> DataFrame:
        found = self.indexed().chunks
        if found is None:
            raise ToolError("the index holds no text")
        return found.withColumnRenamed("chunk_id", "id")

    def indexed_notes(self) -> DataFrame:
        return self.notes().join(self.indexed().files.select("rel_path"), "rel_path", "left_semi")

    def _of_generation(self, kind: str, build) -> str:
        """The folder of something that is built once for each generation of the index, by whoever needs it first."""
        number, at = self.indexed().number, f"{self.config.index_dir}/{kind}"
        if (said := pointers.read(self.spark, at, number) if jsonl.exists(self.spark, f"{at}/pointers/{number:012d}.json") else None) is None:
            said = {"folder": f"{at}/{uuid.uuid4().hex}"}
            build(said["folder"])
            try:
                pointers.publish(self.spark, at, number, said)
            except pointers.Conflict:  # another has built the same meanwhile
                pass
        return said["folder"]

    def postings(self) -> postings.Postings:
        """The inverted index of the indexed notes' lines."""
        return postings.Postings(self.spark, self._of_generation("postings", lambda path: postings.build(self.indexed_notes(), path)))

    def cells(self) -> cells.Cells:
        """The index of the chunks' embeddings."""
        return cells.open_at(self.spark, self._of_generation("cells", lambda path: cells.build(self.chunks().select("id", "embedding"), path)))

    def queries(self, *texts: str) -> DataFrame:
        """query_id, query, embedding. Embeddings come from the cache of queries; only those that it lacks are asked for."""
        return self.embedded(self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"))

    def embedded(self, rows: DataFrame) -> DataFrame:
        """rows (query_id, query) with embedding, through the cache."""
        name = getattr(self.embed, "model", type(self.embed).__name__)
        key = T.cache_key(F.lit(name), F.col("query"))
        wanted = rows.select("query_id", "query", key.alias("cache_key"), F.lit(name).alias("model"), F.col("query").alias("query_text"))
        cache = manifest.embedding_cache(self.spark, f"{self.config.data_dir}/query_embeddings")
        return manifest.read_through(wanted, cache, lambda x: self.embed(x, "query_text").select("cache_key", "model", "query_text", "embedding")).select("query_id", "query", "embedding")

    # Tools.

    def route_query(self, query: str) -> DataFrame:
        q = self.spark.createDataFrame([(required(query, "query"),)], "query string")
        return q.select(router.route(F.col("query")).alias("r"), router.density_target(F.col("query")).alias("density_target")).select("r.*", "density_target")

    def query_notes(self, *queries: str, limit: int = 8) -> DataFrame:
        for q in queries:
            required(q, "query")
        asked = self.queries(*queries)
        found = search.search(asked, self.indexed_notes(), self.chunks(), clamp(limit, 1, 30), self.config.top_k, self.postings(), self.cells())
        hits = kept(found, "hits")  # searched once: for the log and for the caller
        jsonl.append(jsonl.log_rows(asked, hits, F.unix_micros(F.current_timestamp()) / 1e6), self.log_path)
        return hits

    def search_notes(self, query: str, top_k: int | None = None, include_text: bool = True, max_chars: int = 35_000) -> DataFrame:
        k = clamp(top_k or self.config.top_k, 1, 100)
        q = self.queries(required(query, "query"))
        found = vectors.hybrid_rerank(q, vectors.nearest(q, self.chunks(), 3 * k, self.cells()), k)
        return vectors.within_budget(found, clamp(max_chars, 500, 200_000)) if include_text else found.withColumn("text", F.lit(""))

    def answer_from_notes(self, question: str, top_k: int = 10, max_sources_chars: int | None = None) -> dict:
        r = self.answers(required(question, "question"), top_k=top_k, max_sources_chars=max_sources_chars).first()
        return {"ok": r.ok, "answer": r.answer} | ({} if r.ok else {"reason": r.reason})

    def answers(self, *questions: str, top_k: int = 10, max_sources_chars: int | None = None) -> DataFrame:
        """query_id, query, ok, answer, reason, rounds for a batch of questions; the language model is called in the tasks."""
        q, k = self.queries(*questions), clamp(top_k, 1, 30)
        found = vectors.within_budget(vectors.hybrid_rerank(q, vectors.nearest(q, self.chunks(), 3 * k, self.cells()), k), 200_000)
        return grounding.answers(q, grounding.packed_sources(found, max_sources_chars or self.config.max_sources_chars), self.llm)

    def chat(self, query: str, history: list[tuple[str, str]] | None = None) -> str:
        """An answer without notes. Without a history of the caller's own, the stored one is used, and the two new turns are added to it."""
        past = self.history() if history is None else list(history)
        most = 2 * self.config.max_history_turns
        said = "\n".join(f"{role}: {text}" for role, text in (past[-most:] if most else []))
        answer = self.llm("You are a helpful assistant.", f"{said}\nuser: {required(query, 'query')}".strip())
        if history is None:
            turns = self.spark.createDataFrame([("user", query, time.time(), 0), ("assistant", answer, time.time(), 1)], "role string, content string, ts double, place long")
            jsonl.append_turns(turns, self.config.chat_history_path)
        return answer

    def history(self) -> list[tuple[str, str]]:
        """The last turns of the stored chat, oldest first."""
        if not jsonl.exists(self.spark, self.config.chat_history_path):
            return []
        turns = jsonl.read_history(self.spark, self.config.chat_history_path).orderBy(F.desc("ts"), F.desc("place")).limit(2 * max(1, self.config.max_history_turns))
        return [(r.role, r.content) for r in turns.collect()][::-1]

    def clear_history(self) -> bool:
        return jsonl.clear(self.spark, self.config.chat_history_path)

    def density(self, question: str) -> str | None:
        """The report that a density question asks for, or None if it is none."""
        target = self.route_query(question).first().density_target
        return density.report(self.indexed_notes(), target) if target else None

    def list_indexed_files(self, limit: int = 200, offset: int = 0) -> DataFrame:
        return listing.page(self.indexed().files, clamp(limit, 1, 500), max(0, int(offset)))

    def find_files(self, term: str, mode: str = "both", limit: int = 100) -> DataFrame:
        return listing.find_files(self.indexed_notes(), required(term, "term"), mode, clamp(limit, 1, 500))

    def get_note(self, rel_path: str, start_line: int | None = None, end_line: int | None = None, max_chars: int = 120_000) -> DataFrame:
        asked = self.spark.createDataFrame([(required(rel_path, "rel_path"), start_line, end_line)], "rel_path string, start_line int, end_line int")
        return listing.excerpts(asked.where(listing.safe_path(F.col("rel_path"))), self.indexed_notes(), clamp(max_chars, 200, 500_000))

    def open_note(self, text: str, last_hits: list[str] = ()) -> DataFrame | str:
        """The note that input asks to open: by its number in the last results, or by its path; a message if that is not clear."""
        r = self.route_query(text).first()
        if r.note_result_index is not None:
            if not 1 <= r.note_result_index <= len(last_hits):
                return f"The last search returned {len(last_hits)} result(s), so I cannot open #{r.note_result_index}."
            return self.get_note(last_hits[r.note_result_index - 1])
        if not r.note_path_hint:
            return f"I could not determine which note to open from: {text}"
        hint = self.spark.createDataFrame([(r.note_path_hint,)], "hint string")
        found = [x.rel_path for x in listing.resolve(hint, self.indexed().files).orderBy("rel_path").limit(11).collect()]
        if len(found) == 1:
            return self.get_note(found[0])
        if not found:
            return f"No indexed file matched {r.note_path_hint}."
        return "\n".join([f"Multiple indexed files matched {r.note_path_hint}:", *(f"- {p}" for p in found[:10]), "Say the full relative path you want to open."])

    def list_large_files(self, min_size_mb: float = 1.0, limit: int = 100) -> DataFrame:
        return listing.large_files(files.discover(self.spark, self.config.doc_root, self.config.include_ext), float(min_size_mb), clamp(limit, 1, 500))

    def cases(self) -> DataFrame:
        return jsonl.read_cases(self.spark, self.eval_path) if self.eval_path and jsonl.exists(self.spark, self.eval_path) else self.spark.createDataFrame([], jsonl.CASE)

    def eval_candidates(self, limit: int = 25, refresh: bool = False) -> DataFrame:
        """The stored page of candidates; with refresh, or where none is stored, a new one is made from the search log and stored."""
        at = self.candidates_path
        if refresh or not jsonl.exists(self.spark, at):
            log = jsonl.read_log(self.spark, self.log_path) if jsonl.exists(self.spark, self.log_path) else jsonl.clean_log(self.spark.createDataFrame([], "value string, line_no long"))
            jsonl.write_candidates(evaluation.candidates(log, self.cases(), 200), at)
        return jsonl.read_candidates(self.spark, at).where(F.col("n") <= clamp(limit, 1, 200))

    def eval_promote(self, selections: list = (), promote_all: bool = False) -> DataFrame:
        """Write the cases with the selected candidates, and the candidates that are left; the cases. Without a selection, all are taken only if promote_all says so."""
        found = self.eval_candidates(200)
        picked = None if promote_all else evaluation.parse_selections([str(s) for s in selections], 200) if selections else []
        cases, left = (kept(x, "promoted") for x in evaluation.promote(found, self.cases(), picked))
        if not self.eval_path:
            raise ToolError("no file of cases is configured")
        jsonl.write_cases(cases, self.eval_path)
        jsonl.write_candidates(left, self.candidates_path)
        return self.cases()

    def eval_rows(self, limit: int = 8) -> DataFrame:
        """Each case with rank, snippet_rank and query_type, all searched in one batch."""
        cases = kept(self.cases().withColumn("query_id", F.monotonically_increasing_id()), "cases")
        hits = search.search(self.embedded(cases.select("query_id", "query")), self.indexed_notes(), self.chunks(), limit, self.config.top_k, self.postings(), self.cells())
        return kept(evaluation.case_ranks(cases, hits), "ranked")

    def run_eval(self, limit: int = 8, each=None) -> str:
        """All cases: the rates as text. each is called with every case's row as it is read back, one partition at a time."""
        ranked = self.eval_rows(limit)
        for row in ranked.orderBy("query_id").toLocalIterator() if each else ():
            each(row)
        return evaluation.summary(evaluation.rates(ranked, limit).first(), limit)

    def reindex_status(self) -> dict:
        """The state of the last or the running pass; while one runs, its phase with counts, and the tasks of the stages that Spark is working on."""
        state = dict(self.state)
        if state["running"]:
            tracker = self.spark.sparkContext.statusTracker()
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(self.group) if (info := tracker.getJobInfo(j)) and info.status == "RUNNING" for s in info.stageIds]
            stages = [s for s in stages if s]
            state |= {"tasks": sum(s.numTasks for s in stages), "tasks_done": sum(s.numCompletedTasks for s in stages)}
        return state

    def reindex_now(self, wait: bool = True, force: bool = False, lock_timeout: float = 300, force_reindex: bool | None = None, lock_timeout_seconds: float | None = None, embed=None) -> dict:
        """One pass; with wait=False in the background. One pass runs at a time, and the lock is taken before a start is reported.

        force_reindex and lock_timeout_seconds are other names of force and lock_timeout.
        """
        force, lock_timeout = force if force_reindex is None else force_reindex, lock_timeout if lock_timeout_seconds is None else lock_timeout_seconds
        if not self.lock.acquire(timeout=clamp(float(lock_timeout), 1.0, 86_400.0) if wait else 0):
            return {"started": False, **self.reindex_status()}
        self.state = {"running": True, "last": None, "error": None, "started_at": time.time(), "phase": "start"}

        def tell(**progress) -> None:
            self.state = self.state | progress

        def run() -> None:
            try:
                self.spark.sparkContext.setJobGroup(self.group, "index pass")
                c = self.config
                counters = index.index_once(self.spark, self.notes(), c.index_dir, index.IndexConfig(c.chunk_chars, c.chunk_overlap, c.max_chunks_per_file, c.max_file_size_mb, embed=embed or self.embed), force, tell)
                self.state = {"running": False, "last": counters, "error": None}
            except Exception as e:
                self.state = {"running": False, "last": None, "error": str(e)}
                if wait:
                    raise
            finally:
                self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
                self.lock.release()

        if wait:
            run()
        else:
            threading.Thread(target=run, daemon=True).start()
        return {"started": True, **self.state}

    TOOLS = (
        "route_query", "query_notes", "eval_candidates", "eval_promote", "chat", "list_indexed_files", "find_files", "search_notes", "get_note",
        "reindex_status", "reindex_now", "answer_from_notes", "list_large_files",
    )

    def call(self, tool: str, **arguments):
        """A tool by name."""
        if tool not in self.TOOLS:
            raise ToolError(f"unknown tool: {tool}")
        return getattr(self, tool)(**arguments)

    def resource(self, uri: str):
        """notes://manifest, notes://config or notes://reindex/status."""
        if uri == "notes://manifest":
            return self.indexed().files.orderBy("rel_path")
        if uri == "notes://config":
            return self.config
        if uri == "notes://reindex/status":
            return self.reindex_status()
        raise ToolError(f"unknown resource: {uri}")

    @staticmethod
    def prompt(question: str, top_k: int = 10) -> str:
        """The text that asks a client to answer a question from notes."""
        return f"Call answer_from_notes with question={required(question, 'question')!r} and top_k={top_k}. Answer only from what it returns, and keep its citations."
