"""Retrieval evaluation: ranks of expected notes, rolled-up rates, and evaluation cases mined from the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

#: The note of a mined case, and the query types.
NOTE = "Generated from search log. Review expected path/query type before promoting to eval set."
TYPES = ("filename_focus", "snippet_focus", "mixed")


def case_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases: query_id, expected_paths, expected_snippet_terms, expected_query_type. hits: query_id, rank, rel_path, snippet, query_type.

    For each case: rank of the first expected path, rank of the first such hit whose snippet has all terms, and query_type.
    """
    x = cases.join(hits.select("query_id", "rank", "rel_path", "snippet", "query_type"), "query_id", "left")
    expected = F.array_contains("expected_paths", F.col("rel_path"))
    snippet = T.normalize(F.col("snippet"))
    terms = F.forall("expected_snippet_terms", lambda t: snippet.contains(t)) & (F.size("expected_snippet_terms") > 0)
    out = x.groupBy("query_id").agg(F.min(F.when(expected, F.col("rank"))).alias("rank"), F.min(F.when(expected & terms, F.col("rank"))).alias("snippet_rank"), F.max("query_type").alias("query_type"))
    return cases.join(out, "query_id")


def rates(ranked: DataFrame, limit: int = 8) -> DataFrame:
    """One row of counts over all cases."""
    n = lambda cond: F.count(F.when(cond, 1))
    r, s = F.col("rank"), F.col("snippet_rank")
    typed, termed = F.col("expected_query_type").isNotNull(), F.size("expected_snippet_terms") > 0
    return ranked.agg(
        F.count(F.lit(1)).alias("cases"), n(r == 1).alias("hit_1"), n(r <= 3).alias("hit_3"), n(r <= limit).alias("hit_limit"), n(typed).alias("typed"),
        n(typed & (F.col("query_type") == F.col("expected_query_type"))).alias("type_hits"), n(termed).alias("snippet_cases"), n(termed & (s == 1)).alias("snippet_1"),
        n(termed & (s <= 3)).alias("snippet_3"), n(termed & (s <= limit)).alias("snippet_limit"),
    )


def latest_queries(log: DataFrame) -> DataFrame:
    """The newest row of each query (of equals, the first of the log). log: ts, line_no, query and any others."""
    w = Window.partitionBy("query").orderBy(F.desc("ts"), "line_no")
    return log.withColumn("query", T.strip(F.col("query"))).where("query <> ''").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def candidates(log: DataFrame, existing: DataFrame, limit: int = 25) -> DataFrame:
    """Evaluation cases from the newest `limit` queries that have a hit and no case yet, oldest first (column n).

    log: ts, line_no, query, query_type, top_hits. A query whose newest row has no hit gives none.
    """
    x = latest_queries(log).join(existing.select("query").distinct(), "query", "left_anti")
    hits = F.transform("top_hits", lambda h: F.struct(T.strip(F.coalesce(h["rel_path"], F.lit(""))).alias("p"), T.strip(F.coalesce(h["snippet"], F.lit(""))).alias("s")))
    x = x.select("ts", "line_no", "query", "query_type", hits.alias("h"))
    path = F.try_element_at(F.filter("h", lambda h: h["p"] != ""), F.lit(1))["p"]
    snippet = F.try_element_at(F.filter("h", lambda h: h["s"] != ""), F.lit(1))["s"]
    x = x.select("ts", "line_no", "query", F.array(path).alias("expected_paths"), F.when(F.col("query_type").isin(*TYPES), F.col("query_type")).otherwise("mixed").alias("expected_query_type"), F.array().cast("array<string>").alias("expected_snippet_terms"), F.lit(NOTE).alias("notes"), snippet.alias("top_observed_snippet"), path.alias("_p"))
    x = x.where("_p is not null").drop("_p").orderBy(F.desc("ts"), "line_no").limit(limit)
    return x.withColumn("n", F.row_number().over(Window.orderBy("ts", F.desc("line_no")))).drop("ts", "line_no")


def parse_selections(args: list[str], total: int) -> list[int] | None:
    """Numbers and ranges to a list without repeats, within 1..total; None for all. Junk raises ValueError."""
    if not args or "all" in (a.lower() for a in args):
        return None
    out: dict[int, None] = {}
    for a in filter(None, (a.strip() for a in args)):
        first, dash, last = a.partition("-")
        ends = sorted((int(first), int(last))) if dash else [int(first)] * 2
        out.update((i, None) for i in range(max(1, ends[0]), min(total, ends[1]) + 1))
    return list(out)


def promote(found: DataFrame, cases: DataFrame, selected: list[int] | None) -> tuple[DataFrame, DataFrame]:
    """(cases with the selected candidates that are new, the candidates that are left). Selected ones that are cases already are dropped."""
    chosen = found if selected is None else found.where(F.col("n").isin(selected) if selected else F.lit(False))
    left = found.join(chosen.select("n"), "n", "left_anti")
    fresh = chosen.join(cases.select("query"), "query", "left_anti").drop("top_observed_snippet", "n")
    return cases.unionByName(fresh, allowMissingColumns=True), left


def summary(r, limit: int = 8) -> str:
    """The rates (a row) as text."""
    part = lambda k, n: f"{k}/{n} ({100 * k / max(1, n):.1f}%)"
    out = [f"Summary: hit@1={part(r.hit_1, r.cases)}, hit@3={part(r.hit_3, r.cases)}, hit@{limit}={part(r.hit_limit, r.cases)}"]
    if r.typed:
        out.append(f"Query Type: {part(r.type_hits, r.typed)}")
    if r.snippet_cases:
        out.append(f"Snippet Terms: hit@1={part(r.snippet_1, r.snippet_cases)}, hit@3={part(r.snippet_3, r.snippet_cases)}, hit@{limit}={part(r.snippet_limit, r.snippet_cases)}")
    return "\n".join(out)
