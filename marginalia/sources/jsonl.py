"""Search log, chat history and evaluation files as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import pointers

HIT = "struct<rel_path:string,start_line:int,end_line:int,snippet:string,score:double,reasons:array<string>>"
LOG = f"ts double, query string, query_type string, top_hits array<{HIT}>"
TURN = "role string, content string, ts double"
CASE = "query string, expected_paths array<string>, expected_snippet_terms array<string>, expected_query_type string, notes string"


def log_rows(queries: DataFrame, hits: DataFrame, ts: Column, most: int = 5) -> DataFrame:
    """queries: query_id, query. hits: query_id, query_type, rank, rel_path, start_line, end_line, snippet, score, reasons. One log row for each query, with its first hits (none: an empty list)."""
    few = hits.where(F.col("rank") <= most)
    hit = F.struct("rel_path", "start_line", "end_line", "snippet", F.round("score", 6).alias("score"), "reasons")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", hit.alias("hit")))), lambda s: s["hit"])
    found = few.groupBy("query_id").agg(listed.alias("top_hits"))
    x = queries.select("query_id", "query", T.query_type(F.col("query")).alias("query_type")).join(found, "query_id", "left")
    return x.select(ts.alias("ts"), "query", "query_type", F.coalesce("top_hits", F.array().cast(f"array<{HIT}>")).alias("top_hits"))


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines. Files become visible when the whole job has ended (the writer's two-phase commit)."""
    rows.write.mode("append").json(path)


def clear(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file of JSON lines; whether there was one."""
    fs, p = pointers.file_of(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = pointers.file_of(spark, path)
    return bool(fs.exists(p))


def append_turns(turns: DataFrame, path: str) -> None:
    """turns: role, content, ts, and place (order of equal times)."""
    append(turns.select("role", "content", "ts", "place"), path)


def clean_log(raw: DataFrame) -> DataFrame:
    """raw: value (a line) and line_no. Blank lines, malformed JSON, other than objects and blank queries are dropped; hits that are no objects too."""
    kept = raw.where(F.trim("value").startswith("{")).withColumn("j", F.from_json("value", LOG, {"mode": "PERMISSIVE"}))
    query = T.strip(F.col("j")["query"])
    return kept.where(F.col("j").isNotNull() & (query != "")).select(
        "line_no", F.coalesce(F.col("j")["ts"], F.lit(0.0)).alias("ts"), query.alias("query"), F.coalesce(F.nullif(F.col("j")["query_type"], F.lit("")), F.lit("mixed")).alias("query_type"),
        F.coalesce(F.filter(F.col("j")["top_hits"], lambda h: h.isNotNull()), F.array().cast(f"array<{HIT}>")).alias("top_hits"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no orders the lines of a file; files follow each other by name."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("line_no"))
    return clean_log(lines.select("value", "line_no"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Chat turns; malformed lines are dropped, as in the log."""
    raw = spark.read.text(path).withColumn("j", F.from_json("value", TURN + ", place bigint"))
    return raw.where(F.col("j").isNotNull() & F.col("j")["role"].isNotNull()).select("j.role", "j.content", "j.ts", F.coalesce("j.place", F.lit(0)).alias("place"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, strictly: a missing query, no expected path or an unknown type raises an error when the rows are read."""
    x = spark.read.option("multiLine", True).schema(CASE).json(path)
    bad = F.col("query").isNull() | (T.strip(F.col("query")) == "") | F.col("expected_paths").isNull() | (F.size("expected_paths") == 0)
    kind = F.col("expected_query_type")
    x = x.withColumn("query", F.when(bad, F.raise_error(F.lit("a case needs a query and expected_paths"))).when(kind.isNotNull() & ~kind.isin("filename_focus", "snippet_focus", "mixed"), F.raise_error(F.concat(F.lit("unknown expected_query_type: "), kind))).otherwise(F.col("query")))
    return x.withColumn("expected_snippet_terms", F.transform(F.coalesce("expected_snippet_terms", F.array().cast("array<string>")), F.lower))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates, leniently: what is no object is dropped; n numbers them from 1."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("i", "item"))
    x = raw.select("i", F.from_json("item", CASE + ", top_observed_snippet string").alias("j")).where(F.col("j")["query"].isNotNull())
    return x.select((F.col("i") + 1).alias("n"), "j.*")


def write_array(rows: DataFrame, path: str, order: Column, *left_out: str) -> int:
    """rows as one JSON array file, which takes the place of the old one when it is whole; their number.

    For lists that people review and edit (cases, a page of candidates): the array is put together by Spark and is one row.
    """
    spark = rows.sparkSession
    item = F.struct(order.alias("o"), F.to_json(F.struct(*[c for c in rows.columns if c not in left_out])).alias("j"))
    listed = rows.select(item.alias("x")).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["j"]).alias("all"))
    text, n = listed.select(F.concat(F.lit("[\n  "), F.array_join("all", ",\n  "), F.lit("\n]\n")), F.size("all")).first()
    fs, fresh = pointers.file_of(spark, f"{path}.{uuid.uuid4().hex}.new")
    _, old = pointers.file_of(spark, path)
    out = fs.create(fresh, False)
    out.write(bytearray((text if n else "[]\n").encode()))
    out.close()
    _, aside = pointers.file_of(spark, f"{path}.old")
    fs.delete(aside, False)
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(fresh, old):
        raise OSError(f"could not write {path}")
    return n


def write_candidates(found: DataFrame, path: str) -> int:
    """Candidates as one JSON array, in the order of n; the number written."""
    return write_array(found, path, F.col("n"), "n")


def write_cases(cases: DataFrame, path: str) -> int:
    """Cases as one JSON array, in the order of their queries; the number written."""
    return write_array(cases, path, F.col("query"))
