"""The tables of a folder as notes, chunks, manifests, logs and evaluation cases, and a fixed batch of user input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources.scratch import spread

#: A batch of search queries, by number; a query's embedding is the vector of its number.
SEARCHES = (
    "where did I mention that for this", "find my note about src11", "which file has the src7 doc", "snippet with que les des",
    "passage that are from this", "show me en/src3/doc_63.txt", "und der die",
)
#: A batch of inputs to route.
INPUTS = (
    "/help", "/eval-promote 1 2", "Reindex  NOW", "promote eval candidates 3", "what files have been indexed?", "what files have been indexed", "open docker.md", "show me the contents of a/b/c.md",
    "show me the second result", "open result #3", "find the note with sql in the title", "where did i put the keys", "list documents about spark", "hello there", "",
    "show the text from notes/x (1).md please", "which files have the most IP addresses", "what files contain a lot of emails", "which file has many urls", "which files have the most api keys",
    "what files have the highest number of credit cards", "which files have most sql statements", "how many emails are there",
)
#: Answers to check against the citation a/b.md:1-3.
ANSWERS = (
    'Answer:\nYes.\n\nEvidence:\n- "it is so" (a/b.md: 1-3)', "Answer: yes", "Answer:\nEvidence:\nnothing", "Answer:\nx\nEvidence:\n- no quotes (a/b.md: 1-3)", 'Answer:\nx\nEvidence:\n- "quote" a/b.md 1-3',
    'Answer:\nx\nEvidence:\n- "quote" (c/d.md: 1-3)', 'Answer:\nx\nEvidence:\n- "one" (a/b.md:1-3)\n- "two" (a/b.md: 4-9)', "I can't find that in your notes.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, over all cores: the small ones are one row group, which one task would read and work on alone."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: rel_path, doc_id, text, mtime, size."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(path.alias("rel_path"), "doc_id", "text", (F.lit(1_700_000_000.0) + F.col("doc_id") * 60).alias("mtime"), F.octet_length("text").cast("long").alias("size"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings joined to the notes of the same number, as one chunk each."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n = notes(spark, sf_dir).withColumn("lines", T.lines(F.col("text")))
    return v.join(n, v.id == n.doc_id).select(
        "id", "rel_path", F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.greatest(F.size("lines"), F.lit(1)).alias("end_line"), F.lit(None).cast("string").alias("heading"),
        T.first_nonempty_line(F.col("text")).alias("first_line"), "text", "mtime", "embedding",
    )


def searches(spark: SparkSession, sf_dir: str, embedded: bool = True) -> DataFrame:
    q = spark.createDataFrame(list(enumerate(SEARCHES)), "query_id long, query string")
    if not embedded:
        return q
    return q.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with the vector of its number: query_id, embedding."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(v, "query_id")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query for a passage: query_id, query."""
    text = F.concat(F.lit("find the passage "), F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))


def old_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes' manifest before changes: every tenth note missing, every seventh older, a hundred that are gone since."""
    n = notes(spark, sf_dir).where("doc_id % 10 <> 3").select("rel_path", (F.col("mtime") - F.when(F.col("doc_id") % 7 == 0, 1.0).otherwise(0.0)).alias("mtime"), "size")
    gone = spark.range(100).select(F.concat(F.lit("en/gone/doc_"), F.col("id").cast("string"), F.lit(".txt")).alias("rel_path"), F.lit(1.0).alias("mtime"), F.col("id").alias("size"))
    return n.unionByName(gone)


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a search log; purchases have no hit."""
    e = table(spark, sf_dir, "events")
    query = F.concat("event_type", F.lit(" "), (F.col("user_id") % 50).cast("string"))
    hit = F.struct(F.concat(F.lit("en/src1/doc_"), (F.col("event_id") % 100).cast("string"), F.lit(".txt")).alias("rel_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.concat(F.lit("seen "), F.col("event_id").cast("string")).alias("snippet"), F.col("value").alias("score"), F.array(F.lit("text")).alias("reasons"))
    hits = F.when(F.col("event_type") == "purchase", F.array().cast("array<struct<rel_path:string,start_line:int,end_line:int,snippet:string,score:double,reasons:array<string>>>")).otherwise(F.array(hit))
    return e.select(F.col("event_id").alias("line_no"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), query.alias("query"), F.when(F.col("event_id") % 3 == 0, "snippet_focus").otherwise("other").alias("query_type"), hits.alias("top_hits"))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search batch as evaluation cases: each expects the first ten notes whose path or text holds its last word."""
    rows = [(i, q, q.split()[-1].lower(), "snippet_focus" if i % 2 == 0 else None) for i, q in enumerate(SEARCHES)]
    q = spark.createDataFrame(rows, "query_id long, query string, word string, expected_query_type string")
    n = notes(spark, sf_dir).select("rel_path", F.lower("text").alias("low"))
    found = n.join(F.broadcast(q), n.low.contains(q.word) | F.lower(n.rel_path).contains(q.word)).select("query_id", "rel_path")
    # Each task passes on ten of a query; all of them never meet.
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("rel_path"))).where("_k <= 10")
    found = first.groupBy("query_id").agg(F.sort_array(F.collect_list("rel_path")).alias("expected_paths"))
    out = q.join(found, "query_id", "left").withColumn("expected_paths", F.coalesce("expected_paths", F.array().cast("array<string>")))
    return out.select("query_id", "query", "expected_paths", F.when(F.col("query_id") % 2 == 0, F.array("word")).otherwise(F.array().cast("array<string>")).alias("expected_snippet_terms"), "expected_query_type")


def quoting_model(system: str, prompt: str) -> str:
    """A stand-in for a language model: it quotes the first words of the first source, and cites it wrongly the first time that a question is even in length."""
    header, _, rest = prompt.partition("\n")[2].partition("\n")
    place = header.partition("] ")[2].replace(":", ": ", 1)
    question = prompt.partition("QUESTION\n")[2].partition("\n")[0]
    wrong = len(question) % 2 == 0 and "failed:" not in prompt
    quote = " ".join(rest.split()[:4]).replace('"', "'")
    return f'Answer:\nSee the evidence.\n\nEvidence:\n- "{quote}" ({"x/" * wrong}{place})'
