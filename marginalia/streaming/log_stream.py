"""The search log as a stream: the latest row of each query as a kept table, and counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.evaluation import latest_queries
from marginalia.sources.jsonl import LOG


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON log files as they arrive; malformed lines and blank queries are dropped."""
    raw = spark.readStream.schema(LOG).option("mode", "DROPMALFORMED").json(path)
    return raw.where("query is not null and trim(query) <> ''").withColumn("line_no", F.lit(0))


def keep_latest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch into `table`: generations of one row a query, each written whole under a number of its own.

    A batch that is replayed after a failure overwrites its own generation, so every row is merged once.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch
        if number > 0:
            both = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{table}/gen={number - 1}"))
        latest_queries(both).write.mode("overwrite").parquet(f"{table}/gen={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Searches in each window of event time by query type; rows later than `late` are dropped and old windows are let go."""
    timed = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "query_type").agg(F.count(F.lit(1)).alias("searches"))
