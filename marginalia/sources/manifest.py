"""The index on disk: a files table, chunks in buckets of notes, and a pointer to the current tables; keyed changes of tables.

A commit writes the files table and the buckets that have changed, and points to these and to the old folders of all other buckets. So a pass over
a large index costs the buckets that its changes touch, and readers see the old or the new tables, never a mixture.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources import pointers
from marginalia.sources.keyed import KeyedTable
from marginalia.sources.scratch import kept

FILES = "rel_path string, mtime double, size bigint"


@dataclass
class Generation:
    files: DataFrame
    chunks: DataFrame | None  # None: no chunk at all
    version: str
    buckets: dict[int, str]  # bucket: its folder, relative to the index
    count: int
    number: int = 0


def empty_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILES)


def bucket_of(count: int):
    """The bucket of a note."""
    return F.pmod(F.xxhash64("rel_path"), F.lit(count)).cast("int")


def read_buckets(spark: SparkSession, path: str, folders) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]) if folders else None


def current(spark: SparkSession, path: str) -> Generation | None:
    found = pointers.newest(spark, path)
    if found is None:
        return None
    number, meta = found
    buckets = {int(k): v for k, v in meta["buckets"].items()}
    return Generation(spark.read.schema(FILES).parquet(f"{path}/{meta['files']}"), read_buckets(spark, path, sorted(buckets.values())), meta["version"], buckets, meta["count"], number)


def commit(spark: SparkSession, path: str, files: DataFrame, chunks: DataFrame, touched: list[int], version: str, count: int) -> None:
    """chunks: all rows of the touched buckets. Write them and the files, then publish a pointer to them; a crash at any step leaves the last version."""
    old = current(spark, path)
    name = f"gen-{uuid.uuid4().hex}"
    chunks.withColumn("bucket", bucket_of(count)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{name}/chunks")
    files.write.parquet(f"{path}/{name}/files")
    buckets = {k: v for k, v in (old.buckets if old and old.count == count else {}).items() if k not in set(touched)}
    for k in touched:  # a bucket whose notes are all gone has no folder
        fs, folder = pointers.file_of(spark, f"{path}/{name}/chunks/bucket={k}")
        if fs.exists(folder):
            buckets[k] = f"{name}/chunks/bucket={k}"
    pointers.publish_next(spark, path, old.number if old else 0, {"files": f"{name}/files", "buckets": buckets, "version": version, "count": count})


def upsert(table: DataFrame, rows: DataFrame, key: str = "rel_path") -> DataFrame:
    """table with rows in place of those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str = "rel_path") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


CACHE = "cache_key string, model string, query_text string, embedding array<float>"


def embedding_cache(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, CACHE, "cache_key")


def read_through(wanted: DataFrame, cache: KeyedTable, embed) -> DataFrame:
    """wanted: cache_key, model, query_text and any others. wanted with embedding; embed is called once on each key that the table lacks, and what it gives is merged into it."""
    lacking = wanted.join(cache.read().select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"]).select("cache_key", "model", "query_text")
    misses = kept(embed(lacking), "embedded")
    if not misses.isEmpty():
        cache.merge(misses)
    return wanted.join(cache.read().select("cache_key", "embedding"), "cache_key")
