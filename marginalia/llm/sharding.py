"""Sharding: a reproducible shuffle that gives every row a shard and a slot which anyone can compute.

Rows are numbered 0..n-1 in the order of their id (global_order). The keyed Feistel permutation of feistel.py maps row
numbers to places 0..n-1; place p lies in shard p mod k at slot p div k. So shard sizes differ by at most one row, slots have
no gaps, and row_of() inverts the whole without any table. The number of rows and the key fix everything.

Edge cases: null texts count as empty (size 1, checksum 0); rows with equal or null ids are told apart by checksum and size, and rows
equal in all of these take neighbouring row numbers; very long texts count whole; an empty table gives no rows. Only doc_id and text are read, so other
columns cannot clash; they are not returned.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import feistel
from marginalia.llm.common import global_order

SHARDS, KEY = 16, 20240229


def shard_rows(df: DataFrame, order: list[str], shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """df with row_no, shard (int) and slot (long). df should be narrow; join wide columns back by their id."""
    numbered = global_order(df, order)
    n = df.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(feistel.permute(row.to_numpy(), n, key))

    placed = numbered.withColumn("_place", place("row_no"))
    return placed.select(*numbered.columns, (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"))


def row_of(shard: int, slot: int, n: int, shards: int = SHARDS, key: int = KEY) -> int:
    """The row number at a shard's slot."""
    return int(feistel.permute([slot * shards + shard], n, key, inverse=True)[0])


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no for each row of documents (the law is rows: counts at most one apart)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(narrow, ["doc_id", "text_crc32", "size"], shards, key)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
