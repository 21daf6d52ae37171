"""Intermediate tables that are read more than once: written to the folder that driver and executors share, so that a lost executor costs tasks, not steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="marginalia-")
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/marginalia/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Within, a write's shuffle files go when it has ended, and not when the driver happens to collect its garbage. For writes only: they plan anew each time, while a table that is collected twice would miss its files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df, written once and read back; by: a column of few values that becomes a folder of its own each."""
    path = new_path(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    with tidy(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files make fewer partitions than there are cores; large inputs have more and pass as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
