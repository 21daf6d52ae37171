"""What the operators of this subpackage share: a place for intermediate tables, exact row keys, and an exact global order."""

from __future__ import annotations

import ctypes
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.sources.scratch import tidy

#: ASCII white space, the separator of words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where driver and executors are one process may it be unset; a temporary folder then serves."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="marginalia-")
    return _own_dir[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marginalia/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that were not written elsewhere read from them, so call it at the end."""
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Of each passing() that is open, the innermost last: the folders that go at its end.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised within are deleted at the end, except lasting ones. What is returned from within must be such a table, or read none of the others."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            _delete(spark, path)


def materialize(df: DataFrame, label: str, compression: str | None = None, lasting: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. lasting: it outlives the passing() it is made in, but not the one around that."""
    path = shared_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path, compression=compression)
    for paths in (_passing[:-1] if lasting else _passing)[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def in_one_plan(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Within, a query over small tables of known size is one plan and one job, dealt out over so many partitions (at most those of the session).

    Planned adaptively it is a job and another text of the whole plan for each of its stages, all of which the driver holds; a loop of such queries fills the driver.
    """
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(max(1, min(partitions, most)))}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _hashable(value: Column, kind: T.DataType) -> Column:
    """value, with maps (which have no hash) as sorted text."""
    if "map<" in kind.simpleString():
        return F.to_json(F.struct(F.sort_array(F.map_entries(value)) if isinstance(kind, T.MapType) else value), {"ignoreNullFields": "false"})
    return value


def row_key(df: DataFrame) -> Column:
    """128 bits that stand for all columns of a row: two hashes with different beginnings."""
    cols = [_hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols[::-1]).alias("b"))


def global_order(df: DataFrame, keys: list[str], size: str | None = None) -> DataFrame:
    """Add row_no (0, 1, ... in the order of keys) and, if size is named, start_at (the sum of size over all earlier rows).

    Rows are range-partitioned by the keys and written once, so that every later read sees the same partitions. Only the
    per-partition totals (one row a partition) meet in one task. df should be narrow: it is shuffled twice.
    Rows equal in all keys get neighbouring numbers in any order.
    """
    parts = materialize(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "order")
    value = F.col(size) if size else F.lit(0)
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value.cast("long")).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    out = parts.withColumn("_k", F.row_number().over(inside) - 1)
    if size:
        out = out.withColumn("_b", F.coalesce(F.sum(value.cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row for each range partition: its number is the number of shuffle partitions, whatever the table's size.
    out = out.join(F.broadcast(totals), "_part")
    cols = [F.col(c) for c in df.columns] + [(F.col("_n0") + F.col("_k")).cast("long").alias("row_no")]
    if size:
        cols.append((F.col("_s0") + F.col("_b")).cast("long").alias("start_at"))
    return out.select(*cols)


def with_let(value: Column, body) -> Column:
    """body(value), with value computed once for each row although body uses it many times or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hand_back() -> None:
    """Freed memory of this process goes back to the system, as far as its allocators can (malloc_trim is glibc's)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def handing_back(run: Callable) -> Callable:
    """run, the function of an Arrow task (of batches, of a group's table, or of two), that hands back what it has freed when it has ended.

    Spark keeps a Python worker for later tasks. Without this it keeps the peak of its last one too, beside stages that have no use for it.
    """
    def of_batches(batches):
        yield from run(batches)
        hand_back()

    def of_group(table):
        out = run(table)
        hand_back()
        return out

    def of_groups(left, right):
        out = run(left, right)
        hand_back()
        return out

    return of_batches if inspect.isgeneratorfunction(run) else of_group if len(inspect.signature(run).parameters) == 1 else of_groups


def giving_way(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that have the name of a result column (in any case): those give way to the result."""
    taken = {n.lower() for n in names}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    if len(kept) == len(df.columns):
        return df
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in kept])


def set_apart(df: DataFrame, *needed: str) -> DataFrame:
    """df with every column but the needed ones renamed by place, so that no name clashes; undone by toDF(*df.columns)."""
    return df.toDF(*[c if c in needed else f"extra_column_{i}" for i, c in enumerate(df.columns)])
