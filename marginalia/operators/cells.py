"""Exact nearest neighbours through an index of cells: what bounds rule out is never read.

The index. Centres are seeded rows of the vectors (of least id hash, at most CENTRES of them). Each vector goes to its nearest centre, into parts of
at most PART_ROWS rows, so that a cell which holds a third of all vectors is many parts. A part is one row of two tables: `codes`, with each vector's
distance from the centre, its offset from the centre in eight bits a dimension and the length of what that rounding lost; and `full`, with
the vectors themselves.

A search, for a batch of queries of any size:
  1. Cells. The distances of a query from the centres give, by the triangle inequality, the least distance of any vector of a part.
  2. First bound. In the cells nearest to the query that hold k vectors together, the codes give an upper bound of each distance (by the triangle
     inequality again: distance to the rounded vector plus what rounding lost). The k-th of them bounds the k-th nearest distance.
  3. Second pass. All parts that are not ruled out; of their vectors, those whose lower bound by code does not exceed the query's bound, nor the
     k-th upper bound of their part, nor that of all parts together.
  4. The exact distances of those, read from `full`, only from the parts that have any.
The rows are those of a scan over all vectors. share_read() tells how much of them was read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.sources.scratch import kept, new_path

CENTRES, PART_ROWS, QUERY_ROWS = 256, 4096, 4096
#: Bounds are widened by this share, so that rounding of sums cannot rule out a tie.
SLACK = 1e-9


def _rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a from the rows of b."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _wide(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + SLACK) + SLACK


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(m.ravel(), kind))


@dataclass
class Cells:
    """The index at a folder. parts: cell, part, n, least, most (distances from the centre) of each part, at most one row for PART_ROWS vectors."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    vectors: int
    kind: str  # type of the ids

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    @property
    def full(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/full")

    @property
    def parts(self) -> DataFrame:
        return self.codes.select("cell", "part", "n", "least", "most")


def build(vectors: DataFrame, path: str | None = None, centres: int = CENTRES, part_rows: int = PART_ROWS) -> Cells:
    """vectors: id, embedding (all of one length; rows without one are left out). Writes the index to path (else to the shared folder)."""
    spark = vectors.sparkSession
    path = path or new_path(spark, "cells")
    rows = vectors.select("id", "embedding").where("embedding is not null")
    kind = rows.schema["id"].dataType.simpleString()
    most = min(centres, max(1, int(math.sqrt(total)))) if (total := rows.count()) else 1
    seeds = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("embedding").toArrow().column("embedding")
    middle = _rows(seeds) if total else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_rows(b.column("embedding")), middle)
                near = d.argmin(axis=1)
                yield b.append_column("cell", pa.array(near, pa.int32()))

    placed = rows.mapInArrow(assign, f"id {kind}, embedding {rows.schema['embedding'].dataType.simpleString()}, cell int")
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    # At most CENTRES rows.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id", "embedding"), F.col("parts")).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        v = _rows(table.column("embedding"))
        off = v - middle[cell]
        r = np.sqrt((off * off).sum(axis=1))
        scale = max(float(np.abs(off).max(initial=0)) / 127, 1e-300)
        code = np.rint(off / scale).astype(np.int8)
        lost = np.sqrt(((off - code * scale) ** 2).sum(axis=1))
        ids = table.column("id").combine_chunks()
        return pa.table({
            "cell": pa.array([cell], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(v)], pa.int32()), "least": [float(r.min())], "most": [float(r.max())],
            "ids": pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), ids), "r": _lists(r[None, :], pa.float64()), "lost": _lists(lost[None, :], pa.float64()), "scale": [scale],
            "code": [code.tobytes()], "vectors": [v.tobytes()],
        })

    packed = dealt.groupBy("cell", "part").applyInArrow(pack, f"cell int, part int, n int, least double, most double, ids array<{kind}>, r array<double>, lost array<double>, scale double, code binary, vectors binary")
    packed.write.parquet(f"{path}/packed")
    packed = spark.read.parquet(f"{path}/packed")
    packed.drop("vectors").write.parquet(f"{path}/codes")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(middle)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    packed.select("cell", "part", "ids", "vectors").write.parquet(f"{path}/full")
    return Cells(spark, path, middle, total, kind)


def open_at(spark: SparkSession, path: str) -> Cells:
    """The index that build() wrote to path."""
    codes = spark.read.parquet(f"{path}/codes")
    middle = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow().column("centre")  # at most CENTRES rows
    return Cells(spark, path, _rows(middle), codes.agg(F.sum("n")).first()[0] or 0, codes.schema["ids"].dataType.elementType.simpleString())


def _bounds(q: np.ndarray, centre: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries from the rounded vectors of a part, and what rounding may add or take."""
    code = np.frombuffer(row["code"], np.int8).reshape(row["n"], q.shape[1])
    return _distances(q, centre + code * row["scale"]), np.asarray(row["lost"])[None, :]


def _met(cells: Cells, asked: DataFrame, f, kinds: str) -> DataFrame:
    """f(queries as a table, part as a row) for each part and the queries that ask for it. asked: query_id, q, cell and any others.

    A part is sent once to each block of QUERY_ROWS queries that asks for its cell, so a task holds one part and one block.
    """
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))  # at most CENTRES rows
    asked = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    numbers = cells.parts.groupBy("cell").agg((F.max("part") + 1).alias("parts"))
    left = asked.join(F.broadcast(numbers), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = cells.codes.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = [f(mine, row) for row in theirs.to_pylist()] if mine.num_rows else []
        return pa.concat_tables(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(kinds)).empty_table()
    keys = ("cell", "part", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kinds)


def candidates(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """queries: query_id, embedding. query_id, id, cell, part, at (its place there): a superset of the k nearest of each query, by bounds alone."""
    middle, kind = cells.centres, queries.schema["query_id"].dataType.simpleString()
    # At most CENTRES rows: the vectors of each cell and the range of their distances from its centre.
    of_cell = {r.cell: (r.n, r.least, r.most) for r in cells.parts.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()}
    numbers = np.array(sorted(of_cell), np.int32)
    counts, least, most = (np.array([of_cell[c][i] for c in numbers], float) for i in range(3))

    def near(home: bool):
        """The cells of a query: its nearest ones that hold k vectors together; or those that its bound does not rule out."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = _distances(_rows(b.column("q")), middle[numbers])
                if home:
                    order = np.argsort(d, axis=1)
                    before = np.cumsum(counts[order], axis=1) - counts[order]
                    i, j = np.nonzero(before < k)
                    j = order[i, j]
                else:
                    bound = b.column("bound").to_numpy(zero_copy_only=False).astype(float)
                    low = np.maximum(np.maximum(d - most, least - d), 0)
                    i, j = np.nonzero(low <= _wide(bound)[:, None])
                yield b.take(pa.array(i)).append_column("cell", pa.array(numbers[j], pa.int32()))

        return run

    plain = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("q"))

    def upper(mine: pa.Table, row: dict) -> pa.Table:
        d, lost = _bounds(_rows(mine.column("q")), middle[row["cell"]], row)
        some = np.sort(d + lost, axis=1)[:, :k]
        return pa.table({"query_id": mine.column("query_id").take(pa.array(np.repeat(np.arange(len(some)), some.shape[1]))), "high": some.ravel()})

    home = _met(cells, plain.mapInArrow(near(True), f"query_id {kind}, q array<double>, cell int"), upper, f"query_id {kind}, high double")

    def bounded(rows: DataFrame) -> DataFrame:
        """The k-th upper bound of each query."""
        ranked = rows.select("query_id", "high").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("high"))).where(F.col("n") <= k)
        return ranked.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("high")).otherwise(float("inf")).alias("bound"))

    bound = bounded(home)

    def lower(mine: pa.Table, row: dict) -> pa.Table:
        d, lost = _bounds(_rows(mine.column("q")), middle[row["cell"]], row)
        bound = mine.column("bound").to_numpy()
        if row["n"] >= k:
            bound = np.minimum(bound, np.partition(d + lost, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d - lost <= _wide(bound)[:, None])
        return pa.table({
            "query_id": mine.column("query_id").take(pa.array(i)), "q": mine.column("q").combine_chunks().take(pa.array(i)), "cell": np.full(len(i), row["cell"], np.int32),
            "part": np.full(len(i), row["part"], np.int32), "at": j.astype(np.int32), "low": (d - lost)[i, j], "high": (d + lost)[i, j],
        })

    again = plain.join(bound, "query_id").mapInArrow(near(False), f"query_id {kind}, q array<double>, bound double, cell int")
    found = _met(cells, again, lower, f"query_id {kind}, q array<double>, cell int, part int, at int, low double, high double")
    # Of all parts together, the k-th upper bound is nearer still. The rows are written once, as both sides of this read them.
    found = kept(found, "candidates")
    last = bounded(found)
    return found.join(last, "query_id").where(F.col("low") <= F.col("bound") * (1 + SLACK) + SLACK).select("query_id", "q", "cell", "part", "at")


def exact(cells: Cells, found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among the candidates, by exact distance; ties by id."""
    kind, width = found.schema["query_id"].dataType.simpleString(), cells.centres.shape[1]
    kinds = f"query_id {kind}, id {cells.kind}, distance double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        for row in theirs.to_pylist() if mine.num_rows else []:
            v = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
            at = mine.column("at").to_numpy()
            # A candidate at a time would be slow, all at once could be large.
            d = np.concatenate([((_rows(mine.column("q").slice(i, 8192)) - v[at[i : i + 8192]]) ** 2).sum(axis=1) for i in range(0, len(at), 8192)])
            ids = pa.array(row["ids"], schema.field("id").type)
            out.append(pa.table({"query_id": mine.column("query_id"), "id": ids.take(pa.array(at)), "distance": d}, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    # Candidates of one part are dealt out by blocks too, so that a part which all queries ask for is not one task.
    blocks = found.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS * 8)).cast("int").alias("blocks"))
    mine = found.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    theirs = cells.full.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ("cell", "part", "block")
    scored = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(run, kinds)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def nearest(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance (squared), rank: as operators.vectors.nearest over the indexed vectors."""
    return exact(cells, candidates(cells, queries, k), k)


def share_read(cells: Cells, found: DataFrame, queries: int) -> DataFrame:
    """found: candidates(). One row: distances computed from whole vectors, as a share of queries x vectors."""
    return found.agg(F.count(F.lit(1)).alias("compared"), (F.count(F.lit(1)) / F.lit(float(max(1, queries * cells.vectors)))).alias("share"))
