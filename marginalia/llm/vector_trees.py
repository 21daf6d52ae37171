"""KD-trees over shards of integer vectors, and the Spark plan of exact inner-product searches over them.

Index. A skeleton of median splits, fitted on a bounded sample (SAMPLE rows of least id hash, at most SAMPLE / CELL_SAMPLE cells), gives each
vector a cell; every vector is then filed, none is dropped. A cell of more than SHARD_ROWS vectors, such as one that holds a third of all,
is dealt by hash into as many shards as it needs. In a shard, a task builds a KD-tree by median splits on the widest dimension; its order and
tight bounding boxes follow from the rows alone, so a shard is stored as one packed row (ids, labels, matrix).

Search. Queries are packed likewise, into blocks of up to BLOCK_ROWS queries of neighbouring cells.
  1. Home: each query meets one shard of its own cell. Its k-th score there is a floor for the k-th score overall.
  2. Pairs of a block and a shard whose boxes can hold no score between floor and ceiling are ruled out on the narrow table of boxes.
  3. What remains is dealt out by pair; a task walks the shard's tree for a whole block, from the floors on, and returns at most k rows a query.
  4. Rows of a query are merged by rank.
Floors only rule out what is certainly below the k-th score, so results are exact whatever the data; for vectors without structure little is
ruled out and the work is that of all blocks by all shards. A task holds one shard and one block at a time.

Scores below 2^53 are exact: products are taken in single precision where all sums stay below 2^24, else in double. Larger scores have 53 exact bits, and
stop at the ends of a long.

Edge cases: rows without an id or a vector, or with a null or non-finite component, take no part; rows equal in all of id, label and vector count once;
rows of one id with different vectors are candidates each, and queries together (the best of any of them counts); vectors of different lengths are taken to end in zeros; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS, QUERY_LEAF_ROWS = 2048, 4096, 64, 16
SAMPLE, CELL_SAMPLE = 16_384, 16
#: The largest component, which a long and a double both hold.
MOST = 2**62
#: Queries of so many neighbouring cells, as a power of two, share blocks.
NEAR_CELLS = 5
PACKED = "n int, width int, kind string, ids binary, labels binary, vectors binary, lows binary, highs binary, floors binary, windows int, least array<double>, most array<double>, floor double, ceiling double"
PAYLOAD = ("n", "width", "kind", "ids", "labels", "vectors", "lows", "highs", "floors", "windows")
FOUND = "query_id long, place int, vec_id long, score long"


# Vectors.


def quantise(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, or null where the vector is null or a component is null or not finite. Components beyond MOST stay there."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(MOST)), F.lit(-MOST))
    return F.when(vector.isNotNull() & good, F.transform(vector, whole))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of long), each different row once."""
    return vectors.where("vec_id is not null and v is not null").select("vec_id", "label", "v").distinct()


def _matrix(v: pa.Array) -> np.ndarray:
    """Lists as a matrix; shorter ones end in zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat, sizes = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _tight(m: np.ndarray) -> np.ndarray:
    """m in the smallest type that holds its whole numbers."""
    top = np.abs(m).max(initial=0)
    return m.astype(np.int8 if top < 2**7 else np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact below 2^53."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    kind = np.float32 if bound < 2**24 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def as_long(score: np.ndarray) -> np.ndarray:
    return np.clip(score, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


# Trees. A tree over n rows has 2^depth leaves; node i of level l holds rows n * i >> l to n * (i + 1) >> l of the tree's order.


def depth_of(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(n / leaf))) if n > leaf else 0


def edges(n: int, level: int) -> np.ndarray:
    return (n * np.arange(2**level + 1, dtype=np.int64)) >> level


def kd_order(m: np.ndarray, depth: int) -> np.ndarray:
    """Rows in the order of a tree: each node is split at the median of its widest dimension."""
    order = np.arange(len(m))
    if m.shape[1] == 0:
        return order
    for level in range(depth):
        at = edges(len(m), level + 1)
        for i in range(2**level):
            a, mid, b = at[2 * i], at[2 * i + 1], at[2 * i + 2]
            own = m[order[a:b]]
            dim = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order[a:b] = order[a:b][np.argpartition(own[:, dim], mid - a)]
    return order


class Tree:
    """Tight boxes of all nodes of a tree over m, which is in the tree's order."""

    def __init__(self, m: np.ndarray, leaf: int):
        self.depth, self.m = depth_of(len(m), leaf), m
        self.at = edges(len(m), self.depth)
        low, high = np.minimum.reduceat(m, self.at[:-1], axis=0), np.maximum.reduceat(m, self.at[:-1], axis=0)
        levels = [(low, high)]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            levels.append((low, high))
        self.levels = levels[::-1]


# Packed rows.


def _pack(keys: tuple, keyed: pa.Schema, table: pa.Table, leaf: int, schema: pa.Schema) -> pa.Table:
    m = _matrix(table.column("v"))
    order = kd_order(m, depth_of(len(m), leaf))
    m = _tight(m[order])
    long = lambda c: table.column(c).fill_null(0).to_numpy().astype(np.int64)[order]
    row = dict(zip(keyed.names, keys)) | {
        "n": len(m), "width": m.shape[1], "kind": m.dtype.str, "ids": long("vec_id").tobytes(), "labels": long("label").tobytes(), "vectors": m.tobytes(),
        "least": m.min(axis=0).astype(float).tolist(), "most": m.max(axis=0).astype(float).tolist(), "lows": None, "highs": None, "floors": None, "windows": 0, "floor": -math.inf, "ceiling": math.inf,
    }
    if "lows" in table.column_names:
        low, high, floor = (_matrix(table.column(c))[order] for c in ("lows", "highs", "floors"))
        row |= {"lows": low.tobytes(), "highs": high.tobytes(), "floors": floor.tobytes(), "windows": low.shape[1], "floor": float(np.maximum(low, floor).min()), "ceiling": float(high.max())}
    return pa.Table.from_pylist([row], schema=schema)


def pack(rows: DataFrame, keys: list[str], leaf: int) -> DataFrame:
    """One row for each value of the keys (int columns): vec_id, label, v (and lows, highs, floors) in the order of a tree, with the root's box."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = ", ".join([*[f"{k} int" for k in keys], PACKED])
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    keyed = pa.schema([schema.field(k) for k in keys])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _pack(tuple(k.as_py() for k in key), keyed, table, leaf, schema)

    return rows.groupBy(*keys).applyInArrow(run, kinds)


class Packed:
    def __init__(self, row: dict, mark: str = ""):
        row = {c: row[mark + c] for c in PAYLOAD}
        n, windows = row["n"], row["windows"]
        self.n, self.windows = n, windows
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.m = np.frombuffer(row["vectors"], np.dtype(row["kind"])).reshape(n, row["width"])
        if windows:
            self.low, self.high, self.floor = (np.frombuffer(row[c], np.float64).reshape(n, windows) for c in ("lows", "highs", "floors"))


# Results of one block.


class Best:
    """The k best rows of each slot: higher scores first, then smaller ids. kth is a slot's k-th score, or the floor it began with."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.kth = k, floors.astype(np.float64).copy()
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.new: list[tuple] = []

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot):
            self.new.append((slot, score, ids))

    def settle(self) -> bool:
        """Take the offers in. True if there were any."""
        if not self.new:
            return False
        slot, score, ids = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.new))
        self.new = []
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        full = rank == self.k - 1
        self.kth[slot[full]] = np.maximum(self.kth[slot[full]], score[full])
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        return True


Walk = Callable[[Packed, Packed, Best, str], None]


# The plan.


class Index:
    """vectors: vec_id, label, v. The filed vectors (with their cell), the packed shards, and the numbers of both."""

    def __init__(self, vectors: DataFrame, shard_rows: int = SHARD_ROWS):
        self.spark = vectors.sparkSession
        plain = materialize(usable(vectors), "vectors")
        n = plain.count()
        self.n = n
        sample = plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
        depth = max(0, min(math.ceil(math.log2(max(n, 1) / shard_rows)), int(math.log2(max(len(sample), CELL_SAMPLE) / CELL_SAMPLE))))
        skeleton = _skeleton(_matrix(sample.column("v")), depth)
        kinds = {f.name: f.dataType.simpleString() for f in plain.schema}

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield b.append_column("cell", pa.array(_cells(_matrix(b.column("v")), skeleton), pa.int32()))

        filed = plain.mapInArrow(file, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", cell int")
        self.vectors = materialize(filed.withColumn("salt", _salt()), "filed")
        # At most SAMPLE / CELL_SAMPLE rows.
        sizes = {r.cell: r.n for r in self.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.deal, self.shards_n = _deal(self.spark, sizes, shard_rows, "cell")
        dealt = self.vectors.join(F.broadcast(self.deal), "cell").withColumn("shard", (F.col("first") + F.col("salt") % F.col("parts")).cast("int"))
        self.shards = materialize(pack(dealt, ["shard"], LEAF_ROWS), "shards")

    def search(self, queries: DataFrame, k: int, walk: Walk, rule: str = "any") -> DataFrame:
        """queries: vec_id, label, v, cell, salt, lows and highs (arrays of double, one value for each window of scores).

        query_id, place (of the window), vec_id, score, rank: the k best candidates within each window of a query, by the rule any, same or
        different (label). A query's own id is no candidate.
        """
        queries = materialize(self._floored(queries, k, walk, rule), "queries")
        sizes = {r.near: r.n for r in queries.groupBy("near").agg(F.count(F.lit(1)).alias("n")).collect()}
        deal, _ = _deal(self.spark, sizes, BLOCK_ROWS, "near")
        dealt = queries.join(F.broadcast(deal), "near").withColumn("block", (F.col("first") + F.col("salt") % F.col("parts")).cast("int"))
        blocks = materialize(pack(dealt, ["block"], QUERY_LEAF_ROWS), "blocks")

        def found(q: Packed, c: Packed, row: dict) -> pa.RecordBatch:
            best = Best(np.maximum(q.floor, q.low).ravel(), k)
            walk(q, c, best, rule)
            return pa.RecordBatch.from_pydict({"query_id": q.ids[best.slot // q.windows], "place": (best.slot % q.windows).astype(np.int32), "vec_id": best.id, "score": as_long(best.score)})

        ranked = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
        out = _met(self._pairs(blocks), blocks, self.shards, found, FOUND)
        return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    def _floored(self, queries: DataFrame, k: int, walk: Walk, rule: str) -> DataFrame:
        """queries with floors: the k-th score of each window within one shard of the query's own cell, where that holds k."""
        dealt = queries.join(F.broadcast(self.deal), "cell").withColumn("shard", (F.col("first") + F.col("salt") % F.col("parts")).cast("int"))
        dealt = dealt.withColumn("floors", F.transform("lows", lambda x: F.lit(-math.inf))).withColumn("near", F.shiftright("cell", NEAR_CELLS))
        blocks = pack(dealt, ["shard", "near"], QUERY_LEAF_ROWS)

        def floored(q: Packed, c: Packed, row: dict) -> pa.RecordBatch:
            best = Best(q.low.ravel(), k)
            walk(q, c, best, rule)
            full = np.bincount(best.slot, minlength=q.n * q.windows) >= k
            floors = np.where(full, best.kth, -np.inf).reshape(q.n, q.windows)
            lists = {"v": (q.m.astype(np.int64), pa.int64()), "lows": (q.low, pa.float64()), "highs": (q.high, pa.float64()), "floors": (floors, pa.float64())}
            return pa.RecordBatch.from_pydict({"vec_id": q.ids, "label": q.labels, **{c: pa.array(list(m), pa.list_(t)) for c, (m, t) in lists.items()}, "near": np.full(q.n, row["near"], np.int32)})

        kinds = "vec_id long, label long, v array<long>, lows array<double>, highs array<double>, floors array<double>, near int"
        out = _met(blocks.select("shard", "near", F.col("shard").alias("block")), blocks.withColumnRenamed("shard", "block"), self.shards, floored, kinds)
        return out.withColumn("salt", _salt())

    def _pairs(self, blocks: DataFrame) -> DataFrame:
        """block, shard: those whose boxes allow a score between the block's floor and ceiling. A stated query set, in blocks, against all shards."""
        every = F.explode(F.sequence(F.lit(0), F.lit(self.shards_n - 1)) if self.shards_n else F.array().cast("array<int>"))
        one = blocks.select("block", "floor", "ceiling", F.col("least").alias("a"), F.col("most").alias("b"), every.alias("shard"))
        two = self.shards.select("shard", F.col("least").alias("c"), F.col("most").alias("d"))
        corner = lambda pick: F.aggregate(
            F.sequence(F.lit(1), F.least(F.size("a"), F.size("c"))), F.lit(0.0),
            lambda s, i: s + pick(*[F.element_at(x, i) * F.element_at(y, i) for x in ("a", "b") for y in ("c", "d")]),
        )
        high, low = corner(F.greatest), corner(F.least)
        # Sums beyond 2^53 are rounded: the bounds then get a margin.
        largest = lambda x, y: F.greatest(F.array_max(F.transform(x, F.abs)), F.array_max(F.transform(y, F.abs)))
        top = largest("a", "b") * largest("c", "d") * F.size("a")
        slack = F.when(top > float(2**53), top * 1e-9).otherwise(0.0)
        empty = F.least(F.size("a"), F.size("c")) == 0
        kept = empty | ((high + slack >= F.col("floor")) & (low - slack <= F.col("ceiling")))
        return one.join(two, "shard").where(kept).select("block", "shard")


def _salt() -> Column:
    return F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(2**31))


def _skeleton(sample: np.ndarray, depth: int) -> list[list[tuple[int, float]]]:
    """For each level, the dimension and the median of each node of a sample's tree."""
    out, order = [], np.arange(len(sample))
    for level in range(depth):
        at, row = edges(len(sample), level + 1), []
        for i in range(2**level):
            a, mid, b = at[2 * i], at[2 * i + 1], at[2 * i + 2]
            own = sample[order[a:b]]
            dim = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if own.size else 0
            if own.size:
                order[a:b] = order[a:b][np.argpartition(own[:, dim], mid - a)]
            row.append((dim, float(sample[order[mid], dim]) if own.size else 0.0))
        out.append(row)
    return out


def _cells(m: np.ndarray, skeleton: list) -> np.ndarray:
    cell = np.zeros(len(m), np.int32)
    for row in skeleton:
        dims, cuts = np.array([d for d, _ in row]), np.array([c for _, c in row])
        at = dims[cell]
        value = np.where(at < m.shape[1], m[np.arange(len(m)), np.minimum(at, m.shape[1] - 1)], 0.0) if m.shape[1] else np.zeros(len(m))
        cell = 2 * cell + (value >= cuts[cell])
    return cell


def _deal(spark: SparkSession, sizes: dict[int, int], most: int, key: str) -> tuple[DataFrame, int]:
    """key, first, parts: numbers for the parts of at most about `most` rows of each key. As many rows as the skeleton has cells at most."""
    rows, first = [], 0
    for k in sorted(sizes):
        parts = -(-sizes[k] // most)
        rows.append((k, first, parts))
        first += parts
    return spark.createDataFrame(rows, f"{key} int, first int, parts int"), first


def _met(pairs: DataFrame, blocks: DataFrame, shards: DataFrame, f: Callable[[Packed, Packed, dict], pa.RecordBatch], kinds: str) -> DataFrame:
    """What f makes of the block and the shard of each pair. Packed rows are few and large: pairs are dealt out evenly, and a task opens one pair at a time."""
    side = lambda df, key, mark: df.select(key, *[F.col(c).alias(mark + c) for c in PAYLOAD])
    joined = pairs.join(side(blocks, "block", "q_"), "block").join(side(shards, "shard", "c_"), "shard")
    joined = joined.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                out = f(Packed(row, "q_"), Packed(row, "c_"), row)
                if out.num_rows:
                    yield out

    return joined.mapInArrow(run, kinds)
