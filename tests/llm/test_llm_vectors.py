"""Hard negatives and top-k search: against brute force over all rows, with small shards so that there are many of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import hard_negatives, topk_search, vector_trees
from marginalia.llm.vector_trees import Best, Packed, Tree, kd_order

SCHEMA = "vec_id long, label int, embedding array<float>"


def floors(vector, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in vector]


def usable(rows, scale, labelled=False):
    out = {}
    for i, label, v in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not np.isfinite(x) for x in v):
            continue
        out[(i, label if labelled else 0, tuple(floors(v, scale)))] = None
    return list(out)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k, every=20):
    rows = usable(rows, 64)
    out = []
    for i in {r[0] for r in rows if r[0] % every == 0}:
        best = sorted((-dot(v, w), j) for q, _, v in rows if q == i for j, _, w in rows if j != i)[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows, every=50):
    rows = usable([(i, None if a is None else (a + 1) % 10 if i is not None and i % 7 == 0 else a, v) for i, a, v in rows], 256, True)
    out = []
    for i in {r[0] for r in rows if r[0] % every == 0}:
        scored = sorted((-dot(v, w), j, other == label) for q, label, v in rows if q == i for j, other, w in rows if j != i)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(t, n) for t, n, alike in scored if not alike and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, p, rank, n, -s, -t) for rank, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def made(n, seed, groups=6, width=9, loose=0.25):
    """Vectors around a few centres, a third of them equal, with odd rows among them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    rows = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else centres[rng.integers(groups)] + loose * rng.normal(size=width)
        rows.append((i, int(rng.integers(10)), [float(x) for x in v / np.linalg.norm(v)]))
    odd = [(None, 1, [0.5] * width), (20, None, [0.5] * width), (50, 3, None), (100, 3, [float("nan")] + [0.1] * (width - 1)), (101, 3, [float("inf")] * width), (150, 2, [None] * width), (n + 1, 2, [1.0]), (n + 2, 2, []), rows[60], rows[60]]
    return rows + odd


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed):
    rows = made(700, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=40)) == brute_top(rows, 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    rows = made(700, seed, loose=0.6)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = got(hard_negatives.mine(df, F.col("vec_id") % 50 == 0, shard_rows=40))
    assert found == brute_negatives(rows) and len(found) > 50


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.5, 0.0]), (2, 2, [0.4, 1.0])], SCHEMA)
    assert got(topk_search.top_k(df, F.col("vec_id") == 0)) == [(0, 1, 1, 2048), (0, 2, 2, 1600)]
    assert got(hard_negatives.mine(df, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 32768, 26112)]
    empty = spark.createDataFrame([], SCHEMA)
    assert topk_search.top_k(empty, F.lit(True)).isEmpty() and hard_negatives.mine(empty, F.lit(True)).isEmpty()
    assert topk_search.top_k(df, F.col("vec_id") == 77).isEmpty()
    clash = df.selectExpr("*", "1 as score", "'x' as cell", "2 as v", "3 as rank")
    assert got(topk_search.top_k(clash, F.col("vec_id") == 0)) == [(0, 1, 1, 2048), (0, 2, 2, 1600)]
    assert len(got(hard_negatives.mine(clash, F.col("vec_id") == 0))) == 1


def test_large_components(spark):
    """Sums beyond 2^24 stay exact; beyond 2^53 the order of scores does."""
    rows = [(i, 1, [1000.0 * (1 + i), 3.0, -1.0]) for i in range(40)]
    assert got(topk_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=4, shard_rows=10)) == brute_top(rows, 4)
    huge = [(i, 1, [1e18 * (1 + i), 2.0]) for i in range(40)] + [(99, 1, [3e38, -3e38])]
    found = got(topk_search.top_k(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") == 0, k=3))
    assert [x[0] for x in found] == [0, 0, 0] and found[0][3] > 2**62


def packed(m, labels=None, windows=0, low=None, high=None):
    """A packed row in the order of a tree, as a task opens it."""
    order = kd_order(m, vector_trees.depth_of(len(m), vector_trees.QUERY_LEAF_ROWS if windows else vector_trees.LEAF_ROWS))
    p = Packed.__new__(Packed)
    p.n, p.windows, p.m, p.ids = len(m), windows, m[order], order.astype(np.int64)
    p.labels = (np.zeros(len(m), np.int64) if labels is None else labels)[order]
    if windows:
        p.low, p.high = (np.full((len(m), windows), x) for x in (low, high))
        p.floor = np.full((len(m), windows), -np.inf)
    return p


def test_trees_prune():
    """Boxes are tight, and on vectors with structure most leaf pairs are never scored."""
    rng = np.random.default_rng(5)
    centres = 400 * rng.normal(size=(64, 8))
    m = np.round(centres[np.arange(2048) % 64] + 4 * rng.normal(size=(2048, 8)))
    tree = Tree(m[kd_order(m, 5)], 64)
    assert tree.depth == 5 and (tree.levels[0][0][0] == m.min(axis=0)).all() and (tree.levels[0][1][0] == m.max(axis=0)).all()
    counts = {}
    for name, walk, module in (("top", topk_search.walk, topk_search), ("dual", hard_negatives.walk, hard_negatives)):
        seen, real = [0], module.products

        def counted(a, b, seen=seen, real=real):
            seen[0] += len(a) * len(b)
            return real(a, b)

        module.products = counted
        try:
            q, c = packed(m[:1024], windows=1, low=-np.inf, high=np.inf), packed(m)
            q.ids = q.ids + 10_000
            best = Best(q.low.ravel(), 3)
            walk(q, c, best, "any")
            best.settle()
        finally:
            module.products = real
        scores = q.m @ c.m.T
        want = np.sort(scores, axis=1)[:, ::-1][:, :3]
        assert (np.sort(best.score.reshape(1024, 3), axis=1)[:, ::-1] == want).all()
        counts[name] = seen[0] / scores.size
    assert counts["top"] < 0.25 and counts["dual"] < 0.5, counts


def test_every_query_by_home_floors(spark):
    """Floors from the home shard change nothing but the work: equal to a search with k beyond any shard, cut to k."""
    rows = made(400, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    few = got(topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=3, shard_rows=30))
    many = [x for x in got(topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=1000, shard_rows=30)) if x[1] <= 3]
    assert few == many
