"""Exact top-k search by inner product over KD-trees, one a shard.

A task walks one shard's tree for a block of queries. Down the levels, the bound of each box for each query (the largest inner product that
any point in the box could have with it) rules nodes out whose bound lies below the query's k-th score so far; no child of theirs is looked at.
The leaves that remain are visited best first: in each wave every query visits the leaf of its next highest bound, queries at the
same leaf are scored together, and the k-th scores rise before the next wave. The k-th score that a query begins with is the one that it
reached in a shard of its own cell (vector_trees.py). Ties at the k-th score are kept until the smaller ids are known.

Edge cases are those of vector_trees.py; a query with fewer than k candidates gets them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.vector_trees import LEAF_ROWS, SHARD_ROWS, Best, Index, Packed, Tree, products, quantise

SCALE, TOP, EVERY = 64.0, 20, 20


def upper_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box, the largest inner product with a point of the box."""
    w = min(q.shape[1], low.shape[1])
    q, low, high = q[:, :w], low[:, :w].astype(np.float64), high[:, :w].astype(np.float64)
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def walk(q: Packed, c: Packed, best: Best, rule: str = "any") -> None:
    """Best-first walk of the tree over c for the queries q (one window each)."""
    tree, m = Tree(c.m, LEAF_ROWS), q.m.astype(np.float64)
    # Sums of whole numbers beyond 2^53 are rounded: bounds then get a margin.
    top = float(np.abs(m).max(initial=0)) * float(np.abs(c.m).max(initial=0)) * max(m.shape[1], 1)
    slack = 1e-9 * top if top > 2**53 else 0.0
    alive = np.ones((q.n, 1), bool)
    for level, (low, high) in enumerate(tree.levels):
        if level:
            alive = np.repeat(alive, 2, axis=1)
        bound = np.where(alive, upper_bounds(m, low, high) + slack, -np.inf)
        alive &= bound >= best.kth[:, None]
    bound = np.where(alive, bound, -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    for wave in range(order.shape[1]):
        leaf = order[:, wave]
        going = np.flatnonzero((bound[np.arange(q.n), leaf] >= best.kth) & alive[np.arange(q.n), leaf])
        if not len(going):
            break
        by_leaf = going[np.argsort(leaf[going], kind="stable")]
        for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            a, b = tree.at[leaf[group[0]]], tree.at[leaf[group[0]] + 1]
            scores = products(q.m[group], c.m[a:b])
            i, j = np.nonzero((scores >= best.kth[group][:, None]) & (q.ids[group][:, None] != c.ids[a:b][None, :]))
            best.offer(group[i], scores[i, j], c.ids[a:b][j])
        best.settle()


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: float = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors: vec_id, embedding. query_id, rank, vec_id, score for each row of is_query: its k rows of highest inner product of floor(scale * x), ties to smaller ids."""
    index = Index(vectors.select("vec_id", F.lit(0).cast("long").alias("label"), quantise(F.col("embedding"), scale).alias("v")), shard_rows)
    queries = index.vectors.where(is_query).withColumns({"lows": F.array(F.lit(float("-inf"))), "highs": F.array(F.lit(float("inf")))})
    found = index.search(queries, k, walk)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle() -> str:
    """DuckDB SQL of the query's rows: every query against every row."""
    v = f"list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE))"
    good = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return (
        f"WITH v AS (SELECT DISTINCT vec_id, {v} v FROM embeddings WHERE {good}), "
        f"s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER rank FROM s) "
        f"SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}"
    )
