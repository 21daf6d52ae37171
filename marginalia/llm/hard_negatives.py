"""Hard-negative mining by dual-tree search: a tree over the anchors of a block against the tree over the candidates of a shard.

For a pair of nodes, the boxes give an interval that holds the inner product of every anchor in the one with every candidate in the other.
A pair is dropped, with all anchors and candidates below it, if its interval lies wholly below what any of the anchors still needs or wholly
above what all of them may take; else its children are paired. Pairs of leaves are scored exactly, those of higher intervals first, and
the k-th scores reached raise what an anchor group needs before the next pairs.

Two searches: the positives of an anchor (its best rows of the same label), then, for each positive, the best rows of other labels within a
window of scores between shares of the positive's score. Both windows and labels are checked row by row at the leaves.

Edge cases are those of vector_trees.py; rows without a label take no part; an anchor without positives has no rows; a negative positive
score leaves an empty window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialize
from marginalia.llm.vector_trees import LEAF_ROWS, QUERY_LEAF_ROWS, SHARD_ROWS, Best, Index, Packed, Tree, products, quantise

SCALE, POSITIVES, NEGATIVES, EVERY = 256.0, 5, 3, 50
#: A negative scores between these percentages of the positive's score.
LEAST_PERCENT, MOST_PERCENT = 50, 95


def intervals(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of points of the boxes a[i] with points of the boxes b[j]."""
    w = min(a[0].shape[1], b[0].shape[1])
    (al, ah), (bl, bh) = ((x[:, :w].astype(np.float64) for x in y) for y in (a, b))
    al, ah, bl, bh = al[i], ah[i], bl[j], bh[j]
    corners = (al * bl, al * bh, ah * bl, ah * bh)
    return np.minimum.reduce(corners).sum(axis=1), np.maximum.reduce(corners).sum(axis=1)


def _open(need: np.ndarray, cap: np.ndarray, i: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    return (high + slack >= need[i]) & (low - slack <= cap[i])


def walk(q: Packed, c: Packed, best: Best, rule: str) -> None:
    """Both trees are descended together; q may have several windows."""
    one, two = Tree(q.m, QUERY_LEAF_ROWS), Tree(c.m, LEAF_ROWS)
    top = float(np.abs(q.m).max(initial=0)) * float(np.abs(c.m).max(initial=0)) * max(q.m.shape[1], 1)
    slack = 1e-9 * top if top > 2**53 else 0.0
    # An empty window needs nothing: it must not hold a group open.
    void = q.low > q.high
    caps = np.where(void, -np.inf, q.high).max(axis=1)

    def needs() -> np.ndarray:
        return np.where(void, np.inf, best.kth.reshape(q.n, q.windows)).min(axis=1)

    i = j = np.zeros(1, np.int64)
    need = needs()
    for level in range(max(one.depth, two.depth) + 1):
        l1, l2 = min(level, one.depth), min(level, two.depth)
        if level:
            if level <= one.depth:
                i, j = np.repeat(2 * i, 2) + np.tile([0, 1], len(i)), np.repeat(j, 2)
            if level <= two.depth:
                i, j = np.repeat(i, 2), np.repeat(2 * j, 2) + np.tile([0, 1], len(j))
        starts = (q.n * np.arange(2**l1)) >> l1
        low, high = intervals(one.levels[l1], two.levels[l2], i, j)
        kept = _open(np.minimum.reduceat(need, starts), np.maximum.reduceat(caps, starts), i, low, high, slack)
        i, j, low, high = i[kept], j[kept], low[kept], high[kept]
    # Leaf pairs in waves: the w-th best pair of each anchor leaf.
    order = np.lexsort((-high, i))
    i, j, low, high = i[order], j[order], low[order], high[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    wave = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    cap = np.maximum.reduceat(caps, one.at[:-1])
    for w in range(int(wave.max(initial=-1)) + 1):
        at = np.flatnonzero(wave == w)
        need = np.minimum.reduceat(needs(), one.at[:-1])
        for p in at[_open(need, cap, i[at], low[at], high[at], slack)]:
            _leaves(q, c, best, rule, slice(one.at[i[p]], one.at[i[p] + 1]), slice(two.at[j[p]], two.at[j[p] + 1]))
        best.settle()


def _leaves(q: Packed, c: Packed, best: Best, rule: str, a: slice, b: slice) -> None:
    scores = products(q.m[a], c.m[b])
    kth = best.kth.reshape(q.n, q.windows)[a]
    fit = (scores >= kth.min(axis=1)[:, None]) & (q.ids[a][:, None] != c.ids[b][None, :])
    if rule != "any":
        fit &= (q.labels[a][:, None] == c.labels[b][None, :]) == (rule == "same")
    x, y = np.nonzero(fit)
    if not len(x):
        return
    got = scores[x, y]
    for w in range(q.windows):
        inside = (got >= kth[x, w]) & (got <= q.high[a][x, w])
        best.offer((a.start + x[inside]) * q.windows + w, got[inside], c.ids[b][y[inside]])


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: float = SCALE, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors: vec_id, label, embedding. anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its `positives` best rows of the same label, the `negatives` best rows of another label whose score is
    between the two percentages of the positive's.
    """
    index = Index(vectors.where("label is not null").select("vec_id", F.col("label").cast("long").alias("label"), quantise(F.col("embedding"), scale).alias("v")), shard_rows)
    anchors = index.vectors.where(is_anchor)
    every = {"lows": F.array(F.lit(float("-inf"))), "highs": F.array(F.lit(float("inf")))}
    near = materialize(index.search(anchors.withColumns(every), positives, walk, "same").select("query_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most `positives` rows an anchor: one window for each, in the order of rank.
    windows = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    low = lambda x: F.ceil(x["positive_score"] * least_percent / F.lit(100)).cast("double")
    high = lambda x: F.floor(x["positive_score"] * most_percent / F.lit(100)).cast("double")
    none = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.lit(float("inf")))
    filled = lambda f, void: F.slice(F.concat(F.transform("p", f), F.transform(none, lambda x: F.lit(void))), 1, positives)
    asked = anchors.join(windows, anchors.vec_id == windows.query_id).select(*anchors.columns, filled(low, float("inf")).alias("lows"), filled(high, float("-inf")).alias("highs"))
    far = index.search(asked, negatives, walk, "different").select("query_id", (F.col("place") + 1).alias("place"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").alias("nth"))
    out = far.join(near.withColumnRenamed("rank", "place"), ["query_id", "place"])
    return out.select(F.col("query_id").alias("anchor_id"), "positive_id", F.col("nth").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """DuckDB SQL of the query's rows: every anchor against every row."""
    v = f"list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE))"
    good = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return (
        f"WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, {v} v FROM embeddings WHERE {good}), "
        f"s AS (SELECT q.vec_id anchor_id, c.vec_id, q.label = c.label alike, list_inner_product(q.v, c.v)::BIGINT score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0), "
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) nth FROM s WHERE alike), "
        f"p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM p0 WHERE nth <= {POSITIVES}), "
        "n0 AS (SELECT p.*, s.vec_id negative_id, s.score negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER rank "
        f"FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score AND 100 * s.score <= {MOST_PERCENT} * p.positive_score) "
        f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n0 WHERE rank <= {NEGATIVES}"
    )
