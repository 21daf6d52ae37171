"""Connected components of a graph held as a table of edges, by alternating large-star and small-star steps.

Each step is one aggregation (the least neighbour of each node) and one join; components shrink to stars around their least node in
a number of rounds that grows with the logarithm of their length. Edges are written to the shared folder after each round. No
neighbourhood is ever gathered: a node with many edges costs partial minima and a join that adaptive execution can split.
The tables of the rounds are deleted at the end; the result is a table of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, passing

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v, distinct."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        pulled = edges.join(least, "u")
        moved = pulled.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of one ordered type. node, root (the least node of its component) for every node that has an edge."""
    with passing(edges.sparkSession):
        return materialize(_components(edges), "components", lasting=True)


def _components(edges: DataFrame) -> DataFrame:
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = materialize(e, "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        e = materialize(_star(_star(e, True), False), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
