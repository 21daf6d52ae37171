"""Vector nearest neighbours and the hybrid rerank of their result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.operators import cells
from marginalia.sources.scratch import kept


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 distance of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, index: cells.Cells | None = None) -> DataFrame:
    """queries: query_id, embedding. vectors: id (a key), embedding and any others. The k nearest vectors of each query with distance and rank (ties by id).

    With an index of cells over the vectors, those that bounds rule out are not read. Without one, the stated queries are broadcast (a batch of user
    input), so the vectors are scanned once and never dealt out; Spark keeps only k rows a query in each partition before the final ranking. Other columns take no
    part in that: they are read for the k rows of each query alone, by their ids, which a join below (texts by id) can filter with too.
    """
    if index is not None:
        return vectors.drop("embedding").join(cells.nearest(index, queries, k), "id")
    q = F.broadcast(queries.select("query_id", F.col("embedding").alias("q_embedding")))
    pairs = vectors.select("id", "embedding").crossJoin(q).withColumn("distance", squared_distance(F.col("embedding"), F.col("q_embedding")))
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    found = pairs.drop("embedding", "q_embedding").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    others = [c for c in vectors.columns if c not in ("id", "embedding")]
    if not others:
        return found
    found = kept(found, "nearest")
    ids = [r.id for r in found.select("id").distinct().collect()]  # k rows a query of the batch
    return vectors.drop("embedding").where(F.col("id").isin(ids)).join(F.broadcast(found), "id")


def hybrid_rerank(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """queries: query_id, query. found: query_id, rank, text and any others. The k best by 0.75 rank share + 0.25 keyword overlap; ties keep their rank."""
    q = queries.select("query_id", T.tokens(F.col("query")).alias("_q"))
    own = Window.partitionBy("query_id")
    x = found.join(F.broadcast(q), "query_id").withColumn("_n", F.count(F.lit(1)).over(own))
    place = (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)
    x = x.withColumn("score", 0.75 * (1 - place) + 0.25 * S.keyword(F.col("_q"), T.tokens(F.col("text"))))
    x = x.withColumn("new_rank", F.row_number().over(own.orderBy(F.desc("score"), "rank")))
    return x.where(F.col("new_rank") <= k).drop("_q", "_n")


def within_budget(ranked: DataFrame, most: int, rank: str = "new_rank") -> DataFrame:
    """Cuts texts (in rank order, for each query) so that they hold `most` characters together; rows after that are dropped."""
    w = Window.partitionBy("query_id").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    x = ranked.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).where((F.col("_before") < most) | (F.col(rank) == 1))
    return x.withColumn("text", F.substring("text", F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.col("_before")).cast("int"))).drop("_before")
