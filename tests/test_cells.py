"""The index of cells gives the rows of a full scan, whatever the data."""

import numpy as np
import pytest

from marginalia.operators import cells, vectors


def made(kind, n=600, width=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    if kind == "groups":
        v = centres[rng.integers(20, size=n)] + 0.05 * rng.normal(size=(n, width))
    elif kind == "copies":
        v = np.where(rng.random(n)[:, None] < 0.4, centres[0], rng.normal(size=(n, width)))
    else:
        v = rng.normal(size=(n, width))
    return [(i, [float(x) for x in row]) for i, row in enumerate(v.astype(np.float32))]


@pytest.mark.parametrize("kind", ["groups", "copies", "plain"])
def test_equals_scan(spark, kind):
    rows = made(kind)
    v = spark.createDataFrame(rows + [(9999, None)], "id long, embedding array<float>")
    q = spark.createDataFrame([r for r in rows if r[0] % 17 == 0], "query_id long, embedding array<float>")
    index = cells.build(v, part_rows=50)
    got = sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in cells.nearest(index, q, 7).collect())
    want = sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in vectors.nearest(q, v.where("embedding is not null"), 7).collect())
    assert got == want and len(got) == 36 * 7
    share = cells.share_read(index, cells.candidates(index, q, 7), 36).first().share
    assert share < {"groups": 0.08, "copies": 0.35, "plain": 0.1}[kind]


def test_cells_are_ruled_out(spark):
    """On grouped vectors the triangle inequality leaves few parts to a query."""
    rows = made("groups", 2000)
    index = cells.build(spark.createDataFrame(rows, "id long, embedding array<float>"))
    q = spark.createDataFrame(rows[:10], "query_id long, embedding array<float>")
    found = cells.candidates(index, q, 5)
    parts = found.select("query_id", "cell", "part").distinct().count()
    assert index.parts.count() >= 20 and parts <= 10 * index.parts.count() / 3


def test_small_and_empty(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b2", [0.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id int, embedding array<float>")
    got = [(r.query_id, r.id, r["rank"], r.distance) for r in cells.nearest(cells.build(v), q, 5).orderBy("rank").collect()]
    assert got == [(1, "b", 1, 0.0), (1, "b2", 2, 0.0), (1, "a", 3, 2.0)]
    none = cells.build(v.where("false"))
    assert none.vectors == 0 and cells.nearest(none, q.where("false"), 5).isEmpty()
