"""The partitioned neighbour join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.modeling import neighbors
from tablewright.modeling.neighbors import knn_classify, knn_regress, nearest_neighbors


def brute(queries, train, k, exclude_self=False):
    out = {}
    for qid, q in queries:
        ranked = sorted(
            (float(np.sqrt(((np.array(q) - np.array(t)) ** 2).sum())), tid)
            for tid, _, t in train if not (exclude_self and tid == qid)
        )
        out[qid] = [tid for _, tid in ranked[:k]]
    return out


@pytest.fixture(scope="module")
def points():
    """Three clusters, one of them a third of the rows in a single spot."""
    rng = np.random.default_rng(11)
    vectors = np.vstack([
        np.tile([1.0, 1.0, 1.0], (100, 1)), rng.normal(size=(120, 3)), rng.normal(size=(80, 3)) * 0.1 + 20,
    ])
    return [(i, i % 4, [float(x) for x in v]) for i, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def frames(spark, points):
    train = spark.createDataFrame(points, "id bigint, label int, vector array<double>")
    rng = np.random.default_rng(12)
    asked = [(i, [float(x) for x in rng.normal(size=3) * 6]) for i in range(60)] + [(60, [1.0, 1.0, 1.0]), (61, [1.0, 1.0, 1.0])]
    return spark.createDataFrame(asked, "id bigint, vector array<double>"), asked, train


@pytest.mark.parametrize("small_rows", [0, 20_000])
def test_exact(frames, points, small_rows, monkeypatch):
    queries, asked, train = frames
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    got = nearest_neighbors(queries, train, 5, pivots=12, small_rows=small_rows).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["id"], []).append(r["neighbor_id"])
    assert found == brute(asked, points, 5)


@pytest.mark.parametrize("small_rows", [0, 20_000])
def test_exclude_self(spark, points, frames, small_rows):
    train = frames[2]
    got = nearest_neighbors(train.select("id", "vector"), train, 3, pivots=12, exclude_self=True, small_rows=small_rows).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["id"], []).append(r["neighbor_id"])
    assert found == brute([(i, v) for i, _, v in points], points, 3, exclude_self=True)


def test_pruning_skips_far_cells(frames):
    queries, _, train = frames
    distinct = neighbors._distinct_vectors(train, 5).cache()
    grid = neighbors._pivots(distinct, distinct.count(), 40)
    cells = neighbors._with_cell(distinct, grid)
    summaries = neighbors._summaries(cells)
    assert summaries["size"].sum() == distinct.count()
    asked = neighbors._with_cell(queries.withColumnRenamed("id", "query"), grid).withColumn("bound", F.lit(2.0))
    visited = neighbors._visits(asked, grid, summaries, 5).select(F.size("cells").alias("n")).collect()
    assert sum(r["n"] for r in visited) < len(summaries) * queries.count() / 2


def test_two_levels_place_every_pivot_in_its_own_cell(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 4)))]
    distinct = spark.createDataFrame(rows, "id bigint, label int, vector array<double>")
    tops, starts, pivots = neighbors._pivots(distinct, 400, 100)
    assert starts[0] == 0 and starts[-1] == len(pivots) and (np.diff(starts) > 0).all()
    cell, gap = neighbors._kernels()[3](pivots, tops, starts, pivots)
    assert (cell == np.arange(len(pivots))).all() and (gap == 0).all()


def test_large_route_ends_without_a_top_k_merge(spark, frames):
    """The plan after the last written table; earlier ones are not in it."""
    queries, _, train = frames
    plan = nearest_neighbors(queries, train, 5, pivots=12, small_rows=0)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


@pytest.mark.parametrize("width, spread", [(1, 1.0), (8, 1.0), (2, 0.0)])
def test_exact_over_widths_and_ties(spark, width, spread):
    """Grid points with many equal distances; one table is a single vector."""
    rng = np.random.default_rng(width)
    train = [(i, i % 3, [float(round(x)) * spread for x in v]) for i, v in enumerate(rng.normal(size=(150, width)) * 3)]
    asked = [(i, [float(round(x)) for x in v]) for i, v in enumerate(rng.normal(size=(40, width)) * 3)]
    got = nearest_neighbors(
        spark.createDataFrame(asked, "id bigint, vector array<double>"),
        spark.createDataFrame(train, "id bigint, label int, vector array<double>"), 4, pivots=10, small_rows=0).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["id"], []).append(r["neighbor_id"])
    assert found == brute(asked, train, 4)


def test_fewer_training_rows_than_neighbours(spark):
    train = spark.createDataFrame([(1, 2, [0.0]), (2, 4, [9.0])], "id bigint, label int, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0])], "id bigint, vector array<double>")
    for small_rows in (0, 100):
        assert knn_regress(asked, train, 5, small_rows=small_rows).first()["prediction"] == 3.0
    assert knn_classify(asked, train, 1).first()["prediction"] == 2


def test_vote_ties_go_to_the_smaller_class(spark):
    train = spark.createDataFrame([(1, 3, [0.0]), (2, 1, [2.0])], "id bigint, label int, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0])], "id bigint, vector array<double>")
    assert knn_classify(asked, train, 2).first()["prediction"] == 1


def test_a_query_visits_strips_and_not_their_cells(spark):
    """In many dimensions nearly every cell is near; a query's vector goes once to the strip of many cells."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 24)))]
    distinct = spark.createDataFrame(rows, "id bigint, label int, vector array<double>")
    grid = neighbors._pivots(distinct, 600, 100)
    cells = neighbors._with_cell(distinct, grid)
    summaries = neighbors._summaries(cells)
    strips = neighbors._strips(summaries, len(grid[2]), 200)
    size = np.zeros(len(strips), int)
    size[summaries["cell"]] = summaries["size"]
    assert (np.diff(strips) >= 0).all() and strips[-1] < 6 and np.bincount(strips, size).max() <= 200
    asked = distinct.withColumnRenamed("id", "query").drop("label")
    asked = neighbors._with_cell(asked, grid).withColumn("bound", F.lit(5.0))
    visited = neighbors._visits(asked, grid, summaries, 5, strips).select(F.explode("cells").alias("s"), "query").collect()
    of_query = {r["query"]: strips[r["cell"]] for r in asked.select("query", "cell").collect()}
    assert len(visited) == len({tuple(r) for r in visited}) > 600 and all(r["s"] != of_query[r["query"]] for r in visited)


@pytest.mark.parametrize("shift, names", [(0.0, int), (1e6, "n{:04}".format)])
def test_exact_where_pruning_helps_little(spark, monkeypatch, shift, names):
    """Wide vectors near and far from zero, ids as numbers and as text; groups stay in the partitions they hash to."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 100)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(7)
    rows = [(names(i), i % 3, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(500, 12)), 1) + shift)]
    train = spark.createDataFrame(rows, f"id {'bigint' if names is int else 'string'}, label int, vector array<double>")
    try:
        got = nearest_neighbors(train.drop("label"), train, 4, pivots=30, exclude_self=True, small_rows=0).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["id"], []).append(r["neighbor_id"])
    assert found == brute([(i, v) for i, _, v in rows], rows, 4, exclude_self=True)


def test_a_training_set_is_not_measured_pair_by_pair():
    """Only what may be near is measured one by one, the rest goes by matrix products; numbers beyond squares are met too."""
    *_, nearest = neighbors._kernels()
    rng = np.random.default_rng(9)
    points = rng.normal(size=(300, 6))
    points[7], points[8, 0] = 1e200, np.inf
    known = neighbors.pd.DataFrame({"id": np.arange(300), "label": 0, "cell": np.arange(300) % 4, "vector": list(points)})
    asked = neighbors.pd.DataFrame({"query": np.arange(300), "own": -1, "bound": np.inf, "vector": list(points)})
    with np.errstate(all="ignore"):
        found = nearest(asked, known, 3).sort_values(["query", "distance", "id"]).groupby("query")["id"].apply(lambda s: list(s)[:3])
    expected = brute(list(enumerate(points)), [(i, 0, v) for i, v in enumerate(points) if i not in (7, 8)], 3)
    assert all(found[i] == expected[i] for i in range(300) if i not in (7, 8)) and found[7][0] == 7


def test_missing_numbers_are_no_neighbours_while_there_are_others(spark):
    train = [(1, 1, [0.0, None]), (2, 2, [1.0, 1.0]), (3, 3, [None, 2.0]), (4, 4, [5.0, 5.0])]
    asked = spark.createDataFrame([(9, [4.0, 4.0])], "id bigint, vector array<double>")
    got = nearest_neighbors(asked, spark.createDataFrame(train, "id bigint, label int, vector array<double>"), 2)
    assert [(r["rank"], r["neighbor_id"]) for r in got.orderBy("rank").collect()] == [(1, 4), (2, 2)]
