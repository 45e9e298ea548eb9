"""Forests whose large nodes Spark splits and whose small ones are grown inside tasks."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.modeling import forests
from tablewright.modeling.candidates import Settings, TrainingFacts, pool_of
from tablewright.modeling.forests import Forest, ForestModel


@pytest.fixture(scope="module")
def points(spark):
    """Two numbers of few values and four yes/no features; the class and the number to learn follow from them with noise."""
    rng, rows = random.Random(11), []
    for i in range(900):
        a, b, hot = rng.randrange(20), rng.randrange(-5, 6), rng.randrange(4)
        rows.append((i, float(a), float(b), *[float(hot == k) for k in range(4)], a * b + hot + rng.random(), float((a + hot + rng.randrange(8)) // 9)))
    df = spark.createDataFrame(rows, "id long, a double, b double, h0 double, h1 double, h2 double, h3 double, y double, kind double")
    return VectorAssembler(inputCols=["a", "b", "h0", "h1", "h2", "h3"], outputCol="features").transform(df).repartition(3, "id")


def told(model, df, column="prediction"):
    return {r["id"]: r[column] for r in model.transform(df).select("id", column).collect()}


def spec(kind, label, **choices):
    return kind(labelCol=label, featureSubsetStrategy=choices.pop("features", "all"), maxDepth=30, seed=3, **choices)


def test_one_tree_is_sparks_tree(points):
    """Without chance both take the same splits, to the last leaf."""
    for kind, label in ((RandomForestRegressor, "y"), (RandomForestClassifier, "kind")):
        wanted = spec(kind, label, numTrees=1, bootstrap=False)
        theirs, own = wanted.fit(points), Forest(wanted).fit(points)
        a, b = told(theirs, points), told(own, points)
        # of cuts that are equally good, rounding picks another one now and then
        assert np.mean(np.isclose([a[i] for i in a], [b[i] for i in a])) > 0.97
        assert np.allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-2)
    shares = {r["id"]: r["p"] for r in theirs.transform(points).select("id", vector_to_array("probability").alias("p")).collect()}
    own = told(own, points, "probability")
    assert np.mean([np.allclose(shares[i], own[i]) for i in shares]) > 0.8


@pytest.mark.parametrize("bootstrap", [False, True])
def test_nodes_split_by_spark_are_those_split_in_tasks(points, monkeypatch, bootstrap):
    for kind, label in ((RandomForestRegressor, "y"), (RandomForestClassifier, "kind")):
        wanted = spec(kind, label, numTrees=2, bootstrap=bootstrap)
        inside = Forest(wanted).fit(points)
        with monkeypatch.context() as m:
            # at most about 200 rows are left to a task, and a job adds up a few nodes
            m.setattr(forests, "SMALL_ENTRIES", 800)
            m.setattr(forests, "CELLS", 1_000)
            split = Forest(wanted).fit(points)
        a, b = told(inside, points), told(split, points)
        # of cuts that are equally good, rounding picks another one now and then
        assert np.mean(np.isclose([a[i] for i in a], [b[i] for i in a])) > 0.9
        assert np.allclose(inside.featureImportances.toArray(), split.featureImportances.toArray(), atol=5e-3)


def test_deep_forests_take_no_more_jobs_than_flat_ones(spark, points):
    """Spark's own builder takes a job or more a level, and adds up all bins of every open node in each."""
    rows, jobs = points.withColumnRenamed("y", "label"), []
    for depth in (1, 30):
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        pool_of("regression")["Random Forest"](Settings(trees=3, forest_depth=depth), TrainingFacts(900, 1.0, 2, 6)).fit(rows)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth {depth}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 1


def test_weights_are_those_of_a_bootstrap():
    drawn = forests._kernels()[0](np.arange(100_000), 7, 42, True)
    other = forests._kernels()[0](np.arange(100_000), 8, 42, True)
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03 and abs((drawn == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(drawn, other)[0, 1]) < 0.02


def test_equal_rows_missing_classes_and_saving(spark, points, tmp_path):
    same = points.limit(5).select("id", F.col("features"), F.lit(2.5).alias("y"), F.lit(1.0).alias("kind"))
    assert set(told(Forest(spec(RandomForestRegressor, "y", numTrees=3)).fit(same), same).values()) == {2.5}
    one = Forest(spec(RandomForestClassifier, "kind", numTrees=3)).fit(same)
    assert set(told(one, same).values()) == {1.0} and one.featureImportances.toArray().sum() == 0
    model = Forest(spec(RandomForestClassifier, "kind", numTrees=5, features="sqrt")).fit(points)
    model.save(str(tmp_path / "forest"))
    assert told(ForestModel.load(str(tmp_path / "forest")), points, "probability") == told(model, points, "probability")
    with pytest.raises(ValueError):
        Forest(spec(RandomForestRegressor, "y")).fit(points.limit(0))


@pytest.mark.parametrize("kind, label", [(RandomForestRegressor, "y"), (RandomForestClassifier, "kind")])
def test_large_forests_stay_in_files(points, tmp_path, monkeypatch, kind, label):
    """No process holds the trees: they are written where they grow, and read tree by tree while rows are scored, many batches at once."""
    model = Forest(spec(kind, label, numTrees=7)).fit(points)
    column = "probability" if label == "kind" else "prediction"
    sent = told(model, points, column)
    # trees are added up in another order
    same = lambda other: other.keys() == sent.keys() and all(np.allclose(other[i], sent[i], rtol=1e-12) for i in sent)
    assert not [v for v in vars(model).values() if isinstance(v, list) and v and not isinstance(v[0], float)]
    model.save(str(tmp_path / "forest"))
    monkeypatch.setattr(forests, "SENT_BYTES", 0)
    for bound in (100, forests.SCORED_BYTES):
        monkeypatch.setattr(forests, "SCORED_BYTES", bound)
        assert same(told(model, points, column))
    assert same(told(ForestModel.load(f"file:{tmp_path / 'forest'}"), points, column))
    assert told(model, points.limit(0), column) == {}


def test_whole_trees_are_sent_the_rows_once(spark, points):
    """Rows of a table that a task can hold are not shuffled again for every tree."""
    written, rows = {}, points.withColumnRenamed("y", "label")
    for trees in (2, 40):
        spark.sparkContext.setJobGroup(f"{trees} trees", "")
        pool_of("regression")["Extra Trees"](Settings(trees=trees), TrainingFacts(900, 1.0, 2, 6)).fit(rows)
        tracker = spark.sparkContext.statusTracker()
        written[trees] = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"{trees} trees"))
    spark.sparkContext.setJobGroup("", "")
    assert written[2] == written[40]
