"""Extremely randomised trees, the kernel machine and the booster of several classes."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablewright import modeling as M
from tablewright.modeling import kernel
from tablewright.modeling.candidates import Settings, TrainingFacts, coefficients, pool_of
from tablewright.modeling.kernel import FourierFeatures, KernelClassifier
from tablewright.modeling.random_trees import ExtraTrees, RandomCuts
from tablewright.modeling.softmax_trees import SoftmaxBoosting, SoftmaxModel

QUICK = Settings(trees=10, rounds=2, forest_depth=8, margin_iterations=20)


def assembled(spark, points, names="xy"):
    df = spark.createDataFrame(points, ", ".join(f"{c} double" for c in [*names, "label"]))
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df)


@pytest.fixture(scope="module")
def ring(spark):
    """A disc inside a ring, and a wider ring for a third class."""
    rng, points = random.Random(5), []
    for i in range(600):
        angle, label = rng.uniform(0, 2 * math.pi), i % 3
        radius = (0.4, 1.2, 2.2)[label] + rng.uniform(-0.2, 0.2)
        points.append((radius * math.cos(angle), radius * math.sin(angle), float(label)))
    return assembled(spark, points)


@pytest.mark.parametrize("classes", [2, 3])
def test_rings_are_separated(ring, classes):
    rows = ring.where(F.col("label") < classes)
    scored = KernelClassifier(classes, 20, 1e-4).fit(rows).transform(rows)
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.97
    for r in scored.select("prediction", "probability").collect():
        assert abs(sum(r["probability"]) - 1) < 1e-9 and max(r["probability"]) == r["probability"][int(r["prediction"])]


def test_a_linear_machine_does_not_separate_them(ring, monkeypatch):
    monkeypatch.setattr(kernel, "MOST_FEATURES", 1)
    rows = ring.where(F.col("label") < 2)
    scored = KernelClassifier(2, 20, 1e-4).fit(rows).transform(rows)
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] < 0.8


def test_probabilities_match_frequencies(spark):
    """Where a third of the rows of one place are of class 1, its share is about a third."""
    rows = assembled(spark, [(float(i % 2), 0.0, float(i % 3 == 0) if i % 2 else 0.0) for i in range(1200)])
    scored = KernelClassifier(2, 20, 1e-3, width=32).fit(rows).transform(rows)
    found = {r["x"]: r["p"] for r in scored.groupBy("x").agg(F.avg(F.get("probability", F.lit(1))).alias("p")).collect()}
    assert abs(found[1.0] - 1 / 3) < 0.05 and found[0.0] < 0.05


def test_features_have_the_kernel_as_mean_product(spark):
    points = [(0.0, 0.0, 0.0), (0.5, -0.3, 0.0), (2.0, 1.0, 0.0)]
    lifted = FourierFeatures(0.7, 2, 20_000).transform(assembled(spark, points)).select("x", "y", vector_to_array("__lifted").alias("z")).collect()
    for a in lifted:
        for b in lifted:
            wanted = math.exp(-0.7 * ((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2))
            assert abs(float(np.dot(a["z"], b["z"])) - wanted) < 0.03


def test_bins_count_the_thresholds_below(spark):
    cutter = RandomCuts([0.0, 10.0, 1.0, 20.0, -1.0, 15.0, 5.0, 5.0], copies=2, cuts=2)
    rows = cutter.transform(assembled(spark, [(0.5, 15.0, 0.0), (9.0, -3.0, 0.0)])).select(vector_to_array("__bins").alias("b")).collect()
    assert [r["b"] for r in rows] == [[1.0, 1.0, 1.0, 1.0], [2.0, 0.0, 2.0, 0.0]]


def test_extra_trees_learn_and_rank_features(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-3, 3), rng.gauss(0, 1)) for _ in range(800)]
    rows = assembled(spark, [(x, y, math.sin(x) * 3) for x, y in points])
    model = ExtraTrees(RandomForestRegressor(numTrees=10, maxDepth=8), lambda n: n).fit(rows)
    error = model.transform(rows).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    assert error < 0.5
    ranks = coefficients(model)
    assert len(ranks) == 2 and abs(sum(ranks) - 1) < 1e-9 and ranks[0] > 0.8
    other = ExtraTrees(RandomForestRegressor(numTrees=10, maxDepth=8), lambda n: n, seed=7).fit(rows)
    assert other.stages[0].getOrDefault("thresholds") != model.stages[0].getOrDefault("thresholds")
    with pytest.raises(ValueError):
        ExtraTrees(RandomForestRegressor(), lambda n: n).fit(rows.limit(0))


@pytest.mark.parametrize("name", ["Extra Trees", "Kernel SVC"])
def test_saved_and_loaded(spark, ring, tmp_path, name):
    df = ring.select("x", "y", F.col("label").cast("int").alias("kind")).withColumn("id", F.monotonically_increasing_id())
    model = M.fit_model(M.prepare_problem(df, "kind", key=["id"], features=["x", "y"]), name, QUICK)
    assert model.meta["metrics"]["accuracy"] > 0.9
    model.save(spark, str(tmp_path / "m"))
    columns = ["id", "prediction", "prob_0", "prob_2"]
    before = {r["id"]: tuple(r) for r in model.predict(df).select(columns).collect()}
    back = M.TrainedModel.load(spark, str(tmp_path / "m"))
    assert {r["id"]: tuple(r) for r in back.predict(df).select(columns).collect()} == before
    assert (back.feature_importance(spark) is None) == (name == "Kernel SVC")


def plain_softmax_round(rows, classes, step=0.1):
    """Shares after one round of depth one on one yes/no feature, row by row."""
    first = [np.log(sum(y == k for _, y in rows) / len(rows)) for k in range(classes)]
    shares = np.exp(first)
    scores = {x: np.array(first) for x, _ in rows}
    for x in scores:
        for k in range(classes):
            r = np.array([(y == k) - shares[k] for v, y in rows if v == x])
            scores[x][k] += step * (classes - 1) / classes * r.sum() / (abs(r) * (1 - abs(r))).sum()
    return {x: np.exp(s) / np.exp(s).sum() for x, s in scores.items()}


def test_softmax_round_is_the_closed_form(spark):
    rows = [(float(i % 2), (i // 2 % 3) if i % 2 else (i % 5 > 2) * 2) for i in range(90)]
    df = spark.createDataFrame([(x, float(y)) for x, y in rows], "x double, label double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = SoftmaxBoosting(3, rounds=1, depth=1).fit(df)
    wanted = plain_softmax_round(rows, 3)
    for r in model.transform(df).select("x", "probability", "prediction").distinct().collect():
        assert np.allclose(r["probability"], wanted[r["x"]])
        assert r["prediction"] == np.argmax(wanted[r["x"]])
    assert model.featureImportances.toArray().tolist() == [1.0]


def test_softmax_trees_learn_corners_and_survive_saving(spark, tmp_path):
    """Four corners of a square, two of them one class: no single cut tells them apart. More rounds than
    are kept unwritten."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float([[0, 1], [2, 0]][int(a > 0)][int(b > 0)])) for a, b in rng.uniform(-1, 1, (400, 2))]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    model = SoftmaxBoosting(3, rounds=12, step=0.5, depth=2).fit(df)
    scored = model.transform(df).cache()
    assert scored.where("label = prediction").count() > 380
    assert scored.where("abs(aggregate(probability, 0D, (a, x) -> a + x) - 1) > 1e-9").count() == 0
    model.save(str(tmp_path / "model"))
    again = SoftmaxModel.load(str(tmp_path / "model")).transform(df)
    assert again.select("probability").exceptAll(scored.select("probability")).count() == 0


def test_softmax_of_constant_features_gives_the_class_shares(spark):
    df = spark.createDataFrame([(1.0, float(y)) for y in (0, 0, 1, 2)], "x double, label double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    got = SoftmaxBoosting(3, rounds=1, depth=2).fit(df).transform(df).first()["probability"]
    assert np.allclose(got, [0.5, 0.25, 0.25])
    with pytest.raises(ValueError):
        SoftmaxBoosting(3, rounds=1).fit(df.limit(0))


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_levels_of_forests_are_not_sent_the_trees(task):
    """Each forest keeps the nodes of its rows; without that a level's tasks hold all trees grown so far."""
    pool, facts = pool_of(task, others=True), TrainingFacts(100, 1.0, 2, 3)
    for name in ("Random Forest", "Extra Trees", "Unbagged Forest"):
        made = pool[name](Settings(), facts)
        assert getattr(made, "forest", made).getCacheNodeIds(), name


def test_the_kernel_machine_reads_its_rows_in_many_partitions(ring, monkeypatch):
    """However few partitions the table has, one holds a bounded number of rows while it is lifted; predictions stay."""
    whole = KernelClassifier(2, 20, 1e-4)
    few, seen = ring.where("label < 2").coalesce(1), []
    expected = whole.fit(few).transform(few).select("label", "prediction").collect()
    lift = FourierFeatures._transform
    monkeypatch.setattr(FourierFeatures, "_transform", lambda self, df: seen.append(df.rdd.getNumPartitions()) or lift(self, df))
    monkeypatch.setattr(kernel, "LIFT_ROWS", 64)
    dealt = whole.fit(few)
    assert seen == [7]
    agree = sum(a == b for a, b in zip(expected, dealt.transform(few).select("label", "prediction").collect()))
    assert agree >= 0.98 * len(expected)


def test_wide_vectors_keep_the_kernel(spark, monkeypatch):
    """Two classes that no linear machine separates, in one-hot vectors of more features than are lifted as a block."""
    assert kernel.MOST_FEATURES > 10**9
    monkeypatch.setattr(kernel, "DENSE", 8)
    rng, size, rows = random.Random(4), 40, []
    for i in range(400):
        a, b = rng.randrange(2), rng.randrange(2)
        rows.append((Vectors.sparse(size, {a: 3.0, 37 + b: 3.0}), float(a ^ b)))
    df = spark.createDataFrame(rows, ["features", "label"])
    scored = KernelClassifier(2, 50, 1e-4).fit(df).transform(df)
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.95


def test_entries_are_lifted_as_the_kernel_asks(spark, monkeypatch):
    """Mean products of vectors beyond the block are those of the Gaussian kernel, dense and sparse ones alike."""
    monkeypatch.setattr(kernel, "DENSE", 4)
    near = [{0: 0.5, 30: 1.0}, {0: 0.2, 30: 0.6, 49: -0.4}, {}, {2: 1.0, 17: 1.0}]
    rows = [(Vectors.sparse(50, v),) for v in near] + [(Vectors.dense([v.get(i, 0.0) for i in range(50)]),) for v in near]
    lifted = FourierFeatures(0.7, 50, 20_000).transform(spark.createDataFrame(rows, ["features"]))
    z = [r["z"] for r in lifted.select(vector_to_array("__lifted").alias("z")).collect()]
    for i, a in enumerate(near):
        assert np.allclose(z[i], z[i + 4])
        for j, b in enumerate(near):
            wanted = math.exp(-0.7 * sum((a.get(k, 0.0) - b.get(k, 0.0)) ** 2 for k in range(50)))
            assert abs(float(np.dot(z[i], z[j])) - wanted) < 0.03
