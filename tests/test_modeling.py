"""Preparation, selection and metrics."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright import modeling as M
from tablewright.modeling import Settings, candidates, selection
from tablewright.modeling.candidates import CLASSIFICATION, REGRESSION
from tablewright.suite.registry import table

QUICK = Settings(trees=5, rounds=3, tree_depth=4, forest_depth=4, iterations=50, margin_iterations=10)


@pytest.fixture(scope="module")
def staff(spark):
    """Pay from experience and schooling, with gaps and a text class that depends on pay."""
    rng = np.random.default_rng(42)
    levels = ["High School", "Bachelor", "Master", "PhD"]
    rows = []
    for i in range(240):
        years, level = float(np.round(rng.uniform(0, 35), 1)), int(rng.integers(0, 4))
        pay = 40000 + 2000 * years + 10000 * level + float(rng.normal(0, 2000))
        rows.append((i + 1, f"Employee_{i}", None if i % 15 == 0 else years, None if i % 20 == 1 else levels[level], i % 3 == 0,
                     pay, "high" if pay > 95000 else "mid" if pay > 70000 else "low", int(pay > 80000)))
    return spark.createDataFrame(
        rows, "emp_id int, name string, years double, level string, remote boolean, pay double, band string, well_paid int"
    )


def test_preparation(spark, staff):
    state = M.fit_features(staff, ["years", "remote"], ["level"])
    assert state.names() == ["years", "remote", "level_Bachelor", "level_High School", "level_Master", "level_PhD"]
    ready = M.feature_pipeline(staff, state)
    values = np.array([r["v"] for r in ready.transform(staff).select(vector_to_array("features").alias("v")).collect()])
    assert np.allclose(values[:, :2].mean(axis=0), 0, atol=1e-9) and np.allclose(values[:, :2].std(axis=0), 1)
    assert (values[:, 2:].sum(axis=1) == 1).all()
    odd = spark.createDataFrame([(None, "Doctor's \\ degree", None)], "years double, level string, remote boolean")
    assert list(ready.transform(odd).select(vector_to_array("features").alias("v")).first()["v"][2:]) == [0.0] * 4


def test_regression_recovers_pay(staff, spark):
    problem = M.prepare_problem(staff.drop("band", "well_paid"), "pay", key=["emp_id"])
    assert problem.task == "regression" and set(problem.features.pruned) == {"emp_id", "name"}
    model = M.fit_model(problem, "Linear Regression")
    assert model.meta["metrics"]["r2"] > 0.9
    names = [r["feature"] for r in model.feature_importance(spark).collect()]
    assert {"years", "level_PhD", "level_High School"} <= set(names[:5]) and len(names) == 6


def test_every_regressor_beats_the_mean(staff):
    problem = M.prepare_problem(staff.drop("band", "well_paid"), "pay", key=["emp_id"])
    board = M.compare_models(problem, folds=2, settings=QUICK).collect()
    assert {r["model"] for r in board} == set(REGRESSION)
    for row in board:
        assert row["failure"] is None and row["score"] > 0, row
    assert [r["score"] for r in board] == sorted((r["score"] for r in board), reverse=True)


@pytest.mark.parametrize("target", ["well_paid", "band"])
def test_every_classifier_beats_the_majority(staff, target):
    rows = staff.drop(*[c for c in ("pay", "band", "well_paid") if c != target])
    problem = M.prepare_problem(rows, target, key=["emp_id"])
    majority = rows.groupBy(target).count().agg(F.max("count") / F.sum("count")).first()[0]
    board = M.compare_models(problem, folds=2, settings=QUICK).collect()
    assert {r["model"] for r in board} == set(CLASSIFICATION)
    for row in board:
        assert row["failure"] is None and row["score"] > majority, row


def test_predictions_are_labels(staff, spark, tmp_path):
    rows = staff.drop("pay", "well_paid")
    for name in ("Random Forest", "K-Neighbors", "Gradient Boosting"):
        model = M.fit_model(M.prepare_problem(rows, "band", key=["emp_id"]), name, QUICK)
        scored = model.predict(rows)
        found = scored.collect()
        assert {r["prediction"] for r in found} <= {"high", "mid", "low"}
        assert all(abs(r["prob_high"] + r["prob_low"] + r["prob_mid"] - 1) < 1e-9 for r in found)
        model.save(spark, str(tmp_path / name))
        again = M.TrainedModel.load(spark, str(tmp_path / name)).predict(rows)
        assert {(r["emp_id"], r["prediction"]) for r in again.collect()} == {(r["emp_id"], r["prediction"]) for r in found}
        assert M.TrainedModel.load(spark, str(tmp_path / name)).meta["classes"] == ["high", "low", "mid"]


def test_numeric_classes_keep_their_values(spark):
    rows = spark.createDataFrame([(i, float(i % 7), 10 if i % 7 < 3 else 30) for i in range(140)], "id int, x double, t int")
    model = M.fit_model(M.prepare_problem(rows, "t", key=["id"]), "Decision Tree", QUICK)
    scored = model.predict(rows)
    assert scored.schema["prediction"].dataType.simpleString() == "int"
    assert scored.where("prediction = t").count() == 140
    assert model.meta["metrics"]["roc_auc"] == 1.0
    assert {"prob_10", "prob_30"} <= set(scored.columns)


def test_missing_targets_are_left_out(spark, staff):
    gaps = staff.withColumn("pay", F.when(F.col("emp_id") > 40, F.col("pay"))).drop("band", "well_paid")
    assert M.prepare_problem(gaps, "pay", key=["emp_id"]).data.count() == 200


def test_failures_carry_a_reason(staff, monkeypatch):
    from tablewright.modeling import candidates

    def broken(settings, facts):
        raise RuntimeError("no such solver")

    monkeypatch.setitem(candidates.REGRESSION, "Lasso Regression", broken)
    problem = M.prepare_problem(staff.drop("band", "well_paid"), "pay", key=["emp_id"])
    board = M.compare_models(problem, 2, QUICK, models=["Linear Regression", "Lasso Regression"]).collect()
    assert board[-1]["score"] is None and "no such solver" in board[-1]["failure"]
    with pytest.raises(ValueError, match="no such solver"):
        M.train_best(staff.drop("band", "well_paid"), "pay", key=["emp_id"], folds=2, settings=QUICK, models=["Lasso Regression"])


def test_folds_partition_the_rows(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    placed = M.stratified_kfold(rows, "o_orderstatus", 4, ["o_orderkey"])
    sizes = {(r["o_orderstatus"], r["fold"]): r["count"] for r in placed.groupBy("o_orderstatus", "fold").count().collect()}
    assert sum(sizes.values()) == rows.count()
    for status in ("F", "O", "P"):
        per_fold = [sizes[status, f] for f in range(4)]
        assert max(per_fold) - min(per_fold) <= 1
    again = M.stratified_kfold(rows.repartition(3), "o_orderstatus", 4, ["o_orderkey"])
    assert placed.exceptAll(again).count() == 0


def test_a_class_of_one_row(spark):
    rows = spark.createDataFrame([(i, "rare" if i == 0 else "common") for i in range(50)], "id int, c string")
    split = M.stratified_train_test(rows, "c", 0.2, ["id"])
    assert split.where("is_test").count() == 10 and split.where("is_test AND c = 'rare'").count() == 0


def test_auc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([(1, .9), (0, .9), (1, .4), (0, .1), (0, .4)], "label int, score double")
    assert M.roc_auc(rows).first()["roc_auc"] == pytest.approx((0.5 + 2 + 0.5 + 1) / 6)
    assert M.roc_auc(rows.where("label = 1")).first()["roc_auc"] is None


def test_undefined_precision_counts_as_zero(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (2.0, 1.0)], "label double, prediction double")
    found = M.classification_metrics(rows).first()
    assert found["accuracy"] == pytest.approx(1 / 3) and found["precision"] == pytest.approx(1 / 9)
    assert found["f1"] == pytest.approx(0.5 / 3)


@pytest.mark.parametrize("whole", [False, True])
def test_held_rows_are_dealt_to_partitions(spark, staff, monkeypatch, whole):
    """A table from one row group, with rows that come twice, doesn't stay one task's."""
    from tablewright.modeling import selection

    seen, held = [], selection._held

    def watched(*frames):
        seen.extend(frames[0].groupBy(F.spark_partition_id()).count().collect())
        return held(*frames)

    monkeypatch.setattr(selection, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(selection, "_held", watched)
    rows = staff.union(staff.limit(60)).select("emp_id", "years", "level", "pay").coalesce(1)
    problem = M.prepare_problem(rows, "pay", key=["emp_id"])
    if whole:
        M.compare_models(problem, folds=2, settings=QUICK, models=["Linear Regression"])
    else:
        M.fit_model(problem, "Linear Regression", QUICK)
    assert max(r["count"] for r in seen) <= 110 and sum(r["count"] for r in seen[:3]) == 300


@pytest.mark.parametrize("rows", [30, 300])
def test_tables_of_every_size_are_dealt_alike(spark, monkeypatch, rows):
    """However its rows lie, a held table is put in the order of its hashes, below and above the size of a partition."""
    monkeypatch.setattr(selection, "PART_ROWS", 100)
    df = spark.range(rows).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    for parts in (1, 5):
        dealt = selection._spread(df.repartition(parts), rows)
        assert dealt.rdd.getNumPartitions() == max(1, rows // 100)
        own = dealt.select(F.spark_partition_id().alias("p"), F.xxhash64("a", "b").alias("h")).collect()
        assert own == sorted(own, key=lambda r: (r["p"], r["h"]))


def test_folds_are_compared_side_by_side(spark, monkeypatch):
    """Folds held at once or one after another give the same board; a candidate that fails is tried on no later fold."""
    df = spark.createDataFrame([(i, float(i % 17), float(i % 5), float(i % 17 * 2 + i % 5)) for i in range(300)], "id long, a double, b double, y double")
    problem = M.prepare_problem(df, "y", "regression", key=["id"], features=["a", "b"])
    tried = []

    class Fails:
        def __init__(self, estimator, facts):
            self.estimator, self.facts = estimator, facts

        def fit(self, train):
            tried.append(self.facts.rows)
            raise ValueError("never fits")

    monkeypatch.setitem(candidates.REGRESSION, "Lasso Regression", lambda s, f: Fails(None, f))
    names, boards = ["Linear Regression", "Decision Tree", "Lasso Regression"], []
    for held in (10**6, 1):
        monkeypatch.setattr(selection, "HELD_ROWS", held)
        boards.append([tuple(r) for r in M.compare_models(problem, 3, models=names).collect()])
    assert boards[0] == boards[1] and boards[0][-1] == ("Lasso Regression", None, 0, "ValueError: never fits")
    assert all(score > 0.9 and folds == 3 for _, score, folds, failure in boards[0] if failure is None)
    assert 2 <= len(tried) <= 4
