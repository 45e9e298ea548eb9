"""Ordinary tables that an operation must not stumble over."""

import pytest
from pyspark.sql import functions as F

from tablewright import analysis as A, modeling as M
from tablewright.modeling.candidates import Settings
from tablewright.operators import EncodeCategorical, FillNa
from tablewright.sources import read_csv
from tablewright.sources.catalog import unique_columns

NAN = float("nan")
QUICK = Settings(trees=3, rounds=3, tree_depth=3, forest_depth=3, iterations=20, margin_iterations=5)


def test_nan_is_not_carried_on(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None), (4, 2.0), (5, NAN)], "t int, v double")
    fill = lambda method: [r["v"] for r in FillNa(method=method, columns=["v"], order=["t"])(df).orderBy("t").collect()]
    assert fill("ffill") == [1.0, 1.0, 1.0, 2.0, 2.0]
    assert fill("bfill") == [1.0, 2.0, 2.0, 2.0, None]


def test_profiles_of_one_kind_of_column(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "x")], "p string, q string")
    numbers = spark.createDataFrame([(1, 2.0), (3, 4.0)], "p int, q double")
    assert A.describe(texts).count() == 0 and A.numeric_insights(texts).count() == 0
    assert A.categorical_insights(numbers).count() == 0
    assert A.target_correlations(spark.createDataFrame([(1.0,)], "p double"), "p").count() == 0
    assert A.summary_report(texts, "q").where("section = 'target'").count() == 1
    assert A.summary_report(numbers, "q").count() > 0
    assert A.describe(texts).columns == A.describe(numbers).columns
    assert A.numeric_insights(texts).columns == A.numeric_insights(numbers).columns
    assert A.categorical_insights(texts).columns == A.categorical_insights(numbers).columns


def test_keys_of_wide_ranged_integers(spark):
    df = spark.createDataFrame([(-2_000_000_000, -(1 << 62)), (2_000_000_000, 1 << 62)], "a int, b long")
    assert unique_columns(df) == ["a", "b"]


def test_mode_beside_an_array(spark):
    df = spark.createDataFrame([("x", [1]), (None, [2]), ("x", None)], "k string, v array<int>")
    assert [r["k"] for r in FillNa(method="mode")(df).collect()] == ["x"] * 3


def test_rows_that_differ_in_nested_columns_are_no_repeats(spark):
    df = spark.createDataFrame([(1, [1], {"a": 1}), (1, [2], {"a": 1}), (1, [1], {"a": 1}), (1, [1], {"a": 2})],
                               "k int, v array<int>, m map<string,int>")
    assert A.duplicate_rows(df).first()[0] == 1


def test_a_missing_csv_is_reported(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none.csv"))


def clashing(spark):
    return spark.range(80).select(
        F.col("id").alias("label"), (F.col("id") % 7).cast("double").alias("features"),
        (F.col("id") % 3).cast("string").alias("prediction"), (F.col("id") % 5).cast("double").alias("probability"),
        (F.col("id") % 2 * 2 + 1).cast("double").alias("rawPrediction"), F.col("id").alias("row_no"),
        F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("kind"),
    )


@pytest.mark.parametrize("target, name", [
    ("kind", "Logistic Regression"), ("label", "Linear Regression"), ("kind", "K-Neighbors"), ("prediction", "Linear SVC")])
def test_columns_named_like_model_columns(spark, target, name):
    df = clashing(spark)
    features = [c for c in df.columns if c not in (target, "row_no")]
    problem = M.prepare_problem(df, target, "regression" if target == "label" else "classification", key=["row_no"], features=features)
    model = M.fit_model(problem, name, QUICK)
    done = model.predict(df)
    assert done.count() == 80 and done.where("prediction IS NULL").count() == 0
    assert set(df.columns) <= set(done.columns)
    board = M.compare_models(problem, folds=2, settings=QUICK, models=[name]).first()
    assert board["failure"] is None


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("name", list(M.CLASSIFICATION))
def test_every_classifier_gives_shares(spark, name, classes):
    df = spark.range(90).select(
        (F.col("id") % classes).cast("string").alias("kind"),
        (F.col("id") % classes + F.rand(1)).alias("x"), F.rand(2).alias("y"), F.col("id").alias("key"))
    model = M.fit_model(M.prepare_problem(df, "kind", key=["key"], features=["x", "y"]), name, QUICK)
    shares = [f"prob_{c}" for c in range(classes)]
    for row in model.predict(df).collect():
        assert abs(sum(row[c] for c in shares) - 1) < 1e-9
        assert row[f"prob_{row['prediction']}"] == max(row[c] for c in shares)
    if classes == 2:
        assert model.meta["metrics"]["roc_auc"] > 0.9


def test_wide_text_features_and_one_hot(spark):
    df = spark.range(22_000).select(
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("code"), (F.col("id") % 2).cast("string").alias("half"),
        (F.col("id") * 1.0).alias("y"), F.col("id").alias("key"))
    wide = df.withColumn("code", F.concat(F.lit("v"), (F.col("key") % 21_000).cast("string")))
    state = M.fit_features(wide, [], ["code", "half"])
    assert len(state.names()) == 21_002
    first = M.feature_pipeline(wide, state).transform(wide).first()
    assert first["features"].size == 21_002 and first["features"].numNonzeros() == 2
    hot = EncodeCategorical("onehot", ["code"])(df.limit(1_001).select("code"))
    assert len(hot.columns) == 1_001
    with pytest.raises(ValueError):
        EncodeCategorical("onehot", ["code"], max_width=1_000)(df.limit(1_001).select("code"))
