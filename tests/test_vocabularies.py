"""Columns and targets whose values live in a table of the shared folder instead of the driver."""

import shutil

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright import modeling as M
from tablewright.functions import vocabularies
from tablewright.modeling.candidates import Settings

QUICK = Settings(trees=3, rounds=2)


@pytest.fixture
def goods(spark):
    rows = [(i, float(i % 7), f"kind {i % 11}", None if i % 13 == 0 else f"o'{i % 5}\\ü", (i % 11) * 2.0 + i % 7) for i in range(200)]
    return spark.createDataFrame(rows, "id long, size double, kind string, maker string, price double")


def features(ready, df):
    return {r["id"]: (r["v"]) for r in ready.transform(df).select("id", vector_to_array("features").alias("v")).collect()}


def test_joined_vectors_equal_listed_ones(spark, goods):
    listed = M.fit_features(goods, ["size"], ["kind", "maker"])
    joined = M.fit_features(goods, ["size"], ["kind", "maker"], most_listed=0)
    assert not listed.tables and not joined.categories and joined.width() == listed.width() == len(joined.names())
    new = goods.union(spark.createDataFrame([(900, None, "unseen", None, 0.0)], goods.schema))
    assert features(M.feature_pipeline(goods, joined), new) == features(M.feature_pipeline(goods, listed), new)
    named = [r["feature"] for r in M.feature_names(spark, joined).orderBy("position").collect()]
    assert named == listed.names()


def test_no_value_is_in_the_plan(goods):
    """The driver and the plan hold neither list nor metadata of a joined column's values."""
    joined = M.fit_features(goods, ["size"], ["kind", "maker"], most_listed=0)
    ready = M.feature_pipeline(goods, joined).transform(goods.drop("maker").withColumn("maker", F.lit("x")))
    plan = ready._jdf.queryExecution().toString()
    assert "kind 7" not in plan and "LEFT JOIN" not in plan and "LeftOuter" in plan
    assert not ready.schema["features"].metadata


def test_models_keep_their_tables(spark, goods, monkeypatch, tmp_path):
    monkeypatch.setattr(vocabularies, "LIST_VALUES", 3)
    problem = M.prepare_problem(goods, "price", task="regression", key=["id"], features=["size", "kind", "maker"])
    model = M.fit_model(problem, "Ridge Regression", QUICK)
    assert model.meta["metrics"]["r2"] > 0.9 and len(model.meta["vocabularies"]) == 2
    scored = {r["id"]: r["prediction"] for r in model.predict(goods).collect()}
    model.save(spark, str(tmp_path / "model"))
    shutil.copytree(tmp_path / "model", tmp_path / "copy")
    back = M.TrainedModel.load(spark, str(tmp_path / "copy"))
    assert all(str(tmp_path / "copy") in v["path"] for v in back.meta["vocabularies"])
    assert {r["id"]: r["prediction"] for r in back.predict(goods).collect()} == scored
    back.save(spark, str(tmp_path / "copy"))


def test_many_classes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vocabularies, "LIST_VALUES", 3)
    df = spark.range(120).select("id", (F.col("id") % 12 * 10).alias("kind"), (F.col("id") % 12 * 1.0).alias("x"), F.rand(1).alias("y"))
    problem = M.prepare_problem(df, "kind", task="classification", key=["id"], features=["x"])
    assert M.class_count(problem.classes) == 12 and isinstance(problem.classes, dict)
    model = M.fit_model(problem, "K-Neighbors", QUICK)
    model.save(spark, str(tmp_path / "model"))
    for made in (model, M.TrainedModel.load(spark, str(tmp_path / "model"))):
        rows = made.predict(df).collect()
        assert rows[0]["prediction"] is not None and not any(c.startswith("prob_") for c in rows[0].asDict())
        assert sum(r["prediction"] == r["kind"] for r in rows) > 100


def test_codes_of_numbers_and_gaps(spark):
    df = spark.createDataFrame([(10,), (9,), (100,), (None,), (9,)], "n int")
    for most in (0, 10):
        classes = M.target_vocabulary(df, "n", most_listed=most)
        coded = M.label_codes(df, "n", classes)
        back = M.decode_labels(coded, "label", classes, "back", "int").collect()
        assert {(r["n"], r["label"], r["back"]) for r in back} == {(9, 0.0, 9), (10, 1.0, 10), (100, 2.0, 100), (None, None, None)}
    assert M.target_vocabulary(df.limit(0), "n", most_listed=0) == []
