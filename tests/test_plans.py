"""Chains, replay, advice and the workspace on the given tables."""

import pytest
from pyspark.sql import functions as F

from tablewright import FittedPlan, TableSource, Workspace, apply_operations, standard_chain
from tablewright import analysis as A
from tablewright.modeling import Settings
from tablewright.plans import validate_specs
from tablewright.session import scratch_path
from tablewright.suite.registry import customer_ids, orders_gaps, table


def test_replay_equals_training_output(spark, sf):
    rows = orders_gaps(spark, sf)
    plan = FittedPlan.fit(rows, [
        {"op": "fillna", "method": "mode", "columns": ["o_orderpriority"]},
        {"op": "fillna", "method": "mean"},
        {"op": "create_bins", "column": "o_totalprice", "bins": 4},
        {"op": "encode_categorical", "method": "onehot", "columns": ["o_orderstatus"]},
        {"op": "scale_numeric", "method": "minmax", "columns": ["o_custkey"]},
    ])
    applied, replayed = plan.apply(rows), plan.replay(rows)
    assert applied.columns == replayed.columns
    assert applied.exceptAll(replayed).count() == 0


def test_bins_keep_their_training_edges(spark):
    train = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    plan = FittedPlan.fit(train, [{"op": "create_bins", "column": "x", "bins": 2, "new_column": "b", "output": "index"}])
    new = spark.createDataFrame([(5.0,), (6.0,), (40.0,)], "x double")
    assert [r["b"] for r in plan.replay(new).orderBy("x").collect()] == [0, 1, None]


def test_replay_passes_over_absent_columns(spark, sf):
    plan = FittedPlan.fit(table(spark, sf, "part"), [
        {"op": "drop_columns", "columns": ["p_name", "p_retailprice"]},
        {"op": "create_ratio", "numerator": "p_size", "denominator": "p_partkey", "new_column": "r"},
        {"op": "filter_rows", "condition": "p_size > 10"},
    ])
    new = table(spark, sf, "part").drop("p_retailprice", "p_partkey")
    assert plan.replay(new).columns == ["p_brand", "p_type", "p_size"]
    assert plan.replay(new).count() == new.count()


def test_saved_plans_with_large_vocabularies(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    plan = FittedPlan.fit(rows, [{"op": "encode_categorical", "method": "label", "max_literals": 0}])
    path = scratch_path(spark, "plan")
    plan.save(spark, path)
    again = FittedPlan.load(spark, path)
    assert again.apply(rows).exceptAll(plan.apply(rows)).count() == 0
    assert all(t["path"].startswith(path) for _, s in again.steps for t in s["tables"].values())


def test_target_is_guarded():
    for spec in ({"op": "drop_columns", "columns": ["a", "t"]}, {"op": "create_bins", "column": "t", "bins": 3}):
        with pytest.raises(ValueError, match="target"):
            validate_specs([spec], "t")
    assert validate_specs([{"op": "scale_numeric", "columns": ["a", "t"], "exclude": ["t"]}], "t")


def test_standard_order():
    chain = standard_chain(
        target="y", bins=("a", 3), head=5, scale="standard", dropna=True, encode="label", fillna="constant", fillna_value=1,
        drop_columns=["b"], keep_columns=["a"], drop_duplicates=True, filter="a > 1", sample=9, ratio=("a", "b", "r"),
        product=("a", "b", "p"), difference=("a", "b", "d"),
    )
    assert [s["op"] for s in chain] == [
        "dropna", "fillna", "drop_columns", "keep_columns", "drop_duplicates", "filter_rows", "scale_numeric",
        "encode_categorical", "sample_rows", "head_rows", "create_ratio", "create_product", "create_difference", "create_bins",
    ]
    assert chain[6]["exclude"] == ["y"]
    with pytest.raises(ValueError):
        standard_chain(fillna="constant")


def test_standard_chain_runs(spark, sf):
    chain = standard_chain(
        target="o_totalprice", dropna=True, scale="minmax", encode="label", head=20, bins=("o_custkey", 3), order=["o_orderkey"]
    )
    done = apply_operations(table(spark, sf, "orders"), chain)
    assert done.count() == 20 and "o_custkey_binned" in done.columns


# -- advice ------------------------------------------------------------------------


def test_task_rules(spark):
    def task(values, kind):
        return A.detect_task_type(spark.createDataFrame([(v,) for v in values], f"t {kind}"), "t")

    assert task(["a", "b"], "string") == "classification"
    assert task([float(i % 10) for i in range(100)], "double") == "classification"
    assert task([float(i) for i in range(11)], "double") == "regression"
    assert task(range(11), "int") == "regression"                    # dense
    assert task([i * 100 for i in range(11)], "int") == "classification"   # sparse
    assert task([i * 100 for i in range(51)], "int") == "regression"       # too many values
    assert A.detect_task_type(spark.createDataFrame([(1,)], "t int"), "t", "regression") == "regression"


def test_key_like_columns(spark):
    rows = [(i + 1, i + 1, i, 1, f"n{i}", None) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id int, place int, shifted_id int, k int, name string, empty double")
    reasons = A.prune_columns(A.column_traits(df))
    assert reasons == {"row_id": "sequential id", "k": "constant", "name": "unique text", "empty": "constant"}


def test_no_target_left(spark):
    with pytest.raises(ValueError, match="varies enough"):
        A.suggest_target(spark.createDataFrame([(1, f"t{i}") for i in range(20)], "k int, t string"))
    few = A.suggest_target(spark.createDataFrame([(1, f"t{i % 3}") for i in range(20)], "k int, t string"))
    assert few["target_column"] == "t" and few["task_type"] == "classification"


def test_suggestions_with_gaps(spark, sf):
    chain = A.suggest_preprocessing(orders_gaps(spark, sf), "o_custkey")
    assert {"op": "fillna", "method": "median"} in chain
    assert chain[-1] == {"op": "scale_numeric", "method": "standard", "exclude": ["o_custkey"]}
    assert {"op": "fillna", "method": "mean"} in A.suggest_preprocessing(orders_gaps(spark, sf))


# -- workspace ---------------------------------------------------------------------


def test_walk_through(spark, sf, tmp_path):
    work = Workspace(
        TableSource.from_parquet(spark, sf, ["customer", "orders", "nation", "part"]), cv_folds=2,
        settings=Settings(trees=3, rounds=2, tree_depth=4, forest_depth=4, iterations=20, margin_iterations=5),
    )
    assert work.list_tables() == ["customer", "nation", "orders", "part"]
    assert {r["table_name"]: r["row_count"] for r in work.get_table_summary().collect()}["nation"] == 25
    with pytest.raises(RuntimeError):
        work.apply_preprocessing([])
    with pytest.raises(RuntimeError):
        work.predict({})
    work.load_query_as_data("SELECT p_partkey + 1 AS part_id, p_brand, p_type, p_size, p_retailprice FROM part")
    work.apply_preprocessing([{"op": "filter_rows", "condition": "p_size < 45"}, {"op": "drop_columns", "columns": ["p_brand"]}])
    steps = work.get_preprocessing_summary().collect()
    assert [s["operation"] for s in steps] == ["filter_rows", "drop_columns"] and steps[0]["rows_out"] < steps[0]["rows_in"]
    assert work.analyze("p_retailprice").where("section = 'target'").count() > 0
    assert work.analyze(analysis_type="correlations").count() == 9
    assert len(work.analyze("p_type", "target")) == 2
    with pytest.raises(ValueError):
        work.analyze(analysis_type="horoscope")
    board = work.train("p_retailprice", key=["part_id"], models=["Linear Regression", "Decision Tree"]).collect()
    assert {r["model"] for r in board} == {"Linear Regression", "Decision Tree"} and board[0]["score"] >= board[1]["score"]
    scored = work.predict([{"part_id": 3, "p_type": "SMALL", "p_size": 7}, {"part_id": 4, "p_type": "new", "p_size": None}])
    assert scored.where("prediction IS NOT NULL").count() == 2
    work.save_model(str(tmp_path / "model"))
    other = Workspace(work.source)
    other.load_model(str(tmp_path / "model"))
    again = other.predict(work.data).select("part_id", "prediction")
    assert again.exceptAll(work.predict(work.data).select("part_id", "prediction")).count() == 0
    folder = work.save_dataset(str(tmp_path / "out"), include_original_tables=True)
    assert sorted(Workspace.open(spark, folder).list_tables()) == ["customer", "nation", "orders", "part", "preprocessed_data"]


def test_nothing_left_to_learn_from(spark, sf):
    from tablewright.modeling import prepare_problem

    with pytest.raises(ValueError, match="pruned"):
        prepare_problem(customer_ids(spark, sf).select("customer_id", "channel", "c_acctbal"), "c_acctbal")
    with pytest.raises(ValueError, match="has no column"):
        prepare_problem(customer_ids(spark, sf), "nope")


def test_row_counts_of_steps(spark, sf):
    rows = table(spark, sf, "orders")
    plan = FittedPlan.fit(rows, [{"op": "dropna"}, {"op": "drop_duplicates", "subset": ["o_custkey"], "order": ["o_orderkey"]}])
    found = plan.lineage(rows).collect()
    assert found[0]["rows_in"] == rows.count()
    assert found[1]["rows_out"] == rows.select("o_custkey").distinct().count()
    assert rows.where(F.lit(True)).count() == found[0]["rows_out"]
