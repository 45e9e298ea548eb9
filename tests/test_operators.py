"""Operations against pandas on small frames with gaps, ties and constants."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.operators import (
    ConvertDtype, CreateBins, CreateRatio, DropColumns, DropDuplicates, DropNa, EncodeCategorical, FillNa, HeadRows,
    KeepColumns, SampleRows, ScaleNumeric, make_operation,
)
from tablewright.operators.derive import bin_edges, bin_labels

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "id bigint, x double, y double, g string"


@pytest.fixture(scope="module")
def frame():
    return pd.DataFrame({
        "id": range(8),
        "x": [1.0, None, 3.0, 3.0, 10.0, None, -2.0, 0.0],
        "y": [0.0, 2.0, None, 4.0, 0.0, 1.0, 5.0, 0.5],
        "g": ["b", "a", None, "b", "c", "a", "a", None],
    })


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [[None if pd.isna(v) else v for v in r] for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("id").select(name).collect()]


def same(got, wanted):
    wanted = [None if pd.isna(v) else v for v in wanted]
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.mark.parametrize("method", ["mean", "median"])
def test_statistic_fill(df, frame, method):
    filled = FillNa(method=method)(df)
    same(column(filled, "x"), frame["x"].fillna(getattr(frame["x"], method)()))
    assert column(filled, "g") == column(df, "g")


def test_mode_fill_takes_the_smallest_of_ties(df, frame):
    same(column(FillNa(method="mode")(df), "x"), frame["x"].fillna(frame["x"].mode()[0]))
    same(column(FillNa(method="mode", columns=["g"])(df), "g"), frame["g"].fillna(frame["g"].mode()[0]))


def test_ordered_fills(df, frame):
    for method in ("ffill", "bfill"):
        same(column(FillNa(method=method, order=["id"], columns=["x"])(df), "x"), getattr(frame["x"], method)())


def test_fill_needs_sense(df):
    with pytest.raises(ValueError, match="method is one of"):
        FillNa(method="magic")
    with pytest.raises(ValueError, match="order"):
        FillNa(method="ffill")
    with pytest.raises(ValueError, match="value"):
        FillNa(method="constant")


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0)], "id bigint, x double")
    same(column(FillNa()(df), "x"), [1.0, 2.0, 3.0])
    assert DropNa()(df).count() == 2


def test_dropna(df, frame):
    assert DropNa()(df).count() == len(frame.dropna())
    assert DropNa(subset=["x", "g"], how="all")(df).count() == len(frame.dropna(subset=["x", "g"], how="all"))


def test_unknown_columns_raise(df):
    for op in (DropColumns(["x", "nope"]), KeepColumns(["nope"]), CreateRatio("x", "nope", "r"), ConvertDtype("nope", "int")):
        with pytest.raises(ValueError, match="has no columns"):
            op(df)


def test_keep_columns_keeps_the_order(df):
    assert KeepColumns(["g", "id"])(df).columns == ["g", "id"]


@pytest.mark.parametrize("method", ["standard", "minmax"])
def test_scaling(df, frame, method):
    x = frame["x"]
    wanted = (x - x.mean()) / x.std(ddof=0) if method == "standard" else (x - x.min()) / (x.max() - x.min())
    same(column(ScaleNumeric(method, ["x"])(df), "x"), wanted)
    flat = df.withColumn("k", F.lit(7.0))
    assert set(column(ScaleNumeric(method, ["k"])(flat), "k")) == {0.0}
    assert column(ScaleNumeric(method, exclude=["y", "id"])(df), "y") == column(df, "y")
    with pytest.raises(ValueError, match="method is standard"):
        ScaleNumeric("robust")


def test_label_codes(df):
    assert column(EncodeCategorical("label")(df), "g") == [1, 0, None, 1, 2, 0, 0, None]
    assert column(EncodeCategorical("label", missing_as="None")(df), "g") == [2, 1, 0, 2, 3, 1, 1, 0]
    # a vocabulary too large for literals is ranked in slices and joined from a written table
    assert column(EncodeCategorical("label", max_literals=0)(df), "g") == [1, 0, None, 1, 2, 0, 0, None]
    with pytest.raises(ValueError, match="method is label"):
        EncodeCategorical("target")


def test_one_hot_columns(df, frame):
    made = EncodeCategorical("onehot", ["g"])(df)
    wanted = pd.get_dummies(frame, columns=["g"])
    assert made.columns == list(wanted.columns)
    for name in ("g_a", "g_b", "g_c"):
        assert column(made, name) == list(wanted[name])
    with pytest.raises(ValueError, match="one-hot"):
        EncodeCategorical("onehot", ["g"], max_width=2)(df)


def test_unseen_values(spark, df):
    op = EncodeCategorical("label", ["g"])
    new = spark.createDataFrame([(1, "zzz"), (2, "a")], "id bigint, g string")
    assert column(op.apply(new, op.fit(df)), "g") == [-1, 0]


def test_ratio_by_zero_is_missing(df, frame):
    same(column(CreateRatio("x", "y", "r")(df), "r"), frame["x"] / frame["y"].replace(0, np.nan))


def test_conversions(spark):
    df = spark.createDataFrame([(1, "12"), (2, " 7"), (3, "x")], "id bigint, t string")
    assert column(ConvertDtype("t", "int", on_error="null")(df), "t") == [12, 7, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ConvertDtype("t", "int")(df).collect()
    with pytest.raises(ValueError, match="Unknown type name"):
        ConvertDtype("t", "complex")


@QUICK
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30), st.integers(1, 7))
def test_bins_are_those_of_cut(spark, values, bins):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, x double")
    wanted = pd.cut(pd.Series(values), bins=bins, labels=False)
    assert column(CreateBins("x", bins, "b", output="index")(df), "b") == list(wanted)


def test_bin_labels_read_like_intervals(spark):
    values = pd.Series([1.0, 7.0, 5.0, 4.0, 6.0, 3.0])
    cut = pd.cut(values, bins=3)
    lo, hi = values.min(), values.max()
    assert bin_labels(bin_edges(lo, hi, 3)) == [str(c) for c in cut.cat.categories]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, x double")
    assert column(CreateBins("x", 3)(df), "x_binned") == [str(c) for c in cut]
    assert column(CreateBins("x", 3, output="interval")(df), "x_binned")[1]["hi"] == 7.0


def test_first_duplicate_is_kept(df):
    kept = DropDuplicates(["g"], order=["id"])(df)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 4]
    assert kept.columns == df.columns
    assert DropDuplicates()(df.union(df)).count() == 8


def test_samples_repeat_and_are_exact(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    first = {r["k"] for r in SampleRows(frac=0.1, key=["k"])(df).collect()}
    again = {r["k"] for r in SampleRows(frac=0.1, key=["k"])(df.repartition(7)).collect()}
    assert len(first) == 500 and first == again
    assert {r["k"] for r in SampleRows(n=500, key=["k"], random_state=1)(df).collect()} != first
    assert SampleRows()(df).count() == 1
    with pytest.raises(ValueError):
        SampleRows(n=1, frac=0.5)


def test_large_head_is_selected_in_slices(spark, monkeypatch):
    from tablewright.functions import ordering

    monkeypatch.setattr(ordering, "TOP_K_ROWS", 10)
    df = spark.range(3000).withColumn("v", (F.col("id") * 7919) % 3001)
    wanted = sorted(range(3000), key=lambda i: (i * 7919) % 3001)[:1234]
    assert sorted(r["id"] for r in HeadRows(1234, ["v"])(df).collect()) == sorted(wanted)
    assert SampleRows(n=1234, key=["id"])(df).count() == 1234


def test_closed_registry():
    for bad in ({"op": "reset"}, {"op": "get_data"}, {"nothing": 1}):
        with pytest.raises(ValueError, match="no operation is called"):
            make_operation(bad)
    with pytest.raises(ValueError, match="Unknown parameters"):
        make_operation({"op": "head_rows", "size": 3})
