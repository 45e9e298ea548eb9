"""Sliced windows and exact quantiles against pandas and numpy, with crowded keys and values."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import exact_quantiles, fill_in_order, number_rows, running_totals
from tablewright.functions import ordering
from tablewright.functions.hashing import hash_text, unit_hash
from tablewright.functions.ordering import cut_points, slice_of


@pytest.fixture(scope="module")
def rows():
    """A third of the rows share one key and one time; many values are missing."""
    rng = random.Random(5)
    made = []
    for i in range(3000):
        hot = rng.random() < 0.35
        made.append((i, "hot" if hot else f"k{rng.randrange(40)}", 500 if hot else rng.randrange(1000),
                     None if rng.random() < 0.6 else round(rng.uniform(-5, 5), 3)))
    return pd.DataFrame(made, columns=["id", "key", "t", "v"])


@pytest.fixture(scope="module")
def df(spark, rows):
    data = [[None if pd.isna(x) else x for x in r] for r in rows.itertuples(index=False)]
    return spark.createDataFrame(data, "id bigint, key string, t int, v double").repartition(5)


@pytest.mark.parametrize("by", [(), ("key",)])
@pytest.mark.parametrize("slices", [1, 4, 37])
def test_fills(df, rows, by, slices):
    ordered = rows.sort_values(["t", "id"])
    for forward in (True, False):
        source = ordered.groupby("key")["v"] if by else ordered["v"]
        wanted = source.ffill() if forward else source.bfill()
        got = fill_in_order(df, ["v"], ["t", "id"], by, forward, slices).toPandas().set_index("id")["v"].sort_index()
        pd.testing.assert_series_equal(got, wanted.sort_index(), check_names=False, check_index_type=False)


@pytest.mark.parametrize("by", [(), ("key",)])
def test_positions_and_totals(df, rows, by):
    ordered = rows.sort_values(["t", "id"])
    wanted = (ordered.groupby("key").cumcount() if by else pd.Series(range(len(ordered)), index=ordered.index)) + 1
    got = number_rows(df, ["t", "id"], by, slices=16).toPandas().set_index("id")["position"].sort_index()
    assert list(got) == list(wanted.sort_index())
    source = ordered.groupby("key")["t"] if by else ordered["t"]
    totals = running_totals(df, ["t", "id"], {"s": F.col("t")}, by, slices=16).toPandas().set_index("id")["s"].sort_index()
    assert list(totals) == list(source.cumsum().sort_index())


def test_crowded_values_are_spread(df):
    cuts = cut_points(df, ["t", "id"], 16)
    sizes = [r["count"] for r in df.groupBy(slice_of(["t", "id"], cuts).alias("s")).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 3000 / 4


def test_text_order(spark):
    words = [f"{'x' * 300}{i % 50:03d}" for i in range(500)] + [None, "", "é"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id bigint, w string")
    got = number_rows(df, ["w", "id"], slices=8).orderBy("position").collect()
    wanted = sorted(range(len(words)), key=lambda i: (words[i] is not None, (words[i] or "").encode(), i))
    assert [r["id"] for r in got] == wanted


def test_null_groups(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, "a", None)], "id bigint, g string, v double")
    got = {r["id"]: r["v"] for r in fill_in_order(df, ["v"], ["id"], ["g"], slices=2).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None}


@pytest.mark.parametrize("gather", [3, 50, 100_000])
def test_bracketed_quantiles(spark, gather):
    rng = np.random.default_rng(3)
    columns = {
        "smooth": rng.normal(size=4000), "few": rng.integers(0, 4, 4000).astype(float),
        "crowded": np.where(rng.random(4000) < 0.4, 7.0, rng.exponential(size=4000)),
        "wide": rng.normal(size=4000) * 10.0 ** rng.integers(-200, 200, 4000),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).withColumn(
        "gaps", F.when(F.col("smooth") > 0, F.col("smooth"))
    ).withColumn("empty", F.lit(None).cast("double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, [*columns, "gaps", "empty"], probs, builtin_rows=0, gather_rows=gather)
    columns["gaps"] = columns["smooth"][columns["smooth"] > 0]
    for name, values in columns.items():
        for p in probs:
            wanted = float(np.quantile(values, p))
            assert got[name][p] == pytest.approx(wanted, rel=1e-12, abs=1e-300), (name, p)
    assert set(got["empty"].values()) == {None}
    builtin = exact_quantiles(df, ["smooth"], probs)
    assert builtin["smooth"][0.5] == pytest.approx(got["smooth"][0.5], rel=1e-12)


@pytest.mark.parametrize("n", [0, 1, 3, 40, 199, 200, 333, 500, 501, 900])
def test_long_heads_are_selected_where_they_lie(spark, monkeypatch, n):
    """A value shared by a third of the rows, gaps, and texts that agree in their first 256 characters."""
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 3)
    monkeypatch.setattr(ordering, "SELECT_SLICES", 5)
    rows = [(None if i % 3 == 0 else i * 7 % 50, "x" * 300 + str(i % 4) if i % 2 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, t string, i int").repartition(5)
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))[:n]
    found = ordering.first_rows(df, n, ["a", "t", "i"]).collect()
    assert Counter(map(tuple, found)) == Counter(wanted)


def test_equal_rows_in_a_long_head(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 3)
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "a int").repartition(4)
    for n, ones in ((20, 20), (50, 50), (70, 50)):
        found = Counter(r["a"] for r in ordering.first_rows(df, n, ["a"]).collect())
        assert found == Counter({1: ones, 2: n - ones}) - Counter()


@pytest.mark.parametrize("n", [2, 57, 300, 400])
def test_hash_ordered_heads_need_no_sample(spark, monkeypatch, n):
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 3)
    monkeypatch.setattr(ordering, "SELECT_SLICES", 4)
    df = spark.range(300).withColumn("h", hash_text(["id"], 42)).repartition(3)
    wanted = sorted((r["h"], r["id"]) for r in df.collect())[:n]
    found = ordering.first_rows(df, n, ["h", "id"], unit_hash(["id"], 42)).collect()
    assert sorted((r["h"], r["id"]) for r in found) == wanted


def test_long_heads_sort_few_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = ordering.first_rows(rows, 4_000, ["l_orderkey", "l_linenumber"])._jdf.queryExecution().toString()
    limits = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert limits and max(limits) <= ordering.TOP_K_ROWS and "Window" not in plan
