"""What the physical plans must and must not contain."""

import re

import pytest

from tablewright.functions import fill_in_order, number_rows
from tablewright.operators import FillNa, FilterRows, KeepColumns, ScaleNumeric
from tablewright.plans import FittedPlan
from tablewright.suite.registry import events_gaps, table


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def windows(text):
    """Argument lines of the windows over rows (those over slice summaries are tiny)."""
    return [line for line in text.splitlines() if line.startswith("Arguments:") and "windowspecdefinition" in line]


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = FittedPlan.fit(table(spark, sf, "lineitem"), [
        {"op": "filter_rows", "condition": "l_quantity > 45 and l_returnflag = 'R'"},
        {"op": "keep_columns", "columns": ["l_orderkey", "l_quantity"]},
    ]).apply(table(spark, sf, "lineitem"))
    text = plan_of(df)
    assert "GreaterThan(l_quantity,45.0)" in text and "EqualTo(l_returnflag,R)" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>", text)


def test_row_wise_chain_is_one_stage(spark, sf):
    rows = table(spark, sf, "lineitem")
    chain = [ScaleNumeric("standard", ["l_tax"]), FillNa(columns=["l_discount"]), KeepColumns(["l_tax", "l_discount"]), FilterRows("l_tax > 0")]
    text = plan_of(FittedPlan.fit(rows, chain).apply(rows))
    assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize("by", [[], ["user_id"]])
def test_fills_window_inside_slices(spark, sf, by):
    df = fill_in_order(events_gaps(spark, sf), ["value"], ["ts", "event_id"], by, slices=8)
    over_rows = [w for w in windows(plan_of(df)) if "ts#" in w]
    assert over_rows and all("__slice" in w for w in over_rows)


def test_positions_window_inside_slices(spark, sf):
    df = number_rows(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], slices=8)
    over_rows = [w for w in windows(plan_of(df)) if "o_orderkey" in w]
    assert over_rows and all("__slice" in w for w in over_rows)
