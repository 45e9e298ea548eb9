"""Projection, filters, types, missing values and row operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import (
    ConvertDtype, DropColumns, DropDuplicates, DropNa, FillNa, FilterRows, HeadRows, KeepColumns,
    RenameColumns, SampleRows, coerce_numeric,
)
from tablewright.suite.registry import (
    EVENTS_GAPS, ORDERS_GAPS, events_gaps, order_traits, orders_gaps, query, table,
)


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(spark, sf):
    return DropColumns(["o_orderdate", "o_orderpriority"])(table(spark, sf, "orders"))


@query("keep_columns", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
def keep_columns(spark, sf):
    return KeepColumns(["c_mktsegment", "c_custkey", "c_acctbal"])(table(spark, sf, "customer"))


@query("rename_columns", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def rename_columns(spark, sf):
    return RenameColumns({"n_nationkey": "nation_id", "n_name": "nation", "unknown": "x"})(table(spark, sf, "nation"))


@query("convert_dtype", """
SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def convert_dtype(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return ConvertDtype("p_size", "str")(ConvertDtype("p_retailprice", "int")(parts))


SIZE_TEXTS = "CASE WHEN p_type = 'SMALL' THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END"


def size_texts(spark, sf):
    """Part sizes as text, with a word where the type already says it."""
    text = F.when(F.col("p_type") == "SMALL", "n/a").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.alias("size_text"))


@query("try_convert_dtype", f"SELECT p_partkey, TRY_CAST({SIZE_TEXTS} AS BIGINT) AS size_text FROM part")
def try_convert_dtype(spark, sf):
    return ConvertDtype("size_text", "int", on_error="null")(size_texts(spark, sf))


@query("coerce_numeric", f"SELECT p_partkey, TRY_CAST({SIZE_TEXTS} AS DOUBLE) AS size FROM part")
def coerce(spark, sf):
    return size_texts(spark, sf).select("p_partkey", coerce_numeric("size_text").alias("size"))


@query("filter_rows", "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
def filter_rows(spark, sf):
    return FilterRows("l_quantity > 45 and l_discount < 0.03")(table(spark, sf, "lineitem"))


# -- missing values ----------------------------------------------------------------


@query("dropna_any", f"WITH {ORDERS_GAPS} SELECT * FROM orders_gaps WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
def dropna_any(spark, sf):
    return DropNa()(orders_gaps(spark, sf))


@query("dropna_all", f"WITH {ORDERS_GAPS} SELECT * FROM orders_gaps WHERE o_totalprice IS NOT NULL OR o_orderpriority IS NOT NULL")
def dropna_all(spark, sf):
    return DropNa(subset=["o_totalprice", "o_orderpriority"], how="all")(orders_gaps(spark, sf))


def _filled(spark, sf, **how):
    gaps = orders_gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return FillNa(**how)(gaps)


@query("fillna_mean", f"""
WITH {ORDERS_GAPS}
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_gaps)), 2) AS o_totalprice, o_orderpriority
FROM orders_gaps""")
def fillna_mean(spark, sf):
    filled = _filled(spark, sf, columns=["o_totalprice", "o_orderpriority", "unknown"])
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("fillna_median", f"""
WITH {ORDERS_GAPS}
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_gaps)), 2) AS o_totalprice, o_orderpriority
FROM orders_gaps""")
def fillna_median(spark, sf):
    filled = _filled(spark, sf, method="median", columns=["o_totalprice", "o_orderpriority"])
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("fillna_mode", f"""
WITH {ORDERS_GAPS},
p AS (SELECT o_orderpriority AS v FROM orders_gaps WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
t AS (SELECT o_totalprice AS v FROM orders_gaps WHERE o_totalprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_totalprice, (SELECT v FROM t)) AS o_totalprice,
       coalesce(o_orderpriority, (SELECT v FROM p)) AS o_orderpriority
FROM orders_gaps""")
def fillna_mode(spark, sf):
    return _filled(spark, sf, method="mode", columns=["o_totalprice", "o_orderpriority"])


@query("fillna_zero", f"WITH {ORDERS_GAPS} SELECT o_orderkey, coalesce(o_totalprice, 0.0::DOUBLE) AS o_totalprice, o_orderpriority FROM orders_gaps")
def fillna_zero(spark, sf):
    return _filled(spark, sf, method="zero")


@query("fillna_constant", f"WITH {ORDERS_GAPS} SELECT o_orderkey, o_totalprice, coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM orders_gaps")
def fillna_constant(spark, sf):
    return _filled(spark, sf, method="constant", value="unknown", columns=["o_orderpriority"])


@query("fillna_ffill", f"""
WITH {EVENTS_GAPS}
SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events_gaps""")
def fillna_ffill(spark, sf):
    fill = FillNa(method="ffill", columns=["value"], order=["ts", "event_id"], by=["user_id"])
    return fill(events_gaps(spark, sf)).select("event_id", "user_id", "value")


@query("fillna_bfill", f"""
WITH {EVENTS_GAPS}
SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM events_gaps""")
def fillna_bfill(spark, sf):
    fill = FillNa(method="bfill", columns=["value"], order=["ts", "event_id"], by=["user_id"])
    return fill(events_gaps(spark, sf)).select("event_id", "user_id", "value")


@query("fillna_ffill_global", f"""
WITH {EVENTS_GAPS}
SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events_gaps""")
def fillna_ffill_global(spark, sf):
    fill = FillNa(method="ffill", columns=["value"], order=["ts", "event_id"])
    return fill(events_gaps(spark, sf)).select("event_id", "value")


# -- rows --------------------------------------------------------------------------


@query("drop_duplicates", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def drop_duplicates(spark, sf):
    return DropDuplicates()(order_traits(spark, sf))


@query("drop_duplicates_subset", """
SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1""")
def drop_duplicates_subset(spark, sf):
    return DropDuplicates(["o_custkey", "o_orderstatus"], order=["o_orderdate", "o_orderkey"])(table(spark, sf, "orders"))


@query("sample_n", "SELECT * FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 1000")
def sample_n(spark, sf):
    return SampleRows(n=1000, key=["o_orderkey"])(table(spark, sf, "orders"))


@query("sample_frac", """
SELECT * FROM orders
QUALIFY row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey)
        <= (SELECT CAST(round_even(0.25 * count(*), 0) AS BIGINT) FROM orders)""")
def sample_frac(spark, sf):
    return SampleRows(frac=0.25, key=["o_orderkey"])(table(spark, sf, "orders"))


@query("head_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def head_rows(spark, sf):
    return HeadRows(order=["c_custkey"])(table(spark, sf, "customer"))


@query("fillna_ffill_nan", """
SELECT event_id, ts, user_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events""")
def fillna_ffill_nan(spark, sf):
    """Unknown values arrive as NaN and are filled like nulls."""
    rows = events_gaps(spark, sf).select("event_id", "ts", "user_id", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    return FillNa(method="ffill", columns=["value"], order=["ts", "event_id"], by=["user_id"])(rows)
