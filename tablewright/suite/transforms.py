"""Scaling, encoding, new columns, chains, replay and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import (
    CreateBins, CreateDifference, CreateProduct, CreateRatio, EncodeCategorical, ScaleNumeric,
)
from tablewright.plans import FittedPlan
from tablewright.session import scratch_path
from tablewright.streaming import through_stream, transform_stream
from tablewright.suite.registry import EVENTS_GAPS, ORDERS_GAPS, events_gaps, orders_gaps, query, table


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def z_score(column: str, table_name: str, places: int = 6) -> str:
    return (f"round(({column} - (SELECT avg({column}) FROM {table_name})) / "
            f"(SELECT stddev_pop({column}) FROM {table_name}), {places})")


@query("scale_standard", f"""
WITH {ORDERS_GAPS} SELECT o_orderkey, {z_score('o_totalprice', 'orders_gaps')} AS o_totalprice FROM orders_gaps""")
def scale_standard(spark, sf):
    rows = orders_gaps(spark, sf).select("o_orderkey", "o_totalprice")
    return _rounded(ScaleNumeric("standard", ["o_totalprice"])(rows), "o_totalprice")


@query("scale_minmax", """
SELECT l_orderkey, l_linenumber,
       round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 6) AS l_quantity,
       round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS l_extendedprice,
       0.0::DOUBLE AS k
FROM lineitem""")
def scale_minmax(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(1.0).alias("k"))
    scaled = ScaleNumeric("minmax", ["l_quantity", "l_extendedprice", "k"])(rows)
    return _rounded(scaled, "l_quantity", "l_extendedprice")


@query("scale_exclude", f"""
SELECT {z_score('p_partkey', 'part')} AS p_partkey, p_name, p_brand, p_type, {z_score('p_size', 'part')} AS p_size, p_retailprice
FROM part""")
def scale_exclude(spark, sf):
    return _rounded(ScaleNumeric("standard", exclude=["p_retailprice"])(table(spark, sf, "part")), "p_partkey", "p_size")


@query("encode_label", f"""
WITH {ORDERS_GAPS},
p AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders_gaps WHERE o_orderpriority IS NOT NULL)),
s AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS v FROM orders_gaps))
SELECT o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority
FROM orders_gaps o LEFT JOIN p ON o.o_orderpriority = p.v JOIN s ON o.o_orderstatus = s.v""")
def encode_label(spark, sf):
    rows = orders_gaps(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return EncodeCategorical("label", ["o_orderstatus", "o_orderpriority"])(rows)


@query("encode_label_large", """
SELECT doc_id, dense_rank() OVER (ORDER BY text) - 1 AS text FROM documents""")
def encode_label_large(spark, sf):
    """Codes of whole document texts: the vocabulary is as large as the table and is ranked in slices."""
    return EncodeCategorical("label", ["text"], max_literals=0)(table(spark, sf, "documents").select("doc_id", "text"))


@query("encode_onehot", f"""
WITH {EVENTS_GAPS}
SELECT event_id, value, event_type = 'click' AS event_type_click, event_type = 'error' AS event_type_error,
       event_type = 'purchase' AS event_type_purchase, event_type = 'signup' AS event_type_signup, event_type = 'view' AS event_type_view
FROM events_gaps""")
def encode_onehot(spark, sf):
    rows = events_gaps(spark, sf).select("event_id", "event_type", "value")
    return EncodeCategorical("onehot", ["event_type"])(rows)


@query("create_ratio", """
SELECT l_orderkey, l_linenumber, l_tax, l_discount, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS tax_per_discount
FROM lineitem""")
def create_ratio(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return CreateRatio("l_tax", "l_discount", "tax_per_discount")(rows)


@query("create_product", "SELECT l_orderkey, l_extendedprice, l_discount, l_extendedprice * l_discount AS saved FROM lineitem")
def create_product(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    return CreateProduct("l_extendedprice", "l_discount", "saved")(rows)


@query("create_difference", "SELECT l_orderkey, l_discount, l_tax, l_discount - l_tax AS net FROM lineitem")
def create_difference(spark, sf):
    return CreateDifference("l_discount", "l_tax", "net")(table(spark, sf, "lineitem").select("l_orderkey", "l_discount", "l_tax"))


BIN_INDEX = """
SELECT o_orderkey, o_totalprice,
       len(list_filter(range(1, 8), lambda i: o_totalprice > lo + i * ((hi - lo) / 8))) AS price_bin
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"""


@query("create_bins", BIN_INDEX)
def create_bins(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    binned = CreateBins("o_totalprice", 8, "price_bin", output="index")(rows)
    return binned.withColumn("price_bin", F.col("price_bin").cast("bigint"))


@query("create_bins_interval", """
SELECT p_partkey, round(CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) ELSE lo + i * ((hi - lo) / 5) END, 6) AS bin_lo,
       round(CASE WHEN i = 4 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 5) END, 6) AS bin_hi
FROM (SELECT p_partkey, lo, hi, len(list_filter(range(1, 5), lambda j: p_retailprice > lo + j * ((hi - lo) / 5))) AS i
      FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part))""")
def create_bins_interval(spark, sf):
    binned = CreateBins("p_retailprice", 5, "bin", output="interval")(table(spark, sf, "part").select("p_partkey", "p_retailprice"))
    return binned.select("p_partkey", F.round("bin.lo", 6).alias("bin_lo"), F.round("bin.hi", 6).alias("bin_hi"))


# -- chains ------------------------------------------------------------------------

CHAIN = [
    {"op": "fillna", "method": "median", "columns": ["o_totalprice"]},
    {"op": "filter_rows", "condition": "o_orderstatus <> 'O'"},
    {"op": "create_product", "col1": "o_totalprice", "col2": "o_custkey", "new_column": "weight"},
    {"op": "scale_numeric", "method": "standard", "columns": ["o_totalprice"]},
    {"op": "encode_categorical", "method": "label", "columns": ["o_orderstatus"]},
    {"op": "rename_columns", "mapping": {"o_custkey": "customer"}},
    {"op": "drop_columns", "columns": ["o_orderpriority", "o_orderdate"]},
]
CHAIN_FIT = f"""{ORDERS_GAPS},
filled AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_gaps)) AS price
           FROM orders_gaps),
kept AS (SELECT * FROM filled WHERE o_orderstatus <> 'O'),
fit AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd FROM kept)"""
CHAIN_ROW = """o_orderkey, o_custkey AS customer, {code} AS o_orderstatus,
       round((price - mu) / sd, 6) AS o_totalprice, round(price * o_custkey, 3) AS weight"""


def _chain_output(df):
    return df.withColumn("o_totalprice", F.round("o_totalprice", 6)).withColumn("weight", F.round("weight", 3))


@query("op_chain", f"""
WITH {CHAIN_FIT} SELECT {CHAIN_ROW.format(code="CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END")} FROM kept, fit""")
def op_chain(spark, sf):
    rows = orders_gaps(spark, sf)
    return _chain_output(FittedPlan.fit(rows, CHAIN).apply(rows))


@query("replay_on_new_rows", f"""
WITH {CHAIN_FIT} SELECT {CHAIN_ROW.format(code="CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE -1 END")} FROM filled, fit""")
def replay_on_new_rows(spark, sf):
    """The fitted chain on rows that still hold the status it filtered out: unseen, so -1."""
    rows = orders_gaps(spark, sf)
    return _chain_output(FittedPlan.fit(rows, CHAIN).replay(rows))


@query("transform_new_rows", f"""
SELECT c_custkey, {z_score('c_acctbal', 'customer').replace('round((c_acctbal', 'round((s_acctbal')} AS c_acctbal,
       coalesce(code, -1) AS c_mktsegment
FROM (SELECT s_suppkey AS c_custkey, s_acctbal, CASE WHEN s_acctbal > 0.0 THEN 'BUILDING' ELSE 'UNSEEN' END AS segment FROM supplier) n
LEFT JOIN (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)) m ON n.segment = m.v""")
def transform_new_rows(spark, sf):
    """Scaler and codes learned on customers, applied to suppliers."""
    plan = FittedPlan.fit(table(spark, sf, "customer"), [
        {"op": "scale_numeric", "method": "standard", "columns": ["c_acctbal"]},
        {"op": "encode_categorical", "method": "label", "columns": ["c_mktsegment"]},
    ])
    new = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.when(F.col("s_acctbal") > 0.0, "BUILDING").otherwise("UNSEEN").alias("c_mktsegment"),
    )
    return _rounded(plan.replay(new), "c_acctbal")


@query("chain_lineage", f"""
WITH {ORDERS_GAPS}, n AS (SELECT count(*) AS rows_all, count(*) FILTER (o_orderstatus <> 'O') AS rows_kept FROM orders_gaps)
SELECT step, operation, CASE WHEN step <= 2 THEN rows_all ELSE rows_kept END AS rows_in,
       CASE WHEN step = 1 THEN rows_all ELSE rows_kept END AS rows_out, columns_out
FROM n, (VALUES (1, 'fillna', 6), (2, 'filter_rows', 6), (3, 'create_product', 7), (4, 'scale_numeric', 7),
                (5, 'encode_categorical', 7), (6, 'rename_columns', 7), (7, 'drop_columns', 5)) t(step, operation, columns_out)""")
def chain_lineage(spark, sf):
    rows = orders_gaps(spark, sf)
    return FittedPlan.fit(rows, CHAIN).lineage(rows).drop("params")


@query("fitted_plan_roundtrip", f"""
WITH {CHAIN_FIT} SELECT {CHAIN_ROW.format(code="CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END")} FROM kept, fit""")
def fitted_plan_roundtrip(spark, sf):
    rows = orders_gaps(spark, sf)
    path = scratch_path(spark, "plan")
    FittedPlan.fit(rows, CHAIN).save(spark, path)
    return _chain_output(FittedPlan.load(spark, path).apply(rows))


@query("stream_transform", f"""
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, user_id, round((value - lo) / (hi - lo), 6) AS value,
       dense_rank() OVER (ORDER BY event_type) - 1 AS event_type,
       len(list_filter(range(1, 4), lambda i: value > lo + i * ((hi - lo) / 4))) AS value_bin
FROM events, b""")
def stream_transform(spark, sf):
    """A plan fitted on the batch, run over the same files as a stream."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    plan = FittedPlan.fit(rows, [
        {"op": "create_bins", "column": "value", "bins": 4, "new_column": "value_bin", "output": "index"},
        {"op": "scale_numeric", "method": "minmax", "columns": ["value"]},
        {"op": "encode_categorical", "method": "label", "columns": ["event_type"]},
    ])
    whole = table(spark, sf, "events").schema
    done = through_stream(
        spark, f"{sf}/events*.parquet", whole,
        lambda s: transform_stream(s.select("event_id", "user_id", "event_type", "value"), plan),
    )
    return _rounded(done, "value").withColumn("value_bin", F.col("value_bin").cast("bigint"))
