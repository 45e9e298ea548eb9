"""Registry of the checked queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.sources import TableSource

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under ``key``, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def sql_query(key: str, text: str, oracle: str | None = None) -> None:
    """Register a pass-through SQL query; the same text is its check unless another is given."""
    query(key, oracle or text)(lambda spark, sf: source(spark, sf).run_sql(text))


def source(spark: SparkSession, sf: str) -> TableSource:
    return TableSource.from_parquet(spark, sf, TABLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- derived tables: the same rule as a DataFrame and as SQL -----------------------


def orders_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose pending prices and unspecified priorities are unknown."""
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
        "o_orderdate",
    )


ORDERS_GAPS = """orders_gaps AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, o_orderdate
  FROM orders)"""


def events_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose error rows carry no value."""
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


EVENTS_GAPS = """events_gaps AS (
  SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value
  FROM events)"""


def order_traits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without their key: the same few values recur, so whole rows repeat."""
    return table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")


def customer_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a key from 1 on, a constant and a column of distinct texts."""
    return table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1).alias("customer_id"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
        F.lit("retail").alias("channel"),
    )


CUSTOMER_IDS = """customer_ids AS (
  SELECT c_custkey + 1 AS customer_id, c_name, c_nationkey, c_acctbal, c_mktsegment, 'retail' AS channel
  FROM customer)"""
