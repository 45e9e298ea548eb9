"""Profiling and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import analysis as A
from tablewright.suite.registry import (
    CUSTOMER_IDS, ORDERS_GAPS, customer_ids, order_traits, orders_gaps, query, table,
)
from tablewright.suite.transforms import z_score


def _round(df, *names, places=4):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("basic_shape", """
SELECT count(*) AS row_count, 6 AS column_count, 'o_orderkey,o_custkey,o_totalprice' AS numeric_columns,
       'o_orderstatus,o_orderdate,o_orderpriority' AS categorical_columns
FROM orders""")
def basic_shape(spark, sf):
    return A.basic_shape(table(spark, sf, "orders"))


GAP_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority o_orderdate".split()


@query("missing_values", f"WITH {ORDERS_GAPS}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM orders_gaps" for c in GAP_COLUMNS))
def missing_values(spark, sf):
    return A.missing_values(orders_gaps(spark, sf))


@query("duplicate_rows", """
SELECT (SELECT count(*) FROM orders)
       - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)) AS duplicate_rows""")
def duplicate_rows(spark, sf):
    return A.duplicate_rows(order_traits(spark, sf))


def _describe_sql(column: str, table_name: str) -> str:
    value = f"CAST({column} AS DOUBLE)"
    parts = ", ".join(f"round(quantile_cont({value}, {p}), 4) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return (f"SELECT '{column}' AS column_name, count({column}) AS count, round(avg({value}), 4) AS mean, "
            f"round(stddev_samp({value}), 4) AS std, min({value}) AS min, {parts}, max({value}) AS max FROM {table_name}")


@query("describe", "\nUNION ALL\n".join(
    _describe_sql(c, "lineitem") for c in "l_linenumber l_quantity l_extendedprice l_discount l_tax".split()))
def describe(spark, sf):
    numbers = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _round(A.describe(table(spark, sf, "lineitem"), numbers), "mean", "std", "q25", "q50", "q75")


@query("describe_joined", """
WITH d AS (SELECT o.o_totalprice, c.c_acctbal, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
""" + "\nUNION ALL\n".join(_describe_sql(c, "d") for c in ("o_totalprice", "c_acctbal", "c_nationkey")))
def describe_joined(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_totalprice", "c_acctbal", "c_nationkey")
    return _round(A.describe(joined), "mean", "std", "q25", "q50", "q75")


PAIR = "l_quantity l_extendedprice l_discount l_tax l_linenumber k".split()


@query("correlation_matrix", "WITH d AS (SELECT *, 1.0 AS k FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    + ("max(CAST(NULL AS DOUBLE))" if "k" in (a, b) else "round(corr(" + a + ", " + b + "), 4)")
    + " AS correlation FROM d"
    for a in PAIR for b in PAIR))
def correlation_matrix(spark, sf):
    """All pairs, with a constant column whose correlations are undefined."""
    rows = table(spark, sf, "lineitem").withColumn("k", F.lit(1.0))
    return A.correlation_matrix(rows, PAIR)


@query("correlation_pairwise", f"""
WITH {ORDERS_GAPS}
SELECT 'o_custkey' AS column_a, 'o_totalprice' AS column_b, round(corr(o_custkey, o_totalprice), 4) AS correlation FROM orders_gaps
UNION ALL SELECT 'o_totalprice', 'o_custkey', round(corr(o_custkey, o_totalprice), 4) FROM orders_gaps
UNION ALL SELECT 'o_custkey', 'o_custkey', 1.0 UNION ALL SELECT 'o_totalprice', 'o_totalprice', 1.0""")
def correlation_pairwise(spark, sf):
    return A.correlation_matrix(orders_gaps(spark, sf), ["o_custkey", "o_totalprice"])


def _insight_sql(column: str, kind: str, table_name: str) -> str:
    v = f"CAST({column} AS DOUBLE)"
    return (f"SELECT '{column}' AS column_name, '{kind}' AS data_type, count(*) - count({column}) AS null_count, "
            f"round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, "
            f"round(max({v}), 4) AS max, round(skewness({v}), 4) AS skew FROM {table_name}")


@query("insights_numeric", f"WITH {ORDERS_GAPS}\n" + "\nUNION ALL\n".join(
    _insight_sql(c, k, "orders_gaps") for c, k in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"))))
def insights_numeric(spark, sf):
    return A.numeric_insights(orders_gaps(spark, sf))


def _top_sql(column: str, table_name: str, k: int) -> str:
    return f"""
SELECT '{column}' AS column_name, (SELECT count(DISTINCT {column}) FROM {table_name}) AS n_distinct,
       row_number() OVER (ORDER BY count(*) DESC, {column}) AS rank, CAST({column} AS VARCHAR) AS value, count(*) AS n
FROM {table_name} WHERE {column} IS NOT NULL GROUP BY {column}
QUALIFY row_number() OVER (ORDER BY count(*) DESC, {column}) <= {k}"""


@query("insights_categorical", "\nUNION ALL\n".join(_top_sql(c, "documents", 5) for c in ("text", "lang", "source")))
def insights_categorical(spark, sf):
    """Whole document texts included: repeated texts are the top values."""
    return A.categorical_insights(table(spark, sf, "documents"), ["text", "lang", "source"])


@query("target_numeric", f"""
WITH {ORDERS_GAPS}
SELECT 'o_totalprice' AS target_column, count(*) - count(o_totalprice) AS null_count, round(avg(o_totalprice), 4) AS mean,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std,
       round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(skewness(o_totalprice), 4) AS skew
FROM orders_gaps""")
def target_numeric(spark, sf):
    return A.target_numeric(orders_gaps(spark, sf), "o_totalprice")


@query("target_categorical", """
SELECT p_brand AS value, count(*) AS n, (SELECT count(DISTINCT p_brand) FROM part) AS unique_classes
FROM part GROUP BY p_brand QUALIFY row_number() OVER (ORDER BY count(*) DESC, p_brand) <= 10""")
def target_categorical(spark, sf):
    return A.target_categorical(table(spark, sf, "part"), "p_brand")


@query("target_correlations", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice), 4) AS correlation FROM lineitem"
    for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax".split()))
def target_correlations(spark, sf):
    return A.target_correlations(table(spark, sf, "lineitem"), "l_extendedprice")


REPORT = """
SELECT 'shape' AS section, '*' AS column_name, 'row_count' AS metric, CAST(count(*) AS VARCHAR) AS value FROM customer_ids
UNION ALL SELECT 'shape', '*', 'column_count', '6'
UNION ALL SELECT 'shape', '*', 'numeric_columns', 'customer_id,c_nationkey,c_acctbal'
UNION ALL SELECT 'shape', '*', 'categorical_columns', 'c_name,c_mktsegment,channel'
UNION ALL SELECT 'duplicates', '*', 'duplicate_rows', '0'
"""


@query("summary_report", f"WITH {CUSTOMER_IDS}\n{REPORT}" + "".join(
    f"UNION ALL SELECT 'missing', '{c}', 'missing', '0'\n"
    for c in "customer_id c_name c_nationkey c_acctbal c_mktsegment channel".split()
) + "".join(
    f"UNION ALL SELECT '{s}', '{c}', '{m}', CAST({e.format(v=f'CAST({c} AS DOUBLE)')} AS VARCHAR) FROM customer_ids\n"
    for c in ("customer_id", "c_nationkey", "c_acctbal")
    for s, m, e in (
        ("describe", "count", "count({v})"), ("describe", "mean", "round(avg({v}), 4)"),
        ("describe", "std", "round(stddev_samp({v}), 4)"), ("describe", "min", "round(min({v}), 4)"),
        ("describe", "q25", "round(quantile_cont({v}, 0.25), 4)"), ("describe", "q50", "round(quantile_cont({v}, 0.5), 4)"),
        ("describe", "q75", "round(quantile_cont({v}, 0.75), 4)"), ("describe", "max", "round(max({v}), 4)"),
        ("insights", "null_count", "count(*) - count({v})"), ("insights", "mean", "round(avg({v}), 4)"),
        ("insights", "std", "round(stddev_samp({v}), 4)"), ("insights", "min", "round(min({v}), 4)"),
        ("insights", "max", "round(max({v}), 4)"), ("insights", "skew", "round(skewness({v}), 4)"),
    )
) + "".join(
    f"UNION ALL SELECT 'distinct', '{c}', 'n_distinct', CAST(count(DISTINCT {c}) AS VARCHAR) FROM customer_ids\n"
    f"UNION ALL SELECT * FROM (SELECT 'top_values', '{c}', {c}, CAST(count(*) AS VARCHAR) FROM customer_ids GROUP BY {c} "
    f"QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) <= 5)\n"
    for c in ("c_name", "c_mktsegment", "channel")
) + "".join(
    f"UNION ALL SELECT 'correlations', '{a}', '{b}', CAST(round(corr({a}, {b}), 4) AS VARCHAR) FROM customer_ids\n"
    for a in ("customer_id", "c_nationkey", "c_acctbal") for b in ("customer_id", "c_nationkey", "c_acctbal")
) + "".join(
    f"UNION ALL SELECT 'target', 'c_acctbal', '{m}', CAST({e} AS VARCHAR) FROM customer_ids\n"
    for m, e in (
        ("null_count", "count(*) - count(c_acctbal)"), ("mean", "round(avg(c_acctbal), 4)"),
        ("median", "round(quantile_cont(c_acctbal, 0.5), 4)"), ("std", "round(stddev_samp(c_acctbal), 4)"),
        ("min", "round(min(c_acctbal), 4)"), ("max", "round(max(c_acctbal), 4)"), ("skew", "round(skewness(c_acctbal), 4)"),
    )
) + "".join(
    f"UNION ALL SELECT 'target_correlations', '{c}', 'correlation', CAST(round(corr({c}, c_acctbal), 4) AS VARCHAR) FROM customer_ids\n"
    for c in ("customer_id", "c_nationkey")
))
def summary_report(spark, sf):
    return A.summary_report(customer_ids(spark, sf), "c_acctbal")


def _digest_sql(column: str, kind: str) -> str:
    numeric = kind in ("bigint", "int", "double")
    stats = ", ".join(f"round({f}(CAST({column} AS DOUBLE)), 2) AS {n}" for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) \
        if numeric else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
    top = "CAST(NULL AS VARCHAR)" if numeric else f"""(SELECT string_agg(v || '(' || n || ')', ', ' ORDER BY n DESC, v) FROM
      (SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"""
    return (f"SELECT '{column}' AS column_name, '{kind}' AS data_type, count(DISTINCT {column}) AS n_distinct, "
            f"count(*) - count({column}) AS null_count, {stats}, {top} AS top FROM part")


@query("dataset_digest", "\nUNION ALL\n".join(_digest_sql(c, k) for c, k in (
    ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
    ("p_size", "int"), ("p_retailprice", "double"))))
def dataset_digest(spark, sf):
    return A.dataset_digest(table(spark, sf, "part"))


# -- advice ------------------------------------------------------------------------

TASK_TARGETS = (
    ("lineitem", "l_linenumber", True), ("part", "p_size", True), ("orders", "o_totalprice", False),
    ("orders", "o_orderstatus", None), ("labels", "quality", True), ("customer", "c_nationkey", True),
)


def _task_sql(table_name: str, column: str, integral: bool | None) -> str:
    if integral is None:
        task = "CASE WHEN count(*) > 0 THEN 'classification' END"
    else:
        dense = (f"WHEN count(DISTINCT {column}) <= 50 THEN CASE WHEN count(DISTINCT {column}) / (max({column}) - min({column}) + 1.0) > 0.5 "
                 "THEN 'regression' ELSE 'classification' END") if integral else ""
        task = f"CASE WHEN count(DISTINCT {column}) <= 10 THEN 'classification' {dense} ELSE 'regression' END"
    return f"SELECT '{column}' AS target_column, {task} AS task_type FROM {table_name}"


@query("detect_task_type", "\nUNION ALL\n".join(_task_sql(*t) for t in TASK_TARGETS))
def detect_task_type(spark, sf):
    rows = [(c, A.detect_task_type(table(spark, sf, t).select(c), c)) for t, c, _ in TASK_TARGETS]
    return spark.createDataFrame(rows, "target_column string, task_type string")


def _pruned(spark, sf, reason):
    found = A.prune_columns(A.column_traits(customer_ids(spark, sf)))
    return spark.createDataFrame([(c,) for c, r in found.items() if r == reason], "column_name string")


CUSTOMER_COLUMNS = "customer_id c_name c_nationkey c_acctbal c_mktsegment channel".split()


def _where(columns, condition: str) -> str:
    return f"WITH {CUSTOMER_IDS}\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name FROM customer_ids HAVING {condition.format(c=c)}" for c in columns)


@query("constant_columns", _where(CUSTOMER_COLUMNS, "count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1"))
def constant_columns(spark, sf):
    return _pruned(spark, sf, "constant")


@query("id_text_columns", _where(("c_name", "c_mktsegment", "channel"), "count(DISTINCT {c}) = count(*)"))
def id_text_columns(spark, sf):
    return _pruned(spark, sf, "unique text")


@query("sequential_id_columns", _where(("customer_id", "c_nationkey", "c_acctbal"),
       "count(DISTINCT {c}) = count(*) AND min({c}) = 1 AND max({c}) = count(*) AND '{c}' LIKE '%id'"))
def sequential_id_columns(spark, sf):
    return _pruned(spark, sf, "sequential id")


@query("suggest_target", """
SELECT target_column, 'regression' AS task_type FROM (
  SELECT 'p_partkey' AS target_column, stddev_samp(p_partkey) AS s FROM part
  UNION ALL SELECT 'p_size', stddev_samp(p_size) FROM part
  UNION ALL SELECT 'p_retailprice', stddev_samp(p_retailprice) FROM part) ORDER BY s DESC LIMIT 1""")
def suggest_target(spark, sf):
    found = A.suggest_target(table(spark, sf, "part"))
    return spark.createDataFrame([(found["target_column"], found["task_type"])], "target_column string, task_type string")


@query("suggest_preprocessing", """
SELECT * FROM (VALUES (1, 'drop_columns', 'customer_id'), (2, 'drop_columns', 'c_name'), (3, 'drop_columns', 'channel'),
                      (4, 'scale_numeric', NULL)) t(step, op, column_name)""")
def suggest_preprocessing(spark, sf):
    chain = A.suggest_preprocessing(customer_ids(spark, sf), "c_acctbal")
    rows = [(i + 1, s["op"], s["columns"][0] if "columns" in s else None) for i, s in enumerate(chain)]
    return spark.createDataFrame(rows, "step int, op string, column_name string")


@query("apply_suggested", f"""
WITH {CUSTOMER_IDS}
SELECT {z_score('c_nationkey', 'customer')} AS c_nationkey, c_acctbal, c_mktsegment FROM customer_ids""")
def apply_suggested(spark, sf):
    done = A.apply_suggested(customer_ids(spark, sf), "c_acctbal")
    return done.withColumn("c_nationkey", F.round("c_nationkey", 6))


@query("insights_all_text", """
SELECT column_name, count(*) OVER (PARTITION BY column_name) AS classes, value, n
FROM (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus)""")
def insights_all_text(spark, sf):
    """A table of texts alone: no numeric report, a whole categorical one."""
    texts = table(spark, sf, "orders").select("o_orderstatus")
    found = A.categorical_insights(texts).select("column_name", F.col("n_distinct").alias("classes"), "value", "n")
    return found.join(A.numeric_insights(texts).select("column_name"), "column_name", "left_anti")


@query("insights_all_numeric", """
SELECT 'l_quantity' AS column_name, 0 AS null_count, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS min, max(l_quantity) AS max
FROM lineitem""")
def insights_all_numeric(spark, sf):
    """A table of numbers alone: no categorical report, a whole numeric one."""
    numbers = table(spark, sf, "lineitem").select("l_quantity")
    found = A.numeric_insights(numbers).select("column_name", "null_count", "mean", "min", "max")
    return found.join(A.categorical_insights(numbers).select("column_name"), "column_name", "left_anti")
