"""Sources, catalog and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.session import scratch_path
from tablewright.sources import (
    TableSource, parse_json, read_csv, read_json, rows_to_json, save_dataset, write_csv,
)
from tablewright.suite.registry import TABLES, orders_gaps, ORDERS_GAPS, query, source, table

# The columns of the given tables, used to write the checks.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
COLUMNS = {t: c.split() for t, c in COLUMNS.items()}
def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


COUNTS = _union(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)
KEYS = _union(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name FROM {t} "
    f"HAVING count(*) = count({c}) AND count(*) = count(DISTINCT {c})"
    for t in TABLES for c in COLUMNS[t] if c != "embedding"
)
# Every column against every key of its class: all of its distinct values must find an equal one.
VALUES = _union(
    f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v, "
    f"CASE WHEN typeof({c}) IN ('INTEGER', 'BIGINT') THEN 'whole' ELSE typeof({c}) END AS k FROM {t} WHERE {c} IS NOT NULL"
    for t in TABLES for c in COLUMNS[t] if c != "embedding"
)
STEM = "lower(CASE WHEN regexp_matches({0}, '^[^_]{{0,2}}_.') THEN substr({0}, strpos({0}, '_') + 1) ELSE {0} END)"
FOREIGN = f"""
WITH column_values AS MATERIALIZED ({VALUES}), key_columns AS ({KEYS}),
sizes AS (SELECT t, c, count(*) AS n FROM column_values GROUP BY ALL),
key_values AS (SELECT v.* FROM column_values v JOIN key_columns ON t = table_name AND c = column_name),
hits AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, count(*) AS n
         FROM column_values a JOIN key_values b ON a.k = b.k AND a.v = b.v AND a.t <> b.t GROUP BY ALL)
SELECT h.t AS table_name, h.c AS column_name, h.pt AS parent_table, h.pc AS parent_column, h.n AS n_values,
       p.n AS n_parent_values, {STEM.format("h.c")} = {STEM.format("h.pc")} AS names_agree
FROM hits h JOIN sizes s ON h.t = s.t AND h.c = s.c AND h.n = s.n JOIN sizes p ON h.pt = p.t AND h.pc = p.c"""


@query("row_count", COUNTS)
def row_count(spark, sf):
    return source(spark, sf).row_counts()


@query("candidate_keys", KEYS)
def candidate_keys(spark, sf):
    return source(spark, sf).candidate_keys()


@query("foreign_keys", FOREIGN)
def foreign_keys(spark, sf):
    return source(spark, sf).foreign_keys()


@query("foreign_keys_named", f"SELECT * FROM ({FOREIGN}) WHERE names_agree")
def foreign_keys_named(spark, sf):
    return source(spark, sf).foreign_keys(match_names=True)


@query("table_summary", _union(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(c)} AS column_count, '{','.join(c)}' AS columns FROM {t}"
    for t, c in COLUMNS.items()
))
def table_summary(spark, sf):
    return source(spark, sf).table_summary().withColumn("columns", F.array_join("columns", ","))


@query("database_overview", f"""
WITH counts AS ({COUNTS}), keys AS ({KEYS}), fks AS ({FOREIGN}),
shapes AS ({_union(f"SELECT '{t}' AS table_name, '{','.join(c)}' AS columns" for t, c in COLUMNS.items())})
SELECT c.table_name, c.row_count, s.columns,
       (SELECT string_agg(k.column_name, ',' ORDER BY k.column_name) FROM keys k WHERE k.table_name = c.table_name) AS primary_keys,
       (SELECT string_agg(f.column_name || '>' || f.parent_table || '.' || f.parent_column, ','
                          ORDER BY f.column_name || '>' || f.parent_table || '.' || f.parent_column)
        FROM fks f WHERE f.table_name = c.table_name) AS foreign_keys
FROM counts c JOIN shapes s USING (table_name)""")
def database_overview(spark, sf):
    wide = source(spark, sf).overview()
    relation = F.transform("foreign_keys", lambda r: F.concat(r["column_name"], F.lit(">"), r["parent_table"], F.lit("."), r["parent_column"]))
    return wide.select(
        "table_name", "row_count",
        F.array_join(F.transform("columns", lambda c: c["column_name"]), ",").alias("columns"),
        F.array_join("primary_keys", ",").alias("primary_keys"), F.array_join(relation, ",").alias("foreign_keys"),
    )


@query("load_table_limit", "SELECT * FROM customer ORDER BY c_custkey LIMIT 500")
def load_table_limit(spark, sf):
    return source(spark, sf).load_table("customer", 500, order=["c_custkey"])


@query("load_table_limit_large", "SELECT * FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 4000")
def load_table_limit_large(spark, sf):
    return source(spark, sf).load_table("lineitem", 4000, order=["l_shipdate", "l_orderkey", "l_linenumber"])


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def preview(spark, sf):
    return source(spark, sf).preview("orders", order=["o_orderkey"])


QUERY_AS_DATASET = """
SELECT o.o_orderkey, o.o_totalprice, o.o_orderpriority, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""


@query("query_as_dataset", QUERY_AS_DATASET)
def query_as_dataset(spark, sf):
    return source(spark, sf).run_sql(QUERY_AS_DATASET)


@query("csv_scan", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def csv_scan(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    path = scratch_path(spark, "csv")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query("csv_sink", """
SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 250000.0 THEN 'high' ELSE 'low' END AS prediction FROM orders""")
def csv_sink(spark, sf):
    scored = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_totalprice") > 250000.0, "high").otherwise("low").alias("prediction")
    )
    path = scratch_path(spark, "predictions")
    write_csv(scored, path)
    return read_csv(spark, path, scored.schema)


@query("json_scan", "SELECT event_id, event_type, value, user_id FROM events")
def json_scan(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    path = scratch_path(spark, "json")
    rows.write.json(path)
    return read_json(spark, path, rows.schema)


@query("json_records", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_records(spark, sf):
    return parse_json(table(spark, sf, "events").select("event_id", "props"), "props", "k bigint")


@query("save_dataset", f"WITH {ORDERS_GAPS} SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders_gaps WHERE o_totalprice IS NOT NULL")
def save_dataset_roundtrip(spark, sf):
    cleaned = orders_gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority").na.drop(subset=["o_totalprice"])
    folder = save_dataset(cleaned, scratch_path(spark, "saved"), "orders_clean")
    return spark.read.parquet(f"{folder}/orders_clean.parquet")


@query("save_with_originals", _union(
    [f"SELECT 'preprocessed_data' AS table_name, count(*) AS row_count FROM customer WHERE c_acctbal > 0.0"]
    + [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES]
))
def save_with_originals(spark, sf):
    opened = source(spark, sf)
    positive = opened.run_sql("SELECT * FROM customer WHERE c_acctbal > 0.0")
    folder = save_dataset(
        positive, scratch_path(spark, "saved"), "query: SELECT * FROM customer...", opened
    )
    saved = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("preprocessed_data", *TABLES)}
    counted = None
    for name, df in saved.items():
        part = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        counted = part if counted is None else counted.unionByName(part)
    return counted


@query("rows_to_json", f"WITH {ORDERS_GAPS} SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders_gaps")
def rows_to_json_roundtrip(spark, sf):
    rows = orders_gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority")
    # an unknown price arrives as NaN, which must leave as null
    noisy = rows.withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(float("nan"))))
    return parse_json(rows_to_json(noisy), "json", rows.schema)
