"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads. Each query's whole
result is computed and discarded (``noop`` sink); one small query warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright import build_session  # noqa: E402
from tablewright.suite import QUERIES  # noqa: E402

HEADLINE = [
    # cleaning and transforming
    "query_as_dataset", "filter_rows", "fillna_median", "fillna_mode", "fillna_ffill", "fillna_ffill_global",
    "drop_duplicates_subset", "sample_frac", "scale_minmax", "encode_label", "encode_label_large",
    "encode_onehot", "create_bins", "op_chain", "stream_transform",
    # catalog and profiles
    "table_summary", "candidate_keys", "foreign_keys", "database_overview", "describe", "correlation_matrix", "insights_numeric",
    "insights_categorical", "duplicate_rows", "target_correlations", "summary_report",
    # relational
    "sql_inner_join", "sql_group_avg", "sql_window_rank", "sql_grouping_sets",
    # features, models, metrics
    "stratified_kfold_assign", "stratified_split", "onehot_features", "ols_fit", "ridge_fit", "predict_batch",
    "knn_classify", "knn_regress", "predict_batch_wide", "model_on_label_column", "metric_roc_auc", "metric_f1", "suggest_preprocessing",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sql_filter"](spark, sf).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for key in wanted:
        started = time.perf_counter()
        QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
        print(f"{key}: {seconds[key]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
