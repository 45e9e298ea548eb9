"""Shared scratch space."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from tablewright.session import cut_lineage


def shuffle_files(spark) -> set[str]:
    root = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    return {f for r in root.split(",") for f in glob.glob(f"{r}/blockmgr-*/*/shuffle_*.data")}


def test_a_cut_leaves_no_shuffle_files_and_no_setting_behind(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    counted = spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count("*").alias("n"))
    before, setting = shuffle_files(spark), spark.conf.get(key, None)
    cut = cut_lineage(counted.join(counted.where("k < 5").select("k"), "k", "left_semi"))
    assert not shuffle_files(spark) - before
    assert spark.conf.get(key, None) == setting
    assert sorted(map(tuple, cut.collect())) == [(k, 3) for k in range(5)]
    assert counted.count() == 7_000  # the same rows once more, from the start
