"""From raw documents to packed training sequences: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame;
all but the last return the columns of ``docs``. Between stages the rows are written to the
shared folder and read again, so a lost executor costs part of one stage.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.llm import chosen_path, packing, quality_rules, suffix_dedup, toxicity  # noqa: E402
from tablewright.llm.registry import table  # noqa: E402
from tablewright.session import cut_lineage  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network accepts."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return chosen_path.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat."""
    return suffix_dedup.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs, keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

# A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
