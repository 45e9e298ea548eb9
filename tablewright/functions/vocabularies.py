"""Distinct values of text columns: counted once, kept as a list while small, as a ranked table beyond."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import quoted
from tablewright.functions.ordering import number_rows
from tablewright.session import cut_lineage, scratch_path

# A vocabulary within both bounds may be a list on the driver and literals in a plan.
LIST_VALUES, LIST_BYTES = 10_000, 1 << 18

CODE_SCHEMA = "value string, code bigint"


def count_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Written rows (column, value, n) of the present values as text."""
    items = [x for c in columns for x in (F.lit(c), quoted(c).cast("string"))]
    stacked = df.select(F.stack(F.lit(len(columns)), *items).alias("column", "value"))
    return cut_lineage(stacked.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def sizes_of(counts: DataFrame) -> dict[str, tuple[int, int, str]]:
    """Per column: number of values, their bytes, and the most frequent value (the smallest of equals)."""
    rows = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("values"), F.sum(F.octet_length("value")).alias("bytes"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("mode"))
    return {r["column"]: (r["values"], r["bytes"], r["mode"]["value"]) for r in rows.collect()}


def fits_list(size: tuple[int, int, str], most: int | None = None) -> bool:
    """Whether a vocabulary may be a list: at most ``most`` (else ``LIST_VALUES``) values, and not too long."""
    return size[0] <= (LIST_VALUES if most is None else most) and size[1] <= LIST_BYTES


def store_codes(values: DataFrame, as_type: str = "string") -> dict[str, Any]:
    """Write (value, code) of distinct ``value`` texts, ranked in slices; returns where, and how many."""
    path = scratch_path(values.sparkSession, "codes")
    ranked = values.select("value", F.col("value").cast(as_type).alias("rank"))
    number_rows(ranked, ["rank", "value"], name="position").select(
        "value", (F.col("position") - 1).alias("code")).write.parquet(path)
    return {"path": path, "rows": values.sparkSession.read.parquet(path).count()}


def read_codes(df: DataFrame, stored: dict[str, Any]) -> DataFrame:
    return df.sparkSession.read.schema(CODE_SCHEMA).parquet(stored["path"])
