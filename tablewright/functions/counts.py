"""Value counts of many columns in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import is_missing, quoted
from tablewright.session import BROADCAST_ROWS, cut_lineage

# Longer texts are counted by their beginning and a digest.
BEGINNING = 64
TEXT = "string"


def _slots(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """One value column per data type, so that values keep their own ordering."""
    kinds: dict[str, str] = {}
    for name in columns:
        kinds.setdefault(df.schema[name].dataType.simpleString(), f"value_{len(kinds)}")
    return kinds


def distinct_estimate(value: Column) -> Column:
    """Sketched distinct count (within a few percent) in one small buffer per task.

    Fast enough for every column of a wide table in one aggregation. It only decides
    which columns are worth an exact count.
    """
    hashed = F.when(value.isNotNull(), F.xxhash64(value))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(12))), F.lit(0))


def _cut(value: Column) -> tuple[Column, Column]:
    """What stands for a text while it is counted: its beginning and, if there is more, a digest of the whole."""
    return F.substring(value, 1, BEGINNING), F.when(F.char_length(value) > BEGINNING, F.unhex(F.md5(value)))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value slots, digest, n): how often each present value occurs.

    All columns are stacked in a single scan and counted map-side first, so a value
    that fills a third of a column travels as one row per input task. Of a long text only its
    beginning and a digest travel; :func:`most_frequent` fetches the few that are shown.
    """
    slots = _slots(df, columns)
    items = []
    for name in columns:
        kind = df.schema[name].dataType.simpleString()
        value = F.when(~is_missing(df, name), quoted(name))
        value, digest = _cut(value) if kind == TEXT else (value, F.lit(None).cast("binary"))
        items.append(F.lit(name))
        items.extend(value if k == kind else F.lit(None).cast(k) for k in slots)
        items.append(digest)
    stacked = df.select(F.stack(F.lit(len(columns)), *items).alias("column", *slots.values(), "digest"))
    present = reduce(lambda x, y: x | y, [F.col(s).isNotNull() for s in slots.values()])
    return stacked.where(present).groupBy("column", *slots.values(), "digest").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(df: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(column, rank, value, n): the ``k`` most frequent values per column of ``counts``, the smaller first on a tie.

    The rank filter is pushed below the shuffle as a per-task group limit. Texts that tie in count and beginning
    are all kept at first; whole texts are read for what is left, and decide.
    """
    slots = {c: counts.schema[c].dataType.simpleString() for c in counts.columns if c.startswith("value_")}
    per_column = Window.partitionBy("column")
    near = counts.withColumn("rank", F.rank().over(per_column.orderBy(
        F.desc("n"), *[F.asc(s) for s in slots], F.col("digest").isNotNull().asc()))).where(F.col("rank") <= k)
    text = next((s for s, kind in slots.items() if kind == TEXT), None)
    whole = F.col(text) if text else None
    if text:
        near = cut_lineage(near)
        wanted = near.where("digest IS NOT NULL").select(F.col("column").alias("c"), F.col("digest").alias("d"))
        names = {r["c"]: r["n"] for r in wanted.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        if names:
            near = near.join(_texts(df, sorted(names), wanted, sum(names.values())), ["column", "digest"], "left")
            whole = F.coalesce("whole", text)
    values = [whole if s == text else F.col(s) for s in slots]
    ranked = near.withColumn("rank", F.row_number().over(per_column.orderBy(F.desc("n"), *[v.asc() for v in values])))
    return ranked.where(F.col("rank") <= k).select(
        "column", "rank", F.coalesce(*[v.cast("string") for v in values]).alias("value"), "n")


def _texts(df: DataFrame, columns: list[str], wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(column, digest, whole): one copy of each wanted long text."""
    items = [x for c in columns for x in (F.lit(c), quoted(c))]
    stacked = df.select(F.stack(F.lit(len(columns)), *items).alias("column", "whole"))
    digests = stacked.withColumn("digest", _cut(F.col("whole"))[1]).where("digest IS NOT NULL")
    side = F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted
    met = digests.join(side, (F.col("column") == F.col("c")) & (F.col("digest") == F.col("d")), "left_semi")
    return met.groupBy("column", "digest").agg(F.first("whole").alias("whole"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct) with missing values left out; a column of nulls has no row."""
    counts = value_counts(df, columns)
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
