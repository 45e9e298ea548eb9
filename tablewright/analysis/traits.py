"""Per-column facts that pruning, task detection and advice share, from as few scans as possible."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import (
    as_double, flat_columns, is_integral, is_missing, is_numeric, quoted,
)
from tablewright.functions.counts import distinct_estimate

# Exact distinct counts matter only up to this size (task detection asks for 10 and 50)
# or for columns that may be unique.
FEW_VALUES = 50


@dataclasses.dataclass
class ColumnTraits:
    name: str
    numeric: bool
    integral: bool
    rows: int
    present: int
    distinct: int          # exact when it decides anything, else the sketch's estimate
    unique: bool           # complete and all distinct
    low: float | None
    high: float | None
    std: float | None

    @property
    def constant(self) -> bool:
        """At most one value, a missing value counting as one."""
        return self.distinct + (self.present < self.rows) <= 1

    @property
    def sequential(self) -> bool:
        """Whole numbers 1, 2, ... without gap: complete, distinct, from 1 up to the row count."""
        return self.unique and self.rows > 1 and self.low == 1 and self.high == self.rows


def column_traits(df: DataFrame, columns: list[str] | None = None) -> list[ColumnTraits]:
    """One aggregation for counts, ranges and sketched distinct counts of all columns.

    A second one counts exactly the columns where the sketch leaves a decision open:
    few values, or possibly all distinct.
    """
    names = [c for c in flat_columns(df) if columns is None or c in columns]
    kinds = {c: df.schema[c].dataType for c in names}
    numbers = [c for c in names if is_numeric(kinds[c])]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~is_missing(df, c)).alias(f"p{i}") for i, c in enumerate(names)],
        *[distinct_estimate(quoted(c)).alias(f"d{i}") for i, c in enumerate(names)],
        *[F.min(as_double(df, c)).alias(f"lo_{i}") for i, c in enumerate(numbers)],
        *[F.max(as_double(df, c)).alias(f"hi_{i}") for i, c in enumerate(numbers)],
        *[F.stddev_samp(as_double(df, c)).alias(f"sd_{i}") for i, c in enumerate(numbers)],
    ).first()
    n = row["n"]
    spans = {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(numbers)}

    def open_question(i: int, c: str) -> bool:
        if row[f"d{i}"] <= 2 * FEW_VALUES:
            return True
        if row[f"p{i}"] < n or row[f"d{i}"] < n / 2:
            return False
        return not is_integral(kinds[c]) or spans[c][1] - spans[c][0] + 1 >= n

    asked = [(i, c) for i, c in enumerate(names) if open_question(i, c)]
    exact = df.agg(*[
        F.count_distinct(F.when(~is_missing(df, c), quoted(c))).alias(f"d{i}") for i, c in asked
    ]).first() if asked else {}
    known = {c: exact[f"d{i}"] for i, c in asked}
    return [
        ColumnTraits(
            name=c, numeric=is_numeric(kinds[c]), integral=is_integral(kinds[c]), rows=n, present=row[f"p{i}"],
            distinct=known.get(c, row[f"d{i}"]), unique=row[f"p{i}"] == n and known.get(c) == n,
            low=spans[c][0] if c in spans else None, high=spans[c][1] if c in spans else None,
            std=row[f"sd_{numbers.index(c)}"] if c in spans else None,
        )
        for i, c in enumerate(names)
    ]
