"""Scaling of numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import as_double, is_numeric
from tablewright.operators.base import Operation, State, operation


@operation("scale_numeric")
class ScaleNumeric(Operation):
    """Shift and scale by the mean and population deviation, or by minimum and range.

    Missing values are left out of the fit and stay missing; a column without spread
    becomes 0. Columns in ``exclude`` keep their units.
    """

    method: str = "standard"
    columns: list[str] | None = None
    exclude: list[str] | None = None

    def __post_init__(self):
        if self.method not in ("standard", "minmax"):
            raise ValueError(f"method is standard or minmax, not {self.method!r}")

    def columns_used(self) -> list[str]:
        return [c for c in self.columns or [] if c not in (self.exclude or [])]

    def fit(self, df: DataFrame) -> State:
        listed = self.columns or [f.name for f in df.schema if is_numeric(f.dataType)]
        targets = [c for c in listed if c in df.columns and c not in (self.exclude or [])]
        if not targets:
            return {"scales": {}}
        low, high = (F.avg, F.stddev_pop) if self.method == "standard" else (F.min, F.max)
        row = df.agg(
            *[low(as_double(df, c)).alias(f"a{i}") for i, c in enumerate(targets)],
            *[high(as_double(df, c)).alias(f"b{i}") for i, c in enumerate(targets)],
        ).first()
        scales = {}
        for i, c in enumerate(targets):
            shift, upper = row[f"a{i}"], row[f"b{i}"]
            spread = None if shift is None else (upper if self.method == "standard" else upper - shift)
            scales[c] = [shift, spread or 1.0]
        return {"scales": scales}

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        scaled = {
            c: (as_double(df, c) - F.lit(shift)) / F.lit(spread)
            for c, (shift, spread) in state["scales"].items()
            if c in df.columns and shift is not None
        }
        return df.withColumns(scaled) if scaled else df
