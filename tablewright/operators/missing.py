"""Missing values: dropping rows and filling columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import as_double, ensure_columns, flat_columns, is_missing, is_numeric, quoted
from tablewright.functions.counts import most_frequent, value_counts
from tablewright.functions.ordering import fill_in_order
from tablewright.functions.quantiles import exact_quantiles
from tablewright.operators.base import Operation, State, operation

# The method names of the fill operation.
FILL_METHODS = ("mean", "median", "mode", "zero", "constant", "ffill", "bfill")


@operation("dropna", row_wise=False)
class DropNa(Operation):
    subset: list[str] | None = None
    how: str = "any"

    def __post_init__(self):
        if self.how not in ("any", "all"):
            raise ValueError("how must be 'any' or 'all'")

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        columns = self.subset or df.columns
        ensure_columns(df, columns)
        return df.na.drop(self.how, subset=list(columns))


@operation("fillna")
class FillNa(Operation):
    """Fill missing values.

    ``mean`` and ``median`` touch numeric columns only, ``mode`` any column, ``zero``
    numeric columns unless others are listed, ``constant`` the columns that can hold
    the value. ``ffill`` and ``bfill`` need ``order``: the columns that put the rows in
    order (and identify them), optionally within ``by`` groups.
    """

    value: Any = None
    method: str = "mean"
    columns: list[str] | None = None
    order: list[str] | None = None
    by: list[str] | None = None

    def __post_init__(self):
        if self.method not in FILL_METHODS:
            raise ValueError(f"method is one of {FILL_METHODS}, not {self.method!r}")
        if self.method == "constant" and self.value is None:
            raise ValueError("method 'constant' needs a value")
        if self.method in ("ffill", "bfill"):
            if not self.order:
                raise ValueError(f"method '{self.method}' needs order columns: a table has no row order of its own")
            self.row_wise = False

    def columns_used(self) -> list[str]:
        return list(self.columns or [])

    def _targets(self, df: DataFrame) -> list[str]:
        listed = [c for c in (self.columns or df.columns) if c in df.columns]
        if self.method in ("mean", "median"):
            return [c for c in listed if is_numeric(df.schema[c].dataType)]
        if self.method == "zero" and not self.columns:
            return [c for c in listed if is_numeric(df.schema[c].dataType)]
        if self.method == "constant" and not self.columns:
            number = isinstance(self.value, (int, float))
            return [c for c in listed if is_numeric(df.schema[c].dataType) == number]
        if self.method in ("ffill", "bfill"):
            skip = {*(self.order or []), *(self.by or [])}
            return [c for c in listed if c not in skip]
        if self.method == "mode" and not self.columns:
            return [c for c in listed if c in flat_columns(df)]
        return listed

    def fit(self, df: DataFrame) -> State:
        targets = self._targets(df)
        if not targets:
            return {"values": {}}
        if self.method == "mean":
            row = df.agg(*[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(targets)]).first()
            return {"values": {c: row[f"m{i}"] for i, c in enumerate(targets)}}
        if self.method == "median":
            found = exact_quantiles(df, targets, [0.5])
            return {"values": {c: found[c][0.5] for c in targets}}
        if self.method == "mode":
            best = most_frequent(df, value_counts(df, targets), 1)
            return {"values": {r["column"]: r["value"] for r in best.select("column", "value").collect()}}
        if self.method == "zero":
            return {"values": {c: "0" for c in targets}}
        if self.method == "constant":
            return {"values": {c: self.value for c in targets}}
        return {"columns": targets}

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        if self.method in ("ffill", "bfill"):
            ensure_columns(df, [*self.order, *(self.by or [])])
            # NaN is missing: it must neither stay nor be carried on
            gaps = {c: F.when(~is_missing(df, c), quoted(c)) for c in state["columns"] if c in df.columns}
            return fill_in_order(df.withColumns(gaps), state["columns"], self.order, self.by or (), self.method == "ffill")
        filled = {}
        for c, v in state["values"].items():
            if v is not None and c in df.columns:
                filled[c] = F.when(is_missing(df, c), self._literal(df, c, v)).otherwise(self._widened(df, c))
        return df.withColumns(filled) if filled else df

    def _kind(self, df: DataFrame, name: str) -> str:
        """Means and medians of integers are fractions: such columns widen to double."""
        if self.method in ("mean", "median"):
            return "double"
        return df.schema[name].dataType.simpleString()

    def _literal(self, df: DataFrame, name: str, value: Any) -> Column:
        return F.lit(value).cast(self._kind(df, name))

    def _widened(self, df: DataFrame, name: str) -> Column:
        return quoted(name).cast(self._kind(df, name)) if self.method in ("mean", "median") else quoted(name)

