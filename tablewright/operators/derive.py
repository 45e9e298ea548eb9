"""New columns from existing ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import as_double, ensure_columns, quoted
from tablewright.operators.base import Operation, State, operation


def _both(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


@operation("create_ratio")
class CreateRatio(Operation):
    """``numerator / denominator``; a zero denominator gives a missing value."""

    numerator: str
    denominator: str
    new_column: str

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        ensure_columns(df, [self.numerator, self.denominator])
        ratio = F.try_divide(as_double(df, self.numerator), as_double(df, self.denominator))
        return df.withColumn(self.new_column, ratio)

    def replay(self, df: DataFrame, state: State) -> DataFrame:
        return self.apply(df, state) if _both(df, self.numerator, self.denominator) else df

    def columns_used(self) -> list[str]:
        return [self.numerator, self.denominator]


@operation("create_product")
class CreateProduct(Operation):
    col1: str
    col2: str
    new_column: str

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        ensure_columns(df, [self.col1, self.col2])
        return df.withColumn(self.new_column, quoted(self.col1) * quoted(self.col2))

    def replay(self, df: DataFrame, state: State) -> DataFrame:
        return self.apply(df, state) if _both(df, self.col1, self.col2) else df

    def columns_used(self) -> list[str]:
        return [self.col1, self.col2]


@operation("create_difference")
class CreateDifference(Operation):
    col1: str
    col2: str
    new_column: str

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        ensure_columns(df, [self.col1, self.col2])
        return df.withColumn(self.new_column, quoted(self.col1) - quoted(self.col2))

    def replay(self, df: DataFrame, state: State) -> DataFrame:
        return self.apply(df, state) if _both(df, self.col1, self.col2) else df

    def columns_used(self) -> list[str]:
        return [self.col1, self.col2]


@operation("create_bins")
class CreateBins(Operation):
    """Equal-width bins over the fitted minimum and maximum, closed on the right.

    The lowest edge lies 0.1% of the range below the minimum, so the minimum has a bin.
    ``output`` is ``label`` (text such as ``(0.9, 10.0]``), ``index`` (0-based) or
    ``interval`` (a struct of the two edges). Values outside the fitted range, which
    only new rows can have, and missing values get null.
    """

    column: str
    bins: int
    new_column: str | None = None
    output: str = "label"

    def __post_init__(self):
        if int(self.bins) < 1:
            raise ValueError("bins must be positive")
        if self.output not in ("label", "index", "interval"):
            raise ValueError("output must be 'label', 'index' or 'interval'")

    def columns_used(self) -> list[str]:
        return [self.column]

    def fit(self, df: DataFrame) -> State:
        ensure_columns(df, [self.column])
        value = as_double(df, self.column)
        row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        return {"edges": bin_edges(row["lo"], row["hi"], int(self.bins)) if row["lo"] is not None else []}

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        ensure_columns(df, [self.column])
        name = self.new_column or f"{self.column}_binned"
        edges = state["edges"]
        if not edges:
            return df.withColumn(name, F.lit(None).cast("string"))
        return df.withColumn(name, self._output(bin_index(as_double(df, self.column), edges), edges))

    def replay(self, df: DataFrame, state: State) -> DataFrame:
        return self.apply(df, state) if self.column in df.columns else df

    def _output(self, index: Column, edges: list[float]) -> Column:
        if self.output == "index":
            return index
        if self.output == "label":
            return F.get(F.array(*[F.lit(t) for t in bin_labels(edges)]), index)
        table = F.array(*[F.lit(float(e)) for e in edges])
        return F.when(index.isNotNull(), F.struct(F.get(table, index).alias("lo"), F.get(table, index + 1).alias("hi")))


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """``bins + 1`` edges; a column without spread is widened by 0.1% of its size."""
    if low == high:
        pad = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - pad, high + pad
        step = (high - low) / bins
        return [low + i * step for i in range(bins)] + [high]
    step = (high - low) / bins
    edges = [low + i * step for i in range(bins)] + [high]
    edges[0] = low - 0.001 * (high - low)
    return edges


def bin_index(value: Column, edges: list[float]) -> Column:
    """0-based bin of a value: the position of the first edge at or above it, less one."""
    low, high = edges[0], edges[-1]
    inside = (value > F.lit(low)) & (value <= F.lit(high))
    return F.when(inside, _search(value, edges, 1, len(edges) - 1))


def _search(value: Column, edges: list[float], first: int, last: int) -> Column:
    """Nested comparisons, as deep as the logarithm of the bin count."""
    if first == last:
        return F.lit(first - 1)
    middle = (first + last) // 2
    return F.when(value <= F.lit(edges[middle]), _search(value, edges, first, middle)).otherwise(
        _search(value, edges, middle + 1, last)
    )


def bin_labels(edges: list[float]) -> list[str]:
    """Texts of the bins, with as many digits (three or more) as keep the edges apart."""
    for digits in range(3, 20):
        shown = [_rounded(e, digits) for e in edges]
        if len(set(shown)) == len(edges):
            break
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]


def _rounded(x: float, digits: int) -> float:
    """Round to ``digits`` places, or to that many significant digits below one."""
    if x == 0 or not math.isfinite(x):
        return float(x)
    if abs(x) < 1:
        digits += -math.floor(math.log10(abs(x))) - 1
    return round(float(x), digits)
