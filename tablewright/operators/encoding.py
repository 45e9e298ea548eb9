"""Encoding of categorical columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import is_categorical, quoted
from tablewright.functions.counts import distinct_estimate
from tablewright.functions.vocabularies import read_codes, store_codes
from tablewright.operators.base import Operation, State, operation
from tablewright.session import BROADCAST_ROWS

# Vocabularies up to this size are kept as literals; larger ones become a code table.
VOCABULARY_ROWS = 10_000


def vocabulary(df: DataFrame, columns: list[str], limit: int | None) -> dict[str, list[str] | None]:
    """Sorted distinct texts per column, or None for a column with more than ``limit``.

    Columns that may exceed the limit are counted exactly before any value is collected.
    """
    items = [x for c in columns for x in (F.lit(c), quoted(c).cast("string"))]
    stacked = df.select(F.stack(F.lit(len(columns)), *items).alias("column", "value"))
    values = stacked.where("value IS NOT NULL").distinct()
    sizes = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()} \
        if limit is not None and _maybe_large(df, columns, limit) else {c: 0 for c in columns}
    small = [c for c in columns if limit is None or sizes.get(c, 0) <= limit]
    found: dict[str, list[str] | None] = {c: ([] if c in small else None) for c in columns}
    if small:
        for row in values.where(F.col("column").isin(small)).collect():
            found[row["column"]].append(row["value"])
    return {c: (sorted(v) if v is not None else None) for c, v in found.items()}


def _maybe_large(df: DataFrame, columns: list[str], limit: int) -> bool:
    """A sketch pass: only near or above the limit are the values counted exactly."""
    row = df.agg(*[distinct_estimate(quoted(c).cast("string")).alias(f"d{i}")
                   for i, c in enumerate(columns)]).first()
    return any(row[f"d{i}"] > limit / 2 for i in range(len(columns)))


@operation("encode_categorical")
class EncodeCategorical(Operation):
    """``label``: the position of the value among the sorted values; ``onehot``: a column per value.

    A missing value keeps no code (null) unless ``missing_as`` names a text for it;
    one-hot gives all false. A value not seen in the fit gets code -1. ``max_width`` lets a user
    refuse columns with more values than that; there is no limit of its own.
    """

    method: str = "label"
    columns: list[str] | None = None
    missing_as: str | None = None
    max_width: int | None = None
    max_literals: int = VOCABULARY_ROWS

    def __post_init__(self):
        if self.method not in ("label", "onehot"):
            raise ValueError(f"method is label or onehot, not {self.method!r}")

    def columns_used(self) -> list[str]:
        return list(self.columns or [])

    def _text(self, name: str) -> Column:
        text = quoted(name).cast("string")
        return F.coalesce(text, F.lit(self.missing_as)) if self.missing_as is not None else text

    def fit(self, df: DataFrame) -> State:
        listed = self.columns or [f.name for f in df.schema if is_categorical(f.dataType)]
        targets = [c for c in listed if c in df.columns]
        if not targets:
            return {"values": {}, "tables": {}}
        texts = df.select(*[self._text(c).alias(c) for c in targets])
        if self.method == "onehot":
            values = vocabulary(texts, targets, self.max_width)
            wide = [c for c, v in values.items() if v is None]
            if wide:
                raise ValueError(f"More than {self.max_width} values to one-hot in {wide}; use label encoding")
            return {"values": values, "tables": {}}
        values = vocabulary(texts, targets, self.max_literals)
        tables = {
            c: store_codes(texts.select(quoted(c).alias("value")).where("value IS NOT NULL").distinct())
            for c, v in values.items() if v is None}
        return {"values": {c: v for c, v in values.items() if v is not None}, "tables": tables}

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        if self.method == "onehot":
            return self._one_hot(df, state["values"])
        for name in df.columns:
            if name in state["values"]:
                df = self._join_codes(df, name, F.broadcast(_code_table(df, state["values"][name])))
            elif name in state["tables"]:
                stored = state["tables"][name]
                codes = read_codes(df, stored)
                small = stored["rows"] <= BROADCAST_ROWS
                df = self._join_codes(df, name, F.broadcast(codes) if small else codes)
        return df

    def _join_codes(self, df: DataFrame, name: str, codes: DataFrame) -> DataFrame:
        names = df.columns
        side = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        joined = df.withColumn("__text", self._text(name)).join(side, F.col("__text") == F.col("__value"), "left")
        code = F.when(F.col("__text").isNotNull(), F.coalesce(F.col("__code"), F.lit(-1))).cast("bigint")
        return joined.select(*[code.alias(c) if c == name else quoted(c) for c in names])

    def _one_hot(self, df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
        present = {c: v for c, v in values.items() if c in df.columns}
        kept = [quoted(c) for c in df.columns if c not in present]
        made = [
            self._text(c).eqNullSafe(F.lit(v)).alias(f"{c}_{v}") for c, vs in present.items() for v in vs
        ]
        return df.select(*kept, *made)


def _code_table(df: DataFrame, values: list[str]) -> DataFrame:
    """(value, code) rows of a vocabulary whose size was checked against the broadcast bound."""
    rows = json.dumps([{"value": v, "code": i} for i, v in enumerate(values)])
    one = df.sparkSession.range(1)
    return one.select(F.inline(F.from_json(F.lit(rows), "array<struct<value:string,code:bigint>>")))

