"""Projection, filtering and type conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import ensure_columns, quoted
from tablewright.operators.base import Operation, State, operation

# Accepted type names and the SQL type each stands for.
TYPE_NAMES = {
    "int": "bigint", "int32": "int", "int64": "bigint",
    "float": "double", "float32": "float", "float64": "double",
    "str": "string", "string": "string", "object": "string", "category": "string",
    "bool": "boolean", "boolean": "boolean",
    "datetime": "timestamp_ntz", "datetime64[ns]": "timestamp_ntz", "date": "date",
}


@operation("drop_columns")
class DropColumns(Operation):
    columns: list[str]

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        ensure_columns(df, self.columns)
        return df.drop(*self.columns)

    def replay(self, df: DataFrame, state: State) -> DataFrame:
        return df.drop(*self.columns)

    def columns_used(self) -> list[str]:
        return list(self.columns)


@operation("keep_columns")
class KeepColumns(Operation):
    columns: list[str]

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        ensure_columns(df, self.columns)
        return df.select(*[quoted(c) for c in self.columns])

    def replay(self, df: DataFrame, state: State) -> DataFrame:
        return df.select(*[quoted(c) for c in self.columns if c in df.columns])


@operation("rename_columns")
class RenameColumns(Operation):
    mapping: dict[str, str]

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        return df.withColumnsRenamed({a: b for a, b in self.mapping.items() if a in df.columns})

    def columns_used(self) -> list[str]:
        return list(self.mapping)


@operation("filter_rows", row_wise=False)
class FilterRows(Operation):
    """Keep the rows for which a SQL condition is true, such as ``salary > 50000 and age < 40``."""

    condition: str

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        return df.filter(F.expr(self.condition))


@operation("convert_dtype")
class ConvertDtype(Operation):
    """Cast one column; a value that does not fit raises, or turns null with ``on_error='null'``."""

    column: str
    dtype: str
    on_error: str = "raise"

    def __post_init__(self):
        if self.dtype not in TYPE_NAMES:
            raise ValueError(f"Unknown type name: {self.dtype}")
        if self.on_error not in ("raise", "null"):
            raise ValueError("on_error must be 'raise' or 'null'")

    def _converted(self, df: DataFrame) -> Column:
        target, value = TYPE_NAMES[self.dtype], quoted(self.column)
        if self.on_error == "null":
            # try_cast has no int<->boolean<->timestamp surprises for text, the usual input
            return value.try_cast(target)
        if isinstance(df.schema[self.column].dataType, T.StringType) and target in ("bigint", "int"):
            value = F.trim(value)
        return value.cast(target)

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        ensure_columns(df, [self.column])
        return df.withColumn(self.column, self._converted(df))

    def replay(self, df: DataFrame, state: State) -> DataFrame:
        return self.apply(df, state) if self.column in df.columns else df

    def columns_used(self) -> list[str]:
        return [self.column]


def coerce_numeric(name: str) -> Column:
    """A column as double; what cannot be read as a number becomes missing."""
    value = quoted(name).try_cast("double")
    return F.when(~F.isnan(value), value)
