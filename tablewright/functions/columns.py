"""Column classes, name handling and null rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def quoted(name: str) -> Column:
    """The column called exactly ``name``, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans, the columns that statistics and scaling apply to."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_categorical(dtype: T.DataType) -> bool:
    """Everything that is not numeric: text, dates, times."""
    return not is_numeric(dtype) and not isinstance(dtype, NESTED)


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the categorical columns, in table order."""
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    categorical = [f.name for f in df.schema if is_categorical(f.dataType)]
    return numeric, categorical


def flat_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]


def ensure_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise a ``ValueError`` that lists the names missing from ``df``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"the table has no columns {missing}")


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric column as double, with NaN read as missing."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return quoted(name).cast("int").cast("double")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = quoted(name).cast("double")
        return F.when(~F.isnan(value), value)
    return quoted(name).cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return quoted(name).isNull() | F.isnan(quoted(name))
    return quoted(name).isNull()


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into null in the floating-point columns.

    Kept apart from table loading: a column wrapped in an expression can no longer
    be filtered inside the parquet reader.
    """
    wanted = set(df.columns if columns is None else columns)
    floating = [
        f.name for f in df.schema
        if f.name in wanted and isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({n: F.when(~F.isnan(quoted(n)), quoted(n)) for n in floating}) if floating else df


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
