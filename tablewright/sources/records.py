"""Files of rows: CSV and JSON records in, tables and CSV out."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.columns import nan_to_null
from tablewright.session import path_exists
from tablewright.sources.catalog import TableSource


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of CSV files with a header; types come from ``schema``, else from an extra scan."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    reader = spark.read.option("header", True).option("enforceSchema", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of JSON-lines files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null(reader.json(path))


def parse_json(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Replace a column of JSON texts by the fields of ``schema``."""
    parsed = df.withColumn("__record", F.from_json(F.col(column), schema))
    return parsed.select(*[c for c in df.columns if c != column], "__record.*")


def records(spark: SparkSession, data: str | dict[str, Any] | list[dict[str, Any]], schema=None) -> DataFrame:
    """A few records given in code or as JSON text: one object or an array of objects."""
    if isinstance(data, str):
        try:
            data = json.loads(data)
        except json.JSONDecodeError as error:
            raise ValueError(f"Invalid JSON: {error}") from error
    rows = [data] if isinstance(data, dict) else data
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("records must be a JSON object or an array of objects")
    if schema is None:
        return spark.createDataFrame(rows)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [f for f in wanted if any(f.name in r for r in rows)]
    return spark.createDataFrame([[_fit(r.get(f.name), f.dataType) for f in fields] for r in rows],
                                 T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def _fit(value: Any, dtype: T.DataType) -> Any:
    """JSON has one number type: a whole number is accepted where a fraction is expected."""
    return float(value) if isinstance(dtype, (T.DoubleType, T.FloatType)) and isinstance(value, int) else value


def prediction_rows(spark: SparkSession, json_text=None, csv_path: str | None = None, schema=None) -> DataFrame | None:
    """The rows to score from JSON or from a CSV file, not from both."""
    if json_text is not None and csv_path is not None:
        raise ValueError("Give JSON records or a CSV file, not both")
    if json_text is not None:
        return records(spark, json_text, schema)
    return read_csv(spark, csv_path, schema) if csv_path is not None else None


def rows_to_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text; NaN, which JSON lacks, is written as null."""
    clean = nan_to_null(df)
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns]),
                                  {"ignoreNullFields": "false"}).alias(column))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header, written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_dataset(
    df: DataFrame, folder: str, table: str | None = None, originals: TableSource | None = None,
    names: Sequence[str] | None = None,
) -> str:
    """Write ``df`` as table ``table`` of ``folder``, replacing it; optionally all source tables beside it.

    The source is only read. Without a name, or with a query's label, the table is
    called ``preprocessed_data``.
    """
    table = "preprocessed_data" if not table or table.startswith("query:") else table
    df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    if originals is not None:
        for name in names or originals.list_tables():
            if name != table:
                originals.table(name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder
