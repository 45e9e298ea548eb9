"""Tables, record files and sinks."""

from tablewright.sources.catalog import TableSource, unique_columns
from tablewright.sources.records import (
    parse_json, prediction_rows, read_csv, read_json, records, rows_to_json, save_dataset, write_csv,
)

__all__ = [
    "TableSource", "parse_json", "prediction_rows", "read_csv", "read_json", "records", "rows_to_json",
    "save_dataset", "unique_columns", "write_csv",
]
