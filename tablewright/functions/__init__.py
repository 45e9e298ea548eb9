"""Column helpers and scalable building blocks shared by all operators."""

from tablewright.functions.columns import (
    ensure_columns,
    is_categorical,
    is_numeric,
    nan_to_null,
    quoted,
    split_columns,
)
from tablewright.functions.counts import distinct_counts, distinct_estimate, most_frequent, value_counts
from tablewright.functions.hashing import fold_of, hash_text, unit_hash
from tablewright.functions.ordering import cut_points, fill_in_order, number_rows, running_totals, slice_of
from tablewright.functions.quantiles import exact_quantiles

__all__ = [
    "cut_points", "distinct_counts", "distinct_estimate", "ensure_columns", "exact_quantiles", "fill_in_order", "fold_of",
    "hash_text", "is_categorical", "is_numeric", "most_frequent", "nan_to_null", "number_rows", "quoted",
    "running_totals", "slice_of", "split_columns", "unit_hash", "value_counts",
]
