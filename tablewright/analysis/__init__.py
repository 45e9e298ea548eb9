"""Profiling, column facts and rule-based advice."""

from tablewright.analysis.advice import (
    apply_suggested, detect_task_type, prune_columns, suggest_preprocessing, suggest_target, task_of,
)
from tablewright.analysis.profile import (
    basic_shape, categorical_insights, correlation_matrix, dataset_digest, describe, duplicate_rows,
    missing_values, numeric_insights, summary_report, target_categorical, target_correlations, target_numeric,
)
from tablewright.analysis.traits import ColumnTraits, column_traits

__all__ = [
    "ColumnTraits", "apply_suggested", "basic_shape", "categorical_insights", "column_traits",
    "correlation_matrix", "dataset_digest", "describe", "detect_task_type", "duplicate_rows",
    "missing_values", "numeric_insights", "prune_columns", "suggest_preprocessing", "suggest_target",
    "summary_report", "target_categorical", "target_correlations", "target_numeric", "task_of",
]
