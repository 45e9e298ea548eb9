"""Rules that suggest a target column and a cleaning chain."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from tablewright.analysis.traits import FEW_VALUES, ColumnTraits, column_traits
from tablewright.plans import FittedPlan

# Thresholds of the task rule.
CLASS_VALUES = 10
DENSE_SHARE = 0.5


def task_of(traits: ColumnTraits) -> str:
    """Regression or classification, from a target column's facts.

    Text is classified; so are numbers with few values, and whole numbers with some
    values that cover their range only sparsely.
    """
    if not traits.numeric or traits.distinct <= CLASS_VALUES:
        return "classification"
    if traits.integral and traits.distinct <= FEW_VALUES:
        dense = traits.distinct / (traits.high - traits.low + 1) > DENSE_SHARE
        return "regression" if dense else "classification"
    return "regression"


def detect_task_type(df: DataFrame, target: str, task: str | None = None) -> str:
    return task or task_of(column_traits(df, [target])[0])


def suggest_target(df: DataFrame, preferred: str | None = None) -> dict[str, Any]:
    """The numeric column that varies most, else the first text column with few values."""
    if preferred is not None and preferred in df.columns:
        return {"target_column": preferred, "task_type": detect_task_type(df, preferred), "source": "user"}
    traits = column_traits(df)
    numeric = [t for t in traits if t.numeric and t.present > 1 and t.distinct > 1 and not (t.unique and t.low == 1)]
    texts = [t for t in traits if not t.numeric and t.distinct <= CLASS_VALUES]
    if numeric:
        best = max(numeric, key=lambda t: t.std)
    elif texts:
        best = texts[0]
    else:
        raise ValueError("no column varies enough to be predicted")
    return {"target_column": best.name, "task_type": task_of(best), "source": "heuristic"}


def suggest_preprocessing(df: DataFrame, target: str | None = None) -> list[dict[str, Any]]:
    """Drop constant, key-like and all-distinct text columns, fill what is missing, scale."""
    traits = column_traits(df)
    useless = [t for t in traits if t.name != target and (
        t.constant
        or (t.numeric and t.unique and t.rows > 1 and t.low == 1 and t.name.lower().endswith("id"))
        or (not t.numeric and t.unique)
    )]
    chain: list[dict[str, Any]] = [{"op": "drop_columns", "columns": [t.name]} for t in useless]
    if any(t.present < t.rows for t in traits):
        chain.append({"op": "fillna", "method": "median" if target else "mean"})
    if sum(t.numeric for t in traits if t.name != target) > 1:
        scaling: dict[str, Any] = {"op": "scale_numeric", "method": "standard"}
        if target:
            scaling["exclude"] = [target]
        chain.append(scaling)
    return chain


def apply_suggested(df: DataFrame, target: str | None = None) -> DataFrame:
    """Suggest a chain and apply it."""
    return FittedPlan.fit(df, suggest_preprocessing(df, target)).apply(df)


def prune_columns(traits: Sequence[ColumnTraits]) -> dict[str, str]:
    """Column names that carry nothing for a model, with the reason."""
    reasons = {}
    for t in traits:
        if t.constant:
            reasons[t.name] = "constant"
        elif not t.numeric and t.unique:
            reasons[t.name] = "unique text"
        elif t.numeric and t.sequential and t.name.lower().endswith("id"):
            reasons[t.name] = "sequential id"
    return reasons
