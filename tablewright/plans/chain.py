"""Chains of operations: fit once, replay on new rows, save and load."""

from __future__ import annotations

import copy
import json
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.base import Operation, State, make_operation
from tablewright.session import read_text, write_text

Spec = dict[str, Any]


def validate_specs(specs: Sequence[Spec], target: str | None = None) -> list[Operation]:
    """Build the operations; those that would change the target column are refused."""
    operations = [make_operation(s) for s in specs]
    touching = [o.name for o in operations if target is not None and target in o.columns_used()]
    if touching:
        raise ValueError(f"Operations change the target column '{target}': {touching}")
    return operations


class FittedPlan:
    """Operations in order, each with the state it learned from the training data."""

    def __init__(self, steps: list[tuple[Operation, State]]):
        self.steps = steps

    @classmethod
    def fit(cls, df: DataFrame, specs: Sequence[Spec | Operation]) -> FittedPlan:
        """Fit every operation on the output of the ones before it.

        Operations without a state run no job here: the chain stays one lazy plan.
        """
        steps, current = [], df
        for spec in specs:
            op = spec if isinstance(spec, Operation) else make_operation(spec)
            state = op.fit(current)
            current = op.apply(current, state)
            steps.append((op, state))
        return cls(steps)

    def apply(self, df: DataFrame) -> DataFrame:
        """The whole chain, as it was applied to the training data."""
        for op, state in self.steps:
            df = op.apply(df, state)
        return df

    def replay(self, df: DataFrame) -> DataFrame:
        """The row-wise operations only: for prediction rows and for streams.

        Nothing is learned again and no row is dropped or reordered; columns that
        the new rows lack (the target) are passed over.
        """
        for op, state in self.steps:
            if op.row_wise:
                df = op.replay(df, state)
        return df

    def lineage(self, df: DataFrame) -> DataFrame:
        """(step, operation, params, rows_in, rows_out, columns_out) of the chain on ``df``.

        Only steps that choose rows are counted, all in one job over pruned columns;
        the others pass their row count on.
        """
        current, widths = df, []
        counted = {0: df}
        for i, (op, state) in enumerate(self.steps):
            current = op.apply(current, state)
            widths.append(len(current.columns))
            if not op.row_wise:
                counted[i + 1] = current
        parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("step"), "n") for i, d in counted.items()]
        known = {r["step"]: r["n"] for r in reduce(DataFrame.unionByName, parts).collect()}
        counts = [known[0]]
        for i in range(len(self.steps)):
            counts.append(known.get(i + 1, counts[-1]))
        rows = [
            (i + 1, op.name, json.dumps(op.params(), sort_keys=True), counts[i], counts[i + 1], widths[i])
            for i, (op, _) in enumerate(self.steps)
        ]
        schema = "step int, operation string, params string, rows_in bigint, rows_out bigint, columns_out int"
        return df.sparkSession.createDataFrame(rows, schema)

    def save(self, spark, path: str) -> None:
        """Write the states as JSON; large code tables are copied beside it."""
        steps = []
        for i, (op, state) in enumerate(self.steps):
            state = copy.deepcopy(state)
            for j, stored in enumerate((state.get("tables") or {}).values()):
                target = f"{path}/codes-{i}-{j}"
                spark.read.parquet(stored["path"]).write.mode("overwrite").parquet(target)
                stored["path"] = target
            steps.append({"op": op.name, "params": op.params(), "state": state})
        write_text(spark, f"{path}/plan", json.dumps(steps, default=str))

    @classmethod
    def load(cls, spark, path: str) -> FittedPlan:
        steps = json.loads(read_text(spark, f"{path}/plan"))
        return cls([(make_operation({"op": s["op"], **s["params"]}), s["state"]) for s in steps])


def apply_operations(df: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Fit and apply a list of ``{"op": name, **params}``."""
    return FittedPlan.fit(df, specs).apply(df)
