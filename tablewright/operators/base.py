"""The operation contract and its closed registry.

An operation is a small dataclass: its fields are the parameters, ``fit`` learns a
JSON-able state from the data it is first applied to, ``apply`` is a lazy DataFrame
transformation. ``row_wise`` operations depend on nothing but the row and the state,
so they can be replayed on new rows or on a stream; the others choose or order the
training rows and are left out of a replay.
"""

from __future__ import annotations

import dataclasses
from typing import Any, ClassVar

from pyspark.sql import DataFrame

State = dict[str, Any]


@dataclasses.dataclass
class Operation:
    name: ClassVar[str] = ""
    row_wise: ClassVar[bool] = True

    def fit(self, df: DataFrame) -> State:
        return {}

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        raise NotImplementedError

    def replay(self, df: DataFrame, state: State) -> DataFrame:
        """Apply to new rows, where some training columns (the target) may be absent."""
        return self.apply(df, state)

    def columns_used(self) -> list[str]:
        """Columns whose values the operation changes or removes."""
        return []

    def params(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self.fit(df))


OPERATIONS: dict[str, type[Operation]] = {}


def operation(name: str, row_wise: bool = True):
    """Class decorator: make a dataclass of the operation and register it."""

    def register(cls: type[Operation]) -> type[Operation]:
        made = dataclasses.dataclass(cls)
        made.name, made.row_wise = name, row_wise
        OPERATIONS[name] = made
        return made

    return register


def make_operation(spec: dict[str, Any]) -> Operation:
    """Build an operation from ``{"op": name, **params}``; unknown names raise."""
    params = dict(spec)
    name = params.pop("op", None)
    if name not in OPERATIONS:
        raise ValueError(f"no operation is called {name!r}")
    cls = OPERATIONS[name]
    known = {f.name for f in dataclasses.fields(cls)}
    unknown = sorted(set(params) - known)
    if unknown:
        raise ValueError(f"Unknown parameters for {name}: {unknown}")
    return cls(**params)
