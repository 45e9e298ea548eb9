"""Operations that choose rows: de-duplication, sampling, head."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import ensure_columns, flat_columns, quoted
from tablewright.functions.hashing import hash_text, unit_hash
from tablewright.functions.ordering import first_rows
from tablewright.operators.base import Operation, State, operation


@operation("drop_duplicates", row_wise=False)
class DropDuplicates(Operation):
    """Keep one row per distinct row, or the first per ``subset`` in ``order``.

    The first row is found by a minimum over (order, row), which combines map-side,
    so a value shared by a third of the rows costs one row per task in the shuffle.
    """

    subset: list[str] | None = None
    order: list[str] | None = None

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        if not self.subset:
            return df.dropDuplicates()
        ensure_columns(df, [*self.subset, *(self.order or [])])
        order = self.order or flat_columns(df)
        rest = [c for c in df.columns if c not in self.subset]
        whole = F.struct(*[quoted(c).alias(f"r{i}") for i, c in enumerate(rest)])
        first = F.min_by(whole, F.struct(*[quoted(c) for c in order]))
        kept = df.groupBy(*[quoted(c) for c in self.subset]).agg(first.alias("__first"))
        place = {c: F.col("__first")[f"r{i}"].alias(c) for i, c in enumerate(rest)}
        return kept.select(*[place.get(c, quoted(c)) for c in df.columns])


@operation("sample_rows", row_wise=False)
class SampleRows(Operation):
    """Exactly ``n`` rows, or exactly the rounded share ``frac``, without replacement.

    The rows with the smallest seeded hash of ``key`` are taken: repeatable on any
    cluster. Without ``key`` all flat columns together are the key.
    """

    n: int | None = None
    frac: float | None = None
    random_state: int = 42
    key: list[str] | None = None

    def __post_init__(self):
        if self.n is not None and self.frac is not None:
            raise ValueError("Give n or frac, not both")
        if self.frac is not None and not 0 <= self.frac <= 1:
            raise ValueError("frac must lie between 0 and 1")

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        if self.n is None and self.frac is None:
            n = 1
        else:
            n = self.n if self.n is not None else round(self.frac * df.count())
        key = self.key or flat_columns(df)
        ensure_columns(df, key)
        hashed = df.withColumn("__hash", hash_text(key, self.random_state))
        return first_rows(hashed, n, ["__hash", *key], unit_hash(key, self.random_state)).drop("__hash")


@operation("head_rows", row_wise=False)
class HeadRows(Operation):
    """The first ``n`` rows in ``order`` (all flat columns when none is given)."""

    n: int = 100
    order: list[str] | None = None

    def apply(self, df: DataFrame, state: State) -> DataFrame:
        order = self.order or flat_columns(df)
        ensure_columns(df, order)
        return first_rows(df, self.n, order)
