"""Repeatable pseudo-random numbers from row keys.

``rand`` and ``sample`` depend on how the rows are spread over partitions; a hash of
the seed and the key does not, so a split stays the same on any cluster and after
any task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import flat_columns, quoted


def hash_text(key: Sequence[str], seed: int) -> Column:
    """md5 of ``seed:key1:key2...`` as 32 hex digits; a null key part reads as empty."""
    parts = [F.coalesce(quoted(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hash_number(key: Sequence[str], seed: int) -> Column:
    """The first eight hex digits of :func:`hash_text` as a number below 2**32."""
    return F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("bigint")


def unit_hash(key: Sequence[str], seed: int) -> Column:
    """A repeatable number in [0, 1)."""
    return hash_number(key, seed) / F.lit(float(2**32))


def fold_of(key: Sequence[str], seed: int, folds: int) -> Column:
    return (hash_number(key, seed) % folds).cast("int")


def default_key(df: DataFrame) -> list[str]:
    """Without a declared key all flat columns together identify a row."""
    return flat_columns(df)
