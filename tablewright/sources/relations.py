"""Relations between columns, whatever their names: whose values all occur in a key of another table.

All columns that can take part are read once. Each value becomes a short digest with one bit for
its column; the bits of equal values are united (in each task first, so a frequent value is
small work), equal bit sets are counted, and a column's parents are the bits that all sets
with the column's bit share. What reaches the driver is one row per column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import NESTED, is_integral, quoted

# Columns per 64-bit word of a bit set.
WORD = 63
# Ranges of texts are compared by their beginnings, which order as the texts do.
BEGINNING = 64

Place = tuple[str, str]


def value_class(dtype: T.DataType) -> str | None:
    """Columns of one class can hold equal values: all whole numbers, else the same type."""
    if isinstance(dtype, NESTED):
        return None
    return "whole" if is_integral(dtype) else dtype.simpleString()


def open_pairs(tables: dict[str, DataFrame], keys: Sequence[Place], agree: Callable[[str, str], bool] | None = None) -> list[tuple[Place, Place]]:
    """(column, key) pairs of different tables and one class; ``agree`` may restrict the names."""
    return [
        ((child, f.name), (parent, key))
        for parent, key in keys
        for child, df in tables.items() if child != parent
        for f in df.schema
        if value_class(f.dataType) is not None
        and value_class(f.dataType) == value_class(tables[parent].schema[key].dataType)
        and (agree is None or agree(f.name, key))
    ]


def ranges(tables: dict[str, DataFrame], places: Sequence[Place], side_by_side: Callable) -> dict[Place, tuple]:
    """Smallest and largest value per column, texts cut to their beginnings; one scan per table."""
    wanted: dict[str, list[str]] = {}
    for table, column in sorted(set(places)):
        wanted.setdefault(table, []).append(column)

    def span(table: str) -> dict:
        values = [_bounded(tables[table], c) for c in wanted[table]]
        row = tables[table].agg(
            *[f(v).alias(f"{k}{i}") for i, v in enumerate(values) for k, f in (("lo", F.min), ("hi", F.max))]).first()
        return {(table, c): (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(wanted[table])}

    return {k: v for found in side_by_side(span, list(wanted)) for k, v in found.items()}


def _bounded(df: DataFrame, column: str) -> Column:
    dtype, value = df.schema[column].dataType, quoted(column)
    if isinstance(dtype, T.StringType):
        return F.substring(value, 1, BEGINNING)
    return F.nanvl(value, F.lit(None)) if isinstance(dtype, (T.DoubleType, T.FloatType)) else value


def within(inner: tuple, outer: tuple) -> bool:
    """Whether the range may lie inside the other; a range without values lies in none."""
    return inner[0] is not None and outer[0] is not None and outer[0] <= inner[0] and inner[1] <= outer[1]


def included(tables: dict[str, DataFrame], places: Sequence[Place]) -> dict[Place, tuple[int, set[Place]]]:
    """Per column: its number of distinct values and the columns that hold all of them.

    One shuffle of the distinct (class, digest) pairs, whose size no frequent value adds to.
    """
    places = sorted(set(places))
    if not places:
        return {}
    at = {p: i for i, p in enumerate(places)}
    words = [f"w{i}" for i in range(-(-len(places) // WORD))]
    values = reduce(DataFrame.unionByName, [_digests(tables[t], [p for p in places if p[0] == t], at, len(words)) for t in {t for t, _ in places}])
    united = values.groupBy("kind", "digest").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = united.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    held = F.filter(
        F.sequence(F.lit(0), F.lit(len(places) - 1)),
        lambda i: F.get(F.array(*words), (i / WORD).cast("int")).bitwiseAND(F.expr("1L") * F.pow(F.lit(2), i % WORD).cast("long")) != 0)
    rows = sets.withColumn("place", F.explode(held)).groupBy("place").agg(
        F.sum("n").alias("n"), *[F.bit_and(w).alias(w) for w in words]).collect()
    found = {p: (0, set()) for p in places}
    for r in rows:
        others = {p for p, i in at.items() if r[words[i // WORD]] >> i % WORD & 1}
        found[places[r["place"]]] = (r["n"], others - {places[r["place"]]})
    return found


def _digests(df: DataFrame, places: list[Place], at: dict[Place, int], n_words: int) -> DataFrame:
    """(kind, digest, one bit in one of the words) of every present value."""
    each = []
    for place in places:
        value, dtype = quoted(place[1]), df.schema[place[1]].dataType
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0).cast(dtype)  # zero has one sign
        bits = [F.lit(1 << at[place] % WORD if w == at[place] // WORD else 0).cast("long").alias(f"w{w}") for w in range(n_words)]
        each.append(F.struct(F.lit(value_class(dtype)).alias("kind"), F.unhex(F.md5(value.cast("string"))).alias("digest"), *bits))
    return df.select(F.explode(F.array(*each)).alias("v")).select("v.*").where("digest IS NOT NULL")
