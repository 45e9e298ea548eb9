"""Ordered computations without a one-task window.

A running total, a row number or a fill over a whole table needs the rows in order,
but ``Window.orderBy`` alone sends everything to one task, and ``partitionBy(key)``
does the same for a key that holds a large share of the rows. The helpers here cut
the order into slices at sampled cut points, run the window inside
``(group, slice)``, and carry a small per-slice summary from slice to slice.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.functions.columns import quoted
from tablewright.session import MAX_SLICES

# A head of up to this many rows is a top-k (kept per task, merged in one).
TOP_K_ROWS = 500
# Slices that a longer head is counted in, and how often the last one may be cut again.
SELECT_SLICES, SELECT_LEVELS = 256, 4

_SLICE = "__slice"
_GROUP = "__group"
_CUT_TEXT = 256


def slice_count(df: DataFrame) -> int:
    """As many slices as the session's shuffles have partitions, within a fixed bound."""
    return max(1, min(MAX_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, order: Sequence[str], slices: int) -> tuple[str, str]:
    """Cut points of the order as (JSON array, array type).

    The sample takes about 32 rows per slice, each where it lies: the rows are counted
    first, so that only the wanted ones leave their tasks. It is drawn per row, not per
    distinct value, so crowded ranges get more cuts. Any value may serve as a cut, and
    no result depends on which; long texts are shortened here, rows are compared whole.
    """
    keys = [_short(df, c).alias(f"k{i}") for i, c in enumerate(order)]
    tuples = df.select(F.struct(*keys).alias("k"))
    kind = f"array<{tuples.schema['k'].dataType.simpleString()}>"
    if slices <= 1:
        return "[]", kind
    rows = df.select(F.count(F.lit(1)).alias("n")).first()["n"]
    sample = (
        tuples.sample(fraction=min(1.0, 32 * slices / max(1, rows)), seed=16)
        .agg(F.to_json(F.sort_array(F.collect_list("k")), {"ignoreNullFields": "false"}).alias("j"))
        .first()["j"]
    )
    drawn = json.loads(sample or "[]")
    step = len(drawn) / slices
    picks = [drawn[int(i * step)] for i in range(1, slices)] if drawn else []
    unique = [p for i, p in enumerate(picks) if i == 0 or p != picks[i - 1]]
    return json.dumps(unique), kind


def _short(df: DataFrame, name: str) -> Column:
    text = isinstance(df.schema[name].dataType, T.StringType)
    return F.substring(quoted(name), 1, _CUT_TEXT) if text else quoted(name)


def slice_of(order: Sequence[str], cuts: tuple[str, str]) -> Column:
    """Index of the slice a row falls in: the number of cut points at or below it."""
    points, kind = cuts
    count = len(json.loads(points))
    if count == 0:
        return F.lit(0)
    table = F.sort_array(F.from_json(F.lit(points), kind))
    key = F.struct(*[quoted(c).alias(f"k{i}") for i, c in enumerate(order)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(count.bit_length()))])

    def halve(at: Column, step: Column) -> Column:
        ahead = at + step
        return F.when((ahead <= count) & (F.get(table, ahead - 1) <= key), ahead).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def _sliced(df: DataFrame, order: Sequence[str], slices: int | None) -> DataFrame:
    wanted = slice_count(df) if slices is None else slices
    return df.withColumn(_SLICE, slice_of(order, cut_points(df, order, wanted)))


def _share(df: DataFrame, share: Column, slices: int | None) -> DataFrame:
    wanted = slice_count(df) if slices is None else slices
    return df.withColumn(_SLICE, F.floor(share * wanted).cast("int"))


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add the group as one struct column: null parts compare as equal, so the window and
    the join on it need the same partitioning and the rows are shuffled once."""
    if not by:
        return df, []
    return df.withColumn(_GROUP, F.struct(*[quoted(b).alias(f"b{i}") for i, b in enumerate(by)])), [_GROUP]


def _join_slices(rows: DataFrame, summary: DataFrame, group: list[str]) -> DataFrame:
    """Attach a per-slice summary; without groups it has at most MAX_SLICES rows."""
    return rows.join(summary if group else F.broadcast(summary), [*group, _SLICE], "left")


def running_totals(
    df: DataFrame, order: Sequence[str], totals: dict[str, Column], by: Sequence[str] = (),
    slices: int | None = None, share: Column | None = None, with_total: bool = False,
) -> DataFrame:
    """Add, for each name in ``totals``, the running sum up to and including the row.

    ``order`` must identify a row within its group. Where the order starts with a
    hash, ``share`` (the hash as a number in [0, 1)) gives the slices without a sample.
    ``with_total`` adds the group's whole sum as ``<name>_total``.
    """
    start, group = _grouped(df.withColumns({f"__t_{n}": e for n, e in totals.items()}), by)
    sliced = _sliced(start, order, slices) if share is None else _share(start, share, slices)
    local = Window.partitionBy(*group, _SLICE).orderBy(*[quoted(c) for c in order])
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summary = sliced.groupBy(*group, _SLICE).agg(*[F.sum(f"__t_{n}").alias(f"__s_{n}") for n in totals])
    whole = {f"{n}_total": F.sum(f"__s_{n}").over(Window.partitionBy(*group)) for n in totals} if with_total else {}
    summary = summary.select(
        *group, _SLICE,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in totals],
        *[e.alias(n) for n, e in whole.items()],
    )
    rows = sliced.withColumns({n: F.sum(f"__t_{n}").over(local) for n in totals})
    joined = _join_slices(rows, summary, group).withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in totals})
    return joined.select(*[quoted(c) for c in df.columns], *totals, *whole)


def number_rows(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position",
    slices: int | None = None, share: Column | None = None, with_total: bool = False,
) -> DataFrame:
    """Add the 1-based position of each row in its group, as ``row_number`` would."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by, slices, share, with_total)


def first_rows(df: DataFrame, n: int, order: Sequence[str], share: Column | None = None) -> DataFrame:
    """The ``n`` first rows in ``order`` (in any order beyond ``TOP_K_ROWS``).

    A short head is a top-k. A longer one is selected where the rows lie: they are counted per slice of the order, all
    slices before the one in which the ``n``-th row falls are taken by a filter, and only that slice is cut again, until
    a short head of it is left. No row is shuffled for it, but for those of the last slice. Where ``order`` starts with a hash,
    ``share`` (the hash as a number in [0, 1)) gives the slices without a sample.
    """
    if n <= TOP_K_ROWS:
        return df.orderBy(*[quoted(c) for c in order]).limit(max(n, 0))
    taken, rest, left, before = [], df, n, 0
    for level in range(1, SELECT_LEVELS + 1):
        if share is None:
            at = slice_of(order, cut_points(rest, order, SELECT_SLICES))
        else:
            at = (F.floor(share * SELECT_SLICES**level) - before * SELECT_SLICES).cast("int")
        counted = sorted((r["at"], r["n"]) for r in rest.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect())
        whole, last = 0, None
        for number, rows in counted:
            if whole + rows > left:
                last = number
                break
            whole += rows
        if last is None:  # all that is left belongs to the head
            return reduce(DataFrame.unionByName, [*taken, rest])
        if whole:
            taken.append(rest.where(at < last))
        rest, left, before = rest.where(at == last), left - whole, before * SELECT_SLICES + last
        if left <= TOP_K_ROWS or share is None and len(counted) == 1:
            break
    if left <= TOP_K_ROWS:
        taken.append(rest.orderBy(*[quoted(c) for c in order]).limit(left))
    else:  # the order's beginnings don't tell these rows apart
        ranked = number_rows(rest, order, name="__position")
        taken.append(ranked.where(F.col("__position") <= left).drop("__position"))
    return reduce(DataFrame.unionByName, taken)


def fill_in_order(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (),
    forward: bool = True, slices: int | None = None,
) -> DataFrame:
    """Replace nulls by the nearest present value before (or after) the row.

    Inside a slice a window does it; a slice that starts (ends) with nulls takes the
    last (first) present value of the slices before (after) it.
    """
    start, group = _grouped(df, by)
    sliced = _sliced(start, order, slices)
    keys = [quoted(c) for c in order]
    position = F.struct(*keys)
    inside = Window.partitionBy(*group, _SLICE).orderBy(*keys)
    across = Window.partitionBy(*group).orderBy(_SLICE)
    if forward:
        inside, across = inside.rowsBetween(Window.unboundedPreceding, 0), across.rowsBetween(Window.unboundedPreceding, -1)
        near, edge = F.last, F.max_by
    else:
        inside, across = inside.rowsBetween(0, Window.unboundedFollowing), across.rowsBetween(1, Window.unboundedFollowing)
        near, edge = F.first, F.min_by
    summary = sliced.groupBy(*group, _SLICE).agg(
        *[edge(quoted(c), F.when(quoted(c).isNotNull(), position)).alias(f"__e{i}") for i, c in enumerate(columns)]
    )
    summary = summary.select(
        *group, _SLICE,
        *[near(f"__e{i}", ignorenulls=True).over(across).alias(f"__c{i}") for i in range(len(columns))],
    )
    rows = sliced.withColumns({f"__f{i}": near(quoted(c), ignorenulls=True).over(inside) for i, c in enumerate(columns)})
    joined = _join_slices(rows, summary, group)
    filled = joined.withColumns({c: F.coalesce(F.col(f"__f{i}"), F.col(f"__c{i}")) for i, c in enumerate(columns)})
    return filled.select(*[quoted(c) for c in df.columns])
