"""Exact quantiles at any table size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import as_double
from tablewright.session import DRIVER_ROWS

# Up to this many values the built-in exact aggregate is the faster way; it keeps
# every distinct value in one buffer, so larger columns take the bracket search.
BUILTIN_ROWS = 200_000
# Sketch size, and about how far its ranks are off (as a share of the values).
_SKETCH = 4_096
_ERROR = 0.0015


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], builtin_rows: int = BUILTIN_ROWS,
    gather_rows: int = DRIVER_ROWS,
) -> dict[str, dict[float, float | None]]:
    """Linearly interpolated quantiles of the present values, as the median is defined.

    Large columns: a sketch brackets each wanted rank, one scan counts the values
    below and inside the bracket, and the bracket shrinks until few values lie strictly
    inside; only that last handful, counted by value, reaches the driver.
    """
    if not columns:
        return {}
    plain = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    probs = list(probs)
    counted = plain.agg(
        *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.min(f"c{i}").alias(f"lo{i}") for i in range(len(columns))],
        *[F.max(f"c{i}").alias(f"hi{i}") for i in range(len(columns))],
    ).first()
    sizes = [counted[f"n{i}"] for i in range(len(columns))]
    if max(sizes) <= builtin_rows:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        row = plain.agg(*[F.percentile(f"c{i}", levels).alias(f"q{i}") for i in range(len(columns))]).first()
        return {c: dict(zip(probs, row[f"q{i}"] or [None] * len(probs))) for i, c in enumerate(columns)}

    result: dict[str, dict[float, float | None]] = {c: {p: None for p in probs} for c in columns}
    open_: list[dict] = []
    for i, c in enumerate(columns):
        for p in probs:
            if sizes[i]:
                at = (sizes[i] - 1) * p
                open_.append({
                    "column": c, "i": i, "p": p, "first": math.floor(at), "second": math.ceil(at),
                    "part": at - math.floor(at), "lo": counted[f"lo{i}"], "hi": counted[f"hi{i}"],
                    "below": 0, "inside": sizes[i], "between": sizes[i],
                })
    while open_:
        _narrow(plain, open_)
        ready = [b for b in open_ if b["between"] <= gather_rows]
        for b, (low, high) in zip(ready, _read(plain, ready)):
            result[b["column"]][b["p"]] = low + (high - low) * b["part"]
        open_ = [b for b in open_ if b not in ready]
    return result


def _inside(b: dict):
    return F.col(f"c{b['i']}").between(F.lit(b["lo"]), F.lit(b["hi"]))


def _between(b: dict):
    value = F.col(f"c{b['i']}")
    return (value > F.lit(b["lo"])) & (value < F.lit(b["hi"]))


def _narrow(plain: DataFrame, brackets: list[dict]) -> None:
    """Shrink every bracket around its two wanted ranks; brackets of equal range share a sketch."""
    shared: dict[tuple, list[dict]] = {}
    for b in brackets:
        shared.setdefault((b["i"], b["lo"], b["hi"]), []).append(b)
    sketched = plain.agg(*[
        F.kll_sketch_get_quantile_double(
            F.kll_sketch_agg_double(F.when(_inside(group[0]), F.col(f"c{group[0]['i']}")), F.lit(_SKETCH)),
            F.array(*[F.lit(x) for b in group for x in _levels(b)]),
        ).alias(f"b{g}")
        for g, group in enumerate(shared.values())
    ]).first()
    found = {
        id(b): (sketched[f"b{g}"][2 * j], sketched[f"b{g}"][2 * j + 1])
        for g, group in enumerate(shared.values()) for j, b in enumerate(group)
    }
    trial = [{**b, "lo": found[id(b)][0], "hi": found[id(b)][1]} for b in brackets]
    counted = plain.agg(
        *[F.count_if(F.col(f"c{t['i']}") < F.lit(t["lo"])).alias(f"u{j}") for j, t in enumerate(trial)],
        *[F.count_if(_inside(t)).alias(f"v{j}") for j, t in enumerate(trial)],
        *[F.count_if(_between(t)).alias(f"w{j}") for j, t in enumerate(trial)],
    ).first()
    for j, (b, t) in enumerate(zip(brackets, trial)):
        below, inside = counted[f"u{j}"], counted[f"v{j}"]
        if below <= b["first"] and b["second"] < below + inside and inside < b["inside"]:
            b.update(lo=t["lo"], hi=t["hi"], below=below, inside=inside, between=counted[f"w{j}"], margin=2)
        else:
            # The sketch missed (or could not shrink): look again with a wider margin.
            b["margin"] = b.get("margin", 2) * 4
            if b["margin"] * _ERROR > 1:
                _halve(plain, b)


def _levels(b: dict) -> tuple[float, float]:
    slack = b.get("margin", 2) * _ERROR
    low = (b["first"] - b["below"]) / b["inside"] - slack
    high = (b["second"] - b["below"] + 1) / b["inside"] + slack
    return max(0.0, low), min(1.0, high)


def _halve(plain: DataFrame, b: dict) -> None:
    """Bisect the value range: slow, but always makes progress."""
    middle = b["lo"] + (b["hi"] - b["lo"]) / 2
    value = F.col(f"c{b['i']}")
    left = _inside(b) & (value <= F.lit(middle))
    right = _inside(b) & (value > F.lit(middle))
    row = plain.agg(F.count_if(left).alias("n"), F.max(F.when(left, value)).alias("left_max"),
                    F.min(F.when(right, value)).alias("right_min")).first()
    cut = b["below"] + row["n"]
    if b["second"] < cut:
        b.update(hi=row["left_max"], inside=row["n"], between=row["n"], margin=2)
    elif b["first"] >= cut:
        rest = b["inside"] - row["n"]
        b.update(lo=row["right_min"], below=cut, inside=rest, between=rest, margin=2)
    else:
        # The two ranks lie on either side of the cut, so both values are known.
        b.update(pair=(row["left_max"], row["right_min"]), between=0)


def _read(plain: DataFrame, brackets: list[dict]) -> list[tuple[float, float]]:
    """The values at the two ranks of each bracket, from its counted distinct values."""
    wanted = [j for j, b in enumerate(brackets) if b["lo"] != b["hi"] and "pair" not in b]
    found: dict[int, list[tuple[float, int]]] = {j: [] for j in wanted}
    if wanted:
        items = [x for j in wanted for x in (F.lit(j), F.when(_inside(brackets[j]), F.col(f"c{brackets[j]['i']}")))]
        touched = plain.where(reduce(lambda x, y: x | y, [_inside(brackets[j]) for j in wanted]))
        stacked = touched.select(F.stack(F.lit(len(wanted)), *items).alias("j", "v")).where("v IS NOT NULL")
        for row in stacked.groupBy("j", "v").count().collect():
            found[row["j"]].append((row["v"], row["count"]))
    pairs = []
    for j, b in enumerate(brackets):
        if "pair" in b:
            pairs.append(b["pair"])
        elif b["lo"] == b["hi"]:
            pairs.append((b["lo"], b["lo"]))
        else:
            at, values = b["below"], []
            for value, count in sorted(found[j]):
                at += count
                values.append((at, value))
            low = next(v for upto, v in values if b["first"] < upto)
            high = next(v for upto, v in values if b["second"] < upto)
            pairs.append((low, high))
    return pairs
