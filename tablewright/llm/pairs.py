"""All pairs inside groups of rows, in blocks of bounded size.

A group of up to ``block`` rows is compared in one go. A larger one is cut into blocks by row
hash, and each pair of blocks is compared in a task of its own: every pair of rows meets
exactly once, no task holds more than two blocks, and what is written out are the rows'
link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import arrow_schema, local_roots, slices


def block_pairs(rows: DataFrame, key: str, block: int, row: str = "rid") -> DataFrame:
    """``rows`` of groups with two rows at least, dealt to comparisons: plus (g, b, cross).

    ``g`` numbers the comparison, ``b`` is 0 or 1 for its two blocks, ``cross`` tells
    whether only pairs between the blocks count. A row of a group of k blocks is copied
    to the k comparisons of its block.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(
        key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(11), row), F.col("blocks")).cast("int")
    dealt = (
        rows.join(sizes, key).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.select(
        *rows.columns, F.xxhash64(key, low, high).alias("g"),
        (F.col("own") > F.col("other")).cast("int").alias("b"), (F.col("own") != F.col("other")).alias("cross"))


def by_group(rows: DataFrame, step: Callable[[dict[str, list]], dict | None], schema: str) -> DataFrame:
    """Apply ``step`` to the rows of each ``g`` (dict of columns), which must be few.

    One shuffle by ``g`` and a sort; a task then walks its rows once and holds one group.
    """
    kind = rows.sparkSession.createDataFrame([], schema).schema
    names = kind.fieldNames()

    def run(batches):
        arrow, held = arrow_schema(kind), None

        def done(group: pa.Table):
            out = step({c: group[c].to_pylist() for c in group.column_names}) if len(group) > 1 else None
            return out and pa.RecordBatch.from_arrays(
                [pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            keys = table["g"].to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for a, b in zip(starts, starts[1:]):
                if b - a > 1 and (out := done(table.slice(a, b - a))):
                    yield out
            held = table.slice(starts[-1]) if len(starts) else table
        if held is not None and (out := done(held)):
            yield out

    return rows.repartition(slices(rows), "g").sortWithinPartitions("g").mapInArrow(run, kind)


def links_of(linked: np.ndarray, group: dict[str, list], row: str = "rid") -> dict | None:
    """Rows (rid, root, links) of one comparison from its boolean matrix of linked rows."""
    linked = linked.copy()
    np.fill_diagonal(linked, False)
    if group["cross"][0]:
        side = np.array(group["b"])
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return None
    weight = np.array(group["copies"], np.int64) if "copies" in group else np.ones(len(linked), np.int64)
    ids = np.array(group[row], np.int64)
    order = np.argsort(ids, kind="stable")  # roots are then smallest ids
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    left, right = np.nonzero(linked)
    forward = left < right
    roots = local_roots(len(ids), place[left[forward]], place[right[forward]])
    has = linked.any(1)
    return {"rid": ids[has], "root": ids[order][roots[place]][has], "links": (linked @ weight)[has]}


LINKS = "rid long, root long, links long"


def whole_groups(rows: DataFrame, key: str, order: list[str],
                 step: Callable[[dict[str, np.ndarray]], dict | None], schema: str) -> DataFrame:
    """Apply ``step`` to sorted columns holding whole groups of ``key``, many at a time.

    For groups that are small by nature, such as the positions of one text.
    """
    kind = rows.sparkSession.createDataFrame([], schema).schema
    names = kind.fieldNames()

    def run(batches):
        arrow, held = arrow_schema(kind), None

        def done(part: pa.Table):
            out = step({c: part[c].to_numpy() for c in part.column_names}) if len(part) else None
            return out and pa.RecordBatch.from_arrays(
                [pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held[key].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if out := done(held.slice(0, cut)):
                yield out
            held = held.slice(cut)
        if held is not None and (out := done(held)):
            yield out

    return rows.repartition(slices(rows), key).sortWithinPartitions(key, *order).mapInArrow(run, kind)
