"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablewright.session import cut_lineage

# The six characters that end a word: blank, tab, newline, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"


def arrow_map(
    df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema, most: int | None = None
) -> DataFrame:
    """``mapInArrow`` with a function from a batch to a dict of output columns.

    With ``most``, batches are cut between rows into parts of about so many bytes of ``text``."""
    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    names = kind.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(kind)
        for batch in batches if most is None else (p for b in batches for p in parts_of(b, most)):
            out = step(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_column(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, kind)


def parts_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at least one row and about ``most`` bytes of ``text``, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    del sizes, part
    for low, high in zip(edges, edges[1:]):
        if low < high:
            yield batch.slice(low, high - low)
    pa.default_memory_pool().release_unused()


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def arrow_schema(kind) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column; null reads as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def with_row_ids(df: DataFrame, name: str = "rid") -> DataFrame:
    """A written copy of ``df`` with a unique number per row.

    Equal rows become distinguishable, and since the copy lies in the shared folder a
    recomputed task reads the same numbers again.
    """
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def slices(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links (left, right): the smallest node reachable from each."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an edge list: rows (node, component), the smallest node.

    Alternating large-star and small-star steps: each node hands its larger (then its
    smaller) neighbours to its smallest one. Nothing but edges is kept, their number
    never grows, and the rounds are logarithmic in practice. Self links are allowed
    and make a component of their own; null ends are ignored. Every round is written
    to the shared folder, so a lost executor costs one round.
    """
    pairs = (
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    )
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v"))).distinct()
    links = cut_lineage(pairs.where("u <> v").distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = cut_lineage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component"))


def _mark(links: DataFrame) -> tuple:
    """Count and hash sum of the edges: unchanged after a round means finished."""
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]
