"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to eight dimensions a block and decoded to the nearest
point of the E8 lattice; the points of all blocks name a cell. Every table uses projections
of its own and files a vector under its cell and the cells of neighbouring lattice points
that it lies next to. Vectors that share a cell are compared on small copies, those that
may be close enough, given how far each copy lies from its vector, are grouped, and inside each group all pairs are compared by cosine in
double precision, so that every link has been verified and each counts once.

The number of blocks follows from the number of vectors (an unrelated pair shares a cell of
one block with probability ``FAR``), the number of tables from the target recall at the
threshold (``NEAR``: probability to meet in one table of one, two and three blocks; a neighbour
is probed in one block at a time, so it is no power of the first; all were measured on
random vectors). Equal vectors are one vector with a number of copies throughout.

Defined cases: vectors that are null, zero or hold null or non-finite components link with
nothing and are components of their own; vectors of different lengths never link; equal
rows are separate vectors that link; an empty table gives no rows; other columns are
ignored; a null vec_id is kept and counts, but names no component unless it stands alone.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.common import arrow_map, components, with_row_ids
from tablewright.llm.pairs import LINKS, block_pairs, by_group, links_of
from tablewright.llm.registry import query, table
from tablewright.session import cut_lineage

COSINE = 0.9
RECALL = 0.97
SCALE = 0.6
PROBES = 2
NEAR, FAR = (0.5, 0.25, 0.095), 0.0018
# Probability to lie in the same cell of one block, probes aside.
SAME = 0.18
CROWD = 200
BLOCK = 1_024
# Allowance for single precision in the cosines of small copies.
SINGLE = 1e-4


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to its neighbouring points."""
    pairs = [np.eye(8)[i] * s + np.eye(8)[j] * t
             for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest whole-number point with an even sum: round, then mend the worst component."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The E8 lattice point nearest to each row: of its two cosets the closer one."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def _fold(points: np.ndarray) -> np.ndarray:
    """One 64-bit number per row of small whole numbers."""
    out = np.full(len(points), 0x9E3779B97F4A7C15, np.uint64)
    for column in points.astype(np.int64).view(np.uint64).T:
        out = (out ^ column) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def cells(vectors: np.ndarray, tables: int, blocks: int, scale: float = SCALE, probes: int = PROBES) -> np.ndarray:
    """Cell numbers (vector, table x (1 + blocks x probes)) of unit vectors."""
    n, size = vectors.shape
    steps, out = minimal_vectors(), []
    for t in range(tables):
        points, near = [], []
        for b in range(blocks):
            rng = np.random.default_rng([size, t, b])
            x = vectors @ (rng.normal(size=(size, 8)) / math.sqrt(8) / scale) + rng.uniform(0, 2, 8)
            point = nearest_point(x)
            toward = np.argpartition(-((x - point) @ steps.T), probes - 1, axis=1)[:, :probes]
            points.append(point)
            near.append([point + steps[toward[:, p]] for p in range(probes)])
        names = [points] + [points[:b] + [other] + points[b + 1:] for b in range(blocks) for other in near[b]]
        for name in names:
            key = np.hstack([np.full((n, 1), t), np.full((n, 1), size), *(2 * p for p in name)])
            out.append(_fold(key))
    return np.stack(out, 1).view(np.int64)


def meeting(blocks: int) -> float:
    """A lower bound of the probability that a pair at the threshold meets in one table."""
    return NEAR[min(blocks, len(NEAR)) - 1] * SAME ** max(0, blocks - len(NEAR))


def tables_for(recall: float, blocks: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(blocks)))


def _unit(column) -> tuple[list, np.ndarray]:
    """Valid vectors' places, and all vectors as unit rows grouped by length."""
    out = []
    for v in column.to_pylist():
        x = None
        if v and not any(c is None for c in v):
            x = np.array(v, float)
            top = np.abs(x).max()
            x = x / top if np.isfinite(top) and top > 0 else None
            x = None if x is None else x / np.linalg.norm(x)
        out.append(x)
    return out


def link_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept)."""
    stored = with_row_ids(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))

    def units(batch):
        unit = _unit(batch["embedding"])
        return {"rid": batch["rid"], "unit": [None if u is None else u.astype("<f8").tobytes() for u in unit],
                "digest_of": [None if u is None else (u + 0.0).astype("<f8").tobytes() for u in unit]}

    unit = arrow_map(stored.select("rid", "embedding"), units, "rid long, unit binary, digest_of binary")
    named = cut_lineage(unit.select("rid", "unit", F.md5("digest_of").alias("same")))
    copies = cut_lineage(named.where("same IS NOT NULL").groupBy("same").agg(
        F.min("rid").alias("first"), F.count("*").alias("copies")))
    distinct = cut_lineage(
        named.join(copies, F.col("rid") == F.col("first")).select("rid", "unit", "copies"))
    n = max(1, distinct.count())
    blocks = max(1, math.ceil(math.log(max(1.0, n / CROWD)) / -math.log(FAR)))
    tables = tables_for(recall, blocks)

    def file(batch):
        out = {"cell": [], "rid": [], "small": [], "error": []}
        rids, raw = batch["rid"].to_numpy(), batch["unit"].to_pylist()
        sizes = np.array([len(u) for u in raw])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            x = np.array([np.frombuffer(raw[i], "<f8") for i in rows])
            names = cells(x, tables, blocks)
            small = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
            back = small / np.linalg.norm(small.astype(float), axis=1, keepdims=True)
            error = np.linalg.norm(x - back, axis=1)
            for i, row in enumerate(rows):
                for name in np.unique(names[i]):
                    out["cell"].append(name)
                    out["rid"].append(rids[row])
                    out["small"].append(small[i].tobytes())
                    out["error"].append(error[i])
        return out

    filed = arrow_map(distinct, file, "cell long, rid long, small binary, error double")

    def close(group):
        x = np.array([np.frombuffer(s, np.int8) for s in group["small"]], np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        # a cosine of two copies is off by their distances from the vectors at most
        error = np.array(group["error"], np.float32)
        return links_of(x @ x.T + error[:, None] + error >= cosine - SINGLE, group)

    found = cut_lineage(by_group(block_pairs(filed, "cell", block), close, LINKS).select("rid", "root").distinct())
    groups = components(found, "rid", "root").select(F.col("node").alias("rid"), F.col("component").alias("grp"))

    def exact(group):
        x = np.array([np.frombuffer(u, "<f8") for u in group["unit"]])
        return links_of(x @ x.T >= cosine, group)

    verified = cut_lineage(
        by_group(block_pairs(distinct.join(groups, "rid"), "grp", block), exact, LINKS))
    links = verified.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(verified.select("rid", "root"), "rid", "root")
    classes = (
        copies.join(links, F.col("first") == F.col("rid"), "left").drop("rid")
        .join(joined, F.col("first") == F.col("node"), "left")
        .select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "first").alias("component"))
    )
    rows = (
        stored.select("rid", "vec_id").join(named.select("rid", "same"), "rid").join(classes, "same", "left")
        .select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component", F.col("rid")).alias("component"))
    )
    rows = cut_lineage(rows)
    names = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return rows.join(names, "component").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op9_lattice_near_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return link_vectors(table(spark, sf, "embeddings"))
