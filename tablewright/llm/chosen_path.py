"""Near-duplicate documents: an n-gram Jaccard join by chosen paths.

A text is the set of its runs of five words. Equal sets are one class. Every class has a
signature of ``COORDINATES`` minimum hashes, itself a set of (coordinate, value) tokens, in
which two classes share as large a part as their sets do. A run starts with all classes in
one bucket. A bucket samples coordinates (1 / similarity of them expected) and passes each class
on to the bucket of each sampled token, so only classes that share the token stay together.
Buckets of at most ``SMALL`` classes are compared by brute force, larger ones are split
again, and after ``DEPTH`` splits compared block by block. How many coordinates agree varies
from pair to pair, and with it the probability to survive a run; the number of runs follows
from the target recall over all pairs at the threshold, for buckets that are split to the end.

Classes whose signatures look similar are grouped, and inside each group all pairs are
compared on the whole sets: every link is exact, each pair counts once, and copies are never
expanded into pairs.

Defined cases: words are what white space separates, letters' case counts; a text of one to
four words is one run; null, empty and blank texts have no runs and link with nothing; equal
rows are separate documents that link; a null doc_id is kept and counts, but names no class
unless it stands alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.common import arrow_map, components, texts_of, with_row_ids
from tablewright.llm.pairs import LINKS, block_pairs, by_group, links_of
from tablewright.llm.registry import query, table
from tablewright.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9998
COORDINATES = 48
SMALL = 256
DEPTH = 4
# Signatures that agree this much less than the threshold still go on to the exact comparison.
SLACK = 0.25
_MANY = 500_000


class _WordHash(dict):
    """Word -> 64-bit hash; started afresh when full, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MANY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASH = _WordHash()
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the runs of ``words`` words, sorted; none for a blank text."""
    parts = text.encode().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASH.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    out = np.zeros(len(parts) - size + 1, np.uint64)
    for i in range(size):
        out = out * _STEP + hashes[i: i + len(out)]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(runs: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """``coordinates`` minimum hashes of a set that is not empty."""
    rng = np.random.default_rng(coordinates)
    factor = (rng.integers(0, 1 << 31, coordinates, np.uint32) * 2 + 1)[:, None]
    shift = rng.integers(0, 1 << 32, coordinates, np.uint32)[:, None]
    short = (runs >> np.uint64(32)).astype(np.uint32)
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1 << 14):  # bounded memory on very long texts
        np.minimum(out, ((short[None, at: at + (1 << 14)] ^ shift) * factor).min(1), out=out)
    return out


def recall_of(runs: int, similarity: float, depth: int, coordinates: int = COORDINATES) -> float:
    """Share of the pairs at the threshold that meet in one of ``runs`` and are told to be alike.

    Of a pair's coordinates a binomial number agrees. A bucket samples each of them with the
    same small probability and passes the pair on for every sampled one that agrees; the
    pair survives ``depth`` splits with the probability of that branching process.
    """
    drawn, met = 1 / (similarity * coordinates), 0.0
    for agree in range(math.ceil((similarity - SLACK) * coordinates - 1e-9), coordinates + 1):
        alive = 1.0
        for _ in range(depth):
            alive = 1 - (1 - drawn * alive) ** agree
        share = math.comb(coordinates, agree) * similarity ** agree * (1 - similarity) ** (coordinates - agree)
        met += share * (1 - (1 - alive) ** runs)
    return met


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs until the pairs at the threshold have met with probability ``recall``."""
    if recall >= recall_of(1 << 20, similarity, depth):
        raise ValueError(f"{COORDINATES} coordinates cannot find a share of {recall} of the pairs")
    return next(n for n in range(1, 1 << 20) if recall_of(n, similarity, depth) >= recall)


def _children(paths: np.ndarray, signs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for the coordinates that each row's bucket samples."""
    coordinates = signs.shape[1]
    index = np.arange(coordinates, dtype=np.uint64)
    drawn = (paths[:, None] + (index + np.uint64(1)) * _STEP) * _MIX
    drawn ^= drawn >> np.uint64(32)
    drawn = drawn * _STEP
    row, chosen = np.nonzero((drawn >> np.uint64(11)) < np.uint64(2**53 / (similarity * coordinates)))
    child = (drawn[row, chosen] ^ signs[row, chosen].astype(np.uint64)) * _MIX
    return row, (child ^ (child >> np.uint64(29))) * _STEP


def _split(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows (path, rid, sign) passed on to child buckets (path, rid)."""

    def step(batch):
        paths = batch["path"].to_numpy().view(np.uint64)
        signs = np.array([np.frombuffer(s, "<u4") for s in batch["sign"].to_pylist()], "<u4").reshape(len(paths), -1)
        if not len(paths):
            return None
        row, child = _children(paths, signs, similarity)
        return {"path": child.view(np.int64), "rid": batch["rid"].to_numpy()[row]}

    return arrow_map(rows.select("path", "rid", "sign"), step, "path long, rid long").distinct()


def candidate_groups(classes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Groups (rid, grp) of ``classes`` (rid, sign) that may be linked, by chosen paths."""
    runs = runs_for(recall, similarity, DEPTH)
    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(F.lit(8), r)))
    level = cut_lineage(_split(classes.withColumn("path", roots), similarity))
    leaves = []
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("path").agg(F.count("*").alias("n"))
        if depth == DEPTH:
            leaves.append(level.join(sizes.where("n > 1").select("path"), "path"))
            break
        leaves.append(level.join(sizes.where(f"n > 1 AND n <= {SMALL}").select("path"), "path"))
        crowded = level.join(sizes.where(f"n > {SMALL}").select("path"), "path")
        level = cut_lineage(_split(crowded.join(classes, "rid"), similarity))
        if level.isEmpty():
            break
    small = leaves[0]
    for more in leaves[1:]:
        small = small.union(more)

    def alike(group):
        signs = np.array([np.frombuffer(s, "<u4") for s in group["sign"]], "<u4")
        same = np.zeros((len(signs), len(signs)), np.uint16)
        for column in signs.T:
            same += column[:, None] == column[None, :]
        return links_of(same >= (similarity - SLACK) * signs.shape[1], group)

    met = by_group(block_pairs(small.join(classes, "rid"), "path", SMALL), alike, LINKS)
    return components(met.select("rid", "root").distinct(), "rid", "root").select(
        F.col("node").alias("rid"), F.col("component").alias("grp"))


def jaccard_matrix(sets: list[np.ndarray], chunk: int = 1 << 13) -> np.ndarray:
    """Similarity of each pair of sets, by products of their incidence matrices in chunks."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[token] > 1
    token, owner = token[common], owner[common]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    dense = np.cumsum(np.r_[False, token[1:] != token[:-1]]) if len(token) else token
    both = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(dense[-1]) + 1 if len(dense) else 0, chunk):
        a, b = np.searchsorted(dense, (at, at + chunk))
        part = np.zeros((len(sets), min(chunk, int(dense[-1]) + 1 - at)), np.float32)
        part[owner[a:b], dense[a:b] - at] = 1
        both += part @ part.T
    size = np.array([len(s) for s in sets])
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def link_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
                   row: str | None = None) -> DataFrame:
    """One row per document: (rid, doc_id, n_links, class_id, kept).

    ``row`` names a column of unique row numbers, made here if there is none. ``class_id`` is the
    smallest doc_id that links lead to; ``kept`` marks one row of each class.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    keyed = docs.select(number.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                        "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))

    def signs(batch):
        out = {"rid": batch["rid"], "doc_id": batch["doc_id"], "key": batch["key"], "same": [], "sign": []}
        for text in texts_of(batch["text"]):
            runs = shingles(text)
            out["same"].append(xxhash.xxh128_digest(runs.tobytes()) if len(runs) else None)
            out["sign"].append(signature(runs).astype("<u4").tobytes() if len(runs) else None)
        return out

    named = cut_lineage(arrow_map(keyed, signs, "rid long, doc_id long, key binary, same binary, sign binary"))
    # One class per set: its number is the smallest row number, its text that of the smallest key.
    classes = cut_lineage(named.where("same IS NOT NULL").groupBy("same").agg(
        F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("key").alias("key"),
        F.max("sign").alias("sign")))
    groups = cut_lineage(candidate_groups(classes.select("rid", "sign"), similarity, recall))
    chosen = groups.join(classes.select("rid", "key", "copies"), "rid")
    # The texts of candidate classes; equal texts are reduced to one inside each task first.
    texts = (
        docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")
        .join(chosen, "key").groupBy("rid").agg(
            F.first("grp").alias("grp"), F.first("copies").alias("copies"), F.first("text").alias("text"))
    )

    def sets(batch):
        return {"rid": batch["rid"], "grp": batch["grp"], "copies": batch["copies"],
                "runs": [shingles(t).astype("<u8").tobytes() for t in texts_of(batch["text"])]}

    whole = cut_lineage(arrow_map(texts, sets, "rid long, grp long, copies long, runs binary"))

    def exact(group):
        parts = [np.frombuffer(r, "<u8") for r in group["runs"]]
        return links_of(jaccard_matrix(parts) >= similarity - 1e-12, group)

    verified = cut_lineage(by_group(block_pairs(whole, "grp", SMALL), exact, LINKS))
    links = verified.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(verified.select("rid", "root"), "rid", "root").withColumnRenamed("node", "rid")
    of_class = classes.select("same", "rid", "copies").join(links, "rid", "left").join(joined, "rid", "left").select(
        "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rid").alias("component"))
    rows = cut_lineage(named.select("rid", "doc_id", "same").join(of_class, "same", "left").select(
        "rid", "doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rid").alias("component")))
    heads = rows.groupBy("component").agg(
        F.min("doc_id").alias("class_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid")).alias("head"))
    return rows.join(heads, "component").select(
        "rid", "doc_id", "n_links", "class_id", (F.col("rid") == F.col("head.rid")).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the one with the smallest doc_id."""
    stored = with_row_ids(docs, "__row")
    kept = link_documents(stored, similarity, recall, row="__row").where("kept").select(F.col("rid").alias("__row"))
    return stored.join(kept, "__row", "left_semi").select(*docs.columns)


@query("op8_chosen_path")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return link_documents(table(spark, sf, "documents")).drop("rid")
