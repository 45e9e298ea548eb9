"""Best-two-fit packing of documents into fixed-length token sequences.

Only the histogram of piece lengths decides which lengths share a sequence, and it has
at most ``capacity`` entries whatever the number of documents. The driver turns it into
patterns ("these lengths together, so many times"); Spark numbers the pieces of each
length and looks up the pattern, sequence and offset of each.

Method: a sequence is filled greedily with the longest piece that still fits. If a gap
stays, its shortest piece is taken out and replaced by the two unpacked pieces that fit
the widened gap most tightly, as long as that fills more. A pattern is repeated while its
lengths last, so the number of steps is bounded by the number of lengths.

Defined cases: a null or empty text is one piece holding only the end id; equal rows are
separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.llm.common import arrow_map, slices, texts_of
from tablewright.llm.registry import query, table
from tablewright.llm.tokens import ChunkEncoder
from tablewright.session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2_048
END_ID = 0


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
                 end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document, its end id included.

    Rows (doc_id, piece, start, length, ids_crc32, ids); ``ids`` are little-endian
    unsigned 32-bit numbers, null unless ``keep_ids``. Only the first piece of a cut
    document may be shorter than ``capacity``.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    encoder: list[ChunkEncoder] = []

    def step(batch):
        if not encoder:
            encoder.append(ChunkEncoder(path, keeps_space=True))
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"])):
            ids = np.append(encoder[0].encode(text), end_id).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            edges = [0, *range(first, len(ids) + 1, capacity)]
            for n, (a, b) in enumerate(zip(edges, edges[1:])):
                raw = ids[a:b].tobytes()
                out["doc_id"].append(doc_id)
                out["piece"].append(n)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(raw))
                out["ids"].append(raw if keep_ids else None)
        return out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step,
                     "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces of it in one sequence}, number of sequences)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        left[length] = n
    numbers = np.arange(capacity + 1)
    patterns = []
    while left.any():
        free, bin_, gap = left.copy(), Counter(), capacity
        while gap:
            fitting = np.flatnonzero(free[: gap + 1])
            if not len(fitting):
                break
            # as many of the longest as fit: what one by one would choose
            length = int(fitting[-1])
            n = int(min(free[length], gap // length))
            bin_[length] += n
            free[length] -= n
            gap -= n * length
        while gap and bin_:
            small = min(bin_)
            room = gap + small
            present = np.where(free[: room + 1] > 0, numbers[: room + 1], 0)
            at_most = np.maximum.accumulate(present)
            one = np.flatnonzero(present)
            one = one[one < room]
            two = at_most[room - one]
            twice = (two == one) & (free[one] < 2)
            if twice.any():  # a single piece cannot be its own partner
                two[twice] = at_most[np.minimum(room - one[twice], one[twice] - 1)]
            sums = np.where(two > 0, one + two, 0)
            if not len(sums) or sums.max() <= small:
                break
            best = int(sums.argmax())
            a, b = int(one[best]), int(two[best])
            for length, change in ((small, -1), (a, 1), (b, 1)):
                bin_[length] += change
                free[length] -= change
            bin_ = +bin_
            gap = room - a - b
        times = min(int(left[length]) // n for length, n in bin_.items())
        for length, n in bin_.items():
            left[length] -= times * n
        patterns.append((dict(bin_), times))
    return patterns


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with (sequence_id, offset): its sequence and its place there.

    ``pieces`` must be stored or repeatable and have doc_id, piece, length, ids_crc32.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    taken: Counter = Counter()
    plan, sequence = [], 0
    for lengths, times in best_two_fit(counts, capacity):
        offset = 0
        for length in sorted(lengths, reverse=True):
            n = lengths[length]
            plan.append((length, taken[length], taken[length] + times * n, n, sequence, offset))
            taken[length] += times * n
            offset += n * length
        sequence += times
    steps = spark.createDataFrame(
        plan, "length long, low long, high long, each long, first_sequence long, first_offset long")
    # Number the pieces of each length: inside (length, slice) by a window, slices by sums.
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices(pieces))))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).select(
        "length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = (
        sliced.withColumn("nth", F.row_number().over(inside) - 1).join(ahead, ["length", "slice"])
        .withColumn("nth", F.col("nth") + F.col("ahead"))
    )
    # A few rows for each of at most ``capacity`` lengths: bounded whatever the corpus.
    placed = ranked.join(F.broadcast(steps), "length").where("nth >= low AND nth < high")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor((F.col("nth") - F.col("low")) / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(F.col("nth") - F.col("low"), F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
                   keep_ids: bool = True) -> DataFrame:
    """Tokenise once into the shared folder, then pack."""
    return pack(cut_lineage(token_pieces(docs, capacity, vocabulary, keep_ids=keep_ids)), capacity)


@query("op4_best_two_fit")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), keep_ids=False).drop("ids")
