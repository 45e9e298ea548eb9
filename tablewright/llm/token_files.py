"""Token ids stored by frequency rank in byte-aligned variable-length code.

Format, one row per segment: ``control`` has two bits per id (bytes of its rank less one),
four ids a byte from the low bits up; ``data`` has the ranks' little-endian bytes without
padding. Ranks count from the most frequent id of the whole corpus, so most take one byte.
``rank_ids`` (the ids in rank order) is stored beside the segments. Decoding looks up the
lengths of four ids at once by control byte in a numpy table.

Defined cases: a null or empty text holds only the end id; equal rows are stored each;
a null doc_id comes first; an empty table gives no segments; other columns are ignored. A
document is never split, so a segment is as long as its documents need.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.llm.common import arrow_map, arrow_schema, slices, texts_of
from tablewright.llm.registry import query, table
from tablewright.llm.tokens import ChunkEncoder
from tablewright.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SEGMENT_IDS = 1 << 18
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        size += ranks >= np.uint32(1 << bits)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that :func:`encode_ranks` stored."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    kept = np.arange(4, dtype=np.uint8) < size[:, None]
    out = np.zeros((n, 4), np.uint8)
    out[kept] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id`` and store all in ascending doc_id order.

    The texts are tokenised once; id counts travel with the ids. One driver collect: the
    counts of at most one row per vocabulary entry.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    raw, encoder = f"{path}/ids", []

    def tokenise(batch):
        if not encoder:
            encoder.append(ChunkEncoder(vocabulary, keeps_space=False))
        own = encoder[0]
        ids = [np.append(own.encode(t), own.dtype.type(end_id)) for t in texts_of(batch["text"])]
        seen = np.bincount(np.concatenate(ids)) if ids else np.zeros(0, int)
        used = np.flatnonzero(seen)
        nothing = [None]
        return {
            "doc_id": batch["doc_id"].to_pylist() + nothing,
            "n": [len(x) for x in ids] + nothing,
            "ids": [x.astype(own.dtype.newbyteorder("<")).tobytes() for x in ids] + nothing,
            "used": nothing * len(ids) + [used.tolist()],
            "times": nothing * len(ids) + [seen[used].tolist()],
            "width": [own.dtype.itemsize] * (len(ids) + 1),
        }

    arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenise,
              "doc_id long, n long, ids binary, used array<int>, times array<long>, width int",
              ).write.option("compression", "zstd").parquet(raw)
    stored = spark.read.parquet(raw)
    counts = (
        stored.where("n IS NULL").select(F.explode(F.arrays_zip("used", "times")).alias("z"))
        .groupBy(F.col("z.used").alias("id")).agg(F.sum("z.times").alias("n"))
    )
    order = [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame([(order,)], "rank_ids array<int>").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(order, default=0) + 1, "<u4")
    rank_of[order] = np.arange(len(order))
    # Text order within equal ids is settled by the ids themselves, so equal keys need no luck.
    rows = stored.where("n IS NOT NULL").select("doc_id", "n", "ids", "width")
    ordered = rows.repartitionByRange(slices(docs), "doc_id", F.xxhash64("ids")).sortWithinPartitions(
        "doc_id", F.xxhash64("ids"))
    schema = spark.createDataFrame(
        [], "part long, begin long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary").schema

    def segments(batches):
        arrow, part, begin = arrow_schema(schema), TaskContext.get().partitionId(), 0
        names, lengths, ids, total = [], [], [], 0

        def flush():
            nonlocal begin, names, lengths, ids, total
            control, data = encode_ranks(rank_of[np.concatenate(ids)])
            row = [part, begin, total, names, lengths, control, data]
            begin, names, lengths, ids, total = begin + total, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, n, blob, width in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "ids", "width"))):
                names.append(doc_id)
                lengths.append(n)
                ids.append(np.frombuffer(blob, "<u2" if width == 2 else "<u4"))
                total += n
                if total >= SEGMENT_IDS:
                    yield flush()
        if names:
            yield flush()

    ordered.mapInArrow(segments, schema).write.parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: rows (doc_id, start, n_tokens, ids), where ``start`` is the
    number of ids of all documents before it and ``ids`` little-endian unsigned 32-bit."""
    rank_ids = np.array(spark.read.parquet(f"{path}/ranks").first()["rank_ids"], "<u4")
    stored = spark.read.parquet(f"{path}/segments")
    # A segment knows where it begins in its part; the parts, one per writing task, add up.
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("ids_in_part")).select(
        "part", F.coalesce(F.sum("ids_in_part").over(over), F.lit(0)).alias("part_begin"))

    def decode(batch):
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
        for begin, n, names, lengths, control, data in zip(*(
            batch[c].to_pylist() for c in ("begin", "n_ids", "doc_ids", "lengths", "control", "data"))):
            ids = rank_ids[decode_ranks(control, data, n)]
            ends = np.cumsum(lengths)
            for name, length, end in zip(names, lengths, ends):
                out["doc_id"].append(name)
                out["start"].append(begin + end - length)
                out["n_tokens"].append(length)
                out["ids"].append(ids[end - length: end].tobytes())
        return out

    # As many rows as tasks wrote the store, so they may go to every task.
    placed = stored.join(F.broadcast(parts), "part").withColumn("begin", F.col("part_begin") + F.col("begin"))
    return arrow_map(placed, decode, "doc_id long, start long, n_tokens long, ids binary")


@query("op10_token_files")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
