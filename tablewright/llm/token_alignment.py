"""Tokens of two tokenizers laid side by side, and how often their ids meet in the corpus.

Both tokenizers cut a text before any blank that stands between two other characters, and no token
reaches over such a cut, so a text is aligned chunk by chunk and each task asks the libraries once
per chunk it has not seen lately. Inside a chunk the character offsets of ``tokenizers`` and
the byte spans of sentencepiece's proto (the immutable one is gone from the installed version; its successor
has the same spans) are coarse cuts. A span holds if the token's decoded bytes fill it; where
tokens share a character, or bytes of a fallback have empty spans, the decoded bytes give the cuts in
between, and the next span that fits closes the run.

Documents that hold a pair of linked ids are counted in each task first, then by Spark. The pairs found in
most documents, at most ``PAIRS`` of them, go to every task as two arrays; documents' links to rarer pairs
are joined by shuffle, where no pair can be hot since each is rare.

Defined cases: a text that is null, empty or not given back byte by byte by both tokenizers has no tokens (zeros
and ``''``); special tokens' strings are plain text; equal rows and null doc_ids are documents like others, each counted; pairs
with equal counts are all best; long texts are aligned whole, and counted in slices that hold whole
texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.common import arrow_map, arrow_schema
from tablewright.llm.registry import query, table
from tablewright.llm.tokens import _byte_letters
from tablewright.session import cut_lineage

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Most pairs sent to every task: 16 bytes each.
PAIRS = 1 << 21
# Chunks, and characters of them, that one worker remembers: bounds memory, not results.
CHUNKS, CHUNK_CHARS = 400_000, 1 << 24
# New chunks are given to the libraries together, up to so many characters.
TOGETHER_CHARS = 1 << 13
# Texts are counted together up to so many characters, pair counts gathered up to so many pairs.
SLICE_CHARS, GATHERED = 1 << 19, 1 << 20

_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")


def cuts(spans: list[int], pieces: list[bytes], whole: bytes) -> list[int] | None:
    """Where each token ends in ``whole``: by the end of its span, or by its bytes where spans are too coarse.

    None if the tokens' bytes are not those of ``whole``.
    """
    out, at, start, run = [], 0, 0, b""
    for end, piece in zip(spans, pieces):
        at, run = at + len(piece), run + piece
        out.append(at)
        if end == at:
            if run != whole[start:at]:
                return None
            start, run = at, b""
    return out if run == whole[start:] else None


def groups_and_links(a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[slice, slice]], list[tuple[int, int]]]:
    """Token ranges between common ends, and the (A, B) tokens whose bytes overlap."""
    groups, links, i, j, i0, j0 = [], [], 0, 0, 0, 0
    while i < len(a_ends) and j < len(b_ends):
        links.append((i, j))
        a, b = a_ends[i], b_ends[j]
        i, j = i + (a <= b), j + (b <= a)
        if a == b:
            groups.append((slice(i0, i), slice(j0, j)))
            i0, j0 = i, j
    return groups, links


class Aligner:
    """Aligns chunks, numbering those seen; numbers hold until :meth:`tidy` forgets them."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.a_bytes = {}
        for entry, n in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in byte_of for c in entry):
                self.a_bytes[n] = bytes(byte_of[c] for c in entry)
        self.b_size = self.b.get_piece_size()
        entries = [self.b.id_to_piece(n) for n in range(self.b_size)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(entries)]
        self.a_sizes = np.zeros(self.a.get_vocab_size(), np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # A piece with a blank after another character could reach over a cut; then texts stay whole.
        self.splits = not any("▁" in p.lstrip("▁") for p in entries)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.texts, self.chars = {}, [], 0
        self.counts = np.zeros((1024, 6), np.int64)  # a, b, groups, links, valid, pairs
        self.first = np.zeros(1024, np.int64)  # place of a chunk's first pair
        self.keys, self.times, self.used = np.zeros(4096, np.int64), np.zeros(4096, np.int64), 0

    def tidy(self) -> None:
        if len(self.numbers) > CHUNKS or self.chars > CHUNK_CHARS:
            self.forget()

    def align(self, chunk: str) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """(A ids, A ends, B ids, B ends) of a chunk that begins with the blank which B adds itself."""
        whole = chunk.encode()
        found = self.a.encode(chunk, add_special_tokens=False)
        byte_at = np.cumsum([0] + [len(c.encode()) for c in chunk]).tolist()
        a_ids = found.ids
        a_ends = cuts([byte_at[end] for _, end in found.offsets], [self.a_bytes.get(n, b"") for n in a_ids], whole)
        pieces = self.b.encode(chunk[1:], return_type="proto").pieces
        b_ids = [p.id for p in pieces]
        b_ends = cuts([p.end + 1 for p in pieces], [self.b_bytes[n] for n in b_ids], whole)
        return None if a_ends is None or b_ends is None else (a_ids, a_ends, b_ids, b_ends)

    def learn(self, chunks: list[str]) -> None:
        """Number new chunks: those that stand between cuts by a few calls for many, the others one by one."""
        together, held = [], 0
        for chunk in chunks:
            # A cut needs a character before it and a blank with a character after it.
            if chunk[:1] != " " or chunk[1:2].isspace() or chunk[-1:].isspace() or "▁" in chunk:
                self._learn_one(chunk)
                continue
            together.append(chunk)
            held += len(chunk)
            if held >= TOGETHER_CHARS:
                self._learn_many(together)
                together, held = [], 0
        if together:
            self._learn_many(together)

    def _learn_many(self, chunks: list[str]) -> None:
        text = "".join(chunks)
        whole = text.encode()
        found = self.a.encode(text, add_special_tokens=False)
        a_ids, pieces = np.array(found.ids, np.int64), self.b.encode(text[1:], return_type="proto").pieces
        b_ids, b_spans = np.array([(p.id, p.end) for p in pieces], np.int64).T
        a_fine, b_fine = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        byte_at = np.cumsum(np.r_[0, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)])
        a_spans = byte_at[np.array(found.offsets, np.int64)[:, 1]]
        ends = np.cumsum([len(c.encode()) for c in chunks])
        # Cuts that spans and bytes agree on; between them the bytes decide. Every chunk must end at one.
        held = np.intersect1d(a_fine[a_fine == a_spans], b_fine[b_fine == b_spans + 1], assume_unique=True)
        if not np.isin(ends, held, assume_unique=True).all() or any(
                b"".join(map(own.__getitem__, ids.tolist())) != whole for own, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids))):
            for chunk in chunks:
                self._learn_one(chunk)
            return
        # Between two neighbouring ends of either side lies exactly one overlap of an A and a B token.
        any_end, both = np.union1d(a_fine, b_fine), np.intersect1d(a_fine, b_fine, assume_unique=True)
        keys = a_ids[np.searchsorted(a_fine, any_end)] * self.b_size + b_ids[np.searchsorted(b_fine, any_end)]
        link_of = np.searchsorted(ends, any_end)
        order = np.lexsort((keys, link_of))
        keys, link_of = keys[order], link_of[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (link_of[1:] != link_of[:-1])])
        times = np.diff(np.r_[new, len(keys)])
        size = len(chunks)
        counts = np.stack([*(np.bincount(np.searchsorted(ends, x), minlength=size) for x in (a_fine, b_fine, both)),
                           np.bincount(link_of, minlength=size), np.ones(size, np.int64), np.bincount(link_of[new], minlength=size)], 1)
        a_text, b_text = list(map(str, found.ids)), list(map(str, b_ids.tolist()))
        a_to, b_to = ((np.searchsorted(x, both) + 1).tolist() for x in (a_fine, b_fine))
        groups = [f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip([0, *a_to], a_to, [0, *b_to], b_to)]
        last = np.cumsum(counts[:, 2]).tolist()
        self._add(chunks, [";".join(groups[i:j]) for i, j in zip([0, *last], last)], counts, keys[new], times)

    def _learn_one(self, chunk: str) -> None:
        made, text, pairs, counts = self.align(chunk), "", {}, np.zeros((1, 6), np.int64)
        if made:
            a_ids, a_ends, b_ids, b_ends = made
            groups, links = groups_and_links(a_ends, b_ends)
            for i, j in links:
                key = a_ids[i] * self.b_size + b_ids[j]
                pairs[key] = pairs.get(key, 0) + 1
            text = ";".join(
                f"{','.join(map(str, a_ids[g]))}|{','.join(map(str, b_ids[h]))}" for g, h in groups)
            counts[0] = len(a_ids), len(b_ids), len(groups), len(links), 1, len(pairs)
        self._add([chunk], [text], counts, list(pairs.keys()), list(pairs.values()))

    def _add(self, chunks: list[str], texts: list[str], counts: np.ndarray, keys, times) -> None:
        at, size = len(self.texts), len(chunks)
        self.numbers.update(zip(chunks, range(at, at + size)))
        self.texts += texts
        self.chars += sum(map(len, chunks))
        while at + size > len(self.first):
            self.counts, self.first = (np.concatenate([x, np.zeros_like(x)]) for x in (self.counts, self.first))
        while self.used + len(keys) > len(self.keys):
            self.keys, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.times))
        self.counts[at: at + size] = counts
        self.first[at: at + size] = self.used + np.cumsum(counts[:, 5]) - counts[:, 5]
        self.keys[self.used: self.used + len(keys)] = keys
        self.times[self.used: self.used + len(keys)] = times
        self.used += len(keys)

    def chunks(self, text: str) -> list[str]:
        return _BEFORE_WORD.split(" " + text) if self.splits else [" " + text]

    def describe(self, texts: list[str]) -> dict:
        """Per text: counts (n, 4), digests, and its distinct linked pairs as flat (owner, key, times) arrays."""
        self.tidy()
        lists = [self.chunks(text) if text else [] for text in texts]
        self.learn(list({c for parts in lists for c in parts}.difference(self.numbers)))
        lists = [list(map(self.numbers.__getitem__, parts)) for parts in lists]
        sizes = np.array([len(x) for x in lists], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        chunk = np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum())
        good = sizes > 0
        good[owner[self.counts[chunk, 4] == 0]] = False
        use = good[owner]
        owner, chunk = owner[use], chunk[use]
        counts = np.zeros((len(texts), 4), np.int64)
        for c in range(4):
            counts[:, c] = np.bincount(owner, self.counts[chunk, c], len(texts))
        digests = [
            hashlib.sha256(";".join(map(self.texts.__getitem__, own)).encode()).hexdigest() if ok else ""
            for own, ok in zip(lists, good)]
        total = max(len(self.texts), 1)
        codes, often = np.unique(owner * total + chunk, return_counts=True)
        owner, chunk = codes // total, codes % total
        n = self.counts[chunk, 5]
        ends = np.cumsum(n)
        at = np.repeat(self.first[chunk] - (ends - n), n) + np.arange(n.sum())
        owner, keys, times = np.repeat(owner, n), self.keys[at], self.times[at] * np.repeat(often, n)
        order = np.lexsort((keys, owner))
        owner, keys, times = owner[order], keys[order], times[order]
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]) if len(keys) else np.zeros(0, int)
        return {"counts": counts, "digests": digests, "owner": owner[new], "keys": keys[new],
                "times": np.add.reduceat(times, new) if len(new) else times}


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process, so later tasks of the worker know its chunks."""
    return Aligner(a_path, b_path)


def text_slices(texts: list[str]) -> Iterator[slice]:
    begin, held = 0, 0
    for n, text in enumerate(texts):
        if held and held + len(text) > SLICE_CHARS:
            yield slice(begin, n)
            begin, held = n, 0
        held += len(text) + 1
    if held:
        yield slice(begin, len(texts))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One written row per document, and rows of pair counts (``rid`` null) for each task.

    A document's distinct links are ``keys`` (A id * size of B + B id, ascending) and ``times``, as little-endian
    unsigned numbers of ``width`` and four bytes.
    """
    schema = docs.sparkSession.createDataFrame(
        [], "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "keys binary, times binary, pairs array<long>, found array<long>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, arrow = aligner(a_path, b_path), arrow_schema(schema)
        pairs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def rows(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        def merge() -> None:
            nonlocal pairs, found, waiting
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            both = np.concatenate([pairs, keys])
            pairs, back = np.unique(both, return_inverse=True)
            found = np.bincount(back, np.concatenate([found, n]), len(pairs)).astype(np.int64)
            waiting = []

        def gathered() -> pa.RecordBatch:
            return rows([[None]] * 9 + [[pairs.tolist()], [found.tolist()]])

        for batch in batches:
            rid, names, texts = (batch[c].to_pylist() for c in ("rid", "doc_id", "text"))
            texts = [t or "" for t in texts]
            for part in text_slices(texts):
                made = own.describe(texts[part])
                size = len(made["digests"])
                bounds = np.searchsorted(made["owner"], np.arange(size + 1))
                keys, times = made["keys"].astype("<u4" if narrow(own) else "<u8"), made["times"].astype("<u4")
                between = list(zip(bounds[:-1], bounds[1:]))
                yield rows([rid[part], names[part], *made["counts"].T, made["digests"], [keys[i:j].tobytes() for i, j in between],
                            [times[i:j].tobytes() for i, j in between], [None] * size, [None] * size])
                waiting.append(made["keys"])
                if sum(map(len, waiting)) > GATHERED:
                    merge()
                    if len(pairs) > GATHERED:
                        yield gathered()
                        pairs, found = pairs[:0], found[:0]
        if waiting:
            merge()
        if len(pairs):
            yield gathered()

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(numbered.mapInArrow(run, schema))


def narrow(own: Aligner) -> bool:
    """Whether a pair's key fits into four bytes."""
    return own.a.get_vocab_size() * own.b_size < 1 << 32


def count_pairs(aligned: DataFrame, b_size: int) -> DataFrame:
    """Rows (key, n, best): in how many documents a pair is linked, and whether no other B id meets its A id in more."""
    counted = cut_lineage(
        aligned.where("rid IS NULL").select(F.explode(F.arrays_zip("pairs", "found")).alias("z"))
        .groupBy(F.col("z.pairs").alias("key")).agg(F.sum("z.found").alias("n")))
    a_id = F.expr(f"key DIV {b_size}")
    most = counted.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    # One row per id of A at most.
    joined = counted.withColumn("a", a_id).join(F.broadcast(most), "a")
    return cut_lineage(joined.select("key", "n", (F.col("n") == F.col("most")).alias("best")))


def frequent_from(counted: DataFrame, pairs: int) -> int:
    """The least count (a power of two) such that at most ``pairs`` pairs have it or more."""
    sizes = {r["level"]: r["pairs"] for r in counted.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("pairs")).collect()}
    held, level = 0, max(sizes, default=0) + 1
    while level > 0 and held + sizes.get(level - 1, 0) <= pairs:
        level -= 1
        held += sizes.get(level, 0)
    return 1 << level


def align_corpus(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    a_path, b_path = a_path or public_tokenizers.path(BYTE_LEVEL), b_path or public_tokenizers.path(PIECES)
    own = Aligner(a_path, b_path)
    b_size, width = own.b_size, "<u4" if narrow(own) else "<u8"
    aligned = align_documents(docs, a_path, b_path)
    counted = count_pairs(aligned, b_size)
    least = frequent_from(counted, pairs)
    arrays = counted.where(F.col("n") >= least).sort("key").toArrow()
    sent = spark.sparkContext.broadcast(tuple(arrays[c].to_numpy() for c in ("key", "n", "best")))

    def look_up(batch: pa.RecordBatch) -> dict:
        known, n, best = sent.value
        blobs, times = batch["keys"].to_pylist(), np.frombuffer(b"".join(batch["times"].to_pylist()), "<u4").astype(np.int64)
        keys = np.frombuffer(b"".join(blobs), width).astype(np.int64)
        sizes = np.array([len(x) for x in blobs], np.int64) // np.dtype(width).itemsize
        owner = np.repeat(np.arange(len(blobs)), sizes)
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        at, rest = at[hit], np.flatnonzero(~hit)
        bounds = np.searchsorted(owner[rest], np.arange(len(blobs) + 1))
        out = {c: batch[c] for c in KEPT}
        out["count_sum"] = _sums(owner[hit], times[hit] * n[at], len(blobs))
        out["n_best"] = _sums(owner[hit], times[hit] * best[at], len(blobs))
        out["rare"] = [keys[rest[i:j]].tolist() for i, j in zip(bounds[:-1], bounds[1:])]
        out["rare_times"] = [times[rest[i:j]].tolist() for i, j in zip(bounds[:-1], bounds[1:])]
        return out

    found = cut_lineage(arrow_map(
        aligned.where("rid IS NOT NULL"), look_up,
        "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "n_best long, count_sum long, rare array<long>, rare_times array<long>"))
    sent.destroy()
    if least > 1:  # some pairs were too many to send
        rare = found.select("rid", F.explode(F.arrays_zip("rare", "rare_times")).alias("z")).select(
            "rid", F.col("z.rare").alias("key"), F.col("z.rare_times").alias("times"))
        more = rare.join(counted.where(F.col("n") < least), "key").groupBy("rid").agg(
            F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        found = found.join(more, "rid", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


KEPT = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _sums(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums per owner in whole numbers; owners come in order."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    bounds = np.searchsorted(owner, np.arange(size + 1))
    return run[bounds[1:]] - run[bounds[:-1]]


@query("op11_token_alignment")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return align_corpus(table(spark, sf, "documents"))
