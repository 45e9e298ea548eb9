"""Byte-level BPE as a lazily determinised finite-state transducer, and its inverse.

The encoding of a byte string is the only token sequence in which every neighbouring pair is
stable, that is, encodes to itself. So the last token of each prefix follows from those of
shorter prefixes, and a position matters for the future only while the bytes after it start
some longer vocabulary entry. A state of the transducer holds the pending bytes and the token
chains of the positions that still matter; once all chains share a beginning, that
beginning is emitted and leaves the state. Lookahead is
thus bounded by the longest vocabulary entry. States and transitions are compiled the first
time a text needs them.

Decoding looks tokens up and passes their bytes through an incremental UTF-8 machine that
carries an unfinished character over from one chunk of ids to the next.

Defined cases: a null or empty text has no ids and decodes to an empty text; equal rows are
encoded each; an empty table gives no rows; other columns are ignored; ids that do not form
UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.common import arrow_map, arrow_schema, texts_of
from tablewright.llm.registry import query, table
from tablewright.llm.tokens import PLAIN, has_odd_space

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Compiled transitions and remembered words per task; beyond them the cache starts afresh.
TRANSITIONS = 250_000
WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Token ids of byte strings for one rank table.

    A state is (pending bytes, live positions); a live position is (place, tokens from the
    last emitted one up to it). The token emitted last is no part of the state: where it
    matters a transition has two targets, so all texts share a state for the same bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # Rank (or -1) of the vocabulary entries and their beginnings, and whether longer entries begin so.
        longer = {t[:n] for t in ranks for n in range(1, len(t))}
        self.known = {t: (ranks.get(t, -1), t in longer) for t in longer.union(ranks)}
        self.size = {rank: len(t) for t, rank in ranks.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank and self._pair(left, right):
                    self.parts[rank] = left, right
                    self.joined[left, right] = rank
                    break
        self.stable: dict[int, bool] = {}
        self._fresh()

    def _fresh(self) -> None:
        start = (b"", ((0, ()),))
        self.numbers = {start: 0}
        self.states = [start]
        self.steps: dict[int, list] = {}

    def _pair(self, left: int, right: int) -> bool:
        """Whether the merges of ``left`` and ``right`` leave their common border alone.

        Undo the latest merge of either side again and again: had the two tokens that
        then meet been merged before that, the border would have gone.
        """
        bound = 1 << 62
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            inner, outer = self.parts.get(left), self.parts.get(right)
            if inner and (left > right or not outer):
                bound, left = left, inner[1]
            elif outer:
                bound, right = right + 1, outer[0]
            else:
                return True

    def _meets(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        key = left << 32 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= 2 * TRANSITIONS:
                self.stable.clear()
            known = self.stable[key] = self._pair(left, right)
        return known

    def _target(self, size: int, data: bytes, kept: list, path) -> tuple[int, tuple[int, ...]]:
        """(next state, ids emitted) when the prefix that ends here has the tokens ``path`` and the
        positions ``kept`` matter besides its end."""
        if not kept:  # what came before is final, and nothing is pending
            return 0, path
        # What all live positions share at the beginning is final: what the least and the greatest share.
        chains = [tokens for _, tokens in kept]
        chains.append(path)
        least, greatest = min(chains), max(chains)
        depth = 0
        for a, b in zip(least, greatest):
            if a != b:
                break
            depth += 1
        base = kept[0][0]
        if base or depth:
            live = [(place - base, tokens[depth:]) for place, tokens in kept]
            live.append((size - base, path[depth:]))
            state = data[base:], tuple(live)
        else:
            state = data, (*kept, (size, path))
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number, path[:depth]

    def _step(self, number: int, byte: int) -> list:
        """Compile one transition: [token, target, other target].

        If the pending bytes as a whole become a vocabulary entry, the first target holds
        where that ``token`` may follow the one emitted last, and the other one elsewhere;
        ``token`` is -1 where nothing depends on that.
        """
        pending, live = self.states[number]
        data = pending + bytes((byte,))
        size, known = len(data), self.known
        token, path, kept = -1, None, []
        for at in live:
            place, tokens = at
            found = known.get(data[place:] if place else data)
            if found is None:
                continue
            rank, goes_on = found
            if goes_on:
                kept.append(at)
            if rank >= 0:
                if not tokens:
                    if not place:
                        token = rank
                elif path is None and self._meets(tokens[-1], rank):
                    path = (*tokens, rank)
        target = self._target(size, data, kept, (token,)) if token >= 0 else None
        other = self._target(size, data, kept, path) if path else None
        out = self.steps[number << 8 | byte] = [token, target if token >= 0 else other, other]
        return out

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece of text, read byte by byte."""
        if len(self.steps) >= TRANSITIONS:
            self._fresh()
        ids: list[int] = []
        number, before, steps, stable = 0, -1, self.steps, self.stable
        for byte in data:
            found = steps.get(number << 8 | byte)
            if found is None:
                found = self._step(number, byte)
            token = found[0]
            if token >= 0 and before >= 0:
                fits = stable.get(before << 32 | token)
                if fits is None:
                    fits = self._meets(before, token)
                number, emitted = found[1] if fits else found[2]
            else:
                number, emitted = found[1]
            if emitted:
                ids.extend(emitted)
                before = emitted[-1]
        ids.extend(self.states[number][1][-1][1])  # the last live position is the end
        return ids


class _Memory(dict):
    """Text -> packed ids, filled on demand and started afresh when full."""

    def __init__(self, fill):
        self.fill = fill

    def __missing__(self, text: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        packed = self[text] = self.fill(text)
        return packed


class Encoder:
    """Ids of whole texts: every match of the pattern goes through the transducer.

    A blank before a word belongs to the word, so a line without runs of white space can
    be cut at its blanks and each part be matched and encoded once.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.machine = Transducer(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.by_blanks = pattern == public_tokenizers.PATTERN
        self.first = _Memory(lambda part: self._part("", part, self.first))
        self.after_blank = _Memory(lambda part: self._part(" ", part, self.after_blank))
        self.pieces = _Memory(self._piece)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.machine.encode(piece.encode())).tobytes()

    def _part(self, blank: str, part: str, memory: _Memory) -> bytes:
        """A word with its marks is two matches, of which the word may be known alone; anything else is left to the pattern."""
        plain = PLAIN.fullmatch(part)
        if plain is None or not part:
            return self._matches(blank + part)
        word, marks = plain.groups()
        if not word:
            return self.pieces[blank + marks]
        return memory[word] + self.pieces[marks] if marks else self._piece(blank + word)

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        if not self.by_blanks or has_odd_space(text):
            return np.frombuffer(self._matches(text), "<i4")
        packed = []
        for line in text.split("\n"):
            head, _, rest = line.partition(" ")
            packed.append(self.first[head])
            if rest:
                packed.extend(map(self.after_blank.__getitem__, rest.split(" ")))
            packed.append(self.first["\n"])
        return np.frombuffer(b"".join(packed[:-1]), "<i4")


def utf8_tail(data: bytes) -> int:
    """How many bytes at the end of ``data`` begin a character that is not complete yet.

    The machine of the encoding: a lead byte announces how many continuation bytes follow.
    """
    for back in range(1, min(4, len(data) + 1)):
        byte = data[-back]
        if byte & 0xC0 == 0x80:
            continue
        needed = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
        return back if needed > back else 0
    return 0


class Decoder:
    """Text of ids, chunk by chunk."""

    def __init__(self, ranks: dict[bytes, int], chunk: int = 4_096):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.chunk = chunk

    def decode(self, ids) -> str:
        carried, out = b"", []
        for at in range(0, len(ids), self.chunk):
            data = carried + b"".join(map(self.tokens.__getitem__, ids[at: at + self.chunk]))
            cut = len(data) - utf8_tail(data)
            out.append(data[:cut].decode("utf-8", "replace"))
            carried = data[cut:]
        out.append(carried.decode("utf-8", "replace"))
        return "".join(out)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, ids array<int>) for every row of ``docs``."""
    path = path or public_tokenizers.path(VOCABULARY)
    made: list[Encoder] = []

    def run(batches):
        if not made:
            made.append(Encoder(path, pattern))
        for batch in batches:
            ids = [made[0].encode(t) for t in texts_of(batch["text"])]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists.cast(arrow.field("ids").type)], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = rows.sparkSession.createDataFrame([], "doc_id long, ids array<int>").schema
    arrow = arrow_schema(kind)
    return rows.mapInArrow(run, kind)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded ``text``."""
    path = path or public_tokenizers.path(VOCABULARY)
    made: list[Decoder] = []

    def step(batch):
        if not made:
            made.append(Decoder(read_ranks(path)))
        lists = batch["ids"]
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        return {"doc_id": batch["doc_id"], "ids": lists,
                "text": [made[0].decode(flat[a:b].tolist()) for a, b in zip(np.r_[0, ends[:-1]], ends)]}

    return arrow_map(encoded.select("doc_id", "ids"), step, "doc_id long, ids array<int>, text string")


@query("op7_bpe_transducer")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return decode(encode(table(spark, sf, "documents"))).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"))
