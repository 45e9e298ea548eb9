"""Repeated passages by distributed prefix doubling.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Sorting
all positions by what follows would find these strings, but most positions are unique after
a few bytes, so positions are named only where names are needed:

1. *First names.* Every window of ``LENGTH`` bytes appoints one anchor: of the ``REACH`` places in its
   middle the one whose 16 bytes hash lowest. The choice depends on the window alone, so
   equal windows appoint the same place. An anchor is named by the ``REACH`` bytes on either
   side. Windows whose anchor's name occurs once are unique and are dropped.
2. *Doubling.* Spark sorts the (name, offset, name) triples of neighbouring anchors, then of runs of two,
   four ... anchors, and reranks: a run is named by its parts, and goes on while its name
   recurs and it is shorter than ``LENGTH``. Past that, all windows inside it are repeated.
3. *Edges.* What remains are windows at the ends of repeats, between the runs and the first
   differing byte. They are compared by hash, in blocks that shrink, with each other and with
   the windows under the same anchor name inside one run of each name, which stands for its equals.

Names and hashes have 64 bits and stand for the bytes they were made of. Equal names are
counted map-side, then joined, so passages shared by a third of the corpus spread out. Each
round holds the surviving positions only and is written to the shared folder.

Defined cases: null reads as empty; texts shorter than ``LENGTH`` bytes lose nothing; equal rows
are separate documents and repeat each other; a null doc_id is kept; an empty table gives
no rows; other columns pass through :func:`cut_repeats` unchanged.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.common import arrow_map, texts_of, union_all, with_row_ids
from tablewright.llm.pairs import whole_groups
from tablewright.llm.registry import query, table
from tablewright.session import cut_lineage

LENGTH = 400
GRAM = 16
# The anchor lies REACH to 2 REACH - 1 bytes into its window: 3 * REACH + GRAM - 1 <= LENGTH.
REACH = 128
# Windows at the edges of repeats are judged so many at a time, then fewer.
BLOCKS = (64, 16, 4, 1)
# Bytes of text hashed at once; longer texts go in overlapping pieces.
PIECE = 1 << 21

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    first = np.ndarray((n,), "<u8", data, 0, (1,))
    second = np.ndarray((n,), "<u8", data, 8, (1,))
    return _mix(_mix(first * _B) + second)


def _span_hash(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a multiple of ``GRAM``) from each start on."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, size, GRAM):
        out = out * _B + grams[starts + at]
    return _mix(out)


def _pair(left, gap, right) -> np.ndarray:
    return _mix(_mix(left.view(np.uint64) * _B + gap.astype(np.uint64)) + right.view(np.uint64))


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, name) of the anchors of one piece of at least ``LENGTH`` bytes."""
    grams = gram_hashes(data)
    low = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    width = 1
    while width < REACH:  # the lowest of REACH places, the later one where two are equal
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    windows = len(data) - LENGTH + 1
    place = (_LOW - (low[REACH: REACH + windows] & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], windows] - 1
    at = place[first]
    return at, first, last, _span_hash(grams, at - REACH, 2 * REACH + GRAM)


def _pieces(data: np.ndarray):
    for start in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        yield start, data[start: start + PIECE + LENGTH - 1]


def _anchor_rows(batch) -> dict:
    rids, parts = [], []
    for rid, text in zip(batch["rid"].to_pylist(), texts_of(batch["text"])):
        data = np.frombuffer(text.encode(), np.uint8)
        for start, piece in _pieces(data):
            if len(piece) >= LENGTH:
                at, first, last, name = anchors(piece)
                parts.append((at + start, first + start, last + start, name.view(np.int64)))
                rids.append(np.full(len(at), rid))
    if not parts:
        return {c: [] for c in ("rid", "spot", "name")}
    at, first, last, name = map(np.concatenate, zip(*parts))
    # One number for the place and its windows, which begin REACH to 2 REACH - 1 bytes before it.
    spot = at << 14 | (at - REACH - first) << 7 | (at - REACH - last)
    return {"rid": np.concatenate(rids), "spot": spot, "name": name}


def _unpack(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = spot >> 14
    return at, at - REACH - (spot >> 7 & 127), at - REACH - (spot & 127)


RUNS = "rid long, level int, low long, high long, name long"
# Runs of anchors this far apart cover LENGTH bytes.
_FAR = LENGTH - 2 * REACH - GRAM


def _neighbours(rows: dict) -> dict:
    """First round: pairs of anchors whose windows follow each other."""
    at, first, last = _unpack(rows["spot"])
    rid, name = rows["rid"], rows["name"]
    # A text hashed in pieces may give an anchor twice: join the two.
    twice = np.flatnonzero((rid[1:] == rid[:-1]) & (at[1:] == at[:-1]))
    first[twice + 1] = first[twice]
    once = np.ones(len(rid), bool)
    once[twice] = False
    rid, at, first, last, name = (x[once] for x in (rid, at, first, last, name))
    i = np.flatnonzero((rid[1:] == rid[:-1]) & (first[1:] == last[:-1] + 1))
    low, high = at[i], at[i + 1]
    return {"rid": rid[i], "level": np.ones(len(i), np.int32), "low": low, "high": high,
            "name": _pair(name[i], high - low, name[i + 1]).view(np.int64)}


def _double(level: int, rows: dict) -> dict:
    """Next round: each short run of ``level`` with a run that begins at its last anchor, of the
    lowest level that carries it past the threshold, else of its own."""
    _, text = np.unique(rows["rid"], return_inverse=True)
    begin = text.astype(np.int64) << 40 | rows["low"]
    todo = np.flatnonzero((rows["level"] == level) & (rows["high"] - rows["low"] < _FAR))
    wanted = text[todo].astype(np.int64) << 40 | rows["high"][todo]
    high = np.zeros(len(todo), np.int64)
    other = np.zeros(len(todo), np.int64)
    for step in range(1, level + 1):
        of_step = np.flatnonzero(rows["level"] == step)
        order = of_step[np.argsort(begin[of_step], kind="stable")]
        if not len(order):
            continue
        found = np.minimum(np.searchsorted(begin[order], wanted), len(order) - 1)
        fits = (begin[order][found] == wanted) & (high - rows["low"][todo] < _FAR)
        far = rows["high"][order][found]
        use = fits & ((far - rows["low"][todo] >= _FAR) | (step == level))
        high[use] = far[use]
        other[use] = rows["name"][order][found][use]
    hit = high > 0
    i = todo[hit]
    return {"rid": rows["rid"][i], "level": np.full(len(i), level + 1, np.int32),
            "low": rows["low"][i], "high": high[hit],
            "name": _pair(rows["name"][i], rows["high"][i] - rows["low"][i], other[hit]).view(np.int64)}


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose name occurs in two rows at least."""
    names = rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return rows.join(names, "name", "left_semi")


def _to_compare(rows: dict) -> dict:
    """What windows of surviving anchors (level 0) have to be compared: (rid, name, at, low, high,
    open), low and high as offsets from the anchor. Open windows lie in no long run (level 1);
    of those that do, the ones in a run that stands for its equals (level 2) are named."""
    out = {c: [] for c in ("rid", "name", "at", "low", "high", "open")}
    bounds = np.flatnonzero(np.r_[True, rows["rid"][1:] != rows["rid"][:-1], True])
    for a, b in zip(bounds, bounds[1:]):
        part = {c: v[a:b] for c, v in rows.items()}
        anchor = part["level"] == 0
        if not anchor.any():
            continue
        at, first, last = _unpack(part["low"][anchor])
        base, end = int(first.min()), int(last.max()) + 2

        def inside(level: int) -> np.ndarray:
            covered = np.zeros(end - base + 1, np.int32)
            low = part["low"][part["level"] == level] - REACH - base
            high = part["high"][part["level"] == level] + REACH + GRAM - LENGTH - base
            np.add.at(covered, np.clip(low, 0, end - base), 1)
            np.add.at(covered, np.clip(high + 1, 0, end - base), -1)
            return np.cumsum(covered)[: end - base] > 0

        for kind, places in ((True, np.flatnonzero(~inside(1))), (False, np.flatnonzero(inside(2)))):
            i, j = np.searchsorted(places, first - base), np.searchsorted(places, last - base, "right")
            has = np.flatnonzero(i < j)
            out["rid"].append(np.full(len(has), part["rid"][0]))
            out["name"].append(part["name"][anchor][has])
            out["at"].append(at[has])
            out["low"].append(places[i[has]] + base - at[has] if len(has) else at[has])
            out["high"].append(places[j[has] - 1] + base - at[has] if len(has) else at[has])
            out["open"].append(np.full(len(has), kind))
    return {c: np.concatenate(v) for c, v in out.items()} if out["name"] else {c: [] for c in out}


def _string_hash(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (``GRAM`` at least) from each start on."""
    out = _span_hash(grams, starts, size // GRAM * GRAM)
    return _mix(out * _B + grams[starts + size - GRAM]) if size % GRAM else out


def _block_hashes(width: int, batch) -> dict:
    """For blocks of ``width`` windows of each text: hashes of the bytes that they cover together
    (``outer``, null where the block overhangs the text) and that all of them share (``core``).
    ``first`` marks one row of those that begin at the same place."""
    out = {c: [] for c in ("rid", "name", "at", "off", "open", "outer", "core", "first")}
    # the questions of all texts stay in flat arrays
    bounds, flat = batch["asked"].offsets.to_numpy(), batch["asked"].flatten()
    asked = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "off", "name", "open")]
    bounds = bounds - bounds[0]
    for i, rid in enumerate(batch["rid"].to_pylist()):
        data = np.frombuffer(batch["text"][i].as_py().encode(), np.uint8)
        at, off, name, is_open = (v[bounds[i]: bounds[i + 1]] for v in asked)
        x = at + off
        for start, piece in _pieces(data):
            mine = np.flatnonzero((x + width > 0) & (x + LENGTH <= len(data)) & (np.maximum(x, 0) >= start)
                                  & (np.maximum(x, 0) < start + PIECE))
            if not len(mine):
                continue
            piece = data[max(0, start - width): start + PIECE + LENGTH + width]
            grams, place = gram_hashes(piece), x[mine] - max(0, start - width)
            whole = (x[mine] >= 0) & (x[mine] + LENGTH + width - 1 <= len(data))
            outer = np.zeros(len(mine), np.int64)
            outer[whole] = _string_hash(grams, place[whole], LENGTH + width - 1).view(np.int64)
            core = _string_hash(grams, place + width - 1, LENGTH + 1 - width).view(np.int64)
            once = np.zeros(len(mine), bool)
            once[np.unique(x[mine], return_index=True)[1]] = True
            out["rid"].append(np.full(len(mine), rid))
            for c, v in (("name", name), ("at", at), ("off", off), ("open", is_open)):
                out[c].append(v[mine])
            out["outer"].append(np.ma.masked_array(outer, ~whole))
            out["core"].append(core)
            out["first"].append(once)
    if not out["rid"]:
        return {c: [] for c in out}
    outer = np.ma.concatenate(out.pop("outer"))
    done = {c: np.concatenate(v) for c, v in out.items()}
    return {**done, "outer": pa.array(outer.data, mask=np.ma.getmaskarray(outer))}


def _edges(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Repeated windows at the edges of runs, as (rid, low, high) byte ranges.

    Windows are judged in blocks at equal distances from their anchors. A block is repeated
    if the bytes that it covers are, and unique if the bytes that its windows share are;
    only the blocks between are cut into smaller ones, down to single windows. A block that is
    settled goes on as a possible equal of others, one for all that cover the same bytes at the
    same distance from an anchor of the same name: others may look for it under any of its names.
    """
    blocks, found = None, []
    for step, width in enumerate(BLOCKS):
        if blocks is None:
            offsets = F.explode(F.sequence(F.floor(F.col("low") / width) * width, F.floor(F.col("high") / width) * width, F.lit(width)))
            blocks = marks.select("rid", "name", "at", "open", offsets.alias("off"))
        else:
            parts = F.explode(F.sequence(F.col("off"), F.col("off") + BLOCKS[step - 1] - 1, F.lit(width)))
            blocks = blocks.select("rid", "name", "at", "open", parts.alias("off"))
        blocks = blocks.groupBy("rid", "name", "at", "off").agg(F.max("open").alias("open"))
        wanted = blocks.where("open").select("name", "off").distinct()
        blocks = blocks.where("open").unionByName(
            blocks.where("NOT open").join(wanted, ["name", "off"], "left_semi").select("rid", "name", "at", "off", "open"))
        asked = blocks.groupBy("rid").agg(F.collect_list(F.struct("name", "at", "off", "open")).alias("asked"))
        hashed = cut_lineage(arrow_map(
            texts.join(asked, "rid"), partial(_block_hashes, width),
            "rid long, name long, at long, off long, open boolean, outer long, core long, first boolean"))
        place = F.struct("rid", "at", "off")
        heads = hashed.where("outer IS NOT NULL").groupBy("outer", "name", "off").agg(
            F.count_if("first").alias("n"), F.min(place).alias("head"))
        same = heads.groupBy("outer").agg(F.sum("n").alias("n_outer")).where("n_outer > 1")
        heads = heads.drop("n").join(same, "outer")
        near = hashed.groupBy("core").agg(F.count_if("first").alias("n_core")).where("n_core > 1").select("core")
        judged = cut_lineage(
            hashed.join(near, "core", "left_semi").join(heads, ["outer", "name", "off"], "left")
            .select("rid", "name", "at", "off", "open", F.col("n_outer").isNotNull().alias("settled"),
                    (F.col("head").isNull() | (F.col("head") == place)).alias("stays")))
        found.append(judged.where("open AND settled").select(
            "rid", (F.col("at") + F.col("off")).alias("low"), (F.col("at") + F.col("off") + LENGTH + width - 1).alias("high")))
        blocks = judged.where("(open AND NOT settled) OR stays").select(
            "rid", "name", "at", "off", (F.col("open") & ~F.col("settled")).alias("open"))
    return union_all(found)


def repeats(stored: DataFrame) -> DataFrame:
    """Texts with repeated passages: (rid, text, spans), spans as an array of (low, high) byte
    ranges that may overlap. ``stored`` has rid, unique and stable, and text."""
    every = cut_lineage(arrow_map(stored.select("rid", "text").where(F.octet_length("text") >= LENGTH), _anchor_rows,
                                  "rid long, spot long, name long"))
    first = cut_lineage(_repeated(every))
    candidates = cut_lineage(whole_groups(first, "rid", ["spot"], _neighbours, RUNS))
    kept = runs = cut_lineage(_repeated(candidates))
    level = 1
    while not kept.where(F.col("high") - F.col("low") < _FAR).isEmpty():
        more = whole_groups(runs, "rid", ["level", "low"], partial(_double, level), RUNS)
        kept = cut_lineage(_repeated(cut_lineage(more)))
        runs = runs.union(kept)
        level += 1
    past = runs.where(F.col("high") - F.col("low") >= _FAR).select("rid", "low", "high", "name")
    # Edges. Windows inside a run are those of any equal run, so one run stands for all.
    chosen = past.groupBy("name").agg(F.min(F.struct("rid", "low", "high")).alias("r")).select("r.*", "name")

    def at_level(rows: DataFrame, level: int) -> DataFrame:
        return rows.select("rid", F.lit(level).alias("level"), "low", "high", "name")

    spots = first.select("rid", F.col("spot").alias("low"), F.lit(0).cast("long").alias("high"), "name")
    marks = cut_lineage(whole_groups(
        at_level(spots, 0).union(at_level(past, 1)).union(at_level(chosen, 2)), "rid", ["level", "low"], _to_compare,
        "rid long, name long, at long, low long, high long, open boolean"))
    # The texts that have candidates at all, once more on their own.
    texts = cut_lineage(stored.select("rid", "text").join(first.select("rid").distinct(), "rid"))
    edges = _edges(texts, marks)
    spans = past.select("rid", (F.col("low") - REACH).alias("low"), (F.col("high") + REACH + GRAM).alias("high"))
    return texts.join(
        spans.union(edges).groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "rid")


def removed_mask(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, low, 1)
    np.add.at(mark, high, -1)
    return np.cumsum(mark[:-1]) > 0


def cut(found: DataFrame) -> DataFrame:
    """Rows (rid, n_bytes, removed array of (low, high), kept binary) of :func:`repeats`."""

    def step(batch):
        out = {"rid": batch["rid"], "n_bytes": [], "removed": [], "kept": []}
        bounds, flat = batch["spans"].offsets.to_numpy(), batch["spans"].flatten()
        low, high = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
        bounds = bounds - bounds[0]
        for text, a, b in zip(batch["text"].to_pylist(), bounds, bounds[1:]):
            data = np.frombuffer(text.encode(), np.uint8)
            gone = removed_mask(len(data), low[a:b], high[a:b])
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            out["n_bytes"].append(len(data))
            out["removed"].append([{"low": int(a), "high": int(b)} for a, b in edges.reshape(-1, 2)])
            out["kept"].append(data[~gone].tobytes())
        return out

    return arrow_map(found, step, "rid long, n_bytes long, removed array<struct<low:long,high:long>>, kept binary")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all repeated passages cut out of their texts; the other columns stay.

    Cutting by bytes may split a character; what is left of it goes too. Documents stay
    even if nothing of their text does.
    """
    stored = with_row_ids(docs, "row__")
    short = arrow_map(cut(repeats(stored.select(F.col("row__").alias("rid"), "text"))), lambda b: {
        "row__": b["rid"], "text__": [k.decode("utf-8", "ignore") for k in b["kept"].to_pylist()],
    }, "row__ long, text__ string")
    short = cut_lineage(short)
    changed = stored.join(short, "row__").withColumn("text", F.col("text__"))
    return stored.join(short.select("row__"), "row__", "left_anti").select(*docs.columns).unionByName(
        changed.select(*docs.columns))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    stored = with_row_ids(table(spark, sf, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))

    def digest(batch):
        return {"rid": batch["rid"], "removed": [sum(s["high"] - s["low"] for s in r) for r in batch["removed"].to_pylist()],
                "spans": [len(r) for r in batch["removed"].to_pylist()],
                "sha": [hashlib.sha256(k).hexdigest() for k in batch["kept"].to_pylist()]}

    found = arrow_map(cut(repeats(stored)), digest, "rid long, removed long, spans long, sha string")
    whole = stored.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                          F.sha2("text", 256).alias("own_sha"))
    return whole.join(found, "rid", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "own_sha").alias("kept_sha256"))
