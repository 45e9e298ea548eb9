"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters with two inputs: the embedding of the word itself (hashed) and the mean of its
character trigrams' embeddings (hashed), so unseen spellings still resemble known ones. A
window of ``WINDOW`` words runs through one gated recurrent layer in each direction;
attention pools the states into one vector and a logistic unit scores it. A document is scored by all
its overlapping windows, one from every word on, and its logit is the highest of them. Training reads
the same windows of each sampled document on every visit.

The network is written and trained here in numpy, by one Spark task, from at most ``SAMPLE``
labelled documents of either class with at most ``SAMPLE_BYTES`` of text (but one at least): the ones
with the smallest hash of their id, so the model does not depend on the partitioning; of several texts
under one id the smallest is read. Only the parameters reach the driver. The logits are then scaled by logistic regression on
the same documents at their true class shares. Scoring reads every word of every text.

Defined cases: a null or empty text is one empty window and gets its score; equal rows are scored
each; a text of any length is read whole, many short ones at a time; unlabelled rows and null labels
never train; without labelled rows of both
classes every score is the share of toxic labels (0 if there is none); an empty table gives
no rows; other columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from pickle import dumps, loads

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.common import arrow_map, texts_of
from tablewright.llm.registry import query, table
from tablewright.session import cut_lineage

WINDOW = 32
BUCKETS, WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 1 << 13, 8, 8, 8, 8
SAMPLE, SAMPLE_BYTES = 3_000, 1 << 25
# Documents shown in training, at least EPOCHS times each.
VISITS, EPOCHS, BATCH, RATE = 12_000, 4, 64, 0.01
# Windows run side by side, and threads that run them in training.
SIDE, THREADS = 2_048, 4
# Bytes of text scored at a time.
HELD = 1 << 20
WORD_MEMORY = 200_000
_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


# -- words ------------------------------------------------------------------------------


class Words(dict):
    """Word -> number, with the hashed inputs of the words added since the last call."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1  # 0 is padding
        self.new.append(word.strip(_EDGE))
        return number

    def numbers(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def inputs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, character buckets of all words in a row, first of each word)."""
    data = np.frombuffer(b"\x01" + b"\x02\x01".join(words) + b"\x02", np.uint8).astype(np.uint32)
    lengths = np.array([len(w) for w in words], np.int64) + 2
    first = np.cumsum(lengths) - lengths
    # Trigrams begin at all but the last two places of a word; a lone mark has none of its own.
    three = np.r_[data, 0, 0]
    codes = ((three[:-2] * 257 + three[1:-1]) * 257 + three[2:]) * np.uint32(2654435761)
    inside = np.ones(len(data), bool)
    inside[first + lengths - 1] = False
    many = lengths > 2
    inside[(first + lengths - 2)[many]] = False
    chars = (codes >> np.uint32(19)).astype(np.int64)[inside]
    counts = np.where(many, lengths - 2, 1)
    powers = np.uint32(16777619) ** (np.arange(len(data), dtype=np.uint32) - np.repeat(first, lengths).astype(np.uint32))
    whole = np.add.reduceat(data * powers, first, dtype=np.uint32) * np.uint32(2654435761)
    return (whole >> np.uint32(19)).astype(np.int64), chars, np.cumsum(counts) - counts


def windows_of(length: int) -> np.ndarray:
    """First words of the windows of a text: all places from which it has ``WINDOW`` words."""
    return np.arange(max(1, length - WINDOW + 1))


# -- the network --------------------------------------------------------------------------


@dataclass
class Network:
    """Parameters by name, and the two numbers that scale a logit to a probability."""

    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, seed: int = 6) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape, by):
            return rng.normal(0, by, shape).astype(np.float32)

        both = 2 * HIDDEN
        return cls({
            "word": normal(BUCKETS, WORD_SIZE, by=0.1), "char": normal(BUCKETS, CHAR_SIZE, by=0.1),
            "x": normal(WORD_SIZE + CHAR_SIZE, 3 * both, by=0.25), "x0": np.zeros(3 * both, np.float32),
            "h": normal(both, 3 * both, by=0.25) * _block(),
            "a": normal(both, ATTENTION, by=0.3), "v": normal(ATTENTION, by=0.5),
            "o": normal(both, by=0.5), "o0": np.zeros(1, np.float32),
        })

    def embed(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        bucket, chars, first = inputs_of(words)
        counts = np.diff(np.r_[first, len(chars)])
        mean = np.add.reduceat(self.p["char"][chars], first, axis=0) / counts[:, None]
        return np.hstack([self.p["word"][bucket], mean]).astype(np.float32), (bucket, chars, counts)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs of the gates, one row per word."""
        return x @ self.p["x"] + self.p["x0"]

    def run(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows. ``index`` (steps, windows) points into ``gates``; 0 is padding."""
        p, (steps, n), both = self.p, index.shape, 2 * HIDDEN
        rows = gates.reshape(-1, 3, both)
        state = np.zeros((n, both), np.float32)
        states = np.zeros((steps, n, both), np.float32)
        there = index > 0
        x = np.empty((n, 3, both), np.float32)
        cache = []
        for t in range(steps):
            back = steps - 1 - t
            x[:, :, :HIDDEN] = rows[index[t], :, :HIDDEN]
            x[:, :, HIDDEN:] = rows[index[back], :, HIDDEN:]
            g = (state @ p["h"]).reshape(n, 3, both)
            zr = _sigmoid(x[:, :2] + g[:, :2])
            new = np.tanh(x[:, 2] + zr[:, 1] * g[:, 2])
            before = state
            state = new + zr[:, 0] * (before - new)
            state[:, :HIDDEN] *= there[t][:, None]
            state[:, HIDDEN:] *= there[back][:, None]
            states[t, :, :HIDDEN] = state[:, :HIDDEN]
            states[back, :, HIDDEN:] = state[:, HIDDEN:]
            if keep:
                cache.append((before, zr, new, g[:, 2].copy()))
        bent = np.tanh(states @ p["a"])
        raw = np.where(there, bent @ p["v"], -30).astype(np.float32)
        weight = np.exp(raw - raw.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        logits = pooled @ p["o"] + p["o0"][0]
        return (logits, (states, bent, weight, pooled, there, cache)) if keep else logits

    def sweep(self, gates: np.ndarray, numbers: np.ndarray, threads: int = 1) -> np.ndarray:
        """Logits as of :meth:`run` of the windows from each place of ``numbers`` on that has
        ``WINDOW`` numbers, which point into ``gates``; 0 is padding."""
        both = 2 * HIDDEN
        signs = np.repeat(np.array([-1, -1, 2], np.float32), both)  # for sigmoids and tanh by exp
        inner, bend = np.ascontiguousarray((self.p["h"] * signs).T), np.ascontiguousarray(2 * self.p["a"].T)
        out = np.empty(max(0, len(numbers) - WINDOW + 1), np.float32)

        def tanh_of_half(x: np.ndarray) -> None:
            np.exp(np.minimum(x, 80, out=x), out=x)
            x += 1
            np.divide(-2, x, out=x)
            x += 1

        def some(at: int) -> None:
            n = min(SIDE, len(out) - at)
            mine = numbers[at: at + n + WINDOW - 1]
            x = np.ascontiguousarray((gates.take(mine, axis=0) * signs).T)
            there = (mine > 0).astype(np.float32)
            whole = bool(there.all())
            state, states = np.zeros((both, n), np.float32), np.empty((WINDOW, both, n), np.float32)
            g, gap = np.empty((3 * both, n), np.float32), np.empty((both, n), np.float32)
            zr, new, z, r = g[: 2 * both], g[2 * both:], g[:both], g[both: 2 * both]
            for t in range(WINDOW):
                back = WINDOW - 1 - t
                np.matmul(inner, state, out=g)
                for first, time in ((0, t), (HIDDEN, back)):
                    z[first: first + HIDDEN] += x[first: first + HIDDEN, time: time + n]
                    r[first: first + HIDDEN] += x[both + first: both + first + HIDDEN, time: time + n]
                np.exp(np.minimum(zr, 80, out=zr), out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                new *= r
                for first, time in ((0, t), (HIDDEN, back)):
                    new[first: first + HIDDEN] += x[2 * both + first: 2 * both + first + HIDDEN, time: time + n]
                tanh_of_half(new)
                np.subtract(state, new, out=gap)
                gap *= z
                np.add(new, gap, out=state)
                if not whole:
                    state[:HIDDEN] *= there[t: t + n]
                    state[HIDDEN:] *= there[back: back + n]
                states[t, :HIDDEN], states[back, HIDDEN:] = state[:HIDDEN], state[HIDDEN:]
            bent = np.matmul(bend, states)
            tanh_of_half(bent)
            weight = np.matmul(self.p["v"], bent)
            if not whole:
                weight[np.lib.stride_tricks.sliding_window_view(there, n) == 0] = -30
            weight -= weight.max(0)
            np.exp(weight, out=weight)
            out[at: at + n] = (weight * np.matmul(self.p["o"], states)).sum(0) / weight.sum(0) + self.p["o0"][0]

        parts = range(0, len(out), SIDE)
        if threads > 1:
            with ThreadPool(threads) as pool:
                pool.map(some, parts)
        else:
            for at in parts:
                some(at)
        return out

    def gradients(self, gates, index, slope) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the summed loss, given its slope at each logit: parameters, and ``gates``."""
        p, (steps, n), both = self.p, index.shape, 2 * HIDDEN
        _, (states, bent, weight, pooled, there, cache) = self.run(gates, index, keep=True)
        out = {"o": pooled.T @ slope, "o0": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * p["o"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(2)
        d_raw = weight * (d_weight - (weight * d_weight).sum(0)) * there
        out["v"] = np.einsum("tna,tn->a", bent, d_raw)
        d_bent = d_raw[:, :, None] * p["v"] * (1 - bent ** 2)
        out["a"] = np.einsum("tnh,tna->ha", states, d_bent)
        d_states = d_states + d_bent @ p["a"].T
        d_gates = np.zeros((len(gates), 3, both), np.float32)
        d_h = np.zeros_like(p["h"])
        carried = np.zeros((n, both), np.float32)
        for t in reversed(range(steps)):
            back = steps - 1 - t
            before, zr, new, rec = cache[t]
            d = carried
            d[:, :HIDDEN] += d_states[t, :, :HIDDEN]
            d[:, HIDDEN:] += d_states[back, :, HIDDEN:]
            d[:, :HIDDEN] *= there[t][:, None]
            d[:, HIDDEN:] *= there[back][:, None]
            z, r = zr[:, 0], zr[:, 1]
            d_new = d * (1 - z) * (1 - new ** 2)
            dx = np.stack([d * (before - new) * z * (1 - z), d_new * rec * r * (1 - r), d_new], 1)
            dg = dx.copy()
            dg[:, 2] *= r
            flat = dg.reshape(n, -1)
            d_h += before.T @ flat
            carried = d * z + flat @ p["h"].T
            np.add.at(d_gates[:, :, :HIDDEN], index[t], dx[:, :, :HIDDEN])
            np.add.at(d_gates[:, :, HIDDEN:], index[back], dx[:, :, HIDDEN:])
        out["h"] = d_h * _block()
        d_gates[0] = 0
        return out, d_gates.reshape(len(gates), -1)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * logits.astype(np.float64) + self.scale[1])


def _block() -> np.ndarray:
    """The directions do not see each other's state."""
    same = np.kron(np.eye(2), np.ones((HIDDEN, HIDDEN)))
    return np.tile(same, (1, 3)).astype(np.float32)


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers in a row, short texts filled up to a window; the first window of each text in
    it, and the number of its windows. No window of a text reaches the next one."""
    count = np.array([len(windows_of(len(d))) for d in docs])
    sizes = count + WINDOW - 1
    offset = np.cumsum(sizes) - sizes
    numbers = np.zeros(sizes.sum(), np.int64)
    for d, at in zip(docs, offset):
        numbers[at: at + len(d)] = d
    return numbers, offset, count


# -- training ---------------------------------------------------------------------------------


def train(texts: list[str], toxic: np.ndarray, share: float, visits: int = VISITS, seed: int = 6) -> Network:
    """Fit to whole documents: each step scores all windows of each and moves the highest."""
    net, rng, words = Network.fresh(seed), np.random.default_rng(seed), Words()
    docs = [words.numbers(t) for t in texts]
    names = [b""] + words.new
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    weight = np.where(toxic > 0, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9))
    step, epochs = 0, max(EPOCHS, -(-visits // len(docs)))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), BATCH):
            batch = order[at: at + BATCH]
            numbers, offset, count = _joined([docs[i] for i in batch])
            used, numbers = np.unique(np.r_[0, numbers], return_inverse=True)
            numbers = numbers[1:]
            x, (bucket, chars, counts) = net.embed([names[i] for i in used])
            gates = net.project(x)
            logits = net.sweep(gates, numbers, THREADS)
            best = np.array([a + logits[a: a + n].argmax() for a, n in zip(offset, count)])
            index = numbers[best[None, :] + np.arange(WINDOW)[:, None]]
            slope = ((_sigmoid(logits[best]) - toxic[batch]) * weight[batch] / len(batch)).astype(np.float32)
            grads, d_gates = net.gradients(gates, index, slope)
            grads["x"], grads["x0"] = x.T @ d_gates, d_gates.sum(0)
            d_x = d_gates @ net.p["x"].T
            grads["word"], grads["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(grads["word"], bucket, d_x[:, :WORD_SIZE])
            np.add.at(grads["char"], chars, np.repeat(d_x[:, WORD_SIZE:] / counts[:, None], counts, axis=0))
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    scorer = Scorer(net)
    logits = np.concatenate([scorer.logits(texts[at: at + 200]) for at in range(0, len(texts), 200)]).astype(float)
    net.scale = _scaling(logits, toxic, np.where(toxic > 0, share / max(toxic.mean(), 1e-9),
                                                 (1 - share) / max(1 - toxic.mean(), 1e-9)))
    return net


def _scaling(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression, lightly held to (1, 0)."""
    x = np.stack([logits, np.ones_like(logits)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ b)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        b = b - np.clip(np.linalg.solve(hess, x.T @ (weight * (p - toxic)) + 0.1 * (b - [1, 0])), -2, 2)
    return float(max(b[0], 1e-3)), float(b[1])


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, most: int = SAMPLE_BYTES,
    visits: int = VISITS,
) -> Network | float:
    """The network trained on the labelled rows outside fold 0, or the share of toxic labels
    if only one class is labelled."""
    key = F.col("doc_id").cast("long")
    usable = labels.select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold(F.col("doc_id"), folds) != 0)
    n = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return share
    mixed = F.xxhash64(F.lit(6), "doc_id")
    drawn = [usable.where(F.col("toxic") == c).orderBy(mixed, "doc_id").limit(sample) for c in (0, 1)]
    # At most two samples of ids go to the tasks, and as many texts to the shared folder.
    texts = cut_lineage(
        docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(drawn[0].union(drawn[1]).distinct()), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("mixed", mixed))
    sizes = texts.select("toxic", "mixed", "doc_id", F.octet_length("text").alias("size")).collect()
    taken = []
    for c in (0, 1):
        mine = sorted((r["mixed"], r["doc_id"], r["size"]) for r in sizes if r["toxic"] == c)
        if not mine:
            return share
        inside = max(1, int(np.searchsorted(np.cumsum([r[2] for r in mine]), most, "right")))
        taken.append((F.col("toxic") == c) & (F.col("mixed") <= mine[inside - 1][0]))

    def learn(batches):
        rows = [r for batch in batches for r in zip(*(batch[n].to_pylist() for n in ("doc_id", "text", "toxic")))]
        rows.sort()
        net = train([r[1] for r in rows], np.array([r[2] for r in rows], np.float32), share, visits)
        yield pa.RecordBatch.from_arrays([pa.array([dumps(net)], pa.binary())], ["network"])

    chosen = texts.where(taken[0] | taken[1]).select("doc_id", "text", "toxic")
    return loads(chosen.coalesce(1).mapInArrow(learn, "network binary").collect()[0]["network"])


# -- scoring ----------------------------------------------------------------------------------


class Scorer:
    """Scores whole texts with a network; the gate inputs of each word are computed once."""

    def __init__(self, net: Network):
        self.net = net
        self._fresh()

    def _fresh(self) -> None:
        self.words = Words()
        self.gates = np.zeros((1, 6 * HIDDEN), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.net.probability(self.logits(texts))

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window logit of each text."""
        if len(self.words) > WORD_MEMORY:
            self._fresh()
        docs = [self.words.numbers(t) for t in texts]
        if self.words.new:
            added = self.net.project(self.net.embed(self.words.new)[0])
            self.gates, self.words.new = np.vstack([self.gates, added]), []
        numbers, offset, count = _joined(docs)
        every = self.net.sweep(self.gates, numbers)
        # Between the last window of a text and the first of the next lie some that read both.
        bounds = np.stack([offset, offset + count], 1).ravel()
        return np.maximum.reduceat(np.r_[every, -np.inf], bounds)[::2].astype(np.float32)


def score(docs: DataFrame, model: Network | float, column: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 600 KB, fixed by the sizes above
    made: list[Scorer] = []
    names = docs.columns

    def step(batch):
        out = {c: batch[c] for c in names}
        model = shared.value
        texts = texts_of(batch["text"])
        if isinstance(model, float):
            out[column] = np.full(len(texts), model)
            return out
        if not made:
            made.append(Scorer(model))
        out[column] = made[0].scores(texts) if texts else np.empty(0)
        return out

    return arrow_map(docs, step, docs.withColumn(column, F.lit(0.0)).schema, HELD)


def keep_civil(docs: DataFrame, labels: DataFrame, limit: float = 0.5, visits: int = VISITS) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with their columns."""
    return score(docs, fit(docs, labels, visits=visits), "__toxic").where(F.col("__toxic") < limit).drop("__toxic")


@query("op6_toxicity")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                   fit(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
