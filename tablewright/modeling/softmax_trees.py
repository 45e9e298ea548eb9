"""Gradient boosting of several classes under one softmax loss.

Each round adds one regression tree per class, all grown on the same rows from the residuals ``label is k``
minus the share of ``k`` (Friedman 2001, algorithm 6): splits by squared error, leaves by one Newton step,
``(K - 1) / K * sum(r) / sum(|r| (1 - |r|))``. The first scores are the logarithms of the class shares.

The features are cut into at most ``BINS`` bins once. A level of all K trees is one job: tasks add up residuals per
(tree, node, feature, bin), Spark sums them and picks the best cut of each node, and one row per node comes back.
Scores are written to the shared folder every ``KEPT_ROUNDS`` rounds; in between the tasks add the newer trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.session import cut_lineage

BINS = 32
KEPT_ROUNDS = 10


def _kernels():
    """What runs inside tasks: routes, shares. Closures, so that they travel with the plan."""

    def route(x, feature, cut, levels):
        """Place of each row at a level: left if the value is at most the cut. ``feature`` and ``cut`` are in heap order."""
        node = np.zeros(len(x), np.int64)
        for _ in range(levels):
            f = feature[node]
            node = 2 * node + 1 + (x[np.arange(len(x)), f] > cut[node])
        return node - (2**levels - 1)

    def shares(scores):
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    return route, shares


class SoftmaxModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (the softmax of all trees' sums) and ``prediction``, the smaller class on a tie."""

    trees = Param(Params._dummy(), "trees", "first scores, step, depth and per round and class: features, cuts, values", TypeConverters.toString)
    gains = Param(Params._dummy(), "gains", "squared error taken off by each feature, adding up to 1", TypeConverters.toListFloat)

    def __init__(self, trees: str | None = None, gains: list[float] | None = None):
        super().__init__()
        if trees is not None:
            self._set(trees=trees, gains=gains)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (as Spark's own tree models call it)
        return DenseVector(self.getOrDefault(self.gains))

    def _transform(self, df: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.trees)
        route, shares = _kernels()

        @F.pandas_udf("array<double>")
        def score(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            model, x = json.loads(text), np.stack(vectors.to_numpy())
            scores = np.tile(np.array(model["first"]), (len(x), 1))
            for trees in model["rounds"]:
                for k, (feature, cut, value) in enumerate(trees):
                    leaf = route(x, np.array(feature), np.array(cut, float), model["depth"])
                    scores[:, k] += model["step"] * np.array(value)[leaf]
            return pd.Series(list(shares(scores)))

        made = df.withColumn("probability", score(vector_to_array("features")))
        return made.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


class SoftmaxBoosting(Estimator):
    def __init__(self, classes: int, rounds: int = 100, step: float = 0.1, depth: int = 3):
        super().__init__()
        self.classes, self.rounds, self.step, self.depth = classes, rounds, step, depth

    def _fit(self, df: DataFrame) -> SoftmaxModel:
        rows = df.select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            raise ValueError("there are no rows to learn from")
        # a class without rows gets the share of a tenth of a row
        first = np.log(np.array([counts.get(k, 0.1) for k in range(self.classes)]) / sum(counts.values()))
        cuts = _cuts(rows)
        state = cut_lineage(_binned(rows, cuts, first.tolist()))
        gains, rounds, pending = np.zeros(len(cuts)), [], []
        for _ in range(self.rounds):
            trees = self._round(state, pending, len(cuts), gains)
            pending.append(trees)
            rounds.append([
                (f.tolist(), [float(cuts[i][c]) if c < len(cuts[i]) else 1e308 for i, c in zip(f, cut)], v.tolist()) for f, cut, v in trees])
            if len(pending) == KEPT_ROUNDS:
                state, pending = cut_lineage(_advanced(state, pending, self.step, self.depth)), []
        text = json.dumps({"first": first.tolist(), "step": self.step, "depth": self.depth, "rounds": rounds})
        return SoftmaxModel(text, (gains / (gains.sum() or 1.0)).tolist())

    def _round(self, state: DataFrame, pending: list, width: int, gains: np.ndarray) -> list:
        """One tree per class: features, cuts (numbers of bins) and leaf values in heap order."""
        inner, factor = 2**self.depth - 1, (self.classes - 1) / self.classes
        # a node that isn't split sends every row to the left
        trees = [(np.zeros(inner, int), np.full(inner, BINS), np.zeros(inner + 1)) for _ in range(self.classes)]

        def newton(g: float, h: float) -> float:
            return factor * g / h if h > 1e-12 else 0.0

        for level in range(self.depth):
            for r in _best_cuts(state, pending, trees, level, width, self.step, self.depth).collect():
                feature, cut, value = trees[r["tree"]]
                at, split = 2**level - 1 + r["node"], r["gain"] > 1e-12
                if split:
                    feature[at], cut[at] = r["feature"], r["bin"]
                    gains[r["feature"]] += r["gain"]
                if level == self.depth - 1:
                    value[2 * r["node"]] = newton(r["left_g"], r["left_h"]) if split else newton(r["g"], r["h"])
                    value[2 * r["node"] + 1] = newton(r["g"] - r["left_g"], r["h"] - r["left_h"]) if split else 0.0
        return trees


def _cuts(rows: DataFrame) -> list[list[float]]:
    """Per feature its distinct quantiles, at most ``BINS - 1``; as many numbers as the model may name."""
    marks = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.percentile_approx("v", marks, 10_000).alias("q"))
    return [sorted(set(r["q"])) for r in found.orderBy("at").collect()]


def _binned(rows: DataFrame, cuts: list[list[float]], first: list[float]) -> DataFrame:
    @F.pandas_udf("binary")
    def bins(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy())
        out = np.empty(x.shape, np.uint8)
        for i, edges in enumerate(cuts):
            out[:, i] = np.searchsorted(edges, x[:, i], "left")
        return pd.Series([r.tobytes() for r in out])

    return rows.select("label", bins("x").alias("bins"), F.array(*map(F.lit, first)).alias("scores"))


def _reader(pending: list, step: float, depth: int):
    route, shares = _kernels()

    def read(part: pd.DataFrame):
        """Bins and up-to-date scores of some rows."""
        x = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), -1)
        scores = np.stack(part["scores"].to_numpy()).astype(float)
        for trees in pending:
            for k, (feature, cut, value) in enumerate(trees):
                scores[:, k] += step * value[route(x, feature, cut, depth)]
        return x, scores

    return read, route, shares


def _advanced(state: DataFrame, pending: list, step: float, depth: int) -> DataFrame:
    read = _reader(pending, step, depth)[0]

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(scores=list(read(batch)[1]))

    return state.mapInPandas(advance, state.schema)


def _best_cuts(state: DataFrame, pending: list, trees: list, level: int, width: int, step: float, depth: int) -> DataFrame:
    """(tree, node, g, h, gain, feature, bin, left_g, left_h): the best cut of every node of a level that has rows."""
    read, route, shares = _reader(pending, step, depth)
    n_bins, nodes, at_once = BINS, 2**level, max(1, 2_000_000 // width)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = nodes * width * n_bins
            sums = np.zeros((len(trees), 3, size))
            for start in range(0, len(batch), at_once):
                part = batch.iloc[start:start + at_once]
                x, scores = read(part)
                left = (part["label"].to_numpy()[:, None] == np.arange(len(trees))) - shares(scores)
                steep = np.abs(left) * (1 - np.abs(left))
                for k, (feature, cut, _) in enumerate(trees):
                    node = route(x, feature, cut, level)
                    cell = ((node[:, None] * width + np.arange(width)) * n_bins + x).ravel()
                    for i, weight in enumerate((np.ones(len(x)), left[:, k], steep[:, k])):
                        sums[k, i] += np.bincount(cell, np.repeat(weight, width), size)
            k, cell = np.nonzero(sums[:, 0])
            yield pd.DataFrame({
                "tree": k, "node": cell // (width * n_bins), "feature": cell // n_bins % width, "bin": cell % n_bins,
                "n": sums[k, 0, cell], "g": sums[k, 1, cell], "h": sums[k, 2, cell]})

    cells = state.mapInPandas(add_up, "tree int, node int, feature int, bin int, n double, g double, h double")
    cells = cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ngh"])
    whole = Window.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(
        "tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias("left_" + c) for c in "ngh"],
        *[F.sum(c).over(whole).alias(c) for c in "ngh"])
    rest_n, rest_g = F.col("n") - F.col("left_n"), F.col("g") - F.col("left_g")
    gain = F.when(rest_n > 0, F.col("left_g") ** 2 / F.col("left_n") + rest_g**2 / rest_n - F.col("g") ** 2 / F.col("n"))
    cells = cells.withColumn("gain", F.coalesce(gain, F.lit(-1.0)))
    # equal gains: the first feature, then the lowest cut
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    best = F.max_by(F.struct("g", "h", "gain", "feature", "bin", "left_g", "left_h"), order)
    return cells.groupBy("tree", "node").agg(best.alias("b")).select("tree", "node", "b.*")
