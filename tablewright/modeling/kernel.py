"""A support vector machine with a Gaussian kernel, by random Fourier features.

``cos(w x + b)`` with normal ``w`` and uniform ``b`` has the kernel as its mean product, so a
linear machine on ``WIDTH`` such features separates what the kernel separates, at a cost that
grows with the rows, not with their square. The kernel's width is that of ``1 / (features * variance)``.
Margins become probabilities by a logistic curve per class, fitted with Platt's smoothed targets on the
training margins; the prediction is the class with the largest share.

The kernel is used whatever the number of features. Vectors of more than ``DENSE`` features (one-hot texts) are lifted from their
entries, and only the directions of features that a batch has are drawn, so memory doesn't grow with the number of features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.session import cut_lineage

WIDTH = 512
# Rows of a partition while it is lifted and learned from: 32 MB of random features.
LIFT_ROWS = 8_192
# Features whose directions are drawn as one block; entries of further ones are multiplied so many at once.
DENSE = 4_096
# Further features share a generator by so many.
DRAWN_TOGETHER = 16
# Set by hand only: a machine on more features is linear. No input sets it off by its size.
MOST_FEATURES = float("inf")
LIFTED = "__lifted"


class FourierFeatures(Transformer, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a vector column; the directions follow from the seed alone."""

    gamma = Param(Params._dummy(), "gamma", "kernel exp(-gamma |x - y|^2)", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "features of a row", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "random features made", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)

    def __init__(self, gamma: float = 1.0, size: int = 1, width: int = WIDTH, seed: int = 42):
        super().__init__()
        self._setDefault(featuresCol="features", outputCol=LIFTED)
        self._set(gamma=gamma, size=size, width=width, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, width, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.width, self.seed))

        lift = _lift_dense if size <= DENSE else _lift_entries
        return df.withColumn(self.getOutputCol(), array_to_vector(lift(F.col(self.getFeaturesCol()), gamma, size, width, seed)))


def _lift_dense(vector: Column, gamma: float, size: int, width: int, seed: int) -> Column:
    @F.pandas_udf("array<double>")
    def lift(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        rng = np.random.default_rng(seed)
        w = rng.normal(size=(size, width)) * (2 * gamma) ** 0.5
        b = rng.uniform(0, 2 * np.pi, width)
        return pd.Series(list(np.cos(np.stack(vectors.to_numpy()) @ w + b) * (2 / width) ** 0.5))

    return lift(vector_to_array(vector))


def _lift_entries(vector: Column, gamma: float, size: int, width: int, seed: int) -> Column:
    """The same for wide vectors, by their entries other than zero. The first ``DENSE`` features have the directions of a block, the
    others those of a generator for every ``DRAWN_TOGETHER`` features, which is made only where one of them occurs."""
    dense, together = DENSE, DRAWN_TOGETHER

    @F.pandas_udf("array<double>")
    def lift(parts: pd.DataFrame) -> pd.Series:
        if not len(parts):
            return pd.Series([], dtype=object)
        rng = np.random.default_rng(seed)
        first = rng.normal(size=(dense, width))
        out = np.zeros((len(parts), width))
        b = rng.uniform(0, 2 * np.pi, width)
        values = [np.asarray(v, float) for v in parts["values"]]
        at = [np.arange(len(v)) if t == 1 else np.asarray(i, np.int64) for t, i, v in zip(parts["type"], parts["indices"], values)]
        row, feature, value = np.repeat(np.arange(len(at)), [len(i) for i in at]), np.concatenate(at), np.concatenate(values)
        # features come in blocks, so that the directions held at once are bounded
        block = np.where(feature < dense, -1, feature // together)
        order = np.lexsort((row, block))
        row, feature, value, block = (c[order] for c in (row, feature, value, block))
        for start in range(0, len(row), dense):
            r, f, v, k = (c[start:start + dense] for c in (row, feature, value, block))
            found, place = np.unique(k[k >= 0], return_inverse=True)
            w = np.empty((len(r), width))
            w[k < 0] = first[f[k < 0]]
            if len(found):
                later = np.flatnonzero(k >= 0)
                ends = np.flatnonzero(np.append(place[1:] != place[:-1], True)) + 1
                for g, (low, high) in enumerate(zip(np.append(0, ends[:-1]), ends)):
                    made = np.random.default_rng([seed, int(found[g])]).normal(size=(together, width))
                    w[later[low:high]] = made[f[later[low:high]] % together]
            w *= v[:, None]
            by_row = np.argsort(r, kind="stable")
            heads = np.flatnonzero(np.append(True, r[by_row][1:] != r[by_row][:-1]))
            out[r[by_row][heads]] += np.add.reduceat(w[by_row], heads, axis=0)
        return pd.Series(list(np.cos(out * (2 * gamma) ** 0.5 + b) * (2 / width) ** 0.5))

    return lift(F.unwrap_udt(vector))


class Calibration(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Margins to shares by a logistic curve per class; the prediction follows the shares."""

    slopes = Param(Params._dummy(), "slopes", "slope per class", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "offset per class", TypeConverters.toListFloat)

    def __init__(self, slopes: list[float] | None = None, offsets: list[float] | None = None):
        super().__init__()
        if slopes is not None:
            self._set(slopes=slopes, offsets=offsets)

    def _transform(self, df: DataFrame) -> DataFrame:
        slopes, offsets = (F.array(*map(F.lit, self.getOrDefault(p))) for p in (self.slopes, self.offsets))
        curve = F.transform(
            vector_to_array("rawPrediction"), lambda m, i: 1 / (1 + F.exp(-(F.get(slopes, i) * m + F.get(offsets, i)))))
        total = F.aggregate("__odds", F.lit(0.0), lambda a, x: a + x)
        made = df.withColumn("__odds", curve).withColumn("probability", F.transform("__odds", lambda x: x / total))
        return made.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double")).drop("__odds")


class KernelClassifier(Estimator):
    def __init__(self, classes: int, iterations: int, penalty: float, seed: int = 42, width: int = WIDTH):
        super().__init__()
        self.classes, self.iterations, self.penalty, self.lift_seed, self.n_wide = classes, iterations, penalty, seed, width

    def _fit(self, df: DataFrame) -> PipelineModel:
        row = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]
        if not row["count"]:
            raise ValueError("there are no rows to learn from")
        mean, variance = row["mean"].toArray(), row["variance"].toArray()
        if len(mean) > MOST_FEATURES:
            return self._learn(df, mean, variance)
        held = _dealt(df.select("features", "label"), row["count"]).persist()
        try:
            return self._learn(held, mean, variance)
        finally:
            held.unpersist()

    def _learn(self, df: DataFrame, mean: np.ndarray, variance: np.ndarray) -> PipelineModel:
        machine = LinearSVC(maxIter=self.iterations, regParam=self.penalty)
        stages = []
        if len(mean) <= MOST_FEATURES:
            spread = float((variance + mean**2).mean() - mean.mean() ** 2)
            stages.append(FourierFeatures(1 / (len(mean) * spread) if spread > 0 else 1.0, len(mean), self.n_wide, self.lift_seed))
            machine = machine.setFeaturesCol(LIFTED)
        lifted = PipelineModel(stages).transform(df)
        if self.classes > 2:
            machine = OneVsRest(classifier=machine, featuresCol=machine.getFeaturesCol())
        stages.append(machine.fit(lifted))
        margins = cut_lineage(stages[-1].transform(lifted).select("label", vector_to_array("rawPrediction").alias("m")))
        curves = [_curve(margins, c) for c in ([1] if self.classes <= 2 else range(self.classes))]
        if self.classes <= 2:  # the margins of the two classes are each other's negatives
            slope, offset = curves[0]
            curves = [(slope, -offset), (slope, offset)]
        return PipelineModel([*stages, Calibration(*map(list, zip(*curves)))])


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows in partitions of ``LIFT_ROWS``, the same ones whenever a partition is made again: every step of the machine reads
    all random features, so a partition's rows, not the table's, are what a task grows with."""
    if rows <= LIFT_ROWS:
        return df
    return df.repartition(-(-rows // LIFT_ROWS)).sortWithinPartitions(F.xxhash64("label", "features"))


def _curve(margins: DataFrame, c: int) -> tuple[float, float]:
    """Slope and offset of a class's logistic curve, with Platt's targets just inside 0 and 1."""
    own = margins.select(F.get("m", F.lit(c)).alias("m"), (F.col("label") == c).alias("hit"))
    n = own.agg(F.count_if("hit").alias("yes"), F.count_if(~F.col("hit")).alias("no")).first()
    target = F.when(F.col("hit"), (n["yes"] + 1) / (n["yes"] + 2)).otherwise(1 / (n["no"] + 2))
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), target.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight")))
    rows = own.select(array_to_vector(F.array("m")).alias("features"), F.explode(sides).alias("s")).select("features", "s.*")
    fitted = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=100).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)
