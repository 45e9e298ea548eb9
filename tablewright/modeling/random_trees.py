"""Extremely randomised trees: splits only at thresholds drawn at random.

Every feature is copied ``COPIES`` times and each copy is cut at ``CUTS`` random places, half-way
between the values of two random rows, so frequent ranges are cut more often. A tree sees only
the bins, and a node only a random choice of copies, so neither can look for the best threshold
of a feature; all rows go to every tree. One Spark forest grows all trees at once.

The bins are computed in Arrow batches by numpy. A row without finite features falls into the lowest bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tablewright.modeling.forests import Forest

COPIES, CUTS = 8, 8
BINS = "__bins"


class RandomCuts(Transformer, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The bin of each feature under each of its copies' cuts, copy after copy, as a vector."""

    thresholds = Param(Params._dummy(), "thresholds", "copies x cuts x features, flat", TypeConverters.toListFloat)
    copies = Param(Params._dummy(), "copies", "copies of each feature", TypeConverters.toInt)
    cuts = Param(Params._dummy(), "cuts", "cuts of each copy", TypeConverters.toInt)

    def __init__(self, thresholds: list[float] | None = None, copies: int = COPIES, cuts: int = CUTS):
        super().__init__()
        self._setDefault(featuresCol="features", outputCol=BINS)
        self._set(copies=copies, cuts=cuts)
        if thresholds is not None:
            self._set(thresholds=thresholds)

    def _transform(self, df: DataFrame) -> DataFrame:
        copies, cuts = self.getOrDefault(self.copies), self.getOrDefault(self.cuts)
        edges = np.array(self.getOrDefault(self.thresholds)).reshape(copies, cuts, -1)

        @F.pandas_udf("array<double>")
        def bins(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            x = np.stack(vectors.to_numpy())
            out = np.concatenate([(x[:, None, :] > own[None]).sum(1) for own in edges], axis=1)
            return pd.Series(list(out.astype(float)))

        return df.withColumn(self.getOutputCol(), array_to_vector(bins(vector_to_array(self.getFeaturesCol()))))


class ExtraTrees(Estimator):
    """Random cuts, then a forest on the bins; ``shares`` is how many features a node may look at."""

    def __init__(self, forest, share, seed: int = 42, copies: int = COPIES, cuts: int = CUTS):
        super().__init__()
        self.forest, self.share, self.cut_seed, self.n_copies, self.n_cuts = forest, share, seed, copies, cuts

    def _fit(self, df: DataFrame) -> PipelineModel:
        count = self.n_copies * self.n_cuts
        # two rows for every cut, a number that no table's size changes
        drawn = df.select(vector_to_array("features").alias("v")).orderBy(F.rand(self.cut_seed)).limit(2 * count).collect()
        if not drawn:
            raise ValueError("there are no rows to draw thresholds from")
        rows = np.array([r["v"] for r in drawn])
        rng = np.random.default_rng(self.cut_seed)
        width = rows.shape[1]
        low, high = (rows[rng.integers(0, len(rows), (count, width)), np.arange(width)] for _ in range(2))
        cutter = RandomCuts(np.ravel((low + high) / 2).tolist(), self.n_copies, self.n_cuts)
        forest = self.forest.copy().setFeaturesCol(BINS).setMaxBins(self.n_cuts + 1)
        forest = forest.setBootstrap(False).setFeatureSubsetStrategy(str(max(1, round(self.share(width)))))
        between = [b + 0.5 for b in range(self.n_cuts)]
        return PipelineModel([cutter, Forest(forest, [between] * (self.n_copies * width)).fit(cutter.transform(df))])


def importances(model: PipelineModel) -> list[float]:
    """Importance per feature: the sum over its copies."""
    cutter, forest = model.stages
    return forest.featureImportances.toArray().reshape(cutter.getOrDefault(cutter.copies), -1).sum(0).tolist()
