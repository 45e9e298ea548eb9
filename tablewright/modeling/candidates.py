"""The candidate models of a selection, as Spark ML estimators."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame, functions as F

from tablewright.modeling.forests import Forest
from tablewright.modeling.kernel import KernelClassifier
from tablewright.modeling.neighbors import _answers, _distinct_vectors
from tablewright.modeling.random_trees import ExtraTrees, RandomCuts, importances
from tablewright.modeling.softmax_trees import SoftmaxBoosting
from tablewright.session import cut_lineage

# The normal-equation solver reads the data once; it holds a square of the width.
NORMAL_WIDTH = 4_096
# The softmax booster keeps a bin of every feature beside a row.
BOOSTED_WIDTH = 4_096


@dataclasses.dataclass
class Settings:
    """Sizes of the candidates; the defaults are the usual full-size pool."""

    trees: int = 100
    rounds: int = 100
    tree_depth: int = 10
    # the deepest trees that Spark builds: forests are not pruned otherwise
    forest_depth: int = 30
    boost_depth: int = 3
    neighbors: int = 5
    iterations: int = 1_000
    margin_iterations: int = 100
    seed: int = 42


@dataclasses.dataclass
class TrainingFacts:
    """What penalties and model shapes depend on."""

    rows: int
    label_std: float
    classes: int
    width: int


class NeighborEstimator:
    """K nearest neighbours with the fit / transform shape of the other candidates."""

    def __init__(self, k: int, classes: int | None, pivots: int | None = None):
        self.k, self.classes, self.pivots = k, classes, pivots

    def fit(self, train: DataFrame) -> NeighborModel:
        # written once: a prediction doesn't prepare the training table again
        return NeighborModel(cut_lineage(_distinct_vectors(_as_vectors(train), self.k)), self.k, self.classes, self.pivots)


class NeighborModel:
    """The ``k`` smallest ids of each training vector, as a written table. Scores each distinct feature vector once and joins the answer back to the rows."""

    def __init__(self, train: DataFrame, k: int, classes: int | None, pivots: int | None = None):
        self.train, self.k, self.classes, self.pivots = train, k, classes, pivots

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("vector", vector_to_array("features"))
        asked = rows.select("vector").distinct().withColumn("query", F.md5(F.to_json(F.struct("vector"))))
        near = _answers(asked, self.train, self.k, self.pivots)
        if self.classes is None:
            found = near.groupBy("vector").agg(F.avg("label").alias("prediction"))
        else:
            votes = near.groupBy("vector", "label").agg(F.count(F.lit(1)).alias("votes"))
            found = votes.groupBy("vector").agg(
                F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("prediction"),
                # at most k entries
                F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "votes"))).alias("by_class"),
                F.sum("votes").alias("all_votes"),
            )
            share = lambda c: F.coalesce(F.try_element_at("by_class", c), F.lit(0)) / F.col("all_votes")
            found = found.select(
                "vector", "prediction", F.transform(F.sequence(F.lit(0), F.lit(self.classes - 1)), share).alias("probability"))
        return rows.join(found, "vector", "left").drop("vector")


def _as_vectors(train: DataFrame) -> DataFrame:
    vector = vector_to_array("features")
    return train.select(
        # an id that depends on the row alone; equal rows are interchangeable
        F.md5(F.to_json(F.struct(vector.alias("v"), F.col("label")))).alias("id"), "label", vector.alias("vector"),
    )


Factory = Callable[[Settings, TrainingFacts], object]


def _solver(facts: TrainingFacts) -> str:
    return "normal" if facts.width <= NORMAL_WIDTH else "l-bfgs"


def linear_regression(s: Settings, f: TrainingFacts) -> LinearRegression:
    return LinearRegression(regParam=0.0, solver=_solver(f), maxIter=s.iterations, tol=1e-12)


def ridge_regression(s: Settings, f: TrainingFacts, alpha: float = 1.0) -> LinearRegression:
    """Squared error plus ``alpha`` times the squared coefficients.

    Spark divides the error by the row count and scales the label by its deviation
    before the penalty applies, hence ``alpha * deviation / rows``. The normal solver
    uses the population deviation, the iterative one the sample deviation.
    """
    solver = _solver(f)
    correction = 1.0 if solver == "normal" or f.rows < 2 else (f.rows / (f.rows - 1)) ** 0.5
    return LinearRegression(
        elasticNetParam=0.0, regParam=alpha * f.label_std * correction / max(1, f.rows),
        standardization=False, solver=solver, tol=1e-12, maxIter=s.iterations,
    )


def lasso_regression(s: Settings, f: TrainingFacts, alpha: float = 0.1) -> LinearRegression:
    return LinearRegression(
        elasticNetParam=1.0, regParam=alpha, standardization=False, solver=_solver(f), tol=1e-9, maxIter=s.iterations
    )


def logistic_regression(s: Settings, f: TrainingFacts) -> LogisticRegression:
    """Log loss with a unit squared penalty, per row."""
    return LogisticRegression(
        maxIter=s.iterations, regParam=1.0 / max(1, f.rows), elasticNetParam=0.0, standardization=False
    )


def _boosted_classifier(s: Settings, f: TrainingFacts):
    """Two classes by Spark's booster; several by one softmax loss, one against the rest where a bin per feature is too wide."""
    boosted = GBTClassifier(maxIter=s.rounds, stepSize=0.1, maxDepth=s.boost_depth, seed=s.seed)
    if f.classes <= 2:
        return boosted
    return SoftmaxBoosting(f.classes, s.rounds, 0.1, s.boost_depth) if f.width <= BOOSTED_WIDTH else OneVsRest(classifier=boosted)


def _linear_svc(s: Settings, f: TrainingFacts):
    machine = LinearSVC(maxIter=s.margin_iterations, regParam=1.0 / max(1, f.rows))
    return machine if f.classes <= 2 else OneVsRest(classifier=machine)


def _forest(kind, s: Settings, **choices):
    """Fully grown trees. Where Spark's own builder grows them, the node of each row and tree is kept beside the rows:
    otherwise every task of a level is sent all trees grown so far and takes each row down from their roots."""
    return kind(numTrees=s.trees, maxDepth=s.forest_depth, cacheNodeIds=True, seed=s.seed, **choices)


def _extra_trees(forest) -> Factory:
    """All features may compete at a node of a regression tree, as many as their root at one of a classifier."""
    share = (lambda n: n) if forest is RandomForestRegressor else (lambda n: n**0.5)
    return lambda s, f: ExtraTrees(_forest(forest, s), share, s.seed)


REGRESSION: dict[str, Factory] = {
    "Linear Regression": linear_regression,
    "Ridge Regression": ridge_regression,
    "Lasso Regression": lasso_regression,
    "Decision Tree": lambda s, f: DecisionTreeRegressor(maxDepth=s.tree_depth, seed=s.seed),
    "Random Forest": lambda s, f: Forest(_forest(RandomForestRegressor, s, featureSubsetStrategy="all")),
    "Gradient Boosting": lambda s, f: GBTRegressor(
        maxIter=s.rounds, stepSize=0.1, maxDepth=s.boost_depth, seed=s.seed),
    "Extra Trees": _extra_trees(RandomForestRegressor),
    "K-Neighbors": lambda s, f: NeighborEstimator(s.neighbors, None),
}

CLASSIFICATION: dict[str, Factory] = {
    "Logistic Regression": logistic_regression,
    "Decision Tree": lambda s, f: DecisionTreeClassifier(maxDepth=s.tree_depth, seed=s.seed),
    "Random Forest": lambda s, f: Forest(_forest(RandomForestClassifier, s, featureSubsetStrategy="sqrt")),
    "Gradient Boosting": _boosted_classifier,
    "Extra Trees": _extra_trees(RandomForestClassifier),
    "K-Neighbors": lambda s, f: NeighborEstimator(s.neighbors, f.classes),
    "Kernel SVC": lambda s, f: KernelClassifier(f.classes, s.margin_iterations, 1.0 / max(1, f.rows), s.seed),
}

# Fitted when asked for by name; no part of a comparison unless it names them.
OTHER_REGRESSION: dict[str, Factory] = {
    "Unbagged Forest": lambda s, f: Forest(_forest(RandomForestRegressor, s, bootstrap=False, featureSubsetStrategy="onethird")),
}
OTHER_CLASSIFICATION: dict[str, Factory] = {
    "Unbagged Forest": lambda s, f: Forest(_forest(RandomForestClassifier, s, bootstrap=False, featureSubsetStrategy="sqrt")),
    "Linear SVC": _linear_svc,
}


def pool_of(task: str, others: bool = False) -> dict[str, Factory]:
    """The candidates of a task, by name; ``others`` adds those that a comparison leaves out."""
    if task == "classification":
        return {**CLASSIFICATION, **(OTHER_CLASSIFICATION if others else {})}
    return {**REGRESSION, **(OTHER_REGRESSION if others else {})}


def coefficients(model) -> list[float] | None:
    """Importance per assembled feature: tree importances or absolute coefficients, if the model has any."""
    if isinstance(model, PipelineModel) and isinstance(model.stages[0], RandomCuts):
        return importances(model)
    if hasattr(model, "featureImportances"):
        return [float(x) for x in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        return [float(max(abs(x) for x in column)) for column in model.coefficientMatrix.toArray().T]
    if hasattr(model, "coefficients"):
        return [abs(float(x)) for x in model.coefficients.toArray()]
    return None
