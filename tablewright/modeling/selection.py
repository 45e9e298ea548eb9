"""Model selection: compare by cross-validation, refit the winner, score a holdout."""

from __future__ import annotations

import contextlib
import dataclasses
import json
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.analysis import task_of
from tablewright.functions.columns import quoted
from tablewright.functions.hashing import default_key
from tablewright.modeling.candidates import NeighborModel, Settings, TrainingFacts, coefficients, pool_of
from tablewright.modeling.features import (
    FEATURES, LABEL, Classes, FeatureSet, FeatureState, as_double, decode_labels, drop_missing_target, feature_pipeline, feature_set,
    class_count, fit_features, label_codes, relocate, target_vocabulary,
)
from tablewright.modeling.folds import kfold, stratified_kfold, stratified_train_test, train_test
from tablewright.modeling.metrics import classification_metrics, regression_metrics, roc_auc
from tablewright.session import read_text, write_text

ROW = "__row"
# Rows of a held partition: candidates read it as one task, many times.
PART_ROWS = 20_000
# Rows of all folds that are held and compared at once, a single fold excepted.
HELD_ROWS = 1_000_000
# Candidates that keep all cores busy: Spark serves the older of two jobs first, so the many short jobs of the others go before.
BUSY = ("Random Forest", "Extra Trees", "Unbagged Forest")


@dataclasses.dataclass
class Problem:
    """A table made ready for selection: pruned, labelled, with its task."""

    data: DataFrame
    target: str
    target_type: str
    task: str
    features: FeatureSet
    classes: Classes | None
    key: list[str]

    @property
    def classification(self) -> bool:
        return self.task == "classification"


def prepare_problem(
    df: DataFrame, target: str, task: str | None = None, key: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
) -> Problem:
    """Prune features, detect the task and add its numeric form under a private name; rows without a target are left out.

    ``key`` names the columns whose hash places a row in folds and splits (all flat
    columns by default), ``features`` restricts the columns to learn from.
    """
    if target not in df.columns:
        raise ValueError(f"the table has no column {target!r} to predict")
    if task not in (None, "regression", "classification"):
        raise ValueError(f"task is regression or classification, not {task!r}")
    rows = drop_missing_target(df, target)
    found = feature_set(rows, target, features)
    chosen = task or task_of(found.target)
    classes = target_vocabulary(rows, target) if chosen == "classification" else None
    labelled = (
        label_codes(rows, target, classes, LABEL) if classes is not None else rows.withColumn(LABEL, as_double(rows, target)))
    return Problem(
        labelled, target, df.schema[target].dataType.simpleString(), chosen, found, classes,
        list(key or default_key(df)),
    )


@contextlib.contextmanager
def _held(*frames: DataFrame):
    """Keep frames in executor storage while they are read repeatedly; a lost block is recomputed."""
    try:
        yield [f.persist() for f in frames]
    finally:
        for f in frames:
            f.unpersist()


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """Deal a table evenly to partitions of ``PART_ROWS`` rows, however few files or row groups it comes from.

    The number of partitions depends on the rows alone; inside one they are in the order of their hash, so that a
    partition made again is the same. Tables of every size take this route: the draws of the forests follow the places of the rows.
    """
    return df.repartition(max(1, -(-rows // PART_ROWS))).sortWithinPartitions(F.xxhash64(*[quoted(c) for c in df.columns]))


def _facts(train: DataFrame, problem: Problem, state: FeatureState) -> TrainingFacts:
    row = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    return TrainingFacts(row["n"], row["s"] or 0.0, class_count(problem.classes), state.width())


def _score(problem: Problem, scored: DataFrame) -> float:
    if problem.classification:
        value = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    else:
        value = regression_metrics(scored).first()["r2"]
    if value is None:
        raise ValueError("score is undefined on this fold")
    return float(value)


def _reason(error: Exception) -> str:
    """The first line of an error, or of the exception at the root of a failed job."""
    cause = getattr(error, "java_exception", None)
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    text = str(error) if cause is None else cause.toString()
    return f"{type(error).__name__}: {text.splitlines()[0][:300]}"


def compare_models(
    problem: Problem, folds: int = 5, settings: Settings | None = None, models: Sequence[str] | None = None,
    seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """(model, score, folds, failure), best first: mean accuracy or R2 over the folds.

    Each fold learns its own preparation from its training part; the assembled
    vectors are held while all candidates train on them. A candidate that fails is
    listed with the reason.
    """
    settings = settings or Settings(seed=seed)
    pool = {n: f for n, f in pool_of(problem.task, others=models is not None).items() if models is None or n in models}
    if problem.classification:
        placed = stratified_kfold(problem.data, LABEL, folds, problem.key, seed, "__fold")
    else:
        placed = kfold(problem.data, folds, problem.key, seed, "__fold")
    found: dict[tuple[str, int], tuple[float | None, str | None]] = {}
    columns, size = [quoted(c) for c in problem.features.columns], problem.features.target.rows
    at_once = max(1, min(folds, HELD_ROWS // max(1, size)))
    with _held(_spread(placed.select(*columns, LABEL, "__fold"), size)) as (base,):

        def prepare(fold: int, stack: contextlib.ExitStack) -> tuple[int, DataFrame, DataFrame, TrainingFacts]:
            train, test = base.where(F.col("__fold") != fold), base.where(F.col("__fold") == fold)
            state = fit_features(train, problem.features.numeric, problem.features.categorical)
            ready = feature_pipeline(train, state, FEATURES)
            fit_on, score_on = stack.enter_context(_held(*[_ready(ready, d) for d in (train, test)]))
            facts = _facts(fit_on, problem, state)
            score_on.count()                   # both parts are in storage before the threads start
            return fold, fit_on, score_on, facts

        def attempt(item: tuple) -> None:
            name, (fold, fit_on, score_on, facts) = item
            if any(found.get((name, k), (None, None))[1] for k in range(fold)):
                return                         # it has failed on a fold before
            try:
                found[name, fold] = _score(problem, pool[name](settings, facts).fit(fit_on).transform(score_on)), None
            except Exception as error:  # the reason goes into the report
                found[name, fold] = None, _reason(error)

        for start in range(0, folds, at_once):
            some = range(start, min(folds, start + at_once))
            with contextlib.ExitStack() as stack:
                parts = [prepare(fold, stack) for fold in some]
                for names, threads in (
                    ([n for n in pool if n not in BUSY], parallelism * min(2, len(some))), ([n for n in pool if n in BUSY], min(2, parallelism)),
                ):
                    # the longest first: boosting takes one short job after another
                    items = [(n, part) for n in sorted(names, key=lambda n: n != "Gradient Boosting") for part in parts]
                    with ThreadPool(max(1, min(threads, len(items)))) as workers:
                        workers.map(attempt, items, 1)
    rows = []
    for n in pool:
        of_folds = [found[n, k] for k in range(folds) if (n, k) in found]
        failed = next((k for k, (_, failure) in enumerate(of_folds) if failure), None)
        scores = [score for score, _ in of_folds[:failed]]
        rows.append((n, None if failed is not None else sum(scores) / folds, len(scores), None if failed is None else of_folds[failed][1]))
    rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0.0)))
    schema = "model string, score double, folds int, failure string"
    return problem.data.sparkSession.createDataFrame(rows, schema)


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _ready(preparation: PipelineModel, df: DataFrame) -> DataFrame:
    """What a candidate sees: the features, the label if there is one, and the whole row packed
    away, so that no column of a user can meet a column of Spark ML."""
    prepared = preparation.transform(df)
    label = [F.col(LABEL).alias("label")] if LABEL in df.columns else []
    row = F.struct(*[quoted(c) for c in df.columns if c != LABEL])
    return prepared.select(F.col(FEATURES).alias("features"), *label, row.alias(ROW))


def _shares(scored: DataFrame, classes: Classes | None) -> Column | None:
    """An array with a share per class: the model's probabilities, else its margins through the
    logistic function, made to add up to one."""
    if not isinstance(classes, list):  # classes in a table are too many for a column each
        return None
    if "probability" in scored.columns:
        shares = F.col("probability")
        return shares if isinstance(scored.schema["probability"].dataType, T.ArrayType) else vector_to_array("probability")
    if "rawPrediction" not in scored.columns:
        return None
    odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-m)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


class TrainedModel:
    """Preparation, estimator and what is known about them."""

    def __init__(self, preparation: PipelineModel, estimator, meta: dict[str, Any]):
        self.preparation, self.estimator, self.meta = preparation, estimator, meta

    def predict(self, df: DataFrame) -> DataFrame:
        """The input with ``prediction`` and, where the model has them, ``prob_<class>`` columns.

        Works on batches and, but for K-Neighbors, on streams.
        """
        classes = self.meta["classes"]
        scored = self.estimator.transform(_ready(self.preparation, df))
        prediction = F.col("prediction")
        shares = _shares(scored, classes)
        if classes is not None:
            scored = decode_labels(scored, "prediction", classes, dtype=self.meta["target_type"])
        made = {} if shares is None else {f"prob_{c}": F.get(shares, F.lit(i)) for i, c in enumerate(classes)}
        # a column of the input that has the name of a result gives way to it
        kept = [F.col(f"{ROW}.{_name(c)}").alias(c) for c in df.columns if c != "prediction" and c not in made]
        return scored.select(*kept, prediction, *[e.alias(n) for n, e in made.items()])

    def predict_codes(self, df: DataFrame) -> DataFrame:
        """The raw scoring columns and, where ``df`` has it, ``label``, for metrics."""
        return self.estimator.transform(_ready(self.preparation, df)).drop(ROW)

    def feature_importance(self, spark: SparkSession) -> DataFrame | None:
        """(feature, importance), largest first; None for models without importances."""
        values, names = coefficients(self.estimator), self.meta["feature_names"]
        if values is None or len(values) != len(names):
            return None
        rows = sorted(zip(names, values), key=lambda r: -r[1])
        return spark.createDataFrame(rows, "feature string, importance double")

    def info(self, spark: SparkSession) -> DataFrame:
        """(property, value): task, target, model, scores, features and classes as text."""
        rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in self.meta.items()]
        return spark.createDataFrame(rows, "property string, value string")

    def save(self, spark: SparkSession, path: str) -> None:
        meta, moves = dict(self.meta), {}
        for i, stored in enumerate(meta.get("vocabularies", [])):
            moves[stored["path"]] = own = f"{path}/vocabulary/{i}"
            if own != stored["path"]:
                spark.read.parquet(stored["path"]).write.mode("overwrite").parquet(own)
        meta["vocabularies"] = [{**stored, "path": moves[stored["path"]]} for stored in meta.get("vocabularies", [])]
        if isinstance(meta["classes"], dict) and meta["classes"]["path"] != f"{path}/classes":
            spark.read.parquet(meta["classes"]["path"]).write.mode("overwrite").parquet(f"{path}/classes")
            meta["classes"] = {**meta["classes"], "path": f"{path}/classes"}
        preparation = relocate(self.preparation, moves)
        if isinstance(self.estimator, NeighborModel):
            preparation.write().overwrite().save(f"{path}/pipeline")
            self.estimator.train.write.mode("overwrite").parquet(f"{path}/neighbors")
            meta["neighbors"] = {"k": self.estimator.k, "classes": self.estimator.classes}
        else:
            PipelineModel([preparation, self.estimator]).write().overwrite().save(f"{path}/pipeline")
        write_text(spark, f"{path}/meta", json.dumps(meta))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedModel:
        meta = json.loads(read_text(spark, f"{path}/meta"))
        loaded = PipelineModel.load(f"{path}/pipeline")
        # the folder may have been copied since it was written
        moves = {stored["path"]: f"{path}/vocabulary/{i}" for i, stored in enumerate(meta.get("vocabularies", []))}
        meta["vocabularies"] = [{**stored, "path": moves[stored["path"]]} for stored in meta.get("vocabularies", [])]
        if isinstance(meta["classes"], dict):
            meta["classes"]["path"] = f"{path}/classes"
        if "neighbors" in meta:
            known = meta["neighbors"]
            train = spark.read.parquet(f"{path}/neighbors")
            return cls(relocate(loaded, moves), NeighborModel(train, known["k"], known["classes"]), meta)
        return cls(relocate(loaded.stages[0], moves), loaded.stages[1], meta)


def fit_model(
    problem: Problem, name: str, settings: Settings | None = None, test_size: float = 0.2, seed: int = 42,
) -> TrainedModel:
    """Fit one candidate on the training split and score it on the holdout."""
    settings = settings or Settings(seed=seed)
    if problem.classification and class_count(problem.classes) > 1:
        placed = stratified_train_test(problem.data, LABEL, test_size, problem.key, seed, "__test")
    else:
        placed = train_test(problem.data, test_size, problem.key, seed, "__test")
    columns = [quoted(c) for c in problem.features.columns]
    with _held(_spread(placed.select(*columns, LABEL, "__test"), problem.features.target.rows)) as (base,):
        train, test = base.where(~F.col("__test")), base.where(F.col("__test"))
        state = fit_features(train, problem.features.numeric, problem.features.categorical)
        preparation = feature_pipeline(train, state, FEATURES)
        with _held(_ready(preparation, train)) as (fit_on,):
            facts = _facts(fit_on, problem, state)
            estimator = pool_of(problem.task, others=True)[name](settings, facts).fit(fit_on)
            meta = {
                "task_type": problem.task, "target_column": problem.target, "target_type": problem.target_type,
                "model": name, "classes": problem.classes, "feature_columns": problem.features.columns,
                "numeric_columns": problem.features.numeric, "categorical_columns": problem.features.categorical,
                "feature_names": state.names(), "vocabularies": list(state.tables.values()), "pruned_columns": problem.features.pruned,
            }
            model = TrainedModel(preparation, estimator, meta)
            meta["metrics"] = _holdout_metrics(problem, model.predict_codes(test))
    return model


def _holdout_metrics(problem: Problem, scored: DataFrame) -> dict[str, float | None]:
    if not problem.classification:
        return regression_metrics(scored).first().asDict()
    metrics = classification_metrics(scored).first().asDict()
    shares = _shares(scored, problem.classes)
    if class_count(problem.classes) == 2 and shares is not None:
        metrics["roc_auc"] = roc_auc(scored.withColumn("score", F.get(shares, F.lit(1)))).first()["roc_auc"]
    return metrics


def train_best(
    df: DataFrame, target: str, task: str | None = None, key: Sequence[str] | None = None, folds: int = 5,
    test_size: float = 0.2, settings: Settings | None = None, models: Sequence[str] | None = None, seed: int = 42,
) -> tuple[TrainedModel, DataFrame]:
    """Compare the candidates, refit the best on the training split; returns it and the leaderboard."""
    problem = prepare_problem(df, target, task, key)
    board = compare_models(problem, folds, settings, models, seed)
    ranked = board.collect()                       # one row per candidate
    if not ranked or ranked[0]["score"] is None:
        reasons = "; ".join(f"{r['model']}: {r['failure']}" for r in ranked)
        raise ValueError(f"every candidate failed: {reasons}")
    model = fit_model(problem, ranked[0]["model"], settings, test_size, seed)
    model.meta["cv_score"] = ranked[0]["score"]
    model.meta["model_scores"] = {r["model"]: r["score"] for r in ranked}
    return model, board
