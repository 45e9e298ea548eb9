"""Feature columns for models: impute, scale, one-hot, assemble.

What is learned from the training rows (medians, means, deviations, modes, category
lists) is turned into ready Spark ML transformers, so a fitted preparation is an
ordinary ``PipelineModel`` that can be saved, loaded and run on a stream.

A column with more values than a list should hold keeps them in a ranked table of the shared
folder instead: its code is joined, and the sparse vector is put together from the codes by SQL,
so neither the driver nor a plan ever holds the values.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.analysis import column_traits, prune_columns
from tablewright.analysis.traits import ColumnTraits
from tablewright.functions.columns import as_double, is_missing, quoted
from tablewright.functions.quantiles import exact_quantiles
from tablewright.functions.vocabularies import count_values, fits_list, read_codes, sizes_of, store_codes

LABEL, FEATURES = "__label", "__features"


@dataclasses.dataclass
class FeatureSet:
    """The usable feature columns of a table, and what was left out and why."""

    numeric: list[str]
    categorical: list[str]
    pruned: dict[str, str]
    target: ColumnTraits

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical


def feature_set(df: DataFrame, target: str, only: Sequence[str] | None = None) -> FeatureSet:
    """Prune constant and key-like columns and split the rest by class; one shared profile.

    ``only`` restricts the features that are considered.
    """
    if target not in df.columns:
        raise ValueError(f"the table has no column {target!r} to predict")
    wanted = None if only is None else [target, *only]
    traits = {t.name: t for t in column_traits(df, wanted)}
    if target not in traits:
        raise ValueError(f"Target column '{target}' is nested and cannot be predicted.")
    about = traits.pop(target)
    pruned = prune_columns(list(traits.values()))
    usable = [t for t in traits.values() if t.name not in pruned]
    if not usable:
        raise ValueError(f"every column but the target was pruned: {pruned}")
    return FeatureSet(
        [t.name for t in usable if t.numeric], [t.name for t in usable if not t.numeric], pruned, about
    )


def prune_features(df: DataFrame, target: str) -> DataFrame:
    """The table without useless feature columns; the target stays."""
    features = feature_set(df, target)
    return df.select(*[quoted(c) for c in df.columns if c in features.columns or c == target])


@dataclasses.dataclass
class FeatureState:
    """Learned constants of the preparation; JSON-able."""

    numeric: dict[str, list[float]]      # name -> [median, mean, deviation]
    categories: dict[str, list[str]]     # name -> sorted values
    modes: dict[str, str]
    tables: dict[str, dict[str, Any]] = dataclasses.field(default_factory=dict)  # name -> path and rows of its codes

    def names(self) -> list[str]:
        """Names of the assembled features: numeric first, then ``<column>_<value>``, then ``<column>[<code>]``
        for the columns whose values are in a table."""
        return [
            *self.numeric, *(f"{c}_{v}" for c, vs in self.categories.items() for v in vs),
            *(f"{c}[{i}]" for c, t in self.tables.items() for i in range(t["rows"])),
        ]

    def width(self) -> int:
        return len(self.numeric) + sum(map(len, self.categories.values())) + sum(t["rows"] for t in self.tables.values())

    def as_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)


def fit_features(train: DataFrame, numeric: list[str], categorical: list[str], most_listed: int | None = None) -> FeatureState:
    """Learn the constants from the training rows; columns of more than ``most_listed`` values get a table.

    Mean and deviation are those after imputation; they follow from the moments of
    the present values, so the imputed column is never materialised. The exact median
    is looked up only for columns that have gaps.
    """
    scales: dict[str, list[float]] = {}
    if numeric:
        row = train.agg(
            F.count(F.lit(1)).alias("n"),
            *[f(as_double(train, c)).alias(f"{k}{i}") for i, c in enumerate(numeric)
              for k, f in (("p", F.count), ("m", F.avg), ("s", F.stddev_pop))],
        ).first()
        gaps = [c for i, c in enumerate(numeric) if row[f"p{i}"] < row["n"]]
        medians = exact_quantiles(train, gaps, [0.5])
        for i, c in enumerate(numeric):
            present, mean, std = row[f"p{i}"], row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
            median = medians[c][0.5] if c in medians else mean
            scales[c] = _imputed_moments(row["n"], present, mean, std, 0.0 if median is None else median)
    if not categorical:
        return FeatureState(scales, {}, {})
    counts = count_values(train, categorical)
    sizes = sizes_of(counts)
    listed = [c for c in categorical if c not in sizes or fits_list(sizes[c], most_listed)]
    tables = {
        c: store_codes(counts.where(F.col("column") == c).select("value")) for c in categorical if c not in listed}
    return FeatureState(scales, _lists(counts, listed), {c: size[2] for c, size in sizes.items()}, tables)


def _imputed_moments(n: int, present: int, mean: float, std: float, median: float) -> list[float]:
    """[median, mean, deviation] of a column whose ``n - present`` gaps hold the median."""
    if n == 0:
        return [median, 0.0, 1.0]
    share = present / n
    overall = share * mean + (1 - share) * median
    variance = share * (std**2 + (mean - overall) ** 2) + (1 - share) * (median - overall) ** 2
    return [median, overall, variance**0.5 or 1.0]


def _lists(counts: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted values per column, from counts whose sizes were checked."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in counts.where(F.col("column").isin(columns)).collect() if columns else []:
        found[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in found.items()}


def feature_pipeline(df: DataFrame, state: FeatureState, output: str = "features") -> PipelineModel:
    """The preparation as a pipeline of fitted transformers; no job runs here."""
    prepared = [f"{_imputed(df, c, m)} AS `__num_{i}`" for i, (c, m) in enumerate(state.numeric.items())]
    prepared += [
        f"coalesce(CAST({_name(c)} AS STRING), {_text(state.modes.get(c, ''))}) AS `__cat_{i}`"
        for i, c in enumerate([*state.categories, *state.tables])
    ]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(prepared)} FROM __THIS__")]
    count = len(state.categories)
    if state.tables:
        return PipelineModel([*stages, *_joined_stages(state, output)])
    inputs = [f"__num_{i}" for i in range(len(state.numeric))]
    if count:
        texts, codes, hots = ([f"__{k}_{i}" for i in range(count)] for k in ("cat", "idx", "hot"))
        for text, code, values in zip(texts, codes, state.categories.values()):
            stages.append(StringIndexerModel.from_labels(values or [""], text, code, handleInvalid="keep"))
        # the "keep" bucket for unseen values comes last, so dropping it gives all zeros
        encoder = OneHotEncoder(inputCols=codes, outputCols=hots, dropLast=True, handleInvalid="error")
        empty = df.sparkSession.createDataFrame([], df.schema)
        stages.append(encoder.fit(PipelineModel(stages[:]).transform(empty)))
        inputs += hots
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return PipelineModel(stages)


def _joined_stages(state: FeatureState, output: str) -> list:
    """Stages for columns with a table of codes: index or join, then one sparse vector per row."""
    stages, codes, offset = [], [], len(state.numeric)
    for i, values in enumerate(state.categories.values()):
        stages.append(StringIndexerModel.from_labels(values or [""], f"__cat_{i}", f"__idx_{i}", handleInvalid="keep"))
        codes.append(f"CASE WHEN `__idx_{i}` < {len(values)} THEN {offset} + CAST(`__idx_{i}` AS INT) END")
        offset += len(values)
    for i, stored in enumerate(state.tables.values(), len(state.categories)):
        stages.append(SQLTransformer(statement=(
            f"SELECT __THIS__.*, v.code AS `__idx_{i}` FROM __THIS__ LEFT JOIN {_file(stored['path'])} v ON __THIS__.`__cat_{i}` = v.value")))
        codes.append(f"CAST({offset} + `__idx_{i}` AS INT)")
        offset += stored["rows"]
    entries = [f"named_struct('i', {i}, 'x', `__num_{i}`)" for i in range(len(state.numeric))]
    entries += [f"named_struct('i', {c}, 'x', 1D)" for c in codes]
    # Spark SQL has no function that makes a sparse vector, but reads one as JSON.
    vector = T.StructType([T.StructField("v", VectorUDT())]).json()
    packed = (
        f"named_struct('v', named_struct('type', 0Y, 'size', {offset}, 'indices', transform(`__entries`, e -> e.i), "
        "'values', transform(`__entries`, e -> e.x)))")
    stages.append(SQLTransformer(statement=(
        f"SELECT *, from_json(to_json({packed}), '{vector}').v AS `{output}` FROM "
        f"(SELECT *, filter(array({', '.join(entries)}), e -> e.i IS NOT NULL) AS `__entries` FROM __THIS__)")))
    return stages


def _file(path: str) -> str:
    return f"parquet.`{path}`"


def relocate(preparation: PipelineModel, moves: dict[str, str]) -> PipelineModel:
    """The preparation, reading its tables of codes from other paths."""
    stages = []
    for stage in preparation.stages:
        if isinstance(stage, SQLTransformer):
            statement = stage.getStatement()
            for old, new in moves.items():
                statement = statement.replace(_file(old), _file(new))
            stage = SQLTransformer(statement=statement)
        stages.append(stage)
    return PipelineModel(stages)


def feature_names(spark: SparkSession, state: FeatureState) -> DataFrame:
    """(position, feature), with the values of stored vocabularies read from their tables."""
    listed = [*state.numeric, *(f"{c}_{v}" for c, vs in state.categories.items() for v in vs)]
    names = spark.createDataFrame(list(enumerate(listed)), "position long, feature string")
    offset = len(listed)
    for column, stored in state.tables.items():
        rows = spark.read.parquet(stored["path"])
        names = names.union(rows.select(F.col("code") + offset, F.concat(F.lit(f"{column}_"), "value")))
        offset += stored["rows"]
    return names


def internal_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("__num_", "__cat_", "__idx_", "__hot_", "__entries"))]


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _imputed(df: DataFrame, column: str, moments: list[float]) -> str:
    """SQL of (value or median - mean) / deviation; NaN counts as missing."""
    median, mean, deviation = (f"CAST('{m!r}' AS DOUBLE)" for m in moments)
    boolean = isinstance(df.schema[column].dataType, T.BooleanType) if column in df.columns else False
    value = f"CAST({_name(column)} AS INT)" if boolean else _name(column)
    return f"(coalesce(nullif(CAST({value} AS DOUBLE), CAST('NaN' AS DOUBLE)), {median}) - {mean}) / {deviation}"


Classes = list[str] | dict[str, Any]


def target_vocabulary(df: DataFrame, target: str, most_listed: int | None = None) -> Classes:
    """The distinct target values as texts in the target's own order: a list while that is small, else a table of codes."""
    counts = count_values(df, [target])
    size = sizes_of(counts).get(target)
    if size is not None and not fits_list(size, most_listed):
        return store_codes(counts.select("value"), "double" if _ordered_as_number(df, target) else "string")
    found = _lists(counts, [target])[target]
    return sorted(found, key=float) if _ordered_as_number(df, target) else found


def class_count(classes: Classes | None) -> int:
    return 0 if classes is None else classes["rows"] if isinstance(classes, dict) else len(classes)


# The name under which the classes of a target have been known.
target_classes = target_vocabulary


def _ordered_as_number(df: DataFrame, target: str) -> bool:
    return isinstance(df.schema[target].dataType, T.NumericType)


def label_codes(df: DataFrame, target: str, classes: Classes, name: str = "label") -> DataFrame:
    """Add the class code of the target as a double: its position in ``classes``.

    The codes are looked up by hash, those of a table by a join; a value outside ``classes`` or a missing one has none.
    """
    text, code = "__class_text", "__class_code"
    worded = df.withColumn(text, quoted(target).cast("string"))
    if isinstance(classes, dict):
        side = read_codes(df, classes).select(F.col("value").alias("__class_value"), F.col("code").alias(code))
        coded = worded.join(side, F.col(text) == F.col("__class_value"), "left").drop("__class_value")
        return coded.withColumn(name, F.col(code).cast("double")).drop(*[c for c in (text, code) if c != name])
    indexer = StringIndexerModel.from_labels(classes or [""], text, code, handleInvalid="keep")
    coded = indexer.transform(worded)
    known = F.when(F.col(code) < len(classes), F.col(code))
    return coded.withColumn(name, known).drop(*[c for c in (text, code) if c != name])


def decode_labels(
    df: DataFrame, column: str, classes: Classes, name: str | None = None, dtype: str = "string"
) -> DataFrame:
    """Turn class codes back into class values; a code that no class has becomes null."""
    if isinstance(classes, dict):
        side = read_codes(df, classes).select(F.col("code").alias("__class_code"), F.col("value").cast(dtype).alias("__class_value"))
        joined = df.join(side, quoted(column).cast("bigint") == F.col("__class_code"), "left")
        return joined.withColumn(name or column, F.col("__class_value")).drop("__class_code", "__class_value")
    table = F.array(*[F.lit(v).cast(dtype) for v in classes])
    return df.withColumn(name or column, F.get(table, quoted(column).cast("int")))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(~is_missing(df, target))
