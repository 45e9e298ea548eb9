"""Profiles of a table: shape, missing values, distributions, correlations, target relations.

Every report is a small tidy DataFrame. Scalar statistics of all columns come from
one aggregation, value counts of all columns from one stacked group-by.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.columns import (
    as_double, ensure_columns, flat_columns, is_categorical, is_missing, is_numeric, quoted, split_columns,
)
from tablewright.functions.counts import most_frequent, value_counts
from tablewright.functions.quantiles import exact_quantiles
from tablewright.operators.columns import coerce_numeric
from tablewright.session import cut_lineage

PLACES = 4
REPORT_COLUMNS = ("section", "column_name", "metric", "value")
# Pairs of columns whose products are summed in one scan.
PAIRS_PER_SCAN = 500


def _long(row: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One aggregated row with ``<name><i>`` fields, turned into one row per column."""
    if not columns:
        return _no_rows(row, names)
    items = [x for i, c in enumerate(columns) for x in (F.lit(c), *[F.col(f"{n}{i}") for n in names])]
    return row.select(F.stack(F.lit(len(columns)), *items).alias("column_name", *names))


def _no_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The shape of a report about no column at all."""
    kinds = {"count": "bigint", "null_count": "bigint", "missing": "bigint"}
    return df.sparkSession.createDataFrame(
        [], ", ".join(["column_name string", *(f"`{n}` {kinds.get(n, 'double')}" for n in names)]))


def _skew(value: Column) -> Column:
    """Sample skewness: the population form with the small-sample correction."""
    n = F.count(value).cast("double")
    corrected = F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)) * F.skewness(value)
    return F.when(n < 3, F.lit(None)).when(F.stddev_pop(value) == 0, F.lit(0.0)).otherwise(corrected)


def basic_shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and the names of the numeric and categorical columns."""
    numeric, categorical = split_columns(df)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(",".join(numeric)).alias("numeric_columns"),
        F.lit(",".join(categorical)).alias("categorical_columns"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """(column_name, missing): missing cells per column; their sum is the table's total."""
    counts = df.agg(*[F.count_if(is_missing(df, c)).alias(f"missing{i}") for i, c in enumerate(df.columns)])
    return _long(counts, df.columns, ["missing"])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier row (missing equals missing)."""
    def key(field: T.StructField) -> Column:
        # maps cannot be grouped by; their entries in order can
        value = quoted(field.name)
        return F.array_sort(F.map_entries(value)) if isinstance(field.dataType, T.MapType) else value

    groups = df.select(*[key(f).alias(f"k{i}") for i, f in enumerate(df.schema)])
    groups = groups.groupBy(*groups.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum of the numeric columns."""
    names = list(columns or split_columns(df)[0])
    ensure_columns(df, names)
    if not names:
        return _no_rows(df, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    row = df.agg(*[
        f(as_double(df, c)).alias(f"{n}{i}") for i, c in enumerate(names)
        for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ])
    row = row.withColumns({
        f"{label}{i}": F.lit(quartiles[c][p]).cast("double")
        for i, c in enumerate(names) for label, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    })
    return _long(row, names, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def _both(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are present; null without spread."""
    together = x.isNotNull() & y.isNotNull()
    px, py = F.when(together, x), F.when(together, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation) for all ordered pairs; booleans are left out.

    A first scan finds means, gaps and constants, a second one sums the products of
    the centred columns: one sum per pair of complete columns, a few more where rows
    with gaps have to be left out pair by pair. Wide tables take the pairs in groups.
    """
    names = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])
    if len(names) < 2:
        raise ValueError(f"a correlation matrix takes two numeric columns or more, here are {names}")
    plain = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    facts = plain.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(f"x{i}").alias(f"{k}{i}") for i in range(len(names))
          for k, f in (("p", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))],
    ).first()
    varies = [i for i in range(len(names)) if facts[f"p{i}"] and facts[f"lo{i}"] < facts[f"hi{i}"]]
    whole = {i for i in varies if facts[f"p{i}"] == facts["n"]}
    centred = plain.select(*[(F.col(f"x{i}") - F.lit(facts[f"m{i}"])).alias(f"x{i}") for i in varies])
    pairs = list(combinations(varies, 2))
    found: dict[tuple[int, int], float | None] = {(i, i): 1.0 for i in varies}
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        found.update(_pair_correlations(centred, pairs[start:start + PAIRS_PER_SCAN], whole))
    rows = [
        (names[a], names[b], found.get((min(a, b), max(a, b)))) for a in range(len(names)) for b in range(len(names))
    ]
    long = df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")
    return long.withColumn("correlation", F.round("correlation", PLACES))


def _pair_correlations(centred: DataFrame, pairs: list[tuple[int, int]], whole: set[int]) -> dict:
    if not pairs:
        return {}
    products, gapless = [], [i for i in sorted({i for p in pairs for i in p}) if i in whole]
    for i in gapless:
        products.append(F.sum(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"s{i}"))
    for a, b in pairs:
        x, y = F.col(f"x{a}"), F.col(f"x{b}")
        products.append(F.sum(x * y).alias(f"s{a}_{b}") if a in whole and b in whole else _both(x, y).alias(f"r{a}_{b}"))
    row = centred.agg(*products).first()
    return {
        (a, b): row[f"s{a}_{b}"] / (row[f"s{a}"] * row[f"s{b}"]) ** 0.5 if a in whole and b in whole else row[f"r{a}_{b}"]
        for a, b in pairs
    }


def numeric_insights(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, data_type, null_count, mean, std, min, max, skew), rounded to 4 places."""
    names = list(columns or split_columns(df)[0])
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, data_type string, null_count bigint, mean double, std double, min double, max double, skew double")
    values = {c: as_double(df, c) for c in names}
    row = df.agg(*[
        e.alias(f"{n}{i}") for i, c in enumerate(names)
        for n, e in (
            ("null_count", F.count_if(is_missing(df, c))),
            ("mean", F.avg(values[c])), ("std", F.stddev_samp(values[c])),
            ("min", F.min(values[c])), ("max", F.max(values[c])), ("skew", _skew(values[c])),
        )
    ])
    long = _long(row, names, ["null_count", "mean", "std", "min", "max", "skew"])
    rounded = [F.round(n, PLACES).alias(n) for n in ("mean", "std", "min", "max", "skew")]
    return long.select("column_name", _type_of(df, names), "null_count", *rounded)


def _type_of(df: DataFrame, names: Sequence[str]) -> Column:
    table = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    return F.element_at(table, F.col("column_name")).alias("data_type")


def categorical_insights(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column_name, n_distinct, rank, value, n): distinct count and most frequent values."""
    names = list(columns or split_columns(df)[1])
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct bigint, rank int, value string, n bigint")
    counts = cut_lineage(value_counts(df, names))
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    top = most_frequent(df, counts, k)
    # one row per column on this side: its size is the width of the table
    joined = top.join(F.broadcast(distinct), "column")
    return joined.select(F.col("column").alias("column_name"), "n_distinct", "rank", "value", "n")


def target_numeric(df: DataFrame, target: str) -> DataFrame:
    """Mean, median, deviation, minimum, maximum and skewness of a numeric target."""
    ensure_columns(df, [target])
    value = as_double(df, target)
    median = exact_quantiles(df, [target], [0.5])[target][0.5]
    row = df.agg(
        F.count_if(is_missing(df, target)).alias("null_count"), F.avg(value).alias("mean"),
        F.lit(median).cast("double").alias("median"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), _skew(value).alias("skew"),
    )
    rounded = [F.round(n, PLACES).alias(n) for n in ("mean", "median", "std", "min", "max", "skew")]
    return row.select(F.lit(target).alias("target_column"), "null_count", *rounded)


def target_categorical(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """(value, n, unique_classes): the most frequent classes of a target."""
    ensure_columns(df, [target])
    top = categorical_insights(df, [target], k)
    return top.select("value", "n", F.col("n_distinct").alias("unique_classes"))


def target_correlations(df: DataFrame, target: str, min_values: int = 10) -> DataFrame:
    """(column_name, correlation) of the numeric columns with the target, strongest first.

    A text target is read as numbers where possible; with ``min_values`` or fewer
    numeric target values, and for columns without spread, there is no row.
    """
    ensure_columns(df, [target])
    y = as_double(df, target) if is_numeric(df.schema[target].dataType) else coerce_numeric(target)
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != target]
    if not names:
        return _no_rows(df, ["correlation"])
    plain = df.select(y.alias("y"), *[as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    row = plain.agg(
        F.count("y").alias("n"),
        *[_both(F.col(f"x{i}"), F.col("y")).alias(f"correlation{i}") for i in range(len(names))],
    ).where(F.col("n") > min_values)
    long = _long(row, names, ["correlation"]).withColumn("correlation", F.round("correlation", PLACES))
    return long.where("correlation IS NOT NULL").orderBy(F.desc(F.abs("correlation")), "column_name")


def summary_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """All of the above as (section, column_name, metric, value) with values as text.

    Everything scalar comes from one aggregation of the table; top values, repeated
    rows, quartiles and correlations add their own scans, each made once.
    """
    if target is not None:
        ensure_columns(df, [target])
    numeric, categorical = split_columns(df)
    number_target = target in numeric
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    cells = [("shape", "*", n, F.col(n)) for n in ("row_count", "column_count", "numeric_columns", "categorical_columns")]
    scalars: dict[str, Column] = {}

    def cell(section: str, column: str, metric: str, value: Column) -> None:
        name = f"m{len(scalars)}"
        scalars[name] = value.alias(name)
        cells.append((section, column, metric, F.col(name)))

    for c in df.columns:
        cell("missing", c, "missing", F.count_if(is_missing(df, c)))
    for c in numeric:
        v = as_double(df, c)
        spread = {
            "mean": F.round(F.avg(v), PLACES), "std": F.round(F.stddev_samp(v), PLACES),
            "min": F.round(F.min(v), PLACES), "max": F.round(F.max(v), PLACES),
        }
        quarters = {k: F.round(F.lit(quartiles[c][p]).cast("double"), PLACES) for k, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))}
        nulls, skew = F.count_if(is_missing(df, c)), F.round(_skew(v), PLACES)
        sections = [("describe", {"count": F.count(v), **spread, **quarters}), ("insights", {"null_count": nulls, **spread, "skew": skew})]
        if c == target:
            sections.append(("target", {"null_count": nulls, "median": quarters["q50"], **spread, "skew": skew}))
        for section, metrics in sections:
            for metric, value in metrics.items():
                cell(section, c, metric, value)
    row = df.agg(F.count(F.lit(1)).alias("row_count"), *scalars.values()).withColumns({
        "column_count": F.lit(len(df.columns)), "numeric_columns": F.lit(",".join(numeric)),
        "categorical_columns": F.lit(",".join(categorical)),
    })
    items = [x for section, c, m, v in cells for x in (F.lit(section), F.lit(c), F.lit(m), v.cast("string"))]
    parts = [
        row.select(F.stack(F.lit(len(cells)), *items).alias(*REPORT_COLUMNS)),
        duplicate_rows(df).select(
            F.lit("duplicates").alias("section"), F.lit("*").alias("column_name"), F.lit("duplicate_rows").alias("metric"),
            F.col("duplicate_rows").cast("string").alias("value"),
        ),
    ]
    if categorical:
        parts.append(_categorical_report(df, categorical, None if number_target else target))
    measured = [c for c in numeric if isinstance(df.schema[c].dataType, T.NumericType)]
    if len(measured) > 1:
        matrix = correlation_matrix(df, measured)
        parts.append(matrix.select(
            F.lit("correlations").alias("section"), F.col("column_a").alias("column_name"),
            F.col("column_b").alias("metric"), F.col("correlation").cast("string").alias("value"),
        ))
    if target is not None:
        parts.append(target_correlations(df, target).select(
            F.lit("target_correlations").alias("section"), "column_name", F.lit("correlation").alias("metric"),
            F.col("correlation").cast("string").alias("value"),
        ))
    return reduce(DataFrame.unionByName, parts)


def _categorical_report(df: DataFrame, columns: Sequence[str], target: str | None) -> DataFrame:
    """Top values, distinct counts and the target's classes, from one set of value counts."""
    ranked = categorical_insights(df, columns, 10)
    def entry(section: str, metric: Column, value: Column, shown: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), metric.alias("metric"), value.alias("value"), shown.alias("shown")
        )

    n, distinct, value = F.col("n"), F.col("n_distinct"), F.col("value")
    entries = [
        entry("top_values", value, n, F.col("rank") <= 5), entry("distinct", F.lit("n_distinct"), distinct, F.col("rank") == 1)
    ]
    if target is not None:
        entries.append(entry("target", value, n, F.col("column_name") == target))
    long = ranked.select("column_name", F.explode(F.array(*entries)).alias("e")).where("e.shown")
    return long.select("e.section", "column_name", "e.metric", F.col("e.value").cast("string").alias("value"))


def dataset_digest(df: DataFrame, k: int = 5) -> DataFrame:
    """(column_name, data_type, n_distinct, null_count, min, max, mean, top): one row per flat column."""
    names = flat_columns(df)
    counts = cut_lineage(value_counts(df, names))
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    texts = [c for c in names if is_categorical(df.schema[c].dataType)]
    ranked = most_frequent(df, counts.where(F.col("column").isin(texts)), k)
    shown = F.concat_ws("", F.col("value"), F.lit("("), F.col("n").cast("string"), F.lit(")"))
    top = ranked.groupBy("column").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", shown.alias("t")))), lambda s: s["t"]), ", ")
        .alias("top")
    )
    row = df.agg(*[
        e.alias(f"{n}{i}") for i, c in enumerate(names)
        for n, e in (
            ("null_count", F.count_if(is_missing(df, c))),
            *[
                (n, F.round(f(as_double(df, c)), 2) if is_numeric(df.schema[c].dataType) else F.lit(None).cast("double"))
                for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
            ],
        )
    ])
    long = _long(row, names, ["null_count", "min", "max", "mean"])
    # both sides below have one row per column
    joined = long.join(F.broadcast(distinct), F.col("column_name") == F.col("column"), "left").drop("column")
    joined = joined.join(F.broadcast(top), F.col("column_name") == F.col("column"), "left").drop("column")
    return joined.select(
        "column_name", _type_of(df, names), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        "null_count", "min", "max", "mean", "top",
    )
