"""Tables of a source: names, schemas, sizes, inferred keys and relations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.columns import NESTED, is_integral, quoted
from tablewright.functions.counts import distinct_estimate
from tablewright.functions.ordering import first_rows
from tablewright.sources.relations import included, open_pairs, ranges, within

KEY_SCHEMA = "table_name string, column_name string"
RELATION_SCHEMA = (
    "table_name string, column_name string, parent_table string, parent_column string, "
    "n_values long, n_parent_values long, names_agree boolean"
)


class TableSource:
    """Named tables, opened lazily: parquet files of a folder, catalog tables or JDBC.

    Opening a folder lists its ``*.parquet`` entries through Spark's own file listing
    and registers each as a view, so that SQL can name them.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        self.tables = dict(sorted(tables.items()))
        self._keys: dict[str, list[str]] = {}
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> TableSource:
        try:
            wanted = list(names) if names is not None else _list_parquet(spark, folder)
            tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in wanted}
        except Exception as error:
            raise ConnectionError(f"Failed to open {folder}: {error}") from error
        return cls(spark, tables)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None) -> TableSource:
        listed = spark.catalog.listTables(database) if database else spark.catalog.listTables()
        prefix = f"`{database}`." if database else ""
        return cls(spark, {t.name: spark.table(f"{prefix}`{t.name}`") for t in listed})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, names: Sequence[str], **options: str) -> TableSource:
        """Tables of a database by Spark's JDBC reader (its driver must be on the class path).

        ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` in
        ``options`` make the read parallel.
        """
        try:
            reader = spark.read.format("jdbc").option("url", url).options(**options)
            return cls(spark, {n: reader.option("dbtable", n).load() for n in names})
        except Exception as error:
            raise ConnectionError(f"Failed to connect to {url}: {error}") from error

    def list_tables(self) -> list[str]:
        return list(self.tables)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"Unknown table '{name}'; known: {self.list_tables()}")
        return self.tables[name]

    def load_table(self, name: str, limit: int | None = None, order: Sequence[str] | None = None) -> DataFrame:
        """One table, or its first ``limit`` rows in ``order`` (any rows when no order is given)."""
        df = self.table(name)
        if limit is None:
            return df
        return first_rows(df, limit, order) if order else df.limit(limit)

    def preview(self, name: str, n: int = 50, order: Sequence[str] | None = None) -> DataFrame:
        return self.load_table(name, n, order)

    def run_sql(self, query: str) -> DataFrame:
        """SQL text over the registered tables, as Spark plans it."""
        return self.spark.sql(query)

    # -- metadata as DataFrames ---------------------------------------------

    def schemas(self) -> DataFrame:
        rows = [
            (t, i, f.name, f.dataType.simpleString(), f.nullable)
            for t, df in self.tables.items() for i, f in enumerate(df.schema)
        ]
        return self.spark.createDataFrame(
            rows, "table_name string, position int, column_name string, type string, nullable boolean"
        )

    def row_count(self, name: str) -> int:
        return self.table(name).count()

    def row_counts(self, names: Iterable[str] | None = None) -> DataFrame:
        """(table_name, row_count); parquet answers it from file footers."""
        parts = [
            self.table(n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
            for n in (names or self.tables)
        ]
        return reduce(DataFrame.unionByName, parts)

    def table_summary(self) -> DataFrame:
        """(table_name, row_count, column_count, columns) of every table."""
        shapes = F.create_map(*[
            x for n, df in self.tables.items() for x in (F.lit(n), F.array(*[F.lit(c) for c in df.columns]))
        ])
        return self.row_counts().withColumn("columns", F.element_at(shapes, F.col("table_name"))).select(
            "table_name", "row_count", F.size("columns").alias("column_count"), "columns"
        )

    def candidate_keys(self, names: Iterable[str] | None = None) -> DataFrame:
        """(table_name, column_name) of the columns without nulls whose values are all distinct."""
        wanted = list(names or self.tables)
        fresh = [t for t in wanted if t not in self._keys]
        self._keys.update(zip(fresh, _side_by_side(lambda t: unique_columns(self.table(t)), fresh)))
        return self.spark.createDataFrame([(t, c) for t in wanted for c in self._keys[t]], KEY_SCHEMA)

    def foreign_keys(self, match_names: bool = False) -> DataFrame:
        """Inferred relations: every value of a column occurs in a candidate key of another table.

        Any column of the key's class is tried, whatever its name; what values happen to lie
        inside a key by chance (small counters inside long row numbers) is listed too. ``names_agree``
        and the numbers of distinct values tell such pairs apart; ``match_names`` tries only pairs whose
        names agree after their table prefix. A column without values relates to nothing.
        """
        keys = [(r.table_name, r.column_name) for r in self.candidate_keys().collect()]
        agree = (lambda a, b: _stem(a) == _stem(b)) if match_names else None
        pairs = open_pairs(self.tables, keys, agree)
        spans = ranges(self.tables, [p for pair in pairs for p in pair], _side_by_side)
        pairs = [(child, parent) for child, parent in pairs if within(spans[child], spans[parent])]
        found = included(self.tables, [p for pair in pairs for p in pair])
        rows = [
            (*child, *parent, found[child][0], found[parent][0], _stem(child[1]) == _stem(parent[1]))
            for child, parent in pairs if parent in found[child][1]
        ]
        return self.spark.createDataFrame(rows, RELATION_SCHEMA)

    def overview(self) -> DataFrame:
        """One row per table: size, columns with types, inferred keys and relations."""
        columns = self.schemas().groupBy("table_name").agg(
            F.sort_array(F.collect_list(F.struct("position", "column_name", "type", "nullable"))).alias("columns")
        )
        keys = self.candidate_keys().groupBy("table_name").agg(
            F.sort_array(F.collect_list("column_name")).alias("primary_keys")
        )
        relations = self.foreign_keys().groupBy("table_name").agg(
            F.sort_array(F.collect_list(F.struct("column_name", "parent_table", "parent_column"))).alias("foreign_keys")
        )
        return (
            self.row_counts().join(columns, "table_name", "left")
            .join(keys, "table_name", "left").join(relations, "table_name", "left")
        )


def _side_by_side(job, items: list) -> list:
    """Run one small metadata job per table, several at a time."""
    if not items:
        return []
    with ThreadPool(min(8, len(items))) as workers:
        return workers.map(job, items)


def _stem(name: str) -> str:
    """A column name without a one- or two-letter table prefix: ``o_custkey`` is ``custkey``."""
    prefix, _, rest = name.partition("_")
    return (rest if rest and len(prefix) <= 2 else name).lower()


def _list_parquet(spark: SparkSession, folder: str) -> list[str]:
    """Table names: the ``*.parquet`` files or folders directly below ``folder``."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/*.parquet")
    root = folder.split("://")[-1].rstrip("/") + "/"
    below = {r["path"].split(root, 1)[-1].split("/")[0] for r in listed.select("path").distinct().collect()}
    return sorted(name.removesuffix(".parquet") for name in below)


def _comparable(df: DataFrame, name: str) -> Column:
    """Text is compared by digest: whole values count, short digests travel."""
    value = quoted(name)
    return F.unhex(F.md5(value)) if isinstance(df.schema[name].dataType, T.StringType) else value


def unique_columns(df: DataFrame) -> list[str]:
    """Columns without nulls whose values are all distinct.

    A first scan drops columns with nulls and those whose sketched distinct count is
    below half the rows (the sketch is off by a few percent at most) or whose whole
    numbers do not even span as many values as there are rows; only the rest is
    counted exactly.
    """
    names = [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]
    if not names:
        return []
    # wide enough for any difference of two whole numbers
    wide = "decimal(38,0)"
    spans = {c: F.max(quoted(c)).cast(wide) - F.min(quoted(c)).cast(wide) for c in names if is_integral(df.schema[c].dataType)}
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)],
        *[distinct_estimate(quoted(c)).alias(f"d{i}") for i, c in enumerate(names)],
        *[s.alias(f"s{i}") for i, s in ((names.index(c), s) for c, s in spans.items())],
    ).first()
    rows = row["n"]
    likely = [
        c for i, c in enumerate(names)
        if rows and row[f"c{i}"] == rows and row[f"d{i}"] >= rows / 2
        and (c not in spans or row[f"s{i}"] + 1 >= rows)
    ]
    if not likely:
        return []
    exact = df.agg(*[F.count_distinct(_comparable(df, c)).alias(f"d{i}") for i, c in enumerate(likely)]).first()
    return [c for i, c in enumerate(likely) if exact[f"d{i}"] == rows]
