"""One object for the whole route: source, working dataset, chain, profile, model, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablewright import analysis
from tablewright.modeling.candidates import Settings
from tablewright.modeling.selection import TrainedModel, train_best
from tablewright.plans import FittedPlan, validate_specs
from tablewright.sources import TableSource, records, save_dataset

REPORTS = ("summary", "correlations", "insights", "target")


def _target_reports(df: DataFrame, target: str | None) -> tuple[DataFrame, DataFrame]:
    if target not in df.columns:
        raise ValueError(f"the target report is about one of {df.columns}, not {target!r}")
    numeric, _ = analysis.profile.split_columns(df)
    distribution = analysis.target_numeric if target in numeric else analysis.target_categorical
    return distribution(df, target), analysis.target_correlations(df, target)


REPORTS = {
    "summary": analysis.summary_report,
    "correlations": lambda df, target: analysis.correlation_matrix(df),
    "insights": lambda df, target: (analysis.numeric_insights(df), analysis.categorical_insights(df)),
    "target": _target_reports,
}


class Workspace:
    """A table source with a current dataset, its fitted plan and its trained model.

    Every dataset and report is a DataFrame; nothing is computed before it is asked for.
    """

    def __init__(
        self, source: TableSource, task_type: str | None = None, test_size: float = 0.2, cv_folds: int = 5,
        random_state: int = 42, settings: Settings | None = None,
    ):
        self.source, self.spark = source, source.spark
        self.task_type, self.test_size, self.cv_folds = task_type, test_size, cv_folds
        self.random_state, self.settings = random_state, settings
        self.name: str | None = None
        self.loaded: DataFrame | None = None       # as it came from the source
        self.data: DataFrame | None = None         # after the chain
        self.plan: FittedPlan | None = None
        self.model: TrainedModel | None = None
        self.leaderboard: DataFrame | None = None
        self.target_column: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **options: Any) -> Workspace:
        return cls(TableSource.from_parquet(spark, folder), **options)

    # -- source ------------------------------------------------------------------

    def list_tables(self) -> list[str]:
        return self.source.list_tables()

    def get_database_overview(self) -> DataFrame:
        return self.source.overview()

    def get_table_summary(self) -> DataFrame:
        return self.source.table_summary()

    def load_table(self, table_name: str, limit: int | None = None, order: Sequence[str] | None = None) -> DataFrame:
        return self._work_on(self.source.load_table(table_name, limit, order), table_name)

    def execute_query(self, query: str) -> DataFrame:
        return self.source.run_sql(query)

    def load_query_as_data(self, query: str) -> DataFrame:
        return self._work_on(self.source.run_sql(query), f"query: {query[:50]}...")

    def use_data(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Any DataFrame as the working dataset."""
        return self._work_on(df, name)

    def _work_on(self, df: DataFrame, name: str | None) -> DataFrame:
        self.loaded, self.data, self.name, self.plan = df, df, name, None
        return df

    def _current(self) -> DataFrame:
        if self.data is None:
            raise RuntimeError("this needs a working dataset; name one with load_table, load_query_as_data or use_data")
        return self.data

    # -- preparation ---------------------------------------------------------------

    def apply_preprocessing(self, operations: Sequence[dict[str, Any]], target: str | None = None) -> DataFrame:
        """Fit and apply a chain; later chains are added to it. ``target`` guards a column from changes."""
        fitted = FittedPlan.fit(self._current(), validate_specs(operations, target))
        self.data = fitted.apply(self._current())
        self.plan = FittedPlan([*(self.plan.steps if self.plan else []), *fitted.steps])
        return self.data

    def get_preprocessing_summary(self) -> DataFrame:
        """Step by step row and column counts of the chain so far."""
        self._current()
        return (self.plan or FittedPlan([])).lineage(self.loaded)

    def prepare_new_rows(self, df: DataFrame) -> DataFrame:
        """Replay the chain's row-wise steps on rows in the source's form."""
        return self.plan.replay(df) if self.plan else df

    def save_dataset(self, folder: str, table_name: str | None = None, include_original_tables: bool = False) -> str:
        originals = self.source if include_original_tables else None
        return save_dataset(self._current(), folder, table_name or self.name, originals)

    # -- analysis ------------------------------------------------------------------

    def analyze(self, target_column: str | None = None, analysis_type: str = "summary") -> DataFrame | tuple[DataFrame, ...]:
        """``summary``, ``correlations``, ``insights`` (numeric, categorical) or ``target``
        (distribution, correlations)."""
        report = REPORTS.get(analysis_type)
        if report is None:
            raise ValueError(f"no report is called {analysis_type!r}; there are {sorted(REPORTS)}")
        return report(self._current(), target_column or self.target_column)

    def suggest_target(self, preferred: str | None = None) -> dict[str, Any]:
        return analysis.suggest_target(self._current(), preferred)

    def suggest_preprocessing(self, target_column: str | None = None) -> list[dict[str, Any]]:
        return analysis.suggest_preprocessing(self._current(), target_column)

    # -- model ---------------------------------------------------------------------

    def train(
        self, target_column: str, task_type: str | None = None, table_name: str | None = None,
        key: Sequence[str] | None = None, models: Sequence[str] | None = None,
    ) -> DataFrame:
        """Compare the candidates and keep the refitted best; returns the leaderboard."""
        if table_name:
            self.load_table(table_name)
        self.model, self.leaderboard = train_best(
            self._current(), target_column, task_type or self.task_type, key, self.cv_folds, self.test_size,
            self.settings, models, self.random_state,
        )
        self.target_column = target_column
        return self.leaderboard

    def _trained(self) -> TrainedModel:
        if self.model is None:
            raise RuntimeError("this needs a model; use train or load_model")
        return self.model

    def predict(self, data: DataFrame | dict[str, Any] | list[dict[str, Any]] | str) -> DataFrame:
        """Score a DataFrame (batch or stream), or a few records given in code or as JSON."""
        model = self._trained()
        if not isinstance(data, DataFrame):
            data = records(self.spark, data, self._current().schema if self.data is not None else None)
        return model.predict(data)

    def get_model_info(self) -> DataFrame:
        return self._trained().info(self.spark)

    def get_feature_importance(self) -> DataFrame | None:
        return self._trained().feature_importance(self.spark)

    def save_model(self, path: str) -> None:
        self._trained().save(self.spark, path)

    def load_model(self, path: str) -> None:
        self.model = TrainedModel.load(self.spark, path)
        self.target_column = self.model.meta["target_column"]
