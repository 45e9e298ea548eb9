"""Fitted plans and models on streams.

Only row-wise work is replayed, so the streams need no state: the same expressions
as in a batch, planned once and run per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from tablewright.modeling.selection import TrainedModel
from tablewright.plans import FittedPlan
from tablewright.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the parquet files that match ``path``, now and later."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def transform_stream(stream: DataFrame, plan: FittedPlan) -> DataFrame:
    return plan.replay(stream)


def predict_stream(stream: DataFrame, model: TrainedModel) -> DataFrame:
    return model.predict(stream)


def drain(stream: DataFrame, path: str, progress: str) -> None:
    """Process what is available, write it to ``path`` as parquet and stop.

    ``progress`` keeps the offsets: a restarted query goes on where it stopped and the
    file sink writes each batch once.
    """
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def through_stream(
    spark: SparkSession, path: str, schema: T.StructType, step: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run ``step`` over the files of ``path`` as a stream and read back what it wrote."""
    work = scratch_path(spark, "stream")
    result = step(read_stream(spark, path, schema))
    drain(result, f"{work}/out", f"{work}/progress")
    return spark.read.schema(result.schema).parquet(f"{work}/out")
