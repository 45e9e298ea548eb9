"""Model quality as aggregations; exact at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.ordering import running_totals


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n): as many rows as pairs of classes."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(pairs: DataFrame) -> DataFrame:
    """(class, support, predicted, hits) from confusion counts."""
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )).alias("s"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    return sides.groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"),
        # a hit appears once on each side
        (F.sum("hit") / 2).alias("hits"),
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighted by class size (0 where undefined)."""
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    total = F.sum("support")
    return per_class(confusion(df, label, prediction)).agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(precision * F.col("support")) / total).alias("precision"),
        (F.sum(recall * F.col("support")) / total).alias("recall"),
        (F.sum(f1 * F.col("support")) / total).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the exact area under the ROC curve of a 0/1 label, ties counted half.

    Scores are counted first, so equal scores are one row; the running count of
    negatives is then taken over score slices, not in one task.
    """
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(counts, ["score"], {"neg_upto": F.col("neg")})
    pairs = F.sum(F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") / 2))
    return ranked.agg(F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: R2, MSE, RMSE and MAE."""
    error = F.col(label).cast("double") - F.col(prediction)
    mse = F.avg(error * error)
    return df.agg(
        (1 - F.try_divide(mse, F.var_pop(label))).alias("r2"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )
