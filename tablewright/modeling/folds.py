"""Repeatable folds and splits from key hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.hashing import default_key, fold_of, hash_text, unit_hash
from tablewright.functions.ordering import number_rows

SEED = 42


def kfold(df: DataFrame, folds: int = 5, key: Sequence[str] | None = None, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Add the fold number 0..folds-1 of each row: an expression, no shuffle."""
    return df.withColumn(name, fold_of(key or default_key(df), seed, folds))


def _class_positions(df: DataFrame, label: str, key: Sequence[str], seed: int) -> DataFrame:
    """Position of each row within its class in hash order, and the class size; big classes are ranked in slices."""
    hashed = df.withColumn("__hash", hash_text(key, seed))
    return number_rows(
        hashed, ["__hash", *key], by=[label], name="__position", share=unit_hash(key, seed), with_total=True
    ).drop("__hash")


def stratified_kfold(
    df: DataFrame, label: str, folds: int = 5, key: Sequence[str] | None = None, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Folds that share out every class evenly: class sizes per fold differ by one at most."""
    ranked = _class_positions(df, label, key or default_key(df), seed)
    fold = ((F.col("__position") - 1) % folds).cast("int")
    return ranked.withColumn(name, fold).drop("__position", "__position_total")


def train_test(
    df: DataFrame, test_size: float = 0.2, key: Sequence[str] | None = None, seed: int = SEED, name: str = "is_test"
) -> DataFrame:
    """Add ``name``: the rows whose hash lies below ``test_size``."""
    return df.withColumn(name, unit_hash(key or default_key(df), seed) < F.lit(test_size))


def stratified_train_test(
    df: DataFrame, label: str, test_size: float = 0.2, key: Sequence[str] | None = None, seed: int = SEED,
    name: str = "is_test",
) -> DataFrame:
    """Add ``name`` so that each class gives the rounded share ``test_size`` of its rows."""
    ranked = _class_positions(df, label, key or default_key(df), seed)
    share = F.floor(F.col("__position_total") * F.lit(test_size) + F.lit(0.5))
    return ranked.withColumn(name, F.col("__position") <= share).drop("__position", "__position_total")
