"""Leakage-safe training and evaluation windows.

Every rule looks at the end date of the label, because a label that is still open when the
evaluation starts already contains evaluation prices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labels_known_by(df: DataFrame, cutoff: str, clock: str = "trade_date", label_end: str = "target_end_date") -> DataFrame:
    day = F.lit(cutoff).cast("date")
    return df.filter((F.col(clock) <= day) & (F.col(label_end) <= day))


def purge_overlapping(
    train: DataFrame, evaluation_start, embargo_days: int = 0, label_end: str = "target_end_date"
) -> DataFrame:
    """Training rows whose label ends before the evaluation window, less an embargo."""
    limit = F.date_sub(F.lit(evaluation_start).cast("date"), embargo_days)
    return train.filter(F.col(label_end) < limit)


def embargo_after(df: DataFrame, validation_end, days: int, clock: str = "trade_date") -> DataFrame:
    end = F.lit(validation_end).cast("date")
    return df.filter(~((F.col(clock) > end) & (F.col(clock) <= F.date_add(end, days))))


def year_folds(
    df: DataFrame,
    years: Sequence[int],
    rolling_years: int | None = None,
    embargo_days: int = 0,
    clock: str = "trade_date",
    label_end: str = "target_end_date",
) -> DataFrame:
    """One tagged table with all folds: rows of a fold year validate, earlier rows train.

    The fold list is a small constant array, so each row is multiplied in place and nothing is
    shuffled. Training rows are purged against the first day of their fold's year.
    """
    start = F.make_date(F.col("fold_year"), F.lit(1), F.lit(1))
    known = F.col(label_end) < F.date_sub(start, embargo_days)
    past = F.year(clock) < F.col("fold_year")
    if rolling_years is not None:
        past = past & (F.year(clock) >= F.col("fold_year") - rolling_years)
    role = F.when(F.year(clock) == F.col("fold_year"), "valid").when(past & known, "train")
    fanned = df.withColumn("fold_year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    return fanned.withColumn("role", role).filter(F.col("role").isNotNull())


def usable_folds(tagged: DataFrame, min_train: int = 500, min_valid: int = 100) -> DataFrame:
    """Row counts of each fold, kept only where both sides are large enough."""
    counts = tagged.groupBy("fold_year").agg(
        F.count(F.when(F.col("role") == "train", 1)).alias("train_rows"),
        F.count(F.when(F.col("role") == "valid", 1)).alias("valid_rows"),
        F.max(F.when(F.col("role") == "train", F.col("target_end_date"))).alias("last_train_label"),
        F.min(F.when(F.col("role") == "valid", F.col("trade_date"))).alias("first_valid_date"),
    )
    return counts.filter((F.col("train_rows") >= min_train) & (F.col("valid_rows") >= min_valid))
