"""Validity intervals: range joins, overlap checks and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "2999-12-31"


def range_join(
    df: DataFrame,
    intervals: DataFrame,
    by: str = "ticker",
    clock: str = "trade_date",
    start: str = "valid_from",
    end: str = "valid_to",
    how: str = "left",
) -> DataFrame:
    """Attach the interval that holds at `clock`; unmapped rows stay with nulls under a left join.

    Plans as an equi-join on the entity with the dates as residual; an entity has few intervals.
    """
    right = intervals.withColumnRenamed(by, "__by")
    hit = (F.col(by) == F.col("__by")) & (F.col(clock) >= F.col(start)) & (F.col(clock) <= F.col(end))
    return df.join(right, hit, how).drop("__by")


def unmapped(df: DataFrame, intervals: DataFrame, by: str = "ticker", clock: str = "trade_date") -> DataFrame:
    right = intervals.withColumnRenamed(by, "__by")
    hit = (F.col(by) == F.col("__by")) & (F.col(clock) >= F.col("valid_from")) & (F.col(clock) <= F.col("valid_to"))
    return df.join(right, hit, "left_anti")


def overlaps(intervals: DataFrame, by: str = "ticker", owner: str | None = None) -> DataFrame:
    """Start dates at which an earlier interval of the same entity is still open.

    Intervals that share a start are counted together first, so an entity has at most one row per
    day, and one sorted pass with a running maximum replaces a self-join. With `owner`, only a
    clash between different owners counts: the intervals of one owner are merged beforehand, so
    any overlap that is left has two owners.
    """
    if owner is not None:
        intervals = merge_overlapping(intervals, (by, owner))
    starts = intervals.groupBy(by, "valid_from").agg(
        F.max("valid_to").alias("valid_to"), F.count("*").alias("intervals")
    )
    w = Window.partitionBy(by).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1)
    checked = starts.withColumn("earlier_end", F.max("valid_to").over(w))
    return checked.filter((F.col("intervals") > 1) | (F.col("valid_from") <= F.col("earlier_end")))


def collapse_repeats(history: DataFrame, keys: Sequence[str] = ("company_id", "ticker", "valid_from")) -> DataFrame:
    """One row per explicit start date; a closing date in any filing wins over an open end."""
    complete = history.dropna(subset=list(keys))
    return complete.groupBy(*keys).agg(F.max("valid_to").alias("valid_to"))


def merge_overlapping(intervals: DataFrame, by: Sequence[str] = ("ticker", "issuer_id")) -> DataFrame:
    """Union of overlapping intervals of the same entity and owner; gaps are not bridged.

    Equal start dates are reduced before the window, so a group has at most one row per day.
    """
    intervals = intervals.groupBy(*by, "valid_from").agg(F.max("valid_to").alias("valid_to"))
    w = Window.partitionBy(*by).orderBy("valid_from")
    reach = F.max("valid_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("valid_from") <= F.col("__reach"), 0).otherwise(1)
    islands = intervals.withColumn("__reach", reach).withColumn("__fresh", fresh)
    islands = islands.withColumn("__island", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island").agg(
        F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")
    ).drop("__island")
