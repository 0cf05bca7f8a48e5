"""As-of joins on DataFrames.

The left side is first reduced to its distinct (key, clock) pairs, which a key has at most once
per day. Facts are merged into that short timeline with one window per key, and the answer is
joined back on (key, clock). A key that owns a third of the panel therefore never puts its panel
rows into one window task; the join back is an ordinary equi-join that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_clock: str,
    right_clock: str,
    columns: Sequence[str] | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Latest right row with right_clock <= left_clock for the same key (left join).

    `columns` are the right columns to carry; `ties` orders right rows of equal clock, last wins.
    """
    by = list(by)
    columns = [c for c in right.columns if c not in by] if columns is None else list(columns)
    packed = F.struct(*[F.col(c) for c in columns])
    tie = F.struct(*[F.col(c) for c in ties]) if ties else F.lit(0)
    # One fact per key and clock is enough: the last one by `ties`.
    facts = right.filter(F.col(right_clock).isNotNull()).groupBy(*by, F.col(right_clock).alias("__clock")).agg(
        F.max_by(packed, tie).alias("__fact")
    )
    clocks = left.select(*by, F.col(left_clock).alias("__clock")).distinct()
    timeline = facts.withColumn("__asked", F.lit(False)).unionByName(
        clocks.withColumn("__asked", F.lit(True)), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy("__clock", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    answers = (
        timeline.withColumn("__fact", F.last("__fact", ignorenulls=True).over(w))
        .filter(F.col("__asked") & F.col("__fact").isNotNull())
        .select(*by, F.col("__clock").alias(left_clock), *[F.col("__fact")[c].alias(c) for c in columns])
    )
    return left.join(answers, [*by, left_clock], "left")


def asof_series(
    left: DataFrame, series: DataFrame, left_clock: str, series_clock: str, value: str, lag_days: int = 0, out: str | None = None
) -> DataFrame:
    """As-of join without a key: one value per date, known `lag_days` after its own date.

    Both sides are reduced to one row per date before the ordering window, and the answer (one row
    per session) is broadcast, so the panel is not moved.
    """
    out = out or value
    known = series.select(F.date_add(series_clock, lag_days).alias("__clock"), F.col(value).alias(out))
    known = known.groupBy("__clock").agg(F.max(out).alias(out)).withColumn("__asked", F.lit(False))
    asked = left.select(F.col(left_clock).alias("__clock")).distinct().withColumn("__asked", F.lit(True))
    w = Window.orderBy("__clock", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    answers = (
        known.unionByName(asked, allowMissingColumns=True)
        .withColumn(out, F.last(out, ignorenulls=True).over(w))
        .filter("__asked")
        .select(F.col("__clock").alias(left_clock), out)
    )
    return left.join(F.broadcast(answers), left_clock, "left")
