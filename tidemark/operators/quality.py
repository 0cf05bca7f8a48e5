"""Checks as violation tables: an empty result means the rule holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import any_of, finite

PREVIEW_ROWS = 10


class DataQualityError(ValueError):
    """A rule about the data does not hold."""


def require_empty(violations: DataFrame, rule: str) -> None:
    """Raise with a preview of the offending rows; at most `PREVIEW_ROWS` reach the driver."""
    preview = violations.limit(PREVIEW_ROWS).collect()
    if preview:
        raise DataQualityError(f"{rule}: {[r.asDict() for r in preview]}")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """A join that fails if the right side (with one_to_one either side) has a key twice.

    The count rides on the shuffle that the join needs anyway and is combined before it; a broken key stops the job with
    its values in the message.
    """
    keys = list(on)

    def single(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        rows = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("__row"))
        told = F.concat(F.lit(f"{side} side has a key more than once: "), F.to_json(F.struct(*keys)))
        checked = F.when(F.col("__n") > 1, F.raise_error(told).cast(rows.schema["__row"].dataType)).otherwise(F.col("__row"))
        return rows.select(*keys, checked.alias("__row")).select(*keys, *(F.col(f"__row.`{c}`").alias(c) for c in rest))

    return (single(left, "left") if one_to_one else left).join(single(right, "right"), keys, how)


def invalid_prices(prices: DataFrame, column: str = "close") -> DataFrame:
    value = F.col(column)
    return prices.filter(~finite(value) | (value <= 0))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def check_prices(prices: DataFrame, column: str = "close") -> None:
    require_empty(invalid_prices(prices, column).select("ticker", "trade_date", column), "invalid prices")
    require_empty(duplicate_keys(prices, ["ticker", "trade_date"]), "duplicate price rows")


def not_finite(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(any_of([~finite(F.col(c)) for c in columns]))


def future_facts(df: DataFrame, clock: str = "trade_date", received: str = "received", reference: str = "reference_date") -> DataFrame:
    """Rows that use a fact received after their own date, or received before its period ended."""
    return df.filter((F.col(received) > F.col(clock)) | (F.col(reference) > F.col(received)))


def split_violations(train: DataFrame, evaluation: DataFrame, clock: str = "trade_date", label_end: str | None = None) -> DataFrame:
    """One row when training dates or labels reach the evaluation window."""
    last = [F.max(clock).alias("train_last")]
    last.append((F.max(label_end) if label_end else F.max(clock)).alias("label_last"))
    first = evaluation.agg(F.min(clock)).scalar()
    bounds = train.agg(*last).withColumn("evaluation_first", first)
    return bounds.filter("train_last >= evaluation_first OR label_last >= evaluation_first")


def execution_not_after_signal(df: DataFrame, signal: str = "trade_date", execution: str = "execution_date") -> DataFrame:
    return df.filter(F.col(execution).isNull() | (F.col(execution) <= F.col(signal)))


def pair_matrix_violations(pairs: DataFrame, by: Sequence[str], value: str = "correlation") -> DataFrame:
    """Rules of a correlation matrix kept as pairs i <= j: finite, unit diagonal, within [-1, 1]."""
    v = F.col(value)
    reason = (
        F.when(~finite(v), "not_finite")
        .when((F.col("asset_i") == F.col("asset_j")) & (F.abs(v - 1.0) > 1e-8), "diagonal")
        .when(F.abs(v) > 1.0 + 1e-8, "range")
    )
    return pairs.select(*by, "asset_i", "asset_j", value, reason.alias("reason")).filter("reason IS NOT NULL")


def reversed_intervals(df: DataFrame, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return df.filter(F.col(start) > F.col(end))


def weight_violations(weights: DataFrame, by: Sequence[str] = ("trade_date",), weight: str = "target_weight") -> DataFrame:
    bad = ~finite(F.col(weight)) | (F.col(weight) < 0)
    return (
        weights.groupBy(*by)
        .agg(F.sum(weight).alias("weight_sum"), F.sum(bad.cast("bigint")).alias("bad_rows"))
        .filter("bad_rows > 0 OR weight_sum <= 0 OR weight_sum > 1.000001")
    )


def months_with_many_dates(signals: DataFrame, by: Sequence[str] = (), clock: str = "trade_date") -> DataFrame:
    month = F.trunc(clock, "MM").alias("month")
    dates = signals.select(*by, month, clock).distinct()
    return dates.groupBy(*by, "month").agg(F.count("*").alias("dates")).filter("dates > 1")


def not_allowed(column: Column, allowed: Sequence[str]) -> Column:
    value = F.upper(F.trim(column))
    return value.isNull() | ~value.isin(list(allowed))


def values_not_allowed(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    value = F.upper(F.trim(F.col(column)))
    return df.filter(not_allowed(F.col(column), allowed)).groupBy(value.alias(column)).agg(F.count("*").alias("rows"))


def quarantine(df: DataFrame, bad: Column, reason: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and a side table; every row that shares a bad row's key leaves."""
    w = Window.partitionBy(*keys)
    marked = df.withColumn("__bad", F.max(F.coalesce(bad, F.lit(True)).cast("int")).over(w) == 1)
    good = marked.filter(~F.col("__bad")).drop("__bad")
    side = df.filter(F.coalesce(bad, F.lit(True))).withColumn("quarantine_reason", F.lit(reason))
    return good, side
