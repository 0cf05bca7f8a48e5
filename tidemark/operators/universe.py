"""Which names could have been traded on each date, and targets inside that set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import add_average_ranks
from tidemark.functions.scalars import traded_value


@dataclass(frozen=True)
class UniverseConfig:
    history: int = 252
    participation_window: int = 63
    participation: float = 0.90
    adv_window: int = 63
    adv: float = 1_000_000.0
    price: float | None = None


def session_calendar(prices: DataFrame) -> DataFrame:
    """Sessions numbered from 0.

    Dates are made distinct first (with map-side partial aggregation), so the ordering window
    sees one row per session.
    """
    sessions = prices.select("trade_date").distinct()
    index = F.row_number().over(Window.orderBy("trade_date")) - 1
    return sessions.withColumn("session", index.cast("bigint"))


def _median(values: str) -> Column:
    """Median of a short list without nulls; null for an empty one. Cheaper over a sliding frame than a percentile of each frame."""
    ordered, size = F.sort_array(values), F.size(values)
    low, high = F.get(ordered, F.floor((size - 1) / 2).cast("int")), F.get(ordered, F.floor(size / 2).cast("int"))
    return F.when(size % 2 == 1, low).otherwise(0.5 * low + 0.5 * high)


def point_in_time_universe(prices: DataFrame, config: UniverseConfig = UniverseConfig()) -> DataFrame:
    frame = prices.withColumn("traded_value_brl", traded_value(prices)).join(
        F.broadcast(session_calendar(prices)), "trade_date"
    )
    bars = Window.partitionBy("ticker").orderBy("session")
    seen = bars.rangeBetween(-(config.participation_window - 1), 0)
    value_window = bars.rangeBetween(-(config.adv_window - 1), 0)
    expected = F.least(F.lit(config.participation_window).cast("bigint"), F.col("session") + 1)
    frame = frame.withColumns(
        {
            "history_sessions": F.row_number().over(bars).cast("bigint"),
            "session_participation": F.count(F.lit(1)).over(seen) / expected,
            "__values": F.collect_list("traded_value_brl").over(value_window),
        }
    ).withColumn("adv_brl", _median("__values"))
    reasons = [
        F.when(F.col("history_sessions") < config.history, F.lit("insufficient_history")),
        F.when(F.col("session_participation") < config.participation, F.lit("low_session_participation")),
        F.when(F.col("adv_brl").isNull() | (F.col("adv_brl") < config.adv), F.lit("low_adv")),
    ]
    if config.price is not None:
        reasons.append(F.when(F.col("close") < config.price, F.lit("penny_stock")))
    reason = F.array_join(F.array_compact(F.array(*reasons)), ",")
    return frame.select(
        "trade_date",
        "ticker",
        F.lit(True).alias("quote_observed"),
        "history_sessions",
        "session_participation",
        "adv_brl",
        (reason == "").alias("universe_eligible"),
        F.nullif(reason, F.lit("")).alias("universe_rejection_reason"),
    )


def attach_universe(signals: DataFrame, universe: DataFrame) -> DataFrame:
    """Left join with defaults for names without a quote on the signal date."""
    stale = [c for c in universe.columns if c in signals.columns and c not in ("trade_date", "ticker")]
    joined = signals.drop(*stale).join(universe, ["trade_date", "ticker"], "left")
    return joined.withColumns(
        {
            "quote_observed": F.coalesce("quote_observed", F.lit(False)),
            "universe_eligible": F.coalesce("universe_eligible", F.lit(False)),
            "universe_rejection_reason": F.when(
                F.col("quote_observed").isNull(), F.lit("no_quote_on_signal_date")
            ).when(
                ~F.col("universe_eligible"),
                F.coalesce("universe_rejection_reason", F.lit("no_quote_on_signal_date")),
            ),
        }
    )


def investible_targets(eligible: DataFrame, group_bound: int | None = None) -> DataFrame:
    """Forward returns against the mean and order of the rows given, which are the eligible ones."""
    means = eligible.groupBy("trade_date").agg(F.avg("future_return").alias("market_forward_return"))
    frame = eligible.drop("market_forward_return", "target_excess_return", "target_cross_sectional_rank").join(
        F.broadcast(means), "trade_date", "left"
    )
    frame = frame.withColumn("target_excess_return", F.col("future_return") - F.col("market_forward_return"))
    frame = add_average_ranks(
        frame, ["trade_date"], {"__target_rank": "future_return"}, ["ticker"], group_bound, "observed"
    )
    return frame.withColumn("target_cross_sectional_rank", F.col("__target_rank") - 0.5).drop("__target_rank")


def apply_universe(
    signals: DataFrame, universe: DataFrame, eligible_only: bool = True, group_bound: int | None = None
) -> DataFrame:
    """Keep the investible names, rank them among themselves and recompute targets there."""
    joined = attach_universe(signals, universe)
    eligible = joined.filter("universe_eligible")
    again = {c: c.removeprefix("rank_") for c in eligible.columns if c.startswith("rank_")}
    again = {out: src for out, src in again.items() if src in eligible.columns}
    if again:
        eligible = add_average_ranks(
            eligible.drop(*again), ["trade_date"], again, ["ticker"], group_bound, "observed"
        )
    eligible = investible_targets(eligible, group_bound)
    if eligible_only:
        return eligible
    targets = ["market_forward_return", "target_excess_return", "target_cross_sectional_rank"]
    return joined.drop(*targets).join(
        eligible.select("trade_date", "ticker", *targets), ["trade_date", "ticker"], "left"
    )
