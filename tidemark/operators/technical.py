"""Trailing features and forward labels of the daily (or weekly) price panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import add_average_ranks
from tidemark.functions.rolling import by_bar, change, full_window, same_regime
from tidemark.functions.scalars import price_column, traded_value


@dataclass(frozen=True)
class BarWindows:
    """Window lengths in bars; the defaults are trading days."""

    short: int = 5
    month: int = 21
    quarter: int = 63
    half: int = 126
    year: int = 252
    unit: str = "d"

    @property
    def horizons(self) -> tuple[int, ...]:
        return (self.short, self.month, self.quarter, self.half, self.year)

    def name(self, stem: str, bars: int) -> str:
        return f"{stem}_{bars}{self.unit}"

    @property
    def ret(self) -> str:
        return f"ret_1{self.unit}"

    @property
    def reversal(self) -> str:
        return self.name("short_term_reversal", self.short)

    @property
    def log_value(self) -> str:
        return self.name("log_traded_value", self.month)

    @property
    def amihud(self) -> str:
        return self.name("amihud_illiquidity", self.month)

    @property
    def residual_volatility(self) -> str:
        return self.name("residual_volatility", self.quarter)

    @property
    def ranked(self) -> list[str]:
        """Features that get a cross-sectional percentile rank."""
        return [
            self.name("return", self.month),
            self.name("return", self.quarter),
            self.name("return", self.half),
            "momentum_12_1",
            self.name("volatility", self.quarter),
            self.name("distance_sma", self.quarter),
            self.name("log_volume", self.month),
            self.reversal,
            "medium_term_momentum",
            self.residual_volatility,
            self.log_value,
            self.amihud,
        ]


DAILY = BarWindows()
#: From so many tickers a session on, sessions are dealt to more parts, one for each hundredth of it.
WIDE_SESSION = 20_000


def session_mean(panel: DataFrame, value: str, out: str) -> DataFrame:
    """Cross-sectional mean joined back to the panel.

    The mean is one row per session (at most 366 a year), so it is broadcast; the panel keeps its
    partitioning by ticker and is not shuffled again.
    """
    means = panel.groupBy("trade_date").agg(F.avg(value).alias(out))
    return panel.join(F.broadcast(means), "trade_date", "left")


def trailing_features(prices: DataFrame, windows: BarWindows = DAILY) -> DataFrame:
    """Per-ticker features that look back only, plus the market return of the session."""
    w = by_bar()
    column = price_column(prices)
    px = F.col(column)
    marker = F.col("distribution_number") if "distribution_number" in prices.columns and column == "close" else None
    prices = prices.withColumn("traded_value_brl", traded_value(prices))
    value = F.col("traded_value_brl")

    def guarded(expr: Column, start: int, end: int = 0) -> Column:
        return F.when(same_regime(marker, end, start, w), expr)

    frame = prices.withColumn(windows.ret, guarded(change(px, 1, w), 1))
    ret = F.col(windows.ret)
    features: dict[str, Column] = {}
    for n in windows.horizons:
        features[windows.name("return", n)] = guarded(change(px, n, w), n)
        features[windows.name("volatility", n)] = guarded(full_window(F.stddev_samp, ret, n, w), n - 1)
    for n in (windows.month, windows.quarter, windows.year):
        features[windows.name("distance_sma", n)] = guarded(px / full_window(F.avg, px, n, w) - 1.0, n - 1)
    skipped, far = F.lag(px, windows.month).over(w), F.lag(px, windows.year).over(w)
    features["momentum_12_1"] = guarded(F.try_divide(skipped, far) - 1.0, windows.year, windows.month)
    features["log_traded_value"] = F.log1p(value)
    features["log_volume"] = F.log1p(value)
    mean_value = F.log1p(full_window(F.avg, value, windows.month, w))
    features[windows.log_value] = mean_value
    features[windows.name("log_volume", windows.month)] = mean_value
    if "trades" in prices.columns:
        features[windows.name("log_trades", windows.month)] = F.log1p(
            full_window(F.avg, F.col("trades"), windows.month, w)
        )
    impact = F.when(value.isNotNull(), F.abs(ret) / F.greatest(value, F.lit(1e-12)))
    features[windows.amihud] = full_window(F.avg, impact, windows.month, w)
    frame = frame.withColumns(features)
    frame = frame.withColumns(
        {
            windows.reversal: -F.col(windows.name("return", windows.short)),
            "medium_term_momentum": 0.5 * F.col(windows.name("return", windows.quarter))
            + 0.5 * F.col(windows.name("return", windows.half)),
        }
    )
    frame = session_mean(frame, windows.ret, f"market_return_1{windows.unit}")
    frame = frame.withColumn(
        f"market_residual_1{windows.unit}", ret - F.col(f"market_return_1{windows.unit}")
    )
    residual = F.col(f"market_residual_1{windows.unit}")
    return frame.withColumn(
        windows.residual_volatility, full_window(F.stddev_samp, residual, windows.quarter, w)
    )


def forward_labels(prices: DataFrame, horizons: Sequence[int] = (21,), lag: int = 1) -> DataFrame:
    """Returns earned after the signal: from bar t+lag to bar t+lag+horizon, with both dates.

    One output row per price row and horizon. Rows whose label is not complete keep null labels.
    """
    if lag < 1:
        raise ValueError("the label must start at least one bar after the signal")
    w = by_bar()
    column = price_column(prices)
    px, clock = F.col(column), F.col("trade_date")
    marker = F.col("distribution_number") if "distribution_number" in prices.columns and column == "close" else None
    structs = []
    for h in horizons:
        start, end = F.lead(px, lag).over(w), F.lead(px, lag + h).over(w)
        same = F.lit(True) if marker is None else F.lead(marker, lag).over(w) == F.lead(marker, lag + h).over(w)
        structs.append(
            F.struct(
                F.lit(h).alias("target_horizon_bars"),
                F.lead(clock, lag).over(w).alias("target_start_date"),
                F.lead(clock, lag + h).over(w).alias("target_end_date"),
                F.when(same, F.try_divide(end, start) - 1.0).alias("future_return"),
            )
        )
    labelled = prices.withColumn("__labels", F.array(*structs))
    return labelled.select(*prices.columns, F.inline("__labels"))


def technical_features(
    prices: DataFrame,
    windows: BarWindows = DAILY,
    horizon: int = 21,
    lag: int = 1,
    group_bound: int | None = None,
    ranks: bool = True,
) -> DataFrame:
    """The full panel: trailing features, one label, and percentile ranks per session."""
    frame = forward_labels(trailing_features(prices, windows), (horizon,), lag)
    frame = frame.withColumns(
        {
            "execution_lag_bars": F.lit(lag),
            "uses_total_return_adjusted_price": F.lit(price_column(prices) == "adjusted_close"),
        }
    )
    if not ranks:
        return frame
    if group_bound is not None and group_bound >= WIDE_SESSION:
        # The sorts of a task hold all sessions dealt to it: many parts, so that it is dealt only a few long ones.
        frame = frame.repartition(group_bound // (WIDE_SESSION // 100), "trade_date")
    return add_average_ranks(
        frame,
        ["trade_date"],
        {f"rank_{c}": c for c in windows.ranked},
        ["ticker"],
        group_bound,
        denominator="observed",
    )


def month_ends(prices: DataFrame) -> DataFrame:
    """The last market session of each month over all tickers."""
    sessions = prices.select("trade_date").distinct()
    return sessions.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.max("trade_date").alias("trade_date"))


def monthly_snapshots(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows on the common month-end only; a ticker without a quote that day has no row."""
    return panel.join(F.broadcast(calendar.select("trade_date")), "trade_date", "left_semi")


def lagged_liquidity(prices: DataFrame, bars: int = 21, minimum: int = 5) -> DataFrame:
    """Mean traded value and return deviation of the previous `bars` rows, known before the bar."""
    w = by_bar()
    frame = prices.withColumns(
        {"traded_value_brl": traded_value(prices), "__ret": change(F.col(price_column(prices)), 1, w)}
    )
    frame = frame.withColumns(
        {
            "lagged_adv": full_window(F.avg, F.col("traded_value_brl"), bars, w, minimum, skip=1),
            "lagged_sigma": full_window(F.stddev_samp, F.col("__ret"), bars, w, minimum, skip=1),
        }
    )
    return frame.drop("__ret")
