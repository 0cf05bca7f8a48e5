"""Market-wide state per session, attached to the panel.

All of these tables hold one row per session, so their ordering windows and broadcasts are bounded
by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_series
from tidemark.operators.technical import DAILY, BarWindows


def market_regime(panel: DataFrame, windows: BarWindows = DAILY) -> DataFrame:
    ret = F.col(windows.ret)
    month, quarter = windows.name("return", windows.month), windows.name("return", windows.quarter)
    days = panel.groupBy("trade_date").agg(
        F.avg(ret).alias("regime_market_return"),
        F.avg(month).alias("regime_market_return_month"),
        F.avg(quarter).alias("regime_market_return_quarter"),
        F.avg((ret > 0).cast("double")).alias("regime_breadth"),
        F.stddev_samp(ret).alias("regime_dispersion"),
    )
    w = Window.orderBy("trade_date")
    frame = w.rowsBetween(-(windows.month - 1), 0)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("regime_market_return")
    days = days.withColumns(
        {
            "regime_realized_vol": F.when(F.count(r).over(frame) == windows.month, F.stddev_samp(r).over(frame)),
            "__index": F.when(r.isNotNull(), F.product(1.0 + r).over(past)),
        }
    )
    return days.withColumn("regime_drawdown", F.col("__index") / F.max("__index").over(past) - 1.0).drop("__index")


def attach_rate(regime: DataFrame, series: DataFrame, lag_days: int = 1) -> DataFrame:
    """A policy rate as known on each session, and its change from the session before."""
    if lag_days < 1:
        raise ValueError("a rate is known one calendar day after its own date at the earliest")
    joined = asof_series(regime, series, "trade_date", "date", "value", lag_days, "regime_rate")
    step = F.col("regime_rate") - F.lag("regime_rate").over(Window.orderBy("trade_date"))
    return joined.withColumn("regime_rate_change", F.coalesce(step, F.lit(0.0)))


def attach_regime(panel: DataFrame, regime: DataFrame, windows: BarWindows = DAILY) -> DataFrame:
    """Session-level columns on every panel row plus two interactions with market volatility."""
    joined = panel.join(F.broadcast(regime), "trade_date", "left")
    vol = F.col("regime_realized_vol")
    return joined.withColumns(
        {
            "regime_momentum_x_vol": F.col("momentum_12_1") * vol,
            "regime_volatility_x_vol": F.col(windows.name("volatility", windows.quarter)) * vol,
        }
    )
