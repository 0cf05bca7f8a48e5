"""Corporate actions: total-return adjustment and marks of names that stop quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import null_safe_join
from tidemark.functions.scalars import share_multiplier
from tidemark.operators.quality import require_empty

STOCK_KINDS = ["stock_split", "reverse_split", "bonus_shares"]
CASH_KINDS = ["cash_dividend", "jcp"]


def action_timeline(prices: DataFrame, actions: DataFrame, by: str = "ticker") -> DataFrame:
    """Bars and actions of each entity on one clock, with the price multiplier of each action.

    One shuffle by entity serves the as-of lookup of the cum-event close, the first and last bar,
    and (see `adjustment_factors`) the backward product.
    """
    bars = prices.select(F.col(by), F.col("trade_date").alias("clock"), F.col("close"), F.lit(True).alias("is_bar"))
    events = actions.filter(F.col("last_date_prior").isNotNull()).select(
        by, F.col("last_date_prior").alias("clock"), "action_type", "cash_amount", "share_factor", F.lit(False).alias("is_bar")
    )
    line = bars.unionByName(events, allowMissingColumns=True)
    forward = Window.partitionBy(by).orderBy(F.col("clock"), F.col("is_bar").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    line = line.withColumns(
        {
            "cum_close": F.last("close", ignorenulls=True).over(forward),
            "first_bar": F.min(F.when(F.col("is_bar"), F.col("clock"))).over(whole),
            "last_bar": F.max(F.when(F.col("is_bar"), F.col("clock"))).over(whole),
        }
    )
    has_before = F.col("first_bar") <= F.col("clock")
    stock = F.col("action_type").isin(STOCK_KINDS) & (F.col("share_factor") > 0) & has_before & (F.col("last_bar") > F.col("clock"))
    cash = F.col("action_type").isin(CASH_KINDS) & (F.col("cash_amount") > 0) & F.col("cum_close").isNotNull()
    return line.withColumns(
        {
            "split_multiplier": F.when(stock, share_multiplier(F.col("action_type"), F.col("share_factor"))),
            "cash_multiplier": F.when(cash, (F.col("cum_close") - F.col("cash_amount")) / F.col("cum_close")),
        }
    )


def impossible_yields(timeline: DataFrame, by: str = "ticker") -> DataFrame:
    """Cash events at least as large as the price they come off."""
    return timeline.filter("NOT is_bar AND cash_multiplier <= 0").select(by, "clock", "cash_amount", "cum_close")


def adjustment_factors(timeline: DataFrame, by: str = "ticker") -> DataFrame:
    """Per bar, the product of the multipliers of all actions dated on or after it."""
    backward = (
        Window.partitionBy(by).orderBy(F.col("clock").desc(), F.col("is_bar")).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        timeline.withColumns(
            {
                "split_adjustment_factor": F.coalesce(F.product("split_multiplier").over(backward), F.lit(1.0)),
                "cash_adjustment_factor": F.coalesce(F.product("cash_multiplier").over(backward), F.lit(1.0)),
            }
        )
        .filter("is_bar")
        .select(by, F.col("clock").alias("trade_date"), "split_adjustment_factor", "cash_adjustment_factor", F.col("close").alias("__close"))
    )


def adjust_prices(prices: DataFrame, actions: DataFrame, by: str = "ticker", check: bool = True) -> DataFrame:
    """Prices with a total-return close; raw closes stay as they are.

    `check` runs the fail-closed test for impossible cash yields, which is one extra pass.
    """
    timeline = action_timeline(prices, actions, by)
    if check:
        require_empty(impossible_yields(timeline, by), "cash action not below the cum-event close")
    factors = adjustment_factors(timeline, by).drop("__close")
    joined = null_safe_join(prices, factors, [by, "trade_date"])
    return joined.withColumn(
        "adjusted_close", F.col("close") * F.col("split_adjustment_factor") * F.col("cash_adjustment_factor")
    )


def stale_marks(
    prices: DataFrame,
    calendar: DataFrame,
    max_stale: int = 20,
    column: str = "close",
    haircut: float = -0.999,
    action_marker: str | None = None,
    max_abs_return: float | None = None,
) -> DataFrame:
    """Valuation of every name on every session from its first bar to the end of the calendar.

    Missing quotes carry the last price. A name silent for `max_stale` + 1 sessions takes the
    haircut once. A session on which `action_marker` changes earns zero (with `max_abs_return`,
    only where the move is larger than that) and is flagged; other larger moves are flagged too.
    """
    end = calendar.agg(F.max("session")).scalar()
    bars = prices.join(F.broadcast(calendar.select("trade_date", "session")), "trade_date")
    spans = bars.groupBy("ticker").agg(F.min("session").alias("__start")).withColumn("__end", end)
    grid = spans.select("ticker", F.explode(F.sequence("__start", "__end")).alias("session"))
    carry = [column] + ([action_marker] if action_marker else [])
    quotes = bars.select("ticker", "session", *carry, F.col("session").alias("__seen"))
    w = Window.partitionBy("ticker").orderBy("session")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    marks = grid.join(quotes, ["ticker", "session"], "left").withColumns(
        {
            "quote_observed": F.col("__seen").isNotNull(),
            "mark": F.last(column, ignorenulls=True).over(past),
            "stale_sessions": F.col("session") - F.last("__seen", ignorenulls=True).over(past),
            **({"__marker": F.last(action_marker, ignorenulls=True).over(past)} if action_marker else {}),
        }
    )
    previous = F.lag("mark").over(w)
    raw = F.col("mark") / previous - 1.0
    moved = (F.lag("__marker").over(w) != F.col("__marker")) if action_marker else F.lit(False)
    large = (F.abs(raw) > max_abs_return) if max_abs_return is not None else F.lit(False)
    excluded = moved & (large if (action_marker and max_abs_return is not None and column != "close") else F.lit(True))
    both = F.col("quote_observed") & F.lag("quote_observed").over(w)
    marked = marks.withColumns(
        {
            "action_excluded": F.coalesce(excluded, F.lit(False)),
            "suspicious": F.coalesce(both & large & ~F.coalesce(excluded, F.lit(False)), F.lit(False)),
            "asset_return": F.when(F.col("stale_sessions") == max_stale + 1, haircut)
            .when(F.coalesce(excluded, F.lit(False)), 0.0)
            .otherwise(raw),
        }
    )
    dates = F.broadcast(calendar.select("session", "trade_date"))
    return marked.join(dates, "session").select(
        "ticker", "trade_date", "session", "mark", "quote_observed", "stale_sessions", "asset_return", "action_excluded", "suspicious"
    )
