"""Returns, drawdowns, attribution and regimes of equity curves.

Curves have one row per strategy and session (or month), so windows over a strategy are bounded by
the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import compounded
from tidemark.functions.scalars import finite
from tidemark.operators.asof import asof_join

BARS_PER_YEAR = 252


def daily_returns(curve: DataFrame, value: str = "portfolio_value", by: Sequence[str] = ("strategy",), out: str = "r") -> DataFrame:
    w = Window.partitionBy(*by).orderBy("trade_date")
    return curve.withColumn(out, F.col(value) / F.lag(value).over(w) - 1.0)


def compound_by_period(returns: DataFrame, r: str = "r", by: Sequence[str] = ("strategy",), unit: str = "MM") -> DataFrame:
    """Compounded return per month or year."""
    kept = returns.filter(F.col(r).isNotNull())
    return kept.groupBy(*by, F.trunc("trade_date", unit).alias("period")).agg(compounded(F.col(r)).alias("period_return"))


def first_to_last(curve: DataFrame, value: str = "portfolio_value", by: Sequence[str] = ("strategy",), unit: str = "MM") -> DataFrame:
    """Last over first value inside the period; the first session's own return is not in it."""
    ends = F.max_by(value, "trade_date") / F.min_by(value, "trade_date") - 1.0
    return curve.groupBy(*by, F.trunc("trade_date", unit).alias("period")).agg(ends.alias("period_return"))


def annual_performance(
    curve: DataFrame, value: str = "portfolio_value", by: Sequence[str] = ("strategy",), bars: int = BARS_PER_YEAR
) -> DataFrame:
    """Per calendar year: first-to-last return, Sharpe of its sessions, worst drawdown inside it."""
    by = list(by)
    year = F.year("trade_date")
    inside = Window.partitionBy(*by, "year").orderBy("trade_date")
    rows = curve.withColumn("year", year).withColumns(
        {
            "r": F.col(value) / F.lag(value).over(inside) - 1.0,
            "dd": F.col(value) / F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1.0,
        }
    )
    std = F.stddev_samp("r")
    sharpe = F.when(std > 1e-12, F.avg("r") * bars / (std * F.sqrt(F.lit(float(bars))))).otherwise(0.0)
    return rows.groupBy(*by, "year").agg(
        (F.max_by(value, "trade_date") / F.min_by(value, "trade_date") - 1.0).alias("annual_return"),
        sharpe.alias("sharpe"),
        F.min("dd").alias("max_drawdown"),
    )


def summary_metrics(
    curve: DataFrame,
    risk_free: DataFrame | None = None,
    by: Sequence[str] = ("strategy",),
    net: str = "net_value",
    gross: str = "gross_value",
    bars: int = BARS_PER_YEAR,
) -> DataFrame:
    """Wealth, risk and risk-adjusted metrics of each curve, with gross twins."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("trade_date")
    rows = curve.withColumns(
        {
            "r": F.col(net) / F.lag(net).over(w) - 1.0,
            "g": F.col(gross) / F.lag(gross).over(w) - 1.0,
            "dd": F.col(net) / F.max(net).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1.0,
        }
    )
    if risk_free is not None:
        rows = rows.join(F.broadcast(risk_free.select("trade_date", F.col("rf"))), "trade_date", "left")
    else:
        rows = rows.withColumn("rf", F.lit(0.0))
    rows = rows.withColumn("rf", F.when(F.col("r").isNotNull(), F.coalesce("rf", F.lit(0.0))))
    root = F.sqrt(F.lit(float(bars)))

    def ratio(values):
        vol = F.stddev_samp(values) * root
        return F.when(vol > 1e-12, F.avg(values) * bars / vol).otherwise(0.0)

    totals = rows.groupBy(*by).agg(
        F.min_by(net, "trade_date").alias("start_value"),
        F.max_by(net, "trade_date").alias("end_value"),
        F.min_by(gross, "trade_date").alias("gross_start_value"),
        F.max_by(gross, "trade_date").alias("gross_end_value"),
        F.count("r").alias("sessions"),
        (F.stddev_samp("r") * root).alias("annualized_volatility"),
        (F.stddev_samp("g") * root).alias("gross_annualized_volatility"),
        ratio(F.col("r") - F.col("rf")).alias("sharpe"),
        ratio(F.col("r")).alias("raw_sharpe"),
        ratio(F.col("g") - F.col("rf")).alias("gross_sharpe"),
        ratio(F.col("g")).alias("gross_raw_sharpe"),
        F.product(1.0 + F.col("rf")).alias("risk_free_wealth"),
        F.min("dd").alias("max_drawdown"),
    )
    years = F.greatest(F.col("sessions") / F.lit(float(bars)), F.lit(1.0 / bars))
    wealth, gross_wealth = F.col("end_value") / F.col("start_value"), F.col("gross_end_value") / F.col("gross_start_value")
    return totals.withColumns(
        {
            "years": years,
            "total_return": wealth - 1.0,
            "cagr": F.pow(wealth, 1.0 / years) - 1.0,
            "gross_total_return": gross_wealth - 1.0,
            "gross_cagr": F.pow(gross_wealth, 1.0 / years) - 1.0,
            "risk_free_cagr": F.pow("risk_free_wealth", 1.0 / years) - 1.0,
            "relative_cagr": F.pow(wealth / F.col("risk_free_wealth"), 1.0 / years) - 1.0,
        }
    )


def relative_cagr(pairs: DataFrame, strategy: str, benchmark: str, by: Sequence[str] = ("strategy",), periods_per_year: int = 12) -> DataFrame:
    """Annualised ratio of the two wealth paths, from log returns, so that no long product leaves the range of numbers.

    A return that is missing, not finite or not above -100 % on either side is an error.
    """
    own, other = F.col(strategy), F.col(benchmark)
    sound = F.coalesce(finite(own) & finite(other) & (own > -1.0) & (other > -1.0), F.lit(False))
    step = F.when(sound, F.log1p(own) - F.log1p(other)).otherwise(F.raise_error(F.lit("returns must be finite and above -100 %")).cast("double"))
    return pairs.groupBy(*by).agg(F.expm1(F.avg(step) * periods_per_year).alias("relative_cagr"), F.count("*").alias("periods"))


def contribution_totals(contributions: DataFrame, by: Sequence[str]) -> DataFrame:
    return contributions.groupBy(*by).agg(
        F.sum("return_contribution").alias("total_contribution"),
        F.count("*").alias("held_sessions"),
        F.avg("weight_at_previous_close").alias("average_weight"),
    )


def attribute(contributions: DataFrame, labels: DataFrame, label: str, clock: str = "effective_from", unknown: str | None = "Unknown") -> DataFrame:
    """Attach the label in force on the contribution date; names without one get `unknown` or the ticker."""
    joined = asof_join(contributions, labels, ["ticker"], "trade_date", clock, [label])
    default = F.lit(unknown) if unknown is not None else F.col("ticker").cast("string")
    return joined.withColumn(label, F.coalesce(F.col(label).cast("string"), default))


def concentration(annual: DataFrame, by_name: DataFrame, years: int = 5, names: int = 10, by: str = "strategy", limit: float = 0.50) -> DataFrame:
    """Share of the positive log wealth and contribution that the best years and names supply."""
    wealth = annual.withColumn("w", F.log1p(F.greatest("annual_return", F.lit(-0.999999)))).filter("w > 0")
    top = Window.partitionBy(by).orderBy(F.col("w").desc(), "year")
    share_years = wealth.withColumn("n", F.row_number().over(top)).groupBy(by).agg(
        (F.sum(F.when(F.col("n") <= years, F.col("w"))) / F.sum("w")).alias("top_years_share")
    )
    positive = by_name.filter("total_contribution > 0")
    totals = positive.groupBy(by).agg(F.sum("total_contribution").alias("__all"))
    # Only the first rows of each strategy are kept before the shuffle.
    w = Window.partitionBy(by).orderBy(F.col("total_contribution").desc(), "ticker")
    best = positive.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= names).groupBy(by).agg(
        F.sum("total_contribution").alias("__best")
    )
    share_names = totals.join(best, by).select(by, (F.col("__best") / F.col("__all")).alias("top_names_share"))
    joined = share_years.join(share_names, by, "full")
    return joined.withColumns(
        {
            "years_concentrated": F.col("top_years_share") > limit,
            "names_concentrated": F.col("top_names_share") > limit,
        }
    )


def rolling_excess(pairs: DataFrame, windows: Sequence[int] = (12, 24, 36), by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Compounded strategy and benchmark return over trailing months, full windows only."""
    w = Window.partitionBy(*by).orderBy("period")
    structs = []
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        structs.append(
            F.struct(
                F.lit(n).alias("window_months"),
                F.count(F.lit(1)).over(frame).alias("months"),
                compounded(F.col("strategy_return"), frame).alias("strategy_window"),
                compounded(F.col("benchmark_return"), frame).alias("benchmark_window"),
            )
        )
    rows = pairs.withColumn("__w", F.array(*structs)).select(*by, "period", F.inline("__w"))
    return rows.filter(F.col("months") == F.col("window_months")).select(
        *by, "period", "window_months", "strategy_window", "benchmark_window",
        (F.col("strategy_window") - F.col("benchmark_window")).alias("excess_return"),
    )


def annual_alpha_beta(pairs: DataFrame, by: Sequence[str] = ("strategy",), bars: int = BARS_PER_YEAR) -> DataFrame:
    """Least squares of strategy on benchmark returns per calendar year."""
    y, x = F.col("strategy_return"), F.col("benchmark_return")
    grouped = pairs.filter(y.isNotNull() & x.isNotNull()).groupBy(*by, F.year("trade_date").alias("year"))
    rows = grouped.agg(
        F.var_samp(x).alias("v"), F.covar_samp(y, x).alias("c"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.count("*").alias("observations")
    )
    beta = F.when(F.col("v") > 1e-15, F.col("c") / F.col("v"))
    return rows.select(*by, "year", beta.alias("beta"), ((F.col("my") - beta * F.col("mx")) * bars).alias("annualized_alpha"), "observations")


def drawdown_episodes(curve: DataFrame, value: str = "portfolio_value", by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Peak, trough, recovery and length of every drawdown.

    A value equal to the running maximum starts a new peak, so each peak opens its own island.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("trade_date")
    v = F.col(value)
    peak = F.max(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumns({"__n": F.row_number().over(w), "__peak": peak})
    rows = rows.withColumn("__island", F.sum((v >= F.col("__peak")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*by, "__island").agg(
        F.min("trade_date").alias("peak_date"),
        F.min("__n").alias("__first"),
        F.max("__n").alias("__last"),
        F.min_by("trade_date", F.struct(v.alias("v"), F.col("trade_date").alias("d"))).alias("trough_date"),
        (F.min(v) / F.max(v) - 1.0).alias("max_drawdown"),
    )
    order = Window.partitionBy(*by).orderBy("__island")
    islands = islands.withColumns(
        {"recovery_date": F.lead("peak_date").over(order), "__next": F.lead("__first").over(order)}
    )
    return islands.filter("max_drawdown < 0").select(
        *by, "peak_date", "trough_date", "recovery_date", "max_drawdown",
        F.when(F.col("__next").isNotNull(), F.col("__next") - F.col("__first"))
        .otherwise(F.col("__last") - F.col("__first")).cast("bigint").alias("duration_sessions"),
        F.col("recovery_date").isNotNull().alias("recovered"),
    )


def regime_performance(months: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Mean monthly excess in regimes known before the month.

    `months`: period, strategy_return, benchmark_return, rate_return. The market regime looks at
    the twelve months before; volatility and rates compare the last three months with the median
    of all earlier three-month windows.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("period")
    three = w.rowsBetween(-3, -1)
    rows = months.withColumns(
        {
            "n": F.row_number().over(w),
            "trend": compounded(F.col("benchmark_return"), w.rowsBetween(-12, -1)),
            "vol": F.stddev_samp("benchmark_return").over(three),
            "rate": F.avg("rate_return").over(three),
        }
    )
    # Three-month windows are complete from the fourth month on.
    rows = rows.withColumns(
        {"full_vol": F.when(F.col("n") > 3, F.col("vol")), "full_rate": F.when(F.col("n") > 3, F.col("rate"))}
    )
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "vol_median": F.percentile("full_vol", F.lit(0.5)).over(prior),
            "rate_median": F.percentile("full_rate", F.lit(0.5)).over(prior),
        }
    ).filter("n > 12")
    over_market = F.col("strategy_return") - F.col("benchmark_return")
    over_rate = F.col("strategy_return") - F.col("rate_return")
    cells = F.array(
        F.struct(F.lit("market").alias("regime_type"), F.when(F.col("trend") >= 0, "bull").otherwise("bear").alias("regime"), over_market.alias("excess")),
        F.struct(F.lit("volatility").alias("regime_type"), F.when(F.col("vol") >= F.col("vol_median"), "high_vol").otherwise("low_vol").alias("regime"), over_market.alias("excess")),
        F.struct(F.lit("rates").alias("regime_type"), F.when(F.col("rate") >= F.col("rate_median"), "high_rate").otherwise("low_rate").alias("regime"), over_rate.alias("excess")),
    )
    return rows.select(*by, F.inline(cells)).groupBy(*by, "regime_type", "regime").agg(
        F.count("*").alias("months"),
        F.avg("excess").alias("mean_monthly_excess"),
        F.avg((F.col("excess") > 0).cast("double")).alias("excess_hit_rate"),
    )
