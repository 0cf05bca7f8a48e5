"""Portfolio accounting as tables: periods, holdings, turnover, costs and equity curves.

Every position is reset at each execution, so the recursion of a simulator factorises: inside a
period a position grows by the product of its returns, and capital is the product of period
growth and cost factors. Strategies and cost scenarios are columns, so all of them run in one job.
Holdings are at most k names per strategy and date, whatever the size of the market.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite
from tidemark.operators.quality import require_empty

INITIAL_CAPITAL = 100_000.0
BPS = 10_000.0
# One-way half-spreads in basis points by traded-value tier, and impact settings.
TIER_LIMITS = (1_000_000.0, 10_000_000.0)
TIER_HALF_SPREAD_BPS = (30.0, 15.0, 8.0)
IMPACT_BPS = 10.0
VOLATILITY_IMPACT = 0.5
CASH = "cash"


def execution_dates(signals: DataFrame, calendar: DataFrame, delay: int = 1, how: str = "inner") -> DataFrame:
    """Add the session `delay` bars after the signal; `calendar` holds one row per session."""
    later = calendar.select((F.col("session") - delay).alias("__s"), F.col("trade_date").alias("execution_date"))
    pairs = calendar.select("trade_date", "session").join(later, F.col("session") == F.col("__s")).select(
        "trade_date", "execution_date"
    )
    return signals.join(F.broadcast(pairs), "trade_date", how)


def common_dates(rows: DataFrame, by: str = "strategy", clock: str = "trade_date") -> DataFrame:
    """Dates on which every strategy has a row."""
    observed = rows.select(by, clock).distinct()
    strategies = observed.agg(F.count_distinct(by)).scalar()
    return observed.groupBy(clock).agg(F.count("*").alias("__n")).filter(F.col("__n") == strategies).select(clock)


def rebalance_periods(targets: DataFrame, calendar: DataFrame, delay: int = 1) -> DataFrame:
    """Per strategy, the spans between executions in session numbers.

    Period 0 runs from the first signal to the first execution and holds only cash.
    """
    dates = targets.select("strategy", "trade_date").distinct()
    numbered = dates.join(F.broadcast(calendar), "trade_date")
    last = calendar.agg(F.max("session")).scalar()
    executed = numbered.withColumn("start", F.col("session") + delay).filter(F.col("start") <= last)
    w = Window.partitionBy("strategy").orderBy("start")
    held = executed.select(
        "strategy",
        "trade_date",
        F.row_number().over(w).cast("bigint").alias("period"),
        "start",
        F.coalesce(F.lead("start").over(w), last).alias("end"),
    )
    opening = executed.groupBy("strategy").agg(
        F.min("trade_date").alias("trade_date"), F.min("session").alias("s0"), F.min("start").alias("end")
    )
    opening = opening.select("strategy", "trade_date", F.lit(0).cast("bigint").alias("period"), F.col("s0").alias("start"), "end")
    return opening.unionByName(held)


def aligned_risk_free(calendar: DataFrame, series: DataFrame, check: bool = True) -> DataFrame:
    """One return per session; a missing or impossible value fails closed."""
    rates = series.groupBy("trade_date").agg(F.max("daily_return").alias("rf"), F.count("*").alias("__copies"))
    joined = calendar.join(rates, "trade_date", "left")
    if check:
        bad = joined.filter((F.col("session") > 0) & (~finite(F.col("rf")) | (F.col("rf") <= -1.0) | (F.col("__copies") > 1)))
        require_empty(bad.select("trade_date", "rf"), "risk-free series must have one finite return above -1 per session")
    return joined.select("trade_date", "session", "rf")


def position_growth(targets: DataFrame, periods: DataFrame, returns: DataFrame) -> DataFrame:
    """Growth of each position on each session of its period, from its execution close.

    `targets`: strategy, trade_date, ticker, target_weight. `returns`: ticker, session,
    asset_return on every session a name is held. A session without a return counts as flat.
    """
    held = targets.join(periods.filter("period > 0"), ["strategy", "trade_date"]).filter(F.col("end") > F.col("start"))
    days = held.select(
        "strategy", "period", "ticker", "target_weight", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("session")
    )
    joined = days.join(returns, ["ticker", "session"], "left").withColumn("asset_return", F.coalesce("asset_return", F.lit(0.0)))
    w = Window.partitionBy("strategy", "period", "ticker").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("growth", F.product(1.0 + F.col("asset_return")).over(w))


def cash_growth(targets: DataFrame, periods: DataFrame, risk_free: DataFrame) -> DataFrame:
    """The cash position of every period on the same footing as a name."""
    invested = targets.groupBy("strategy", "trade_date").agg(F.sum("target_weight").alias("__w"))
    # A residue of rounding is not a position.
    left = 1.0 - F.coalesce("__w", F.lit(0.0))
    spans = periods.join(invested, ["strategy", "trade_date"], "left").withColumn(
        "target_weight", F.when(F.col("period") == 0, 1.0).when(left < 1e-12, 0.0).otherwise(left)
    )
    days = spans.filter(F.col("end") > F.col("start")).select(
        "strategy", "period", "target_weight", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("session")
    )
    joined = days.join(F.broadcast(risk_free.select("session", F.coalesce("rf", F.lit(0.0)).alias("asset_return"))), "session")
    w = Window.partitionBy("strategy", "period").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("growth", F.product(1.0 + F.col("asset_return")).over(w)).withColumn("ticker", F.lit(CASH))


def holding_values(targets: DataFrame, periods: DataFrame, returns: DataFrame, risk_free: DataFrame) -> DataFrame:
    """Names and cash on every session: weight at the start, growth so far, return of the session."""
    columns = ["strategy", "period", "session", "ticker", "target_weight", "asset_return", "growth"]
    names = position_growth(targets, periods, returns).withColumn("ticker", F.col("ticker").cast("string"))
    return names.select(columns).unionByName(cash_growth(targets, periods, risk_free).select(columns))


def period_values(holdings: DataFrame) -> DataFrame:
    """Growth of one unit of capital inside each period, per session."""
    value = F.sum(F.col("target_weight") * F.col("growth"))
    return holdings.groupBy("strategy", "period", "session").agg(value.alias("value"))


def drifted_weights(holdings: DataFrame, periods: DataFrame, values: DataFrame) -> DataFrame:
    """Weights at the end of each period, just before the next execution."""
    ends = periods.select("strategy", "period", F.col("end").alias("session"))
    closing = holdings.join(ends, ["strategy", "period", "session"]).join(values, ["strategy", "period", "session"])
    return closing.select(
        "strategy", "period", "ticker", (F.col("target_weight") * F.col("growth") / F.col("value")).alias("drifted_weight")
    )


def order_book(targets: DataFrame, periods: DataFrame, drifted: DataFrame) -> DataFrame:
    """Per execution and name: weight held before, weight wanted, including cash."""
    held = periods.filter("period > 0")
    wanted = targets.join(held, ["strategy", "trade_date"]).select(
        "strategy", "period", F.col("ticker").cast("string").alias("ticker"), F.col("target_weight").alias("wanted"), F.lit(0.0).alias("held")
    )
    invested = wanted.groupBy("strategy", "period").agg(F.sum("wanted").alias("__w"))
    residual = 1.0 - F.coalesce("__w", F.lit(0.0))
    cash = held.select("strategy", "period").join(invested, ["strategy", "period"], "left").select(
        "strategy", "period", F.lit(CASH).alias("ticker"), F.when(residual < 1e-12, 0.0).otherwise(residual).alias("wanted"), F.lit(0.0).alias("held")
    )
    # A period of zero length (a signal on the last session) ends where it starts, fully in its target.
    before = drifted.select(
        "strategy", (F.col("period") + 1).alias("period"), "ticker", F.lit(0.0).alias("wanted"), F.col("drifted_weight").alias("held")
    ).join(held.select("strategy", "period"), ["strategy", "period"], "left_semi")
    return wanted.unionByName(cash).unionByName(before).groupBy("strategy", "period", "ticker").agg(
        F.sum("held").alias("held"), F.sum("wanted").alias("wanted")
    )


def half_l1_turnover(orders: DataFrame, held: str = "held", wanted: str = "wanted", by: Sequence[str] = ("strategy", "period")) -> DataFrame:
    return orders.groupBy(*by).agg((0.5 * F.sum(F.abs(F.col(wanted) - F.col(held)))).alias("turnover"))


def equity_curves(
    periods: DataFrame, values: DataFrame, turnover: DataFrame, bps: Sequence[float], calendar: DataFrame, initial: float = INITIAL_CAPITAL
) -> DataFrame:
    """Net and gross capital on every session for each flat cost per unit of turnover.

    The cost of an execution is paid at its close. The scenario list is a short constant array.
    """
    closing = periods.join(
        values.withColumnRenamed("session", "end").withColumnRenamed("value", "closing"), ["strategy", "period", "end"], "left"
    )
    costed = closing.join(turnover, ["strategy", "period"], "left").withColumn(
        "bps", F.explode(F.array(*[F.lit(float(b)) for b in bps]))
    )
    costed = costed.withColumn("cost", F.coalesce("turnover", F.lit(0.0)) * F.col("bps") / BPS)
    w = Window.partitionBy("strategy", "bps").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    growth = F.coalesce("closing", F.lit(1.0))
    chained = costed.withColumns(
        {
            "gross_open": initial * F.coalesce(F.product(growth).over(w), F.lit(1.0)),
            "net_open": initial
            * F.coalesce(F.product(growth * (1.0 - F.col("cost"))).over(w), F.lit(1.0))
            * (1.0 - F.col("cost")),
        }
    ).select("strategy", "bps", "period", "start", "end", "net_open", "gross_open")
    # The opening capital of period 0, then each session after the start of its period.
    opening = chained.filter("period = 0").select(
        "strategy", "bps", "period", F.col("start").alias("session"), F.col("net_open").alias("net_value"), F.col("gross_open").alias("gross_value")
    )
    inside = chained.join(values, ["strategy", "period"]).select(
        "strategy", "bps", "period", "session", (F.col("net_open") * F.col("value")).alias("net_value"), (F.col("gross_open") * F.col("value")).alias("gross_value")
    )
    # On an execution session the value after costs stands.
    at_execution = chained.filter("period > 0").select(
        "strategy", "bps", F.col("start").alias("session"), F.col("net_open").alias("__net")
    )
    curve = opening.unionByName(inside).join(at_execution, ["strategy", "bps", "session"], "left")
    curve = curve.withColumn("net_value", F.coalesce("__net", "net_value")).drop("__net")
    return curve.join(F.broadcast(calendar), "session")


def daily_contributions(holdings: DataFrame, values: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weight at the previous close times the return of the session, per name."""
    w = Window.partitionBy("strategy", "period", "ticker").orderBy("session")
    before = F.coalesce(F.lag(F.col("target_weight") * F.col("growth")).over(w), F.col("target_weight"))
    wv = Window.partitionBy("strategy", "period").orderBy("session")
    previous = values.withColumn("__before", F.coalesce(F.lag("value").over(wv), F.lit(1.0))).drop("value")
    rows = holdings.withColumn("__held", before).join(previous, ["strategy", "period", "session"])
    weight = F.col("__held") / F.col("__before")
    return rows.filter(F.col("ticker") != CASH).join(F.broadcast(calendar), "session").select(
        "strategy", "trade_date", "ticker", weight.alias("weight_at_previous_close"), "asset_return",
        (weight * F.col("asset_return")).alias("return_contribution"),
    )


def tier_half_spread_bps(adv: Column) -> Column:
    low, mid, high = TIER_HALF_SPREAD_BPS
    return F.when(adv <= TIER_LIMITS[0], low).when(adv <= TIER_LIMITS[1], mid).otherwise(high)


def liquidity_fills(
    orders: DataFrame,
    capitals: Sequence[float],
    caps: Sequence[float],
    fee_bps: float = 0.0,
    impact: str = "sqrt_participation",
    quoted: str | None = None,
) -> DataFrame:
    """Executed weight and cost parts of every order under each capital and participation cap.

    `orders`: strategy, period, ticker, held, wanted, adv, sigma (names only). Capital is a
    constant of the scenario, so the prior weight is the drifted target. Orders without a known
    positive adv cannot trade. An execution has at most the names of two selections.
    """
    cells = F.array(*[F.struct(F.lit(float(c)).alias("capital"), F.lit(float(p)).alias("cap")) for c in capitals for p in caps])
    rows = orders.select("*", F.inline(cells))
    liquid = F.col("adv").isNotNull() & (F.col("adv") > 0)
    delta = F.col("wanted") - F.col("held")
    most = F.when(liquid, F.col("cap") * F.col("adv") / F.col("capital")).otherwise(0.0)
    rows = rows.withColumn("step", F.signum(delta) * F.least(F.abs(delta), most))
    rows = rows.withColumn("filled", F.greatest(F.col("held") + F.col("step"), F.lit(0.0)))
    book = Window.partitionBy("strategy", "period", "capital", "cap")
    excess = F.greatest(F.sum("filled").over(book) - 1.0, F.lit(0.0))
    buys = F.sum(F.greatest("step", F.lit(0.0))).over(book)
    cut = F.least(F.lit(1.0), F.coalesce(F.try_divide(excess, buys), F.lit(0.0)))
    rows = rows.withColumn("filled", F.col("filled") - F.greatest("step", F.lit(0.0)) * cut)
    traded = F.abs(F.col("filled") - F.col("held"))
    participation = F.when(liquid, traded * F.col("capital") / F.col("adv"))
    half = tier_half_spread_bps(F.col("adv"))
    if quoted is not None:
        half = F.coalesce(F.col(quoted) / 2.0, half)
    root = F.sqrt(F.coalesce(participation, F.lit(0.0)))
    rate = VOLATILITY_IMPACT * F.coalesce("sigma", F.lit(0.0)) * root if impact == "volatility_scaled" else IMPACT_BPS / BPS * root
    return rows.withColumns(
        {
            "traded": traded,
            "participation": participation,
            "fees": traded * fee_bps / BPS,
            "spread": traded * F.coalesce(half, F.lit(TIER_HALF_SPREAD_BPS[2])) / BPS,
            "impact": traded * rate,
        }
    ).drop("step")


def cost_components(fills: DataFrame, by: Sequence[str] = ("strategy", "capital", "cap")) -> DataFrame:
    """Sums of cost fraction and amount by component."""
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("fraction")) for c in ("fees", "spread", "impact")])
    long = fills.select(*by, F.col("capital").alias("__capital"), F.inline(parts))
    return long.groupBy(*by, "component").agg(
        F.sum("fraction").alias("cost_fraction"), F.sum(F.col("fraction") * F.col("__capital")).alias("cost_amount")
    )


def rejected_orders(fills: DataFrame, blocked_exits: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """All orders that were not carried out as asked, with the reason."""
    partial = fills.filter(F.abs(F.col("filled") - F.col("wanted")) > 1e-12).select(
        "strategy", "period", "ticker", F.lit("participation_cap_partial_fill").alias("reason")
    ).distinct()
    out = partial
    for extra, reason in ((blocked_exits, "no_observed_quote_for_exit"), (skipped, None)):
        if extra is not None:
            label = F.lit(reason) if reason else F.col("reason")
            out = out.unionByName(extra.select("strategy", "period", "ticker", label.alias("reason")))
    return out


def strategy_cost_table(values: DataFrame, turnover: DataFrame, fills: DataFrame) -> DataFrame:
    """One row per strategy and scenario: gross and net growth, costs over capital, turnover, fill ratio and rejections.

    `values` are those of `period_values`. Gross growth is the product of all periods; the costs of
    an execution are paid from the wealth it finds, as in `equity_curves`, and costs that reach
    all of it leave nothing. Growth is also given in logs (null when nothing is left).
    """
    scenario = ["strategy", "capital", "cap"]
    asked = F.abs(F.col("wanted") - F.col("held"))
    short = F.abs(F.col("filled") - F.col("wanted"))
    executions = fills.groupBy(*scenario, "period").agg(
        F.sum("fees").alias("fees"),
        F.sum("spread").alias("spread"),
        F.sum("impact").alias("impact"),
        F.sum("traded").alias("traded"),
        F.sum(asked).alias("asked"),
        F.sum(short).alias("short"),
        F.count(F.when(short > 1e-12, 1)).alias("rejected"),
    )
    paid = F.col("fees") + F.col("spread") + F.col("impact")
    costs = executions.groupBy(*scenario).agg(
        F.sum("fees").alias("fees"),
        F.sum("spread").alias("spread"),
        F.sum("impact").alias("impact"),
        F.try_divide(F.sum("traded"), F.sum("asked")).alias("fill_ratio"),
        F.sum("rejected").alias("rejected_orders"),
        (F.sum("short") * F.col("capital")).alias("rejected_notional"),
        F.when(F.max(paid) < 1, F.sum(F.when(paid < 1, F.log1p(-paid)))).alias("__kept"),
    )
    ends = values.groupBy("strategy", "period").agg(F.max_by("value", "session").alias("value"))
    gross = ends.groupBy("strategy").agg(F.sum(F.log("value")).alias("log_gross"))
    churn = turnover.groupBy("strategy").agg(F.sum("turnover").alias("turnover"), F.count("*").alias("rebalances"))
    rows = costs.join(churn, "strategy").join(gross, "strategy").withColumn("log_net", F.col("log_gross") + F.col("__kept")).drop("__kept")
    return rows.withColumns({"gross": F.expm1("log_gross"), "net": F.coalesce(F.expm1("log_net"), F.lit(-1.0))})


def run_records(periods: DataFrame, capitals: Sequence[float], caps: Sequence[float], delay: int = 1, fill_policy: str = "partial_to_cap") -> DataFrame:
    """What each strategy was run on under each scenario, for `statistics.fairness_failures`. `periods` are those of `rebalance_periods`."""
    held = periods.filter("period > 0")
    runs = held.groupBy("strategy").agg(
        F.min("start").alias("evaluation_start"),
        F.max("end").alias("evaluation_end"),
        F.array_join(F.sort_array(F.collect_set("start")), ",").alias("rebalance_dates"),
        F.count("*").alias("rebalance_periods"),
    )
    cells = [
        F.struct(F.lit(f"{c:g}/{p:g}").alias("cost_scenario"), F.lit(float(c)).alias("initial_capital"), F.lit(float(p)).alias("participation_cap"))
        for c in capitals for p in caps
    ]
    return runs.select("*", F.inline(F.array(*cells)), F.lit(delay).alias("execution_delay_bars"), F.lit(fill_policy).alias("fill_policy"))


def benchmark_curve(calendar: DataFrame, returns: DataFrame, column: str = "daily_return", initial: float = 1.0) -> DataFrame:
    """Price path of a return series, one row per session; a missing return is flagged, not filled."""
    joined = calendar.join(returns.select("trade_date", F.col(column).alias("__r")), "trade_date", "left")
    w = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("price", initial * F.product(1.0 + F.coalesce("__r", F.lit(0.0))).over(w)).select(
        "trade_date", "session", "price", F.col("__r").isNotNull().alias("observed")
    )


def held_then_best(names: list, kept: set, k: int, buffer: int) -> list:
    """The k names of a date, given its ranking and the names held: held ones within k + buffer first, then by rank."""
    if k <= 0:
        return []
    stay = [n for n in names[: k + max(buffer, 0)] if n in kept]
    return (stay + [n for n in names if n not in set(stay)])[:k]


def hysteresis_selection(ranked: DataFrame, k: int, buffer: int) -> DataFrame:
    """Keep a held name while its rank is within k + buffer, then fill by rank.

    `ranked` holds at most k + buffer names per strategy and date (rank ascending). The choice of a
    date depends on the date before, so the dates of a strategy are folded in order: its row is one
    list of short rankings, k + buffer names a date whatever the size of the market.
    """
    ticker = dict(ranked.dtypes)["ticker"]
    listed = F.sort_array(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), "ticker")))
    days = ranked.groupBy("strategy", "trade_date").agg(listed.alias("listed"))
    history = days.groupBy("strategy").agg(F.sort_array(F.collect_list(F.struct("trade_date", "listed"))).alias("days"))
    nothing = F.array().cast(f"array<{ticker}>")
    start = F.struct(
        nothing.alias("held"),
        F.array().cast(f"array<struct<trade_date:date,names:array<{ticker}>,listed:array<struct<rank:bigint,ticker:{ticker}>>>>").alias("out"),
    )

    def step(state: Column, day: Column) -> Column:
        names = day["listed"]["ticker"]
        stay = F.filter(F.slice(names, 1, max(k, 0) + max(buffer, 0)), lambda n: F.array_contains(state["held"], n))
        rest = F.filter(names, lambda n: ~F.array_contains(stay, n))
        chosen = F.slice(F.concat(stay, rest), 1, max(k, 0))
        picked = F.struct(day["trade_date"].alias("trade_date"), chosen.alias("names"), day["listed"].alias("listed"))
        return F.struct(chosen.alias("held"), F.concat(state["out"], F.array(picked)).alias("out"))

    walked = history.select("strategy", F.explode(F.aggregate("days", start, step, lambda state: state["out"])).alias("day"))
    rows = walked.select("strategy", "day.trade_date", "day.names", F.explode("day.listed").alias("row"))
    return rows.filter(F.array_contains("names", F.col("row.ticker"))).select(
        "strategy", "trade_date", "row.ticker", "row.rank", (1.0 / F.size("names")).alias("target_weight")
    )
