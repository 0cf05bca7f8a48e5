"""Queries over holdings, costs, curves and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import quoted_spread_bps, rounded
from tidemark.operators import book, performance, quality, selection, technical
from tidemark.plans import market_sql as S
from tidemark.plans.filings_queries import _MACRO
from tidemark.plans.market import WEEKLY, Market
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import FORECAST_SQL
from tidemark.session import cut_lineage

r = S.r
D = S._D
# Scenarios of capital and participation cap.
CAPITALS, CAPS = (1e5, 1e6, 1e7), (0.01, 0.02, 0.05)

_SCORES = {
    "momentum": "rank_momentum_12_1",
    "low_volatility": "1.0 - rank_volatility_12w",
    "ml": "prediction - 0.5 * uncertainty",
    "liquidity": "rank_log_traded_value_4w",
}
TARGETS = [
    *FORECAST_SQL,
    """tradable AS (SELECT f.*, s.session FROM forecasts f JOIN sessions s ON s.trade_date = f.trade_date JOIN sessions n ON n.session = s.session + 1
        WHERE EXISTS (SELECT 1 FROM prices p WHERE p.ticker = f.ticker AND p.trade_date = n.trade_date))""",
    "bids AS (" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, trade_date, session, ticker, issuer_id, {v} AS score FROM tradable WHERE {v} IS NOT NULL" for k, v in _SCORES.items()) + ")",
    "single AS (SELECT *, row_number() OVER (PARTITION BY strategy, trade_date, issuer_id ORDER BY score DESC, ticker) AS cls FROM bids)",
    "topn AS (SELECT *, row_number() OVER (PARTITION BY strategy, trade_date ORDER BY score DESC, ticker) AS rank FROM single WHERE cls = 1)",
    "targets AS (SELECT strategy, trade_date, session, ticker, issuer_id, rank, 1.0 / count(*) OVER (PARTITION BY strategy, trade_date) AS target_weight FROM topn WHERE rank <= 10)",
]
BOOK = [
    *TARGETS,
    S.RISK_FREE,
    "lastone AS (SELECT max(session) AS last FROM sessions)",
    "execd AS (SELECT DISTINCT strategy, trade_date, session + 1 AS start_s FROM targets)",
    """heldp AS (SELECT strategy, trade_date, row_number() OVER (PARTITION BY strategy ORDER BY start_s) AS period, start_s,
        coalesce(lead(start_s) OVER (PARTITION BY strategy ORDER BY start_s), (SELECT last FROM lastone)) AS end_s FROM execd)""",
    "openp AS (SELECT strategy, 0 AS period, min(start_s) - 1 AS start_s, min(start_s) AS end_s FROM heldp GROUP BY 1)",
    "allp AS (SELECT strategy, period, start_s, end_s FROM heldp UNION ALL SELECT * FROM openp)",
    "heldtickers AS (SELECT DISTINCT ticker FROM targets)",
    "grid AS (SELECT t.ticker, s.session FROM (SELECT ticker, min(session) AS f FROM prices JOIN sessions USING (trade_date) WHERE ticker IN (SELECT ticker FROM heldtickers) GROUP BY 1) t JOIN sessions s ON s.session >= t.f)",
    """filled AS (SELECT g.*, p.close IS NOT NULL AS quoted, last_value(p.close IGNORE NULLS) OVER w AS mark,
        g.session - last_value(CASE WHEN p.close IS NOT NULL THEN g.session END IGNORE NULLS) OVER w AS stale
        FROM grid g LEFT JOIN (SELECT ticker, session, close FROM prices JOIN sessions USING (trade_date)) p ON p.ticker = g.ticker AND p.session = g.session
        WINDOW w AS (PARTITION BY g.ticker ORDER BY g.session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "marks AS (SELECT ticker, session, quoted, CASE WHEN stale = 21 THEN -0.999 ELSE mark / lag(mark) OVER (PARTITION BY ticker ORDER BY session) - 1.0 END AS ret FROM filled)",
    """names AS (SELECT h.strategy, h.period, CAST(t.ticker AS VARCHAR) AS ticker, t.target_weight, s.session, coalesce(m.ret, 0.0) AS ret
        FROM targets t JOIN heldp h ON h.strategy = t.strategy AND h.trade_date = t.trade_date JOIN sessions s ON s.session > h.start_s AND s.session <= h.end_s
        LEFT JOIN marks m ON m.ticker = t.ticker AND m.session = s.session)""",
    """cashw AS (SELECT a.strategy, a.period, a.start_s, a.end_s, CASE WHEN a.period = 0 THEN 1.0 WHEN 1.0 - coalesce(w, 0.0) < 1e-12 THEN 0.0 ELSE 1.0 - coalesce(w, 0.0) END AS target_weight
        FROM allp a LEFT JOIN (SELECT h.strategy, h.period, sum(target_weight) AS w FROM targets t JOIN heldp h ON h.strategy = t.strategy AND h.trade_date = t.trade_date GROUP BY 1, 2) x
        ON x.strategy = a.strategy AND x.period = a.period)""",
    """everything AS (SELECT strategy, period, ticker, target_weight, session, ret FROM names UNION ALL
        SELECT c.strategy, c.period, 'cash', c.target_weight, s.session, f.daily_return FROM cashw c JOIN sessions s ON s.session > c.start_s AND s.session <= c.end_s JOIN risk_free f ON f.trade_date = s.trade_date)""",
    "holdings AS (SELECT *, product(1.0 + ret) OVER (PARTITION BY strategy, period, ticker ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth FROM everything)",
    "vals AS (SELECT strategy, period, session, sum(target_weight * growth) AS value FROM holdings GROUP BY 1, 2, 3)",
    """drift AS (SELECT h.strategy, h.period, h.ticker, h.target_weight * h.growth / v.value AS drifted FROM holdings h
        JOIN allp a ON a.strategy = h.strategy AND a.period = h.period AND a.end_s = h.session JOIN vals v ON v.strategy = h.strategy AND v.period = h.period AND v.session = h.session)""",
    """wants AS (SELECT h.strategy, h.period, CAST(t.ticker AS VARCHAR) AS ticker, t.target_weight AS wanted FROM targets t JOIN heldp h ON h.strategy = t.strategy AND h.trade_date = t.trade_date
        UNION ALL SELECT strategy, period, 'cash', target_weight FROM cashw WHERE period > 0)""",
    "befores AS (SELECT d.strategy, d.period + 1 AS period, d.ticker, d.drifted AS held FROM drift d JOIN heldp h ON h.strategy = d.strategy AND h.period = d.period + 1)",
    """orders_ AS (SELECT coalesce(w.strategy, b.strategy) AS strategy, coalesce(w.period, b.period) AS period, coalesce(w.ticker, b.ticker) AS ticker, coalesce(held, 0.0) AS held, coalesce(wanted, 0.0) AS wanted
        FROM wants w FULL JOIN befores b ON w.strategy = b.strategy AND w.period = b.period AND w.ticker = b.ticker)""",
    "churn AS (SELECT strategy, period, 0.5 * sum(abs(wanted - held)) AS turnover FROM orders_ GROUP BY 1, 2)",
]


@query("topk_targets", S.with_(*TARGETS, select=f"SELECT strategy, trade_date, ticker, issuer_id, rank, {r('target_weight')} AS target_weight FROM targets"))
def topk_targets(spark, sf_dir):
    t = Market(spark, sf_dir).targets
    return t.select("strategy", "trade_date", "ticker", "issuer_id", "rank", rounded(F.col("target_weight")).alias("target_weight"))


@query(
    "topk_missing_issuers",
    S.with_(
        *FORECAST_SQL,
        """gaps AS (SELECT trade_date, ticker, CASE WHEN ticker % 3 <> 0 THEN issuer_id END AS issuer_id, momentum_12_1 AS score FROM forecasts WHERE momentum_12_1 IS NOT NULL)""",
        """classes AS (SELECT *, row_number() OVER (PARTITION BY trade_date, coalesce(CAST(issuer_id AS VARCHAR), substr(CAST(ticker AS VARCHAR), 1, 4)) ORDER BY score DESC, ticker) AS cls FROM gaps)""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ticker) AS rank FROM classes WHERE cls = 1)""",
        select="SELECT trade_date, ticker, issuer_id, rank FROM placed WHERE rank <= 10",
    ),
)
def topk_missing_issuers(spark, sf_dir):
    """A third of the names have no issuer; their ticker's root tells them apart."""
    rows = Market(spark, sf_dir).forecasts.withColumn("issuer_id", F.when(F.col("ticker") % 3 != 0, F.col("issuer_id")))
    return selection.topk_with_issuer_cap(rows, "momentum_12_1", 10).select("trade_date", "ticker", "issuer_id", "rank")


@query("holding_returns", S.with_(*BOOK, select=f"SELECT strategy, period, session, {r('ln(value)')} AS log_value FROM vals"))
def holding_returns(spark, sf_dir):
    return Market(spark, sf_dir).values.select("strategy", "period", "session", rounded(F.log("value")).alias("log_value"))


@query("drifted_weights", S.with_(*BOOK, select=f"SELECT strategy, period, ticker, {r('held')} AS held, {r('wanted')} AS wanted FROM orders_"))
def drifted_weights(spark, sf_dir):
    return Market(spark, sf_dir).orders.select(
        "strategy", "period", "ticker", rounded(F.col("held")).alias("held"), rounded(F.col("wanted")).alias("wanted")
    )


@query("turnover", S.with_(*BOOK, select=f"SELECT strategy, period, {r('turnover')} AS turnover FROM churn"))
def turnover(spark, sf_dir):
    return Market(spark, sf_dir).turnover.select("strategy", "period", rounded(F.col("turnover")).alias("turnover"))


_CURVE = [
    *BOOK,
    """chain AS (SELECT a.strategy, a.period, a.start_s, a.end_s, b.bps, ln(coalesce(v.value, 1.0)) AS g, ln(1.0 - coalesce(c.turnover, 0.0) * b.bps / 10000.0) AS k
        FROM allp a JOIN (SELECT CAST(unnest([5, 10, 15, 25, 50, 100]) AS DOUBLE) AS bps) b ON true LEFT JOIN churn c ON c.strategy = a.strategy AND c.period = a.period
        LEFT JOIN vals v ON v.strategy = a.strategy AND v.period = a.period AND v.session = a.end_s)""",
    """opens AS (SELECT *, coalesce(sum(g) OVER w, 0.0) AS gross_open, coalesce(sum(g + k) OVER w, 0.0) + k AS net_open FROM chain
        WINDOW w AS (PARTITION BY strategy, bps ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """path AS (SELECT strategy, bps, period, start_s AS session, net_open AS ln_net, gross_open AS ln_gross FROM opens WHERE period = 0
        UNION ALL SELECT o.strategy, o.bps, o.period, v.session, CASE WHEN v.session = o.end_s AND n.net_open IS NOT NULL THEN n.net_open ELSE o.net_open + ln(v.value) END, o.gross_open + ln(v.value)
        FROM opens o JOIN vals v ON v.strategy = o.strategy AND v.period = o.period LEFT JOIN opens n ON n.strategy = o.strategy AND n.bps = o.bps AND n.period = o.period + 1)""",
    "curve AS (SELECT strategy, bps, period, session, trade_date, ln_net, ln_gross FROM path JOIN sessions USING (session))",
]


@query("net_curve_by_bps", S.with_(*_CURVE, select=f"SELECT strategy, bps, trade_date, {r('ln_net')} AS log_net, {r('ln_gross')} AS log_gross FROM curve WHERE bps <> 15"))
def net_curve_by_bps(spark, sf_dir):
    c = Market(spark, sf_dir).curves((5.0, 10.0, 25.0, 50.0, 100.0))
    return c.select(
        "strategy", "bps", "trade_date", rounded(F.log(F.col("net_value") / 100_000.0)).alias("log_net"), rounded(F.log(F.col("gross_value") / 100_000.0)).alias("log_gross")
    )


_ADV = f"""liq AS (SELECT ticker, session, {S.full('avg', 'traded_value_brl', 21, 5, 1)} AS adv, {S.full('stddev_samp', 'ret_1w', 21, 5, 1)} AS sigma FROM rets JOIN sessions USING (trade_date))"""
_FILLS = [
    *BOOK, _ADV,
    """asked AS (SELECT o.*, l.adv, l.sigma FROM orders_ o JOIN heldp h ON h.strategy = o.strategy AND h.period = o.period
        LEFT JOIN liq l ON CAST(l.ticker AS VARCHAR) = o.ticker AND l.session = h.start_s WHERE o.ticker <> 'cash')""",
    """steps1 AS (SELECT a.*, capital, cap, sign(wanted - held) * least(abs(wanted - held), CASE WHEN adv > 0 THEN cap * adv / capital ELSE 0.0 END) AS step
        FROM asked a, (SELECT CAST(unnest([100000, 1000000, 10000000]) AS DOUBLE) AS capital) c, (SELECT CAST(unnest([0.01, 0.02, 0.05]) AS DOUBLE) AS cap) p)""",
    "steps2 AS (SELECT *, greatest(held + step, 0.0) AS f0 FROM steps1)",
    """steps3 AS (SELECT *, greatest(sum(f0) OVER w - 1.0, 0.0) AS excess, sum(greatest(step, 0.0)) OVER w AS buys FROM steps2 WINDOW w AS (PARTITION BY strategy, period, capital, cap))""",
    "steps4 AS (SELECT *, f0 - greatest(step, 0.0) * CASE WHEN buys > 0 THEN least(1.0, excess / buys) ELSE 0.0 END AS filled FROM steps3)",
    """fills AS (SELECT *, abs(filled - held) AS traded, abs(filled - held) * 2.0 / 10000.0 AS fees,
        abs(filled - held) * CASE WHEN adv <= 1e6 THEN 30.0 WHEN adv <= 1e7 THEN 15.0 ELSE 8.0 END / 10000.0 AS spread,
        abs(filled - held) * 10.0 / 10000.0 * sqrt(CASE WHEN adv > 0 THEN abs(filled - held) * capital / adv ELSE 0.0 END) AS impact FROM steps4)""",
]


def fills(m: Market):
    liquidity = technical.lagged_liquidity(m.prices, 21, 5).join(F.broadcast(m.sessions), "trade_date").select(
        F.col("ticker").cast("string").alias("ticker"), F.col("session").alias("start"), F.col("lagged_adv").alias("adv"), F.col("lagged_sigma").alias("sigma")
    )
    asked = m.orders.filter(F.col("ticker") != book.CASH).join(m.periods.select("strategy", "period", "start"), ["strategy", "period"])
    asked = asked.join(liquidity, ["ticker", "start"], "left")
    return book.liquidity_fills(asked, CAPITALS, CAPS, fee_bps=2.0)


@query(
    "liquidity_costs",
    S.with_(*_FILLS, select=f"SELECT strategy, capital, cap, component, {r('sum(x)')} AS cost_fraction, {r('sum(x * capital)', 2)} AS cost_amount FROM ("
            + " UNION ALL ".join(f"SELECT strategy, capital, cap, '{c}' AS component, {c} AS x FROM fills" for c in ("fees", "spread", "impact")) + ") GROUP BY 1, 2, 3, 4"),
)
def liquidity_costs(spark, sf_dir):
    rows = book.cost_components(fills(Market(spark, sf_dir)))
    return rows.select(
        "strategy", "capital", "cap", "component", rounded(F.col("cost_fraction")).alias("cost_fraction"), rounded(F.col("cost_amount"), 2).alias("cost_amount")
    )


@query(
    "rejected_orders",
    S.with_(
        *_FILLS,
        """blocked AS (SELECT d.strategy, d.period + 1 AS period, d.ticker FROM drift d JOIN heldp h ON h.strategy = d.strategy AND h.period = d.period + 1
            JOIN marks m ON CAST(m.ticker AS VARCHAR) = d.ticker AND m.session = h.start_s WHERE NOT m.quoted)""",
        select="""SELECT strategy, period, reason, count(*) AS names FROM (
          SELECT DISTINCT strategy, period, ticker, 'participation_cap_partial_fill' AS reason FROM fills WHERE abs(filled - wanted) > 1e-12
          UNION ALL SELECT strategy, period, ticker, 'no_observed_quote_for_exit' FROM blocked) GROUP BY 1, 2, 3""",
    ),
)
def rejected_orders(spark, sf_dir):
    m = Market(spark, sf_dir)
    unquoted = m.marks.filter("NOT quote_observed").select(F.col("ticker").cast("string").alias("ticker"), F.col("session").alias("start"))
    held = book.drifted_weights(m.holdings, m.periods, m.values).filter(F.col("ticker") != book.CASH)
    exits = held.withColumn("period", F.col("period") + 1).join(m.periods.select("strategy", "period", "start"), ["strategy", "period"])
    blocked = exits.join(unquoted, ["ticker", "start"], "left_semi")
    rows = book.rejected_orders(fills(m), blocked)
    return rows.groupBy("strategy", "period", "reason").agg(F.count("*").alias("names"))


@query(
    "strategy_by_cost",
    S.with_(
        *_FILLS,
        "t AS (SELECT strategy, sum(turnover) AS turnover, count(*) AS rebalances FROM churn GROUP BY 1)",
        "grown AS (SELECT strategy, sum(ln(value)) AS log_gross FROM (SELECT strategy, period, arg_max(value, session) AS value FROM vals GROUP BY 1, 2) GROUP BY 1)",
        """kept AS (SELECT strategy, capital, cap, sum(ln(1.0 - cost)) AS k FROM
            (SELECT strategy, capital, cap, period, sum(fees + spread + impact) AS cost FROM fills GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)""",
        select=f"""SELECT f.strategy, f.capital, f.cap, {r('sum(fees)')} AS fees, {r('sum(spread)')} AS spread, {r('sum(impact)')} AS impact,
          {r('sum(traded) / sum(abs(wanted - held))')} AS fill_ratio, count(*) FILTER (WHERE abs(filled - wanted) > 1e-12) AS rejected_orders,
          {r('sum(abs(filled - wanted)) * f.capital', 2)} AS rejected_notional, {r('max(log_gross)')} AS log_gross, {r('max(log_gross + k)')} AS log_net,
          {r('max(turnover)')} AS turnover, max(rebalances) AS rebalances
          FROM fills f JOIN t ON t.strategy = f.strategy JOIN grown g ON g.strategy = f.strategy
          JOIN kept ON kept.strategy = f.strategy AND kept.capital = f.capital AND kept.cap = f.cap GROUP BY 1, 2, 3""",
    ),
)
def strategy_by_cost(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = book.strategy_cost_table(m.values, m.turnover, fills(m))
    # Growth in logs: over all years wealth in this market spans orders of magnitude.
    return rows.select(
        "strategy", "capital", "cap", *[rounded(F.col(c)).alias(c) for c in ("log_gross", "log_net", "fees", "spread", "impact", "fill_ratio", "turnover")],
        rounded(F.col("rejected_notional"), 2).alias("rejected_notional"), "rejected_orders", "rebalances",
    )


_CONTRIB = """contrib AS (SELECT h.strategy, s.trade_date, h.ticker, h.session, ret,
      coalesce(lag(h.target_weight * h.growth) OVER (PARTITION BY h.strategy, h.period, h.ticker ORDER BY h.session), h.target_weight) / coalesce(pv.value, 1.0) AS weight
    FROM holdings h JOIN sessions s ON s.session = h.session LEFT JOIN vals pv ON pv.strategy = h.strategy AND pv.period = h.period AND pv.session = h.session - 1)"""


def contributions(m: Market):
    rows = book.daily_contributions(m.holdings, m.values, m.sessions)
    return rows.withColumn("ticker", F.col("ticker").try_cast("bigint"))


@query(
    "contributions",
    S.with_(*BOOK, _CONTRIB, select=f"""SELECT strategy, CAST(ticker AS BIGINT) AS ticker, count(*) AS held_sessions, {r('sum(weight * ret)', 4)} AS total_contribution,
      {r('avg(weight)')} AS average_weight FROM contrib WHERE ticker <> 'cash' GROUP BY 1, 2"""),
)
def contributions_by_ticker(spark, sf_dir):
    rows = performance.contribution_totals(contributions(Market(spark, sf_dir)), ["strategy", "ticker"])
    return rows.select(
        "strategy", "ticker", "held_sessions", rounded(F.col("total_contribution"), 4).alias("total_contribution"), rounded(F.col("average_weight")).alias("average_weight")
    )


@query(
    "contributions_by_sector",
    S.with_(
        *BOOK, _CONTRIB, S.BRIDGE,
        """labelled AS (SELECT c.strategy, coalesce(b.sector, 'Unknown') AS sector, weight * ret AS x FROM (SELECT *, TRY_CAST(ticker AS BIGINT) AS tk FROM contrib WHERE ticker <> 'cash') c
            ASOF LEFT JOIN (SELECT * FROM bridge WHERE ticker % 5 <> 0) b ON b.ticker = c.tk AND c.trade_date >= b.valid_from)""",
        select=f"SELECT strategy, sector, {r('sum(x)', 4)} AS total_contribution, count(*) AS held_sessions FROM labelled GROUP BY 1, 2",
    ),
)
def contributions_by_sector(spark, sf_dir):
    m = Market(spark, sf_dir)
    labels = m.bridge.filter("ticker % 5 <> 0").select("ticker", F.col("valid_from").alias("effective_from"), "sector")
    rows = performance.attribute(contributions(m), labels, "sector")
    totals = performance.contribution_totals(rows, ["strategy", "sector"])
    return totals.select("strategy", "sector", rounded(F.col("total_contribution"), 4).alias("total_contribution"), "held_sessions")


_NET = "net AS (SELECT strategy, trade_date, session, exp(ln_net) * 100000.0 AS v, exp(ln_gross) * 100000.0 AS gv, ln_net FROM curve WHERE bps = 15)"
_DAILY = "daily AS (SELECT *, exp(ln_net - lag(ln_net) OVER (PARTITION BY strategy ORDER BY session)) - 1.0 AS ret FROM net)"


def net_curve(m: Market):
    return m.curves((15.0,)).withColumn("portfolio_value", F.col("net_value"))


@query(
    "monthly_returns",
    S.with_(
        *_CURVE, _NET, _DAILY,
        select=f"""SELECT a.strategy, a.period, {r('a.c')} AS compounded, {r('b.f')} AS first_to_last FROM
          (SELECT strategy, CAST(date_trunc('month', trade_date) AS DATE) AS period, sum(ln(1.0 + ret)) AS c FROM daily WHERE ret IS NOT NULL GROUP BY 1, 2) a
          JOIN (SELECT strategy, CAST(date_trunc('month', trade_date) AS DATE) AS period, max_by(ln_net, session) - min_by(ln_net, session) AS f FROM net GROUP BY 1, 2) b USING (strategy, period)""",
    ),
)
def monthly_returns(spark, sf_dir):
    curve = net_curve(Market(spark, sf_dir))
    a = performance.compound_by_period(performance.daily_returns(curve)).withColumnRenamed("period_return", "c")
    b = performance.first_to_last(curve).withColumnRenamed("period_return", "f")
    return a.join(b, ["strategy", "period"]).select(
        "strategy", "period", rounded(F.log1p("c")).alias("compounded"), rounded(F.log1p("f")).alias("first_to_last")
    )


@query(
    "annual_performance",
    S.with_(
        *_CURVE, _NET,
        """y AS (SELECT *, CAST(year(trade_date) AS INTEGER) AS year, exp(ln_net - lag(ln_net) OVER (PARTITION BY strategy, year(trade_date) ORDER BY session)) - 1.0 AS ret,
            exp(ln_net - max(ln_net) OVER (PARTITION BY strategy, year(trade_date) ORDER BY session)) - 1.0 AS dd FROM net)""",
        select=f"""SELECT strategy, year, {r('max_by(ln_net, session) - min_by(ln_net, session)')} AS log_return, {r('min(dd)')} AS max_drawdown,
          {r('CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) * 52.0 / (stddev_samp(ret) * sqrt(52.0)) ELSE 0.0 END')} AS sharpe FROM y GROUP BY 1, 2""",
    ),
)
def annual_performance(spark, sf_dir):
    rows = performance.annual_performance(net_curve(Market(spark, sf_dir)), bars=52)
    return rows.select(
        "strategy", "year", rounded(F.log1p("annual_return")).alias("log_return"), rounded(F.col("max_drawdown")).alias("max_drawdown"), rounded(F.col("sharpe")).alias("sharpe")
    )


@query(
    "summary_metrics",
    S.with_(
        *_CURVE, _NET, S.RISK_FREE.replace("risk_free AS", "rf2 AS"),
        """w AS (SELECT n.*, exp(ln_net - lag(ln_net) OVER (PARTITION BY strategy ORDER BY session)) - 1.0 AS ret, gv / lag(gv) OVER (PARTITION BY strategy ORDER BY session) - 1.0 AS g,
            exp(ln_net - max(ln_net) OVER (PARTITION BY strategy ORDER BY session)) - 1.0 AS dd, f.daily_return AS rf0 FROM net n JOIN rf2 f USING (trade_date))""",
        "v AS (SELECT *, CASE WHEN ret IS NOT NULL THEN rf0 END AS rf FROM w)",
        """t AS (SELECT strategy, count(ret) AS sessions, max_by(ln_net, session) - min_by(ln_net, session) AS lw, max_by(ln(gv), session) - min_by(ln(gv), session) AS lg, sum(ln(1.0 + rf)) AS lrf,
            avg(ret - rf) / stddev_samp(ret - rf) * sqrt(52.0) AS sharpe, avg(ret) / stddev_samp(ret) * sqrt(52.0) AS raw_sharpe, avg(g - rf) / stddev_samp(g - rf) * sqrt(52.0) AS gross_sharpe, min(dd) AS dd FROM v GROUP BY 1)""",
        select=f"""SELECT strategy, sessions, {r('lw')} AS log_wealth, {r('lw * 52.0 / sessions')} AS log_cagr, {r('lg * 52.0 / sessions')} AS log_gross_cagr, {r('lrf * 52.0 / sessions')} AS log_risk_free_cagr,
          {r('(lw - lrf) * 52.0 / sessions')} AS log_relative_cagr, {r('sharpe')} AS sharpe, {r('raw_sharpe')} AS raw_sharpe, {r('gross_sharpe')} AS gross_sharpe, {r('dd')} AS max_drawdown FROM t""",
    ),
)
def summary_metrics(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = performance.summary_metrics(m.curves((15.0,)), m.rates, bars=52)
    return rows.select(
        "strategy", "sessions", rounded(F.log1p("total_return")).alias("log_wealth"), rounded(F.log1p("cagr")).alias("log_cagr"),
        rounded(F.log1p("gross_cagr")).alias("log_gross_cagr"), rounded(F.log1p("risk_free_cagr")).alias("log_risk_free_cagr"),
        rounded(F.log1p("relative_cagr")).alias("log_relative_cagr"),
        *[rounded(F.col(c)).alias(c) for c in ("sharpe", "raw_sharpe", "gross_sharpe", "max_drawdown")],
    )


INDEX_SQL = """idx AS (SELECT trade_date, session, sum(ln(1.0 + coalesce(m1, 0.0))) OVER (ORDER BY session) AS ln_px, m1 IS NOT NULL AS observed
    FROM sessions LEFT JOIN (SELECT trade_date, avg(ret_1w) AS m1 FROM rets GROUP BY 1) USING (trade_date))"""


@query("benchmark_curve", S.with_(S.PRICES, S.PANEL, S.UNIVERSE, INDEX_SQL, select=f"SELECT trade_date, session, {r('ln_px')} AS log_price, observed FROM idx"))
def benchmark_curve(spark, sf_dir):
    c = Market(spark, sf_dir).index_curve
    return c.select("trade_date", "session", rounded(F.log(F.col("price") / 100_000.0)).alias("log_price"), "observed")


MONTHS_SQL = [
    *_CURVE, _NET, INDEX_SQL, _MACRO,
    "sm AS (SELECT strategy, CAST(date_trunc('month', trade_date) AS DATE) AS period, exp(max_by(ln_net, session) - min_by(ln_net, session)) - 1.0 AS s FROM net GROUP BY 1, 2)",
    "bm AS (SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period, exp(max_by(ln_px, session) - min_by(ln_px, session)) - 1.0 AS b FROM idx GROUP BY 1)",
    "cm AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period, value / 1000.0 AS c FROM macro)",
    "months AS (SELECT strategy, period, s, b, c FROM sm JOIN bm USING (period) JOIN cm USING (period))",
]


def month_pairs(m: Market):
    """Monthly strategy and market returns, first to last inside each month, and the monthly rate."""
    s = performance.first_to_last(net_curve(m)).withColumnRenamed("period_return", "strategy_return")
    b = performance.first_to_last(m.index_curve, "price", ()).withColumnRenamed("period_return", "benchmark_return")
    c = m.macro.select(F.trunc("date", "MM").alias("period"), (F.col("value") / 1000.0).alias("rate_return"))
    return cut_lineage(s.join(F.broadcast(b), "period").join(F.broadcast(c), "period"))


@query(
    "rolling_excess",
    S.with_(
        *MONTHS_SQL,
        "rolled AS (" + " UNION ALL ".join(
            f"""SELECT strategy, period, CAST({n} AS INTEGER) AS window_months, sum(ln(1.0 + s)) OVER w AS a, sum(ln(1.0 + b)) OVER w AS bb, count(*) OVER w AS n FROM months
            WINDOW w AS (PARTITION BY strategy ORDER BY period ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for n in (12, 24, 36)) + ")",
        select=f"SELECT strategy, period, window_months, {r('a')} AS log_strategy, {r('bb')} AS log_benchmark, exp(a) > exp(bb) AS ahead FROM rolled WHERE n = window_months",
    ),
)
def rolling_excess(spark, sf_dir):
    rows = performance.rolling_excess(month_pairs(Market(spark, sf_dir)))
    return rows.select(
        "strategy", "period", "window_months", rounded(F.log1p("strategy_window")).alias("log_strategy"), rounded(F.log1p("benchmark_window")).alias("log_benchmark"),
        (F.col("excess_return") > 0).alias("ahead"),
    )


@query(
    "alpha_beta",
    S.with_(
        *_CURVE, _NET, _DAILY, INDEX_SQL,
        "bd AS (SELECT trade_date, exp(ln_px - lag(ln_px) OVER (ORDER BY session)) - 1.0 AS b FROM idx)",
        select=f"""SELECT strategy, CAST(year(trade_date) AS INTEGER) AS year, {r('regr_slope(ret, b)', 4)} AS beta, {r('regr_intercept(ret, b) * 52.0', 3)} AS annualized_alpha, count(*) AS observations
          FROM daily JOIN bd USING (trade_date) WHERE ret IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""",
    ),
)
def alpha_beta(spark, sf_dir):
    m = Market(spark, sf_dir)
    s = performance.daily_returns(net_curve(m), out="strategy_return").select("strategy", "trade_date", "strategy_return")
    b = performance.daily_returns(m.index_curve, "price", (), "benchmark_return").select("trade_date", "benchmark_return")
    rows = performance.annual_alpha_beta(s.join(F.broadcast(b), "trade_date"), bars=52)
    return rows.select(
        "strategy", "year", rounded(F.col("beta"), 4).alias("beta"), rounded(F.col("annualized_alpha"), 3).alias("annualized_alpha"), "observations"
    )


@query(
    "drawdowns",
    S.with_(
        *_CURVE, _NET,
        "pk AS (SELECT *, ln_net >= max(ln_net) OVER (PARTITION BY strategy ORDER BY session) AS is_peak FROM net)",
        "isl AS (SELECT *, sum(CASE WHEN is_peak THEN 1 ELSE 0 END) OVER (PARTITION BY strategy ORDER BY session) AS island FROM pk)",
        "ep AS (SELECT strategy, island, min(trade_date) AS peak_date, min(session) AS s0, max(session) AS s1, min_by(trade_date, (ln_net, session)) AS trough_date, min(ln_net) - max(ln_net) AS depth FROM isl GROUP BY 1, 2)",
        "nx AS (SELECT *, lead(peak_date) OVER w AS recovery_date, lead(s0) OVER w AS n0 FROM ep WINDOW w AS (PARTITION BY strategy ORDER BY island))",
        select=f"""SELECT strategy, peak_date, trough_date, recovery_date, {r('exp(depth) - 1.0')} AS max_drawdown, coalesce(n0, s1) - s0 AS duration_sessions, recovery_date IS NOT NULL AS recovered
          FROM nx WHERE depth < 0""",
    ),
)
def drawdowns(spark, sf_dir):
    rows = performance.drawdown_episodes(net_curve(Market(spark, sf_dir)))
    return rows.withColumn("max_drawdown", rounded(F.col("max_drawdown")))


@query(
    "concentration",
    S.with_(
        *_CURVE, _NET, _CONTRIB,
        "yr AS (SELECT strategy, year(trade_date) AS y, max_by(ln_net, session) - min_by(ln_net, session) AS w FROM net GROUP BY 1, 2)",
        "ty AS (SELECT strategy, sum(w) FILTER (WHERE n <= 5) / sum(w) AS a FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY w DESC) AS n FROM yr WHERE w > 0) GROUP BY 1)",
        "tc AS (SELECT strategy, ticker, sum(weight * ret) AS c FROM contrib WHERE ticker <> 'cash' GROUP BY 1, 2)",
        "tn AS (SELECT strategy, sum(c) FILTER (WHERE n <= 10) / sum(c) AS b FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY c DESC) AS n FROM tc WHERE c > 0) GROUP BY 1)",
        select=f"SELECT strategy, {r('a')} AS top_years_share, {r('b')} AS top_names_share, a > 0.5 AS years_concentrated, b > 0.5 AS names_concentrated FROM ty FULL JOIN tn USING (strategy)",
    ),
)
def concentration(spark, sf_dir):
    m = Market(spark, sf_dir)
    annual = performance.annual_performance(net_curve(m), bars=52)
    names = performance.contribution_totals(contributions(m), ["strategy", "ticker"])
    rows = performance.concentration(annual, names)
    return rows.select(
        "strategy", rounded(F.col("top_years_share")).alias("top_years_share"), rounded(F.col("top_names_share")).alias("top_names_share"), "years_concentrated", "names_concentrated"
    )


@query(
    "regime_performance",
    S.with_(
        *MONTHS_SQL,
        """wm AS (SELECT *, row_number() OVER o AS n, exp(sum(ln(1.0 + b)) OVER (PARTITION BY strategy ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) - 1.0 AS trend,
            stddev_samp(b) OVER t AS vol, avg(c) OVER t AS rate FROM months WINDOW o AS (PARTITION BY strategy ORDER BY period), t AS (PARTITION BY strategy ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))""",
        """pm AS (SELECT *, quantile_cont(CASE WHEN n > 3 THEN vol END, 0.5) OVER p AS mv, quantile_cont(CASE WHEN n > 3 THEN rate END, 0.5) OVER p AS mr FROM wm
            WINDOW p AS (PARTITION BY strategy ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        """lab AS (SELECT strategy, 'market' AS regime_type, CASE WHEN trend >= 0 THEN 'bull' ELSE 'bear' END AS regime, s - b AS x FROM pm WHERE n > 12
            UNION ALL SELECT strategy, 'volatility', CASE WHEN vol >= mv THEN 'high_vol' ELSE 'low_vol' END, s - b FROM pm WHERE n > 12
            UNION ALL SELECT strategy, 'rates', CASE WHEN rate >= mr THEN 'high_rate' ELSE 'low_rate' END, s - c FROM pm WHERE n > 12)""",
        select=f"SELECT strategy, regime_type, regime, count(*) AS months, {r('avg(x)', 4)} AS mean_monthly_excess, {r('avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)')} AS excess_hit_rate FROM lab GROUP BY 1, 2, 3",
    ),
)
def regime_performance(spark, sf_dir):
    rows = performance.regime_performance(month_pairs(Market(spark, sf_dir)))
    return rows.select(
        "strategy", "regime_type", "regime", "months", rounded(F.col("mean_monthly_excess"), 4).alias("mean_monthly_excess"), rounded(F.col("excess_hit_rate")).alias("excess_hit_rate")
    )


@query(
    "best_worst_months",
    S.with_(
        *MONTHS_SQL,
        select=f"""SELECT strategy, period, {r('ln(1.0 + s)')} AS log_return, side FROM (
          (SELECT *, 'best' AS side FROM months ORDER BY s DESC, strategy, period LIMIT 10) UNION ALL (SELECT *, 'worst' AS side FROM months ORDER BY s, strategy, period LIMIT 10))""",
    ),
)
def best_worst_months(spark, sf_dir):
    rows = selection.extremes(month_pairs(Market(spark, sf_dir)), "strategy_return", 10, ["strategy", "period"])
    return rows.select("strategy", "period", rounded(F.log1p("strategy_return")).alias("log_return"), "side")


@query(
    "weight_sanity",
    S.with_(
        *TARGETS,
        select="""SELECT strategy, trade_date FROM (SELECT strategy, trade_date, target_weight * CASE month(trade_date) WHEN 3 THEN 2.0 WHEN 6 THEN -1.0 WHEN 9 THEN NULL ELSE 1.0 END AS w FROM targets)
          GROUP BY 1, 2 HAVING coalesce(sum(w), 0.0) > 1.000001 OR sum(w) <= 0 OR min(w) < 0 OR count(w) < count(*)""",
    ),
)
def weight_sanity(spark, sf_dir):
    # Doubled, negative and missing weights in some months.
    month = F.month("trade_date")
    factor = F.when(month == 3, 2.0).when(month == 6, -1.0).when(month != 9, 1.0)
    targets = Market(spark, sf_dir).targets.withColumn("target_weight", F.col("target_weight") * factor)
    return quality.weight_violations(targets, ("strategy", "trade_date")).select("strategy", "trade_date")


@query(
    "one_signal_date_per_month",
    S.with_(S.PRICES, select="SELECT ticker, CAST(date_trunc('month', trade_date) AS DATE) AS month, count(DISTINCT trade_date) AS dates FROM prices GROUP BY 1, 2 HAVING count(DISTINCT trade_date) > 1"),
)
def one_signal_date_per_month(spark, sf_dir):
    return quality.months_with_many_dates(Market(spark, sf_dir).prices, ("ticker",))


@query(
    "execution_after_signal",
    S.with_(
        S.PRICES, S.UNIVERSE,
        """c AS (SELECT p.ticker, p.trade_date, n.trade_date AS execution_date FROM prices p JOIN sessions s ON s.trade_date = p.trade_date
            LEFT JOIN sessions n ON n.session = s.session + CASE WHEN p.ticker % 4 = 0 THEN 0 ELSE 1 END)""",
        select="SELECT ticker, count(*) AS violations FROM c WHERE execution_date IS NULL OR execution_date <= trade_date GROUP BY 1",
    ),
)
def execution_after_signal(spark, sf_dir):
    m = Market(spark, sf_dir)
    bars = m.prices.select("ticker", "trade_date")
    same_close = book.execution_dates(bars.filter("ticker % 4 = 0"), m.sessions, 0, "left")
    next_close = book.execution_dates(bars.filter("ticker % 4 <> 0"), m.sessions, 1, "left")
    bad = quality.execution_not_after_signal(same_close.unionByName(next_close))
    return bad.groupBy("ticker").agg(F.count("*").alias("violations"))


@query("values_not_allowed", "SELECT upper(trim(c_mktsegment)) AS c_mktsegment, count(*) AS rows FROM customer WHERE upper(trim(c_mktsegment)) NOT IN ('AUTOMOBILE', 'BUILDING') GROUP BY 1")
def values_not_allowed(spark, sf_dir):
    return quality.values_not_allowed(Market(spark, sf_dir).table("customer"), "c_mktsegment", ["AUTOMOBILE", "BUILDING"])


@query(
    "quoted_spread",
    f"""SELECT l_suppkey AS ticker, {r('avg(CASE WHEN bid > 0 AND ask >= bid THEN (ask - bid) / ((ask + bid) / 2.0) * 10000.0 END)', 4)} AS mean_spread_bps,
      count(*) FILTER (WHERE NOT (bid > 0 AND ask >= bid)) AS unusable
      FROM (SELECT l_suppkey, l_extendedprice * (1.0 - l_discount) AS bid, l_extendedprice * (1.03 - l_tax) AS ask FROM lineitem) GROUP BY 1""",
)
def quoted_spread(spark, sf_dir):
    quotes = Market(spark, sf_dir).table("lineitem").select(
        F.col("l_suppkey").alias("ticker"), (F.col("l_extendedprice") * (1.0 - F.col("l_discount"))).alias("bid"), (F.col("l_extendedprice") * (1.03 - F.col("l_tax"))).alias("ask")
    )
    rows = quotes.withColumn("bps", quoted_spread_bps(F.col("bid"), F.col("ask")))
    return rows.groupBy("ticker").agg(
        rounded(F.avg("bps"), 4).alias("mean_spread_bps"), F.count(F.when(F.col("bps").isNull(), 1)).alias("unusable")
    )


@query(
    "risk_free_gaps",
    S.with_(
        S.PRICES, S.UNIVERSE, S.RISK_FREE,
        select="SELECT s.trade_date, s.session FROM sessions s LEFT JOIN (SELECT * FROM risk_free WHERE month(trade_date) <> 7) f USING (trade_date) WHERE s.session > 0 AND (f.daily_return IS NULL OR f.daily_return <= -1)",
    ),
)
def risk_free_gaps(spark, sf_dir):
    m = Market(spark, sf_dir)
    rates = book.aligned_risk_free(m.sessions, m.risk_free.filter(F.month("trade_date") != 7), check=False)
    return rates.filter("session > 0 AND (rf IS NULL OR rf <= -1)").select("trade_date", "session")


_HYSTERESIS = S.with_(
    *FORECAST_SQL,
    """bids_ AS (SELECT 'momentum' AS strategy, trade_date, ticker, issuer_id, rank_momentum_12_1 AS score FROM forecasts WHERE rank_momentum_12_1 IS NOT NULL
        UNION ALL SELECT 'low_volatility', trade_date, ticker, issuer_id, 1.0 - rank_volatility_12w FROM forecasts WHERE rank_volatility_12w IS NOT NULL)""",
    """single_ AS (SELECT *, row_number() OVER (PARTITION BY strategy, trade_date, coalesce(CAST(issuer_id AS VARCHAR), substr(CAST(ticker AS VARCHAR), 1, 4)) ORDER BY score DESC, ticker) AS cls FROM bids_)""",
    "ranked AS (SELECT * FROM (SELECT strategy, trade_date, ticker, row_number() OVER (PARTITION BY strategy, trade_date ORDER BY score DESC, ticker) AS rank FROM single_ WHERE cls = 1) WHERE rank <= 15)",
    """days AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY trade_date) AS d
        FROM (SELECT strategy, trade_date, list(ticker ORDER BY rank) AS names FROM ranked GROUP BY 1, 2))""",
    """walk AS (SELECT strategy, trade_date, d, names[1:10] AS chosen FROM days WHERE d = 1
        UNION ALL SELECT n.strategy, n.trade_date, n.d,
          list_concat(list_filter(n.names, lambda x: list_contains(w.chosen, x)), list_filter(n.names, lambda x: NOT list_contains(w.chosen, x)))[1:10]
          FROM walk w JOIN days n ON n.strategy = w.strategy AND n.d = w.d + 1)""",
    select="""SELECT r.strategy, r.trade_date, r.ticker, r.rank, 1.0 / len(w.chosen) AS target_weight
      FROM ranked r JOIN walk w ON w.strategy = r.strategy AND w.trade_date = r.trade_date WHERE list_contains(w.chosen, r.ticker)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("hysteresis", _HYSTERESIS)
def hysteresis(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = factors_rows(m)
    ranked = selection.topk_with_issuer_cap(rows, "score", 10, ["strategy", "trade_date"], buffer=5)
    return book.hysteresis_selection(ranked, 10, 5)


def factors_rows(m: Market):
    from tidemark.operators.factors import by_strategy

    rows = m.forecasts.select(
        "trade_date", "ticker", "issuer_id", F.col("rank_momentum_12_1").alias("signal_momentum"), (1.0 - F.col("rank_volatility_12w")).alias("signal_low_volatility")
    )
    return by_strategy(rows, ["trade_date", "ticker", "issuer_id"])
