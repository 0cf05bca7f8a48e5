"""Queries over prices, features, labels and the investible universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import quality, selection, technical, universe
from tidemark.plans import market_sql as S
from tidemark.plans.market import HORIZON, UNIVERSE, WEEKLY, Market
from tidemark.plans.registry import query

FEATURES = [
    "ret_1w", "return_2w", "return_4w", "return_12w", "return_26w", "return_52w", "volatility_2w", "volatility_4w",
    "volatility_12w", "volatility_26w", "volatility_52w", "distance_sma_4w", "distance_sma_12w", "distance_sma_52w",
    "momentum_12_1", "log_traded_value", "log_traded_value_4w", "log_trades_4w", "short_term_reversal_2w",
    "medium_term_momentum", "market_return_1w", "residual_volatility_12w",
]
RANKS = [f"rank_{c}" for c in WEEKLY.ranked]


@query("prices_panel", S.with_(S.PRICES, select="SELECT ticker, trade_date, close, traded_value_brl, trades FROM prices"))
def prices_panel(spark, sf_dir):
    return Market(spark, sf_dir).prices


@query(
    "invalid_prices",
    """SELECT l_orderkey, l_linenumber, l_suppkey AS ticker, CASE WHEN l_discount = 0.09 THEN -l_extendedprice WHEN l_tax = 0.0 THEN 0.0 END AS close FROM lineitem
       WHERE l_discount = 0.1 OR l_discount = 0.09 OR l_tax = 0.0""",
)
def invalid_prices(spark, sf_dir):
    lines = Market(spark, sf_dir).table("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("ticker"),
        F.when(F.col("l_discount") == 0.09, -F.col("l_extendedprice")).when(F.col("l_tax") == 0.0, 0.0).when(F.col("l_discount") != 0.1, F.col("l_extendedprice")).alias("close"),
    )
    return quality.invalid_prices(lines)


@query(
    "duplicate_keys",
    """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    lines = Market(spark, sf_dir).table("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return quality.duplicate_keys(lines, ["l_suppkey", "l_shipdate"])


_MOMENTUM = f"""SELECT trade_date, ticker, issuer_id, {S.r('momentum_12_1')} AS momentum_12_1,
  {S.r('rank_momentum_12_1')} AS rank_momentum_12_1, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY rank_momentum_12_1 DESC, ticker) AS rank FROM (
    SELECT monthly.*, issuer_id,
      row_number() OVER (PARTITION BY trade_date, issuer_id ORDER BY rank_momentum_12_1 DESC, ticker) AS class
    FROM monthly JOIN securities USING (ticker) WHERE rank_momentum_12_1 IS NOT NULL)
  WHERE class = 1) WHERE rank <= 10"""


@query("momentum_topk_monthly", S.with_(S.PRICES, S.PANEL, S.ISSUERS, S.MONTHLY, select=_MOMENTUM))
def momentum_topk_monthly(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = m.monthly.join(m.securities, "ticker")
    best = selection.topk_with_issuer_cap(rows, "rank_momentum_12_1", 10)
    return best.select(
        "trade_date",
        "ticker",
        "issuer_id",
        rounded(F.col("momentum_12_1")).alias("momentum_12_1"),
        rounded(F.col("rank_momentum_12_1")).alias("rank_momentum_12_1"),
        "rank",
    )


_TECH = ", ".join(f"{S.r(c)} AS {c}" for c in FEATURES)
_RANKED = ", ".join(f"{S.r('rank_' + c)} AS rank_{c}" for c in S.RANKED)


@query(
    "technical_features",
    S.with_(
        S.PRICES,
        S.PANEL,
        f"ranked AS (SELECT *, {S.RANKS} FROM panel)",
        select=f"SELECT ticker, trade_date, {_TECH}, {S.r('amihud_illiquidity_4w * 1e6')} AS amihud_per_million, {_RANKED} FROM ranked",
    ),
)
def technical_features(spark, sf_dir):
    panel = Market(spark, sf_dir).panel
    return panel.select(
        "ticker",
        "trade_date",
        *[rounded(F.col(c)).alias(c) for c in FEATURES],
        rounded(F.col("amihud_illiquidity_4w") * 1e6).alias("amihud_per_million"),
        *[rounded(F.col(c)).alias(c) for c in RANKS],
    )


@query(
    "forward_labels",
    S.with_(
        S.PRICES,
        S.PANEL,
        select=f"SELECT ticker, trade_date, target_start_date, target_end_date, {S.r('future_return')} AS future_return FROM panel",
    ),
)
def forward_labels(spark, sf_dir):
    labels = technical.forward_labels(Market(spark, sf_dir).prices, (HORIZON,), 1)
    return labels.select(
        "ticker", "trade_date", "target_start_date", "target_end_date", rounded(F.col("future_return")).alias("future_return")
    )


def _horizon_sql(h: int) -> str:
    lead = S._lead.format
    return f"""SELECT ticker, trade_date, CAST({h} AS INTEGER) AS target_horizon_bars, {lead('trade_date', 1 + h)} AS target_end_date,
      {S.r(lead('close', 1 + h) + ' / ' + lead('close', 1) + ' - 1.0')} AS future_return FROM prices"""


@query(
    "horizon_challengers",
    S.with_(
        S.PRICES,
        select="SELECT * FROM ("
        + " UNION ALL ".join(_horizon_sql(h) for h in (4, 8, 12))
        + ") WHERE target_end_date <= DATE '2000-12-31'",
    ),
)
def horizon_challengers(spark, sf_dir):
    from tidemark.operators.folds import labels_known_by

    labels = technical.forward_labels(Market(spark, sf_dir).prices, (4, 8, 12), 1)
    known = labels_known_by(labels, "2000-12-31")
    return known.select(
        "ticker", "trade_date", "target_horizon_bars", "target_end_date", rounded(F.col("future_return")).alias("future_return")
    )


@query(
    "pit_universe",
    S.with_(
        S.PRICES,
        S.UNIVERSE,
        select=f"""SELECT trade_date, ticker, history_sessions, {S.r('session_participation')} AS session_participation,
          {S.r('adv_brl', 2)} AS adv_brl, universe_rejection_reason IS NULL AS universe_eligible, universe_rejection_reason FROM universe""",
    ),
)
def pit_universe(spark, sf_dir):
    u = Market(spark, sf_dir).universe
    return u.select(
        "trade_date",
        "ticker",
        "history_sessions",
        rounded(F.col("session_participation")).alias("session_participation"),
        rounded(F.col("adv_brl"), 2).alias("adv_brl"),
        "universe_eligible",
        "universe_rejection_reason",
    )


_TARGETS = ["market_forward_return", "target_excess_return", "target_cross_sectional_rank", "rank_momentum_12_1", "rank_volatility_12w"]


@query(
    "investible_targets",
    S.with_(
        S.PRICES, S.PANEL, S.ISSUERS, S.UNIVERSE, S.INVESTIBLE,
        select="SELECT trade_date, ticker, " + ", ".join(f"{S.r(c)} AS {c}" for c in _TARGETS) + " FROM investible",
    ),
)
def investible_targets(spark, sf_dir):
    rows = Market(spark, sf_dir).investible
    return rows.select("trade_date", "ticker", *[rounded(F.col(c)).alias(c) for c in _TARGETS])


@query(
    "signals_with_universe_defaults",
    S.with_(
        S.PRICES, S.UNIVERSE,
        """wanted AS (SELECT s_suppkey AS ticker, trade_date FROM supplier, (SELECT max(trade_date) AS trade_date FROM prices
            GROUP BY date_trunc('month', trade_date)))""",
        select="""SELECT wanted.ticker, wanted.trade_date, u.ticker IS NOT NULL AS quote_observed,
          u.ticker IS NOT NULL AND u.universe_rejection_reason IS NULL AS universe_eligible,
          CASE WHEN u.ticker IS NULL THEN 'no_quote_on_signal_date' ELSE u.universe_rejection_reason END AS universe_rejection_reason
          FROM wanted LEFT JOIN universe u ON u.ticker = wanted.ticker AND u.trade_date = wanted.trade_date""",
    ),
)
def signals_with_universe_defaults(spark, sf_dir):
    m = Market(spark, sf_dir)
    # Every ticker is asked for at every month-end; the list has one date per month.
    dates = m.calendar.agg(F.sort_array(F.collect_list("trade_date"))).scalar()
    asked = m.table("supplier").select(F.col("s_suppkey").alias("ticker"), dates.alias("dates"))
    wanted = asked.select("ticker", F.explode("dates").alias("trade_date"))
    joined = universe.attach_universe(wanted, m.universe)
    return joined.select("ticker", "trade_date", "quote_observed", "universe_eligible", "universe_rejection_reason")


@query(
    "lagged_adv",
    S.with_(
        S.PRICES, S.PANEL,
        select=f"""SELECT ticker, trade_date, {S.r(S.full('avg', 'traded_value_brl', 21, 5, 1), 2)} AS lagged_adv,
          {S.r(S.full('stddev_samp', 'ret_1w', 21, 5, 1))} AS lagged_sigma FROM rets""",
    ),
)
def lagged_adv(spark, sf_dir):
    rows = technical.lagged_liquidity(Market(spark, sf_dir).prices, 21, 5)
    return rows.select(
        "ticker", "trade_date", rounded(F.col("lagged_adv"), 2).alias("lagged_adv"), rounded(F.col("lagged_sigma")).alias("lagged_sigma")
    )


@query(
    "rejected_candidates",
    S.with_(
        S.PRICES, S.PANEL, S.ISSUERS, S.MONTHLY,
        """flagged AS (
          SELECT m.trade_date, m.ticker, issuer_id, m.rank_momentum_12_1 AS score, m.history, e.ticker IS NOT NULL AS quoted FROM (
            SELECT monthly.*, row_number() OVER (PARTITION BY monthly.ticker ORDER BY monthly.trade_date) > 2 AS history FROM monthly) m
          JOIN securities USING (ticker)
          LEFT JOIN (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM (SELECT DISTINCT trade_date FROM prices)) c
            ON c.trade_date = m.trade_date
          LEFT JOIN prices e ON e.ticker = m.ticker AND e.trade_date = c.next_date
          WHERE m.rank_momentum_12_1 IS NOT NULL)""",
        """classed AS (SELECT *, CASE WHEN history AND quoted THEN
             row_number() OVER (PARTITION BY trade_date, issuer_id, history AND quoted ORDER BY score DESC, ticker) END AS class FROM flagged)""",
        """placed AS (SELECT *, coalesce(sum(CASE WHEN class = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY trade_date ORDER BY score DESC, ticker
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM classed)""",
        select="""SELECT trade_date, ticker, CASE WHEN NOT history THEN 'missing_price_history'
          WHEN NOT quoted THEN 'no_observed_execution_quote' ELSE 'issuer_share_class_cap' END AS reason
          FROM placed WHERE accepted < 10 AND (class IS NULL OR class > 1)""",
    ),
)
def rejected_candidates(spark, sf_dir):
    from pyspark.sql import Window

    from tidemark.operators.book import execution_dates

    m = Market(spark, sf_dir)
    w = Window.partitionBy("ticker").orderBy("trade_date")
    rows = m.monthly.withColumn("has_price_history", F.row_number().over(w) > 2).join(m.securities, "ticker")
    dated = execution_dates(rows, universe.session_calendar(m.prices), 1, how="left")
    quotes = m.prices.select("ticker", F.col("trade_date").alias("execution_date"), F.lit(True).alias("__q"))
    flagged = dated.join(quotes, ["ticker", "execution_date"], "left").withColumn(
        "execution_quote", F.coalesce("__q", F.lit(False))
    )
    return selection.rejected_before_cutoff(flagged, "rank_momentum_12_1", 10).select("trade_date", "ticker", "reason")
