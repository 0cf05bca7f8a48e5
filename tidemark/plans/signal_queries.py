"""Queries over factor scores, strategy signals and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import evaluation, factors, selection
from tidemark.plans import market_sql as S
from tidemark.plans.filings_queries import _BALANCE, _CURRENT, _KNOWN, _SNAP, _TTM
from tidemark.plans.market import WEEKLY, Market
from tidemark.plans.registry import query

r = S.r
D = S._D

_Q = sum((0.40, 0.25, 0.15, 0.10, 0.10))
_QUALITY = ["roe_proxy", "roa_proxy", "equity_to_assets", "asset_turnover"]
SIGNALS = [
    S.PRICES, S.PANEL, S.ISSUERS, S.UNIVERSE, S.BRIDGE, S.FACTS, _CURRENT, _KNOWN, _TTM, _BALANCE, _SNAP,
    """eligible AS (SELECT panel.* FROM panel JOIN universe USING (ticker, trade_date)
        WHERE universe_rejection_reason IS NULL AND trade_date IN (SELECT trade_date FROM calendar))""",
    f"""sig0 AS (SELECT e.*, {S.RANKS}, b.issuer_id, b.sector, f.net_margin, {', '.join('f.' + c for c in _QUALITY)},
        future_return - avg(future_return) OVER (PARTITION BY e.trade_date) AS target_excess_return
      FROM eligible e LEFT JOIN bridge b ON b.ticker = e.ticker AND e.trade_date BETWEEN b.valid_from AND b.valid_to
      ASOF LEFT JOIN ratios f ON b.issuer_id = f.issuer_id AND e.trade_date >= f.received)""".replace("PARTITION BY trade_date", "PARTITION BY e.trade_date"),
    "sig1 AS (SELECT *, " + ", ".join(f"{S.avg_rank(c, 'trade_date, sector')} AS sector_rank_{c}" for c in _QUALITY) + " FROM sig0)",
    f"""sig2 AS (SELECT *, {D(.6)} * rank_momentum_12_1 + {D(.25)} * rank_return_26w + {D(.15)} * rank_return_12w AS momentum_score,
        {D(.5)} * (1.0 - rank_volatility_12w) + {D(.5)} * (1.0 - rank_residual_volatility_12w) AS low_volatility_score,
        {D(.4 / _Q)} * {D(.5)} + {D(.25 / _Q)} * coalesce(sector_rank_roe_proxy, 0.5) + {D(.15 / _Q)} * coalesce(sector_rank_roa_proxy, 0.5)
          + {D(.1 / _Q)} * coalesce(sector_rank_equity_to_assets, 0.5) + {D(.1 / _Q)} * coalesce(sector_rank_asset_turnover, 0.5) AS quality_score,
        (rank_momentum_12_1 - {D(.5)}) * {D(.02)} - (rank_volatility_12w - {D(.5)}) * {D(.01)} AS prediction,
        abs(rank_momentum_12_1 - rank_return_12w) * {D(.01)} AS uncertainty FROM sig1)""",
    f"sig AS (SELECT *, {D(1 / 3)} * momentum_score + {D(1 / 3)} * low_volatility_score + {D(1 / 3)} * quality_score AS quant_score FROM sig2)",
]

_SCORES = ["momentum_score", "low_volatility_score", "quality_score", "quant_score"]


@query("factor_scores", S.with_(*SIGNALS, select="SELECT trade_date, ticker, " + ", ".join(f"{r(c)} AS {c}" for c in _SCORES) + " FROM sig"))
def factor_scores(spark, sf_dir):
    return Market(spark, sf_dir).signals.select("trade_date", "ticker", *[rounded(F.col(c)).alias(c) for c in _SCORES])


_STRATEGIES = {
    "ml": "prediction - 0.5 * uncertainty",
    "momentum": "coalesce(rank_momentum_12_1, 0.5)",
    "low_volatility": "coalesce(low_volatility_score, 0.5)",
    "quality": "coalesce(quality_score, 0.5)",
    "quant": "coalesce(quant_score, 0.5)",
    "quant_learned": "coalesce(quant_score, 0.5)",
    "research": "0.65 * ml_percentile + 0.25 * coalesce(quant_score, 0.5) + 0.10 * (1.0 - uncertainty_percentile)",
    "equal_weight": "1.0",
    "liquidity": "coalesce(rank_log_traded_value_4w, 0.0)",
}
STRATEGY_SQL = [
    f"""graded AS (SELECT *, {S.avg_rank('prediction', 'trade_date', 'all')} AS ml_percentile,
        {S.avg_rank('uncertainty', 'trade_date', 'all')} AS uncertainty_percentile FROM sig)""",
    "strategies AS ("
    + " UNION ALL ".join(
        f"SELECT trade_date, ticker, issuer_id, '{k}' AS strategy, CAST({v} AS DOUBLE) AS score FROM graded" for k, v in _STRATEGIES.items()
    )
    + ")",
]


def strategy_rows(m: Market):
    signals = factors.strategy_signals(m.signals, WEEKLY, m.cross_section)
    return factors.by_strategy(signals, ["trade_date", "ticker", "issuer_id"])


@query(
    "strategy_signals",
    S.with_(*SIGNALS, *STRATEGY_SQL, select=f"SELECT trade_date, ticker, strategy, {r('score')} AS score FROM strategies"),
)
def strategy_signals(spark, sf_dir):
    rows = strategy_rows(Market(spark, sf_dir))
    return rows.select("trade_date", "ticker", "strategy", rounded(F.col("score")).alias("score"))


_SLEEVE = """SELECT '{0}' AS sleeve, trade_date, ticker, {0}_score AS x, target_excess_return AS y FROM sig"""
_LEARN = [
    "long AS (" + " UNION ALL ".join(_SLEEVE.format(s) for s in ("momentum", "low_volatility", "quality")) + ")",
    f"""pairs AS (SELECT sleeve, trade_date, {S.avg_rank('x', 'trade_date, sleeve', None)} AS rx, {S.avg_rank('y', 'trade_date, sleeve', None)} AS ry
        FROM long WHERE x IS NOT NULL AND y IS NOT NULL)""",
    "ics AS (SELECT sleeve, trade_date, corr(rx, ry) AS ic FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2 AND NOT isnan(corr(rx, ry)))",
    """churn AS (SELECT sleeve, avg(step) AS churn FROM (SELECT sleeve, abs(x - lag(x) OVER (PARTITION BY sleeve, ticker ORDER BY trade_date)) AS step FROM long) GROUP BY 1)""",
    """strength AS (SELECT sleeve, greatest(0.0, coalesce(mean_ic, 0.0)) / (1.0 + 0.1 * coalesce(churn, 0.0)) AS strength
        FROM churn LEFT JOIN (SELECT sleeve, avg(ic) AS mean_ic FROM ics GROUP BY 1) USING (sleeve))""",
]


@query(
    "learned_sleeve_weights",
    S.with_(
        *SIGNALS, *_LEARN,
        select=f"""SELECT sleeve, {r('strength')} AS strength, {r('0.8 / 3.0 + 0.2 * CASE WHEN sum(strength) OVER () > 0 THEN strength / sum(strength) OVER () ELSE 1.0 / 3.0 END')} AS weight FROM strength""",
    ),
)
def learned_sleeve_weights(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = factors.learned_sleeve_weights(m.signals, group_bound=m.cross_section)
    return rows.select("sleeve", rounded(F.col("strength")).alias("strength"), rounded(F.col("weight")).alias("weight"))


FORECAST_SQL = [S.PRICES, S.PANEL, S.ISSUERS, S.UNIVERSE, S.INVESTIBLE, S.FORECASTS]
CANDIDATES = f"""scored AS (SELECT *, prediction - {D(.5)} * uncertainty AS mu FROM forecasts WHERE prediction IS NOT NULL AND uncertainty IS NOT NULL),
  classed AS (SELECT *, row_number() OVER (PARTITION BY trade_date, issuer_id ORDER BY mu DESC, rank_log_traded_value_4w DESC NULLS LAST, ticker) AS class FROM scored),
  candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY mu DESC, rank_log_traded_value_4w DESC NULLS LAST, ticker) AS alpha_rank
    FROM classed WHERE class = 1) WHERE alpha_rank <= 20)"""


def candidates(m: Market, n: int = 20):
    return selection.alpha_first_candidates(m.forecasts, n, 0.5, "rank_log_traded_value_4w")


@query(
    "alpha_first_candidates",
    S.with_(
        *FORECAST_SQL, CANDIDATES,
        """tops AS (SELECT * FROM (SELECT trade_date, ticker, row_number() OVER (PARTITION BY trade_date ORDER BY mu DESC, rank_log_traded_value_4w DESC NULLS LAST, ticker) AS n FROM scored) WHERE n <= 20)""",
        """dropped AS (SELECT t.trade_date, count(*) AS dropped FROM tops t WHERE NOT EXISTS (
            SELECT 1 FROM candidates c WHERE c.trade_date = t.trade_date AND c.ticker = t.ticker) GROUP BY 1)""",
        select=f"""SELECT trade_date, ticker, issuer_id, alpha_rank, {r('mu')} AS mu, coalesce(dropped, 0) AS dropped_top_alpha
          FROM candidates LEFT JOIN dropped USING (trade_date)""",
    ),
)
def alpha_first_candidates(spark, sf_dir):
    m = Market(spark, sf_dir)
    kept = candidates(m)
    mu = F.col("prediction") - 0.5 * F.col("uncertainty")
    tops = selection.top_per_group(
        m.forecasts.withColumn("mu", mu).filter("mu IS NOT NULL"), ["trade_date"],
        [F.col("mu").desc(), F.col("rank_log_traded_value_4w").desc_nulls_last(), F.col("ticker")], 20, "n",
    )
    dropped = (
        tops.join(kept.select("trade_date", "ticker"), ["trade_date", "ticker"], "left_anti")
        .groupBy("trade_date").agg(F.count("*").alias("dropped"))
    )
    return kept.join(dropped, "trade_date", "left").select(
        "trade_date", "ticker", "issuer_id", "alpha_rank", rounded(F.col("mu")).alias("mu"),
        F.coalesce("dropped", F.lit(0)).alias("dropped_top_alpha"),
    )


@query(
    "prefilter_equal_weight",
    S.with_(
        *FORECAST_SQL, CANDIDATES,
        select=f"SELECT trade_date, ticker, {r('1.0 / count(*) OVER (PARTITION BY trade_date)')} AS target_weight FROM candidates WHERE alpha_rank <= 10",
    ),
)
def prefilter_equal_weight(spark, sf_dir):
    chosen = candidates(Market(spark, sf_dir)).filter("alpha_rank <= 10")
    return selection.equal_weights(chosen).select("trade_date", "ticker", rounded(F.col("target_weight")).alias("target_weight"))


@query(
    "snapshot_ranking",
    S.with_(
        *FORECAST_SQL,
        """published AS (SELECT trade_date AS as_of, ticker, prediction, volatility_12w,
            greatest(0.0, least(100.0, 50.0 + 45.0 * coalesce(prediction / nullif(max(abs(prediction)) OVER (PARTITION BY trade_date), 0.0), 0.0))) AS score FROM forecasts)""",
        select=f"""SELECT as_of, ticker, {r('score', 4)} AS score, {r('volatility_12w * sqrt(52.0)')} AS annual_volatility FROM published
          WHERE as_of = (SELECT max(as_of) FROM published) ORDER BY score DESC, ticker LIMIT 20""",
    ),
)
def snapshot_ranking(spark, sf_dir):
    rows = Market(spark, sf_dir).forecasts.withColumnRenamed("trade_date", "as_of")
    scored = factors.snapshot_scores(rows, "prediction", "volatility_12w", 52)
    return selection.latest_snapshot(scored, 20).select(
        "as_of", "ticker", rounded(F.col("score"), 4).alias("score"), rounded(F.col("annual_volatility")).alias("annual_volatility")
    )


_TOP10 = "top10 AS (SELECT * FROM (SELECT strategy, trade_date, ticker, row_number() OVER (PARTITION BY strategy, trade_date ORDER BY score DESC, ticker) AS n FROM strategies WHERE score IS NOT NULL) WHERE n <= 10)"


@query(
    "selection_turnover",
    S.with_(
        *SIGNALS, *STRATEGY_SQL, _TOP10,
        """months AS (SELECT strategy, trade_date, lag(trade_date) OVER (PARTITION BY strategy ORDER BY trade_date) AS before, count(*) AS positions FROM top10 GROUP BY 1, 2)""",
        select=f"""SELECT m.strategy, m.trade_date, m.positions,
          {r('1.0 - (SELECT count(*) FROM top10 a JOIN top10 b ON a.strategy = b.strategy AND a.ticker = b.ticker WHERE a.strategy = m.strategy AND a.trade_date = m.trade_date AND b.trade_date = m.before) / CAST(m.positions AS DOUBLE)')} AS turnover
          FROM months m WHERE before IS NOT NULL""",
    ),
)
def selection_turnover(spark, sf_dir):
    rows = strategy_rows(Market(spark, sf_dir)).filter("score IS NOT NULL")
    top = selection.top_per_group(rows, ["strategy", "trade_date"], [F.col("score").desc(), F.col("ticker")], 10)
    return evaluation.selection_turnover(top).select(
        "strategy", "trade_date", F.col("positions").cast("bigint").alias("positions"), rounded(F.col("turnover")).alias("turnover")
    )


@query(
    "common_dates",
    S.with_(
        *SIGNALS, *STRATEGY_SQL,
        "seen AS (SELECT DISTINCT strategy, trade_date FROM strategies WHERE score > CASE WHEN strategy = 'momentum' THEN 0.995 ELSE -1.0 END)",
        select="""SELECT trade_date FROM seen GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT strategy) FROM seen)""",
    ),
)
def common_dates(spark, sf_dir):
    from tidemark.operators.book import common_dates as common

    rows = strategy_rows(Market(spark, sf_dir))
    floor = F.when(F.col("strategy") == "momentum", 0.995).otherwise(-1.0)
    return common(rows.filter(F.col("score") > floor))
