"""Queries over covariance tables, weights and baskets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import basket, quality, risk, selection, universe
from tidemark.plans import market_sql as S
from tidemark.plans.market import Market
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import CANDIDATES, FORECAST_SQL
from tidemark.session import cut_lineage

r = S.r
D = S._D

LOOKBACK, MINIMUM, COVERAGE = 104, 30, 0.50
_LIQUID = """liquid0 AS (SELECT *, row_number() OVER (PARTITION BY trade_date, issuer_id ORDER BY rank_log_traded_value_4w DESC NULLS LAST, ticker) AS cls FROM forecasts),
  liquid AS (SELECT * FROM (SELECT trade_date AS as_of, ticker, row_number() OVER (PARTITION BY trade_date ORDER BY rank_log_traded_value_4w DESC NULLS LAST, ticker) AS liquidity_rank
    FROM liquid0 WHERE cls = 1) WHERE liquidity_rank <= {0})"""
_STEPS = """steps AS (SELECT ticker, session, close / lag(close) OVER w - 1.0 AS r, session - lag(session) OVER w AS gap
    FROM prices JOIN sessions USING (trade_date) WINDOW w AS (PARTITION BY ticker ORDER BY session)),
  consecutive AS (SELECT ticker, session, r FROM steps WHERE gap = 1)"""


def _cov(source: str, lookback: int = LOOKBACK, minimum: int = MINIMUM, coverage: float = COVERAGE) -> str:
    return f"""windowed AS (SELECT l.as_of, l.ticker, c.session, c.r, least({lookback}, s.session) AS rows,
      count(*) OVER (PARTITION BY l.as_of, l.ticker) AS observations
      FROM {source} l JOIN sessions s ON s.trade_date = l.as_of JOIN consecutive c ON c.ticker = l.ticker AND c.session <= s.session AND c.session > s.session - {lookback}),
  used AS (SELECT * FROM windowed WHERE observations >= greatest({minimum}, ceil(rows * {D(coverage)}))),
  raw_pairs AS (SELECT a.as_of, a.ticker AS asset_i, b.ticker AS asset_j, covar_samp(a.r, b.r) AS cov, count(*) AS common
      FROM used a JOIN used b ON a.as_of = b.as_of AND a.session = b.session AND a.ticker <= b.ticker GROUP BY 1, 2, 3),
  good AS (SELECT as_of FROM raw_pairs GROUP BY 1 HAVING count(*) FILTER (WHERE asset_i = asset_j) >= 2 AND min(common) >= {minimum}
      AND count(*) = count(*) FILTER (WHERE asset_i = asset_j) * (count(*) FILTER (WHERE asset_i = asset_j) + 1) / 2),
  cov AS (SELECT p.as_of, asset_i, asset_j, common, cov * CASE WHEN asset_i = asset_j THEN 1.0 ELSE 0.8 END * 52.0 AS covariance FROM raw_pairs p SEMI JOIN good ON good.as_of = p.as_of)"""


_COV_SQL = [*FORECAST_SQL, _LIQUID.format(50), _STEPS, _cov("liquid")]


def candidate_covariance(m: Market, n: int = 50):
    names = risk.liquid_candidates(m.forecasts, "rank_log_traded_value_4w", n)
    calendar = universe.session_calendar(m.prices)
    return names, risk.pairwise_covariance(names, m.prices, calendar, LOOKBACK, MINIMUM, COVERAGE, 52.0)


@query("pairwise_covariance", S.with_(*_COV_SQL, select=f"SELECT as_of, asset_i, asset_j, common, {r('covariance', 3)} AS covariance FROM cov"))
def pairwise_covariance(spark, sf_dir):
    _, pairs = candidate_covariance(Market(spark, sf_dir))
    return pairs.select("as_of", "asset_i", "asset_j", "common", rounded(F.col("covariance"), 3).alias("covariance"))


_CORR = """vars AS (SELECT as_of, asset_i AS a, greatest(covariance, 1e-12) AS v FROM cov WHERE asset_i = asset_j),
  corr AS (SELECT c.as_of, asset_i, asset_j, common, CASE WHEN asset_i = asset_j THEN 1.0 ELSE greatest(-1.0, least(1.0, covariance / sqrt(i.v * j.v))) END AS correlation
    FROM cov c JOIN vars i ON i.as_of = c.as_of AND i.a = asset_i JOIN vars j ON j.as_of = c.as_of AND j.a = asset_j)"""


@query("correlation", S.with_(*_COV_SQL, _CORR, select=f"SELECT as_of, asset_i, asset_j, common, {r('correlation')} AS correlation FROM corr"))
def correlation(spark, sf_dir):
    _, pairs = candidate_covariance(Market(spark, sf_dir))
    return risk.correlations(pairs).select("as_of", "asset_i", "asset_j", "common", rounded(F.col("correlation")).alias("correlation"))


@query(
    "matrix_sanity",
    S.with_(
        *_COV_SQL, _CORR,
        """broken AS (SELECT as_of, asset_i, asset_j, CASE WHEN asset_i % 7 = 1 THEN NULL WHEN asset_i = asset_j AND asset_i % 3 = 0 THEN 0.5
            WHEN asset_j % 7 = 2 THEN correlation + 2.5 ELSE correlation END AS v FROM corr)""",
        select="""SELECT as_of, asset_i, asset_j, CASE WHEN v IS NULL THEN 'not_finite' WHEN asset_i = asset_j AND abs(v - 1.0) > 1e-8 THEN 'diagonal' ELSE 'range' END AS reason
          FROM broken WHERE v IS NULL OR abs(v) > 1.00000001 OR asset_i = asset_j AND abs(v - 1.0) > 1e-8""",
    ),
)
def matrix_sanity(spark, sf_dir):
    _, pairs = candidate_covariance(Market(spark, sf_dir))
    # A broken matrix: missing values, a diagonal that is not 1, values out of range.
    value = (
        F.when(F.col("asset_i") % 7 == 1, F.lit(None))
        .when((F.col("asset_i") == F.col("asset_j")) & (F.col("asset_i") % 3 == 0), 0.5)
        .when(F.col("asset_j") % 7 == 2, F.col("correlation") + 2.5)
        .otherwise(F.col("correlation"))
    )
    return quality.pair_matrix_violations(risk.correlations(pairs).withColumn("correlation", value), ["as_of"]).select("as_of", "asset_i", "asset_j", "reason")


_LW = """pr AS (SELECT as_of, count(DISTINCT ticker) AS p FROM used GROUP BY 1),
  whole AS (SELECT u.as_of, u.session FROM used u JOIN pr USING (as_of) GROUP BY u.as_of, u.session, p HAVING count(*) = p),
  x AS (SELECT u.as_of, u.session, u.ticker, u.r - avg(u.r) OVER (PARTITION BY u.as_of, u.ticker) AS r FROM used u JOIN whole w ON w.as_of = u.as_of AND w.session = u.session),
  nn AS (SELECT as_of, count(*) AS n FROM whole GROUP BY 1),
  s AS (SELECT a.as_of, a.ticker AS i, b.ticker AS j, sum(a.r * b.r) / max(n) AS v FROM x a JOIN x b ON a.as_of = b.as_of AND a.session = b.session JOIN nn ON nn.as_of = a.as_of GROUP BY 1, 2, 3),
  q AS (SELECT as_of, sum(e * e) AS fourth FROM (SELECT as_of, session, sum(r * r) AS e FROM x GROUP BY 1, 2) GROUP BY 1),
  st AS (SELECT s.as_of, max(n) AS n, max(p) AS p, sum(CASE WHEN i = j THEN v END) / max(p) AS mu, sum(v * v) AS f2, max(fourth) AS fourth
     FROM s JOIN nn USING (as_of) JOIN pr USING (as_of) JOIN q USING (as_of) GROUP BY 1),
  lw AS (SELECT *, (f2 - p * mu * mu) / p AS delta, (fourth / n - f2) / (p * CAST(n AS DOUBLE)) AS beta FROM st),
  shr AS (SELECT *, least(beta, delta) / delta AS shrinkage FROM lw),
  members AS (SELECT DISTINCT as_of, ticker FROM used),
  matrix AS (SELECT a.as_of, a.ticker AS i, b.ticker AS j, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 3 THEN 0.0 ELSE shrinkage END AS shrinkage, v, mu
     FROM members a JOIN members b ON a.as_of = b.as_of AND a.ticker <= b.ticker
     LEFT JOIN s ON s.as_of = a.as_of AND s.i = a.ticker AND s.j = b.ticker LEFT JOIN shr ON shr.as_of = a.as_of)"""


@query(
    "shrunk_covariance",
    S.with_(
        *FORECAST_SQL, _LIQUID.format(50), _STEPS, _cov("liquid", 104, 10, 0.3), _LW,
        select=f"""SELECT as_of, i AS asset_i, j AS asset_j, n, {r('shrinkage')} AS shrinkage,
          {r('CASE WHEN n < 3 THEN CASE WHEN i = j THEN 1e-6 ELSE 0.0 END ELSE (1.0 - shrinkage) * v + CASE WHEN i = j THEN shrinkage * mu ELSE 0.0 END END', 3)} AS covariance
          FROM matrix""",
    ),
)
def shrunk_covariance(spark, sf_dir):
    m = Market(spark, sf_dir)
    names = risk.liquid_candidates(m.forecasts, "rank_log_traded_value_4w", 50)
    returns = risk.window_returns(names, m.prices, universe.session_calendar(m.prices), 104, 10, 0.3)
    return risk.ledoit_wolf(returns).select(
        "as_of", "asset_i", "asset_j", "n", rounded(F.col("shrinkage")).alias("shrinkage"), rounded(F.col("covariance"), 3).alias("covariance")
    )


@query(
    "inverse_vol_weights",
    S.with_(
        *_COV_SQL,
        select=f"""SELECT as_of, asset_i AS ticker, {r('(1.0 / sqrt(greatest(covariance, 1e-12))) / sum(1.0 / sqrt(greatest(covariance, 1e-12))) OVER (PARTITION BY as_of)')} AS target_weight
          FROM cov WHERE asset_i = asset_j""",
    ),
)
def inverse_vol_weights(spark, sf_dir):
    _, pairs = candidate_covariance(Market(spark, sf_dir))
    return risk.inverse_volatility_weights(pairs).select("as_of", "ticker", rounded(F.col("target_weight")).alias("target_weight"))


@query(
    "weight_caps",
    S.with_(
        *FORECAST_SQL, CANDIDATES,
        "sized AS (SELECT trade_date, ticker, rank_log_traded_value_4w * 100.0 AS liq, count(*) OVER (PARTITION BY trade_date) AS k FROM candidates WHERE alpha_rank <= 10)",
        select=f"SELECT trade_date, ticker, {r('greatest(greatest(0.10, least(0.25, 0.10 + 0.20 * liq / 100.0)), 1.0 / k)')} AS weight_cap FROM sized",
    ),
)
def weight_caps(spark, sf_dir):
    from tidemark.plans.signal_queries import candidates

    chosen = selection.equal_weights(candidates(Market(spark, sf_dir)).filter("alpha_rank <= 10"))
    cap = risk.liquidity_weight_cap(F.col("rank_log_traded_value_4w") * 100.0, 1.0 / F.col("target_weight"))
    return chosen.select("trade_date", "ticker", rounded(cap).alias("weight_cap"))


@query(
    "exposure_breaches",
    S.with_(
        *FORECAST_SQL, CANDIDATES,
        "w AS (SELECT trade_date, sector, issuer_id, 1.0 / count(*) OVER (PARTITION BY trade_date) AS wt FROM candidates WHERE alpha_rank <= 10)",
        "e AS (SELECT trade_date, 'sector' AS kind, sector AS name, sum(wt) AS exposure, 0.4 AS lim FROM w GROUP BY 1, 3 UNION ALL SELECT trade_date, 'issuer', CAST(issuer_id AS VARCHAR), sum(wt), 0.25 FROM w GROUP BY 1, 3)",
        select=f"SELECT trade_date, kind, name, {r('exposure')} AS exposure FROM e WHERE exposure > lim + 1e-9",
    ),
)
def exposure_breaches(spark, sf_dir):
    from tidemark.plans.signal_queries import candidates

    chosen = selection.equal_weights(candidates(Market(spark, sf_dir)).filter("alpha_rank <= 10"))
    return risk.exposure_breaches(chosen).select("trade_date", "kind", "name", rounded(F.col("exposure")).alias("exposure"))


#: Sizes of a basket; each date takes the best.
BASKET_SIZES = range(6, 11)
LAMBDA = 1e-7  # unit prices of this market jump by orders of magnitude
_ALPHA = f"alpha AS (SELECT l.as_of, l.ticker, prediction - {D(.5)} * uncertainty AS alpha, issuer_id, sector FROM liquid l JOIN forecasts f ON f.trade_date = l.as_of AND f.ticker = l.ticker)"


def _alpha(m: Market, names):
    rows = names.withColumn("alpha", F.col("prediction") - 0.5 * F.col("uncertainty"))
    return rows.select("as_of", "ticker", "alpha", "issuer_id", "sector")


@query(
    "basket_utility",
    S.with_(
        *_COV_SQL, _ALPHA,
        """ranked AS (SELECT a.as_of, a.ticker, alpha, row_number() OVER (PARTITION BY a.as_of ORDER BY alpha DESC, a.ticker) AS n
            FROM alpha a JOIN cov c ON c.as_of = a.as_of AND c.asset_i = a.ticker AND c.asset_j = a.ticker WHERE alpha IS NOT NULL)""",
        "baskets AS (SELECT as_of, b AS basket_id, ticker, alpha FROM ranked, (SELECT CAST(unnest([3, 6, 10]) AS INTEGER) AS b) WHERE n <= b)",
        "sized AS (SELECT as_of, basket_id, count(*) AS k, avg(alpha) AS mu FROM baskets GROUP BY 1, 2)",
        """quad AS (SELECT x.as_of, x.basket_id, sum(c.covariance * CASE WHEN x.ticker = y.ticker THEN 1.0 ELSE 2.0 END) AS q FROM baskets x
            JOIN baskets y ON x.as_of = y.as_of AND x.basket_id = y.basket_id AND x.ticker <= y.ticker
            JOIN cov c ON c.as_of = x.as_of AND c.asset_i = x.ticker AND c.asset_j = y.ticker GROUP BY 1, 2)""",
        select=f"SELECT as_of, basket_id, CAST(k AS INTEGER) AS k, {r('mu')} AS mu, {r(f'mu - {LAMBDA} * q * (4 / 52.0) / (k * k)')} AS utility FROM sized JOIN quad USING (as_of, basket_id)",
    ),
)
def basket_utility(spark, sf_dir):
    m = Market(spark, sf_dir)
    names, pairs = candidate_covariance(m)
    known = pairs.filter("asset_i = asset_j").select("as_of", F.col("asset_i").alias("ticker"))
    alpha = _alpha(m, names).filter("alpha IS NOT NULL").join(known, ["as_of", "ticker"], "left_semi")
    ranked = selection.top_per_group(alpha, ["as_of"], [F.col("alpha").desc(), F.col("ticker")], 10, "n")
    sized = ranked.withColumn("basket_id", F.explode(F.array(F.lit(3), F.lit(6), F.lit(10)))).filter("n <= basket_id")
    baskets = sized.groupBy("as_of", "basket_id").agg(F.sort_array(F.collect_list("ticker")).alias("members"))
    scored = basket.basket_utility(baskets, alpha.select("as_of", "ticker", "alpha"), pairs, LAMBDA, 4, 52)
    return scored.select("as_of", "basket_id", "k", rounded(F.col("mu")).alias("mu"), rounded(F.col("utility")).alias("utility"))


@query(
    "basket_exhaustive",
    S.with_(
        *FORECAST_SQL, _LIQUID.format(12), _STEPS, _cov("liquid"), _ALPHA,
        f"lin AS (SELECT a.*, alpha / 3.0 - {LAMBDA} * covariance * (4 / 52.0) / 9.0 AS lin FROM alpha a JOIN cov c ON c.as_of = a.as_of AND c.asset_i = a.ticker AND c.asset_j = a.ticker)",
        f"jo AS (SELECT as_of, asset_i, asset_j, -2.0 * {LAMBDA} * covariance * (4 / 52.0) / 9.0 AS jo FROM cov WHERE asset_i < asset_j)",
        """trip AS (SELECT a.as_of, a.ticker AS t1, b.ticker AS t2, c.ticker AS t3, a.lin + b.lin + c.lin + x.jo + y.jo + z.jo AS u FROM lin a
          JOIN lin b ON b.as_of = a.as_of AND b.ticker > a.ticker JOIN lin c ON c.as_of = a.as_of AND c.ticker > b.ticker
          JOIN jo x ON x.as_of = a.as_of AND x.asset_i = a.ticker AND x.asset_j = b.ticker
          JOIN jo y ON y.as_of = a.as_of AND y.asset_i = a.ticker AND y.asset_j = c.ticker
          JOIN jo z ON z.as_of = a.as_of AND z.asset_i = b.ticker AND z.asset_j = c.ticker
          WHERE a.sector <> b.sector AND a.sector <> c.sector AND b.sector <> c.sector AND a.issuer_id <> b.issuer_id AND a.issuer_id <> c.issuer_id AND b.issuer_id <> c.issuer_id)""",
        select=f"SELECT as_of, {r('max(u)')} AS utility FROM trip WHERE u IS NOT NULL GROUP BY 1",
    ),
)
def basket_exhaustive(spark, sf_dir):
    m = Market(spark, sf_dir)
    names, pairs = candidate_covariance(m, 12)
    best = basket.basket_beam(_alpha(m, names), pairs, 3, LAMBDA, 4, None, 0.40, 52)
    return best.select("as_of", rounded(F.col("utility")).alias("utility"))


@query(
    "basket_exact",
    S.with_(
        *FORECAST_SQL, _LIQUID.format(12), _STEPS, _cov("liquid"), _ALPHA,
        f"lin AS (SELECT a.*, alpha / 4.0 - {LAMBDA} * covariance * (4 / 52.0) / 16.0 AS lin FROM alpha a JOIN cov c ON c.as_of = a.as_of AND c.asset_i = a.ticker AND c.asset_j = a.ticker WHERE alpha IS NOT NULL)",
        f"jo AS (SELECT as_of, asset_i, asset_j, -2.0 * {LAMBDA} * covariance * (4 / 52.0) / 16.0 AS jo FROM cov WHERE asset_i < asset_j)",
        """duo AS (SELECT a.as_of, a.ticker AS t1, b.ticker AS t2, a.sector AS s1, b.sector AS s2, a.issuer_id AS i1, b.issuer_id AS i2, a.lin + b.lin + x.jo AS u
          FROM lin a JOIN lin b ON b.as_of = a.as_of AND b.ticker > a.ticker AND a.sector <> b.sector AND a.issuer_id <> b.issuer_id
          JOIN jo x ON x.as_of = a.as_of AND x.asset_i = a.ticker AND x.asset_j = b.ticker)""",
        """four AS (SELECT p.as_of, p.t1, p.t2, q.t1 AS t3, q.t2 AS t4, p.u + q.u + w.jo + x.jo + y.jo + z.jo AS u FROM duo p
          JOIN duo q ON q.as_of = p.as_of AND q.t1 > p.t2 AND q.s1 NOT IN (p.s1, p.s2) AND q.s2 NOT IN (p.s1, p.s2) AND q.i1 NOT IN (p.i1, p.i2) AND q.i2 NOT IN (p.i1, p.i2)
          JOIN jo w ON w.as_of = p.as_of AND w.asset_i = p.t1 AND w.asset_j = q.t1 JOIN jo x ON x.as_of = p.as_of AND x.asset_i = p.t1 AND x.asset_j = q.t2
          JOIN jo y ON y.as_of = p.as_of AND y.asset_i = p.t2 AND y.asset_j = q.t1 JOIN jo z ON z.as_of = p.as_of AND z.asset_i = p.t2 AND z.asset_j = q.t2)""",
        "best AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY u DESC, t1, t2, t3, t4) AS n FROM four WHERE u IS NOT NULL)",
        select=f"SELECT as_of, t1 || ',' || t2 || ',' || t3 || ',' || t4 AS members, {r('u')} AS utility FROM best WHERE n = 1",
    ),
)
def basket_exact(spark, sf_dir):
    """The best four of twelve candidates of each date, by growth with a bound; the twin tries all."""
    m = Market(spark, sf_dir)
    names, pairs = candidate_covariance(m, 12)
    alpha = cut_lineage(_alpha(m, names).filter("alpha IS NOT NULL"))
    best = basket.basket_best(alpha, cut_lineage(pairs), 4, LAMBDA, 4, 0.40, 52)
    return best.select("as_of", F.array_join("members", ",").alias("members"), rounded(F.col("utility")).alias("utility"))


@query("basket_beam")
def basket_beam(spark, sf_dir):
    """The best basket of 6 to 10 names among the candidates of each date; the search is exact, the name has stayed."""
    m = Market(spark, sf_dir)
    names, pairs = candidate_covariance(m, 30)
    alpha = cut_lineage(_alpha(m, names))
    pairs = cut_lineage(pairs)
    found = [basket.basket_best(alpha, pairs, k, LAMBDA, 4, sector_share=0.40, bars_per_year=52) for k in BASKET_SIZES]
    best = selection.top_per_group(reduce(DataFrame.unionByName, found), ["as_of"], [F.col("utility").desc(), F.col("k")], 1)
    return best.select("as_of", "k", F.array_join("members", ",").alias("members"), rounded(F.col("utility")).alias("utility"), "search")
