"""Queries over market state, coverage, drift, coefficients and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import diagnostics, evaluation, folds, quality, regime
from tidemark.plans import market_sql as S
from tidemark.plans.filings_queries import _MACRO
from tidemark.plans.market import WEEKLY, Market
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import CANDIDATES, FORECAST_SQL, candidates

r = S.r
D = S._D

_REGIME_SQL = """days AS (
    SELECT trade_date, avg(ret_1w) AS m1, avg(return_4w) AS m4, avg(return_12w) AS m12,
      avg(CASE WHEN ret_1w > 0 THEN 1.0 WHEN ret_1w IS NOT NULL THEN 0.0 END) AS breadth, stddev_samp(ret_1w) AS dispersion FROM panel GROUP BY 1),
  state AS (SELECT *, CASE WHEN count(m1) OVER w4 = 4 THEN stddev_samp(m1) OVER w4 END AS vol,
      CASE WHEN m1 IS NOT NULL THEN sum(ln(1.0 + m1)) OVER (ORDER BY trade_date) END AS log_index FROM days
      WINDOW w4 AS (ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
  regime AS (SELECT *, exp(log_index - max(log_index) OVER (ORDER BY trade_date)) - 1.0 AS drawdown FROM state)"""
_REGIME_COLS = {
    "regime_market_return": "m1", "regime_market_return_month": "m4", "regime_market_return_quarter": "m12", "regime_breadth": "breadth",
    "regime_dispersion": "dispersion", "regime_realized_vol": "vol", "regime_drawdown": "drawdown",
}


@query(
    "market_regime",
    S.with_(S.PRICES, S.PANEL, _REGIME_SQL, select="SELECT trade_date, " + ", ".join(f"{r(v)} AS {k}" for k, v in _REGIME_COLS.items()) + " FROM regime"),
)
def market_regime(spark, sf_dir):
    rows = regime.market_regime(Market(spark, sf_dir).unranked, WEEKLY)
    return rows.select("trade_date", *[rounded(F.col(c)).alias(c) for c in _REGIME_COLS])


@query(
    "regime_interactions",
    S.with_(
        S.PRICES, S.PANEL, _REGIME_SQL, _MACRO,
        """rated AS (SELECT g.trade_date, g.vol, m.value AS rate FROM regime g
            ASOF LEFT JOIN (SELECT date + 1 AS available, value FROM macro) m ON g.trade_date >= m.available)""",
        select=f"""SELECT ticker, p.trade_date, {r('rate')} AS regime_rate, {r('momentum_12_1 * vol')} AS regime_momentum_x_vol,
          {r('volatility_12w * vol')} AS regime_volatility_x_vol FROM panel p LEFT JOIN rated USING (trade_date)""",
    ),
)
def regime_interactions(spark, sf_dir):
    m = Market(spark, sf_dir)
    state = regime.attach_rate(regime.market_regime(m.unranked, WEEKLY), m.macro, 1)
    rows = regime.attach_regime(m.unranked, state, WEEKLY)
    return rows.select(
        "ticker", "trade_date", *[rounded(F.col(c)).alias(c) for c in ("regime_rate", "regime_momentum_x_vol", "regime_volatility_x_vol")]
    )


_COVERED = ["return_4w", "return_52w", "volatility_12w", "momentum_12_1", "amihud_illiquidity_4w"]


@query(
    "feature_coverage",
    S.with_(
        S.PRICES, S.PANEL,
        select=" UNION ALL ".join(
            f"SELECT CAST(year(trade_date) AS INTEGER) AS year, '{c}' AS feature, {r(f'count({c}) / CAST(count(*) AS DOUBLE)')} AS coverage FROM panel GROUP BY 1" for c in _COVERED
        ),
    ),
)
def feature_coverage(spark, sf_dir):
    rows = diagnostics.feature_coverage(Market(spark, sf_dir).unranked, _COVERED, [F.year("trade_date").alias("year")])
    return rows.select("year", "feature", rounded(F.col("coverage")).alias("coverage"))


def _gate_sql(c: str) -> str:
    need, dates = ("0.8", "0.8") if c in ("return_4w", "return_52w") else ("0.6", "0.6")
    return f"""SELECT '{c}' AS feature, {r('coverage')} AS coverage, {r('share')} AS date_share, coverage >= {need} AND share >= {dates} AS enabled FROM (
      SELECT sum(n) / CAST(sum(total) AS DOUBLE) AS coverage, avg(CASE WHEN n / CAST(total AS DOUBLE) >= {need} THEN 1.0 ELSE 0.0 END) AS share
      FROM (SELECT trade_date, count({c}) AS n, count(*) AS total FROM panel WHERE trade_date < DATE '2000-01-01' GROUP BY 1))"""


@query("feature_gate", S.with_(S.PRICES, S.PANEL, select=" UNION ALL ".join(_gate_sql(c) for c in _COVERED)))
def feature_gate(spark, sf_dir):
    train = Market(spark, sf_dir).unranked.filter("trade_date < DATE '2000-01-01'")
    rows = diagnostics.feature_gate(train, _COVERED, ["return_4w", "return_52w"])
    return rows.select("feature", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("date_share")).alias("date_share"), "enabled")


_DRIFT = ["log_traded_value_4w", "log_trades_4w", "ret_1w"]
_A, _B = (1996, 1998), (1999, 2001)
_LONG = "samples AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN year(trade_date) BETWEEN 1996 AND 1998 THEN 'a' ELSE 'b' END AS regime, {c} AS x FROM panel WHERE year(trade_date) BETWEEN 1996 AND 2001"
    for c in _DRIFT
) + ")"
_SPOTS = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


@query(
    "drift_moments",
    S.with_(
        S.PRICES, S.PANEL, _LONG,
        select=f"SELECT feature, regime, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std, {r('1.0 - count(x) / CAST(count(*) AS DOUBLE)')} AS missingness, "
        + ", ".join(f"{r(f'quantile_cont(x, {p})')} AS {n}" for n, p in _SPOTS.items()) + " FROM samples GROUP BY 1, 2",
    ),
)
def drift_moments(spark, sf_dir):
    # No bound is proven for the rows of a feature, so the exact quantiles take the banded way.
    rows = diagnostics.drift_moments(Market(spark, sf_dir).unranked, _DRIFT, _A, _B)
    names = ["mean", "std", "missingness", *_SPOTS]
    return rows.select("feature", "regime", *[rounded(F.col(c)).alias(c) for c in names])


_EDGES = "edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM samples WHERE regime = 'a' AND x IS NOT NULL GROUP BY 1)"


@query(
    "psi",
    S.with_(
        S.PRICES, S.PANEL, _LONG, _EDGES,
        "binned AS (SELECT s.feature, regime, len(list_filter(e[2:len(e) - 1], lambda c: c <= x)) AS bin, len(e) AS n_edges FROM samples s JOIN edges USING (feature) WHERE x IS NOT NULL)",
        """counts AS (SELECT e.feature, b.bin, (SELECT count(*) FROM binned x WHERE x.feature = e.feature AND x.bin = b.bin AND regime = 'a') AS a,
            (SELECT count(*) FROM binned x WHERE x.feature = e.feature AND x.bin = b.bin AND regime = 'b') AS b,
            (SELECT count(*) FROM binned x WHERE x.feature = e.feature AND regime = 'a') AS ta, (SELECT count(*) FROM binned x WHERE x.feature = e.feature AND regime = 'b') AS tb
            FROM edges e, (SELECT unnest(range(0, 10)) AS bin) b WHERE b.bin <= len(e.e) - 2)""",
        "shares AS (SELECT feature, greatest(a / CAST(ta AS DOUBLE), 1e-6) AS pa, greatest(b / CAST(tb AS DOUBLE), 1e-6) AS pb FROM counts)",
        select=f"SELECT feature, {r('sum((pb - pa) * ln(pb / pa))')} AS psi FROM shares GROUP BY 1",
    ),
)
def psi(spark, sf_dir):
    rows = diagnostics.stability_index(Market(spark, sf_dir).unranked, _DRIFT, _A, _B)
    return rows.select("feature", rounded(F.col("psi")).alias("psi"))


@query(
    "ks_wasserstein",
    S.with_(
        S.PRICES, S.PANEL, _LONG,
        """steps AS (SELECT feature, x, count(*) FILTER (WHERE regime = 'a') AS a, count(*) FILTER (WHERE regime = 'b') AS b FROM samples WHERE x IS NOT NULL GROUP BY 1, 2),
        cdf AS (SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS next_x,
            abs(sum(a) OVER (PARTITION BY feature ORDER BY x) / CAST(sum(a) OVER (PARTITION BY feature) AS DOUBLE)
              - sum(b) OVER (PARTITION BY feature ORDER BY x) / CAST(sum(b) OVER (PARTITION BY feature) AS DOUBLE)) AS gap FROM steps)""",
        select=f"SELECT feature, {r('max(gap)')} AS ks_statistic, {r('sum(gap * (next_x - x))')} AS wasserstein FROM cdf GROUP BY 1",
    ),
)
def ks_wasserstein(spark, sf_dir):
    rows = diagnostics.distribution_distances(Market(spark, sf_dir).unranked, _DRIFT, _A, _B)
    return rows.select("feature", rounded(F.col("ks_statistic")).alias("ks_statistic"), rounded(F.col("wasserstein")).alias("wasserstein"))


_IC_FEATURES = ["return_4w", "return_12w", "momentum_12_1", "volatility_12w", "log_traded_value_4w", "amihud_illiquidity_4w", "short_term_reversal_2w"]
_INV = [S.PRICES, S.PANEL, S.ISSUERS, S.UNIVERSE, S.INVESTIBLE]
_IC = [
    "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, trade_date, {c} AS x, target_excess_return AS y FROM investible" for c in _IC_FEATURES) + ")",
    f"""ranked AS (SELECT feature, trade_date, {S.avg_rank('x', 'trade_date, feature', None)} AS rx, {S.avg_rank('y', 'trade_date, feature', None)} AS ry
      FROM long WHERE x IS NOT NULL AND y IS NOT NULL)""",
    "ic AS (SELECT trade_date, feature, corr(rx, ry) AS ic, count(*) AS pairs FROM ranked GROUP BY 1, 2 HAVING count(*) >= 10)",
]


@query("monthly_ic", S.with_(*_INV, *_IC, select=f"SELECT trade_date, feature, {r('ic')} AS ic, pairs FROM ic"))
def monthly_ic(spark, sf_dir):
    m = Market(spark, sf_dir)
    ic = diagnostics.monthly_ic(m.eligible, _IC_FEATURES, group_bound=m.cross_section)
    return ic.select("trade_date", "feature", rounded(F.col("ic")).alias("ic"), "pairs")


@query(
    "ic_report",
    S.with_(
        *_INV, *_IC,
        "yearly AS (SELECT feature, CAST(year(trade_date) AS INTEGER) AS year, avg(ic) AS m, quantile_cont(ic, 0.5) AS med, stddev_samp(ic) AS s, count(*) AS months FROM ic GROUP BY 1, 2)",
        select=f"SELECT feature, year, months, {r('m')} AS ic_mean, {r('med')} AS ic_median, {r('s')} AS ic_std, {r('m / s')} AS icir, {r('m / (s / sqrt(months))')} AS ic_tstat FROM yearly",
    ),
)
def ic_report(spark, sf_dir):
    m = Market(spark, sf_dir)
    yearly = diagnostics.ic_by_year(diagnostics.monthly_ic(m.eligible, _IC_FEATURES, group_bound=m.cross_section))
    return yearly.select(
        "feature", "year", "months", *[rounded(F.col(c)).alias(c) for c in ("ic_mean", "ic_median", "ic_std", "icir", "ic_tstat")]
    )


@query(
    "ic_regimes",
    S.with_(
        *_INV, *_IC,
        """spans AS (SELECT feature, avg(CASE WHEN year(trade_date) BETWEEN 1996 AND 1998 THEN ic END) AS a,
            avg(CASE WHEN year(trade_date) BETWEEN 1999 AND 2001 THEN ic END) AS b FROM ic GROUP BY 1)""",
        select=f"""SELECT feature, {r('a')} AS ic_a, {r('b')} AS ic_b, CASE WHEN sign(a) <> sign(b) THEN 'sign_flip' WHEN b - a > 0.02 THEN 'gained_relevance'
          WHEN b - a < -0.02 THEN 'deteriorated' WHEN abs(a) < 0.02 AND abs(b) < 0.02 THEN 'never_material' ELSE 'stable' END AS classification FROM spans""",
    ),
)
def ic_regimes(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = diagnostics.ic_regimes(diagnostics.monthly_ic(m.eligible, _IC_FEATURES, group_bound=m.cross_section), _A, _B)
    return rows.select("feature", rounded(F.col("ic_a")).alias("ic_a"), rounded(F.col("ic_b")).alias("ic_b"), "classification")


@query(
    "monthly_ic_summary",
    S.with_(
        *_INV, *_IC,
        "s AS (SELECT feature, avg(ic) AS m, stddev_samp(ic) AS sd, count(*) AS months, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM ic GROUP BY 1)",
        select=f"SELECT feature, months, {r('m')} AS ic_mean, {r('sd / sqrt(months)')} AS ic_se, {r('m / (sd / sqrt(months))')} AS ic_tstat, {r('m / sd')} AS information_ratio, {r('hit')} AS hit_rate FROM s",
    ),
)
def monthly_ic_summary(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = diagnostics.ic_summary(diagnostics.monthly_ic(m.eligible, _IC_FEATURES, group_bound=m.cross_section))
    return rows.select("feature", "months", *[rounded(F.col(c)).alias(c) for c in ("ic_mean", "ic_se", "ic_tstat", "information_ratio", "hit_rate")])


EVAL_SQL = [
    f"""ev AS (SELECT trade_date, ticker, prediction AS p, target_excess_return AS y FROM forecasts WHERE prediction IS NOT NULL AND target_excess_return IS NOT NULL)""",
    f"""evr AS (SELECT *, {S.avg_rank('p', 'trade_date', None)} AS rp, {S.avg_rank('y', 'trade_date', None)} AS ry, count(*) OVER (PARTITION BY trade_date) AS n,
      row_number() OVER (PARTITION BY trade_date ORDER BY p, ticker) AS place FROM ev)""",
    """xs AS (SELECT trade_date, corr(rp, ry) AS rank_ic, avg(CASE WHEN place > n - greatest(1, n // 10) THEN y END) AS top, avg(CASE WHEN place <= greatest(1, n // 10) THEN y END) AS bottom,
      avg(CASE WHEN (y > 0) = (p > 0) THEN 1.0 ELSE 0.0 END) AS hit FROM evr GROUP BY 1 HAVING count(*) >= 10)""",
]


@query(
    "xs_metrics",
    S.with_(*FORECAST_SQL, *EVAL_SQL, select=f"SELECT trade_date, {r('rank_ic')} AS rank_ic, {r('top')} AS top_decile_mean, {r('bottom')} AS bottom_decile_mean, {r('top - bottom')} AS top_minus_bottom, {r('hit')} AS hit_rate FROM xs"),
)
def xs_metrics(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = evaluation.cross_section_metrics(m.forecasts, group_bound=m.cross_section)
    return rows.select("trade_date", *[rounded(F.col(c)).alias(c) for c in evaluation.METRICS])


@query(
    "xs_metrics_by_year",
    S.with_(*FORECAST_SQL, *EVAL_SQL, select=f"SELECT CAST(year(trade_date) AS INTEGER) AS year, count(*) AS dates, {r('avg(rank_ic)')} AS rank_ic, {r('avg(top - bottom)')} AS top_minus_bottom, {r('avg(hit)')} AS hit_rate FROM xs GROUP BY 1"),
)
def xs_metrics_by_year(spark, sf_dir):
    m = Market(spark, sf_dir)
    per_date = evaluation.cross_section_metrics(m.forecasts, group_bound=m.cross_section)
    rows = evaluation.average_metrics(per_date, [F.year("trade_date").alias("year")])
    return rows.select("year", "dates", *[rounded(F.col(c)).alias(c) for c in ("rank_ic", "top_minus_bottom", "hit_rate")])


TOPK_SQL = [
    """placed AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY p DESC, ticker) AS best, row_number() OVER (PARTITION BY trade_date ORDER BY p, ticker) AS worst,
      row_number() OVER (PARTITION BY trade_date ORDER BY y DESC, ticker) AS truth, count(*) OVER (PARTITION BY trade_date) AS n, avg(y) OVER (PARTITION BY trade_date) AS universe FROM ev)""",
    "ks AS (SELECT CAST(unnest([5, 10, 20, 30, 50]) AS INTEGER) AS k)",
    """topk AS (SELECT trade_date, k, count(*) FILTER (WHERE best <= k AND truth <= k) / CAST(k AS DOUBLE) AS precision,
      sum(CASE WHEN best <= k AND truth <= k THEN 1.0 / log2(best + 1.0) ELSE 0.0 END) / sum(CASE WHEN best <= k THEN 1.0 / log2(best + 1.0) END) AS ndcg,
      avg(CASE WHEN best <= k THEN y END) AS top_mean, quantile_cont(CASE WHEN best <= k THEN y END, 0.5) AS top_median,
      avg(CASE WHEN best <= k THEN CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END END) AS hit, avg(CASE WHEN worst <= k THEN y END) AS bottom_mean, max(universe) AS universe
      FROM placed, ks WHERE n >= greatest(3, k) GROUP BY 1, 2)""",
]
_TOPK_OUT = {
    "precision": "precision", "recall": "precision", "ndcg": "ndcg", "mean_future_return": "top_mean", "median_future_return": "top_median", "hit_rate": "hit",
    "top_minus_universe": "top_mean - universe", "top_minus_bottom": "top_mean - bottom_mean",
}


@query("topk_metrics", S.with_(*FORECAST_SQL, *EVAL_SQL, *TOPK_SQL, select="SELECT trade_date, k, " + ", ".join(f"{r(v)} AS {c}" for c, v in _TOPK_OUT.items()) + " FROM topk"))
def topk_metrics(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = evaluation.topk_metrics(m.forecasts, group_bound=m.cross_section)
    return rows.select("trade_date", "k", *[rounded(F.col(c)).alias(c) for c in _TOPK_OUT])


@query(
    "topk_by_year",
    S.with_(*FORECAST_SQL, *EVAL_SQL, *TOPK_SQL, select="SELECT CAST(year(trade_date) AS INTEGER) AS year, k, " + ", ".join(f"{r(f'avg({v})')} AS {c}" for c, v in _TOPK_OUT.items()) + ", count(*) AS dates FROM topk GROUP BY 1, 2"),
)
def topk_by_year(spark, sf_dir):
    rows = evaluation.average_metrics(
        evaluation.topk_metrics(Market(spark, sf_dir).forecasts), [F.year("trade_date").alias("year"), "k"], evaluation.TOPK_METRICS
    )
    return rows.select("year", "k", "dates", *[rounded(F.col(c)).alias(c) for c in _TOPK_OUT])


@query(
    "prefilter_recall",
    S.with_(
        *FORECAST_SQL, *EVAL_SQL, CANDIDATES,
        "best AS (SELECT * FROM (SELECT trade_date, ticker, row_number() OVER (PARTITION BY trade_date ORDER BY target_excess_return DESC, ticker) AS n, count(*) OVER (PARTITION BY trade_date) AS total FROM forecasts WHERE target_excess_return IS NOT NULL) WHERE n <= 10 AND total >= 10)",
        select=f"SELECT b.trade_date, {r('count(c.ticker) / CAST(count(*) AS DOUBLE)')} AS recall FROM best b LEFT JOIN candidates c ON c.trade_date = b.trade_date AND c.ticker = b.ticker GROUP BY 1",
    ),
)
def prefilter_recall(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = evaluation.prefilter_recall(m.forecasts, candidates(m), "target_excess_return")
    return rows.select("trade_date", rounded(F.col("recall")).alias("recall"))


@query(
    "sample_weights",
    S.with_(
        *_INV,
        """w AS (SELECT trade_date, ticker, 1.0 / ((SELECT count(DISTINCT issuer_id) FROM investible i WHERE i.trade_date = o.trade_date) * count(*) OVER (PARTITION BY trade_date, issuer_id)) AS base,
            exp(-ln(2.0) * (date_diff('day', trade_date, DATE '2002-01-01') / CAST(365.25 AS DOUBLE)) / 2.0) AS decay,
            CASE WHEN target_excess_return IS NOT NULL THEN least(4, CAST(floor((""" + S.avg_rank("target_excess_return", "trade_date", "all") + """) * 5) AS INTEGER)) END AS relevance
          FROM investible o)""",
        select=f"SELECT trade_date, ticker, {r('base / avg(base) OVER ()')} AS sample_weight, {r('decay / avg(decay) OVER ()')} AS recency_weight, relevance FROM w",
    ),
)
def sample_weights(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = evaluation.issuer_balanced_weights(m.investible)
    rows = evaluation.recency_weights(rows, "2002-01-01", 2.0)
    rows = evaluation.relevance_levels(rows, "target_excess_return", group_bound=m.cross_section)
    return rows.select(
        "trade_date", "ticker", rounded(F.col("sample_weight")).alias("sample_weight"), rounded(F.col("recency_weight")).alias("recency_weight"), "relevance"
    )


_YEARS = (1998, 1999, 2000, 2001)


@query(
    "purged_folds",
    S.with_(
        S.PRICES, S.PANEL, S.UNIVERSE, S.ISSUERS, S.INVESTIBLE,
        "f AS (SELECT CAST(unnest([1998, 1999, 2000, 2001]) AS INTEGER) AS fold_year)",
        """tagged AS (SELECT i.*, fold_year, CASE WHEN year(trade_date) = fold_year THEN 'valid'
            WHEN year(trade_date) < fold_year AND year(trade_date) >= fold_year - 3 AND target_end_date < make_date(fold_year, 1, 1) - 7 THEN 'train' END AS role FROM investible i, f)""",
        select="""SELECT fold_year, count(*) FILTER (WHERE role = 'train') AS train_rows, count(*) FILTER (WHERE role = 'valid') AS valid_rows,
          max(target_end_date) FILTER (WHERE role = 'train') AS last_train_label, min(trade_date) FILTER (WHERE role = 'valid') AS first_valid_date
          FROM tagged GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'train') >= 500 AND count(*) FILTER (WHERE role = 'valid') >= 100""",
    ),
)
def purged_folds(spark, sf_dir):
    return folds.usable_folds(folds.year_folds(Market(spark, sf_dir).investible, _YEARS, rolling_years=3, embargo_days=7))


@query(
    "embargoed_training",
    S.with_(
        S.PRICES, S.PANEL,
        select="""SELECT trade_date, count(*) AS rows FROM panel WHERE (target_end_date < DATE '1999-01-01' - 14 OR trade_date > DATE '1999-12-31')
          AND NOT (trade_date > DATE '1999-12-31' AND trade_date <= DATE '1999-12-31' + 30) GROUP BY 1""",
    ),
)
def embargoed_training(spark, sf_dir):
    panel = Market(spark, sf_dir).unranked
    before = folds.purge_overlapping(panel, "1999-01-01", 14)
    after = panel.filter("trade_date > DATE '1999-12-31'")
    rows = folds.embargo_after(before.unionByName(after), "1999-12-31", 30)
    return rows.groupBy("trade_date").agg(F.count("*").alias("rows"))


@query(
    "temporal_split_check",
    S.with_(
        S.PRICES, S.PANEL,
        select="""SELECT max(trade_date) AS train_last, max(target_end_date) AS label_last, DATE '1999-01-04' AS evaluation_first FROM panel WHERE trade_date < DATE '1999-01-01'""",
    ),
)
def temporal_split_check(spark, sf_dir):
    panel = Market(spark, sf_dir).unranked
    train, evaluation_rows = panel.filter("trade_date < DATE '1999-01-01'"), panel.filter("trade_date >= DATE '1999-01-01'")
    return quality.split_violations(train, evaluation_rows, label_end="target_end_date")


@query(
    "finite_signals",
    """SELECT event_type, count(*) AS bad_rows FROM events WHERE value IS NULL OR value <= 0 OR event_id % 10 IN (0, 1, 2) GROUP BY 1""",
)
def finite_signals(spark, sf_dir):
    # Every kind of bad number: null, not a number, infinite.
    turn = F.col("event_id") % 10
    scores = Market(spark, sf_dir).table("events").withColumn(
        "score", F.when(turn == 0, F.lit(None)).when(turn == 1, float("nan")).when(turn == 2, float("inf")).when(F.col("value") > 0, F.log("value"))
    )
    return quality.not_finite(scores, "score").groupBy("event_type").agg(F.count("*").alias("bad_rows"))
