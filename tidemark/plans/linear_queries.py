"""The linear branch over all folds, policies, targets and penalties, held against normal equations in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import calibration, evaluation, learning, linear
from tidemark.plans import market_sql as S
from tidemark.plans.learning_queries import FEATURES, panel_years, training_panel
from tidemark.plans.market import Market
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

r = S.r
MIN_TRAIN, MIN_VALID = 100, 20
#: Penalties that the nested search chooses among.
ALPHAS = (0.1, 1.0, 10.0, 100.0)
INNER_YEARS = 3
TARGETS = ("target_excess_return", "target_cross_sectional_rank")
EXPANDING = learning.TrainingPolicy()

_TERMS = [*FEATURES, *[f"missing_{f}" for f in FEATURES]]


def _double(v: float) -> str:
    return f"CAST({v} AS DOUBLE)"


def models_sql(policies, alphas=(learning.RIDGE_ALPHA,), targets=("target_excess_return",)) -> list[str]:
    """CTEs from the panel to `solved`: the training rows of every fold spelled out, standardised term by term, and the
    normal equations eliminated row by row."""
    grid = ", ".join(f"('{p.name}', {p.window_years or 'NULL'}, {_double(p.half_life_years) if p.half_life_years else 'NULL'})" for p in policies)
    clean = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    medians = ", ".join(f"quantile_cont({f}, 0.5) AS {f}" for f in FEATURES)
    cells = [f"SELECT policy, fold, rid, base, {i} AS pos, coalesce(t.{f}, m.{f}, 0.0) AS v FROM weighted t JOIN medians m USING (policy, fold)" for i, f in enumerate(FEATURES)]
    cells += [f"SELECT policy, fold, rid, base, {len(FEATURES) + i}, CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END FROM weighted" for i, f in enumerate(FEATURES)]
    goals = " UNION ALL ".join(f"SELECT policy, fold, rid, '{t}' AS target, {t} AS y FROM weighted" for t in targets)
    return [
        f"""rows_ AS (SELECT trade_date, ticker, issuer_id, target_end_date, target_excess_return, target_cross_sectional_rank, {clean}, row_number() OVER (ORDER BY trade_date, ticker) AS rid
          FROM investible WHERE target_excess_return IS NOT NULL)""",
        f"policies AS (SELECT * FROM (VALUES {grid}) p(policy, years_back, half_life))",
        "folds AS (SELECT DISTINCT CAST(year(trade_date) AS INTEGER) AS fold FROM rows_)",
        """train AS (SELECT policy, fold, half_life, rows_.* FROM rows_, policies, folds
          WHERE year(trade_date) < fold AND target_end_date < make_date(fold, 1, 1) AND (years_back IS NULL OR year(trade_date) >= fold - years_back)
          QUALIFY count(*) OVER (PARTITION BY policy, fold) >= %d)""" % MIN_TRAIN,
        f"medians AS (SELECT policy, fold, {medians} FROM train GROUP BY 1, 2)",
        """owners AS (SELECT policy, fold, trade_date, issuer_id, count(*) AS classes FROM train GROUP BY 1, 2, 3, 4)""",
        """per_date AS (SELECT policy, fold, trade_date, count(*) AS issuers FROM owners GROUP BY 1, 2, 3)""",
        """raw_weights AS (SELECT train.*, coalesce(exp(-ln(2.0) * (make_date(fold, 1, 1) - trade_date) / 365.25 / half_life), 1.0) / (issuers * classes) AS u
          FROM train JOIN owners USING (policy, fold, trade_date, issuer_id) JOIN per_date USING (policy, fold, trade_date))""",
        "weighted AS (SELECT *, u / avg(u) OVER (PARTITION BY policy, fold) AS base FROM raw_weights)",
        "cells AS (" + " UNION ALL ".join(cells) + ")",
        """moments AS (SELECT policy, fold, pos, avg(v) AS mean, stddev_pop(v) AS scale, sum(base * v) / sum(base) AS centre, count(*) AS n
          FROM cells GROUP BY 1, 2, 3 HAVING stddev_pop(v) > 1e-9)""",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY policy, fold ORDER BY pos) AS slot FROM moments)",
        "scaled AS (SELECT policy, fold, rid, base, slot, (v - centre) / scale AS z FROM cells JOIN numbered USING (policy, fold, pos))",
        f"goals AS ({goals})",
        "products AS (SELECT policy, fold, a.slot AS i, b.slot AS j, sum(a.base * a.z * b.z) AS g FROM scaled a JOIN scaled b USING (policy, fold, rid) GROUP BY 1, 2, 3, 4)",
        "goal_means AS (SELECT policy, fold, target, sum(base * y) / sum(base) AS centre FROM goals JOIN weighted USING (policy, fold, rid) GROUP BY 1, 2, 3)",
        "rights AS (SELECT policy, fold, target, slot AS i, sum(base * z * (y - centre)) AS b FROM scaled JOIN goals USING (policy, fold, rid) JOIN goal_means USING (policy, fold, target) GROUP BY 1, 2, 3, 4)",
        f"penalties AS (SELECT unnest([{', '.join(_double(a) for a in alphas)}]) AS alpha)",
        """lines AS (SELECT policy, fold, i, list(g ORDER BY j) AS line FROM products GROUP BY 1, 2, 3)""",
        """start AS (SELECT policy, fold, target, alpha, list(list_append(list_transform(line, lambda v, k: v + CASE WHEN k = i THEN alpha ELSE 0.0 END), b) ORDER BY i) AS m
          FROM lines JOIN rights USING (policy, fold, i), penalties GROUP BY 1, 2, 3, 4)""",
        """steps AS (SELECT policy, fold, target, alpha, 1 AS k, len(m) AS n, m FROM start
          UNION ALL
          SELECT policy, fold, target, alpha, k + 1, n, list_transform(m, lambda line, i: CASE WHEN i = k
            THEN list_transform(m[k], lambda v: v / m[k][k])
            ELSE list_transform(line, lambda v, j: v - line[k] * m[k][j] / m[k][k]) END) FROM steps WHERE k <= n)""",
        """solved AS (SELECT policy, target, alpha, fold, slot, m[slot][steps.n + 1] AS coefficient FROM steps JOIN numbered USING (policy, fold) WHERE k = steps.n + 1)""",
    ]


_SCORED = [
    """valid AS (SELECT * FROM (SELECT *, CAST(year(trade_date) AS INTEGER) AS fold FROM rows_) QUALIFY count(*) OVER (PARTITION BY fold) >= %d)""" % MIN_VALID,
    "valid_cells AS ("
    + " UNION ALL ".join(
        [f"SELECT policy, fold, rid, {i} AS pos, coalesce(v.{f}, m.{f}, 0.0) AS v FROM valid v JOIN medians m USING (fold)" for i, f in enumerate(FEATURES)]
        + [f"SELECT policy, fold, rid, {len(FEATURES) + i}, CASE WHEN v.{f} IS NULL THEN 1.0 ELSE 0.0 END FROM valid v JOIN medians m USING (fold)" for i, f in enumerate(FEATURES)]
    )
    + ")",
    f"""predicted AS (SELECT policy, target, alpha, fold, rid, {r('any_value(g.centre) + sum(coefficient * (v - numbered.centre) / scale)', 9)} AS p
      FROM valid_cells JOIN numbered USING (policy, fold, pos) JOIN solved USING (policy, fold, slot) JOIN goal_means g USING (policy, fold, target) GROUP BY 1, 2, 3, 4, 5)""",
    "judged AS (SELECT policy, target, alpha, fold, trade_date, ticker, p, target_excess_return AS y FROM predicted JOIN valid USING (fold, rid))",
    f"""placed AS (SELECT *, {S.avg_rank('p', 'policy, target, alpha, fold, trade_date', None)} AS rp, {S.avg_rank('y', 'policy, target, alpha, fold, trade_date', None)} AS ry,
      row_number() OVER (PARTITION BY policy, target, alpha, fold, trade_date ORDER BY p, ticker) AS place, count(*) OVER (PARTITION BY policy, target, alpha, fold, trade_date) AS n FROM judged)""",
    """daily AS (SELECT policy, target, alpha, fold, trade_date, corr(rp, ry) AS ic, avg(y) FILTER (place > n - greatest(1, n // 10)) - avg(y) FILTER (place <= greatest(1, n // 10)) AS spread
      FROM placed GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 10 AND NOT isnan(corr(rp, ry)))""",
    "yearly AS (SELECT policy, target, alpha, fold AS fold_year, avg(ic) AS rank_ic, avg(spread) AS spread, count(*) AS dates FROM daily GROUP BY 1, 2, 3, 4)",
]
_PANEL = [S.PRICES, S.PANEL, S.ISSUERS, S.UNIVERSE, S.INVESTIBLE]


def _with(*parts: str, select: str) -> str:
    return S.with_(*parts, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


def yearly_metrics(m: Market, policies, alphas=(learning.RIDGE_ALPHA,), targets=("target_excess_return",)):
    """Mean rank correlation and decile spread of every model on its fold's year, judged on the excess return."""
    panel = training_panel(m)
    models = linear.fit_folds(panel, panel_years(panel), FEATURES, policies, targets, alphas, MIN_TRAIN)
    scored = linear.predict_folds(models, panel, FEATURES, ("trade_date", "ticker", "target_excess_return"), MIN_VALID)
    # The same nine digits on both sides, so that equal predictions tie.
    scored = cut_lineage(scored.withColumn("prediction", rounded(F.col("prediction"), 9)))
    daily = evaluation.cross_section_metrics(scored, by=(*linear.MODEL, "trade_date"), group_bound=m.cross_section)
    return evaluation.average_metrics(daily, linear.MODEL).withColumnRenamed("top_minus_bottom", "spread")


@query(
    "linear_coefficients",
    _with(
        *_PANEL, *models_sql(learning.POLICIES), "terms AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in _TERMS) + f"]) AS term, unnest(range({len(_TERMS)})) AS pos)",
        select=f"""SELECT policy, fold AS fold_year, term, n AS train_rows, {r('coefficient')} AS coefficient
          FROM solved JOIN numbered USING (policy, fold, slot) JOIN terms USING (pos)""",
    ),
)
def linear_coefficients(spark, sf_dir):
    panel = training_panel(Market(spark, sf_dir))
    models = linear.fit_folds(panel, panel_years(panel), FEATURES, learning.POLICIES, min_train=MIN_TRAIN)
    rows = linear.coefficients(models, FEATURES)
    return rows.select("policy", "fold_year", "term", "train_rows", rounded(F.col("coefficient")).alias("coefficient"))


@query(
    "linear_policy_ic",
    _with(*_PANEL, *models_sql(learning.POLICIES), *_SCORED, select=f"SELECT policy, fold_year, {r('rank_ic')} AS rank_ic, {r('spread')} AS spread, dates FROM yearly"),
)
def linear_policy_ic(spark, sf_dir):
    rows = yearly_metrics(Market(spark, sf_dir), learning.POLICIES)
    return rows.select("policy", "fold_year", rounded(F.col("rank_ic")).alias("rank_ic"), rounded(F.col("spread")).alias("spread"), "dates")


@query(
    "linear_target_comparison",
    _with(*_PANEL, *models_sql([EXPANDING], targets=TARGETS), *_SCORED, select=f"SELECT target, fold_year, {r('rank_ic')} AS rank_ic, {r('spread')} AS spread, dates FROM yearly"),
)
def linear_target_comparison(spark, sf_dir):
    rows = yearly_metrics(Market(spark, sf_dir), [EXPANDING], targets=TARGETS)
    return rows.select("target", "fold_year", rounded(F.col("rank_ic")).alias("rank_ic"), rounded(F.col("spread")).alias("spread"), "dates")


@query(
    "linear_nested_search",
    _with(
        *_PANEL, *models_sql([EXPANDING, *learning.POLICIES[5:]], ALPHAS), *_SCORED,
        "judgements AS (SELECT policy, alpha, fold_year, " + r("rank_ic", 9) + " AS rank_ic FROM yearly)",
        f"""trials AS (SELECT o.fold_year, i.policy, i.alpha, avg(i.rank_ic) AS inner_value, count(*) AS years
          FROM (SELECT DISTINCT fold AS fold_year FROM folds) o JOIN judgements i ON i.fold_year BETWEEN o.fold_year - {INNER_YEARS} AND o.fold_year - 1
          GROUP BY 1, 2, 3 HAVING count(*) = {INNER_YEARS})""",
        "best AS (SELECT *, count(*) OVER (PARTITION BY fold_year) AS trials FROM trials QUALIFY row_number() OVER (PARTITION BY fold_year ORDER BY inner_value DESC, policy, alpha) = 1)",
        select=f"""SELECT fold_year, policy, alpha, trials, {r('inner_value')} AS inner_rank_ic, {r('j.rank_ic')} AS outer_rank_ic FROM best JOIN judgements j USING (fold_year, policy, alpha)""",
    ),
)
def linear_nested_search(spark, sf_dir):
    m = Market(spark, sf_dir)
    yearly = yearly_metrics(m, [EXPANDING, *learning.POLICIES[5:]], ALPHAS).withColumn("rank_ic", rounded(F.col("rank_ic"), 9))
    yearly = cut_lineage(yearly.select("policy", "alpha", "fold_year", "rank_ic"))  # one row per trial and year
    chosen = linear.nested_choice(yearly, sorted(row[0] for row in yearly.select("fold_year").distinct().collect()), INNER_YEARS)
    return chosen.select(
        "fold_year", "policy", "alpha", "trials", rounded(F.col("inner_value")).alias("inner_rank_ic"), rounded(F.col("outer_value")).alias("outer_rank_ic")
    )


_ERRORS = [
    f"""errors AS (SELECT fold AS fold_year, trade_date, ticker, {r('stddev_pop(p)', 8)} AS x, abs(any_value(y) - avg(p)) AS y
      FROM judged GROUP BY 1, 2, 3)""",
]
_RELIABILITY = [
    "edges AS (SELECT fold_year, list_sort(list_distinct(" + "[" + ", ".join(f"quantile_cont(x, CAST({i} AS DOUBLE) / 5.0)" for i in range(6)) + "])) AS e FROM errors GROUP BY 1)",
    "binned AS (SELECT fold_year, len(list_filter(e[2:len(e) - 1], lambda v: v < x)) AS bin, avg(y) AS mean FROM errors JOIN edges USING (fold_year) GROUP BY 1, 2)",
    "rising AS (SELECT fold_year, count(*) AS bins, bool_and(coalesce(mean >= before, true)) AS rises FROM (SELECT *, lag(mean) OVER (PARTITION BY fold_year ORDER BY bin) AS before FROM binned) GROUP BY 1)",
    f"error_ranks AS (SELECT *, {S.avg_rank('x', 'fold_year', None)} AS rx, {S.avg_rank('y', 'fold_year', None)} AS ry FROM errors)",
    "sizes AS (SELECT fold_year, count(*) AS rows, count(DISTINCT x) AS distinct_values, corr(rx, ry) AS ic FROM error_ranks GROUP BY 1)",
    f"""judgement AS (SELECT *, concat_ws(',', CASE WHEN rows < {calibration.LEAST_ROWS} THEN 'rows' END, CASE WHEN distinct_values < {calibration.LEAST_VALUES} THEN 'values' END,
      CASE WHEN NOT ic > 0 THEN 'correlation' END, CASE WHEN bins < 3 OR NOT rises THEN 'rising_bins' END) AS failed FROM sizes JOIN rising USING (fold_year))""",
]
_CURVE = [
    "error_values AS (SELECT fold_year, x, count(*) AS n, sum(y) AS s FROM errors GROUP BY 1, 2)",
    """spread_values AS (SELECT *, count(*) OVER (PARTITION BY fold_year) AS vals, sum(n) OVER (PARTITION BY fold_year) AS total,
      row_number() OVER (PARTITION BY fold_year ORDER BY x) - 1 AS place, sum(n) OVER (PARTITION BY fold_year ORDER BY x) - n AS before FROM error_values)""",
    f"""blocks AS (SELECT fold_year, CASE WHEN vals <= {calibration.BLOCKS} THEN place ELSE floor(before * {calibration.BLOCKS} / total) END AS cell,
      min(x) AS low, max(x) AS high, CAST(sum(n) AS BIGINT) AS rows, sum(s) AS s FROM spread_values GROUP BY 1, 2)""",
    "numbered_blocks AS (SELECT *, CAST(row_number() OVER (PARTITION BY fold_year ORDER BY cell) AS INTEGER) AS block FROM blocks)",
    """runs AS (SELECT a.fold_year, a.block AS first, b.block AS last, sum(c.s) / sum(c.rows) AS mean
      FROM numbered_blocks a JOIN numbered_blocks b ON a.fold_year = b.fold_year AND b.block >= a.block
      JOIN numbered_blocks c ON c.fold_year = a.fold_year AND c.block BETWEEN a.block AND b.block GROUP BY 1, 2, 3)""",
    "least AS (SELECT fold_year, first, i.block, min(mean) AS m FROM runs JOIN numbered_blocks i USING (fold_year) WHERE first <= i.block AND last >= i.block GROUP BY 1, 2, 3)",
    "curve AS (SELECT fold_year, block, max(m) AS fitted FROM least GROUP BY 1, 2)",
]


def policy_errors(m: Market):
    """Per fold year, date and name: spread of the nine policies' predictions and the error of their mean, out of sample."""
    panel = training_panel(m)
    models = linear.fit_folds(panel, panel_years(panel), FEATURES, learning.POLICIES, min_train=MIN_TRAIN)
    scored = linear.predict_folds(models, panel, FEATURES, ("trade_date", "ticker", "target_excess_return"), MIN_VALID)
    p = rounded(F.col("prediction"), 9)
    rows = scored.groupBy("fold_year", "trade_date", "ticker").agg(
        rounded(F.stddev_pop(p), 8).alias("disagreement"), F.abs(F.first("target_excess_return") - F.avg(p)).alias("error")
    )
    return cut_lineage(rows)


@query(
    "disagreement_calibration",
    _with(
        *_PANEL, *models_sql(learning.POLICIES), *_SCORED, *_ERRORS, *_RELIABILITY,
        select=f"SELECT fold_year, rows, distinct_values, {r('ic')} AS rank_correlation, bins, failed = '' AS enabled, failed FROM judgement",
    ),
)
def disagreement_calibration(spark, sf_dir):
    m = Market(spark, sf_dir)
    report = calibration.verdicts(calibration.reliability(policy_errors(m), ["fold_year"], ["trade_date", "ticker"]))
    return report.select(
        "fold_year", "rows", "distinct_values", rounded(F.col("rank_correlation")).alias("rank_correlation"), F.size("bin_errors").cast("long").alias("bins"), "enabled", "failed"
    )


@query(
    "calibration_curve",
    _with(
        *_PANEL, *models_sql(learning.POLICIES), *_SCORED, *_ERRORS, *_CURVE,
        select=f"SELECT fold_year, block, {r('low')} AS low, {r('high')} AS high, rows, {r('fitted')} AS fitted FROM curve JOIN numbered_blocks USING (fold_year, block)",
    ),
)
def calibration_curve(spark, sf_dir):
    rows = calibration.rising_curve(policy_errors(Market(spark, sf_dir)), ["fold_year"])
    return rows.select("fold_year", "block", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"), "rows", rounded(F.col("fitted")).alias("fitted"))
