"""Queries over bootstrap intervals, Sharpe inference, overfitting, fairness and gates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import book, evaluation, performance, statistics
from tidemark.plans import market_sql as S
from tidemark.plans.book_queries import CAPITALS, CAPS, MONTHS_SQL, month_pairs
from tidemark.plans.diagnostics_queries import EVAL_SQL, TOPK_SQL
from tidemark.plans.market import Market
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import FORECAST_SQL
from tidemark.session import cut_lineage

r = S.r

# A relative return compressed to log space: returns of this market span orders of magnitude.
_REL = "rel AS (SELECT strategy, period, ln((1.0 + s) / (1.0 + b)) AS x, row_number() OVER (PARTITION BY strategy ORDER BY period) - 1 AS i FROM months)"


def relative(m: Market):
    x = F.log((1.0 + F.col("strategy_return")) / (1.0 + F.col("benchmark_return")))
    return month_pairs(m).withColumn("x", x)


_BOOTSTRAP = [
    "sz AS (SELECT strategy, count(*) AS n FROM rel GROUP BY 1)",
    """dr AS (SELECT strategy, n, b, d, CAST('0x' || substr(md5('42|' || b || '|' || d), 1, 12) AS BIGINT) % (n - 2) AS st
        FROM sz, (SELECT unnest(range(0, 2000)) AS b), (SELECT unnest(range(0, 100)) AS d) WHERE d < ceil(n / 3.0))""",
    "ix AS (SELECT strategy, b, st + o AS i FROM dr, (SELECT unnest([0, 1, 2]) AS o) WHERE d * 3 + o < n)",
    "es AS (SELECT ix.strategy, b, avg(x) AS e FROM ix JOIN rel ON rel.strategy = ix.strategy AND rel.i = ix.i GROUP BY 1, 2)",
]


@query(
    "bootstrap_ci",
    S.with_(
        *MONTHS_SQL, _REL,
        *_BOOTSTRAP,
        select=f"""SELECT p.strategy, {r('point')} AS point, {r('quantile_cont(e, 0.025)')} AS ci_low, {r('quantile_cont(e, 0.975)')} AS ci_high, max(n) AS observations
          FROM es JOIN (SELECT strategy, avg(x) AS point, count(*) AS n FROM rel GROUP BY 1) p ON p.strategy = es.strategy GROUP BY p.strategy, point""",
    ),
)
def bootstrap_ci(spark, sf_dir):
    rows = statistics.block_bootstrap(relative(Market(spark, sf_dir)), "x", "period")
    return rows.select("strategy", *[rounded(F.col(c)).alias(c) for c in ("point", "ci_low", "ci_high")], "observations")


@query(
    "relative_cagr",
    S.with_(*MONTHS_SQL, select=f"SELECT strategy, {r('exp(avg(ln((1.0 + s) / (1.0 + b))) * 12.0) - 1.0')} AS relative_cagr, count(*) AS periods FROM months GROUP BY 1"),
)
def relative_cagr(spark, sf_dir):
    rows = performance.relative_cagr(month_pairs(Market(spark, sf_dir)), "strategy_return", "benchmark_return")
    return rows.select("strategy", rounded(F.col("relative_cagr")).alias("relative_cagr"), "periods")


_MOMENTS = """mo AS (SELECT strategy, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, stddev_pop(x) AS sp, kurtosis_pop(x) + 3.0 AS k FROM rel GROUP BY 1),
  sk AS (SELECT rel.strategy, avg(power(x - m, 3)) / power(max(sp), 3) AS skew FROM rel JOIN mo USING (strategy) GROUP BY 1),
  sr AS (SELECT mo.*, skew, m / sd * sqrt(12.0) AS s FROM mo JOIN sk USING (strategy)),
  va AS (SELECT *, (1.0 - skew * s / sqrt(12.0) + ((k - 1.0) / 4.0) * (s * s / 12.0)) / (n - 1) AS v FROM sr)"""


def _cdf(z: str) -> str:
    terms = f"""(SELECT sum(exp((2 * i + 1) * ln(abs({z})) - ((i + 1) * ln(2.0) + lgamma(i + 1.5) - 0.5 * ln(pi())))) FROM (SELECT unnest(range(0, 220)) AS i))"""
    return f"CASE WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2.0) / sqrt(2.0 * pi()) * {terms} END"


_HURDLE = statistics.sharpe_hurdle(20, 0.25)


@query(
    "sharpe_psr_dsr",
    S.with_(
        *MONTHS_SQL, _REL, _MOMENTS,
        f"zz AS (SELECT *, s / sqrt(v * 12.0) AS z0, (s - CAST({_HURDLE!r} AS DOUBLE)) / sqrt(v * 12.0) AS z1 FROM va)",
        select=f"SELECT strategy, n, {r('s')} AS sharpe, {r('skew')} AS skewness, {r('k')} AS kurtosis, {r(_cdf('z0'))} AS psr, {r(_cdf('z1'))} AS dsr, {r(f'CAST({_HURDLE!r} AS DOUBLE)')} AS hurdle FROM zz",
    ),
)
def sharpe_psr_dsr(spark, sf_dir):
    x = relative(Market(spark, sf_dir)).select("strategy", "period", "x")
    plain = statistics.probabilistic_sharpe(x, "x").withColumnRenamed("probability", "psr")
    deflated = statistics.deflated_sharpe(x, "x", 20, 0.25).select("strategy", F.col("probability").alias("dsr"), "hurdle")
    return plain.join(deflated, "strategy").select(
        "strategy", "n", *[rounded(F.col(c)).alias(c) for c in ("sharpe", "skewness", "kurtosis", "psr", "dsr", "hurdle")]
    )


_PBO = [
    "ok AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i FROM rel GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT strategy) FROM rel))",
    "tt AS (SELECT count(*) AS t FROM ok)",
    """bl AS (SELECT period, CAST(CASE WHEN i < (t % 8) * (t // 8 + 1) THEN i // (t // 8 + 1) ELSE (t % 8) + (i - (t % 8) * (t // 8 + 1)) // (t // 8) END AS INTEGER) AS block FROM ok, tt)""",
    "sp AS (SELECT m FROM (SELECT unnest(range(0, 256)) AS m) WHERE bit_count(m) = 4)",
    """sides AS (SELECT m, strategy, (m >> block) & 1 = 1 AS train, CASE WHEN stddev_samp(x) > 1e-12 THEN avg(x) * 12.0 / (stddev_samp(x) * sqrt(12.0)) ELSE 0.0 END AS score
        FROM rel JOIN bl USING (period), sp GROUP BY 1, 2, 3)""",
    "pr AS (SELECT m, strategy, max(score) FILTER (WHERE train) AS a, max(score) FILTER (WHERE NOT train) AS b FROM sides GROUP BY 1, 2)",
    "wn AS (SELECT m, b AS won FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY a DESC, strategy) AS n FROM pr) WHERE n = 1)",
    "rk AS (SELECT m, avg(CASE WHEN b <= won THEN 1.0 ELSE 0.0 END) AS rank FROM pr JOIN wn USING (m) GROUP BY 1)",
]


@query("pbo", S.with_(*MONTHS_SQL, _REL, *_PBO, select=f"SELECT {r('avg(CASE WHEN rank <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS overfitting_probability, count(*) AS splits FROM rk"))
def pbo(spark, sf_dir):
    x = relative(Market(spark, sf_dir)).select("strategy", "period", "x")
    rows = statistics.overfitting_probability(x, "x")
    return rows.select(rounded(F.col("overfitting_probability")).alias("overfitting_probability"), "splits")


# The bootstrap over the monthly series of the signal instead of those of the strategies.
_SIGNAL = [
    *EVAL_SQL, *TOPK_SQL,
    """srel AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY trade_date) - 1 AS i FROM (
        SELECT 'rank_ic' AS strategy, trade_date, rank_ic AS x FROM xs UNION ALL SELECT 'top10_spread', trade_date, top_mean - bottom_mean FROM topk WHERE k = 10
        UNION ALL SELECT 'top10_hit_rate', trade_date, hit FROM topk WHERE k = 10) WHERE x IS NOT NULL AND NOT isnan(x))""",
    *[re.sub(r"\b(sz|dr|ix|es|rel)\b", r"s\1", part) for part in _BOOTSTRAP],
]


@query(
    "signal_statistics",
    S.with_(
        *FORECAST_SQL, *_SIGNAL,
        select=f"""SELECT p.strategy AS statistic, {r('point')} AS point, {r('se')} AS standard_error, {r('quantile_cont(e, 0.025)')} AS ci_low, {r('quantile_cont(e, 0.975)')} AS ci_high, max(n) AS months
          FROM ses JOIN (SELECT strategy, avg(x) AS point, stddev_samp(x) / sqrt(count(*)) AS se, count(*) AS n FROM srel GROUP BY 1) p ON p.strategy = ses.strategy GROUP BY p.strategy, point, se""",
    ),
)
def signal_statistics(spark, sf_dir):
    """Mean, standard error and bootstrap interval of the monthly rank correlation, top-10 spread and top-10 hit rate."""
    series = signal_series(Market(spark, sf_dir))
    errors = series.groupBy("strategy").agg((F.stddev_samp("x") / F.sqrt(F.count("x").cast("double"))).alias("standard_error"))
    rows = statistics.block_bootstrap(series, "x", "trade_date").join(errors, "strategy")
    return rows.select(F.col("strategy").alias("statistic"), *[rounded(F.col(c)).alias(c) for c in ("point", "standard_error", "ci_low", "ci_high")], F.col("observations").alias("months"))


def signal_series(m: Market):
    forecasts = cut_lineage(m.forecasts.select("trade_date", "ticker", "prediction", "target_excess_return"))
    return cut_lineage(evaluation.signal_series(forecasts, group_bound=m.cross_section))


_RECORDS = """records AS (SELECT o_orderpriority AS strategy, o_orderstatus AS cost_scenario, max(o_custkey % 5) AS initial_capital, min(o_orderdate) AS evaluation_start,
    max(date_trunc('month', o_orderdate)) AS evaluation_end, count(DISTINCT date_trunc('month', o_orderdate)) AS rebalance_dates, count(DISTINCT year(o_orderdate)) AS rebalance_periods,
    min(o_custkey % 2) AS execution_delay_bars, CAST(max(o_custkey % 3) AS INTEGER) AS participation_cap, max(o_orderstatus) AS fill_policy
    FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') GROUP BY 1, 2)"""


@query(
    "fairness",
    S.with_(
        _RECORDS,
        "f AS (" + " UNION ALL ".join(f"SELECT cost_scenario, '{c}' AS field, CAST({c} AS VARCHAR) AS v FROM records" for c in statistics.FAIRNESS_FIELDS) + ")",
        select="""SELECT 'field_differs' AS failure, cost_scenario, CAST(NULL AS VARCHAR) AS strategy, field FROM f GROUP BY cost_scenario, field HAVING count(DISTINCT v) > 1
          UNION ALL SELECT 'scenario_missing', c.cost_scenario, s.strategy, NULL FROM (SELECT DISTINCT cost_scenario FROM records) c, (SELECT DISTINCT strategy FROM records) s
          WHERE NOT EXISTS (SELECT 1 FROM records x WHERE x.strategy = s.strategy AND x.cost_scenario = c.cost_scenario)""",
    ),
)
def fairness(spark, sf_dir):
    orders = Market(spark, sf_dir).table("orders").filter("NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')")
    month = F.date_trunc("month", "o_orderdate")
    records = orders.groupBy(F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("cost_scenario")).agg(
        F.max(F.col("o_custkey") % 5).alias("initial_capital"), F.min("o_orderdate").alias("evaluation_start"), F.max(month).alias("evaluation_end"),
        F.count_distinct(month).alias("rebalance_dates"), F.count_distinct(F.year("o_orderdate")).alias("rebalance_periods"),
        F.min(F.col("o_custkey") % 2).alias("execution_delay_bars"), F.max(F.col("o_custkey") % 3).alias("participation_cap"), F.max("o_orderstatus").alias("fill_policy"),
    )
    return statistics.fairness_failures(records)


_METRIC_SQL = [
    *MONTHS_SQL, _REL, *_BOOTSTRAP, *_SIGNAL,
    "low AS (SELECT strategy, quantile_cont(e, 0.025) * 12.0 AS low FROM es GROUP BY 1)",
    _MOMENTS,
    f"zz AS (SELECT *, (s - CAST({_HURDLE!r} AS DOUBLE)) / sqrt(v * 12.0) AS z1 FROM va)",
    f"dsr AS (SELECT strategy, {_cdf('z1')} AS dsr FROM zz)",
    """facts_ AS (SELECT strategy, avg(ln((1.0 + s) / (1.0 + c))) / stddev_samp(ln((1.0 + s) / (1.0 + c))) * sqrt(12.0) AS sh FROM months GROUP BY 1)""",
    "crel AS (SELECT strategy, period, ln((1.0 + s) / (1.0 + c)) AS x, row_number() OVER (PARTITION BY strategy ORDER BY period) - 1 AS i FROM months)",
    *[re.sub(r"\b(sz|dr|ix|es|rel)\b", r"c\1", part) for part in _BOOTSTRAP],
    "clow AS (SELECT strategy, quantile_cont(e, 0.025) * 12.0 AS low FROM ces GROUP BY 1)",
    """fair AS (SELECT CASE WHEN count(DISTINCT runs) = 1 THEN 1.0 ELSE 0.0 END AS passed FROM
        (SELECT strategy, concat(min(start_s), '|', max(end_s), '|', string_agg(start_s, ',' ORDER BY start_s)) AS runs FROM heldp GROUP BY 1))""",
    "worst AS (SELECT strategy, min(exp(ln_net - mx) - 1.0) AS dd FROM (SELECT strategy, ln_net, max(ln_net) OVER (PARTITION BY strategy ORDER BY session) AS mx FROM net) GROUP BY 1)",
    "spent AS (SELECT strategy, sum(turnover) * 12.0 / count(*) AS turn FROM churn GROUP BY 1)",
    """metrics AS (SELECT strategy, 'excess_sharpe_vs_cdi' AS name, sh AS actual FROM facts_ UNION ALL SELECT strategy, 'max_drawdown', dd FROM worst UNION ALL SELECT strategy, 'annualized_turnover', turn FROM spent
        UNION ALL SELECT strategy, 'relative_cagr_ci_low_vs_ibov', low FROM low UNION ALL SELECT strategy, 'relative_cagr_ci_low_vs_cdi', low FROM clow
        UNION ALL SELECT strategy, 'benchmark_fairness_passed', passed FROM facts_, fair UNION ALL SELECT strategy, 'deflated_sharpe_probability', dsr FROM dsr
        UNION ALL SELECT strategy, 'number_of_trials_recorded', CAST((SELECT count(DISTINCT strategy) FROM facts_) AS DOUBLE) FROM facts_
        UNION ALL SELECT f.strategy, g.strategy || '_ci_low', g.low FROM facts_ f, (SELECT strategy, quantile_cont(e, 0.025) AS low FROM ses WHERE strategy IN ('rank_ic', 'top10_spread') GROUP BY 1) g)""",
]
_GATE_ROWS = " UNION ALL ".join(f"SELECT '{lv}' AS level, '{n}' AS name, '{op}' AS operator, CAST({t} AS DOUBLE) AS threshold" for lv, n, op, t in statistics.GATES)


@query(
    "gates",
    S.with_(
        *_METRIC_SQL, f"gate_list AS ({_GATE_ROWS})",
        select=f"""SELECT st.strategy, g.level, g.name, g.operator, g.threshold, {r('m.actual', 4)} AS actual,
          coalesce(CASE g.operator WHEN '>' THEN m.actual > g.threshold WHEN '>=' THEN m.actual >= g.threshold WHEN '<=' THEN m.actual <= g.threshold ELSE m.actual = g.threshold END, false) AS passed
          FROM (SELECT DISTINCT strategy FROM metrics) st CROSS JOIN gate_list g LEFT JOIN metrics m ON m.strategy = st.strategy AND m.name = g.name""",
    ),
)
def gates(spark, sf_dir):
    return statistics.gate_results(gate_metrics(Market(spark, sf_dir))).withColumn("actual", rounded(F.col("actual"), 4))


def gate_metrics(m: Market):
    """Long (strategy, name, actual) rows for the gates, each from the operator that computes it.

    The bounds on growth relative to the market and to cash are the bootstrap's, per year and in logs (of the same sign as
    the relative CAGR); the Sharpe ratio is that of log returns over cash. The signal level is the one forecast that all
    strategies share, and fairness compares what the strategies of each scenario were run on. Gates whose input this
    market lacks (leakage tests, acknowledgements) stay without a value and so fail.
    """
    months = month_pairs(m)
    over = {"ibov": F.log1p("strategy_return") - F.log1p("benchmark_return"), "cdi": F.log1p("strategy_return") - F.log1p("rate_return")}
    facts = months.groupBy("strategy").agg(statistics.sharpe(over["cdi"]).alias("sh"))
    worst = performance.summary_metrics(m.curves((15.0,)), bars=52).select("strategy", F.col("max_drawdown").alias("dd"))
    spent = m.turnover.groupBy("strategy").agg((F.sum("turnover") * 12.0 / F.count("*")).alias("turn"))
    pairs = F.array(*[F.struct(F.lit(n).alias("benchmark"), x.alias("x")) for n, x in over.items()])
    excess = cut_lineage(months.select("strategy", "period", F.inline(pairs)))
    lows = statistics.block_bootstrap(excess, "x", "period", ("strategy", "benchmark"))
    low = lows.groupBy("strategy").agg(*[F.max(F.when(F.col("benchmark") == n, F.col("ci_low") * 12.0)).alias(f"low_{n}") for n in over])
    x = excess.filter("benchmark = 'ibov'").select("strategy", "period", "x")
    failures = statistics.fairness_failures(book.run_records(m.periods, CAPITALS, CAPS))
    fair = failures.agg((F.count("*") == 0).cast("double")).scalar()
    deflated = statistics.deflated_sharpe(x, "x", 20, 0.25).select("strategy", F.col("probability").alias("dsr"))
    trials = facts.agg(F.count_distinct("strategy").cast("double")).scalar()
    wide = facts.join(worst, "strategy").join(spent, "strategy").join(low, "strategy").join(deflated, "strategy")
    cells = {
        "excess_sharpe_vs_cdi": F.col("sh"), "max_drawdown": F.col("dd"), "annualized_turnover": F.col("turn"), "relative_cagr_ci_low_vs_ibov": F.col("low_ibov"),
        "relative_cagr_ci_low_vs_cdi": F.col("low_cdi"), "benchmark_fairness_passed": fair, "deflated_sharpe_probability": F.col("dsr"), "number_of_trials_recorded": trials,
    }
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("actual")) for n, v in cells.items()])
    signal = statistics.block_bootstrap(signal_series(m).filter("strategy <> 'top10_hit_rate'"), "x", "trade_date")
    bounds = signal.select(F.concat("strategy", F.lit("_ci_low")).alias("name"), F.col("ci_low").alias("actual"))
    # Two rows for each strategy.
    shared = wide.select("strategy", F.explode(F.array(F.lit("rank_ic_ci_low"), F.lit("top10_spread_ci_low"))).alias("name")).join(bounds, "name").select("strategy", "name", "actual")
    return wide.select("strategy", F.inline(rows)).unionByName(shared)


@query(
    "gate_verdicts",
    S.with_(
        *_METRIC_SQL, f"gate_list AS ({_GATE_ROWS})",
        """res AS (SELECT st.strategy, g.level, coalesce(CASE g.operator WHEN '>' THEN m.actual > g.threshold WHEN '>=' THEN m.actual >= g.threshold WHEN '<=' THEN m.actual <= g.threshold ELSE m.actual = g.threshold END, false) AS passed
          FROM (SELECT DISTINCT strategy FROM metrics) st CROSS JOIN gate_list g LEFT JOIN metrics m ON m.strategy = st.strategy AND m.name = g.name)""",
        select="""SELECT strategy, bool_and(passed) FILTER (WHERE level = 'signal') AS model_signal_accepted, bool_and(passed) FILTER (WHERE level = 'portfolio') AS portfolio_strategy_accepted,
          bool_and(passed) AS production_ready FROM res GROUP BY 1""",
    ),
)
def gate_verdicts(spark, sf_dir):
    return statistics.gate_verdicts(statistics.gate_results(gate_metrics(Market(spark, sf_dir))))
