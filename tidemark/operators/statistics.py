"""Bootstrap intervals, Sharpe inference, overfitting and acceptance gates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import e
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, normal_cdf

EULER_GAMMA = 0.5772156649015329
OVERFIT_BLOCKS = 8


def sharpe(r: Column, periods_per_year: int = 12) -> Column:
    """Annualised Sharpe ratio of a group; zero for a flat or single-row group."""
    std = F.stddev_samp(r)
    return F.when(std > 1e-12, F.avg(r) * periods_per_year / (std * F.sqrt(F.lit(float(periods_per_year))))).otherwise(0.0)


def cagr(r: Column, periods_per_year: int = 12) -> Column:
    """Annualised growth of a group; null when any period lost everything."""
    return F.when(F.min(r) > -1.0, F.pow(F.product(1.0 + r), periods_per_year / F.count(r)) - 1.0)


METRICS = {"mean": F.avg, "sharpe": sharpe, "cagr": cagr}


def uniform_start(seed: int, replicate: Column, draw: Column, starts: Column) -> Column:
    """A block start from a hash that any SQL engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), draw.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint"), starts)


def block_bootstrap(
    series: DataFrame,
    value: str,
    order: str,
    by: Sequence[str] = ("strategy",),
    metric: str = "mean",
    block: int = 3,
    replicates: int = 2000,
    confidence: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Moving-block bootstrap interval of a named metric for each series.

    Replicates are rows: the draws of each (series, replicate) are generated in place, look up
    their values by an equi-join on position, and are aggregated like any other group. Series are
    monthly or per session; series shorter than three give null bounds.
    """
    if block <= 0 or replicates <= 0:
        raise ValueError("block and replicates must be positive")
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    x = series.filter(finite(F.col(value))).select(*by, (F.row_number().over(w) - 1).alias("i"), F.col(value).alias("x"))
    sizes = x.groupBy(*by).agg(F.count("*").alias("n"))
    length = F.least(F.lit(block), F.col("n"))
    draws = (
        sizes.filter("n >= 3")
        .withColumn("length", length)
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("d", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.col("length")) - 1).cast("int"))))
        .withColumn("start", uniform_start(seed, F.col("b"), F.col("d"), F.col("n") - F.col("length") + 1))
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)))
        .filter(F.col("d") * F.col("length") + F.col("o") < F.col("n"))
        .select(*by, "b", (F.col("start") + F.col("o")).alias("i"))
    )
    measure = METRICS[metric]
    estimates = draws.join(x, [*by, "i"]).groupBy(*by, "b").agg(measure(F.col("x")).alias("estimate"))
    alpha = (1.0 - confidence) / 2.0
    bounds = estimates.groupBy(*by).agg(
        F.percentile("estimate", F.lit(alpha)).alias("ci_low"),
        F.percentile("estimate", F.lit(1.0 - alpha)).alias("ci_high"),
    )
    points = x.groupBy(*by).agg(measure(F.col("x")).alias("point"), F.count("*").alias("observations"))
    points = points.withColumn("point", F.when(F.col("observations") >= 3, F.col("point")))
    return points.join(bounds, by, "left")


def sharpe_hurdle(trials: int, trials_std: float) -> float:
    """Expected best Sharpe of `trials` worthless strategies."""
    if trials <= 0:
        raise ValueError("trials must be positive")
    if trials_std < 0:
        raise ValueError("trials_std must be non-negative")
    if trials == 1 or trials_std == 0:
        return 0.0
    quantile = NormalDist().inv_cdf
    best = (1.0 - EULER_GAMMA) * quantile(1.0 - 1.0 / trials) + EULER_GAMMA * quantile(1.0 - 1.0 / (trials * e))
    return trials_std * best


def probabilistic_sharpe(
    returns: DataFrame, r: str, by: Sequence[str] = ("strategy",), benchmark: float | Column = 0.0, periods_per_year: int = 12
) -> DataFrame:
    """Probability that the true Sharpe exceeds a benchmark, with skewness and kurtosis."""
    by = list(by)
    v = F.col(r)
    m = returns.filter(finite(v)).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("skewness"),
        (F.kurtosis(v) + 3.0).alias("kurtosis"),
    )
    root = F.sqrt(F.lit(float(periods_per_year)))
    ratio = F.col("mean") / F.col("std") * root
    m = m.withColumn("sharpe", F.when((F.col("n") >= 3) & (F.col("std") > 1e-12), ratio))
    s = F.col("sharpe")
    variance = (
        1.0 - F.col("skewness") * s / root + ((F.col("kurtosis") - 1.0) / 4.0) * (s * s / periods_per_year)
    ) / F.greatest(F.col("n") - 1, F.lit(1))
    hurdle = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    m = m.withColumn("z", F.when(variance > 0, (s - hurdle) / F.sqrt(variance * periods_per_year)))
    return m.withColumn("probability", normal_cdf(F.col("z")))


def deflated_sharpe(
    returns: DataFrame, r: str, trials: int, trials_std: float, by: Sequence[str] = ("strategy",), periods_per_year: int = 12
) -> DataFrame:
    hurdle = sharpe_hurdle(trials, trials_std)
    return probabilistic_sharpe(returns, r, by, hurdle, periods_per_year).withColumn("hurdle", F.lit(hurdle))


def overfitting_probability(returns: DataFrame, r: str = "r", order: str = "period", strategy: str = "strategy") -> DataFrame:
    """Share of half-splits whose in-sample winner is at or below the median out of sample.

    Periods observed by all strategies are cut into eight contiguous blocks. The 70 splits are a
    constant array; block sums are formed first, so a split only adds up four of them.
    """
    valid = returns.filter(finite(F.col(r)))
    strategies = valid.agg(F.count_distinct(strategy)).scalar()
    periods = valid.groupBy(order).agg(F.count("*").alias("__n")).filter(F.col("__n") == strategies).select(order)
    numbered = periods.withColumn("i", F.row_number().over(Window.orderBy(order)) - 1)
    total = periods.agg(F.count("*")).scalar()
    small, extra = F.floor(total / OVERFIT_BLOCKS), total % OVERFIT_BLOCKS
    wide = extra * (small + 1)
    block = F.when(F.col("i") < wide, F.floor(F.col("i") / (small + 1))).otherwise(
        extra + F.floor((F.col("i") - wide) / F.greatest(small, F.lit(1)))
    )
    blocked = valid.join(F.broadcast(numbered.filter(total >= OVERFIT_BLOCKS).withColumn("block", block.cast("int"))), order)
    # Deviations from one constant keep the sums of squares accurate.
    centre = valid.agg(F.avg(r)).scalar()
    x = F.col(r) - centre
    sums = blocked.groupBy(F.col(strategy).alias("strategy"), "block").agg(
        F.count("*").alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2")
    )
    splits = [list(c) for c in combinations(range(OVERFIT_BLOCKS), OVERFIT_BLOCKS // 2)]
    table = F.array(*[F.array(*[F.lit(b) for b in s]) for s in splits])
    fanned = sums.select("*", F.posexplode(table).alias("split", "members"))
    side = fanned.groupBy("split", "strategy", F.array_contains("members", F.col("block")).alias("train")).agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")
    )
    mean = F.col("s1") / F.col("n")
    variance = (F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1)
    ratio = F.when(
        (F.col("n") > 1) & (variance > 1e-24), (mean + centre) * F.sqrt(F.lit(12.0)) / F.sqrt(variance)
    ).otherwise(0.0)
    scored = side.withColumn("score", ratio)
    pair = scored.groupBy("split", "strategy").agg(
        F.max(F.when(F.col("train"), F.col("score"))).alias("train_score"), F.max(F.when(~F.col("train"), F.col("score"))).alias("test_score")
    )
    # The first strategy by name wins a tied in-sample score.
    winner = pair.groupBy("split").agg(
        F.min_by("test_score", F.struct((-F.col("train_score")).alias("s"), F.col("strategy").alias("n"))).alias("won")
    )
    ranks = pair.join(F.broadcast(winner), "split").groupBy("split").agg(
        F.avg((F.col("test_score") <= F.col("won")).cast("double")).alias("rank"), F.count("*").alias("strategies")
    )
    return ranks.filter("strategies >= 2").agg(
        F.avg((F.col("rank") <= 0.5).cast("double")).alias("overfitting_probability"), F.count("*").alias("splits")
    )


# Fields that must agree within a cost scenario.
FAIRNESS_FIELDS = [
    "initial_capital", "evaluation_start", "evaluation_end", "rebalance_dates", "rebalance_periods",
    "execution_delay_bars", "participation_cap", "fill_policy",
]


def fairness_failures(records: DataFrame, fields: Sequence[str] = tuple(FAIRNESS_FIELDS)) -> DataFrame:
    """Scenarios whose strategies differ on a shared field, and strategies that lack a scenario."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    long = records.select("strategy", "cost_scenario", F.inline(F.array(*cells)))
    values = F.count_distinct(F.coalesce("value", F.lit("~null~")))
    uneven = long.groupBy("cost_scenario", "field").agg(values.alias("values")).filter("values > 1").select(
        F.lit("field_differs").alias("failure"), "cost_scenario", F.lit(None).cast("string").alias("strategy"), "field"
    )
    scenarios = records.select("cost_scenario").distinct()
    # A handful of scenarios: their set is attached to each strategy and the missing ones exploded.
    wanted = scenarios.agg(F.sort_array(F.collect_set("cost_scenario"))).scalar()
    owned = records.groupBy("strategy").agg(F.collect_set("cost_scenario").alias("owned"))
    missing = owned.select("strategy", F.explode(F.array_except(wanted, "owned")).alias("cost_scenario")).select(
        F.lit("scenario_missing").alias("failure"), "cost_scenario", "strategy", F.lit(None).cast("string").alias("field")
    )
    return uneven.unionByName(missing)


# Pre-registered gates as (level, name, comparison, threshold).
GATES = [
    ("signal", "rank_ic_ci_low", ">", 0.0),
    ("signal", "top10_spread_ci_low", ">", 0.0),
    ("portfolio", "excess_sharpe_vs_cdi", ">=", 0.75),
    ("portfolio", "max_drawdown", ">=", -0.35),
    ("portfolio", "annualized_turnover", "<=", 5.0),
    ("portfolio", "relative_cagr_ci_low_vs_cdi", ">", 0.0),
    ("portfolio", "relative_cagr_ci_low_vs_ibov", ">", 0.0),
    ("portfolio", "deflated_sharpe_probability", ">=", 0.95),
    ("portfolio", "number_of_trials_recorded", ">=", 1.0),
    ("production", "leakage_tests_passed", "==", 1.0),
    ("production", "diagnostic_only_acknowledged", "==", 1.0),
    ("production", "benchmark_fairness_passed", "==", 1.0),
]


def gate_results(metrics: DataFrame) -> DataFrame:
    """Each gate with its actual value. `metrics`: strategy, name, actual. A missing value fails."""
    cells = [
        F.struct(F.lit(level).alias("level"), F.lit(n).alias("name"), F.lit(op).alias("operator"), F.lit(t).alias("threshold"))
        for level, n, op, t in GATES
    ]
    wanted = metrics.select("strategy").distinct().select("strategy", F.inline(F.array(*cells)))
    joined = wanted.join(metrics, ["strategy", "name"], "left")
    a, t, op = F.col("actual"), F.col("threshold"), F.col("operator")
    passed = (
        F.when(op == ">", a > t).when(op == ">=", a >= t).when(op == "<", a < t).when(op == "<=", a <= t).otherwise(a == t)
    )
    return joined.withColumn("passed", F.coalesce(passed & finite(a), F.lit(False)))


def gate_verdicts(results: DataFrame) -> DataFrame:
    """Acceptance per strategy; production needs all three levels."""

    def level(name: str) -> Column:
        return F.min(F.when(F.col("level") == name, F.col("passed")))

    return results.groupBy("strategy").agg(
        level("signal").alias("model_signal_accepted"),
        level("portfolio").alias("portfolio_strategy_accepted"),
        F.min("passed").alias("production_ready"),
    )
