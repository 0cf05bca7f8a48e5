"""Feature coverage, drift between periods, and information coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import add_average_ranks, exact_quantiles, running_before
from tidemark.functions.scalars import finite

PSI_FLOOR = 1e-6


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str], label: str = "feature", value: str = "x") -> DataFrame:
    cells = [F.struct(F.lit(f).alias(label), F.col(f).cast("double").alias(value)) for f in features]
    return df.select(*keep, F.inline(F.array(*cells)))


def feature_coverage(df: DataFrame, features: Sequence[str], by: Sequence[str | Column] = ()) -> DataFrame:
    """Share of finite values of every feature, in one pass over the panel."""
    shares = [F.avg(finite(F.col(f)).cast("double")).alias(f) for f in features]
    wide = df.groupBy(*by).agg(*shares)
    keep = [c for c in wide.columns if c not in features]
    return unpivot_features(wide, features, keep, value="coverage")


def feature_gate(
    train: DataFrame, features: Sequence[str], technical: Sequence[str] = (), minimum: float = 0.60
) -> DataFrame:
    """Features covered well enough overall and on enough dates; stricter for technical ones."""
    if not 0.0 <= minimum <= 1.0:
        raise ValueError("minimum must be in [0, 1]")
    strict = F.col("feature").isin(list(technical))
    required = F.when(strict, max(minimum, 0.80)).otherwise(minimum)
    needed_dates = F.when(strict, 0.80).otherwise(0.60)
    sums = [F.sum(finite(F.col(f)).cast("double")).alias(f) for f in features]
    daily = train.groupBy("trade_date").agg(F.count("*").alias("__rows"), *sums)
    cells = unpivot_features(daily, features, ["__rows"], value="__observed")
    report = cells.groupBy("feature").agg(
        (F.sum("__observed") / F.sum("__rows")).alias("coverage"),
        F.avg((F.col("__observed") / F.col("__rows") >= required).cast("double")).alias("date_share"),
    )
    return report.withColumn("enabled", (F.col("coverage") >= required) & (F.col("date_share") >= needed_dates))


def in_years(years: tuple[int, int], clock: str = "trade_date") -> Column:
    return F.year(clock).between(*years)


def _samples(df: DataFrame, features: Sequence[str], a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    regime = F.when(in_years(a), "a").when(in_years(b), "b")
    tagged = df.withColumn("regime", regime).filter(F.col("regime").isNotNull())
    long = unpivot_features(tagged, features, ["regime"])
    return long.withColumn("x", F.when(finite(F.col("x")), F.col("x")))


def drift_moments(df: DataFrame, features: Sequence[str], a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """Moments, exact quantiles and missing share of each feature in two spans of years."""
    long = _samples(df, features, a, b)
    moments = long.groupBy("feature", "regime").agg(
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.avg(F.col("x").isNull().cast("double")).alias("missingness"),
    )
    spots = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
    quantiles = exact_quantiles(long, ["feature", "regime"], "x", list(spots.values()))
    for i, name in enumerate(spots):
        quantiles = quantiles.withColumnRenamed(f"q{i}", name)
    return moments.join(quantiles, ["feature", "regime"], "left")


def stability_index(
    df: DataFrame, features: Sequence[str], a: tuple[int, int], b: tuple[int, int], bins: int = 10
) -> DataFrame:
    """Population stability index over quantile bins of the first span.

    Edges are one array per feature. Bins are closed on the left; the outer ones are open-ended.
    """
    long = _samples(df, features, a, b).filter(F.col("x").isNotNull())
    probabilities = [i / bins for i in range(bins + 1)]
    q = exact_quantiles(long.filter("regime = 'a'"), ["feature"], "x", probabilities)
    inner = F.array_sort(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(bins + 1)])))
    edges = q.select("feature", inner.alias("edges"))
    cuts = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    # The edge table has one short array per feature, so its size is fixed by the feature list.
    cells = long.join(F.broadcast(edges.withColumn("cuts", cuts)), "feature").withColumn(
        "bin", F.size(F.filter("cuts", lambda c: c <= F.col("x")))
    )
    counts = cells.groupBy("feature", "bin").agg(
        F.first(F.size("edges")).alias("edges"),
        F.count(F.when(F.col("regime") == "a", 1)).alias("a"),
        F.count(F.when(F.col("regime") == "b", 1)).alias("b"),
    )
    totals = counts.groupBy("feature").agg(
        F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.first("edges").alias("edges"), F.collect_set("bin").alias("seen")
    )
    every = totals.select(
        "feature", "ta", "tb", "edges", F.explode(F.sequence(F.lit(0), F.greatest(F.col("edges") - 2, F.lit(0)))).alias("bin")
    )
    full = every.join(counts.select("feature", "bin", "a", "b"), ["feature", "bin"], "left").na.fill(0, ["a", "b"])
    pa = F.greatest(F.col("a") / F.greatest(F.col("ta"), F.lit(1)), F.lit(PSI_FLOOR))
    pb = F.greatest(F.col("b") / F.greatest(F.col("tb"), F.lit(1)), F.lit(PSI_FLOOR))
    index = full.groupBy("feature", "ta", "tb", "edges").agg(F.sum((pb - pa) * F.log(pb / pa)).alias("raw"))
    psi = F.when((F.col("ta") < bins) | (F.col("tb") < bins), None).when(F.col("edges") < 3, 0.0).otherwise(F.col("raw"))
    return index.select("feature", psi.alias("psi"))


def distribution_distances(df: DataFrame, features: Sequence[str], a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """Largest gap (Kolmogorov-Smirnov) and area (Wasserstein-1) between two distribution functions.

    Both come from one table of distinct values with running counts, totals and the next value, in ranges,
    so no feature is sorted or joined in a single task.
    """
    long = _samples(df, features, a, b).filter(F.col("x").isNotNull())
    tied = long.groupBy("feature", "x").agg(
        F.count(F.when(F.col("regime") == "a", 1)).alias("a"), F.count(F.when(F.col("regime") == "b", 1)).alias("b")
    )
    placed = running_before(
        tied, ["feature"], ["x"], {"before_a": "a", "before_b": "b"}, following={"next_x": "x"}, totals={"na": "a", "nb": "b"}
    )
    gap = (F.col("before_a") + F.col("a")) / F.col("na") - (F.col("before_b") + F.col("b")) / F.col("nb")
    steps = placed.filter("na > 0 AND nb > 0").withColumn("gap", F.abs(gap))
    report = steps.groupBy("feature", "na", "nb").agg(
        F.max("gap").alias("ks_statistic"), F.sum(F.col("gap") * (F.col("next_x") - F.col("x"))).alias("wasserstein")
    )
    return report.withColumn("ks_pvalue", ks_pvalue(F.col("ks_statistic"), F.col("na"), F.col("nb")))


def ks_pvalue(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value."""
    t2 = statistic * statistic * (n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * t2),
    )
    return F.when(t2 < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def rank_correlation(
    long: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    keys: Sequence[str],
    minimum: int = 10,
    group_bound: int | None = None,
) -> DataFrame:
    """Spearman correlation per group over rows where both values are finite; groups in which one side is constant have none."""
    pairs = long.filter(finite(F.col(x)) & finite(F.col(y)))
    ranked = add_average_ranks(pairs, by, {"__rx": x, "__ry": y}, keys, group_bound)
    # Not `corr`: it fails on a constant side in ANSI mode.
    ic = F.try_divide(F.covar_pop("__rx", "__ry"), F.stddev_pop("__rx") * F.stddev_pop("__ry"))
    result = ranked.groupBy(*by).agg(ic.alias("ic"), F.count("*").alias("pairs"))
    return result.filter((F.col("pairs") >= minimum) & finite(F.col("ic")))


def monthly_ic(
    df: DataFrame, features: Sequence[str], target: str = "target_excess_return", minimum: int = 10, group_bound: int | None = None
) -> DataFrame:
    """Rank correlation of every feature with the target on every date, in one job."""
    long = unpivot_features(df, features, ["trade_date", "ticker", target])
    return rank_correlation(long, ["trade_date", "feature"], "x", target, ["ticker"], minimum, group_bound)


def ic_by_year(ic: DataFrame) -> DataFrame:
    yearly = ic.groupBy("feature", F.year("trade_date").alias("year")).agg(
        F.avg("ic").alias("ic_mean"),
        F.percentile("ic", F.lit(0.5)).alias("ic_median"),
        F.stddev_samp("ic").alias("ic_std"),
        F.count("*").alias("months"),
    )
    error = F.col("ic_std") / F.sqrt(F.col("months").cast("double"))
    return yearly.withColumns(
        {
            "icir": F.try_divide(F.col("ic_mean"), F.col("ic_std")),
            "ic_se": error,
            "ic_tstat": F.try_divide(F.col("ic_mean"), error),
        }
    )


def ic_regimes(ic: DataFrame, a: tuple[int, int], b: tuple[int, int], material: float = 0.02) -> DataFrame:
    """Mean coefficient in two spans of years and a label for the change."""
    spans = ic.groupBy("feature").agg(
        F.avg(F.when(in_years(a), F.col("ic"))).alias("ic_a"), F.avg(F.when(in_years(b), F.col("ic"))).alias("ic_b")
    )
    spans = spans.withColumns({"delta_ic": F.col("ic_b") - F.col("ic_a"), "sign_flip": F.signum("ic_a") != F.signum("ic_b")})
    kind = (
        F.when(F.col("sign_flip"), "sign_flip")
        .when(F.col("delta_ic") > material, "gained_relevance")
        .when(F.col("delta_ic") < -material, "deteriorated")
        .when((F.abs("ic_a") < material) & (F.abs("ic_b") < material), "never_material")
        .otherwise("stable")
    )
    return spans.withColumn("classification", kind)


def ic_summary(ic: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean, standard error, t, information ratio and hit rate over all months."""
    rows = ic.groupBy(*by).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("*").alias("months"),
        F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"),
    )
    error = F.col("ic_std") / F.sqrt(F.col("months").cast("double"))
    return rows.withColumns(
        {
            "ic_se": error,
            "ic_tstat": F.try_divide(F.col("ic_mean"), error),
            "information_ratio": F.try_divide(F.col("ic_mean"), F.col("ic_std")),
        }
    )
