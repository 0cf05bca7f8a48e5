"""How well a score orders the cross-section, and the weights of training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import add_average_ranks, add_positions, is_bounded
from tidemark.functions.scalars import finite
from tidemark.operators.diagnostics import rank_correlation
from tidemark.operators.selection import top_per_group

KS = (5, 10, 20, 30, 50)


def cross_section_metrics(
    df: DataFrame,
    prediction: str = "prediction",
    target: str = "target_excess_return",
    by: Sequence[str] = ("trade_date",),
    minimum: int = 10,
    group_bound: int | None = None,
) -> DataFrame:
    """Per date: rank correlation, decile means and their spread, and the share of right signs."""
    by = list(by)
    pairs = df.select(*by, "ticker", F.col(prediction).alias("p"), F.col(target).alias("y")).filter(
        finite(F.col("p")) & finite(F.col("y"))
    )
    ic = rank_correlation(pairs, by, "p", "y", ["ticker"], minimum, group_bound)
    sizes = pairs.groupBy(*by).agg(F.count("*").alias("n"))
    placed = add_positions(pairs, by, ["p", "ticker"], "place", group_bound).join(sizes, by)
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    deciles = placed.groupBy(*by).agg(
        F.avg(F.when(F.col("place") > F.col("n") - k, F.col("y"))).alias("top_decile_mean"),
        F.avg(F.when(F.col("place") <= k, F.col("y"))).alias("bottom_decile_mean"),
        F.avg(((F.col("y") > 0) == (F.col("p") > 0)).cast("double")).alias("hit_rate"),
    )
    joined = ic.withColumnRenamed("ic", "rank_ic").join(deciles, by)
    return joined.withColumn("top_minus_bottom", F.col("top_decile_mean") - F.col("bottom_decile_mean"))


METRICS = ["rank_ic", "top_decile_mean", "bottom_decile_mean", "top_minus_bottom", "hit_rate"]


def average_metrics(per_date: DataFrame, by: Sequence[str | Column], metrics: Sequence[str] = METRICS) -> DataFrame:
    return per_date.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("dates"))


TOPK_METRICS = [
    "precision", "recall", "ndcg", "mean_future_return", "median_future_return", "hit_rate",
    "top_minus_universe", "top_minus_bottom", "top_minus_equal_weight_universe",
]


def topk_metrics(
    df: DataFrame,
    ks: Sequence[int] = KS,
    prediction: str = "prediction",
    target: str = "target_excess_return",
    by: Sequence[str] = ("trade_date",),
    group_bound: int | None = None,
) -> DataFrame:
    """Per date and k: overlap with the best realised names and the returns of the chosen ones.

    Only the largest k rows of each end are kept per date. A cross-section of proven size is
    ordered in one pass; otherwise each ordering is pruned to k rows before its shuffle.
    """
    by, most = list(by), max(ks)
    pairs = df.select(*by, "ticker", F.col(prediction).alias("p"), F.col(target).alias("y")).filter(
        finite(F.col("p")) & finite(F.col("y"))
    )
    universe = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("y").alias("universe"))
    if is_bounded(group_bound):
        whole = Window.partitionBy(*by)
        pairs = pairs.withColumns(
            {
                "place": F.row_number().over(whole.orderBy(F.col("p").desc(), "ticker")),
                "truth": F.row_number().over(whole.orderBy(F.col("y").desc(), "ticker")),
                "low": F.row_number().over(whole.orderBy("p", "ticker")),
                "n": F.count(F.lit(1)).over(whole),
                "universe": F.avg("y").over(whole),
            }
        ).filter((F.col("place") <= most) | (F.col("low") <= most))
        sized = pairs.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
        sized = sized.filter((F.col("place") <= F.col("k")) | (F.col("low") <= F.col("k")))
        is_top, hit = F.col("place") <= F.col("k"), F.col("truth") <= F.col("k")
        discount = 1.0 / F.log2(F.col("place") + 1.0)
        joined = sized.groupBy(*by, "k").agg(
            F.count(F.when(is_top & hit, 1)).alias("overlap"),
            F.sum(F.when(is_top & hit, discount).otherwise(0.0)).alias("dcg"),
            F.sum(F.when(is_top, discount)).alias("ideal"),
            F.avg(F.when(is_top, F.col("y"))).alias("mean_future_return"),
            F.percentile(F.when(is_top, F.col("y")), F.lit(0.5)).alias("median_future_return"),
            F.avg(F.when(is_top, (F.col("y") > 0).cast("double"))).alias("hit_rate"),
            F.avg(F.when(F.col("low") <= F.col("k"), F.col("y"))).alias("bottom"),
            F.max("n").alias("n"),
            F.max("universe").alias("universe"),
        )
        return _topk_columns(joined, by)
    chosen = top_per_group(pairs, by, [F.col("p").desc(), F.col("ticker")], most, "place")
    actual = top_per_group(pairs, by, [F.col("y").desc(), F.col("ticker")], most, "truth").select(*by, "ticker", "truth")
    lowest = top_per_group(pairs, by, [F.col("p").asc(), F.col("ticker")], most, "place")

    def fan(rows: DataFrame) -> DataFrame:
        sized = rows.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
        return sized.filter(F.col("place") <= F.col("k"))

    bottoms = fan(lowest).groupBy(*by, "k").agg(F.avg("y").alias("bottom"))
    hit = F.col("truth") <= F.col("k")
    discount = 1.0 / F.log2(F.col("place") + 1.0)
    tops = fan(chosen.join(actual, [*by, "ticker"], "left")).groupBy(*by, "k").agg(
        F.count(F.when(hit, 1)).alias("overlap"),
        F.sum(F.when(hit, discount).otherwise(0.0)).alias("dcg"),
        F.sum(discount).alias("ideal"),
        F.avg("y").alias("mean_future_return"),
        F.percentile("y", F.lit(0.5)).alias("median_future_return"),
        F.avg((F.col("y") > 0).cast("double")).alias("hit_rate"),
    )
    return _topk_columns(tops.join(bottoms, [*by, "k"]).join(universe, by), by)


def _topk_columns(joined: DataFrame, by: Sequence[str]) -> DataFrame:
    joined = joined.filter(F.col("n") >= F.greatest(F.lit(3), F.col("k")))
    share = F.col("overlap") / F.col("k")
    above = F.col("mean_future_return") - F.col("universe")
    return joined.withColumns(
        {
            "precision": share,
            "recall": share,
            "ndcg": F.col("dcg") / F.col("ideal"),
            "top_minus_universe": above,
            "top_minus_bottom": F.col("mean_future_return") - F.col("bottom"),
            "top_minus_equal_weight_universe": above,
        }
    ).select(*by, "k", *TOPK_METRICS)


def prefilter_recall(df: DataFrame, candidates: DataFrame, target: str, best: int = 10, minimum: int = 10) -> DataFrame:
    """Per date, the share of the best realised names that were among the candidates."""
    known = df.filter(F.col(target).isNotNull())
    sizes = known.groupBy("trade_date").agg(F.count("*").alias("n")).filter(F.col("n") >= minimum)
    top = top_per_group(known, ["trade_date"], [F.col(target).desc(), F.col("ticker")], best, "truth")
    marked = top.join(
        candidates.select("trade_date", "ticker", F.lit(1).alias("__in")), ["trade_date", "ticker"], "left"
    ).join(F.broadcast(sizes), "trade_date")
    return marked.groupBy("trade_date").agg((F.count("__in") / F.count("*")).alias("recall"))


def selection_turnover(selected: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Share of each selection that was not in the one before it; a selection has at most k names."""
    sets = selected.groupBy(*by, "trade_date").agg(F.sort_array(F.collect_set("ticker")).alias("names"))
    w = Window.partitionBy(*by).orderBy("trade_date")
    kept = F.size(F.array_intersect("names", F.lag("names").over(w)))
    return sets.select(
        *by, "trade_date", F.size("names").alias("positions"), (1.0 - kept / F.size("names")).alias("turnover")
    ).filter(F.col("turnover").isNotNull())


def issuer_balanced_weights(df: DataFrame, issuer: str = "issuer_id", by: str = "trade_date") -> DataFrame:
    """Equal mass per issuer on a date, shared among its classes, with mean 1 overall.

    Class counts are a grouped aggregate joined back, so an issuer with very many classes is
    reduced on the map side.
    """
    owner = F.coalesce(F.col(issuer).cast("string"), F.concat(F.lit("~"), F.col("ticker").cast("string")))
    keyed = df.withColumn("__owner", owner)
    classes = keyed.groupBy(by, "__owner").agg(F.count("*").alias("__classes"))
    issuers = classes.groupBy(by).agg(F.count("*").alias("__issuers"), F.sum("__classes").alias("__rows"))
    mean = issuers.agg(F.count("*") / F.sum("__rows")).scalar()
    weighted = keyed.join(classes, [by, "__owner"]).join(F.broadcast(issuers), by)
    raw = 1.0 / (F.col("__issuers") * F.col("__classes"))
    return weighted.withColumn("sample_weight", raw / mean).drop("__owner", "__classes", "__issuers", "__rows")


def recency_weights(df: DataFrame, reference_date: str, half_life_years: float, clock: str = "trade_date") -> DataFrame:
    """Exponential decay with age, with mean 1."""
    age = F.greatest(F.lit(0.0), F.datediff(F.lit(reference_date).cast("date"), clock) / 365.25)
    raw = F.exp(-F.log(F.lit(2.0)) * age / half_life_years)
    per_date = df.groupBy(clock).agg(F.count("*").alias("__n")).withColumn("__raw", raw)
    mean = per_date.agg(F.sum(F.col("__raw") * F.col("__n")) / F.sum("__n")).scalar()
    dates = per_date.select(clock, (F.col("__raw") / mean).alias("recency_weight"))
    return df.join(F.broadcast(dates), clock)


def relevance_levels(
    df: DataFrame, target: str, levels: int = 5, by: str = "trade_date", group_bound: int | None = None
) -> DataFrame:
    """Ordinal relevance 0..levels-1 from the average rank of the target within a date."""
    ranked = add_average_ranks(df, [by], {"__share": target}, ["ticker"], group_bound, denominator="all")
    level = F.least(F.lit(levels - 1), F.floor(F.col("__share") * levels).cast("int"))
    return ranked.withColumn("relevance", F.when(F.col("__share").isNotNull(), level)).drop("__share")


def signal_series(df: DataFrame, k: int = 10, prediction: str = "prediction", target: str = "target_excess_return", group_bound: int | None = None) -> DataFrame:
    """Long (strategy, trade_date, x) monthly series of a signal: its rank correlation, its top-k minus bottom-k spread and its top-k hit rate."""
    ic = cross_section_metrics(df, prediction, target, group_bound=group_bound).select(F.lit("rank_ic").alias("strategy"), "trade_date", F.col("rank_ic").alias("x"))
    top = topk_metrics(df, (k,), prediction, target, group_bound=group_bound)
    cells = F.array(*[F.struct(F.lit(f"top{k}_{n}").alias("strategy"), F.col(c).alias("x")) for n, c in (("spread", "top_minus_bottom"), ("hit_rate", "hit_rate"))])
    return ic.unionByName(top.select("trade_date", F.inline(cells)).select("strategy", "trade_date", "x"))
