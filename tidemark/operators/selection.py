"""Top-k choices per date, with issuer caps and recorded rejections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import issuer_root


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group; each map task already keeps only k rows per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint")).filter(F.col(out) <= k)


def issuer_or_root(issuer: str = "issuer_id", ticker: str = "ticker") -> Column:
    """The issuer of a name; without one the first four letters of its ticker stand in."""
    return F.coalesce(F.col(issuer).cast("string"), issuer_root(F.col(ticker)))


def best_per_issuer(df: DataFrame, by: Sequence[str], order: Sequence[Column], issuer: str = "issuer_id") -> DataFrame:
    """One share class per issuer and date: the best-ranked one. Names without an issuer are told apart by their root."""
    return top_per_group(df.withColumn("__issuer", issuer_or_root(issuer)), [*by, "__issuer"], order, 1, "__class").drop("__class", "__issuer")


def topk_with_issuer_cap(
    signals: DataFrame,
    score: str,
    k: int,
    by: Sequence[str] = ("trade_date",),
    buffer: int = 0,
    issuer: str = "issuer_id",
    quoted: str | None = None,
) -> DataFrame:
    """The k + buffer best names per date, one per issuer, names without a quote left out."""
    usable = signals if quoted is None else signals.filter(F.col(quoted))
    order = [F.col(score).desc(), F.col("ticker")]
    single = best_per_issuer(usable.filter(F.col(score).isNotNull()), by, order, issuer)
    return top_per_group(single, by, order, k + buffer)


def rejected_before_cutoff(
    signals: DataFrame,
    score: str,
    k: int,
    by: Sequence[str] = ("trade_date",),
    issuer: str = "issuer_id",
    history: str = "has_price_history",
    quoted: str = "execution_quote",
) -> DataFrame:
    """Names skipped on the way down to the k-th accepted one, each with its reason.

    The cut-off is the score and ticker of the k-th accepted name of a date (one small row per
    date); with fewer than k accepted names every skipped one is reported.
    """
    scored = signals.filter(F.col(score).isNotNull())
    order = [F.col(score).desc(), F.col("ticker")]
    usable = scored.filter(F.col(history) & F.col(quoted))
    single = best_per_issuer(usable, by, order, issuer)
    accepted = top_per_group(single, by, order, k)
    cut = accepted.groupBy(*by).agg(
        F.count("*").alias("__n"),
        F.max_by(F.struct(F.col(score).alias("s"), F.col("ticker").alias("t")), "rank").alias("__cut"),
    )
    taken = accepted.select(*by, "ticker", F.lit(True).alias("__taken"))
    reason = (
        F.when(~F.col(history), "missing_price_history")
        .when(~F.col(quoted), "no_observed_execution_quote")
        .otherwise("issuer_share_class_cap")
    )
    above = (
        F.col("__cut").isNull()
        | (F.col("__n") < k)
        | (F.col(score) > F.col("__cut.s"))
        | ((F.col(score) == F.col("__cut.s")) & (F.col("ticker") < F.col("__cut.t")))
    )
    return (
        scored.join(cut, list(by), "left")
        .join(taken, [*by, "ticker"], "left_anti")
        .filter(above)
        .select(*by, "ticker", reason.alias("reason"))
    )


def extremes(df: DataFrame, value: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n best and n worst rows as one table."""
    best = df.orderBy(F.col(value).desc(), *ties).limit(n).withColumn("side", F.lit("best"))
    worst = df.orderBy(F.col(value).asc(), *ties).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def latest_snapshot(snapshots: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best rows of the newest snapshot date."""
    newest = snapshots.agg(F.max("as_of")).scalar()
    return snapshots.filter(F.col("as_of") == newest).orderBy(F.col(score).desc(), "ticker").limit(n)


def alpha_first_candidates(
    signals: DataFrame,
    n: int,
    penalty: float,
    liquidity: str,
    prediction: str = "prediction",
    uncertainty: str = "uncertainty",
    by: Sequence[str] = ("trade_date",),
    issuer: str = "issuer_id",
) -> DataFrame:
    """Best n names by penalised forecast, then liquidity, one share class per issuer."""
    mu = F.col(prediction) - F.lit(penalty) * F.col(uncertainty)
    scored = signals.withColumn("mu", mu).filter(F.col("mu").isNotNull())
    order = [F.col("mu").desc(), F.col(liquidity).desc_nulls_last(), F.col("ticker")]
    return top_per_group(best_per_issuer(scored, by, order, issuer), by, order, n, "alpha_rank")


def equal_weights(selected: DataFrame, by: Sequence[str] = ("trade_date",), out: str = "target_weight") -> DataFrame:
    """1/n inside each selection; a selection holds at most k rows per date."""
    return selected.withColumn(out, 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by)))
