"""Factor sleeves, composite scores and the strategy signals built from them."""

from __future__ import annotations

from collections.abc import Mapping
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import add_average_ranks
from tidemark.operators.diagnostics import rank_correlation
from tidemark.operators.technical import DAILY, BarWindows

SLEEVES = ["momentum", "low_volatility", "quality"]
# Weights inside the sleeves.
MOMENTUM_WEIGHTS = (0.60, 0.25, 0.15)
QUALITY_WEIGHTS = {
    "gross_profitability": 0.40,
    "roe_proxy": 0.25,
    "roa_proxy": 0.15,
    "equity_to_assets": 0.10,
    "asset_turnover": 0.10,
}
RESEARCH_WEIGHTS = (0.65, 0.25, 0.10)


def sleeve_columns(df: DataFrame, windows: BarWindows = DAILY) -> dict[str, Column]:
    """Momentum, low-volatility and quality scores from percentile ranks."""
    long, mid, short = MOMENTUM_WEIGHTS
    vol = F.col(f"rank_{windows.name('volatility', windows.quarter)}")
    residual_name = f"rank_{windows.residual_volatility}"
    residual = F.col(residual_name) if residual_name in df.columns else vol
    present = []
    for name, weight in QUALITY_WEIGHTS.items():
        column = next((c for c in (f"sector_rank_{name}", f"rank_{name}") if c in df.columns), None)
        if column:
            present.append((weight, column))
    total = sum(w for w, _ in present)
    quality = sum((F.lit(w / total) * F.coalesce(F.col(c), F.lit(0.5)) for w, c in present), F.lit(0.0))
    return {
        "momentum_score": long * F.col("rank_momentum_12_1")
        + mid * F.col(f"rank_{windows.name('return', windows.half)}")
        + short * F.col(f"rank_{windows.name('return', windows.quarter)}"),
        "low_volatility_score": 0.5 * (1.0 - vol) + 0.5 * (1.0 - residual),
        "quality_score": quality if present else F.lit(0.5),
    }


def checked_weights(weights: Mapping[str, float] | None) -> dict[str, float]:
    weights = dict(weights or {s: 1.0 for s in SLEEVES})
    if set(weights) != set(SLEEVES):
        raise ValueError(f"weights must name exactly {SLEEVES}")
    if any(not isfinite(float(w)) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and non-negative")
    total = float(sum(weights.values()))
    if total <= 0:
        raise ValueError("at least one weight must be positive")
    return {s: float(w) / total for s, w in weights.items()}


def composite_score(
    df: DataFrame, weights: Mapping[str, float] | None = None, windows: BarWindows = DAILY, out: str = "quant_score"
) -> DataFrame:
    """Three contributions that add up to the score."""
    shares = checked_weights(weights)
    scored = df.withColumns(sleeve_columns(df, windows))
    parts = {f"quant_contribution_{s}": F.lit(shares[s]) * F.col(f"{s}_score") for s in SLEEVES}
    scored = scored.withColumns(parts)
    m, v, q = (F.col(f"quant_contribution_{s}") for s in SLEEVES)
    return scored.withColumn(out, m + v + q)


def learned_sleeve_weights(
    scored: DataFrame,
    target: str = "target_excess_return",
    shrinkage: float = 0.80,
    turnover_penalty: float = 0.10,
    group_bound: int | None = None,
) -> DataFrame:
    """Sleeve weights from past months: rank correlation over churn, shrunk to equal weights.

    One row per sleeve; everything up to these three rows is grouped in Spark.
    """
    if not 0.0 <= shrinkage <= 1.0:
        raise ValueError("shrinkage must be in [0, 1]")
    pairs = F.array(*[F.struct(F.lit(s).alias("sleeve"), F.col(f"{s}_score").alias("x")) for s in SLEEVES])
    long = scored.select("trade_date", "ticker", F.col(target).alias("y"), F.inline(pairs))
    ic = rank_correlation(long, ["trade_date", "sleeve"], "x", "y", ["ticker"], 2, group_bound)
    mean_ic = ic.groupBy("sleeve").agg(F.avg("ic").alias("mean_ic"))
    w = Window.partitionBy("ticker", "sleeve").orderBy("trade_date")
    churn = (
        long.withColumn("step", F.abs(F.col("x") - F.lag("x").over(w))).groupBy("sleeve").agg(F.avg("step").alias("churn"))
    )
    strength = F.greatest(F.lit(0.0), F.coalesce("mean_ic", F.lit(0.0))) / (
        1.0 + turnover_penalty * F.coalesce("churn", F.lit(0.0))
    )
    rows = churn.join(mean_ic, "sleeve", "left").withColumn("strength", strength)
    total = F.sum("strength").over(Window.partitionBy())  # three rows
    learned = F.when(total > 0, F.col("strength") / total).otherwise(F.lit(1.0 / 3.0))
    return rows.withColumn("weight", F.lit(shrinkage / 3.0) + F.lit(1.0 - shrinkage) * learned)


def strategy_signals(
    df: DataFrame,
    windows: BarWindows = DAILY,
    group_bound: int | None = None,
    quant: str = "quant_score",
    learned: str | None = None,
) -> DataFrame:
    """Scores of all strategies as columns signal_*; nulls become neutral values.

    Needs prediction, uncertainty, the sleeve scores and rank columns.
    """
    ranked = add_average_ranks(
        df,
        ["trade_date"],
        {"ml_percentile": "prediction", "uncertainty_percentile": "uncertainty"},
        ["ticker"],
        group_bound,
        denominator="all",
    )
    neutral = F.lit(0.5)
    alpha, factor, calm = RESEARCH_WEIGHTS
    score = F.coalesce(F.col(quant), neutral)
    return ranked.withColumns(
        {
            "signal_ml": F.col("prediction") - 0.5 * F.col("uncertainty"),
            "signal_momentum": F.coalesce("rank_momentum_12_1", neutral),
            "signal_low_volatility": F.coalesce("low_volatility_score", neutral),
            "signal_quality": F.coalesce("quality_score", neutral),
            "signal_quant": score,
            "signal_quant_learned": F.coalesce(F.col(learned), neutral) if learned else score,
            "signal_research": alpha * F.col("ml_percentile")
            + factor * score
            + calm * (1.0 - F.col("uncertainty_percentile")),
            "signal_equal_weight": F.lit(1.0),
            "signal_liquidity": F.coalesce(F.col(f"rank_{windows.log_value}"), F.lit(0.0)),
        }
    )


def by_strategy(signals: DataFrame, keep: list[str]) -> DataFrame:
    """Signal columns as rows (strategy, score), so that all strategies share one job."""
    names = [c for c in signals.columns if c.startswith("signal_")]
    cells = F.array(*[F.struct(F.lit(n.removeprefix("signal_")).alias("strategy"), F.col(n).cast("double").alias("score")) for n in names])
    return signals.select(*keep, F.inline(cells))


def snapshot_scores(df: DataFrame, prediction: str = "prediction", volatility: str | None = None, bars_per_year: int = 252) -> DataFrame:
    """Display scores of one publication date: 50 is neutral, 95 the strongest forecast."""
    largest = df.groupBy("as_of").agg(F.max(F.abs(F.col(prediction))).alias("__largest"))
    joined = df.join(largest, "as_of", "left")
    raw = 50.0 + 45.0 * F.coalesce(F.try_divide(F.col(prediction), F.col("__largest")), F.lit(0.0))
    out = joined.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).drop("__largest")
    if volatility is not None:
        out = out.withColumn("annual_volatility", F.col(volatility) * F.lit(float(bars_per_year) ** 0.5))
    return out
