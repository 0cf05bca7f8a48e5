"""Pairwise covariance of a bounded candidate set, shrinkage, and portfolio weights.

All tables are long. Pair work runs only on the candidates of a date, which a top-n step has
bounded before; the size of a pair table therefore depends on n and not on the market.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_bar
from tidemark.functions.scalars import price_column
from tidemark.operators.selection import best_per_issuer, top_per_group
from tidemark.session import cut_lineage

VARIANCE_FLOOR = 1e-12


def consecutive_returns(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Returns between quotes on adjacent market sessions; a gap gives no return."""
    w = by_bar(clock="session")
    px = F.col(price_column(prices))
    bars = prices.join(F.broadcast(calendar.select("trade_date", "session")), "trade_date")
    step = F.col("session") - F.lag("session").over(w)
    r = F.when(step == 1, F.try_divide(px, F.lag(px).over(w)) - 1.0)
    return bars.select("ticker", "session", r.alias("r")).filter(F.col("r").isNotNull())


def window_returns(
    candidates: DataFrame, prices: DataFrame, calendar: DataFrame, lookback: int = 252, minimum: int = 60, coverage: float = 0.80
) -> DataFrame:
    """Returns of each candidate over the `lookback` sessions up to its as-of date.

    Names with too few observations are left out. `rows` is the number of sessions available.
    """
    sessions = F.broadcast(calendar.select(F.col("trade_date").alias("as_of"), F.col("session").alias("__end")))
    asked = candidates.select("as_of", "ticker").join(sessions, "as_of")
    spans = asked.select(
        "as_of",
        "ticker",
        F.least(F.lit(lookback).cast("bigint"), F.col("__end")).alias("rows"),
        F.explode(F.sequence(F.greatest(F.lit(1).cast("bigint"), F.col("__end") - (lookback - 1)), "__end")).alias("session"),
    )
    returns = spans.join(consecutive_returns(prices, calendar), ["ticker", "session"])
    counted = returns.withColumn("observations", F.count(F.lit(1)).over(Window.partitionBy("as_of", "ticker")))
    required = F.greatest(F.lit(minimum), F.ceil(F.col("rows") * coverage))
    return counted.filter(F.col("observations") >= required)


def pair_moments(returns: DataFrame) -> DataFrame:
    """Covariance and common observations of every candidate pair i <= j of an as-of date.

    The candidates of one session form one short array (at most n entries), and pairs are made
    from it inside the row, so no self-join of the return table is needed.
    """
    session = returns.groupBy("as_of", "session").agg(
        F.sort_array(F.collect_list(F.struct(F.col("ticker").alias("t"), F.col("r")))).alias("xs")
    )
    left = session.select("as_of", "xs", F.posexplode("xs").alias("i", "a"))
    pairs = left.select(
        "as_of", F.col("a.t").alias("asset_i"), F.col("a.r").alias("x"), F.explode(F.slice("xs", F.col("i") + 1, F.size("xs"))).alias("b")
    )
    return pairs.groupBy("as_of", "asset_i", F.col("b.t").alias("asset_j")).agg(
        F.covar_samp("x", F.col("b.r")).alias("covariance"), F.count("*").alias("common")
    )


def pairwise_covariance(
    candidates: DataFrame,
    prices: DataFrame,
    calendar: DataFrame,
    lookback: int = 252,
    minimum: int = 60,
    coverage: float = 0.80,
    annualization: float = 252.0,
    shrink: float = 0.20,
) -> DataFrame:
    """Point-in-time covariance with diagonal shrinkage, as pairs i <= j with observation counts.

    A date is left out when fewer than two names pass or any pair has too few common sessions.
    """
    returns = window_returns(candidates, prices, calendar, lookback, minimum, coverage)
    pairs = pair_moments(returns)
    names = F.count(F.when(F.col("asset_i") == F.col("asset_j"), 1))
    dates = pairs.groupBy("as_of").agg(
        names.alias("__n"), F.count("*").alias("__pairs"), F.min("common").alias("__least")
    )
    whole = (F.col("__n") >= 2) & (F.col("__least") >= minimum) & (F.col("__pairs") == F.col("__n") * (F.col("__n") + 1) / 2)
    kept = pairs.join(F.broadcast(dates.filter(whole).select("as_of")), "as_of", "left_semi")
    factor = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(1.0 - shrink) * annualization
    return kept.withColumn("covariance", F.col("covariance") * factor)


def correlations(pairs: DataFrame) -> DataFrame:
    """Correlation of each pair from the variances on the diagonal, clipped to [-1, 1]."""
    variance = pairs.filter("asset_i = asset_j").select(
        "as_of", F.col("asset_i").alias("__a"), F.greatest("covariance", F.lit(VARIANCE_FLOOR)).alias("__v")
    )
    left = variance.select("as_of", F.col("__a").alias("asset_i"), F.col("__v").alias("__vi"))
    right = variance.select("as_of", F.col("__a").alias("asset_j"), F.col("__v").alias("__vj"))
    joined = pairs.join(left, ["as_of", "asset_i"]).join(right, ["as_of", "asset_j"])
    raw = F.col("covariance") / F.sqrt(F.col("__vi") * F.col("__vj"))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    value = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(clipped)
    return joined.select("as_of", "asset_i", "asset_j", value.alias("correlation"), "common")


def ledoit_wolf(returns: DataFrame) -> DataFrame:
    """Shrinkage toward the scaled identity, from grouped sums only.

    `returns` has as_of, session, ticker, r. Only sessions on which every name of the date has a
    return count. Output: pairs i <= j of all names of a date with the shrunk covariance and the
    shrinkage used; with fewer than three sessions, or none, the matrix is 1e-6 times the identity.
    """
    # The returns of a bounded number of names are read by every step below.
    returns = cut_lineage(returns.select("as_of", "session", "ticker", "r"))
    names = returns.select("as_of", "ticker").distinct().groupBy("as_of").agg(F.count("*").alias("p"))
    per_session = returns.groupBy("as_of", "session").agg(F.count("*").alias("__names"))
    full = per_session.join(F.broadcast(names), "as_of").filter(F.col("__names") == F.col("p"))
    rows = returns.join(full.select("as_of", "session", "p"), ["as_of", "session"])
    means = rows.groupBy("as_of", "ticker").agg(F.avg("r").alias("__mean"), F.count("*").alias("n"))
    centred = rows.join(means, ["as_of", "ticker"]).withColumn("r", F.col("r") - F.col("__mean"))
    pairs = pair_moments(centred).withColumn("s", F.col("covariance") * (F.col("common") - 1) / F.col("common"))
    twice = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    norms = pairs.groupBy("as_of").agg(
        F.sum(F.when(F.col("asset_i") == F.col("asset_j"), F.col("s"))).alias("trace"),
        F.sum(twice * F.col("s") * F.col("s")).alias("frobenius"),
    )
    fourth = (
        centred.groupBy("as_of", "session", "p", "n").agg(F.sum(F.col("r") * F.col("r")).alias("q"))
        .groupBy("as_of", "p", "n").agg(F.sum(F.col("q") * F.col("q")).alias("fourth"))
    )
    stats = norms.join(fourth, "as_of")
    mu = F.col("trace") / F.col("p")
    delta = (F.col("frobenius") - 2.0 * mu * F.col("trace") + F.col("p") * mu * mu) / F.col("p")
    beta = (F.col("fourth") / F.col("n") - F.col("frobenius")) / (F.col("p") * F.col("n"))
    stats = stats.withColumns({"mu": mu, "delta": delta, "beta": F.least(beta, delta)})
    stats = stats.select("as_of", "n", "mu", F.when(F.col("beta") == 0, 0.0).otherwise(F.try_divide("beta", "delta")).alias("shrinkage"))
    on_diagonal = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(0.0)
    shrunk = (1.0 - F.col("shrinkage")) * F.col("s") + F.col("shrinkage") * F.col("mu") * on_diagonal
    value = F.when(F.col("n") < 3, 1e-6 * on_diagonal).otherwise(shrunk)
    used = F.when(F.col("n") < 3, 0.0).otherwise(F.col("shrinkage"))
    # The names of a date, not their common sessions, say which pairs there are.
    members = returns.groupBy("as_of").agg(F.sort_array(F.collect_set("ticker")).alias("ts"))
    left = members.select("as_of", "ts", F.posexplode("ts").alias("i", "asset_i"))
    asked = left.select("as_of", "asset_i", F.explode(F.slice("ts", F.col("i") + 1, F.size("ts"))).alias("asset_j"))
    found = asked.join(pairs.select("as_of", "asset_i", "asset_j", "s"), ["as_of", "asset_i", "asset_j"], "left")
    rated = found.join(F.broadcast(stats), "as_of", "left").na.fill(0, ["n"])
    return rated.select("as_of", "asset_i", "asset_j", value.alias("covariance"), used.alias("shrinkage"), "n")


def liquid_candidates(signals: DataFrame, liquidity: str, n: int = 50, issuer: str = "issuer_id") -> DataFrame:
    """Most liquid names of each date, one share class per issuer."""
    order = [F.col(liquidity).desc_nulls_last(), F.col("ticker")]
    single = best_per_issuer(signals, ["trade_date"], order, issuer)
    return top_per_group(single, ["trade_date"], order, n, "liquidity_rank").withColumn("as_of", F.col("trade_date"))


def inverse_volatility_weights(pairs: DataFrame, by: str = "as_of") -> DataFrame:
    """Weights proportional to 1/volatility over the names on the diagonal."""
    inverse = 1.0 / F.sqrt(F.greatest("covariance", F.lit(VARIANCE_FLOOR)))
    diagonal = pairs.filter("asset_i = asset_j").select(by, F.col("asset_i").alias("ticker"), inverse.alias("__inverse"))
    total = F.sum("__inverse").over(Window.partitionBy(by))
    return diagonal.withColumn("target_weight", F.col("__inverse") / total).drop("__inverse")


def liquidity_weight_cap(liquidity_score: Column, k: Column) -> Column:
    """Largest weight of a name given its liquidity score of 0..100, never below 1/k."""
    cap = F.greatest(F.lit(0.10), F.least(F.lit(0.25), 0.10 + 0.20 * liquidity_score / 100.0))
    return F.greatest(cap, 1.0 / k)


def exposure_breaches(weights: DataFrame, sector_limit: float = 0.40, issuer_limit: float = 0.25, by: str = "trade_date") -> DataFrame:
    """Sector and issuer sums above their limits."""
    parts = F.array(
        F.struct(F.lit("sector").alias("kind"), F.col("sector").cast("string").alias("name"), F.lit(sector_limit).alias("limit")),
        F.struct(F.lit("issuer").alias("kind"), F.col("issuer_id").cast("string").alias("name"), F.lit(issuer_limit).alias("limit")),
    )
    sums = weights.select(by, "target_weight", F.inline(parts)).groupBy(by, "kind", "name", "limit").agg(
        F.sum("target_weight").alias("exposure")
    )
    return sums.filter(F.col("exposure") > F.col("limit") + 1e-9)
