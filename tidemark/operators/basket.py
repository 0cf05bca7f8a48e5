"""Scoring and searching equal-weight baskets by mean-variance utility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def basket_terms(alpha: DataFrame, pairs: DataFrame, k: int, risk_aversion: float, horizon: int, bars_per_year: int = 252) -> tuple[DataFrame, DataFrame]:
    """Linear terms per name and joint terms per pair of an equal-weight basket of k names.

    `alpha`: as_of, ticker, alpha. `pairs`: annual covariance, i <= j.
    """
    scale = horizon / bars_per_year
    diagonal = pairs.filter("asset_i = asset_j").select("as_of", F.col("asset_i").alias("ticker"), "covariance")
    linear = alpha.join(diagonal, ["as_of", "ticker"]).select(
        "as_of",
        "ticker",
        (F.col("alpha") / k - risk_aversion * F.col("covariance") * scale / (k * k)).alias("linear"),
    )
    joint = pairs.filter("asset_i < asset_j").select(
        "as_of", "asset_i", "asset_j", (-2.0 * risk_aversion * F.col("covariance") * scale / (k * k)).alias("joint")
    )
    return linear, joint


def basket_utility(baskets: DataFrame, alpha: DataFrame, pairs: DataFrame, risk_aversion: float, horizon: int, bars_per_year: int = 252) -> DataFrame:
    """Utility of any number of baskets: mu'w - lambda * w'Cw with w = 1/k.

    `baskets`: as_of, basket_id, members (sorted array). A basket is scored only when every name
    and pair is known.
    """
    scale = horizon / bars_per_year
    k = F.size("members")
    singles = baskets.select("as_of", "basket_id", k.alias("k"), F.explode("members").alias("ticker"))
    linear = singles.join(alpha, ["as_of", "ticker"]).groupBy("as_of", "basket_id", "k").agg(
        (F.sum("alpha") / F.col("k")).alias("mu"), F.count("*").alias("found")
    )
    cells = baskets.select("as_of", "basket_id", "members", F.posexplode("members").alias("i", "asset_i")).select(
        "as_of", "basket_id", "asset_i", F.explode(F.slice("members", F.col("i") + 1, k)).alias("asset_j")
    )
    weight = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    variance = cells.join(pairs, ["as_of", "asset_i", "asset_j"]).groupBy("as_of", "basket_id").agg(
        F.sum(weight * F.col("covariance")).alias("quadratic"), F.count("*").alias("cells")
    )
    joined = linear.join(variance, ["as_of", "basket_id"]).filter(
        (F.col("found") == F.col("k")) & (F.col("cells") == F.col("k") * (F.col("k") + 1) / 2)
    )
    risk = F.col("quadratic") * scale / (F.col("k") * F.col("k"))
    return joined.select(
        "as_of", "basket_id", "k", "mu", risk.alias("variance"), (F.col("mu") - risk_aversion * risk).alias("utility")
    )


def _book(candidates: DataFrame, pairs: DataFrame, k: int, risk_aversion: float, horizon: int, bars_per_year: int) -> DataFrame:
    """One row per date: its candidates in ticker order and the joint terms as a square table; both bounded by n candidates."""
    linear, joint = basket_terms(candidates.select("as_of", "ticker", "alpha"), pairs, k, risk_aversion, horizon, bars_per_year)
    names = candidates.join(linear, ["as_of", "ticker"]).select("as_of", "ticker", "issuer_id", "sector", "linear")
    listed = names.groupBy("as_of").agg(F.sort_array(F.collect_list(F.struct("ticker", "issuer_id", "sector", "linear"))).alias("names"))
    terms = joint.groupBy("as_of").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("asset_i", "asset_j"), F.col("joint")))).alias("joint"))
    cell = lambda a, b: F.col("joint")[F.struct(a["ticker"].alias("asset_i"), b["ticker"].alias("asset_j"))]
    square = F.transform("names", lambda a: F.transform("names", lambda b: cell(a, b)))
    return listed.join(terms, "as_of").select("as_of", "names", square.alias("joint"))


def basket_beam(
    candidates: DataFrame,
    pairs: DataFrame,
    k: int,
    risk_aversion: float = 0.7,
    horizon: int = 21,
    width: int | None = 200,
    sector_share: float = 0.40,
    bars_per_year: int = 252,
) -> DataFrame:
    """Grow baskets name by name, keeping the best `width` partial baskets of each date.

    `candidates`: as_of, ticker, alpha, issuer_id, sector, already cut to a fixed number per date.
    One name per issuer and at most max(1, floor(sector_share * k)) per sector. Names are added in
    ticker order, so each basket is built once. `width` None keeps every partial basket, which is
    an exhaustive search for small k; otherwise the result is a beam, not a proven optimum.
    """
    most = max(1, int(sector_share * k))
    # Read once per level; one row per date, so its lineage is cut.
    book = cut_lineage(_book(candidates, pairs, k, risk_aversion, horizon, bars_per_year))
    beam = book.select("as_of", F.posexplode("names").alias("p", "c")).select(
        "as_of",
        F.array("p").alias("places"),
        F.array("c.ticker").alias("members"),
        F.array("c.issuer_id").alias("issuers"),
        F.array("c.sector").alias("sectors"),
        F.col("c.linear").alias("utility"),
    )
    for _ in range(k - 1):
        grown = beam.join(F.broadcast(book), "as_of").select(
            "as_of", "places", "members", "issuers", "sectors", "utility", "joint", F.posexplode("names").alias("p", "c")
        )
        same_sector = F.size(F.filter("sectors", lambda s: s == F.col("c.sector")))
        allowed = (
            (F.col("p") > F.element_at("places", -1))
            & ~F.array_contains("issuers", F.col("c.issuer_id"))
            & (same_sector < most)
        )
        together = F.aggregate(
            "places", F.lit(0.0), lambda s, i: s + F.col("joint")[i][F.col("p")]
        )
        beam = grown.filter(allowed).select(
            "as_of",
            F.array_append("places", F.col("p")).alias("places"),
            F.array_append("members", F.col("c.ticker")).alias("members"),
            F.array_append("issuers", F.col("c.issuer_id")).alias("issuers"),
            F.array_append("sectors", F.col("c.sector")).alias("sectors"),
            (F.col("utility") + F.col("c.linear") + together).alias("utility"),
        ).filter(F.col("utility").isNotNull())
        if width is not None:
            w = Window.partitionBy("as_of").orderBy(F.col("utility").desc(), "members")
            beam = beam.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= width).drop("__n")
    w = Window.partitionBy("as_of").orderBy(F.col("utility").desc(), "members")
    best = beam.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    label = "beam" if width is not None else "exhaustive"
    return best.select("as_of", F.lit(k).alias("k"), "members", "utility", F.lit(label).alias("search"))


def basket_best(
    candidates: DataFrame,
    pairs: DataFrame,
    k: int,
    risk_aversion: float = 0.7,
    horizon: int = 21,
    sector_share: float = 0.40,
    bars_per_year: int = 252,
) -> DataFrame:
    """The best basket of k names of each date, exactly: level-wise growth that drops only what cannot win.

    Takes what `basket_beam` takes. A beam's basket is the score to beat. Of a partial basket, each name that may still be added
    is worth its linear term, its joint terms with the members, and at most half of its k best joint terms with other names
    (each pair of added names is counted from both sides); the sum over the most valuable of them bounds what the basket can reach.
    A basket below the score to beat, less rounding, is dropped; nothing else is, so a date's work grows with how close its
    candidates are, and there is no width. Equal utilities are decided by the members' names.
    """
    first = cut_lineage(basket_beam(candidates, pairs, k, risk_aversion, horizon, 50, sector_share, bars_per_year))
    most = max(1, int(sector_share * k))
    book = _book(candidates, pairs, k, risk_aversion, horizon, bars_per_year)
    # Joint terms in both directions, and half of the sum of the largest 0, 1, ... of each name.
    size = F.size("names")
    both = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.coalesce(F.col("joint")[F.least(i, j)][F.greatest(i, j)], F.lit(0.0))))
    book = cut_lineage(book.filter(size > 0).withColumn("both", both).join(first.select("as_of", F.col("utility").alias("goal")), "as_of"))
    others = lambda row, i: F.reverse(F.array_sort(F.filter(row, lambda v, j: j != i)))
    halves = F.transform("both", lambda row, i: F.transform(F.sequence(F.lit(0), F.lit(k)), lambda m: 0.5 * F.aggregate(F.slice(others(row, i), F.lit(1), F.greatest(m, F.lit(0))), F.lit(0.0), lambda s, v: s + v)))
    book = cut_lineage(book.withColumn("halves", halves))
    grown = book.select("as_of", "names", "joint", "both", "halves", "goal", F.posexplode("names").alias("p", "c")).select(
        "as_of", F.array("p").alias("places"), F.array("c.ticker").alias("members"), F.array("c.issuer_id").alias("issuers"), F.array("c.sector").alias("sectors"),
        F.col("c.linear").alias("utility"), "names", "both", "halves", "goal",
    )
    held = ["as_of", "places", "members", "issuers", "sectors", "utility"]
    for level in range(1, k + 1):
        missing = k - level
        if missing:
            worth = F.transform(
                F.sequence(F.element_at("places", -1) + 1, F.size("names")),
                lambda j: F.get("names", j)["linear"] + F.aggregate("places", F.lit(0.0), lambda s, i: s + F.get(F.get("both", i), j)) + F.get(F.get("halves", j), F.lit(missing - 1)),
            )
            # The sequence ends one past the last name, so that it never runs backwards; that entry is null and goes.
            best = F.slice(F.reverse(F.array_sort(F.filter(worth, lambda v: v.isNotNull()))), 1, missing)
            bound = F.col("utility") + F.aggregate(best, F.lit(0.0), lambda s, v: s + v)
            slack = 1e-12 * F.greatest(F.lit(1.0), F.abs("goal"))
            grown = grown.filter((F.size(best) == missing) & (bound >= F.col("goal") - slack))
        baskets = cut_lineage(grown.select(*held))
        if not missing:
            break
        wide = baskets.join(book, "as_of").select(*held, "names", "joint", "both", "halves", "goal", F.posexplode("names").alias("p", "c"))
        allowed = (F.col("p") > F.element_at("places", -1)) & ~F.array_contains("issuers", F.col("c.issuer_id")) & (F.size(F.filter("sectors", lambda s: s == F.col("c.sector"))) < most)
        together = F.aggregate("places", F.lit(0.0), lambda s, i: s + F.col("joint")[i][F.col("p")])
        grown = wide.filter(allowed).select(
            "as_of", F.array_append("places", F.col("p")).alias("places"), F.array_append("members", F.col("c.ticker")).alias("members"),
            F.array_append("issuers", F.col("c.issuer_id")).alias("issuers"), F.array_append("sectors", F.col("c.sector")).alias("sectors"),
            (F.col("utility") + F.col("c.linear") + together).alias("utility"), "names", "both", "halves", "goal",
        ).filter(F.col("utility").isNotNull())
    w = Window.partitionBy("as_of").orderBy(F.col("utility").desc(), "members")
    best = baskets.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return best.select("as_of", F.lit(k).alias("k"), "members", "utility", F.lit("exact").alias("search"))
