"""Statement facts: versions, as-known-at sets, trailing flows, ratios and the panel join.

A fact row has issuer_id, reference_date, received, version, account, value and, for flows,
period_start and period_end.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import add_average_ranks
from tidemark.functions.scalars import CURRENCIES, SCALES, safe_ratio
from tidemark.operators.asof import asof_join
from tidemark.operators.intervals import range_join
from tidemark.operators.quality import require_empty

# Account codes of the standard chart.
BALANCE_ACCOUNTS = {"1": "assets", "2.03": "equity", "2.01": "current_liabilities", "2.02": "noncurrent_liabilities"}
FLOW_ACCOUNTS = {"3.01": "revenue", "3.03": "gross_profit", "3.11": "net_income", "6.01": "operating_cash_flow"}
# Accounting descriptors, with numerator and denominator where they are ratios.
RATIOS = {
    "net_margin": ("net_income", "revenue"),
    "roe_proxy": ("net_income", "equity"),
    "roa_proxy": ("net_income", "assets"),
    "asset_turnover": ("revenue", "assets"),
    "gross_margin": ("gross_profit", "revenue"),
    "gross_profitability": ("gross_profit", "assets"),
    "operating_cash_flow_to_assets": ("operating_cash_flow", "assets"),
    "equity_to_assets": ("equity", "assets"),
    "leverage_to_assets": ("total_liabilities", "assets"),
}
DESCRIPTORS = [*RATIOS, "asset_growth", "log_revenue", "log_assets", "log_equity"]
# Gaps and lengths in days that make a quarter or a fiscal year.
QUARTER_MAX_DAYS = 120
QUARTER_MIN_DAYS = 60
FISCAL_YEAR_MIN_DAYS = 330


def earliest_receipt(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """First receipt date of each filing."""
    return documents.groupBy(*keys).agg(F.min("received").alias("received"))


def normalized_amounts(facts: DataFrame, value: str = "value", currency: str = "currency", scale: str = "scale") -> DataFrame:
    """Amounts in single currency units; rows with an unknown currency or scale get a null value
    and are listed by `quality.values_not_allowed`, which callers check first."""
    table = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    known = F.upper(F.trim(currency)).isin(CURRENCIES)
    multiplier = table[F.upper(F.trim(scale))]
    raw = F.col(value).try_cast("double")
    return facts.withColumns(
        {
            f"raw_{value}": raw,
            "currency_scale_multiplier": multiplier,
            value: F.when(known, raw * multiplier),
            "normalized_currency": F.when(known, F.lit("BRL")),
        }
    )


def latest_version(facts: DataFrame) -> DataFrame:
    """Rows of the highest version within (issuer, reference date, receipt date)."""
    order = F.coalesce(F.col("version").cast("bigint"), F.lit(-1))
    w = Window.partitionBy("issuer_id", "reference_date", "received")
    return (
        facts.withColumn("__v", order).withColumn("__top", F.max("__v").over(w)).filter("__v = __top").drop("__v", "__top")
    )


def account_columns(facts: DataFrame, keys: list[str], accounts: Mapping[str, str]) -> DataFrame:
    """Accounts as columns by conditional maximum; no pivot pass is needed for a fixed list."""
    return facts.groupBy(*keys).agg(
        *[F.max(F.when(F.col("account") == code, F.col("value"))).alias(name) for code, name in accounts.items()]
    )


def latest_reference(snapshots: DataFrame) -> DataFrame:
    """One row per receipt: the newest reference period in that filing batch."""
    w = Window.partitionBy("issuer_id", "received").orderBy(F.col("reference_date").desc())
    return snapshots.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def known_facts(facts: DataFrame) -> DataFrame:
    """For each receipt date of an issuer, the facts known then, restatements applied.

    A fact is current from its receipt until the next receipt of the same (account, period), so
    each receipt joins the facts whose currency span covers it and no later overwrite is searched.
    The fan-out is receipts x periods of one issuer, both bounded by the reporting calendar.
    """
    key = ["issuer_id", "account", "period_start", "period_end"]
    valued = facts.filter(F.col("received").isNotNull() & F.col("account").isNotNull() & F.col("value").isNotNull())
    single = valued.groupBy(*key, "received").agg(
        F.max_by("value", F.struct("reference_date", F.coalesce(F.col("version"), F.lit(-1)))).alias("value")
    )
    w = Window.partitionBy(*key).orderBy("received")
    spans = single.withColumn("superseded", F.lead("received").over(w))
    receipts = single.select(F.col("issuer_id").alias("__issuer"), F.col("received").alias("as_of")).distinct()
    covers = (
        (F.col("issuer_id") == F.col("__issuer"))
        & (F.col("received") <= F.col("as_of"))
        & (F.col("superseded").isNull() | (F.col("superseded") > F.col("as_of")))
    )
    return receipts.join(spans, covers).select("as_of", *key, "received", "value")


def trailing_flows(facts: DataFrame, accounts: Mapping[str, str] = FLOW_ACCOUNTS) -> DataFrame:
    """Trailing four-quarter flows at each receipt, else the latest fiscal year, with the basis."""
    flows = facts.filter(F.col("account").isin(list(accounts)))
    known = known_facts(flows).filter(F.col("period_start").isNotNull() & F.col("period_end").isNotNull())
    cell = ["issuer_id", "as_of", "account"]
    w = Window.partitionBy(*cell, "period_start").orderBy("period_end")
    days = F.datediff("period_end", "period_start") + 1
    previous_end = F.lag("period_end").over(w)
    fresh = previous_end.isNull() | (F.datediff("period_end", previous_end) > QUARTER_MAX_DAYS)
    discrete = F.when(fresh, F.when(days <= QUARTER_MAX_DAYS, F.col("value"))).otherwise(
        F.col("value") - F.lag("value").over(w)
    )
    pieces = known.withColumns({"days": days, "discrete": discrete})
    fiscal = pieces.filter(F.col("days") >= FISCAL_YEAR_MIN_DAYS).groupBy(*cell).agg(
        F.max_by("value", F.struct("period_end", "period_start")).alias("fiscal_year")
    )
    quarters = pieces.filter(F.col("discrete").isNotNull()).groupBy(*cell, "period_end").agg(
        F.max_by("discrete", "period_start").alias("discrete")
    )
    wq = Window.partitionBy(*cell).orderBy(F.col("period_end").desc())
    recent = (
        quarters.withColumns(
            {"n": F.row_number().over(wq), "gap": F.datediff("period_end", F.lead("period_end").over(wq))}
        )
        .filter("n <= 4")
        .groupBy(*cell)
        .agg(
            F.count("*").alias("quarters"),
            F.sum("discrete").alias("ttm"),
            F.sum((F.col("gap").between(QUARTER_MIN_DAYS, QUARTER_MAX_DAYS) & (F.col("n") < 4)).cast("int")).alias("even"),
        )
    )
    consecutive = (F.col("quarters") == 4) & (F.col("even") == 3)
    both = recent.join(fiscal, cell, "full")
    return both.select(
        *cell,
        F.when(consecutive, F.col("ttm")).otherwise(F.col("fiscal_year")).alias("value"),
        F.when(consecutive, "TTM").when(F.col("fiscal_year").isNotNull(), "FY").alias("basis"),
    )


def company_snapshots(facts: DataFrame) -> DataFrame:
    """One row per issuer and receipt date: balances, trailing flows and scale-free descriptors."""
    current = latest_version(facts)
    balances = latest_reference(
        account_columns(current, ["issuer_id", "reference_date", "received"], BALANCE_ACCOUNTS)
    )
    if {"period_start", "period_end"} <= set(facts.columns):
        trailing = trailing_flows(current)
        flows = trailing.groupBy("issuer_id", F.col("as_of").alias("received")).agg(
            *[F.max(F.when(F.col("account") == c, F.col("value"))).alias(n) for c, n in FLOW_ACCOUNTS.items()],
            *[F.max(F.when(F.col("account") == c, F.col("basis"))).alias(f"{n}_basis") for c, n in FLOW_ACCOUNTS.items()],
        )
    else:
        flows = account_columns(current, ["issuer_id", "received"], FLOW_ACCOUNTS)
    rows = balances.join(flows, ["issuer_id", "received"], "left")
    w = Window.partitionBy("issuer_id").orderBy("received", "reference_date")
    owed = F.coalesce("current_liabilities", F.lit(0.0)) + F.coalesce("noncurrent_liabilities", F.lit(0.0))
    rows = rows.withColumns(
        {
            "total_liabilities": F.when(
                F.col("current_liabilities").isNotNull() | F.col("noncurrent_liabilities").isNotNull(), owed
            ),
            "asset_growth": safe_ratio(F.col("assets"), F.lag("assets").over(w)) - 1.0,
        }
    )

    def log_of(name: str) -> Column:
        return F.when(F.col(name) > 0, F.log1p(name))

    return rows.withColumns(
        {
            **{out: safe_ratio(F.col(n), F.col(d)) for out, (n, d) in RATIOS.items()},
            "log_revenue": log_of("revenue"),
            "log_assets": log_of("assets"),
            "log_equity": log_of("equity"),
            "negative_equity": F.col("equity").isNotNull() & (F.col("equity") <= 0),
        }
    )


def check_snapshots(snapshots: DataFrame) -> None:
    require_empty(
        snapshots.filter(F.col("reference_date") > F.col("received")).select("issuer_id", "reference_date", "received"),
        "reference dates after receipt dates",
    )


def freshness(panel: DataFrame, stale_after_days: int = 180) -> DataFrame:
    """Age of the attached filing, staleness, and how many descriptors are present."""
    age = F.datediff("trade_date", "reference_date")
    present = [c for c in DESCRIPTORS if c in panel.columns]
    panel = panel.withColumns(
        {"fundamental_age_days": age, "stale_fundamental": age.isNull() | (age > stale_after_days)}
    )
    if not present:
        return panel
    available = sum((F.col(c).isNotNull().cast("bigint") for c in present), F.lit(0).cast("bigint"))
    return panel.withColumns(
        {"fundamental_available_count": available, "fundamental_missing_fraction": 1.0 - available / float(len(present))}
    )


def attach_fundamentals(
    panel: DataFrame,
    snapshots: DataFrame,
    bridge: DataFrame,
    stale_after_days: int = 180,
    group_bound: int | None = None,
    sector_ranked: tuple[str, ...] = (),
    ranks: bool = True,
) -> DataFrame:
    """Join each panel row to the filing its issuer had made public by that date."""
    mapped = range_join(panel, bridge)
    joined = asof_join(mapped, snapshots, ["issuer_id"], "trade_date", "received")
    joined = freshness(joined, stale_after_days)
    if not ranks:
        return joined
    present = [c for c in DESCRIPTORS if c in joined.columns]
    joined = add_average_ranks(
        joined, ["trade_date"], {f"rank_{c}": c for c in present}, ["ticker"], group_bound, "observed"
    )
    if "sector" in bridge.columns:
        wanted = [*present, *[c for c in sector_ranked if c in joined.columns]]
        joined = add_average_ranks(
            joined, ["trade_date", "sector"], {f"sector_rank_{c}": c for c in wanted}, ["ticker"], group_bound, "observed"
        )
    return joined
