"""Model queries; fits have no SQL twin, what is computed from their predictions has tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import learning
from tidemark.plans.market import Market
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

FEATURES = [
    "rank_momentum_12_1", "rank_return_12w", "rank_volatility_12w", "rank_log_traded_value_4w", "rank_amihud_illiquidity_4w",
    "rank_short_term_reversal_2w", "distance_sma_12w",
]
#: Years at the end of the panel that count as recent.
RECENT = 4


def training_panel(m: Market):
    """Month-end rows with features, targets and label ends, written once for all fits."""
    columns = ["trade_date", "ticker", "issuer_id", "target_end_date", "future_return", "target_excess_return", "target_cross_sectional_rank"]
    return cut_lineage(m.investible.select(*columns, *FEATURES).filter("target_excess_return IS NOT NULL"))


def panel_years(panel) -> list[int]:
    """All years of the panel; a walk-forward run keeps those with enough rows on both sides."""
    return sorted(r[0] for r in panel.select(F.year("trade_date")).distinct().collect())  # a few dozen rows at most


@query("ensemble_predictions")
def ensemble_predictions(spark, sf_dir):
    m = Market(spark, sf_dir)
    panel = training_panel(m)
    scored = learning.walk_forward(panel, panel_years(panel), FEATURES, min_train=100, min_valid=20, group_bound=m.cross_section)
    return scored.select("fold_year", "trade_date", "ticker", "prediction", "disagreement", "uncertainty", "prediction_rank")


@query("walk_forward_ic")
def walk_forward_ic(spark, sf_dir):
    m = Market(spark, sf_dir)
    panel = training_panel(m)
    scored = learning.walk_forward(panel, panel_years(panel), FEATURES, min_train=100, min_valid=20, group_bound=m.cross_section)
    return learning.fold_metrics(cut_lineage(scored), group_bound=m.cross_section)


@query("policy_grid")
def policy_grid(spark, sf_dir):
    m = Market(spark, sf_dir)
    panel = training_panel(m)
    years = panel_years(panel)
    recent = years[-RECENT:] or [0]
    return learning.policy_grid(panel, years, (recent[0], recent[-1]), FEATURES, group_bound=m.cross_section)
