from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, factors, folds, quality, selection, technical, universe

D0 = date(2024, 1, 1)


def days(n):
    return [D0 + timedelta(days=i) for i in range(n)]


def prices(spark, rows, schema="trade_date date, ticker string, close double, traded_value_brl double, trades long"):
    return spark.createDataFrame(rows, schema)


def test_label_starts_after_the_signal(spark):
    df = prices(spark, [(d, "AAAA3", c, 1.0, 1) for d, c in zip(days(5), [10.0, 20.0, 30.0, 40.0, 50.0])])
    row = technical.forward_labels(df, (2,), 1).orderBy("trade_date").first()
    assert (row["target_start_date"], row["target_end_date"], row["future_return"]) == (date(2024, 1, 2), date(2024, 1, 4), 1.0)
    with pytest.raises(ValueError):
        technical.forward_labels(df, (2,), 0)


def test_liquidity_and_amihud(spark):
    rows = [(d, t, 10 * 1.01**i, v, 7) for i, d in enumerate(days(22)) for t, v in (("AAAA3", 1000.0), ("BBBB3", 2000.0))]
    out = {r["ticker"]: r for r in technical.trailing_features(prices(spark, rows)).filter(F.col("trade_date") == days(22)[-1]).collect()}
    assert out["AAAA3"]["amihud_illiquidity_21d"] == pytest.approx(0.01 / 1000)
    assert out["AAAA3"]["amihud_illiquidity_21d"] / out["BBBB3"]["amihud_illiquidity_21d"] == pytest.approx(2.0)
    assert out["BBBB3"]["log_traded_value_21d"] == pytest.approx(7.601402334583733)


def test_distribution_change_masks_raw_returns(spark):
    rows = [(d, "AAAA3", c, 1.0, 1, n) for d, c, n in zip(days(4), [10.0, 11.0, 5.0, 6.0], [1, 1, 2, 2])]
    df = spark.createDataFrame(rows, "trade_date date, ticker string, close double, traded_value_brl double, trades long, distribution_number long")
    got = [r["ret_1d"] for r in technical.trailing_features(df).orderBy("trade_date").collect()]
    assert got[0] is None and got[2] is None
    assert got[1] == pytest.approx(0.1) and got[3] == pytest.approx(0.2)


def test_future_prices_do_not_change_features(spark):
    base = [(d, t, 50.0 + (i * k) % 17, 100.0 + i, 3) for i, d in enumerate(days(40)) for k, t in ((3, "AAAA3"), (5, "BBBB3"), (7, "CCCC3"))]
    cut = days(40)[29]
    later = [(d, t, c * 9.0 if d > cut else c, v, n) for d, t, c, v, n in base]
    w = technical.BarWindows(2, 4, 6, 8, 12)

    def features(rows):
        panel = technical.technical_features(prices(spark, rows), w, 3, 1, 10).drop("future_return", "target_start_date", "target_end_date")
        return sorted(map(str, panel.filter(F.col("trade_date") <= F.lit(cut)).collect()))

    assert features(base) == features(later)


def test_month_end_is_common_to_all_tickers(spark):
    rows = [(date(2024, 1, 30), "AAAA3", 1.0, 1.0, 1), (date(2024, 1, 31), "BBBB3", 1.0, 1.0, 1)]
    df = prices(spark, rows)
    kept = technical.monthly_snapshots(df, technical.month_ends(df)).collect()
    assert [r["ticker"] for r in kept] == ["BBBB3"]


def test_sparse_name_is_not_eligible(spark):
    rows = [(d, "LIQD3", 10.0, 100.0, 1) for d in days(8)] + [(d, "SPRS3", 10.0, 100.0, 1) for d in days(8)[::2]]
    config = universe.UniverseConfig(2, 4, 0.75, 2, 1.0)
    out = universe.point_in_time_universe(prices(spark, rows), config)
    last = {r["ticker"]: r["universe_eligible"] for r in out.filter(F.col("trade_date") == days(8)[-1]).collect()}
    assert last == {"LIQD3": True}
    sparse = out.filter("ticker = 'SPRS3'").orderBy("trade_date").collect()[-1]
    assert sparse["universe_rejection_reason"] == "low_session_participation"


def test_ineligible_names_do_not_move_targets(spark):
    signals = [(D0, "ELIG3", 0.1), (D0, "ELIG4", 0.3), (D0, "INEL3", 9.0)]
    flags = [(D0, "ELIG3", True, True, None), (D0, "ELIG4", True, True, None), (D0, "INEL3", True, False, "low_adv")]
    u = spark.createDataFrame(flags, "trade_date date, ticker string, quote_observed boolean, universe_eligible boolean, universe_rejection_reason string")

    def run(rows):
        s = spark.createDataFrame(rows, "trade_date date, ticker string, future_return double")
        out = universe.apply_universe(s, u, group_bound=10)
        return {r["ticker"]: (r["target_excess_return"], r["target_cross_sectional_rank"]) for r in out.collect()}

    assert run(signals) == run(signals[:2])
    everything = universe.apply_universe(spark.createDataFrame(signals + [(D0, "GONE3", 1.0)], "trade_date date, ticker string, future_return double"), u, False, 10)
    reasons = {r["ticker"]: r["universe_rejection_reason"] for r in everything.collect()}
    assert reasons == {"ELIG3": None, "ELIG4": None, "INEL3": "low_adv", "GONE3": "no_quote_on_signal_date"}


def test_quality_rules(spark):
    bad = [(D0, "A", v, 1.0, 1) for v in (0.0, -1.0, float("nan"), float("inf"), float("-inf"), None)]
    df = prices(spark, bad)
    assert quality.invalid_prices(df).count() == 6
    with pytest.raises(quality.DataQualityError, match="invalid prices"):
        quality.check_prices(df)
    with pytest.raises(quality.DataQualityError, match="duplicate"):
        quality.check_prices(prices(spark, [(D0, "A", 1.0, 1.0, 1)] * 2))
    mixed = prices(spark, [(date(2024, 1, 3), "A", 1.0, 1.0, 1), (date(2024, 1, 9), "B", 1.0, 1.0, 1)])
    assert quality.months_with_many_dates(mixed).count() == 1
    pairs = spark.createDataFrame([("A", "A", 0.9), ("A", "B", 1.2), ("B", "B", 1.0), ("B", "C", float("nan"))], "asset_i string, asset_j string, correlation double")
    assert {r["reason"] for r in quality.pair_matrix_violations(pairs, []).collect()} == {"diagonal", "range", "not_finite"}


def test_folds_look_at_label_ends(spark):
    rows = [(date(2024, 1, 2), date(2024, 1, 20)), (date(2024, 1, 5), date(2024, 2, 10)), (date(2025, 12, 1), date(2026, 3, 1))]
    df = spark.createDataFrame(rows, "trade_date date, target_end_date date")
    assert [r[1] for r in folds.purge_overlapping(df, "2024-02-01").collect()] == [date(2024, 1, 20)]
    assert folds.labels_known_by(df, "2025-12-31").count() == 2
    assert folds.embargo_after(df, "2024-01-01", 3).count() == 2


def test_weights(spark):
    rows = [(D0, f"T{i}", o) for i, o in enumerate("AB")] + [(days(2)[1], f"T{i}", o) for i, o in enumerate(["A", "A", "B", None])]
    df = spark.createDataFrame(rows, "trade_date date, ticker string, issuer_id string")
    out = evaluation.issuer_balanced_weights(df).collect()
    by_date = {}
    for r in out:
        by_date[r["trade_date"]] = by_date.get(r["trade_date"], 0) + r["sample_weight"]
    assert len(set(round(v, 12) for v in by_date.values())) == 1
    assert sum(r["sample_weight"] for r in out) / len(out) == pytest.approx(1.0)
    w = [r["recency_weight"] for r in evaluation.recency_weights(df, "2025-01-01", 1.0).orderBy("trade_date").collect()]
    assert w == sorted(w) and sum(w) / len(w) == pytest.approx(1.0)


def test_rank_ic_ignores_level_shifts(spark):
    rows = [(d, f"T{i}", float(i) + k * 1000, float(i)) for k, d in enumerate(days(2)) for i in range(10)]
    df = spark.createDataFrame(rows, "trade_date date, ticker string, prediction double, target_excess_return double")
    for bound in (100, None):
        out = evaluation.cross_section_metrics(df, group_bound=bound).collect()
        assert [r["rank_ic"] for r in out] == pytest.approx([1.0, 1.0])
        assert all(r["top_decile_mean"] == 9.0 and r["bottom_decile_mean"] == 0.0 for r in out)


def test_topk_of_a_perfect_forecast(spark):
    rows = [(D0, f"T{i}", i / 10, i / 10) for i in range(6)]
    df = spark.createDataFrame(rows, "trade_date date, ticker string, prediction double, target_excess_return double")
    for bound in (100, None):
        r = evaluation.topk_metrics(df, (2,), group_bound=bound).first()
        assert (r["precision"], r["recall"], r["ndcg"]) == (1.0, 1.0, pytest.approx(1.0))
        assert r["mean_future_return"] == pytest.approx(0.45) and r["top_minus_bottom"] == pytest.approx(0.4)


def test_factor_contributions_add_up(spark):
    names = ["rank_momentum_12_1", "rank_return_126d", "rank_return_63d", "rank_volatility_63d", "rank_residual_volatility_63d", "rank_roe_proxy"]
    df = spark.createDataFrame([(0.8, 0.6, 0.4, 0.2, 0.4, None)], ", ".join(f"{n} double" for n in names))
    r = factors.composite_score(df).first()
    assert r["momentum_score"] == pytest.approx(0.69) and r["low_volatility_score"] == pytest.approx(0.7) and r["quality_score"] == 0.5
    parts = sum(r[f"quant_contribution_{s}"] for s in factors.SLEEVES)
    assert r["quant_score"] == pytest.approx(parts)
    with pytest.raises(ValueError):
        factors.composite_score(df, {"momentum": -1.0, "low_volatility": 1.0, "quality": 1.0})


def test_issuer_cap_and_rejections(spark):
    rows = [("A1", "I1", 5.0, True, True), ("A2", "I1", 4.0, True, True), ("B1", "I2", 3.0, False, True), ("C1", "I3", 2.0, True, False), ("D1", "I4", 1.0, True, True), ("E1", "I5", 0.5, True, True)]
    df = spark.createDataFrame([(D0, *r) for r in rows], "trade_date date, ticker string, issuer_id string, score double, has_price_history boolean, execution_quote boolean")
    usable = df.filter("has_price_history AND execution_quote")
    assert [r["ticker"] for r in selection.topk_with_issuer_cap(usable, "score", 2).orderBy("rank").collect()] == ["A1", "D1"]
    reasons = {r["ticker"]: r["reason"] for r in selection.rejected_before_cutoff(df, "score", 2).collect()}
    assert reasons == {"A2": "issuer_share_class_cap", "B1": "missing_price_history", "C1": "no_observed_execution_quote"}


def test_names_without_an_issuer_are_told_apart_by_their_root(spark):
    from tidemark.operators import selection

    rows = [("AAAA3", None, 6.0), ("AAAA4", None, 5.0), ("BBBB3", None, 4.0), ("CCCC3", "9", 3.0), ("DDDD3", "9", 2.0), ("EEEE3", None, 1.0)]
    df = spark.createDataFrame([("2024-01-31", *r) for r in rows], "trade_date string, ticker string, issuer_id string, score double")
    got = selection.topk_with_issuer_cap(df, "score", 5).orderBy("rank").collect()
    assert [r["ticker"] for r in got] == ["AAAA3", "BBBB3", "CCCC3", "EEEE3"]


def test_shipments_are_read_once_for_all_views(spark, tmp_path):
    from tidemark.plans.market import Market

    rows = [(k % 3, d, 10.0 + k, 2.0) for k, d in enumerate(days(30))]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    m = Market(spark, str(tmp_path))
    for view in (m.prices, m.unranked, m.universe, m.calendar):
        assert view.count() and not view.inputFiles()


@pytest.mark.parametrize(("values", "median"), [([3.0], 3.0), ([3.0, 1.0], 2.0), ([5.0, None, 1.0, 2.0], 2.0), ([None], None)])
def test_median_of_traded_value(spark, values, median):
    rows = [(d, "LIQD3", 10.0, v, 1) for d, v in zip(days(len(values)), values, strict=True)]
    out = universe.point_in_time_universe(prices(spark, rows), universe.UniverseConfig(1, 4, 0.1, 4, 1.0)).orderBy("trade_date").collect()
    assert out[-1]["adv_brl"] == median


def test_long_sessions_are_dealt_to_many_parts(spark):
    rows = prices(spark, [(d, t, 10.0 + i, 1.0, 1) for i, d in enumerate(days(6)) for t in ("AAAA3", "BBBB3")])
    w = technical.BarWindows(1, 2, 2, 3, 4)
    wide = technical.technical_features(rows, w, 1, 1, 100_000)
    assert wide.rdd.getNumPartitions() == 500
    assert sorted(map(str, wide.collect())) == sorted(map(str, technical.technical_features(rows, w, 1, 1, 10).collect()))
