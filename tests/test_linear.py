"""The linear branch from sums, held against a plain fit of every window."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning, linear

FEATURES = ["a", "b", "flat", "gone"]
POLICIES = [learning.TrainingPolicy(), learning.TrainingPolicy("rolling", window_years=1), learning.TrainingPolicy("decay", half_life_years=1.0)]


def history():
    rng = np.random.default_rng(3)
    rows = []
    for month in range(36):
        day = date(2000 + month // 12, month % 12 + 1, 20)
        for k in range(12):
            a = None if rng.random() < 0.2 else float(rng.normal())
            b = float("inf") if month > 20 and rng.random() < 0.1 else float(rng.random())
            target = 0.3 * (a or 0.0) - 0.1 * (b if b < 9 else 0.5) + 0.1 * float(rng.normal())
            # Some labels of December end in the next year, so a fold's purge cuts that date.
            rows.append((day, f"T{k:02d}", f"I{k // 2}" if k else None, day + timedelta(days=8 + k % 3 * 4), target, float(k), a, b, 1.1, None))
    return rows


SCHEMA = "trade_date date, ticker string, issuer_id string, target_end_date date, target_excess_return double, other double, a double, b double, flat double, gone double"


def plain_fit(rows, policy, year, target, alpha):
    start = date(year, 1, 1)
    train = [r for r in rows if r[0] < start and r[3] < start and (policy.window_years is None or r[0].year >= year - policy.window_years)]
    owner = [r[2] or "~" + r[1] for r in train]
    weights = []
    for r, own in zip(train, owner, strict=True):
        there = [o for q, o in zip(train, owner, strict=True) if q[0] == r[0]]
        decay = 0.5 ** ((start - r[0]).days / 365.25 / policy.half_life_years) if policy.half_life_years else 1.0
        weights.append(decay / (len(set(there)) * there.count(own)))
    w = np.array(weights) / np.mean(weights)
    x = np.array([[np.nan if v is None or not np.isfinite(v) else v for v in r[6:]] for r in train])
    y = np.array([r[target] for r in train])
    gaps = np.isnan(x)
    median = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    full = np.hstack([np.where(gaps, median, x), gaps])
    used = full.std(axis=0) > 1e-9
    z = (full[:, used] - full[:, used].mean(axis=0)) / full[:, used].std(axis=0)
    z_centre, y_centre = (w @ z) / w.sum(), (w @ y) / w.sum()
    z0 = z - z_centre
    coefficients = np.linalg.solve(z0.T @ (w[:, None] * z0) + alpha * np.eye(z.shape[1]), z0.T @ (w * (y - y_centre)))

    def predict(values):
        v = np.array([np.nan if c is None or not np.isfinite(c) else c for c in values])
        own = np.concatenate([np.where(np.isnan(v), median, v), np.isnan(v)])[used]
        return y_centre + ((own - full[:, used].mean(axis=0)) / full[:, used].std(axis=0) - z_centre) @ coefficients

    return len(train), used, coefficients, predict


@pytest.fixture(scope="module")
def fitted(spark):
    rows = history()
    panel = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, panel, linear.fit_folds(panel, [2000, 2001, 2002], FEATURES, POLICIES, ("target_excess_return", "other"), (0.5, 10.0), 20).cache()


def test_every_window_equals_a_plain_fit(fitted):
    rows, _, models = fitted
    got = models.collect()
    assert len(got) == 3 * 2 * 2 * 2 and {m["fold_year"] for m in got} == {2001, 2002}  # 2000 has nothing to learn from
    policies = {p.name: p for p in POLICIES}
    for m in got:
        n, used, coefficients, _ = plain_fit(rows, policies[m["policy"]], m["fold_year"], {"target_excess_return": 4, "other": 5}[m["target"]], m["alpha"])
        assert m["train_rows"] == n and list(m["used"]) == list(used)
        np.testing.assert_allclose(np.array(m["standard"])[used], coefficients, rtol=1e-8, atol=1e-10)
    assert not any(m["used"][2] or m["used"][3] for m in got)


def test_predictions_fill_gaps_with_the_windows_median(fitted):
    rows, panel, models = fitted
    scored = linear.predict_folds(models.filter("target = 'target_excess_return' AND alpha = 10"), panel, FEATURES, min_valid=10).collect()
    assert len(scored) == 3 * 2 * 12 * 12
    by_key = {(r[0], r[1]): r for r in rows}
    plain = {(p.name, y): plain_fit(rows, p, y, 4, 10.0)[3] for p in POLICIES for y in (2001, 2002)}
    for s in scored[::7]:
        assert s["prediction"] == pytest.approx(plain[(s["policy"], s["fold_year"])](by_key[(s["trade_date"], s["ticker"])][6:]), abs=1e-9)


def test_one_ticker_more_and_later_dates_change_no_earlier_fold(fitted, spark):
    rows, _, models = fitted
    later = [(*r[:4], 99.0, *r[5:]) if r[0].year == 2002 else r for r in rows]
    again = linear.fit_folds(spark.createDataFrame(later, SCHEMA), [2001], FEATURES, POLICIES[:1], alphas=(10.0,), min_train=20).first()
    before = models.filter("policy = 'expanding' AND fold_year = 2001 AND alpha = 10 AND target = 'target_excess_return'").first()
    np.testing.assert_allclose(again["standard"], before["standard"], rtol=1e-9, atol=1e-12)


def test_no_rows_give_no_models(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert linear.fit_folds(empty, [2001], FEATURES, POLICIES).count() == 0


def test_the_outer_year_has_no_say_in_the_choice(spark):
    rows = [("p", 1.0, y, 0.1) for y in (1, 2, 3)] + [("q", 1.0, y, 0.2) for y in (1, 2, 3)] + [("p", 1.0, 4, 9.0), ("q", 1.0, 4, -9.0), ("r", 1.0, 3, 5.0), ("r", 1.0, 4, 5.0)]
    yearly = spark.createDataFrame(rows, "policy string, alpha double, fold_year int, rank_ic double")
    chosen = linear.nested_choice(yearly, [1, 4]).collect()
    assert [(c["fold_year"], c["policy"], c["trials"], c["outer_value"]) for c in chosen] == [(4, "q", 2, -9.0)]
    assert chosen[0]["inner_value"] == pytest.approx(0.2) and yearly.agg(F.count("*")).first()[0] == 10


def test_medians_deal_out_only_the_middle_of_each_window(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for month in range(36):
        day = date(2000 + month // 12, month % 12 + 1, 20)
        for k in range(40):
            a = None if rng.random() < 0.1 else float(rng.normal(month % 3))
            rows.append((day, f"T{k:02d}", f"I{k}", day, 0.1, 0.2, a, float(rng.integers(0, 3)), float(month) if k % 2 else -0.0, None))
    panel = spark.createDataFrame(rows, SCHEMA)
    sliced = linear.sliced(panel, [2001, 2002])
    members = linear.memberships(panel.groupBy(F.col("trade_date").alias("date")).agg(F.max("target_end_date").alias("last")), [2001, 2002], POLICIES)
    dealt = []
    plain = linear.running_before
    monkeypatch.setattr(linear, "running_before", lambda df, *a, **b: dealt.append(df.agg(F.sum("n")).first()[0]) or plain(df, *a, **b))
    got = {(m["window"], m["fold_year"], m["feature"]): m["median"] for m in linear.window_medians(sliced, members, FEATURES).collect()}
    expected = {}
    for window, year in ((None, 2001), (None, 2002), (1, 2001), (1, 2002)):
        for i in range(4):
            values = [r[6 + i] for r in rows if r[0].year < year and (window is None or r[0].year >= year - window) and r[6 + i] is not None]
            if values:
                expected[(window, year, i)] = float(np.median(values))
    assert got == pytest.approx(expected, abs=0.0)
    # Columns of few values have large cells, the others small ones.
    everything = sum(len([r for r in rows if r[0].year < y and (w is None or r[0].year >= y - w)]) * 3 for w, y in ((None, 2001), (None, 2002), (1, 2001), (1, 2002)))
    assert dealt[0] < everything * 0.6
