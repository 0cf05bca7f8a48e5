import random
from datetime import date, timedelta
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_cdf
from tidemark.operators import basket, book, performance, risk, statistics

D0 = date(2024, 1, 1)


def calendar(spark, n):
    return spark.createDataFrame([(D0 + timedelta(days=i), i) for i in range(n)], "trade_date date, session long")


def run_book(spark, closes, bps, signal=0):
    n = len(closes)
    cal = calendar(spark, n)
    targets = spark.createDataFrame([("s", D0 + timedelta(days=signal), "A", 1.0)], "strategy string, trade_date date, ticker string, target_weight double")
    rets = spark.createDataFrame([("A", i, closes[i] / closes[i - 1] - 1.0) for i in range(1, n)], "ticker string, session long, asset_return double")
    rf = cal.select("trade_date", "session", F.lit(0.0).alias("rf"))
    periods = book.rebalance_periods(targets, cal)
    holdings = book.holding_values(targets, periods, rets, rf)
    values = book.period_values(holdings)
    orders = book.order_book(targets, periods, book.drifted_weights(holdings, periods, values))
    turnover = book.half_l1_turnover(orders)
    curve = book.equity_curves(periods, values, turnover, (bps,), cal).orderBy("session")
    return [r["net_value"] for r in curve.collect()], turnover.collect()


def test_signal_earns_from_the_next_close(spark):
    assert run_book(spark, [10.0, 20.0, 22.0], 0.0)[0] == pytest.approx([100_000.0, 100_000.0, 110_000.0])


def test_first_purchase_is_charged(spark):
    curve, turnover = run_book(spark, [10.0, 10.0, 10.0], 10.0)
    assert curve[-1] == pytest.approx(99_900.0) and turnover[0]["turnover"] == pytest.approx(1.0)


def test_half_l1(spark):
    rows = [("s", 1, "A", 0.5, 0.0), ("s", 1, "B", 0.5, 0.5), ("s", 1, "C", 0.0, 0.5), ("s", 2, "cash", 1.0, 0.0), ("s", 2, "A", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "strategy string, period long, ticker string, held double, wanted double")
    assert {r["period"]: r["turnover"] for r in book.half_l1_turnover(df).collect()} == {1: 0.5, 2: 1.0}


def test_liquidity_costs(spark):
    rows = [("s", 1, t, 0.0, w, 1e6, 0.02) for t, w in (("A", 0.01), ("B", 0.10))]
    df = spark.createDataFrame(rows, "strategy string, period long, ticker string, held double, wanted double, adv double, sigma double")
    out = {r["ticker"]: r for r in book.liquidity_fills(df, (1e6,), (0.05,), 2.0).collect()}
    assert out["A"]["filled"] == pytest.approx(0.01) and out["B"]["filled"] == pytest.approx(0.05)
    assert out["B"]["participation"] > out["A"]["participation"] and out["A"]["impact"] > 0
    assert out["A"]["spread"] == pytest.approx(0.01 * 30 / 1e4)


def test_hysteresis_keeps_a_held_name(spark):
    rows = [("s", D0, "KEEP3", 1), ("s", D0 + timedelta(days=31), "NEW3", 1), ("s", D0 + timedelta(days=31), "KEEP3", 2)]
    df = spark.createDataFrame(rows, "strategy string, trade_date date, ticker string, rank long")
    out = book.hysteresis_selection(df, 1, 1).orderBy("trade_date").collect()
    assert [r["ticker"] for r in out] == ["KEEP3", "KEEP3"]


@pytest.mark.parametrize("k, buffer", [(3, 2), (1, 0), (4, -1), (0, 3), (9, 2)])
def test_hysteresis_equals_a_plain_walk(spark, k, buffer):
    picks, rows, plain = random.Random(7), [], []
    for strategy in ("s", "t"):
        held = set()
        for month in range(30):
            names = picks.sample("ABCDEFGH", picks.randint(1, 8))[: max(k + max(buffer, 0), 1)]
            day = D0 + timedelta(days=31 * month)
            rows += [(strategy, day, name, i + 1) for i, name in enumerate(names)]
            chosen = book.held_then_best(names, held, k, buffer)
            held = set(chosen)
            plain += [(strategy, day, n, names.index(n) + 1, 1.0 / len(chosen)) for n in chosen]
    picks.shuffle(rows)
    df = spark.createDataFrame(rows, "strategy string, trade_date date, ticker string, rank long").repartition(5)
    out = book.hysteresis_selection(df, k, buffer)
    assert sorted(tuple(r) for r in out.collect()) == sorted(plain)
    assert book.hysteresis_selection(df.limit(0), k, buffer).count() == 0


def test_relative_growth_of_long_paths(spark):
    schema = "strategy string, s double, b double"
    rows = [("a", 0.10, 0.05), ("a", -0.02, 0.01), ("long", 9.0, 0.0)] + [("long", 9.0, 0.0)] * 399
    out = {r["strategy"]: (r["relative_cagr"], r["periods"]) for r in performance.relative_cagr(spark.createDataFrame(rows, schema), "s", "b").collect()}
    assert out["a"] == (pytest.approx((1.10 * 0.98 / (1.05 * 1.01)) ** 6 - 1.0), 2)
    # The wealth ratio itself, 10 ** 400, is no number.
    assert out["long"] == (pytest.approx(1e12, rel=1e-9), 400)
    for bad in (-1.0, None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="above -100 %"):
            performance.relative_cagr(spark.createDataFrame([("a", bad, 0.0)], schema), "s", "b").collect()


def test_cost_table_pays_each_execution(spark):
    fills = spark.createDataFrame(
        [("s", p, 100.0, cap, t, 0.0, 0.5, f, f, fee, 0.0, 0.01) for p, t, f, cap, fee in (
            (1, "A", 0.5, 0.1, 0.02), (1, "B", 0.25, 0.1, 0.02), (2, "A", 0.5, 0.1, 0.0), (1, "A", 0.5, 0.2, 0.99))],
        "strategy string, period int, capital double, cap double, ticker string, held double, wanted double, filled double, traded double, fees double, spread double, impact double",
    )
    values = spark.createDataFrame([("s", 0, 1, 1.0), ("s", 1, 2, 5.0), ("s", 1, 3, 1.2), ("s", 2, 4, 1.5)], "strategy string, period int, session int, value double")
    turnover = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.1)], "strategy string, period int, turnover double")
    out = {r["cap"]: r for r in book.strategy_cost_table(values, turnover, fills).collect()}
    some, ruined = out[0.1], out[0.2]
    assert some["gross"] == pytest.approx(1.2 * 1.5 - 1) and some["net"] == pytest.approx(1.2 * 1.5 * 0.94 * 0.99 - 1)
    assert some["rejected_notional"] == pytest.approx(25.0) and some["rejected_orders"] == 1 and some["fill_ratio"] == pytest.approx(1.25 / 1.5)
    assert ruined["net"] == -1.0 and ruined["log_net"] is None and ruined["gross"] == some["gross"]


def test_run_records_show_unequal_runs(spark):
    schema = "strategy string, trade_date date, period long, start long, end long"
    rows = [(s, D0, p, 1 + 4 * p, 5 + 4 * p) for s in "ab" for p in (0, 1, 2)]
    even = book.run_records(spark.createDataFrame(rows, schema), (1e5, 1e6), (0.01,))
    assert even.count() == 4 and statistics.fairness_failures(even).count() == 0
    late = book.run_records(spark.createDataFrame(rows[:-1], schema), (1e5, 1e6), (0.01,))
    failures = statistics.fairness_failures(late).collect()
    assert {r["field"] for r in failures} == {"evaluation_end", "rebalance_dates", "rebalance_periods"} and len(failures) == 6


def test_drawdown_episodes(spark):
    values = [100.0, 90.0, 95.0, 100.0, 120.0, 60.0]
    df = spark.createDataFrame([("s", D0 + timedelta(days=i), v) for i, v in enumerate(values)], "strategy string, trade_date date, portfolio_value double")
    out = performance.drawdown_episodes(df).orderBy("peak_date").collect()
    assert [(r["max_drawdown"], r["duration_sessions"], r["recovered"]) for r in out] == [(pytest.approx(-0.1), 3, True), (pytest.approx(-0.5), 1, False)]


def test_covariance_ignores_the_future(spark):
    dates = [D0 + timedelta(days=i) for i in range(120)]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(dates)], "trade_date date, session long")
    asked = spark.createDataFrame([(dates[90], "A3"), (dates[90], "B3")], "as_of date, ticker string")

    def cov(k):
        rows = [(d, "A3", 100.0 + i + (i % 3)) for i, d in enumerate(dates)] + [(d, "B3", (80.0 + i / 2 + (i % 5)) * (k if i > 90 else 1)) for i, d in enumerate(dates)]
        px = spark.createDataFrame(rows, "trade_date date, ticker string, close double")
        out = risk.pairwise_covariance(asked, px, cal, 252, 60, 0.8).orderBy("asset_i", "asset_j").collect()
        return [r["covariance"] for r in out], rows

    one, rows = cov(1.0)
    hundred, _ = cov(100.0)
    assert one == pytest.approx(hundred, rel=1e-12) and len(one) == 3
    wide = pd.DataFrame(rows, columns=["d", "t", "p"]).pivot(index="d", columns="t", values="p").iloc[:91].pct_change().dropna()
    want = wide.cov().values * 252
    assert one == pytest.approx([want[0, 0], 0.8 * want[0, 1], want[1, 1]])


def test_ledoit_wolf_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (30, 4)) @ rng.normal(0, 1, (4, 4))
    rows = [(D0, t, f"T{j}", float(x[t, j])) for t in range(30) for j in range(4)]
    out = {(r["asset_i"], r["asset_j"]): r["covariance"] for r in risk.ledoit_wolf(spark.createDataFrame(rows, "as_of date, session long, ticker string, r double")).collect()}
    c = x - x.mean(0)
    n, p = c.shape
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, (((c**2).sum(1) ** 2).sum() / n - (s**2).sum()) / (p * n))
    want = (1 - beta / delta) * s + beta / delta * mu * np.eye(p)
    for (i, j), v in out.items():
        assert v == pytest.approx(want[int(i[1]), int(j[1])])


def test_ledoit_wolf_keeps_dates_with_few_whole_sessions(spark):
    rows = [(D0, 1, "A", 0.1), (D0, 2, "B", 0.2), (D0, 3, "C", 0.3)]  # no session with all three names
    rows += [(D0 + timedelta(days=1), t, name, 0.1 * t * k) for k, name in ((1, "A"), (3, "B")) for t in (1, 2)]
    out = risk.ledoit_wolf(spark.createDataFrame(rows, "as_of date, session long, ticker string, r double")).collect()
    got = {(r["as_of"], r["asset_i"], r["asset_j"]): (r["covariance"], r["shrinkage"], r["n"]) for r in out}
    want = {(D0, i, j): (1e-6 if i == j else 0.0, 0.0, 0) for i, j in ("AA", "AB", "AC", "BB", "BC", "CC")}
    assert got == want | {(D0 + timedelta(days=1), i, j): (1e-6 if i == j else 0.0, 0.0, 2) for i, j in ("AA", "AB", "BB")}


def test_shrunk_covariance_takes_the_candidates_of_the_other_covariances(spark, monkeypatch):
    from tidemark.plans import risk_queries

    class Market:
        def __init__(self, spark, sf_dir):
            days = [D0 + timedelta(days=7 * i) for i in range(40)]
            rows = [(f"T{j:02d}", d, 100.0 + (i * (j + 3)) % 17) for j in range(60) for i, d in enumerate(days)]
            self.prices = spark.createDataFrame(rows, "ticker string, trade_date date, close double")
            self.forecasts = spark.createDataFrame([(days[-1], f"T{j:02d}", j, float(j)) for j in range(60)], "trade_date date, ticker string, issuer_id long, rank_log_traded_value_4w double")

    monkeypatch.setattr(risk_queries, "Market", Market)
    out = risk_queries.shrunk_covariance(spark, "").collect()
    assert {r["asset_i"] for r in out} == {f"T{j:02d}" for j in range(10, 60)} and len(out) == 50 * 51 // 2
    assert {r["n"] for r in out} == {39}


def test_basket_search_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    alpha, pairs, best = [], [], {}
    for inst in range(6):
        day = D0 + timedelta(days=inst)
        a = rng.normal(0, 1, 8)
        m = rng.normal(0, 1, (8, 8))
        c = m @ m.T / 8
        alpha += [(day, f"T{i}", float(a[i]), f"I{i}", f"S{i % 5}") for i in range(8)]
        pairs += [(day, f"T{i}", f"T{j}", float(c[i, j])) for i in range(8) for j in range(i, 8)]
        ok = [s for s in combinations(range(8), 3) if len({i % 5 for i in s}) == 3]
        best[day] = max(a[list(s)].mean() - 0.7 * c[np.ix_(s, s)].sum() / 9 * 21 / 252 for s in ok)
    af = spark.createDataFrame(alpha, "as_of date, ticker string, alpha double, issuer_id string, sector string")
    pf = spark.createDataFrame(pairs, "as_of date, asset_i string, asset_j string, covariance double")
    found = basket.basket_beam(af, pf, 3, 0.7, 21, None).collect()
    assert {r["as_of"]: pytest.approx(r["utility"]) for r in found} == best
    chosen = spark.createDataFrame([(r["as_of"], 1, r["members"]) for r in found], "as_of date, basket_id long, members array<string>")
    scored = {r["as_of"]: r["utility"] for r in basket.basket_utility(chosen, af.select("as_of", "ticker", "alpha"), pf, 0.7, 21).collect()}
    assert {k: pytest.approx(v) for k, v in scored.items()} == best


def test_exact_basket_with_negative_pairs_matches_brute_force(spark):
    """Twenty seeded instances of eight names; the sizes 2 to 5; two names of one issuer; sectors of unequal size."""
    rng = np.random.default_rng(7)
    n, alpha, pairs, instances = 8, [], [], {}
    issuers, sectors = [0, 0, 2, 3, 4, 5, 6, 7], [0, 1, 2, 3, 4, 0, 1, 0]
    for inst in range(20):
        day = D0 + timedelta(days=inst)
        a = rng.normal(3, 3, n)
        c = np.triu(rng.normal(0, 2, (n, n)), 1)
        c = c + c.T + np.diag(np.abs(rng.normal(3, 2, n)))
        instances[day] = (a, c)
        alpha += [(day, f"T{i}", float(a[i]), f"I{issuers[i]}", f"S{sectors[i]}") for i in range(n)]
        pairs += [(day, f"T{i}", f"T{j}", float(c[i, j])) for i in range(n) for j in range(i, n)]
    af = spark.createDataFrame(alpha, "as_of date, ticker string, alpha double, issuer_id string, sector string")
    pf = spark.createDataFrame(pairs, "as_of date, asset_i string, asset_j string, covariance double")
    for k in (2, 4, 5):
        most = max(1, int(0.4 * k))
        allowed = [s for s in combinations(range(n), k) if len({issuers[i] for i in s}) == k and max([sectors[i] for i in s].count(x) for x in range(5)) <= most]
        best = {d: max((a[list(s)].mean() - 0.7 * c[np.ix_(s, s)].sum() / k**2, [f"T{i}" for i in s]) for s in allowed) for d, (a, c) in instances.items()}
        found = basket.basket_best(af, pf, k, 0.7, 252).collect()
        assert {r["as_of"]: (pytest.approx(r["utility"]), r["members"]) for r in found} == best
        assert {r["search"] for r in found} == {"exact"}


def test_exposures(spark):
    rows = [(D0, "A", "I1", 0.25), (D0, "A", "I2", 0.20), (D0, "B", "I3", 0.30), (D0, "C", "I4", 0.25)]
    df = spark.createDataFrame(rows, "trade_date date, sector string, issuer_id string, target_weight double")
    assert {(r["kind"], r["name"]) for r in risk.exposure_breaches(df).collect()} == {("sector", "A"), ("issuer", "I3")}


def test_normal_cdf(spark):
    zs = [-9.0, -3.1, -0.4, 0.0, 1.7, 5.5, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(z) for z in zs], abs=1e-12)


def series(spark, matrix):
    rows = [(f"s{j}", i, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "strategy string, period long, r double")


def test_sharpe_inference(spark):
    x = np.random.default_rng(5).normal(0.01, 0.04, 24)
    df = series(spark, x[:, None])
    row = statistics.deflated_sharpe(df, "r", 20, 0.25).first()
    c = x - x.mean()
    sk, ku = (c**3).mean() / x.std() ** 3, (c**4).mean() / x.std() ** 4
    s = x.mean() / x.std(ddof=1) * 12**0.5
    var = (1 - sk * s / 12**0.5 + (ku - 1) / 4 * s * s / 12) / 23
    assert row["hurdle"] > 0
    assert row["probability"] == pytest.approx(NormalDist().cdf((s - row["hurdle"]) / (var * 12) ** 0.5))
    assert statistics.sharpe_hurdle(1, 0.3) == 0.0


def test_overfitting_against_brute_force(spark):
    m = np.random.default_rng(42).normal(0.001, 0.02, (51, 4))
    got = statistics.overfitting_probability(series(spark, m)).first()
    blocks = np.array_split(np.arange(51), 8)

    def sharpe(rows):
        return m[rows].mean(0) * 12 / (m[rows].std(0, ddof=1) * 12**0.5)

    hits = []
    for chosen in combinations(range(8), 4):
        train = np.concatenate([blocks[i] for i in chosen])
        test = np.concatenate([blocks[i] for i in range(8) if i not in chosen])
        out = sharpe(test)
        hits.append((out <= out[sharpe(train).argmax()]).mean() <= 0.5)
    assert got["splits"] == 70 and got["overfitting_probability"] == pytest.approx(np.mean(hits))


def test_bootstrap(spark):
    x = np.random.default_rng(0).normal(0.5, 1.0, 20)
    df = series(spark, x[:, None])
    row = statistics.block_bootstrap(df, "r", "period", replicates=200).first()
    assert row["ci_low"] < row["point"] < row["ci_high"] and row["point"] == pytest.approx(x.mean())
    again = statistics.block_bootstrap(df.repartition(3), "r", "period", replicates=200).first()
    assert again["ci_low"] == pytest.approx(row["ci_low"])
    short = statistics.block_bootstrap(df.filter("period < 2"), "r", "period", replicates=50).first()
    assert short["point"] is None and short["ci_low"] is None


def test_gates_and_fairness(spark):
    actual = {n: (0.0 if n == "leakage_tests_passed" else (1.0 if t <= 1 else 1.0)) for _, n, _, t in statistics.GATES}
    df = spark.createDataFrame([("s", k, v) for k, v in actual.items()], "strategy string, name string, actual double")
    v = statistics.gate_verdicts(statistics.gate_results(df)).first()
    assert v["model_signal_accepted"] and v["portfolio_strategy_accepted"] and not v["production_ready"]
    rec = spark.createDataFrame([("a", "c1", 1.0), ("b", "c1", 2.0), ("a", "c2", 1.0)], "strategy string, cost_scenario string, initial_capital double")
    kinds = {(r["failure"], r["strategy"], r["field"]) for r in statistics.fairness_failures(rec, ("initial_capital",)).collect()}
    assert kinds == {("field_differs", None, "initial_capital"), ("scenario_missing", "b", None)}
