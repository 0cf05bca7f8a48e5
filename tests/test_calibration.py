"""Verdicts of several groups in one table, and the rising curve against pooled adjacent violators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration

SCHEMA = "fold int, ticker string, disagreement double, error double"


def pooled(values, weights):
    stack = []
    for v, w in zip(values, weights, strict=True):
        stack.append([v, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            (a, m, i), (b, n, j) = stack[-2:]
            stack[-2:] = [[(a * m + b * n) / (m + n), m + n, i + j]]
    return [v for v, _, size in stack for _ in range(size)]


@pytest.fixture(scope="module")
def errors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(100):
        x = float(rng.integers(1, 60))
        rows += [(1, f"T{i}", x, x + 0.01 * float(rng.normal())), (2, f"T{i}", x, -x), (3, f"T{i}", 1.0, float(i)), (4, f"T{i}", float(i), float(rng.normal()))]
    rows += [(5, f"T{i}", float(i), float(i)) for i in range(49)] + [(5, "T98", float("nan"), 1.0), (5, "T99", 3.0, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_one_fold_is_trusted_and_the_others_say_why_not(errors):
    _, df = errors
    got = {r["fold"]: r for r in calibration.verdicts(calibration.reliability(df, ["fold"], ["ticker"])).collect()}
    assert got[1]["enabled"] and got[1]["failed"] == "" and len(got[1]["bin_errors"]) == 5
    assert got[2]["failed"] == "correlation,rising_bins" and got[2]["rank_correlation"] == pytest.approx(-1.0)
    assert got[3]["failed"] == "values,correlation,rising_bins"
    assert got[5]["failed"] == "rows" and got[5]["rows"] == 49
    assert [r["enabled"] for f, r in got.items() if f != 1] == [False] * 4


def test_bins_are_means_between_quantiles(errors):
    rows, df = errors
    x = np.array([r[2] for r in rows if r[0] == 4])
    y = np.array([r[3] for r in rows if r[0] == 4])
    edges = np.quantile(x, np.linspace(0, 1, 6))[1:-1]
    means = [y[np.searchsorted(edges, x, side="left") == b].mean() for b in range(5)]
    assert calibration.reliability(df.filter("fold = 4"), ["fold"], ["ticker"]).first()["bin_errors"] == pytest.approx(means)


def test_curve_is_the_isotonic_fit(errors):
    rows, df = errors
    got = calibration.rising_curve(df, ["fold"]).orderBy("fold", "block").collect()
    for fold in range(1, 6):
        held = {}
        for _, _, x, y in (r for r in rows if r[0] == fold and r[3] is not None and np.isfinite(r[2])):
            held.setdefault(x, []).append(y)
        own = [r for r in got if r["fold"] == fold]
        assert [r["low"] for r in own] == [r["high"] for r in own] == sorted(held) and [r["rows"] for r in own] == [len(held[x]) for x in sorted(held)]
        fitted = pooled([np.mean(held[x]) for x in sorted(held)], [len(held[x]) for x in sorted(held)])
        assert [r["fitted"] for r in own] == pytest.approx(fitted)


def test_more_values_than_blocks_are_pooled_evenly(errors):
    _, df = errors
    got = calibration.rising_curve(df.filter("fold = 4"), ["fold"], blocks=8).orderBy("block").collect()
    assert [r["block"] for r in got] == list(range(1, 9)) and sum(r["rows"] for r in got) == 100 and all(12 <= r["rows"] <= 13 for r in got)
    fitted = [r["fitted"] for r in got]
    assert fitted == sorted(fitted)


def test_nothing_in_nothing_out(errors):
    _, df = errors
    none = df.filter(F.col("fold") > 9)
    assert calibration.verdicts(calibration.reliability(none, ["fold"], ["ticker"])).count() == 0
    assert calibration.rising_curve(none, ["fold"]).count() == 0
