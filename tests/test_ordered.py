"""Ranks, prefix sums and quantiles against brute force, with a hot group and ties, in one range and in many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import add_average_ranks, add_positions, exact_quantiles, running_before
from tidemark.operators.diagnostics import distribution_distances


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 600
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.35, 7.0, rng.integers(0, 40, n) / 4.0)
    value[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"g": group, "id": np.arange(n), "v": value, "w": rng.integers(1, 5, n)})


def load(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)


@pytest.mark.parametrize(("bound", "ranges"), [(1000, None), (None, None), (None, 7)])
@pytest.mark.parametrize("denominator", ["observed", "all", None])
def test_average_ranks(spark, frame, bound, ranges, denominator):
    got = add_average_ranks(load(spark, frame), ["g"], {"r": "v"}, ["id"], bound, denominator, ranges)
    got = got.select("id", "r").toPandas().set_index("id")["r"].astype(float).sort_index()
    rank = frame.groupby("g")["v"].rank(method="average")
    scale = {"observed": frame.groupby("g")["v"].transform("count"), "all": frame.groupby("g")["id"].transform("count"), None: 1}[denominator]
    np.testing.assert_allclose(got.values, (rank / scale).values)


@pytest.mark.parametrize("ranges", [None, 7])
def test_null_group_is_its_own_group(spark, ranges):
    rows = [(1, None, 3.0), (2, None, 1.0), (3, "x", 5.0), (4, "x", 5.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r["id"]: r["r"] for r in add_average_ranks(df, ["g"], {"r": "v"}, ["id"], ranges=ranges).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 1.5, 4: 1.5}


@pytest.mark.parametrize("ranges", [None, 7])
def test_positions_and_prefix_sums(spark, frame, ranges):
    df = load(spark, frame).withColumn("v", F.coalesce("v", F.lit(-1.0)))
    got = add_positions(df, ["g"], ["v", "id"], "p", None, ranges)
    got = running_before(got, ["g"], ["v", "id"], {"s": "w"}, ranges).select("id", "p", "s").toPandas().set_index("id").sort_index()
    want = frame.fillna({"v": -1.0}).sort_values(["g", "v", "id"])
    want["p"] = want.groupby("g").cumcount() + 1
    want["s"] = want.groupby("g")["w"].cumsum() - want["w"]
    want = want.set_index("id").sort_index()
    assert (got["p"].values == want["p"].values).all()
    assert (got["s"].values == want["s"].values).all()


@pytest.mark.parametrize("ranges", [None, 7])
def test_quantiles(spark, frame, ranges):
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(load(spark, frame), ["g"], "v", probs, ranges).collect()}
    for g, rows in frame.groupby("g"):
        np.testing.assert_allclose(got[g], np.nanquantile(rows["v"], probs))


def test_large_integers_and_mixed_types(spark):
    rows = [("d", i, 2**53 + i // 2, float(i % 3), f"t{i % 4}") for i in range(40)]
    df = spark.createDataFrame(rows, "day string, id long, big long, x double, name string")
    ranks = {"r_big": "big", "r_x": "x", "r_name": "name"}
    columns = ["id", *ranks]
    frame = pd.DataFrame(rows, columns=["day", "id", "big", "x", "name"])
    want = pd.DataFrame({"id": frame["id"], **{out: frame[source].rank() for out, source in ranks.items()}})
    for ranges in (None, 5):
        got = add_average_ranks(df, ["day"], ranks, ["id"], ranges=ranges)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.itertuples(index=False, name=None))


def test_one_date_is_spread_over_many_tasks(spark, tmp_path):
    """A single group lies in several ranges, none of which holds most of it, and next values go over their edges."""
    n = 4000
    df = spark.range(n).select(F.lit("d").alias("day"), (F.col("id") * 37 % n).alias("v"), F.lit(1).cast("long").alias("one"))
    placed = running_before(df, ["day"], ["v"], {"before": "one"}, 9, {"next": "v"})
    rows = sorted(map(tuple, placed.select("v", "before", "next").collect()))
    assert rows == [(i, i, i + 1 if i + 1 < n else None) for i in range(n)]
    sizes = [r["count"] for r in df.repartitionByRange(9, "day", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 9 and max(sizes) < n / 3


@pytest.fixture
def settings(spark):
    """Sets values for one test."""
    before = {}

    def put(**values):
        for name, value in values.items():
            key = name.replace("__", ".")
            before[key] = spark.conf.get(key)
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


def test_each_range_has_a_task_of_its_own(spark, settings):
    """Hashed, several ranges of a large group fell to one task while others had none."""
    settings(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="32")
    n = 6400
    df = spark.range(n).select(F.lit("d").alias("g"), (F.col("id") * 37 % n).alias("v"), F.lit(1).alias("one"))
    placed = running_before(df, ["g"], ["v"], {"before": "one"}, 32, {"next": "v"})
    # The sum keeps the windows in the plan.
    tasks = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("before").alias("s")).collect()
    sizes = [r["n"] for r in tasks]
    assert sum(sizes) == n and sum(r["s"] for r in tasks) == n * (n - 1) // 2
    assert len(sizes) == 32 and max(sizes) < 2 * n / 32


def test_group_totals_come_without_a_join(spark, settings, capsys):
    """A join by group would bring all rows of a group to one task."""
    settings(spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1")
    rows = [("a" if i % 3 else "b", i % 50 / 7.0, "1997-01-01" if i % 2 else "2000-01-01") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, day string").withColumn("trade_date", F.to_date("day"))
    spans = distribution_distances(df, ["x"], (1996, 1998), (1999, 2001))
    quantiles = exact_quantiles(df, ["g"], "x", [0.5])
    for result in (spans, quantiles):
        result.explain()
        assert "Join" not in capsys.readouterr().out
    got = spans.first()
    assert (got["na"], got["nb"]) == (200, 200)
    assert got["ks_statistic"] == pytest.approx(1 / 25 / 1) and got["wasserstein"] == pytest.approx(1 / 7)
    for r in quantiles.collect():
        assert r["q0"] == pytest.approx(np.median([x for g, x, _ in rows if g == r["g"]]))


@pytest.mark.parametrize("ranges", [None, 7])
def test_totals_of_groups_with_nulls(spark, ranges):
    rows = [(g, i, None if i % 4 == 1 else i) for g in ("x", None) for i in range(30)] + [("y", 0, None)]
    df = spark.createDataFrame(rows, "g string, v long, w int")
    got = running_before(df, ["g"], ["v"], {"before": "w"}, ranges, {"next": "v"}, {"total": "w"})
    assert got.columns == ["g", "v", "w", "before", "next", "total"]
    held = {g: [r for r in rows if r[0] == g] for g in ("x", "y", None)}
    want = []
    for g, some in held.items():
        total = sum(w for _, _, w in some if w is not None) if g != "y" else None
        want += [(g, v, w, sum(x or 0 for _, _, x in some[:v]), v + 1 if v + 1 < len(some) else None, total) for _, v, w in some]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
