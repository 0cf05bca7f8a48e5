from datetime import date
from random import Random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, events, filings, intervals, names, quality

FACT = "issuer_id string, reference_date date, received date, version long, account string, value double, period_start date, period_end date"


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


def fact(ref, recv, account, value, version=1, start=None, end=None):
    return ("X", ref, recv, version, account, value, start, end)


def test_trailing_four_quarters(spark):
    ends = [date(2023, 3, 31), date(2023, 6, 30), date(2023, 9, 30), date(2023, 12, 31)]
    receipts = [date(2023, 5, 1), date(2023, 8, 1), date(2023, 11, 1), date(2024, 3, 1)]
    rows = [fact(e, r, "3.01", v, 1, date(2023, 1, 1), e) for e, r, v in zip(ends, receipts, [100.0, 220.0, 360.0, 500.0])]
    out = filings.trailing_flows(facts(spark, rows)).orderBy("as_of").collect()
    assert (out[-1]["value"], out[-1]["basis"]) == (500.0, "TTM")
    assert [r["basis"] for r in out[:3]] == [None, None, None]
    annual = filings.trailing_flows(facts(spark, [fact(ends[3], receipts[3], "3.01", 500.0, 1, date(2023, 1, 1), ends[3])])).first()
    assert (annual["value"], annual["basis"]) == (500.0, "FY")


def test_restatements_apply_from_their_receipt(spark):
    e = date(2023, 3, 31)
    rows = [fact(e, date(2023, 5, 1), "3.01", 100.0, 1, date(2023, 1, 1), e), fact(e, date(2023, 9, 1), "3.01", 150.0, 2, date(2023, 1, 1), e)]
    for order in (rows, rows[::-1]):
        known = {r["as_of"]: r["value"] for r in filings.known_facts(facts(spark, order)).collect()}
        assert known == {date(2023, 5, 1): 100.0, date(2023, 9, 1): 150.0}


def test_snapshots(spark):
    r, q = date(2024, 5, 1), date(2024, 3, 31)
    rows = [
        fact(date(2023, 12, 31), r, "1", 100.0), fact(q, r, "1", 120.0), fact(q, r, "1", 150.0, 2), fact(q, r, "2.03", -20.0, 2),
        fact(q, r, "3.01", 0.0, 2), fact(q, r, "3.11", 50.0, 2),
    ]
    out = filings.company_snapshots(facts(spark, rows).drop("period_start", "period_end")).collect()
    assert len(out) == 1
    row = out[0]
    assert (row["reference_date"], row["assets"], row["negative_equity"]) == (q, 150.0, True)
    assert row["net_margin"] is None and row["roe_proxy"] is None and row["log_equity"] is None
    with pytest.raises(quality.DataQualityError):
        filings.check_snapshots(spark.createDataFrame([("X", date(2024, 6, 1), r)], "issuer_id string, reference_date date, received date"))


def bridge(spark, rows):
    return spark.createDataFrame(rows, "ticker string, issuer_id string, valid_from date, valid_to date, sector string")


def test_a_filing_is_known_only_after_its_receipt(spark):
    panel = spark.createDataFrame(
        [("NEW3", date(2024, 5, 1)), ("NEW3", date(2024, 6, 1)), ("OLD3", date(2024, 6, 1))], "ticker string, trade_date date"
    )
    snaps = spark.createDataFrame([("X", date(2024, 3, 31), date(2024, 5, 10), 0.2)], "issuer_id string, reference_date date, received date, net_margin double")
    b = bridge(spark, [("NEW3", "X", date(2020, 1, 1), date(2999, 12, 31), "S")])
    out = {(r["ticker"], r["trade_date"]): r for r in filings.attach_fundamentals(panel, snaps, b, group_bound=10).collect()}
    assert out["NEW3", date(2024, 5, 1)]["net_margin"] is None and out["NEW3", date(2024, 5, 1)]["stale_fundamental"]
    assert out["NEW3", date(2024, 6, 1)]["net_margin"] == 0.2
    assert out["OLD3", date(2024, 6, 1)]["issuer_id"] is None
    assert quality.future_facts(spark.createDataFrame([r.asDict() for r in out.values()], "trade_date date, received date, reference_date date")).count() == 0


def test_asof_allows_equality_and_keeps_every_left_row(spark):
    left = spark.createDataFrame([("k", 1, date(2024, 1, 5)), ("k", 2, date(2024, 1, 5)), ("k", 3, date(2024, 1, 4)), (None, 4, date(2024, 1, 9))], "k string, id long, t date")
    right = spark.createDataFrame([("k", date(2024, 1, 5), 7.0), ("k", date(2024, 1, 5), 8.0)], "k string, t2 date, v double")
    got = {r["id"]: r["v"] for r in asof.asof_join(left, right, ["k"], "t", "t2", ["v"], ["v"]).collect()}
    assert got == {1: 8.0, 2: 8.0, 3: None, 4: None}


def test_rate_is_known_a_day_later(spark):
    days = spark.createDataFrame([(date(2025, 1, 2),), (date(2025, 1, 3),)], "trade_date date")
    series = spark.createDataFrame([(date(2025, 1, 2), 12.25)], "date date, value double")
    got = [r["value"] for r in asof.asof_series(days, series, "trade_date", "date", "value", 1).orderBy("trade_date").collect()]
    assert got == [None, 12.25]


def test_overlaps_and_merging(spark):
    rows = [("T", "123", date(2020, 1, 1), date(2023, 1, 1)), ("T", "456", date(2022, 1, 1), date(2024, 1, 1)), ("T", "123", date(2022, 6, 1), date(2023, 6, 1)), ("U", "1", date(2020, 1, 1), date(2020, 2, 1)), ("U", "1", date(2020, 2, 3), date(2020, 3, 1))]
    df = spark.createDataFrame(rows, "ticker string, issuer_id string, valid_from date, valid_to date")
    merged = {(r["ticker"], r["issuer_id"], r["valid_from"]): r["valid_to"] for r in intervals.merge_overlapping(df).collect()}
    assert merged[("T", "123", date(2020, 1, 1))] == date(2023, 6, 1) and len(merged) == 4
    assert [r["valid_from"] for r in intervals.overlaps(df, owner="issuer_id").collect()] == [date(2022, 1, 1)]
    assert intervals.overlaps(df.filter("ticker = 'U'")).count() == 0


PRICE = "trade_date date, ticker string, close double"
ACTION = "ticker string, action_type string, last_date_prior date, cash_amount double, share_factor double"


def adjusted(spark, closes, actions):
    rows = [(date(2024, 1, i + 2), "A", c) for i, c in enumerate(closes)]
    out = events.adjust_prices(spark.createDataFrame(rows, PRICE), spark.createDataFrame(actions, ACTION))
    return [r["adjusted_close"] for r in out.orderBy("trade_date").collect()]


def test_dividend_and_split(spark):
    assert adjusted(spark, [100.0, 95.0, 96.0], [("A", "cash_dividend", date(2024, 1, 2), 5.0, None)]) == pytest.approx([95.0, 95.0, 96.0])
    assert adjusted(spark, [100.0, 102.0, 51.0, 52.0], [("A", "stock_split", date(2024, 1, 3), None, 100.0)]) == pytest.approx([50.0, 51.0, 51.0, 52.0])
    # A split after the last bar is ignored, a dividend is not.
    assert adjusted(spark, [10.0, 10.0], [("A", "stock_split", date(2024, 1, 9), None, 100.0), ("A", "jcp", date(2024, 1, 9), 1.0, None)]) == pytest.approx([9.0, 9.0])
    with pytest.raises(quality.DataQualityError):
        adjusted(spark, [10.0, 10.0], [("A", "jcp", date(2024, 1, 2), 10.0, None)])


def test_later_action_leaves_returns_before_it(spark):
    closes = [100.0 + i for i in range(15)]
    plain = adjusted(spark, closes, [("A", "cash_dividend", date(2023, 1, 1), 1.0, None)])
    later = adjusted(spark, closes, [("A", "cash_dividend", date(2024, 1, 12), 1.0, None)])
    assert [b / a for a, b in zip(plain[:10], plain[1:11])] == pytest.approx([b / a for a, b in zip(later[:10], later[1:11])])


def test_stale_names_take_one_haircut(spark):
    dates = [date(2024, 1, i) for i in range(1, 8)]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(dates)], "trade_date date, session long")
    df = spark.createDataFrame([(dates[0], "A", 10.0, 1), (dates[1], "A", 5.0, 2), (dates[2], "A", 6.0, 2)], PRICE + ", dist long")
    rows = events.stale_marks(df, cal, max_stale=2, action_marker="dist").orderBy("session").collect()
    assert [r["asset_return"] for r in rows[1:]] == pytest.approx([0.0, 0.2, 0.0, 0.0, -0.999, 0.0])
    assert [r["action_excluded"] for r in rows] == [False, True, False, False, False, False, False]


def test_names(spark):
    listed = spark.createDataFrame([("BBAS3", "BCO BRASIL"), ("PETR4", "PETROBRAS"), ("TEST3", "ENERGIA")], "ticker string, name string")
    reg = spark.createDataFrame([("1", "BCO BRASIL S.A."), ("2", "PETROBRAS PETROLEO BRASILEIRO"), ("3", "ENERGIA NORTE SA"), ("4", "ENERGIA SUL SA")], "issuer_id string, registered_name string")
    out = names.match_names(listed, reg).collect()
    auto = {r["ticker"]: r["issuer_id"] for r in out if r["status"] == "auto_added"}
    assert auto == {"BBAS3": "1", "PETR4": "2"}
    assert {r["issuer_id"] for r in out if r["status"] == "ambiguous"} >= {"3", "4"}
    key = listed.select(F.lit("BCO BRASIL S.A.").alias("name")).limit(1)
    from tidemark.functions.scalars import issuer_name_key

    assert key.select(issuer_name_key(F.col("name"))).first()[0] == "BANCOBRASIL"


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_entries_match_all_pairs(spark, k):
    """Names that all share a word, repeated pieces, short names, equal shares and names without any common piece."""
    rng = Random(3)
    words = ["COMPANHIA", "BANCO", "AGUA", "LUZ", "SUL", "NORTE", "ANANAS", "AAAA"]
    left = sorted({"GRUPO" + "".join(rng.choices(words, k=2)) + str(rng.randrange(40)) for _ in range(60)} | {"XY", "QQQQ", "", "GRUPO"})
    right = sorted({"GRUPO" + "".join(rng.choices(words, k=2)) + str(rng.randrange(40)) for _ in range(80)} | {"GRU", "Z", "GRUPO"})
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    want = set()
    for a in left:
        scored = [(round(2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))), 4), b) for b in right if grams(a) & grams(b)]
        want |= {(a, b, s) for s, b in sorted(scored, reverse=True)[:k]}
    names_df = spark.createDataFrame([(a,) for a in left], "name_key string")
    entries = spark.createDataFrame([(b, b) for b in right], "entry_key string, label string")
    got = names.nearest_entries(names_df, entries, k).select("name_key", "entry_key", "similarity")
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert names.nearest_entries(names_df, entries.limit(0), k).count() == 0


def test_entries_are_not_broadcast_and_letters_of_any_script_count(spark, monkeypatch):
    left = ["ÁGUAS DO NORTE", "日本電信電話", "\U0001f600\U0001f601\U0001f602X", "AB", "NORTE SUL", "\U0010ffff\U0010ffff\U0010ffff"]
    right = ["AGUAS DO NORTE", "ÁGUAS DO SUL", "日本電気", "日本電信", "\U0001f600\U0001f601\U0001f602", "SUL NORTE", "\U0010ffff\U0010ffff\U0010ffffZ", "A"]
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    share = lambda a, b: round(2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))), 4)
    want = {(a, b, share(a, b)) for a in left for _, b in sorted(((share(a, b), b) for b in right if grams(a) & grams(b)), reverse=True)[:2]}
    plans, plain = [], names.cut_lineage
    monkeypatch.setattr(names, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "9223372036854775807b")
    try:
        got = names.nearest_entries(spark.createDataFrame([(a,) for a in left], "name_key string"), spark.createDataFrame([(b, b) for b in right], "entry_key string, label string"), 2)
        rows = set(map(tuple, got.select("name_key", "entry_key", "similarity").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == want and len(plans) > 3
    # Only the numbers of the pieces asked for may be broadcast.
    assert all("LeftSemi" in line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoop" in line)


def test_pieces_that_all_entries_have_are_not_looked_up(spark, monkeypatch):
    left, right = [f"Supplier#00000{i}" for i in range(1100, 3900, 97)], [f"Customer#00000{i}" for i in range(1000, 4000)]
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    share = lambda a, b: round(2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))), 4)
    want = {(a, b, s) for a in left for s, b in sorted(((share(a, b), b) for b in right), reverse=True)[:3]}
    states, plain = [], names.cut_lineage
    monkeypatch.setattr(names, "cut_lineage", lambda df: states.append(plain(df)) or states[-1])
    got = names.nearest_entries(spark.createDataFrame([(a,) for a in left], "name_key string"), spark.createDataFrame([(b, b) for b in right], "entry_key string, label string"))
    assert set(map(tuple, got.select("name_key", "entry_key", "similarity").collect())) == want
    ends = [s.filter(f"__settled AND NOT exists(slice(pieces, 1, done), p -> p.hits = {len(right)})").count() for s in states if "__settled" in s.columns]
    assert sum(ends) == len(left)
