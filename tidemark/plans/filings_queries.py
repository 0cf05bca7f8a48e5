"""Queries over intervals, filings, adjustments and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import asof, events, filings, intervals, names, quality, regime, universe
from tidemark.plans import market_sql as S
from tidemark.plans.market import Market
from tidemark.plans.registry import query

r = S.r


@query(
    "asof_fundamentals",
    S.with_(
        S.PRICES, S.BRIDGE, S.FACTS,
        "assets AS (SELECT issuer_id, received, max_by(value, (period_end, version)) AS assets FROM facts WHERE account = '1' GROUP BY 1, 2)",
        "mapped AS (SELECT p.ticker, p.trade_date, b.issuer_id FROM prices p LEFT JOIN bridge b ON b.ticker = p.ticker AND p.trade_date BETWEEN b.valid_from AND b.valid_to)",
        select=f"""SELECT m.ticker, m.trade_date, m.issuer_id, a.received, {r('a.assets', 2)} AS assets
          FROM mapped m ASOF LEFT JOIN assets a ON m.issuer_id = a.issuer_id AND m.trade_date >= a.received""",
    ),
)
def asof_fundamentals(spark, sf_dir):
    m = Market(spark, sf_dir)
    bars = m.prices.select("ticker", "trade_date")
    mapped = intervals.range_join(bars, m.bridge)
    assets = m.facts.filter("account = '1'")
    joined = asof.asof_join(
        mapped, assets, ["issuer_id"], "trade_date", "received", ["received", "value"], ["reference_date", "version"]
    )
    return joined.select("ticker", "trade_date", "issuer_id", "received", rounded(F.col("value"), 2).alias("assets"))


_MACRO = """macro AS (SELECT last_day(o_orderdate) AS date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100000.0 AS value FROM orders GROUP BY 1)"""


@query(
    "asof_no_key",
    S.with_(
        S.PRICES, S.PANEL, _MACRO,
        "days AS (SELECT trade_date, avg(ret_1w) AS mean_return FROM rets GROUP BY 1)",
        """joined AS (SELECT d.trade_date, m.value AS rate FROM days d
            ASOF LEFT JOIN (SELECT date + 1 AS available, value FROM macro) m ON d.trade_date >= m.available)""",
        select=f"""SELECT trade_date, {r('rate')} AS regime_rate,
          {r('coalesce(rate - lag(rate) OVER (ORDER BY trade_date), 0.0)')} AS regime_rate_change FROM joined""",
    ),
)
def asof_no_key(spark, sf_dir):
    m = Market(spark, sf_dir)
    days = m.prices.select("trade_date").distinct()
    joined = regime.attach_rate(days, m.macro, 1)
    return joined.select(
        "trade_date", rounded(F.col("regime_rate")).alias("regime_rate"), rounded(F.col("regime_rate_change")).alias("regime_rate_change")
    )


@query(
    "bridge_range_join",
    S.with_(
        S.PRICES, S.BRIDGE,
        select="""SELECT p.ticker, p.trade_date, b.issuer_id, b.sector, b.valid_from FROM prices p
          LEFT JOIN (SELECT * FROM bridge WHERE NOT (ticker % 7 = 0 AND valid_from < DATE '1998-01-01')) b
          ON b.ticker = p.ticker AND p.trade_date BETWEEN b.valid_from AND b.valid_to""",
    ),
)
def bridge_range_join(spark, sf_dir):
    m = Market(spark, sf_dir)
    known = m.bridge.filter("NOT (ticker % 7 = 0 AND valid_from < DATE '1998-01-01')")
    return intervals.range_join(m.prices.select("ticker", "trade_date"), known).select(
        "ticker", "trade_date", "issuer_id", "sector", "valid_from"
    )


@query(
    "unmapped_rows",
    S.with_(
        S.PRICES, S.BRIDGE,
        select="""SELECT ticker, count(*) AS bars, min(trade_date) AS first_date, max(trade_date) AS last_date FROM prices p
          WHERE NOT EXISTS (SELECT 1 FROM bridge b WHERE b.ticker = p.ticker AND p.trade_date BETWEEN b.valid_from AND b.valid_to
            AND NOT (b.ticker % 7 = 0 AND b.valid_from < DATE '1998-01-01')) GROUP BY 1""",
    ),
)
def unmapped_rows(spark, sf_dir):
    m = Market(spark, sf_dir)
    known = m.bridge.filter("NOT (ticker % 7 = 0 AND valid_from < DATE '1998-01-01')")
    rows = intervals.unmapped(m.prices.select("ticker", "trade_date"), known)
    return rows.groupBy("ticker").agg(
        F.count("*").alias("bars"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")
    )


_SPANS = """spans AS (SELECT o_custkey AS ticker, o_orderpriority AS issuer_id, CAST(o_orderdate AS DATE) AS valid_from,
    CAST(o_orderdate AS DATE) + CAST(20 + o_orderkey % 60 AS INTEGER) AS valid_to FROM orders)"""


def _spans(m: Market):
    day = F.col("o_orderdate").cast("date")
    return m.table("orders").select(
        F.col("o_custkey").alias("ticker"),
        F.col("o_orderpriority").alias("issuer_id"),
        day.alias("valid_from"),
        F.date_add(day, (20 + F.col("o_orderkey") % 60).cast("int")).alias("valid_to"),
    )


_STARTS = "starts AS (SELECT ticker, valid_from, max(valid_to) AS valid_to, count(*) AS intervals FROM {0} GROUP BY 1, 2)"
_OVERLAP = """SELECT a.ticker, a.valid_from, a.valid_to, a.intervals, max(b.valid_to) AS earlier_end
    FROM starts a LEFT JOIN starts b ON a.ticker = b.ticker AND b.valid_from < a.valid_from
    GROUP BY ALL HAVING a.intervals > 1 OR a.valid_from <= max(b.valid_to)"""
_MERGED = """marked AS (SELECT *, CASE WHEN valid_from <= max(valid_to) OVER (PARTITION BY ticker, issuer_id ORDER BY valid_from, valid_to
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker, issuer_id ORDER BY valid_from, valid_to
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked),
    merged AS (SELECT ticker, issuer_id, min(valid_from) AS valid_from, max(valid_to) AS valid_to FROM islands GROUP BY ticker, issuer_id, island)"""


@query("interval_overlaps", S.with_(_SPANS, _STARTS.format("spans"), select=_OVERLAP))
def interval_overlaps(spark, sf_dir):
    return intervals.overlaps(_spans(Market(spark, sf_dir)))


@query("owner_overlaps", S.with_(_SPANS, _MERGED, _STARTS.format("merged"), select=_OVERLAP))
def owner_overlaps(spark, sf_dir):
    return intervals.overlaps(_spans(Market(spark, sf_dir)), owner="issuer_id")


@query("merged_intervals", S.with_(_SPANS, _MERGED, select="SELECT * FROM merged"))
def merged_intervals(spark, sf_dir):
    return intervals.merge_overlapping(_spans(Market(spark, sf_dir)))


@query(
    "collapsed_filings",
    S.with_(
        _SPANS,
        select="SELECT ticker, issuer_id, valid_from, max(CASE WHEN valid_to <= DATE '1999-12-31' THEN valid_to END) AS valid_to FROM spans GROUP BY 1, 2, 3",
    ),
)
def collapsed_filings(spark, sf_dir):
    history = _spans(Market(spark, sf_dir)).withColumn(
        "valid_to", F.when(F.col("valid_to") <= F.lit("1999-12-31").cast("date"), F.col("valid_to"))
    )
    return intervals.collapse_repeats(history, ("ticker", "issuer_id", "valid_from"))


@query(
    "interval_sanity",
    S.with_(
        _SPANS,
        select="""SELECT 'reversed' AS rule, count(*) AS violations FROM spans WHERE valid_from > valid_to
          UNION ALL SELECT 'overlap', (SELECT count(*) FROM (SELECT ticker, valid_from, count(*) AS n, max(valid_to) AS e,
             max(max(valid_to)) OVER (PARTITION BY ticker ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
             FROM spans GROUP BY 1, 2) WHERE n > 1 OR valid_from <= p)""",
    ),
)
def interval_sanity(spark, sf_dir):
    spans = _spans(Market(spark, sf_dir))
    reversed_ = quality.reversed_intervals(spans).agg(F.count("*").alias("violations")).withColumn("rule", F.lit("reversed"))
    clash = intervals.overlaps(spans).agg(F.count("*").alias("violations")).withColumn("rule", F.lit("overlap"))
    return reversed_.unionByName(clash).select("rule", "violations")


@query(
    "sector_at_start",
    S.with_(
        S.BRIDGE,
        """labels_known AS (SELECT c_nationkey AS issuer_id, CAST(o_orderdate AS DATE) AS reference_date, max(c_mktsegment) AS known_sector
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-02-01' GROUP BY 1, 2)""",
        select="""SELECT b.ticker, b.issuer_id, b.valid_from, coalesce(l.known_sector, 'Unknown') AS sector_at_start
          FROM bridge b ASOF LEFT JOIN labels_known l ON b.issuer_id = l.issuer_id AND b.valid_from >= l.reference_date""",
    ),
)
def sector_at_start(spark, sf_dir):
    m = Market(spark, sf_dir)
    # Orders reduce to one label per customer and day before the join to the customer's nation.
    daily = m.table("orders").filter("o_orderdate >= TIMESTAMP '1995-02-01'").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("reference_date")
    ).distinct()
    labels = daily.join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("issuer_id"), "reference_date"
    ).agg(F.max("c_mktsegment").alias("known_sector"))
    joined = asof.asof_join(
        m.bridge.select("ticker", "issuer_id", "valid_from"), labels, ["issuer_id"], "valid_from", "reference_date", ["known_sector"]
    )
    return joined.select(
        "ticker", "issuer_id", "valid_from", F.coalesce("known_sector", F.lit("Unknown")).alias("sector_at_start")
    )


@query(
    "latest_version",
    S.with_(
        S.FACTS,
        select=f"""SELECT issuer_id, period_end, received, version, account, {r('value', 2)} AS value FROM (
          SELECT *, max(version) OVER (PARTITION BY issuer_id, period_end, received) AS top FROM facts) WHERE version = top""",
    ),
)
def latest_version(spark, sf_dir):
    return filings.latest_version(Market(spark, sf_dir).facts).select(
        "issuer_id", "period_end", "received", "version", "account", rounded(F.col("value"), 2).alias("value")
    )


@query(
    "earliest_receipt",
    S.with_(S.FACTS, select="SELECT issuer_id, period_end, account, min(received) AS received FROM facts GROUP BY 1, 2, 3"),
)
def earliest_receipt(spark, sf_dir):
    return filings.earliest_receipt(Market(spark, sf_dir).facts, ("issuer_id", "period_end", "account"))


_KNOWN = """receipts AS (SELECT DISTINCT issuer_id, received AS as_of FROM current WHERE account IN ('3.01', '3.11')),
  known AS (
    SELECT * EXCLUDE (n) FROM (
      SELECT q.as_of, c.*, row_number() OVER (PARTITION BY q.issuer_id, q.as_of, account, period_start, period_end
             ORDER BY received DESC, version DESC) AS n
      FROM receipts q JOIN current c ON c.issuer_id = q.issuer_id AND c.received <= q.as_of
      WHERE account IN ('3.01', '3.11')) WHERE n = 1)"""
_CURRENT = """current AS (SELECT * FROM (
    SELECT *, max(version) OVER (PARTITION BY issuer_id, period_end, received) AS top FROM facts) WHERE version = top)"""


@query(
    "known_facts_at_receipt",
    S.with_(
        S.FACTS, _CURRENT, _KNOWN,
        select=f"SELECT as_of, issuer_id, account, period_start, period_end, received, {r('value', 2)} AS value FROM known",
    ),
)
def known_facts_at_receipt(spark, sf_dir):
    facts = filings.latest_version(Market(spark, sf_dir).facts).filter(F.col("account").isin("3.01", "3.11"))
    return filings.known_facts(facts).select(
        "as_of", "issuer_id", "account", "period_start", "period_end", "received", rounded(F.col("value"), 2).alias("value")
    )


_BALANCE = """balance AS (
    SELECT issuer_id, period_end, received, max(CASE WHEN account = '1' THEN value END) AS assets,
           max(CASE WHEN account = '2.03' THEN value END) AS equity, max(CASE WHEN account = '2.01' THEN value END) AS current_liabilities
    FROM current GROUP BY 1, 2, 3)"""


@query(
    "balance_pivot",
    S.with_(
        S.FACTS, _CURRENT, _BALANCE,
        select=f"""SELECT issuer_id, period_end, received, {r('assets', 2)} AS assets, {r('equity', 2)} AS equity,
          {r('current_liabilities', 2)} AS current_liabilities FROM balance""",
    ),
)
def balance_pivot(spark, sf_dir):
    rows = filings.account_columns(
        filings.latest_version(Market(spark, sf_dir).facts), ["issuer_id", "period_end", "received"], filings.BALANCE_ACCOUNTS
    )
    return rows.select(
        "issuer_id", "period_end", "received", *[rounded(F.col(c), 2).alias(c) for c in ("assets", "equity", "current_liabilities")]
    )


_TTM = """steps AS (SELECT *, date_diff('day', period_start, period_end) + 1 AS days,
      lag(period_end) OVER w AS prev_end, lag(value) OVER w AS prev_value FROM known
      WINDOW w AS (PARTITION BY issuer_id, as_of, account, period_start ORDER BY period_end)),
  discrete AS (SELECT *, CASE WHEN prev_end IS NULL OR date_diff('day', prev_end, period_end) > 120
      THEN CASE WHEN days <= 120 THEN value END ELSE value - prev_value END AS piece FROM steps),
  placed AS (SELECT *, row_number() OVER (PARTITION BY issuer_id, as_of, account ORDER BY period_end DESC) AS n,
      date_diff('day', lead(period_end) OVER (PARTITION BY issuer_id, as_of, account ORDER BY period_end DESC), period_end) AS gap
      FROM discrete WHERE piece IS NOT NULL),
  recent AS (SELECT issuer_id, as_of, account, count(*) AS quarters, sum(piece) AS ttm,
      count(*) FILTER (WHERE n < 4 AND gap BETWEEN 60 AND 120) AS even FROM placed WHERE n <= 4 GROUP BY 1, 2, 3),
  fiscal AS (SELECT issuer_id, as_of, account, max_by(value, period_end) AS fy FROM steps WHERE days >= 330 GROUP BY 1, 2, 3),
  ttm AS (SELECT coalesce(a.issuer_id, f.issuer_id) AS issuer_id, coalesce(a.as_of, f.as_of) AS as_of, coalesce(a.account, f.account) AS account,
      CASE WHEN quarters = 4 AND even = 3 THEN ttm ELSE fy END AS value,
      CASE WHEN quarters = 4 AND even = 3 THEN 'TTM' WHEN fy IS NOT NULL THEN 'FY' END AS basis
    FROM recent a FULL JOIN fiscal f ON a.issuer_id = f.issuer_id AND a.as_of = f.as_of AND a.account = f.account)"""


@query(
    "ttm_flows",
    S.with_(S.FACTS, _CURRENT, _KNOWN, _TTM, select=f"SELECT issuer_id, as_of, account, {r('value', 2)} AS value, basis FROM ttm"),
)
def ttm_flows(spark, sf_dir):
    rows = filings.trailing_flows(filings.latest_version(Market(spark, sf_dir).facts))
    return rows.select("issuer_id", "as_of", "account", rounded(F.col("value"), 2).alias("value"), "basis")


_SNAP = """snap AS (
    SELECT b.*, t.revenue, t.net_income, t.revenue_basis,
      CASE WHEN lag(assets) OVER w > 0 THEN assets / lag(assets) OVER w END - 1.0 AS asset_growth
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, received ORDER BY period_end DESC) AS n FROM balance) WHERE n = 1) b
    LEFT JOIN (SELECT issuer_id, as_of, max(CASE WHEN account = '3.01' THEN value END) AS revenue,
        max(CASE WHEN account = '3.11' THEN value END) AS net_income, max(CASE WHEN account = '3.01' THEN basis END) AS revenue_basis
        FROM ttm GROUP BY 1, 2) t ON t.issuer_id = b.issuer_id AND t.as_of = b.received
    WINDOW w AS (PARTITION BY b.issuer_id ORDER BY received)),
  ratios AS (
    SELECT *, CASE WHEN revenue > 0 THEN net_income / revenue END AS net_margin, CASE WHEN equity > 0 THEN net_income / equity END AS roe_proxy,
      CASE WHEN assets > 0 THEN net_income / assets END AS roa_proxy, CASE WHEN assets > 0 THEN revenue / assets END AS asset_turnover,
      CASE WHEN assets > 0 THEN equity / assets END AS equity_to_assets, CASE WHEN assets > 0 THEN current_liabilities / assets END AS leverage_to_assets,
      CASE WHEN revenue > 0 THEN ln(1.0 + revenue) END AS log_revenue, CASE WHEN assets > 0 THEN ln(1.0 + assets) END AS log_assets,
      CASE WHEN equity > 0 THEN ln(1.0 + equity) END AS log_equity, equity IS NOT NULL AND equity <= 0 AS negative_equity FROM snap)"""
_RATIO = ["asset_growth", "net_margin", "roe_proxy", "roa_proxy", "asset_turnover", "equity_to_assets", "leverage_to_assets", "log_revenue", "log_assets", "log_equity"]


@query(
    "fundamental_ratios",
    S.with_(
        S.FACTS, _CURRENT, _KNOWN, _TTM, _BALANCE, _SNAP,
        select="SELECT issuer_id, period_end AS reference_date, received, revenue_basis, negative_equity, "
        + ", ".join(f"{r(c)} AS {c}" for c in _RATIO) + " FROM ratios",
    ),
)
def fundamental_ratios(spark, sf_dir):
    rows = Market(spark, sf_dir).snapshots
    return rows.select(
        "issuer_id", "reference_date", "received", "revenue_basis", "negative_equity", *[rounded(F.col(c)).alias(c) for c in _RATIO]
    )


_ATTACHED = """attached AS (
    SELECT m.*, b.issuer_id, b.sector, f.period_end AS reference_date, f.received, net_margin, roe_proxy, asset_turnover, equity_to_assets, asset_growth,
      roa_proxy, leverage_to_assets, log_revenue, log_assets, log_equity
    FROM monthly m LEFT JOIN bridge b ON b.ticker = m.ticker AND m.trade_date BETWEEN b.valid_from AND b.valid_to
    ASOF LEFT JOIN ratios f ON b.issuer_id = f.issuer_id AND m.trade_date >= f.received)"""
_ATT_RANKS = ["net_margin", "roe_proxy", "asset_turnover", "asset_growth"]


@query(
    "sector_rank",
    S.with_(
        S.PRICES, S.PANEL, S.MONTHLY, S.BRIDGE, S.FACTS, _CURRENT, _KNOWN, _TTM, _BALANCE, _SNAP, _ATTACHED,
        "ranked AS (SELECT ticker, trade_date, sector, reference_date, "
        + ", ".join(f"{S.avg_rank(c, 'trade_date')} AS rank_{c}, {S.avg_rank(c, 'trade_date, sector')} AS sector_rank_{c}" for c in _ATT_RANKS)
        + f", {S.avg_rank('momentum_12_1', 'trade_date, sector')} AS sector_rank_momentum_12_1 FROM attached)",
        select="SELECT ticker, trade_date, sector, "
        + ", ".join(f"{r('rank_' + c)} AS rank_{c}, {r('sector_rank_' + c)} AS sector_rank_{c}" for c in _ATT_RANKS)
        + f", {r('sector_rank_momentum_12_1')} AS sector_rank_momentum_12_1 FROM ranked",
    ),
)
def sector_rank(spark, sf_dir):
    rows = Market(spark, sf_dir).fundamentals
    names_ = [f"{p}_{c}" for c in _ATT_RANKS for p in ("rank", "sector_rank")] + ["sector_rank_momentum_12_1"]
    return rows.select("ticker", "trade_date", "sector", *[rounded(F.col(c)).alias(c) for c in names_])


@query(
    "missingness_staleness",
    S.with_(
        S.PRICES, S.PANEL, S.MONTHLY, S.BRIDGE, S.FACTS, _CURRENT, _KNOWN, _TTM, _BALANCE, _SNAP, _ATTACHED,
        "counted AS (SELECT *, (" + " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in _RATIO) + ") AS available FROM attached)",
        select=f"""SELECT ticker, trade_date, CAST(date_diff('day', reference_date, trade_date) AS INTEGER) AS fundamental_age_days,
          reference_date IS NULL OR date_diff('day', reference_date, trade_date) > 180 AS stale_fundamental,
          available AS fundamental_available_count, {r('1.0 - available / 13.0')} AS fundamental_missing_fraction FROM counted""",
    ),
)
def missingness_staleness(spark, sf_dir):
    rows = Market(spark, sf_dir).fundamentals
    return rows.select(
        "ticker", "trade_date", "fundamental_age_days", "stale_fundamental", "fundamental_available_count",
        rounded(F.col("fundamental_missing_fraction")).alias("fundamental_missing_fraction"),
    )


@query(
    "future_facts",
    S.with_(
        S.PRICES, S.FACTS, S.BRIDGE,
        select="""SELECT f.issuer_id, p.trade_date, count(*) AS facts FROM (SELECT DISTINCT trade_date FROM prices) p
          JOIN facts f ON date_trunc('month', f.received) = date_trunc('month', p.trade_date)
          WHERE f.received > p.trade_date OR f.period_end > f.received GROUP BY 1, 2""",
    ),
)
def future_facts(spark, sf_dir):
    m = Market(spark, sf_dir)
    # A deliberately careless join by month: the check must find every row it leaks.
    days = m.prices.select("trade_date").distinct().withColumn("month", F.trunc("trade_date", "MM"))
    careless = days.join(m.facts.withColumn("month", F.trunc("received", "MM")), "month")
    return quality.future_facts(careless).groupBy("issuer_id", "trade_date").agg(F.count("*").alias("facts"))


@query(
    "cardinality_checked_join",
    S.with_(
        S.FACTS,
        """checked AS (SELECT issuer_id, period_end, version, count(*) AS copies, min(received) AS received FROM (
            SELECT DISTINCT issuer_id, period_end, version, received FROM facts) GROUP BY 1, 2, 3)""",
        select="""SELECT f.issuer_id, f.version, count(*) AS rows, count(*) FILTER (WHERE c.received IS NULL) AS unmatched,
          max(c.copies) AS max_copies FROM facts f LEFT JOIN checked c
          ON c.issuer_id = f.issuer_id AND c.period_end = f.period_end AND c.version = f.version GROUP BY 1, 2""",
    ),
)
def cardinality_checked_join(spark, sf_dir):
    facts = Market(spark, sf_dir).facts
    keys = ["issuer_id", "period_end", "version"]
    documents = facts.select(*keys, "received").distinct()
    side = documents.groupBy(*keys).agg(F.count("*").alias("copies"), F.min("received").alias("received"))
    joined = facts.drop("received").join(side, keys, "left")
    return joined.groupBy("issuer_id", "version").agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.col("received").isNull(), 1)).alias("unmatched"),
        F.max("copies").alias("max_copies"),
    )


_ADJUST = """bounds AS (SELECT ticker, min(trade_date) AS first_bar, max(trade_date) AS last_bar FROM prices GROUP BY 1),
  priced AS (SELECT a.*, p.close AS cum_close, first_bar, last_bar FROM actions a JOIN bounds USING (ticker)
    ASOF LEFT JOIN prices p ON p.ticker = a.ticker AND a.last_date_prior >= p.trade_date),
  factors AS (SELECT ticker, last_date_prior,
      CASE WHEN action_type = 'stock_split' AND first_bar <= last_date_prior AND last_bar > last_date_prior THEN 1.0 / (1.0 + share_factor / 100.0) ELSE 1.0 END AS sm,
      CASE WHEN action_type = 'cash_dividend' AND cum_close IS NOT NULL THEN (cum_close - cash_amount) / cum_close ELSE 1.0 END AS cm FROM priced),
  adjusted AS (SELECT p.ticker, p.trade_date, p.close, coalesce(product(sm), 1.0) AS split_adjustment_factor, coalesce(product(cm), 1.0) AS cash_adjustment_factor
    FROM prices p LEFT JOIN factors f ON f.ticker = p.ticker AND f.last_date_prior >= p.trade_date GROUP BY 1, 2, 3)"""


@query(
    "split_factor",
    S.with_(S.PRICES, S.ACTIONS, _ADJUST, select=f"SELECT ticker, trade_date, {r('split_adjustment_factor')} AS split_adjustment_factor FROM adjusted"),
)
def split_factor(spark, sf_dir):
    m = Market(spark, sf_dir)
    line = events.action_timeline(m.prices, m.actions)
    return events.adjustment_factors(line).select(
        "ticker", "trade_date", rounded(F.col("split_adjustment_factor")).alias("split_adjustment_factor")
    )


@query(
    "total_return_close",
    S.with_(
        S.PRICES, S.ACTIONS, _ADJUST,
        select=f"""SELECT ticker, trade_date, {r('cash_adjustment_factor')} AS cash_adjustment_factor,
          {r('close * split_adjustment_factor * cash_adjustment_factor', 4)} AS adjusted_close FROM adjusted""",
    ),
)
def total_return_close(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = events.adjust_prices(m.prices, m.actions, check=False)
    return rows.select(
        "ticker", "trade_date", rounded(F.col("cash_adjustment_factor")).alias("cash_adjustment_factor"),
        rounded(F.col("adjusted_close"), 4).alias("adjusted_close"),
    )


@query(
    "stale_marks",
    S.with_(
        S.PRICES,
        "sessions AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS session FROM (SELECT DISTINCT trade_date FROM prices))",
        "grid AS (SELECT t.ticker, s.trade_date, s.session FROM (SELECT ticker, min(trade_date) AS first FROM prices GROUP BY 1) t JOIN sessions s ON s.trade_date >= t.first)",
        """filled AS (SELECT g.*, p.close IS NOT NULL AS quote_observed, last_value(p.close IGNORE NULLS) OVER w AS mark,
            g.session - last_value(CASE WHEN p.close IS NOT NULL THEN g.session END IGNORE NULLS) OVER w AS stale_sessions
            FROM grid g LEFT JOIN prices p ON p.ticker = g.ticker AND p.trade_date = g.trade_date
            WINDOW w AS (PARTITION BY g.ticker ORDER BY g.session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        "moves AS (SELECT *, mark / lag(mark) OVER (PARTITION BY ticker ORDER BY session) - 1.0 AS raw, lag(quote_observed) OVER (PARTITION BY ticker ORDER BY session) AS before FROM filled)",
        select=f"""SELECT ticker, trade_date, quote_observed, stale_sessions,
          {r('CASE WHEN stale_sessions = 4 THEN -0.999 ELSE raw END')} AS asset_return,
          coalesce(quote_observed AND before AND abs(raw) > 5.0, false) AS suspicious FROM moves""",
    ),
)
def stale_marks(spark, sf_dir):
    m = Market(spark, sf_dir)
    rows = events.stale_marks(m.prices, universe.session_calendar(m.prices), max_stale=3, max_abs_return=5.0)
    return rows.select(
        "ticker", "trade_date", "quote_observed", "stale_sessions", rounded(F.col("asset_return")).alias("asset_return"), "suspicious"
    )


_NAMES = """listed AS (SELECT s_suppkey AS ticker, CASE s_suppkey % 4 WHEN 0 THEN n_name || ' S.A.' WHEN 1 THEN substr(n_name, 1, 7)
      WHEN 2 THEN n_name || ' HOLDING' ELSE 'Nátion ' || n_nationkey || ' BCO' END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  keyed AS (SELECT ticker, name, CASE ticker % 4 WHEN 0 THEN replace(replace(name, ' S.A.', ''), '_', '') WHEN 1 THEN 'NATION'
      WHEN 2 THEN replace(replace(name, '_', ''), ' ', '') ELSE 'NATION' || split_part(name, ' ', 2) || 'BANCO' END AS name_key FROM listed),
  entries AS (SELECT n_nationkey AS issuer_id, n_name AS registered_name, replace(n_name, '_', '') AS entry_key FROM nation),
  exact AS (SELECT name_key, count(*) AS n, min(issuer_id) AS id FROM (SELECT DISTINCT name_key FROM keyed) JOIN entries ON entry_key = name_key GROUP BY 1),
  contained AS (SELECT name_key, count(*) AS n, min(issuer_id) AS id FROM (SELECT DISTINCT name_key FROM keyed) JOIN entries
      ON contains(name_key, entry_key) OR contains(entry_key, name_key) GROUP BY 1),
  state AS (SELECT k.name_key, coalesce(e.n, 0) AS exact_n, coalesce(c.n, 0) AS contained_n, e.id AS eid, c.id AS cid
      FROM (SELECT DISTINCT name_key FROM keyed) k LEFT JOIN exact e USING (name_key) LEFT JOIN contained c USING (name_key)),
  grams AS (SELECT s, g FROM (SELECT DISTINCT s, substr(s, CAST(i AS INTEGER), 3) AS g FROM (
      SELECT s, unnest(range(1, length(s) - 1)) AS i FROM (SELECT DISTINCT name_key AS s FROM keyed UNION SELECT entry_key FROM entries)))),
  sim AS (SELECT a.name_key, e.issuer_id, e.registered_name, round(2.0 * count(*) /
        ((SELECT count(*) FROM grams WHERE s = a.name_key) + (SELECT count(*) FROM grams WHERE s = e.entry_key)), 4) AS similarity
      FROM (SELECT name_key FROM state WHERE exact_n <> 1 AND NOT (exact_n = 0 AND contained_n = 1)) a
      JOIN grams g ON g.s = a.name_key JOIN grams h ON h.g = g.g JOIN entries e ON e.entry_key = h.s GROUP BY a.name_key, e.issuer_id, e.registered_name, e.entry_key),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY similarity DESC, registered_name DESC) AS place FROM sim),
  outcome AS (
    SELECT name_key, CASE WHEN exact_n = 1 THEN eid ELSE cid END AS issuer_id, CASE WHEN exact_n = 1 THEN 'exact_name' ELSE 'unique_name_containment' END AS match_type,
      'auto_added' AS status, 1 AS place FROM state WHERE exact_n = 1 OR (exact_n = 0 AND contained_n = 1)
    UNION ALL
    SELECT s.name_key, r.issuer_id, CASE WHEN r.place IS NULL THEN 'no_candidate' ELSE 'name_similarity' END,
      CASE WHEN r.place IS NULL THEN 'unresolved' WHEN exact_n > 0 OR contained_n > 1 THEN 'ambiguous' ELSE 'review_required' END, r.place
    FROM state s LEFT JOIN ranked r ON r.name_key = s.name_key AND r.place <= 3 WHERE NOT (exact_n = 1 OR (exact_n = 0 AND contained_n = 1)))"""


@query(
    "name_candidates",
    "WITH " + _NAMES + "\nSELECT ticker, keyed.name_key, issuer_id, match_type, status, place FROM keyed JOIN outcome ON outcome.name_key = keyed.name_key",
)
def name_candidates(spark, sf_dir):
    m = Market(spark, sf_dir)
    nation = m.table("nation")
    turn = F.col("s_suppkey") % 4
    name = (
        F.when(turn == 0, F.concat("n_name", F.lit(" S.A.")))
        .when(turn == 1, F.substring("n_name", 1, 7))
        .when(turn == 2, F.concat("n_name", F.lit(" HOLDING")))
        .otherwise(F.concat(F.lit("Nátion "), F.col("n_nationkey").cast("string"), F.lit(" BCO")))
    )
    listed = m.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("ticker"), name.alias("name")
    )
    registry = nation.select(F.col("n_nationkey").alias("issuer_id"), F.col("n_name").alias("registered_name"))
    return names.match_names(listed, registry).select("ticker", "name_key", "issuer_id", "match_type", "status", "place")


@query(
    "similar_names",
    """WITH grams AS (SELECT DISTINCT kind, name, substr(name, CAST(i AS INTEGER), 3) AS g FROM (
        SELECT 's' AS kind, s_name AS name, unnest(range(1, length(s_name) - 1)) AS i FROM supplier
        UNION ALL SELECT 'c', c_name, unnest(range(1, length(c_name) - 1)) FROM customer)),
      sizes AS (SELECT kind, name, count(*) AS n FROM grams GROUP BY 1, 2),
      pairs AS (SELECT a.name AS s_name, b.name AS c_name, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.kind = 's' AND b.kind = 'c' GROUP BY 1, 2),
      scored AS (SELECT s_name, c_name, round(2.0 * shared / (x.n + y.n), 4) AS similarity FROM pairs
        JOIN sizes x ON x.kind = 's' AND x.name = s_name JOIN sizes y ON y.kind = 'c' AND y.name = c_name)
      SELECT s_name, c_name, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY s_name ORDER BY similarity DESC, c_name DESC) AS place FROM scored) WHERE place <= 3""",
)
def similar_names(spark, sf_dir):
    """The three customers whose names are most like each supplier's; all share pieces of their common form."""
    m = Market(spark, sf_dir)
    suppliers = m.table("supplier").select(F.col("s_name").alias("name_key")).distinct()
    customers = m.table("customer").select(F.col("c_name").alias("entry_key"), F.col("c_name").alias("label")).distinct()
    best = names.nearest_entries(suppliers, customers)
    w = Window.partitionBy("name_key").orderBy(F.col("similarity").desc(), F.col("label").desc())
    return best.select(F.col("name_key").alias("s_name"), F.col("entry_key").alias("c_name"), "similarity", F.row_number().over(w).cast("bigint").alias("place"))


@query(
    "latest_label",
    """SELECT l_suppkey, l_returnflag, CAST(first_seen AS DATE) AS first_seen, CAST(last_seen AS DATE) AS last_seen, sightings FROM (
       SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY last_seen DESC, sightings DESC, l_returnflag) AS n FROM (
         SELECT l_suppkey, l_returnflag, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS sightings
         FROM lineitem GROUP BY 1, 2)) WHERE n = 1""",
)
def latest_label(spark, sf_dir):
    lines = Market(spark, sf_dir).table("lineitem")
    rows = names.latest_label(lines, "l_suppkey", "l_returnflag", "l_shipdate")
    return rows.select(
        "l_suppkey", "l_returnflag", F.col("first_seen").cast("date").alias("first_seen"),
        F.col("last_seen").cast("date").alias("last_seen"), "sightings",
    )


@query(
    "precedence_merge",
    """SELECT ticker, issuer_id, source FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prio) AS n FROM (
        SELECT s_suppkey AS ticker, s_nationkey AS issuer_id, 'reviewed' AS source, 1 AS prio FROM supplier WHERE s_acctbal > 5000
        UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25, 'official', 2 FROM supplier WHERE s_acctbal > 0
        UNION ALL SELECT s_suppkey, (s_nationkey + 2) % 25, 'name', 3 FROM supplier)) WHERE n = 1""",
)
def precedence_merge(spark, sf_dir):
    s = Market(spark, sf_dir).table("supplier")

    def source(shift: int, label: str, rows):
        return rows.select(
            F.col("s_suppkey").alias("ticker"), ((F.col("s_nationkey") + shift) % 25).alias("issuer_id"), F.lit(label).alias("source")
        )

    return names.precedence_merge(
        source(0, "reviewed", s.filter("s_acctbal > 5000")), source(1, "official", s.filter("s_acctbal > 0")), source(2, "name", s)
    )


@query(
    "distinct_actions",
    S.with_(
        S.PRICES, S.ACTIONS,
        select="""SELECT ticker, action_type, year(last_date_prior) AS year, max(last_date_prior) AS last_date_prior, count(*) AS copies
          FROM (SELECT ticker, action_type, last_date_prior FROM actions UNION ALL SELECT ticker, action_type, last_date_prior - 7 FROM actions) GROUP BY 1, 2, 3""",
    ),
)
def distinct_actions(spark, sf_dir):
    a = Market(spark, sf_dir).actions.select("ticker", "action_type", "last_date_prior")
    both = a.unionByName(a.withColumn("last_date_prior", F.date_sub("last_date_prior", 7))).withColumn(
        "year", F.year("last_date_prior").cast("bigint")
    )
    kept = names.distinct_latest(both, ["ticker", "action_type", "year"], [F.col("last_date_prior").desc()])
    copies = both.groupBy("ticker", "action_type", "year").agg(F.count("*").alias("copies"))
    return kept.join(copies, ["ticker", "action_type", "year"])
