"""The same market as ANSI SQL, used only by the checks."""

from __future__ import annotations

HORIZON = 4


def r(expr: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


def avg_rank(value: str, by: str, denominator: str | None = "observed") -> str:
    """Tie-averaged rank, optionally divided by the observed or all rows."""
    rank = (
        f"(rank() OVER (PARTITION BY {by} ORDER BY {value} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)"
    )
    if denominator == "observed":
        rank += f" / count({value}) OVER (PARTITION BY {by})"
    if denominator == "all":
        rank += f" / count(*) OVER (PARTITION BY {by})"
    return f"CASE WHEN {value} IS NOT NULL THEN {rank} END"


def full(agg: str, value: str, bars: int, minimum: int | None = None, skip: int = 0) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {bars - 1 + skip} PRECEDING AND {skip} PRECEDING)"
    if skip == 0:
        frame = f"OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {bars - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {frame} >= {minimum or bars} THEN {agg}({value}) {frame} END"


PRICES = """prices AS (
  SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
           / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS traded_value_brl,
         count(*) AS trades
  FROM lineitem GROUP BY 1, 2)"""

ISSUERS = """issuers AS (
  SELECT n_nationkey AS issuer_id, n_name AS issuer_name, r_name AS sector
  FROM nation JOIN region ON n_regionkey = r_regionkey),
securities AS (
  SELECT s_suppkey AS ticker, issuer_id, sector FROM supplier JOIN issuers ON s_nationkey = issuer_id)"""

_lag = "lag({0}, {1}) OVER (PARTITION BY ticker ORDER BY trade_date)"
_lead = "lead({0}, {1}) OVER (PARTITION BY ticker ORDER BY trade_date)"


def _panel() -> str:
    cols = []
    for n in (2, 4, 12, 26, 52):
        cols.append(f"close / {_lag.format('close', n)} - 1.0 AS return_{n}w")
        cols.append(f"{full('stddev_samp', 'ret_1w', n)} AS volatility_{n}w")
    for n in (4, 12, 52):
        cols.append(f"close / ({full('avg', 'close', n)}) - 1.0 AS distance_sma_{n}w")
    cols.append(f"{_lag.format('close', 4)} / {_lag.format('close', 52)} - 1.0 AS momentum_12_1")
    cols.append("ln(1.0 + traded_value_brl) AS log_traded_value")
    cols.append(f"ln(1.0 + {full('avg', 'traded_value_brl', 4)}) AS log_traded_value_4w")
    cols.append(f"ln(1.0 + {full('avg', 'traded_value_brl', 4)}) AS log_volume_4w")
    cols.append(f"ln(1.0 + {full('avg', 'trades', 4)}) AS log_trades_4w")
    cols.append(f"{full('avg', 'impact', 4)} AS amihud_illiquidity_4w")
    cols.append(f"{_lead.format('trade_date', 1)} AS target_start_date")
    cols.append(f"{_lead.format('trade_date', 1 + HORIZON)} AS target_end_date")
    cols.append(f"{_lead.format('close', 1 + HORIZON)} / {_lead.format('close', 1)} - 1.0 AS future_return")
    cols.append("ret_1w - market_return_1w AS market_residual_1w")
    return f"""rets AS (
  SELECT *, close / {_lag.format('close', 1)} - 1.0 AS ret_1w FROM prices),
market AS (SELECT trade_date, avg(ret_1w) AS market_return_1w FROM rets GROUP BY 1),
base AS (
  SELECT rets.*, market_return_1w, abs(ret_1w) / greatest(traded_value_brl, 1e-12) AS impact
  FROM rets JOIN market USING (trade_date)),
feat AS (SELECT *, {', '.join(cols)} FROM base),
panel AS (
  SELECT *, -return_2w AS short_term_reversal_2w, 0.5 * return_12w + 0.5 * return_26w AS medium_term_momentum,
         {full('stddev_samp', 'market_residual_1w', 12)} AS residual_volatility_12w
  FROM feat),
calendar AS (SELECT date_trunc('month', trade_date) AS month, max(trade_date) AS trade_date FROM prices GROUP BY 1)"""


PANEL = _panel()

RANKED = [
    "return_4w", "return_12w", "return_26w", "momentum_12_1", "volatility_12w", "distance_sma_12w", "log_volume_4w",
    "short_term_reversal_2w", "medium_term_momentum", "residual_volatility_12w", "log_traded_value_4w",
    "amihud_illiquidity_4w",
]


def _ranks(by: str = "trade_date") -> str:
    return ", ".join(f"{avg_rank(c, by)} AS rank_{c}" for c in RANKED)


RANKS = _ranks()
MONTHLY = f"""monthly AS (
  SELECT *, {RANKS} FROM panel WHERE trade_date IN (SELECT trade_date FROM calendar))"""

UNIVERSE = """sessions AS (
  SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS session FROM (SELECT DISTINCT trade_date FROM prices)),
observed AS (
  SELECT trade_date, ticker,
         row_number() OVER (PARTITION BY ticker ORDER BY session) AS history_sessions,
         count(*) OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)
           / CAST(least(12, session + 1) AS DOUBLE) AS session_participation,
         quantile_cont(traded_value_brl, 0.5)
           OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS adv_brl
  FROM prices JOIN sessions USING (trade_date)),
universe AS (
  SELECT *, nullif(concat_ws(',',
      CASE WHEN history_sessions < 52 THEN 'insufficient_history' END,
      CASE WHEN session_participation < 0.70 THEN 'low_session_participation' END,
      CASE WHEN adv_brl < 10000 THEN 'low_adv' END), '') AS universe_rejection_reason
  FROM observed)"""

INVESTIBLE = f"""eligible AS (
  SELECT panel.*, history_sessions, session_participation, adv_brl
  FROM panel JOIN universe USING (ticker, trade_date)
  WHERE universe_rejection_reason IS NULL AND trade_date IN (SELECT trade_date FROM calendar)),
investible AS (
  SELECT eligible.*, {RANKS}, issuer_id, sector,
         avg(future_return) OVER (PARTITION BY trade_date) AS market_forward_return,
         future_return - avg(future_return) OVER (PARTITION BY trade_date) AS target_excess_return,
         ({avg_rank('future_return', 'trade_date')}) - 0.5 AS target_cross_sectional_rank
  FROM eligible JOIN securities USING (ticker))"""

_D = "CAST({0} AS DOUBLE)".format
FORECASTS = f"""forecasts AS (
  SELECT *, (rank_momentum_12_1 - {_D(0.5)}) * {_D(0.02)} - (rank_volatility_12w - {_D(0.5)}) * {_D(0.01)} AS prediction,
         abs(rank_momentum_12_1 - rank_return_12w) * {_D(0.01)} AS uncertainty
  FROM investible)"""

BRIDGE = """bridge AS (
  SELECT s_suppkey AS ticker, s_nationkey AS issuer_id, DATE '1995-01-01' AS valid_from, DATE '1998-06-30' AS valid_to, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT s_suppkey, n_nationkey, DATE '1998-07-01', DATE '2999-12-31', r_name
  FROM supplier JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 3 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END
  JOIN region ON n_regionkey = r_regionkey)"""

FACTS = """quarters AS (
  SELECT c_nationkey AS issuer_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total,
         coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS filled
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
cumulative AS (
  SELECT issuer_id, CAST(date_trunc('year', q) AS DATE) AS period_start,
         CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
         CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + CAST(30 + issuer_id % 30 AS INTEGER) AS received,
         CAST(sum(total) OVER (PARTITION BY issuer_id, year(q) ORDER BY q) AS DOUBLE) AS revenue,
         CAST(sum(filled) OVER (PARTITION BY issuer_id, year(q) ORDER BY q) AS DOUBLE) AS income,
         CAST(sum(total) OVER (PARTITION BY issuer_id ORDER BY q) AS DOUBLE) AS assets
  FROM quarters),
first_facts AS (
  SELECT issuer_id, period_start, period_end, received, CAST(1 AS BIGINT) AS version, '1' AS account, assets AS value FROM cumulative
  UNION ALL SELECT issuer_id, period_start, period_end, received, 1, '3.01', revenue FROM cumulative
  UNION ALL SELECT issuer_id, period_start, period_end, received, 1, '3.11', income FROM cumulative
  UNION ALL SELECT issuer_id, period_start, period_end, received, 1, '2.03', assets - revenue FROM cumulative
  UNION ALL SELECT issuer_id, period_start, period_end, received, 1, '2.01', revenue * 0.5 FROM cumulative),
facts AS (
  SELECT * FROM first_facts
  UNION ALL
  SELECT issuer_id, period_start, period_end, received + 45, CAST(2 AS BIGINT), account, value * CAST(1.01 AS DOUBLE)
  FROM first_facts WHERE issuer_id % 5 = 0)"""

ACTIONS = """actions AS (
  SELECT ticker, 'cash_dividend' AS action_type, max(trade_date) AS last_date_prior,
         max_by(close, trade_date) * CAST(0.02 AS DOUBLE) AS cash_amount, CAST(NULL AS DOUBLE) AS share_factor
  FROM prices GROUP BY ticker, year(trade_date)
  UNION ALL
  SELECT ticker, 'stock_split', min(trade_date), NULL, 100.0
  FROM prices WHERE ticker % 10 = 0 AND trade_date >= DATE '1998-01-01' GROUP BY ticker)"""

RISK_FREE = """risk_free AS (
  SELECT DISTINCT trade_date, CAST(0.0005 AS DOUBLE) + CAST(0.0001 AS DOUBLE) * (month(trade_date) % 3) AS daily_return FROM prices)"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
