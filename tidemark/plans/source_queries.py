"""Queries over parsers and streams, on text and events derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.scalars import company_id, rounded, share_multiplier, valid_ticker
from tidemark.operators import factors, filings, quality
from tidemark.plans import market_sql as S
from tidemark.plans.filings_queries import _MACRO
from tidemark.plans.market import Market
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import FORECAST_SQL
from tidemark.session import shared_folder
from tidemark.sources import filings_files, layout
from tidemark.sources.actions import parse_action_payloads
from tidemark.sources.filings_files import parse_macro
from tidemark.sources.quotes import parse_quote_lines
from tidemark.streaming import events as streams

r = S.r


def quote_lines(m: Market):
    """Shipments written as fixed-width quote lines."""
    lines = m.table("lineitem")
    money = F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 13, "0")
    blank = F.lit("0" * 13)
    return lines.select(
        F.concat(
            F.when(F.col("l_linenumber") == 7, "99").otherwise("01"),
            F.date_format("l_shipdate", "yyyyMMdd"),
            F.lit("02"),
            F.rpad(F.col("l_suppkey").cast("string"), 12, " "),
            F.when(F.col("l_returnflag") == "R", "020").otherwise("010"),
            F.rpad(F.lit("NAME"), 12, " "),
            F.when(F.col("l_linestatus") == "O", F.rpad(F.lit("ON      NM"), 10, " ")).otherwise(F.rpad(F.lit("DRN"), 10, " ")),
            F.lit("   "),
            F.lit("R$  "),
            money, money, money, money, money, blank, blank,
            F.lpad(F.col("l_linenumber").cast("string"), 5, "0"),
            F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 18, "0"),
            F.lpad(money, 18, "0"),
            blank,
            F.lit(" 99991231"),
            F.lit("0000001"),
            blank,
            F.rpad(F.concat(F.lit("BR"), F.col("l_partkey").cast("string")), 12, " "),
            F.lit("007"),
        ).alias("line")
    )


@query(
    "quotes_fixed_width",
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS trade_date, count(*) AS quotes, CAST(sum(l_linenumber) AS BIGINT) AS trades,
        CAST(sum(l_quantity) AS BIGINT) AS quantity, {r('max(l_extendedprice)', 2)} AS max_close, {r('min(l_extendedprice)', 2)} AS min_value, CAST(7 AS BIGINT) AS distribution_number
      FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag <> 'R' AND l_linestatus = 'O' GROUP BY 1, 2""",
)
def quotes_fixed_width(spark, sf_dir):
    quotes = parse_quote_lines(quote_lines(Market(spark, sf_dir)), equities_only=True)
    return quotes.groupBy("ticker", "trade_date").agg(
        F.count("*").alias("quotes"),
        F.sum("trades").alias("trades"),
        F.sum("quantity").alias("quantity"),
        rounded(F.max("close"), 2).alias("max_close"),
        rounded(F.min("traded_value_brl"), 2).alias("min_value"),
        F.max("distribution_number").alias("distribution_number"),
    )


@query(
    "action_payloads",
    S.with_(
        S.PRICES, S.ACTIONS,
        select=f"""SELECT 'BR' || ticker AS isin, CASE WHEN action_type = 'stock_split' THEN 'stock_split' WHEN year(last_date_prior) % 2 = 0 THEN 'jcp' ELSE 'cash_dividend' END AS action_type,
          last_date_prior, CAST(CAST(cash_amount AS DECIMAL(18,4)) AS DOUBLE) AS cash_amount, share_factor,
          {r("CASE WHEN action_type = 'stock_split' THEN 1.0 / (1.0 + share_factor / 100.0) ELSE 1.0 END")} AS multiplier FROM actions""",
    ),
)
def action_payloads(spark, sf_dir):
    a = Market(spark, sf_dir).actions
    text = F.format_number(F.col("cash_amount").cast("decimal(18,4)"), 4)
    ptbr = F.translate(text, ",.", ".,")
    day = F.when(F.year("last_date_prior") % 2 == 0, F.date_format("last_date_prior", "dd/MM/yyyy")).otherwise(F.col("last_date_prior").cast("string"))
    isin = F.concat(F.lit("br"), F.col("ticker").cast("string"))
    cash = F.struct(
        F.when(F.year("last_date_prior") % 2 == 0, " jrs  cap proprio").otherwise("Dividendo").alias("label"), ptbr.alias("rate"), day.alias("lastDatePrior"), isin.alias("assetIssued")
    )
    stock = F.struct(F.lit("DESDOBRAMENTO").alias("label"), F.lit("100,00").alias("factor"), day.alias("lastDatePrior"), isin.alias("isinCode"))
    # One document per ticker and year: an issuer has a handful of events in a year.
    documents = a.groupBy("ticker", F.year("last_date_prior").alias("y")).agg(
        F.collect_list(F.when(F.col("action_type") == "cash_dividend", cash)).alias("cashDividends"),
        F.collect_list(F.when(F.col("action_type") == "stock_split", stock)).alias("stockDividends"),
    )
    body = F.to_json(F.struct("cashDividends", "stockDividends"))
    quoted = F.regexp_replace(F.to_json(F.struct(body.alias("s"))), r'^\{"s":(.*)\}$', "$1")
    shape = F.when(F.col("y") % 3 == 0, body).when(F.col("y") % 3 == 1, F.concat(F.lit("["), body, F.lit("]"))).otherwise(quoted)
    events = parse_action_payloads(documents.select(F.lit("ABCD").alias("issuer_root"), shape.alias("payload")))
    return events.select(
        "isin", "action_type", "last_date_prior", "cash_amount", "share_factor",
        rounded(share_multiplier(F.col("action_type"), F.col("share_factor"))).alias("multiplier"),
    )


@query(
    "normalized_amounts",
    f"""SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN {r("o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1000.0 WHEN o_orderstatus = 'O' THEN 1.0 END", 2)} END AS value FROM orders""",
)
def normalized_amounts(spark, sf_dir):
    rows = Market(spark, sf_dir).table("orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("string").alias("value"),
        F.when(F.col("o_orderpriority") == "5-LOW", "USD").when(F.col("o_orderpriority") == "1-URGENT", " reais").otherwise("R$").alias("currency"),
        F.when(F.col("o_orderstatus") == "F", "mil ").when(F.col("o_orderstatus") == "O", "UNIDADE").otherwise("BI").alias("scale"),
    )
    return filings.normalized_amounts(rows).select("o_orderkey", rounded(F.col("value"), 2).alias("value"))


@query(
    "company_ids",
    """SELECT c_custkey, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), 14, '0') AS company_id,
       regexp_full_match('TEST' || (c_custkey % 200), '[A-Z]{4}[0-9]{1,2}') AS ticker_ok FROM customer""",
)
def company_ids(spark, sf_dir):
    c = Market(spark, sf_dir).table("customer")
    ticker = F.concat(F.lit("TEST"), (F.col("c_custkey") % 200).cast("string"))
    return c.select("c_custkey", company_id(F.col("c_name")).alias("company_id"), valid_ticker(ticker).alias("ticker_ok"))


@query("macro_series", S.with_(_MACRO, select="SELECT date, CAST(CAST(value AS DECIMAL(18,4)) AS DOUBLE) AS value, '432' AS series_code FROM macro"))
def macro_series(spark, sf_dir):
    m = Market(spark, sf_dir).macro
    text = F.translate(F.format_number(F.col("value").cast("decimal(18,4)"), 4), ",.", ".,")
    return parse_macro(m.select(F.date_format("date", "dd/MM/yyyy").alias("data"), text.alias("valor")), "432")


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern the path may be one file or a folder of part files.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_dedupe(spark, sf_dir):
    run = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"
    stream = _event_stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "ts")
    streams.ingest(stream, f"{run}/table", f"{run}/state", "day", ["user_id", "event_type", "day"], ["ts"])
    return spark.read.parquet(f"{run}/table").select("user_id", "event_type", "day")


@query(
    "stream_upsert",
    """SELECT day, user_id, event_type, event_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM (
       SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def stream_upsert(spark, sf_dir):
    run = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"
    stream = _event_stream(spark, sf_dir).select(
        F.col("ts").cast("date").alias("day"), "user_id", "event_type", "ts", "event_id", "value", F.from_json("props", "k int")["k"].alias("k")
    )
    streams.ingest(stream, f"{run}/table", f"{run}/state", "day", ["day", "user_id", "event_type"], ["ts", "event_id"])
    return spark.read.parquet(f"{run}/table").select("day", "user_id", "event_type", "event_id", "value", "k")


@query(
    "checked_join",
    """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def checked_join(spark, sf_dir):
    """Orders to their customer and nation, many to one; a customer or nation listed twice would stop the query."""
    m = Market(spark, sf_dir)
    customers = m.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    orders = quality.checked_join(m.table("orders").select("o_orderkey", "o_custkey"), customers, ["o_custkey"], "inner")
    return quality.checked_join(orders, m.table("nation").select("n_nationkey", "n_name"), ["n_nationkey"], "inner").select("o_orderkey", "c_name", "n_name")


@query(
    "drifting_columns",
    """SELECT c_custkey AS party, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def drifting_columns(spark, sf_dir):
    m = Market(spark, sf_dir)
    return layout.union_drifting(
        m.table("customer").select(F.col("c_custkey").alias("party"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        m.table("supplier").select(F.col("s_suppkey").alias("party"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    ).select("party", "name", "segment", "balance")


@query(
    "partitioned_orders",
    """SELECT o_orderkey, o_orderstatus, year(o_orderdate) AS year, CASE WHEN year(o_orderdate) % 2 = 0 THEN o_totalprice END AS extra FROM orders""",
)
def partitioned_orders(spark, sf_dir):
    """Written year by year with a column that every other year lacks, then read as one table."""
    root = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}/orders"
    rows = Market(spark, sf_dir).table("orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("extra"))
    layout.write_partitioned(rows.filter("year % 2 = 1").drop("extra"), root, ["year"], ["o_orderkey"])
    layout.write_partitioned(rows.filter("year % 2 = 0"), root, ["year"], ["o_orderkey"])
    return layout.read_partitions(spark, f"{root}/adjusted", root).select("o_orderkey", "o_orderstatus", "year", "extra")


@query(
    "quarantined_prices",
    """WITH p AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS trade_date, CASE WHEN l_discount = 0.1 THEN 0.0 WHEN l_discount <> 0.09 THEN l_extendedprice END AS close FROM lineitem),
       bad AS (SELECT DISTINCT ticker, trade_date FROM p WHERE close IS NULL OR close <= 0)
       SELECT ticker, trade_date, close, 'invalid_price' AS reason FROM p WHERE close IS NULL OR close <= 0
       UNION ALL SELECT p.ticker, p.trade_date, close, 'good' FROM p LEFT JOIN bad ON bad.ticker = p.ticker AND bad.trade_date = p.trade_date WHERE bad.ticker IS NULL""",
)
def quarantined_prices(spark, sf_dir):
    price = F.when(F.col("l_discount") == 0.1, 0.0).when(F.col("l_discount") != 0.09, F.col("l_extendedprice"))
    rows = Market(spark, sf_dir).table("lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("trade_date"), price.alias("close"))
    good, side = layout.quarantine_prices(rows)
    return side.withColumnRenamed("quarantine_reason", "reason").unionByName(good.withColumn("reason", F.lit("good"))).select("ticker", "trade_date", "close", "reason")


@query(
    "registry_rows",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS company_id, CAST(c_nationkey AS VARCHAR) AS issuer_id, c_name AS registered_name, c_mktsegment AS status FROM customer""",
)
def registry_rows(spark, sf_dir):
    """Registry columns under their published headings, accents and all."""
    c = Market(spark, sf_dir).table("customer")
    file = c.select(
        F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("CNPJ_CIA"), F.col("c_nationkey").cast("string").alias("CD_CVM"),
        F.col("c_name").alias("DENOM_SOCIAL"), F.col("c_mktsegment").alias("SIT"), F.lit("2001-02-03").alias("DT_REG"),
    )
    return filings_files.parse_registry(file).select("company_id", "issuer_id", "registered_name", "status")


@query(
    "landed_files",
    """WITH l AS (SELECT CAST(l_linestatus AS VARCHAR) || strftime(l_shipdate, '%Y-%m') AS part, l_orderkey || '|' || l_linenumber || '|' || l_partkey AS line, l_orderkey, l_linenumber, l_partkey FROM lineitem),
       f AS (SELECT part, string_agg(line || chr(10), '' ORDER BY l_orderkey, l_linenumber, l_partkey) AS body FROM l GROUP BY 1)
       SELECT part, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS bytes FROM f""",
)
def landed_files(spark, sf_dir):
    """Digests of landed text files, one a month and line status, against the text they were written from."""
    root = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}/landed"
    lines = Market(spark, sf_dir).table("lineitem").select(
        F.concat(F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM")).alias("part"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey").alias("line"), "l_orderkey", "l_linenumber", "l_partkey",
    )
    lines.repartition("part").sortWithinPartitions("part", "l_orderkey", "l_linenumber", "l_partkey").select("part", "line").write.partitionBy("part").text(root)
    return layout.file_manifest(spark, root).select(F.regexp_extract("source", "part=([^/]+)/", 1).alias("part"), "sha256", "bytes")


@query(
    "published_runs",
    S.with_(
        *FORECAST_SQL,
        """signed AS (SELECT trade_date AS as_of, ticker, CASE WHEN month(trade_date) % 2 = 0 THEN 'second' ELSE 'first' END AS run,
            CASE WHEN month(trade_date) % 2 = 0 THEN -prediction ELSE prediction END AS prediction FROM forecasts)""",
        select=f"""SELECT as_of, ticker, run, CASE WHEN run = 'second' THEN 'even months again' ELSE 'all months' END AS notes,
          {r('greatest(0.0, least(100.0, 50.0 + 45.0 * coalesce(prediction / nullif(max(abs(prediction)) OVER (PARTITION BY as_of), 0.0), 0.0)))', 4)} AS score FROM signed""",
    ),
)
def published_runs(spark, sf_dir):
    """A run publishes every month, a second one replaces the even months and is retried; each run has one record."""
    root = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"
    rows = Market(spark, sf_dir).forecasts.select(F.col("trade_date").alias("as_of"), "ticker", "prediction")
    even = rows.filter(F.month("as_of") % 2 == 0).withColumn("prediction", -F.col("prediction"))
    for run, part, notes in (("first", rows, "all months"), ("second", even, "even months again"), ("second", even, "even months again")):
        scored = factors.snapshot_scores(part).select("as_of", "ticker", "score").withColumn("run", F.lit(run))
        layout.publish_run(
            scored, f"{root}/snapshots", f"{root}/runs", run,
            features=["prediction"], parameters={}, training_window={}, validation_folds=[], metrics={}, notes=notes,
        )
    runs = layout.read_experiments(spark, f"{root}/runs").select(F.col("experiment_id").alias("run"), "notes")
    published = spark.read.parquet(f"{root}/snapshots").join(runs, "run")
    return published.select("as_of", "ticker", "run", "notes", rounded(F.col("score"), 4).alias("score"))
