"""Corporate-action payloads as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import CASH_LABELS, STOCK_LABELS, action_kind, any_date, ptbr_decimal, tidy_label

# Fields of the payload.
PAYLOAD = (
    "struct<cashDividends: array<struct<label: string, corporateAction: string, rate: string, valueCash: string, "
    "lastDatePrior: string, lastDatePriorEx: string, assetIssued: string, isinCode: string, approvedOn: string, paymentDate: string>>, "
    "stockDividends: array<struct<label: string, factor: string, lastDatePrior: string, assetIssued: string, isinCode: string, approvedOn: string>>>"
)
KEY = ["isin", "action_type", "last_date_prior", "cash_amount", "share_factor"]


def _either(*texts):
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def parse_action_payloads(documents: DataFrame, column: str = "payload", root: str = "issuer_root") -> DataFrame:
    """Events from payload documents: an object, an array whose first element counts, or either
    wrapped in a JSON string. Rows with an unknown label, no date, no isin or no positive amount
    are left out."""
    text = F.trim(F.col(column))
    inner = F.from_json(F.concat(F.lit('{"s":'), text, F.lit("}")), "s string")["s"]
    text = F.when(F.startswith(text, F.lit('"')), F.trim(inner)).otherwise(text)
    item = F.when(F.startswith(text, F.lit("[")), F.get(F.from_json(text, f"array<{PAYLOAD}>"), F.lit(0))).otherwise(
        F.from_json(text, PAYLOAD)
    )
    parsed = documents.select(F.upper(F.substring(F.trim(F.col(root)), 1, 4)).alias("issuer_root"), item.alias("item"))

    cash = parsed.select("issuer_root", F.inline("item.cashDividends")).select(
        "issuer_root",
        F.upper(F.trim(_either("assetIssued", "isinCode"))).alias("isin"),
        action_kind(_either("label", "corporateAction"), CASH_LABELS).alias("action_type"),
        tidy_label(_either("label", "corporateAction")).alias("label"),
        any_date(_either("lastDatePrior", "lastDatePriorEx")).alias("last_date_prior"),
        any_date(F.col("approvedOn")).alias("approved_on"),
        any_date(F.col("paymentDate")).alias("payment_date"),
        ptbr_decimal(_either("rate", "valueCash")).alias("cash_amount"),
        F.lit(None).cast("double").alias("share_factor"),
    ).filter("cash_amount > 0")
    stock = parsed.select("issuer_root", F.inline("item.stockDividends")).select(
        "issuer_root",
        F.upper(F.trim(_either("isinCode", "assetIssued"))).alias("isin"),
        action_kind(F.col("label"), STOCK_LABELS).alias("action_type"),
        tidy_label(F.col("label")).alias("label"),
        any_date(F.col("lastDatePrior")).alias("last_date_prior"),
        any_date(F.col("approvedOn")).alias("approved_on"),
        F.lit(None).cast("date").alias("payment_date"),
        F.lit(None).cast("double").alias("cash_amount"),
        ptbr_decimal(F.col("factor")).alias("share_factor"),
    ).filter("share_factor > 0")
    events = cash.unionByName(stock).filter(
        F.col("action_type").isNotNull() & F.col("last_date_prior").isNotNull() & (F.col("isin") != "")
    )
    # Equal keys may differ in dates of approval or payment: the smallest row stays, whatever the
    # order of arrival.
    rest = [c for c in events.columns if c not in KEY]
    kept = events.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("__rest"))
    return kept.select(*KEY, "__rest.*")


def read_action_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file; the file name starts with the four-letter issuer root."""
    documents = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_name").alias("issuer_root")
    )
    return parse_action_payloads(documents)
