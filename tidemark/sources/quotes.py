"""Fixed-width daily quote files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import cash_equity, cents, integer_field

RECORD_TYPE = "01"
LINE_LENGTH = 245
# Name, first byte (from 0), byte after the last, and kind of each field.
FIELDS = [
    ("record_type", 0, 2, "text"),
    ("trade_date", 2, 10, "date"),
    ("bdi_code", 10, 12, "text"),
    ("ticker", 12, 24, "text"),
    ("market_type", 24, 27, "integer"),
    ("issuer_short_name", 27, 39, "text"),
    ("specification", 39, 49, "text"),
    ("term_days", 49, 52, "text"),
    ("currency", 52, 56, "text"),
    ("open", 56, 69, "cents"),
    ("high", 69, 82, "cents"),
    ("low", 82, 95, "cents"),
    ("average", 95, 108, "cents"),
    ("close", 108, 121, "cents"),
    ("best_bid", 121, 134, "cents"),
    ("best_ask", 134, 147, "cents"),
    ("trades", 147, 152, "integer"),
    ("quantity", 152, 170, "integer"),
    ("traded_value_brl", 170, 188, "cents"),
    ("exercise_price", 188, 201, "cents"),
    ("correction_indicator", 201, 202, "text"),
    ("maturity_date", 202, 210, "text"),
    ("quote_factor", 210, 217, "integer"),
    ("exercise_points", 217, 230, "integer"),
    ("isin", 230, 242, "text"),
    ("distribution_number", 242, 245, "integer"),
]


def parse_quote_lines(lines: DataFrame, equities_only: bool = False, column: str = "line") -> DataFrame:
    """Typed quotes from a column of lines; other record types and short lines are left out."""
    line = F.col(column)
    kept = lines.filter((F.substring(line, 1, 2) == RECORD_TYPE) & (F.length(line) >= LINE_LENGTH))
    readers = {
        "text": F.trim,
        "integer": integer_field,
        "cents": cents,
        "date": lambda text: F.try_to_date(text, "yyyyMMdd"),
    }
    fields = [readers[kind](F.substring(line, start + 1, end - start)).alias(name) for name, start, end, kind in FIELDS]
    quotes = kept.select(*fields).withColumn("volume", F.col("traded_value_brl"))
    if equities_only:
        quotes = quotes.filter(cash_equity(F.col("market_type"), F.col("specification")))
    return quotes


def read_quotes(spark: SparkSession, path: str, equities_only: bool = True) -> DataFrame:
    """Quotes from unzipped files. The CSV reader is used for its latin-1 decoding: the separator
    never occurs, so each line is one value, and files stay splittable."""
    lines = spark.read.csv(path, schema="line string", sep="\u0001", encoding="ISO-8859-1", quote="")
    return parse_quote_lines(lines, equities_only)
