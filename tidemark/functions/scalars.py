"""Column expressions used across the panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Report labels and the event kinds they stand for.
CASH_LABELS = {
    "DIVIDENDO": "cash_dividend",
    "JRS CAP PROPRIO": "jcp",
    "JUROS CAP PROPRIO": "jcp",
    "RENDIMENTO": "cash_dividend",
}
STOCK_LABELS = {
    "DESDOBRAMENTO": "stock_split",
    "GRUPAMENTO": "reverse_split",
    "BONIFICACAO": "bonus_shares",
    "BONIFICAÇÃO": "bonus_shares",
}
# Accepted currencies and unit multipliers of statement amounts.
CURRENCIES = ["REAL", "REAIS", "BRL", "R$"]
SCALES = {"UNIDADE": 1.0, "UNIDADES": 1.0, "MIL": 1000.0}
# Share classes traded in the cash market, and legal-form words in issuer names.
CASH_MARKET = 10
EQUITY_PATTERN = r"^(ON|PN|PNA|PNB|PNC|PND|UNT)\b"
TICKER_PATTERN = r"^[A-Z]{4}\d{1,2}$"
LEGAL_FORM_WORDS = ["A", "CIA", "COMPANHIA", "S", "SA"]
ACCENTED = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝáàâãäåéèêëíìîïóòôõöúùûüçñý"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUCNYaaaaaaeeeeiiiiooooouuuucny"


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding that gives the same double in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def finite(value: Column) -> Column:
    """True for a number that is not null, NaN or infinite."""
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(finite(value), value.cast("double"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator)


def integer_field(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def cents(text: Column) -> Column:
    return integer_field(text) / F.lit(100.0)


def ptbr_decimal(text: Column) -> Column:
    """`1.234,5` and `1234.5` both read as 1234.5; anything else as null."""
    text = F.trim(text)
    comma = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return finite_or_null(F.when(F.contains(text, F.lit(",")), comma).otherwise(text).try_cast("double"))


def any_date(text: Column) -> Column:
    text = F.trim(text)
    return F.coalesce(
        F.try_to_date(F.substring(text, 1, 10), "dd/MM/yyyy"),
        F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
    )


def tidy_label(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(text)), r"\s+", " ")


def action_kind(label: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*pairs)[tidy_label(label)]


def company_id(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) >= 14, digits).otherwise(F.lpad(digits, 14, "0"))


def valid_ticker(ticker: Column) -> Column:
    return F.rlike(ticker, F.lit(TICKER_PATTERN))


def cash_equity(market_type: Column, specification: Column) -> Column:
    return (market_type == CASH_MARKET) & F.rlike(F.trim(specification), F.lit(EQUITY_PATTERN))


def issuer_root(ticker: Column) -> Column:
    return F.substring(ticker.cast("string"), 1, 4)


def issuer_name_key(name: Column) -> Column:
    """Accent-free upper-case words without legal forms, joined without spaces."""
    plain = F.upper(F.translate(name, ACCENTED, PLAIN))
    words = F.regexp_extract_all(plain, F.lit(r"([A-Z0-9]+)"), F.lit(1))
    words = F.transform(words, lambda w: F.when(w == "BCO", F.lit("BANCO")).otherwise(w))
    return F.array_join(F.filter(words, lambda w: ~w.isin(LEGAL_FORM_WORDS)), "")


def share_multiplier(kind: Column, factor: Column) -> Column:
    """Price multiplier of a share-count event; 1 for other kinds, null outside [1e-7, 1e7]."""
    raw = (
        F.when(kind.isin("stock_split", "bonus_shares"), 1.0 / (1.0 + factor / 100.0))
        .when(kind == "reverse_split", F.try_divide(F.lit(1.0), factor))
        .otherwise(F.lit(1.0))
    )
    return F.when(raw.between(1e-7, 1e7), raw)


def quoted_spread_bps(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2.0) * 10000.0)


def traded_value(df: DataFrame) -> Column:
    """The named traded value, falling back to the older `volume` column."""
    present = [F.col(c) for c in ("traded_value_brl", "volume") if c in df.columns]
    if not present:
        raise ValueError("prices need a traded_value_brl or volume column")
    return F.coalesce(*present)


def price_column(df: DataFrame) -> str:
    return "adjusted_close" if "adjusted_close" in df.columns else "close"


def utility(prediction: Column, uncertainty: Column, penalty: float) -> Column:
    return prediction - F.lit(float(penalty)) * F.coalesce(uncertainty, F.lit(0.0))


def normal_cdf(z: Column, terms: int = 220) -> Column:
    """Standard normal distribution function from its power series, inside the JVM.

    Phi(z) = 1/2 + phi(z) * sum over k of z^(2k+1) / (1*3*...*(2k+1)); beyond |z| = 8 the
    result is 0 or 1 to double precision.
    """
    acc = F.struct(z.cast("double").alias("term"), z.cast("double").alias("total"))

    def step(state, k):
        term = state["term"] * z * z / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), acc, step, lambda s: s["total"])
    density = F.exp(-z * z / 2.0) / F.sqrt(F.lit(2.0) * F.pi())
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(0.5 + density * series)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
