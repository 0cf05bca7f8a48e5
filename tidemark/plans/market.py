"""A deterministic weekly market inside the warehouse tables.

A supplier is a ticker, a week of its shipments is a bar, its nation is the issuer and its region
the sector. Orders of a nation's customers become quarterly statement facts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import book, events, factors, filings, selection, technical, universe
from tidemark.operators.universe import UniverseConfig
from tidemark.session import cut_lineage

WEEKLY = technical.BarWindows(short=2, month=4, quarter=12, half=26, year=52, unit="w")
HORIZON = 4
UNIVERSE = UniverseConfig(history=52, participation_window=12, participation=0.70, adv_window=12, adv=10_000.0)
OPEN_END = "2999-12-31"
BRIDGE_SPLIT = "1998-07-01"


def exact_sum(column: str | Column) -> Column:
    """Sum of a money column that does not depend on the order of rows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast("decimal(18,2)")).cast("double")


class Market:
    """Views over one folder of warehouse tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def cross_section(self) -> int:
        """Most rows one date can have: the number of tickers that were ever traded."""
        return self.table("lineitem").agg(F.count_distinct("l_suppkey")).first()[0]

    @cached_property
    def prices(self) -> DataFrame:
        """Weekly bars. Shipments are pre-aggregated before the shuffle, so a ticker with a third
        of all shipments still sends one row per week and map task. Windows, the calendar and the universe all read the
        bars, so they are written once and shipments are scanned once a query."""
        week = F.date_trunc("week", "l_shipdate").cast("date")
        bars = self.table("lineitem").groupBy(F.col("l_suppkey").alias("ticker"), week.alias("trade_date")).agg(
            exact_sum("l_extendedprice").alias("traded_value_brl"),
            exact_sum("l_quantity").alias("quantity"),
            F.count("*").alias("trades"),
        )
        return cut_lineage(bars.select(
            "ticker", "trade_date", (F.col("traded_value_brl") / F.col("quantity")).alias("close"), "traded_value_brl", "trades"
        ))

    @cached_property
    def issuers(self) -> DataFrame:
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(F.col("n_nationkey").alias("issuer_id"), F.col("n_name").alias("issuer_name"), F.col("r_name").alias("sector"))
        return nations

    @cached_property
    def securities(self) -> DataFrame:
        return self.table("supplier").join(
            self.issuers, F.col("s_nationkey") == F.col("issuer_id")
        ).select(F.col("s_suppkey").alias("ticker"), "issuer_id", "sector")

    @cached_property
    def panel(self) -> DataFrame:
        return technical.technical_features(self.prices, WEEKLY, HORIZON, 1, self.cross_section)

    @cached_property
    def unranked(self) -> DataFrame:
        return technical.technical_features(self.prices, WEEKLY, HORIZON, 1, ranks=False)

    @cached_property
    def calendar(self) -> DataFrame:
        return technical.month_ends(self.prices)

    @cached_property
    def monthly(self) -> DataFrame:
        """Month-end rows; ranks are computed on these rows only, not on every week."""
        from tidemark.functions.ordered import add_average_ranks

        rows = technical.monthly_snapshots(self.unranked, self.calendar)
        return add_average_ranks(
            rows, ["trade_date"], {f"rank_{c}": c for c in WEEKLY.ranked}, ["ticker"], self.cross_section, "observed"
        )

    @cached_property
    def universe(self) -> DataFrame:
        return universe.point_in_time_universe(self.prices, UNIVERSE)

    @cached_property
    def eligible(self) -> DataFrame:
        """Month-end rows of eligible names with ranks and targets inside that set."""
        return universe.apply_universe(self.monthly, self.universe, True, self.cross_section)

    @cached_property
    def investible(self) -> DataFrame:
        return self.eligible.join(self.securities, "ticker")

    @cached_property
    def signals(self) -> DataFrame:
        """Eligible rows with filings, sleeve scores and a deterministic forecast."""
        rows = filings.attach_fundamentals(self.eligible, self.snapshots, self.bridge, 180, self.cross_section)
        scored = factors.composite_score(rows, None, WEEKLY)
        momentum, vol = F.col("rank_momentum_12_1"), F.col("rank_volatility_12w")
        return scored.withColumns(
            {
                "prediction": (momentum - 0.5) * 0.02 - (vol - 0.5) * 0.01,
                "uncertainty": F.abs(momentum - F.col("rank_return_12w")) * 0.01,
            }
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """The forecast without filings, for queries that need nothing else."""
        momentum, vol = F.col("rank_momentum_12_1"), F.col("rank_volatility_12w")
        return self.investible.withColumns(
            {
                "prediction": (momentum - 0.5) * 0.02 - (vol - 0.5) * 0.01,
                "uncertainty": F.abs(momentum - F.col("rank_return_12w")) * 0.01,
            }
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """One row per session; every accounting step reads it, so its lineage is cut."""
        return cut_lineage(universe.session_calendar(self.prices))

    @cached_property
    def targets(self) -> DataFrame:
        """Equal-weight top ten of four strategies per month: names quoted at the execution close,
        one per issuer. The table is small and read many times, so its lineage is cut."""
        rows = self.forecasts.select(
            "trade_date",
            "ticker",
            "issuer_id",
            F.col("rank_momentum_12_1").alias("signal_momentum"),
            (1.0 - F.col("rank_volatility_12w")).alias("signal_low_volatility"),
            (F.col("prediction") - 0.5 * F.col("uncertainty")).alias("signal_ml"),
            F.col("rank_log_traded_value_4w").alias("signal_liquidity"),
        )
        dated = book.execution_dates(rows, self.sessions)
        quotes = self.prices.select("ticker", F.col("trade_date").alias("execution_date"))
        quoted = dated.join(quotes, ["ticker", "execution_date"], "left_semi")
        scores = factors.by_strategy(quoted, ["trade_date", "ticker", "issuer_id"])
        top = selection.topk_with_issuer_cap(scores, "score", 10, ["strategy", "trade_date"])
        weighted = selection.equal_weights(top, ["strategy", "trade_date"])
        return cut_lineage(weighted.select("strategy", "trade_date", "ticker", "issuer_id", "rank", "target_weight"))

    @cached_property
    def marks(self) -> DataFrame:
        """Session returns of every name that was ever held."""
        held = self.targets.select("ticker").distinct()
        used = self.prices.join(held, "ticker", "left_semi")
        return events.stale_marks(used, self.sessions, 20)

    @cached_property
    def periods(self) -> DataFrame:
        return cut_lineage(book.rebalance_periods(self.targets, self.sessions))

    @cached_property
    def rates(self) -> DataFrame:
        return book.aligned_risk_free(self.sessions, self.risk_free, check=False)

    @cached_property
    def holdings(self) -> DataFrame:
        """At most k names and cash per strategy and session. Values, drift, turnover and curves all
        read it, so it is written once."""
        return cut_lineage(
            book.holding_values(
                self.targets, self.periods, self.marks.select("ticker", "session", "asset_return"), self.rates
            )
        )

    @cached_property
    def values(self) -> DataFrame:
        return book.period_values(self.holdings)

    @cached_property
    def orders(self) -> DataFrame:
        return book.order_book(self.targets, self.periods, book.drifted_weights(self.holdings, self.periods, self.values))

    @cached_property
    def turnover(self) -> DataFrame:
        return book.half_l1_turnover(self.orders)

    def curves(self, bps: tuple[float, ...] = (15.0,)) -> DataFrame:
        return book.equity_curves(self.periods, self.values, self.turnover, bps, self.sessions)

    @cached_property
    def index_curve(self) -> DataFrame:
        """The equal-weight market as a price path."""
        ret = technical.trailing_features(self.prices, WEEKLY).groupBy("trade_date").agg(
            F.avg(WEEKLY.ret).alias("daily_return")
        )
        return book.benchmark_curve(self.sessions, ret, initial=100_000.0)

    @cached_property
    def bridge(self) -> DataFrame:
        """Two validity intervals per ticker; some tickers move to another issuer."""
        later = F.when(F.col("ticker") % 3 == 0, (F.col("s_nationkey") + 1) % 25).otherwise(F.col("s_nationkey"))
        base = self.table("supplier").select(F.col("s_suppkey").alias("ticker"), "s_nationkey")
        intervals = F.array(
            F.struct(
                F.col("s_nationkey").alias("issuer_id"),
                F.lit("1995-01-01").cast("date").alias("valid_from"),
                F.date_sub(F.lit(BRIDGE_SPLIT).cast("date"), 1).alias("valid_to"),
            ),
            F.struct(
                later.alias("issuer_id"),
                F.lit(BRIDGE_SPLIT).cast("date").alias("valid_from"),
                F.lit(OPEN_END).cast("date").alias("valid_to"),
            ),
        )
        return base.select("ticker", F.inline(intervals)).join(self.issuers.select("issuer_id", "sector"), "issuer_id")

    @cached_property
    def facts(self) -> DataFrame:
        """Quarterly statement facts per issuer with receipt dates and versions.

        Orders are summed per customer first, so one customer with a third of all orders is
        reduced on the map side before the join to its nation.
        """
        quarter = F.trunc("o_orderdate", "quarter")
        per_customer = self.table("orders").groupBy("o_custkey", quarter.alias("q")).agg(
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
            F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))).alias("filled"),
        )
        quarters = (
            per_customer.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("issuer_id"), "q")
            .agg(F.sum("total").alias("total"), F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"))
        )
        from pyspark.sql import Window

        year = Window.partitionBy("issuer_id", F.year("q")).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
        life = Window.partitionBy("issuer_id").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
        end = F.last_day(F.add_months("q", 2))
        cumulative = quarters.select(
            "issuer_id",
            F.trunc("q", "year").alias("period_start"),
            end.alias("period_end"),
            F.date_add(end, (30 + F.col("issuer_id") % 30).cast("int")).alias("received"),
            F.sum("total").over(year).cast("double").alias("revenue"),
            F.sum("filled").over(year).cast("double").alias("income"),
            F.sum("total").over(life).cast("double").alias("assets"),
        )
        entries = F.array(
            F.struct(F.lit("1").alias("account"), F.col("assets").alias("value")),
            F.struct(F.lit("3.01").alias("account"), F.col("revenue").alias("value")),
            F.struct(F.lit("3.11").alias("account"), F.col("income").alias("value")),
            F.struct(F.lit("2.03").alias("account"), (F.col("assets") - F.col("revenue")).alias("value")),
            F.struct(F.lit("2.01").alias("account"), (F.col("revenue") * 0.5).alias("value")),
        )
        first = cumulative.select(
            "issuer_id", "period_start", "period_end", "received", F.lit(1).cast("bigint").alias("version"), F.inline(entries)
        )
        second = first.filter(F.col("issuer_id") % 5 == 0).select(
            "issuer_id",
            "period_start",
            "period_end",
            F.date_add("received", 45).alias("received"),
            F.lit(2).cast("bigint").alias("version"),
            "account",
            (F.col("value") * 1.01).alias("value"),
        )
        return first.unionByName(second).withColumn("reference_date", F.col("period_end"))

    @cached_property
    def snapshots(self) -> DataFrame:
        return filings.company_snapshots(self.facts)

    @cached_property
    def fundamentals(self) -> DataFrame:
        """Month-end rows with the filing known at that date and its ranks."""
        sector_ranked = ("momentum_12_1", "medium_term_momentum", WEEKLY.reversal, "volatility_12w", WEEKLY.residual_volatility, WEEKLY.log_value, WEEKLY.amihud)
        return filings.attach_fundamentals(
            self.monthly, self.snapshots, self.bridge, 180, self.cross_section, sector_ranked
        )

    @cached_property
    def macro(self) -> DataFrame:
        """Monthly series dated at the end of its month."""
        return self.table("orders").groupBy(F.last_day("o_orderdate").alias("date")).agg(
            (exact_sum("o_totalprice") / F.count("*") / 100000.0).alias("value")
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Yearly cash distributions of 2% and one 100% split for every tenth ticker."""
        cash = self.prices.groupBy("ticker", F.year("trade_date").alias("y")).agg(
            F.max("trade_date").alias("last_date_prior"), F.max_by("close", "trade_date").alias("px")
        ).select(
            "ticker", F.lit("cash_dividend").alias("action_type"), "last_date_prior",
            (F.col("px") * 0.02).alias("cash_amount"), F.lit(None).cast("double").alias("share_factor"),
        )
        split = (
            self.prices.filter((F.col("ticker") % 10 == 0) & (F.col("trade_date") >= F.lit("1998-01-01").cast("date")))
            .groupBy("ticker")
            .agg(F.min("trade_date").alias("last_date_prior"))
            .select(
                "ticker", F.lit("stock_split").alias("action_type"), "last_date_prior",
                F.lit(None).cast("double").alias("cash_amount"), F.lit(100.0).alias("share_factor"),
            )
        )
        return cash.unionByName(split)

    @cached_property
    def risk_free(self) -> DataFrame:
        """One percent-style return per session."""
        return self.prices.select("trade_date").distinct().select(
            "trade_date", (0.0005 + 0.0001 * (F.month("trade_date") % 3)).alias("daily_return")
        )
