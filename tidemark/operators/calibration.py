"""From disagreement to expected error: when it may be trusted, and the rising curve that maps it.

All folds are groups of one job; a verdict is a row whose conditions are columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_quantiles, null_safe_join, running_before
from tidemark.functions.scalars import finite
from tidemark.operators import diagnostics

BINS = 5
#: Rows and distinct disagreements that a calibration needs.
LEAST_ROWS, LEAST_VALUES = 50, 5
#: Most blocks of a curve; with fewer distinct disagreements each is a block and the curve is the exact isotonic fit.
BLOCKS = 200


def reliability(errors: DataFrame, by: Sequence[str], keys: Sequence[str], x: str = "disagreement", y: str = "error", bins: int = BINS, group_bound: int | None = None) -> DataFrame:
    """Per group: rows, distinct x, rank correlation of x and y, and the mean y of up to `bins` quantile bins of x.

    Rows without finite x and y do not count. Bins whose edges coincide are one bin.
    """
    by = list(by)
    pairs = errors.filter(finite(F.col(x)) & finite(F.col(y))).select(*by, *keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    tied = pairs.groupBy(*by, "__x").agg(F.count("*").alias("__n"), F.sum("__y").alias("__s"))
    sizes = tied.groupBy(*by).agg(F.sum("__n").alias("rows"), F.count("*").alias("distinct_values"))
    cuts = exact_quantiles(tied, by, "__x", [i / bins for i in range(bins + 1)], times="__n")
    edges = F.array_sort(F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)])))
    inner = cuts.select(*by, F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0))).alias("__edges"))
    # One short array per group; joined without the hint, the values of a group could all go to one task.
    placed = null_safe_join(tied, F.broadcast(inner), by).withColumn("__bin", F.size(F.filter("__edges", lambda e: e < F.col("__x"))))
    means = placed.groupBy(*by, "__bin").agg((F.sum("__s") / F.sum("__n")).alias("__mean"))
    listed = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__bin", "__mean"))), lambda b: b["__mean"]).alias("bin_errors"))
    ic = diagnostics.rank_correlation(pairs, by, "__x", "__y", keys, 2, group_bound).select(*by, F.col("ic").alias("rank_correlation"))
    return null_safe_join(null_safe_join(sizes, listed, by), ic, by)


def verdicts(report: DataFrame, conditions: Mapping[str, Column] | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The report with `enabled` and `failed`, the names of the conditions that do not hold.

    A curve is used where enough rows and values were seen, a larger disagreement went with a larger error, and the bins
    rise; more conditions may be given.
    """
    steps = F.zip_with(F.slice("bin_errors", 2, BINS), F.slice("bin_errors", F.lit(1), F.greatest(F.size("bin_errors") - 1, F.lit(0))), lambda after, before: after >= before)
    holds = {
        **(conditions or {}),
        "rows": F.col("rows") >= least_rows,
        "values": F.col("distinct_values") >= LEAST_VALUES,
        "correlation": F.col("rank_correlation") > 0,
        "rising_bins": (F.size("bin_errors") >= 3) & F.forall(steps, lambda s: s),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(held, F.lit(False)), F.lit(name)) for name, held in holds.items()]))
    return report.withColumns({"enabled": F.size(failed) == 0, "failed": F.array_join(failed, ",")})


def rising_curve(errors: DataFrame, by: Sequence[str], x: str = "disagreement", y: str = "error", blocks: int = BLOCKS) -> DataFrame:
    """Isotonic means of y over blocks of x: per group and block its ends, rows and fitted value (max over starts of the
    least running mean that reaches past the block).

    Equal x share a block; blocks hold about equally many rows. Groups have at most `blocks` blocks, so the running means
    are blocks^2 / 2 rows a group, whatever the input.
    """
    by = list(by)
    tied = errors.filter(finite(F.col(x)) & finite(F.col(y))).groupBy(*by, F.col(x).alias("__x")).agg(F.count("*").alias("__n"), F.sum(y).alias("__s"))
    placed = running_before(
        tied.withColumn("__one", F.lit(1)), by, ["__x"], {"__before": "__n", "__place": "__one"}, totals={"__rows": "__n", "__values": "__one"}
    )
    block = F.when(F.col("__values") <= blocks, F.col("__place")).otherwise(F.floor(F.col("__before") * blocks / F.col("__rows"))).cast("int")
    cells = placed.withColumn("block", block).groupBy(*by, "block").agg(
        F.min("__x").alias("low"), F.max("__x").alias("high"), F.sum("__n").alias("rows"), F.sum("__s").alias("__s")
    )
    ordered = Window.partitionBy(*by).orderBy("block")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({"block": F.row_number().over(ordered), "__upto_n": F.sum("rows").over(upto), "__upto_s": F.sum("__s").over(upto)})
    starts = F.collect_list(F.struct(F.col("block").alias("__from"), (F.col("__upto_n") - F.col("rows")).alias("__n0"), (F.col("__upto_s") - F.col("__s")).alias("__s0"))).over(upto)
    spans = cells.withColumn("__starts", starts).select(*by, "block", "__upto_n", "__upto_s", F.inline("__starts"))
    mean = (F.col("__upto_s") - F.col("__s0")) / (F.col("__upto_n") - F.col("__n0"))
    later = Window.partitionBy(*by, "__from").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = spans.withColumn("__least", F.min(mean).over(later))
    fitted = least.groupBy(*by, "block").agg(F.max("__least").alias("fitted"))
    return null_safe_join(cells.drop("__s", "__upto_n", "__upto_s"), fitted, [*by, "block"])
