"""Ridge models of all folds, policies, targets and penalties from one pass of sufficient statistics.

A row is (1, x, m, y): features with zero for missing, missing flags, targets. Sums of weighted products of these per
date are additive, so every training window is a sum over dates, every decay a factor per date, and median filling,
standardising and centring are linear maps of the sums. The data are read once for the sums and once for the medians;
folds, policies, targets and penalties are keys of small tables, never loops over fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import null_safe_join, running_before
from tidemark.functions.scalars import finite, finite_or_null
from tidemark.operators import evaluation
from tidemark.operators.learning import RIDGE_ALPHA, TrainingPolicy
from tidemark.operators.selection import top_per_group
from tidemark.session import cut_lineage

#: A column whose variance is below this share of its mean square is constant; sums of products cannot tell less apart.
CONSTANT = 1e-12
#: Ranges of values that are counted before a median is looked up; more make the look-up smaller and the counts larger.
CELLS = 256
#: Ranges of values that are counted before a median is looked up; more make the look-up smaller and the counts larger.
CELLS = 256
MODEL = ["policy", "target", "alpha", "fold_year"]


def _fold_start(embargo_days: int):
    return lambda y: F.date_sub(F.make_date(y, F.lit(1), F.lit(1)), embargo_days)


def sliced(panel: DataFrame, years: Sequence[int], embargo_days: int = 0, clock: str = "trade_date", label_end: str = "target_end_date") -> DataFrame:
    """Rows by `slice`: (date, 0) is the whole date, (date, year) what the purge of that fold leaves of a date it cuts.

    Only dates with a label that is open at a fold's start are cut, so a row is in two slices at most for yearly folds
    and labels shorter than a year.
    """
    start = _fold_start(embargo_days)
    dates = panel.groupBy(clock).agg(F.max(label_end).alias("__last"))
    folds = F.array(*[F.lit(int(y)) for y in years])
    cutting = F.filter(folds, lambda y: (F.year(clock) < y) & (F.col("__last") >= start(y)) & (F.col(label_end) < start(y)))
    fanned = panel.join(F.broadcast(dates), clock).withColumn("__year", F.explode(F.concat(F.array(F.lit(0)), cutting)))
    return fanned.withColumn("slice", F.struct(F.col(clock).alias("date"), F.col("__year").alias("year"))).drop("__year", "__last")


def _partial_sums(features: int, targets: int):
    """Per task and slice: weighted products of (1, x, m, y), then count and plain sums of x, x*x and m."""
    width = 1 + 2 * features + targets

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            values = np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), features + targets)
            x, y = values[:, :features], values[:, features:]
            missing = np.isnan(x)
            x = np.where(missing, 0.0, x)
            z = np.hstack([np.ones((len(batch), 1)), x, missing, y])
            plain = np.hstack([np.ones((len(batch), 1)), x, x * x, missing])
            weight = batch["w"].to_numpy(dtype=float)
            for key, at in batch.groupby(["date", "year"], sort=False).indices.items():
                own = np.concatenate([(z[at].T @ (z[at] * weight[at, None])).ravel(), plain[at].sum(axis=0)])
                held[key] = held[key] + own if key in held else own
        if held:
            yield pd.DataFrame({"date": [k[0] for k in held], "year": [k[1] for k in held], "sums": list(held.values())})

    return sums, width * width + 1 + 3 * features


def date_sums(rows: DataFrame, features: Sequence[str], targets: Sequence[str], issuer: str = "issuer_id") -> DataFrame:
    """One row per slice with its `sums`; a task holds one array per date, partial arrays are added cell by cell."""
    weighted = evaluation.issuer_balanced_weights(rows, issuer, "slice")
    cells = [F.coalesce(finite_or_null(F.col(f)), F.lit(float("nan"))) for f in features] + [F.col(t).cast("double") for t in targets]
    sums, _ = _partial_sums(len(features), len(targets))
    parts = weighted.select("slice.date", "slice.year", F.array(*cells).alias("v"), F.col("sample_weight").alias("w")).mapInPandas(
        sums, "date date, year int, sums array<double>"
    )
    added = parts.select("date", "year", F.posexplode("sums").alias("cell", "s")).groupBy("date", "year", "cell").agg(F.sum("s").alias("s"))
    return added.groupBy("date", "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "s"))), lambda c: c["s"]).alias("sums"))


def memberships(dates: DataFrame, years: Sequence[int], policies: Sequence[TrainingPolicy], embargo_days: int = 0) -> DataFrame:
    """The slices of `dates` (date, last label end) that each policy trains on in each fold, with their decay."""
    grid = [
        F.struct(
            F.lit(p.name).alias("policy"), F.lit(int(y)).alias("fold_year"), F.lit(p.window_years).cast("int").alias("window"),
            F.lit(p.half_life_years).cast("double").alias("half_life"),
        )
        for p in policies for y in years
    ]
    start = F.make_date("fold_year", F.lit(1), F.lit(1))
    year = F.year("date")
    rows = dates.select("date", "last", F.inline(F.array(*grid)))
    rows = rows.filter((year < F.col("fold_year")) & (F.col("window").isNull() | (year >= F.col("fold_year") - F.col("window"))))
    whole = F.col("last") < F.date_sub(start, embargo_days)
    age = F.datediff(start, "date") / 365.25
    decay = F.coalesce(F.exp(-F.log(F.lit(2.0)) * age / F.col("half_life")), F.lit(1.0))
    return rows.select("policy", "fold_year", "window", "date", F.when(whole, 0).otherwise(F.col("fold_year")).alias("year"), decay.alias("decay"))


def _value_cells(rows: DataFrame, features: Sequence[str], cells: int) -> DataFrame:
    """Long (date, year, feature, cell, value) of the finite values; the cells of a feature are ranges that hold about equally many.

    Bounds may be approximate: whatever they are, equal values share a cell and a larger cell holds larger values.
    """
    clean = rows.select("slice.date", "slice.year", *[finite_or_null(F.col(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    steps = [i / cells for i in range(1, cells)]
    bounds = clean.agg(*[F.percentile_approx(f"x{i}", steps, 20 * cells).alias(f"x{i}") for i in range(len(features))]).first()
    splits = [[-float("inf"), *sorted(set(bounds[f"x{i}"] or [0.0])), float("inf")] for i in range(len(features))]
    placed = Bucketizer(
        splitsArray=splits, inputCols=[f"x{i}" for i in range(len(features))], outputCols=[f"c{i}" for i in range(len(features))], handleInvalid="keep"
    ).transform(clean)
    long = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"c{i}").cast("int").alias("cell"), F.col(f"x{i}").alias("value")) for i in range(len(features))])
    return placed.select("date", "year", F.inline(long)).filter("value IS NOT NULL")


def _value_cells(rows: DataFrame, features: Sequence[str], cells: int) -> DataFrame:
    """Long (date, year, feature, cell, value) of the finite values; the cells of a feature are ranges that hold about equally many.

    Bounds may be approximate: whatever they are, equal values share a cell and a larger cell holds larger values.
    """
    clean = rows.select("slice.date", "slice.year", *[finite_or_null(F.col(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    steps = [i / cells for i in range(1, cells)]
    bounds = clean.agg(*[F.percentile_approx(f"x{i}", steps, 20 * cells).alias(f"x{i}") for i in range(len(features))]).first()
    splits = [[-float("inf"), *sorted(set(bounds[f"x{i}"] or [0.0])), float("inf")] for i in range(len(features))]
    placed = Bucketizer(
        splitsArray=splits, inputCols=[f"x{i}" for i in range(len(features))], outputCols=[f"c{i}" for i in range(len(features))], handleInvalid="keep"
    ).transform(clean)
    long = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"c{i}").cast("int").alias("cell"), F.col(f"x{i}").alias("value")) for i in range(len(features))])
    return placed.select("date", "year", F.inline(long)).filter("value IS NOT NULL")


def window_medians(rows: DataFrame, members: DataFrame, features: Sequence[str], cells: int = CELLS) -> DataFrame:
    """Exact medians per (window, fold, feature) that has a value there.

    Rows do not meet their windows: counts per slice and cell do, which tells the cell or the two next to each other that hold a
    window's middle. Only the values in these are dealt out to windows. Features without gaps have a median too, since a
    row to be scored may lack them.
    """
    key = ["window", "fold_year", "feature"]
    windows = members.select("window", "fold_year", "date", "year").distinct()
    values = _value_cells(rows, features, cells)
    counted = cut_lineage(values.groupBy("date", "year", "feature", "cell").agg(F.count("*").alias("n")))  # slices x features x cells at most
    cell_sums = counted.join(F.broadcast(windows), ["date", "year"]).groupBy(*key, "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*key)
    upto = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    spans = cell_sums.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(group)})
    middle = spans.filter((F.col("before") <= high) & (low < F.col("before") + F.col("n")))
    # Positions of both middle values after the values of smaller cells.
    spots = middle.groupBy(*key).agg(F.collect_list("cell").alias("cells"), F.min("before").alias("skipped"), F.first(low).alias("low"), F.first(high).alias("high"))
    spots = cut_lineage(spots)  # windows x folds x features
    wanted = null_safe_join(windows, spots.select(*key, F.explode("cells").alias("cell")), ["window", "fold_year"], "inner")
    met = values.join(F.broadcast(wanted), ["date", "year", "feature", "cell"])  # wanted: slices x windows x features, two cells each at most
    tied = met.groupBy(*key, "value").agg(F.count("*").alias("n"))
    placed = null_safe_join(running_before(tied, key, ["value"], {"before": "n"}), F.broadcast(spots), key)  # smaller than `wanted`

    def at(position: str):
        place = F.col(position) - F.col("skipped")
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))

    return placed.groupBy(*key).agg(at("low").alias("low"), at("high").alias("high")).select(*key, (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("median"))


def solve(total: np.ndarray, median: np.ndarray, targets: int, alphas: Sequence[float]):
    """Standardised and raw coefficients of every target and penalty from one window's summed statistics."""
    p = len(median)
    width = 1 + 2 * p + targets
    gram, plain = total[: width * width].reshape(width, width), total[width * width:]
    n, sx, sxx, sm = plain[0], plain[1: 1 + p], plain[1 + p: 1 + 2 * p], plain[1 + 2 * p:]
    # Plain moments of filled features and flags; x * m is zero by construction.
    mean = np.concatenate([sx + median * sm, sm]) / n
    square = np.concatenate([sxx + median**2 * sm, sm]) / n
    variance = square - mean**2
    kept = np.flatnonzero(variance > CONSTANT * square)
    scale = np.sqrt(variance[kept])
    fill = np.eye(width)
    fill[1: 1 + p, 1 + p: 1 + 2 * p] = np.diag(median)
    mass = gram[0, 0]
    centred = fill @ (gram * (n / mass)) @ fill.T
    centred = centred - np.outer(centred[0], centred[0]) / n
    centre = (fill @ gram[0]) / mass
    design = centred[1: 1 + 2 * p, 1: 1 + 2 * p][np.ix_(kept, kept)] / np.outer(scale, scale)
    for t in range(targets):
        right = centred[1 + 2 * p + t, 1: 1 + 2 * p][kept] / scale
        for alpha in alphas:
            standard, raw = np.zeros(2 * p), np.zeros(2 * p)
            standard[kept] = np.linalg.solve(design + alpha * np.eye(len(kept)), right)
            raw[kept] = standard[kept] / scale
            intercept = centre[1 + 2 * p + t] - raw @ centre[1: 1 + 2 * p]
            raw[p:] += raw[:p] * median
            yield t, float(alpha), int(n), float(intercept), standard, raw, np.isin(np.arange(2 * p), kept)


def fit_folds(
    panel: DataFrame, years: Sequence[int], features: Sequence[str], policies: Sequence[TrainingPolicy],
    targets: Sequence[str] = ("target_excess_return",), alphas: Sequence[float] = (RIDGE_ALPHA,),
    min_train: int = 500, embargo_days: int = 0, issuer: str = "issuer_id",
) -> DataFrame:
    """One row per (policy, target, alpha, fold_year): train_rows, intercept, and arrays over features then missing flags.

    `standard` holds the coefficients of standardised columns, `raw` those of the plain ones, `used` which columns vary.
    Rows need a date, a label end and every target; a window of fewer than `min_train` rows, or of no rows, has no model.
    A feature that is missing throughout a window is not used there.
    """
    known = panel.filter(F.col("trade_date").isNotNull() & F.col("target_end_date").isNotNull())
    for t in targets:
        known = known.filter(finite(F.col(t)))
    rows = sliced(known, years, embargo_days)
    sums = cut_lineage(date_sums(rows, features, targets, issuer))
    members = memberships(known.groupBy(F.col("trade_date").alias("date")).agg(F.max("target_end_date").alias("last")), years, policies, embargo_days)
    members = cut_lineage(members)  # dates x folds x policies
    medians = window_medians(rows, members, features)
    p, count, names, penalties = len(features), len(targets), list(targets), [float(a) for a in alphas]
    windows = medians.groupBy("window", "fold_year").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("medians"))
    m, w = members.alias("m"), windows.alias("w")
    joined = m.join(sums.alias("s"), ["date", "year"]).join(
        w, F.col("m.window").eqNullSafe(F.col("w.window")) & (F.col("m.fold_year") == F.col("w.fold_year")), "left"
    )
    filled = F.array(*[F.coalesce(F.try_element_at(F.col("w.medians"), F.lit(i)), F.lit(0.0)) for i in range(p)])
    joined = joined.select("m.policy", "m.fold_year", "m.decay", "s.sums", filled.alias("medians"))
    width = 1 + 2 * p + count

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        stacked = np.array(group["sums"].tolist(), dtype=float)
        products = width * width
        # The decay weighs products, not the plain moments that standardise.
        total = np.concatenate([group["decay"].to_numpy() @ stacked[:, :products], stacked[:, products:].sum(axis=0)])
        if total[products] >= max(min_train, 1):
            for t, alpha, n, intercept, standard, raw, used in solve(total, np.array(group["medians"].iloc[0], dtype=float), count, penalties):
                out.append((key[0], names[t], alpha, key[1], n, intercept, standard, raw, used))
        return pd.DataFrame(out, columns=["policy", "target", "alpha", "fold_year", "train_rows", "intercept", "standard", "raw", "used"])

    schema = "policy string, target string, alpha double, fold_year int, train_rows long, intercept double, standard array<double>, raw array<double>, used array<boolean>"
    return joined.groupBy("policy", "fold_year").applyInPandas(fit, schema)


def coefficients(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long standardised coefficients of the columns that a model uses."""
    names = [*features, *[f"missing_{f}" for f in features]]
    cells = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("term"), "standard", "used")
    long = models.select(*MODEL, "train_rows", F.explode(cells).alias("c"))
    return long.filter("c.used").select(*MODEL, "train_rows", F.col("c.term").alias("term"), F.col("c.standard").alias("coefficient"))


def predict_folds(models: DataFrame, panel: DataFrame, features: Sequence[str], keep: Sequence[str] = ("trade_date", "ticker"), min_valid: int = 100) -> DataFrame:
    """Every model's predictions of its fold's year; columns only, no Python. Years with fewer than `min_valid` rows stay out."""
    valid = panel.withColumn("fold_year", F.year("trade_date"))
    sizes = valid.groupBy("fold_year").agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_valid).drop("__n")
    p = len(features)
    terms = F.col("intercept")
    for i, f in enumerate(features):
        x = finite_or_null(F.col(f))
        terms = terms + F.when(x.isNotNull(), F.get("raw", F.lit(i)) * x).otherwise(F.get("raw", F.lit(p + i)))
    usable = models.join(sizes, "fold_year")
    joined = valid.join(usable.withColumnRenamed("target", "__target"), "fold_year")
    return joined.select("policy", F.col("__target").alias("target"), "alpha", "fold_year", *keep, terms.alias("prediction"))


def nested_choice(yearly: DataFrame, outer_years: Sequence[int], inner_years: int = 3, metric: str = "rank_ic") -> DataFrame:
    """For each outer year the trial (policy, alpha) with the best mean over the inner years before it, and its outer value.

    `yearly` has one row per (policy, alpha, fold_year). A trial competes where it has all its inner years; ties go to the
    first policy and the smallest penalty. The outer year's own value plays no part in the choice.
    """
    outer = yearly.select("policy", "alpha", F.col("fold_year").alias("__inner"), F.col(metric).alias("__v")).withColumn(
        "fold_year", F.explode(F.array(*[F.lit(int(y)) for y in outer_years]))
    )
    inner = outer.filter(F.col("__inner").between(F.col("fold_year") - inner_years, F.col("fold_year") - 1))
    trials = inner.groupBy("fold_year", "policy", "alpha").agg(F.avg("__v").alias("inner_value"), F.count("__v").alias("__years")).filter(F.col("__years") == inner_years)
    counts = trials.groupBy("fold_year").agg(F.count("*").alias("trials"))
    best = top_per_group(trials.drop("__years"), ["fold_year"], [F.col("inner_value").desc(), F.col("policy"), F.col("alpha")], 1)
    return best.join(counts, "fold_year").join(yearly.select("policy", "alpha", "fold_year", F.col(metric).alias("outer_value")), ["policy", "alpha", "fold_year"])
