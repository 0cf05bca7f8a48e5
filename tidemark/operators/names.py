"""Matching listed names to registered companies without inventing aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import issuer_name_key
from tidemark.session import cut_lineage

GRAM = 5
SIMILARITY_GRAM = 3
REVIEW_ROWS = 3
#: Look-ups of a name begin with so many pieces, and a round adds pieces with up to so many times the entries of its rarest.
FIRST_PIECES = 2
FREQUENT = 8
#: Above every code point; three of them fit a bigint.
CODE_POINTS = 1 << 21


def _grams(column: str, size: int):
    """Distinct substrings of a fixed length."""
    text = F.col(column)
    positions = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(
        F.length(text) >= size, F.array_distinct(F.transform(positions, lambda i: F.substr(text, i, F.lit(size))))
    ).otherwise(F.array())


def containment_pairs(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs in which one key is a substring of the other, found through a gram index.

    Each short text is looked up by its rarest gram only, so a gram that most names share does
    not multiply; the substring test then decides. `names` has `name_key`, `entries` has
    `entry_key`, both distinct; only names of at least five letters take part.
    """
    long_names = names.filter(F.length("name_key") >= GRAM)

    def one_way(inner: DataFrame, small: str, outer: DataFrame, big: str) -> DataFrame:
        index = outer.select(big, F.explode(_grams(big, GRAM)).alias("gram"))
        frequency = index.groupBy("gram").agg(F.count("*").alias("hits"))
        probes = inner.filter(F.length(small) >= GRAM).select(small, F.explode(_grams(small, GRAM)).alias("gram"))
        # A gram the index lacks proves that no text contains the probe.
        rated = probes.join(frequency, "gram", "left").groupBy(small).agg(
            F.min_by("gram", F.struct(F.coalesce("hits", F.lit(0)), "gram")).alias("gram")
        )
        return rated.join(index, "gram").filter(F.contains(F.col(big), F.col(small))).select("name_key", "entry_key")

    found = one_way(long_names, "name_key", entries, "entry_key").unionByName(
        one_way(entries, "entry_key", long_names, "name_key")
    )
    short = entries.filter((F.length("entry_key") < GRAM) & (F.length("entry_key") > 0))
    for size in range(1, GRAM):
        pieces = long_names.select("name_key", F.explode(_grams("name_key", size)).alias("entry_key"))
        found = found.unionByName(pieces.join(short.filter(F.length("entry_key") == size), "entry_key", "left_semi").select("name_key", "entry_key"))
    return found.distinct()


def _codes(column: str):
    """Distinct three-letter pieces, each as one number: three code points of 21 bits."""
    text = F.col(column)

    def code(i):
        letters = [F.ascii(F.substr(text, i + k, F.lit(1))).cast("bigint") for k in range(SIMILARITY_GRAM)]
        return reduce(lambda high, low: high * CODE_POINTS + low, letters)

    positions = F.sequence(F.lit(1), F.length(text) - SIMILARITY_GRAM + 1)
    return F.when(F.length(text) >= SIMILARITY_GRAM, F.array_distinct(F.transform(positions, code))).otherwise(F.array().cast("array<bigint>"))


def _any_of(pieces: str, most: int):
    """Whether an entry has one of at most so many pieces; a few are compared one by one, without a hash set for each pair."""
    if most > 2 * FIRST_PIECES:
        return F.arrays_overlap("entry_codes", pieces)
    each = [F.coalesce(F.array_contains("entry_codes", F.get(pieces, F.lit(j))), F.lit(False)) for j in range(most)]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def nearest_entries(names: DataFrame, entries: DataFrame, k: int = REVIEW_ROWS) -> DataFrame:
    """For each name the k entries with the largest share of common three-letter pieces (Dice, four decimals).

    `names`: name_key. `entries`: entry_key, label; both keys distinct and not null. Equal shares are ordered by label, then key,
    both descending; an entry without a common piece never counts. Names look up their rarest pieces, more of them each round. What has
    none of those, or one of them and not the next, shares the remaining pieces at most: such entries are passed over where they are met, and
    a name with k entries above that is done. At last all pieces are looked up, so no candidate is dropped. An entry meets a name at the
    rarest piece they share and is judged there; only what can be among the best is exchanged. Joins are merges: entries never pass the driver.
    """
    right = cut_lineage(entries.select("entry_key", "label", _codes("entry_key").alias("entry_codes")).filter(F.size("entry_codes") > 0))
    index = right.select("entry_key", "label", "entry_codes", F.explode("entry_codes").alias("gram"))
    frequency = index.groupBy("gram").agg(F.count("*").alias("hits"), F.min(F.size("entry_codes")).alias("smallest"))
    left = names.select("name_key", _codes("name_key").alias("name_codes"))
    # A piece that no entry has is never looked up and cannot be shared.
    known = left.select("name_key", F.explode("name_codes").alias("gram")).join(frequency.hint("merge"), "gram")
    pieces = known.groupBy("name_key").agg(
        F.sort_array(F.collect_list(F.struct("hits", "gram"))).alias("pieces"), F.min("smallest").alias("smallest")
    )
    waiting = cut_lineage(left.join(pieces.hint("merge"), "name_key").withColumn("done", F.lit(0)))
    order = Window.partitionBy("name_key").orderBy(F.col("similarity").desc(), F.col("label").desc(), F.col("entry_key").desc())
    found: list[DataFrame] = []
    width, most = FIRST_PIECES, 0
    while not waiting.isEmpty():
        # A round adds no piece that is far more frequent than the first it adds: what that one finds may settle the name.
        offered = F.slice("pieces", F.col("done") + 1, F.lit(width))
        added = F.size(F.filter(offered, lambda p: p["hits"] <= FREQUENT * F.element_at(offered, 1)["hits"]))
        rest = F.size("pieces") - F.col("done")
        # An entry with that many pieces of the name has as many at least, and no fewer than the smallest entry with one of them.
        limit = F.round(2.0 * F.col("rest") / (F.size("name_codes") + F.greatest("rest", "smallest")), 4)
        limit = F.when(F.col("rest") > 0, limit).otherwise(-1.0)
        waiting = waiting.withColumn("done", F.col("done") + added).withColumn("rest", rest).withColumn("limit", limit)
        grams = F.col("pieces")["gram"]
        probes = waiting.select("name_key", "name_codes", "rest", "limit", "done", grams.alias("grams"), F.posexplode(F.slice(grams, F.lit(1), F.col("done"))).alias("i", "gram"))
        probes = probes.select(
            "name_key", "name_codes", "rest", "limit", "gram",
            F.slice("grams", F.lit(1), F.col("i")).alias("rarer"),
            F.slice("grams", F.col("i") + 2, F.col("done") - F.col("i")).alias("next"),
        )
        asked = index.join(F.broadcast(probes.select("gram").distinct()), "gram", "left_semi")  # numbers of pieces only
        most += width
        shared = F.size(F.array_intersect("name_codes", "entry_codes"))
        share = F.round(2.0 * shared / (F.size("name_codes") + F.size("entry_codes")), 4)
        # One expression, so that shares are computed only where the quick tests hold, wherever Spark puts the filter.
        judged = F.when(((F.col("rest") == 0) | _any_of("next", most)) & ~_any_of("rarer", most - 1), share)
        met = probes.join(asked.hint("merge"), "gram").select("name_key", "entry_key", "label", "limit", judged.alias("similarity"))
        scored = met.filter(F.col("similarity") > F.col("limit"))
        best = scored.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k)
        best = cut_lineage(best.select("name_key", "entry_key", "label", "similarity"))
        reached = best.groupBy("name_key").agg(F.count("*").alias("n"))
        settled = (F.col("rest") == 0) | (F.coalesce("n", F.lit(0)) == k)
        state = cut_lineage(waiting.join(reached.hint("merge"), "name_key", "left").withColumn("__settled", settled))
        found.append(best.join(state.filter("__settled").select("name_key").hint("merge"), "name_key", "left_semi"))
        waiting = state.filter("NOT __settled").drop("__settled", "n", "rest", "limit")
        width *= 2
    if not found:
        return left.join(right, F.lit(False)).select("name_key", "entry_key", "label", F.lit(0.0).alias("similarity"))
    return reduce(DataFrame.unionByName, found)


def match_names(listed: DataFrame, registry: DataFrame) -> DataFrame:
    """Automatic matches and review rows.

    `listed`: ticker, name. `registry`: issuer_id, registered_name. A name is matched only when
    exactly one entry has the same key, or none has and exactly one contains it or is contained.
    Everything else gets the most similar entries as review rows.
    """
    listed = listed.withColumn("name_key", issuer_name_key(F.col("name")))
    registry = registry.withColumn("entry_key", issuer_name_key(F.col("registered_name")))
    names = listed.select("name_key").distinct()
    entry_sizes = registry.groupBy("entry_key").agg(
        F.count("*").alias("entries"), F.min_by("issuer_id", "registered_name").alias("issuer_id"), F.min("registered_name").alias("registered_name")
    )
    keys = entry_sizes.select("entry_key")
    exact = entry_sizes.select(F.col("entry_key").alias("name_key"), F.col("entries").alias("exact"), F.col("issuer_id").alias("exact_id"))
    contained = containment_pairs(names, keys).join(entry_sizes, "entry_key").groupBy("name_key").agg(
        F.sum("entries").alias("contained"), F.min("issuer_id").alias("contained_id")
    )
    state = (
        names.join(exact, "name_key", "left")
        .join(contained, "name_key", "left")
        .na.fill(0, ["exact", "contained"])
        .withColumn(
            "match_type",
            F.when((F.col("name_key") != "") & (F.col("exact") == 1), "exact_name")
            .when((F.col("name_key") != "") & (F.col("exact") == 0) & (F.col("contained") == 1), "unique_name_containment"),
        )
    )
    matched = state.filter("match_type IS NOT NULL").select(
        "name_key",
        F.when(F.col("match_type") == "exact_name", F.col("exact_id")).otherwise(F.col("contained_id")).alias("issuer_id"),
        "match_type",
        F.lit("auto_added").alias("status"),
        F.lit(1).cast("bigint").alias("place"),
    )
    open_names = state.filter("match_type IS NULL").select(
        "name_key",
        F.when((F.col("exact") > 0) | (F.col("contained") > 1), "ambiguous").otherwise("review_required").alias("status"),
    )
    labelled = registry.groupBy("entry_key").agg(F.max("registered_name").alias("label"))
    # An entry outside a name's best REVIEW_ROWS has as many rows before it, so its own rows are never needed.
    candidates = nearest_entries(open_names.select("name_key"), labelled).join(
        registry.select("entry_key", "issuer_id", "registered_name"), "entry_key"
    )
    w = Window.partitionBy("name_key").orderBy(F.col("similarity").desc(), F.col("registered_name").desc())
    ranked = candidates.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= REVIEW_ROWS)
    review = open_names.join(ranked, "name_key", "left").select(
        "name_key",
        "issuer_id",
        F.when(F.col("place").isNull(), "no_candidate").otherwise("name_similarity").alias("match_type"),
        F.when(F.col("place").isNull(), "unresolved").otherwise(F.col("status")).alias("status"),
        "place",
        "similarity",
    )
    outcome = matched.unionByName(review, allowMissingColumns=True)
    return listed.select("ticker", "name", "name_key").join(outcome, "name_key")


def latest_label(df: DataFrame, entity: str, label: str, clock: str) -> DataFrame:
    """Most recent, then most frequent, label of each entity with its first and last sighting."""
    seen = df.groupBy(entity, label).agg(
        F.min(clock).alias("first_seen"), F.max(clock).alias("last_seen"), F.count("*").alias("sightings")
    )
    w = Window.partitionBy(entity).orderBy(F.col("last_seen").desc(), F.col("sightings").desc(), F.col(label))
    return seen.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def precedence_merge(*sources: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows of the first source that knows a key; later sources only add unknown keys."""
    merged = sources[0]
    for source in sources[1:]:
        fresh = source.join(merged.select(key).distinct(), key, "left_anti")
        merged = merged.unionByName(fresh, allowMissingColumns=True)
    return merged


def distinct_latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Distinct on a natural key with a stated choice of the row that stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
