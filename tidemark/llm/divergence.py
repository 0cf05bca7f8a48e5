"""Source divergence audit (operator 13): every two sources of a language compared over the language's terms, by sparse merges.

Terms are counted in one pass; each language's kept terms get dense identifiers, and each (language, source) group becomes sorted
(term identifier, count) arrays, one for each block of identifiers. Groups are dealt into small bins, and the arrays of two bins meet
in one co-grouped task, where every unordered pair is merged: terms that both have, terms of one side, and (once, at the
end) terms that neither has. A task holds two bins of one block, whatever the size of the corpus or of a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buffer, stored

#: Documents of a language that a kept term is in, at least.
LEAST_DOCUMENTS = 10
#: Terms reported of each group.
TOP = 10
SCALE = 1_000_000_000
#: Identifiers of a block, and groups of a bin on average.
BLOCK = 32_768
BIN = 8
#: Entries that a task counts before it hands them on.
HELD = 300_000

_terms = np.full(256, 0x20, np.uint8)
_terms[65:91] = np.arange(97, 123)
_terms[97:123] = np.arange(97, 123)
_terms[128:] = np.arange(128, 256)
#: Bytes of terms, A-Z in lower case; all others become spaces.
TERM_BYTES = _terms.tobytes()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, occurrences and documents, summed as far as one task has seen."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emitted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, documents) in found.items():
                terms = pa.array([*times], pa.binary()).cast(pa.string())
                n = len(terms)
                columns = [pa.array([lang]).take(pa.array(np.zeros(n, np.int32))), pa.array([source]).take(pa.array(np.zeros(n, np.int32))), terms]
                numbers = [pa.array([*times.values()], pa.int64()), pa.array([*map(documents.__getitem__, times)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *numbers], ["lang", "source", "term", "times", "documents"])
            found.clear()

        held = 0
        for batch in batches:
            raw, offsets = buffer(batch.column(2))
            at = offsets.tolist()
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if group not in found:
                    found[group] = (Counter(), Counter())
                times, documents = found[group]
                before = len(times)
                terms = raw[at[i] : at[i + 1]].tobytes().translate(TERM_BYTES).split()
                times.update(terms)
                documents.update(set(terms))
                held += len(times) - before
                if held > HELD:
                    yield from emitted()
                    held = 0
        yield from emitted()

    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return named.mapInArrow(work, "lang string, source string, term string, times long, documents long")


def share(times: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (times + 2) / (total + 2 * terms)) by long division in steps of 1000: exact up to 9e15 occurrences."""
    divisor = total + 2 * terms
    rest, found = times + 2, F.lit(0).cast("long")
    for _ in range(3):
        found = found * 1000 + F.call_function("div", rest * 1000, divisor)
        rest = (rest * 1000) % divisor
    return found + 1


def shares(times: np.ndarray, total: int, terms: int) -> np.ndarray:
    """`share` over an array."""
    divisor = np.int64(total + 2 * terms)
    rest, found = times.astype(np.int64) + 2, np.zeros(len(times), np.int64)
    for _ in range(3):
        found = found * 1000 + rest * 1000 // divisor
        rest = rest * 1000 % divisor
    return found + 1


def price(p, q):
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so nothing overflows."""
    return (p - q) * (p - q) // (p + q)


def merged(a: tuple, b: tuple) -> tuple[int, int]:
    """Price of all terms that either group has in a block, and their number.

    A group is its sorted identifiers, their shares, and the share of a term that it lacks. The longer side is searched for the
    identifiers of the shorter one, each search starting from the last one's bounds.
    """
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (few, p, p0), (many, q, q0) = a, b
    place = np.searchsorted(many, few)
    inside = place < len(many)
    inside[inside] = many[place[inside]] == few[inside]
    alone = np.ones(len(many), bool)
    alone[place[inside]] = False
    total = price(p[inside], q[place[inside]]).sum() + price(p[~inside], q0).sum() + price(p0, q[alone]).sum()
    return int(total), int(len(few) + alone.sum())


PAIR = "lang string, a string, b string, value long, present long"


def block_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """All unordered pairs of two bins' groups in one block."""

    def groups(side: pa.Table) -> list[tuple]:
        out = []
        for row in range(side.num_rows):
            total, terms = side["total"][row].as_py(), side["terms"][row].as_py()
            ids = side["ids"][row].values.to_numpy(zero_copy_only=False).astype(np.int64)
            times = side["times"][row].values.to_numpy(zero_copy_only=False).astype(np.int64)
            absent = int(shares(np.zeros(1, np.int64), total, terms)[0]) if terms else 1
            out.append((side["source"][row].as_py(), (ids, shares(times, total, terms) if len(ids) else times, absent)))
        return out

    rows = []
    if left.num_rows and right.num_rows:
        lang, same = left["lang"][0].as_py(), left["bin_a"][0].as_py() == left["bin_b"][0].as_py()
        others = groups(right)
        for a, own in groups(left):
            for b, other in others:
                if not same or a.encode() < b.encode():
                    rows.append((lang, a, b, *merged(own, other)))
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["lang", "a", "b", "value", "present"])


def kept_terms(counted: DataFrame, least: int) -> DataFrame:
    """lang, term, lang_times, id: each language's terms in enough documents, numbered from 0 in order of their bytes.

    Range partitions sorted inside are written; a term's number is its place in its partition, plus the sizes of the
    partitions before, less the number of the language's first term.
    """
    known = counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("times").alias("lang_times")).where(F.col("documents") >= least)
    placed = stored(known.select("lang", "term", "lang_times").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("place", F.monotonically_increasing_id()), "terms")
    part, inside = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    numbered = placed.withColumn("part", part).join(offsets, "part").withColumn("number", F.col("offset") + inside)
    first = numbered.groupBy("lang").agg(F.min("number").alias("first"))
    return numbered.join(first, "lang").select("lang", "term", "lang_times", (F.col("number") - F.col("first")).alias("id"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK, groups_in_bin: int = BIN) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group's shares are from those of the other sources, and its own terms.

    Null text, lang and source are empty strings; a group of documents without terms still is a group. A language with one
    source has no pairs, one without kept terms has pairs of value 0. Repeated rows and ids are documents like others. An empty table
    gives no rows.
    """
    counted = stored(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("documents").alias("documents")), "counts")
    terms = stored(kept_terms(counted, least), "kept")
    kept = stored(counted.drop("documents").join(terms, ["lang", "term"]), "kept_counts")
    every = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    languages = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_times").alias("lang_total"))
    counts = every.groupBy("lang").agg(F.count("*").alias("n_groups"))
    groups = every.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").join(counts, "lang").na.fill(0, ["total", "terms", "lang_total"])
    bins = F.greatest(F.lit(1), F.ceil(F.col("n_groups") / groups_in_bin)).cast("int")
    groups = stored(groups.withColumn("bins", bins).withColumn("bin", F.pmod(F.xxhash64("source"), F.col("bins")).cast("int")), "groups")

    # Each group in each block of its language, with an empty array where it has no term there.
    places = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.call_function("div", F.col("terms") - 1, F.lit(block))))))
    entries = F.sort_array(F.collect_list(F.struct("id", "times")))
    arrays = kept.groupBy("lang", "source", F.call_function("div", F.col("id"), F.lit(block)).alias("block")).agg(entries.alias("entries"))
    nothing = F.array().cast("array<struct<id:bigint,times:bigint>>")
    sparse = places.join(arrays, ["lang", "source", "block"], "left").withColumn("entries", F.coalesce("entries", nothing))
    sparse = stored(sparse.select("lang", "source", "block", "total", "terms", "bins", "bin", F.col("entries.id").alias("ids"), F.col("entries.times").alias("times")), "sparse")
    columns = ["lang", "block", "source", "total", "terms", "ids", "times"]
    last = F.col("bins") - 1
    left = sparse.select(*columns, F.col("bin").alias("bin_a"), F.explode(F.sequence(F.col("bin"), last)).alias("bin_b"))
    right = sparse.select(*columns, F.explode(F.sequence(F.lit(0), F.col("bin"))).alias("bin_a"), F.col("bin").alias("bin_b"))
    key = ["lang", "block", "bin_a", "bin_b"]
    merges = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(block_pairs, PAIR)
    pairs = merges.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))

    def side(name: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"), "terms" if name == "a" else F.col("terms").alias("b_terms"))

    priced = pairs.join(side("a"), ["lang", "a"]).join(side("b").drop("b_terms"), ["lang", "b"])
    zero = F.lit(0).cast("long")
    p, q = share(zero, F.col("a_total"), F.col("terms")), share(zero, F.col("b_total"), F.col("terms"))
    absent = (F.col("terms") - F.col("present")) * F.call_function("div", (p - q) * (p - q), p + q)
    priced = priced.withColumn("value", F.when(F.col("terms") > 0, F.col("value") + absent).otherwise(zero))
    both = F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a")))))
    pair_rows = priced.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    own = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    p, q = share(F.col("times"), F.col("total"), F.col("terms")), share(F.col("lang_times"), F.col("lang_total"), F.col("terms"))
    own = own.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    term_rows = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return stored(pair_rows.withColumn("rank", F.row_number().over(order)).unionByName(term_rows), "divergence")


#: The same rows by dense tables of all groups and terms; meant for small tables.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), sizes AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM kept GROUP BY lang
), grouped AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM grouped g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), priced AS (
  SELECT e.lang, e.source, e.term, e.n, 1 + (1000000000 * (e.n + 2)) // CAST(e.total + 2 * s.v AS HUGEINT) AS p,
         1 + (1000000000 * (k.n + 2)) // CAST(s.n + 2 * s.v AS HUGEINT) AS q
  FROM dense e JOIN sizes s USING (lang) JOIN kept k USING (lang, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
