"""Benchmark decontamination (operator 1): windows of typed templates, joined by hash, then slot consistency.

Numbers, names and units become placeholders, so a question whose parameters were changed still has the template windows
of the original. A pair of document and item counts as a leak if enough of the item is covered and the parameters were
replaced consistently. Every window is also looked for word by word, so an exact copy is found whatever its words are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, Rolling, buffer, mixed, slices, stored, words

#: Words of a window; an item with fewer is one window of its own length, with fewer than LEAST_WORDS it never matches.
WINDOW = 8
LEAST_WORDS = 3
#: Words of a template window that must be literal: more than half of it. Windows with more placeholders match word by word only.
LITERAL = 0.5
#: Least share of the item's words under matched windows, and of its parameters that are replaced by one value each.
COVERED = 0.5
CONSISTENT = 0.5
#: Benchmark windows that one pass over the documents looks for; more take further passes.
WINDOWS_PER_PASS = 2_000_000
SLICE = 1_000_000
UNITS = "kg g mg km m cm mm mi ft in lb oz l ml s sec min h hr hours minutes seconds days weeks months years euro euros dollar dollars cents usd eur percent degrees mph kmh kwh mb gb tb stunden tage jahre heures jours ans horas días años".split()

_rolling, _window_hash, _literal_hash = Rolling(101), Rolling(202), Rolling(303)
NUM, NAME, UNIT = (mixed(np.array([k], np.uint64))[0] for k in (11, 12, 13))
#: Kinds of windows: a template, one whose first word is taken as no name or unit, the words themselves.
TYPED, LED, LITERALLY = range(3)
_digit = np.isin(np.arange(256), np.arange(48, 58))
_word_byte = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_rolling.between(_rolling.prefix(raw), np.array([0]), np.array([len(raw)]))[0])


_units = np.array(sorted(map(_hash_of, UNITS)), np.uint64)


def _marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Bytes of the curly quote, dash or other mark outside ASCII that starts at each byte, and of the one that ends there; whether there is any."""
    long, short = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    long[:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x80)
    short[:-1] = (raw[:-1] == 0xC2) & np.isin(raw[1:], [0xA1, 0xAB, 0xBB, 0xBF])
    starting = long * np.int8(3) + short * np.int8(2)
    ending = np.zeros(len(raw), np.int8)
    ending[2:] += long[:-2] * np.int8(3)
    ending[1:] += short[:-1] * np.int8(2)
    return starting, ending, bool(starting.any())


def templates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each word: its symbol (hash of the trimmed lower-case word, or a placeholder), whether it is one, and its trimmed bounds; then each row's first word, each word's literal symbol, and its symbol and whether it is a placeholder as a window's first word."""
    starts, ends, first = words(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, bool), starts, ends, first, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    low = LOWER[raw]
    accented = np.zeros(len(raw), bool)  # capital Latin letters of two bytes
    accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low[accented] += 0x20
    begin, end = starts.copy(), ends.copy()
    mark, mark_end, quoted = _marks(raw)
    for _ in range(4):
        begin += (begin < end) & ~_word_byte[raw[np.minimum(begin, len(raw) - 1)]]
        end -= (begin < end) & ~_word_byte[raw[end - 1]]
        if quoted:
            at, last = np.minimum(begin, len(raw) - 1), end - 1
            begin += np.where(begin + mark[at] <= end, mark[at], 0)
            end -= np.where(begin + mark_end[last] <= end, mark_end[last], 0)
    sums = _rolling.prefix(low)
    symbol = _rolling.between(sums, begin, end)
    bare = begin >= end  # marks alone, which are told apart in literal windows only
    literal = symbol.copy()
    literal[bare] = _rolling.between(sums, starts[bare], ends[bare])
    digits = np.concatenate([[0], np.cumsum(_digit[raw])])
    number = digits[ends] > digits[starts]
    unit = np.zeros(len(starts), bool)
    unit[1:] = np.isin(symbol[1:], _units) & number[:-1]
    unit[first[:-1][first[:-1] < len(starts)]] = False
    capital = np.zeros(len(starts), bool)
    inside = begin < end
    at = np.minimum(begin, len(raw) - 1)
    capital[inside] = ((raw[at] >= 65) & (raw[at] <= 90) | np.append(accented[1:], False)[at])[inside]
    # A capital at the start of a sentence, a line or a text says nothing.
    line = np.concatenate([[0], np.cumsum(raw == 10)])
    opening = np.ones(len(starts), bool)
    opening[1:] = np.isin(raw[ends[:-1] - 1], np.frombuffer(b".!?:", np.uint8)) | (line[starts[1:]] > line[ends[:-1]])
    opening[first[:-1][first[:-1] < len(starts)]] = True
    name = capital & ~opening & ~number
    # What comes before a window is not the same in an item and in a text, so its first word is also taken as no name or unit.
    leading = symbol.copy()
    symbol[number], symbol[unit], symbol[name] = NUM, UNIT, NAME
    leading[number] = NUM
    return symbol, number | unit | name, begin, end, first, literal, leading, number


def windows(raw: np.ndarray, offsets: np.ndarray, size: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Hash, first word, row and kind of every window of `size` words, with what templates() found; only hashes in `wanted`, if given.

    A window has a template hash, if enough of its words are literal, a second one if its first word is a name or unit only by
    what comes before it, and in any case a hash of its words as they are.
    """
    found = symbol, slot, _, _, first, literal, leading, number = templates(raw, offsets)
    n = len(symbol)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), found
    at = np.arange(n - size + 1)
    slots = np.concatenate([[0], np.cumsum(slot)])
    row = np.searchsorted(first, at, "right") - 1
    inside = first[row + 1] >= at + size
    sums, many = _window_hash.prefix(symbol), slots[at + size] - slots[at]
    kinds = [(at, _window_hash.between(sums, at, at + size), inside & (many < size * (1 - LITERAL)), TYPED)]
    led = np.flatnonzero(inside & slot[at] & ~number[at] & (many - 1 < size * (1 - LITERAL)))
    kinds.append((led, mixed((sums[led + size] - sums[led]) * _window_hash.down(led) + leading[led] - symbol[led]), np.ones(len(led), bool), LED))
    kinds.append((at, _literal_hash.between(_literal_hash.prefix(literal), at, at + size), inside, LITERALLY))
    kept = []
    for own, hashes, usable, kind in kinds:
        if wanted is not None:
            usable = usable & _among(hashes, wanted)
        kept.append((hashes[usable], own[usable], row[own[usable]], np.full(int(usable.sum()), kind)))
    return *map(np.concatenate, zip(*kept, strict=True)), found


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(hashes), bool)
    return wanted[np.searchsorted(wanted, hashes).clip(0, len(wanted) - 1)] == hashes


def _slot_values(raw: np.ndarray, at: int, size: int, kind: int, found: tuple) -> list[str]:
    _, slot, begin, end, *_ = found
    return [raw[begin[k] : end[k]].tobytes().decode(errors="replace") for k in range(at + (kind == LED), at + size) if slot[k]]


WINDOW_ROWS = "part long, pos int, hash long, literal boolean, slots array<string>"


def _window_rows(table: DataFrame, key: str, size: int, wanted: np.ndarray | None, shorter: bool = False) -> DataFrame:
    """Windows of a table as rows (key, part, pos, hash, literal, slots), part being a hash of the row's whole text; only hashes in `wanted`, if given. shorter: only texts of exactly `size` words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            for a, b in slices(offsets, SLICE):
                part = raw[offsets[a] : offsets[b]]
                hashes, at, row, kinds, found = windows(part, offsets[a : b + 1] - offsets[a], size, wanted)
                first = found[4]
                if shorter:
                    keep = (first[row + 1] - first[row]) == size
                    hashes, at, row, kinds = hashes[keep], at[keep], row[keep], kinds[keep]
                own, which = np.unique(row, return_inverse=True)
                texts = [part[x:y].tobytes() for x, y in zip((offsets[own + a] - offsets[a]).tolist(), (offsets[own + a + 1] - offsets[a]).tolist(), strict=True)]
                texts = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts], np.int64)[which]
                slots = pa.array([_slot_values(part, x, size, k, found) for x, k in zip(at.tolist(), kinds.tolist(), strict=True)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(texts), pa.array((at - first[row]).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(kinds == LITERALLY), slots], ["key", "part", "pos", "hash", "literal", "slots"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(F.col(key).alias("key"), "text").mapInArrow(work, f"key {kind}, {WINDOW_ROWS}")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks: doc_id, item_id, windows, coverage, slots, consistency.

    A row for each pair with an occurrence whose matched windows cover at least COVERED of the item's words with at least
    CONSISTENT of its parameters replaced by one value each; of several, the one that covers most. An occurrence is a set
    of windows of one row whose places in the document and in the item differ by equally much, or, as words may have been
    put in or left out, by a run of amounts less than the item's length apart. Such runs are cut in two ways, half a
    length apart, so that a cut through an occurrence in one is none in the other. All windows of the pair together are
    judged as well: parts of an item can stand apart. An item of fewer than LEAST_WORDS words is found where it is a whole text.
    Null texts have no words. Rows with one doc_id count together, repeated items once, and each of several texts of one
    item_id is judged by itself. Very long texts are read a slice at a time. Other columns are not read. An empty documents or
    benchmark table gives no rows.
    """
    listed = F.expr(r"filter(split(lower(text), '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    # Each distinct text of an item is judged by its own words.
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct().select(F.struct("item_id", F.size(listed).alias("n_words")).alias("item"), "text")
    lengths = sorted({r["n"] for r in items.select(F.least("item.n_words", F.lit(WINDOW)).alias("n")).distinct().collect()})  # at most WINDOW
    hits = None
    for size in [n for n in lengths if n >= LEAST_WORDS]:
        own = stored(_window_rows(items, "item", size, None, shorter=size < WINDOW).withColumnsRenamed({"key": "item", "part": "item_part"}), f"windows{size}")
        n = own.count()
        passes = max(1, -(-n // WINDOWS_PER_PASS))
        for p in range(passes):
            some = own.where(F.pmod(F.col("hash"), F.lit(passes)) == p)
            wanted = np.unique(np.array([r[0] for r in some.select("hash").distinct().collect()], np.int64).view(np.uint64))
            found = _window_rows(docs, "doc_id", size, wanted).withColumnRenamed("key", "doc_id")
            # In a literal match all values are the item's own.
            matched = found.alias("d").join(some.distinct().alias("b"), ["hash", "literal"]).select(
                "doc_id", "item", "item_part", F.lit(size).alias("size"), F.col("b.pos").alias("pos"), F.col("d.part").alias("part"), (F.col("d.pos") - F.col("b.pos")).alias("shift"),
                F.expr("zip_with(b.slots, if(literal, b.slots, d.slots), (x, y) -> struct(x as item_value, y as doc_value))").alias("slots"),
            )
            hits = matched if hits is None else hits.unionByName(matched)
    if hits is None:
        hits = docs.select("doc_id").join(items.select("item"), F.lit(False)).select("doc_id", "item", F.lit(0).cast("long").alias("item_part"), F.lit(0).alias("size"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("shift"), F.expr("cast(array() as array<struct<item_value:string,doc_value:string>>)").alias("slots"))
    place = F.expr("""explode(array(
        struct(0 as way, part, cast(shift as long) as run), struct(1 as way, part, floor(shift / item.n_words) as run),
        struct(2 as way, part, floor((shift + item.n_words / 2) / item.n_words) as run), struct(3 as way, 0L as part, 0L as run)))""")
    grouped = hits.withColumn("place", place).groupBy("doc_id", F.col("item.item_id").alias("item_id"), F.col("item.n_words").alias("n_words"), "item_part", "place").agg(
        F.collect_set(F.struct("size", "pos")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    covered = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["pos"], w["pos"] + w["size"] - 1))))
    parameters = F.size(F.array_distinct(F.transform("slots", lambda s: s["item_value"])))
    # Copying a value unchanged and replacing it by one other value are both consistent; several values for one aren't.
    judged = grouped.select(
        "doc_id", "item_id", F.size("windows").cast("long").alias("windows"), F.least(F.lit(1.0), F.size(covered) / F.col("n_words")).alias("coverage"), F.size("slots").alias("slots"),
        F.when(F.size("slots") > 0, parameters / F.size("slots")).otherwise(1.0).alias("consistency"),
    )
    judged = judged.where((F.col("coverage") >= COVERED) & (F.col("consistency") >= CONSISTENT))
    if any(0 < n < LEAST_WORDS for n in lengths):
        # A word or two is a leak only where it is the whole text.
        few = items.where(F.col("item.n_words").between(1, LEAST_WORDS - 1)).select("item.item_id", listed.alias("listed")).distinct()
        whole = docs.where(F.col("text").rlike(r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++([\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?+[\x20\x09-\x0D]*+$")).select("doc_id", listed.alias("listed"))
        one = F.lit(1.0)
        judged = judged.unionByName(whole.join(few, "listed").select("doc_id", "item_id", F.lit(1).cast("long").alias("windows"), one.alias("coverage"), F.lit(0).alias("slots"), one.alias("consistency")))
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "consistency", "windows", "slots")).alias("best"))
    return best.select("doc_id", "item_id", "best.windows", "best.coverage", "best.slots", "best.consistency")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id has no leak."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__leaked"]), "left_anti")
