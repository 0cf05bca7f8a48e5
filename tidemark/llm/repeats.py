"""Repeated windows across documents: sampling, exchange and removal, shared by the suffix-array and suffix-tree operators.

A window is `length` consecutive symbols (bytes or words) of one document. Each window has an anchor: the run of `anchor`
symbols in it with the smallest hash, the leftmost of equals. Equal windows have equal anchors at equal places, so only
anchors (a few per hundred symbols) are exchanged at first, each with the block of all windows that it owns:

- A block that also stands in an earlier document is covered whole.
- Anchors that stand in several documents within different blocks are edges: only their windows go on to the exact
  comparison, which the operators do by their own methods.

Within a few megabytes equal blocks and windows are compared at once, and only those of the earliest document there are
exchanged, so what a block or window of any frequency sends does not grow with its frequency.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Rolling, buffer, mixed, slices, stored, words
from tidemark.llm.sketch import CountSketch

FULL, EDGE = 0, 1
#: Bytes of text that array code handles at once, and whose anchors are compared before they are exchanged.
SLICE, SETTLED = 500_000, 5_000_000
#: Windows of edges that are compared before they are exchanged.
WINDOWS = 200_000
_anchor_hash, _block_hash, _word_hash = Rolling(505), Rolling(606), Rolling(707)


@dataclass(frozen=True)
class Unit:
    """What a window is made of, and how windows are compared.

    columns(symbols, starts): a matrix of 32-bit numbers whose rows are equal just if the windows are; its first two columns
    identify a window within its document. route(symbols, starts, columns, levels): a hash that equal windows share.
    repeated(columns, ids): 2 for windows that a smaller id has too. prefixes: lengths of prefixes to be counted over all
    positions, for route().
    """

    words: bool
    length: int
    anchor: int
    width: int
    columns: Callable[[np.ndarray, np.ndarray], np.ndarray]
    route: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]
    repeated: Callable[[np.ndarray, np.ndarray], np.ndarray]
    prefixes: tuple[int, ...] = ()


def read(unit: Unit, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Symbols, offsets of documents among them, and the words' byte bounds."""
    if not unit.words:
        return raw, offsets, None, None
    starts, ends, first = words(raw, offsets)
    return _word_hash.between(_word_hash.prefix(raw), starts, ends), first, starts, ends


def anchors(symbols: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """For each anchor that owns windows: its hash, its block's hash, document, first window and number of windows."""
    size, k = unit.length, unit.anchor
    n = len(symbols)
    if n < size:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    place = np.arange(n - k + 1)
    prefix = _anchor_hash.prefix(symbols)
    hashes = _anchor_hash.between(prefix, place, place + k)
    del prefix
    low = ((hashes >> np.uint64(32)) << np.uint64(32)) | place.astype(np.uint64)
    span, run = size - k + 1, 1
    while run < span:
        step = min(run, span - run)
        low = np.minimum(low[: len(low) - step], low[step:])
        run += step
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    document = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(chosen)]
    starts = np.flatnonzero(np.arange(len(chosen)) + size <= at[document + 1])
    chosen, document = chosen[starts], document[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(fresh)
    begin, own = starts[first], chosen[first]
    count = np.diff(np.append(first, len(starts)))
    prefix = _block_hash.prefix(symbols)
    block = _block_hash.between(prefix, begin, begin + count - 1 + size) ^ mixed((own - begin).astype(np.uint64))
    return hashes[own], block, document[first], begin, count


def runs(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    fresh = np.ones(len(columns[0]), bool)
    if len(fresh):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    return fresh


def least_of(fresh: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The smallest value of each run, for each row."""
    first = np.flatnonzero(fresh)
    return np.minimum.reduceat(values, first)[np.cumsum(fresh) - 1] if len(first) else values


def packed_marks(begin: np.ndarray, count: np.ndarray, kind: int) -> np.ndarray:
    return (begin.astype(np.uint64) << np.uint64(16)) | (count.astype(np.uint64) << np.uint64(1)) | np.uint64(kind)


#: kind of exchanged rows: a task's counts of prefixes, marks or hits of documents (their bucket is the document's), and rows to be compared.
COUNTS, FOUND, COMPARED = 0, 1, 2
EXCHANGED = "bucket int, kind int, blob binary"
MARKED = "doc_id long, text_key long, kind int, data binary"


def _record(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])


def _blobs(kind: int, goal: np.ndarray, buckets: int, columns: list[np.ndarray], document: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> list[tuple]:
    """Rows packed by bucket: counts of rows and documents, the documents' ids and keys, each row's document, the columns.

    Rows come sorted by document, and documents are written as steps, which compress to almost nothing.
    """
    order = np.argsort(goal, kind="stable")
    bounds = np.searchsorted(goal[order], np.arange(buckets + 1))
    out = []
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        rows = order[bounds[k] : bounds[k + 1]]
        own = document[rows]
        fresh = runs(own)
        used = own[fresh]
        parts = [np.array([len(rows), len(used)], np.int64), ids[used], keys[used], fresh, *(np.ascontiguousarray(c[rows]) for c in columns)]
        out.append((k, kind, b"".join(p.tobytes() for p in parts)))
    return out


def _found(document: np.ndarray, values: np.ndarray, ids: np.ndarray, keys: np.ndarray, buckets: int) -> list[tuple]:
    """Marks or hits, packed by the bucket of their document."""
    order = np.argsort(document, kind="stable")
    document, values = document[order], values[order]
    goal = (mixed((ids[document] ^ keys[document]).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    return _blobs(FOUND, goal, buckets, [values], document, ids, keys)


def _unpack(blob, kinds: list[tuple[np.dtype, int]]) -> tuple[np.ndarray, ...]:
    """Document ids and keys of each row, then the columns (dtype, width)."""
    data = blob.as_buffer()
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    ids, keys = np.frombuffer(data, np.int64, m, 16), np.frombuffer(data, np.int64, m, 16 + 8 * m)
    local = np.cumsum(np.frombuffer(data, np.bool_, n, 16 + 16 * m)) - 1
    at, columns = 16 + 16 * m + n, []
    for kind, width in kinds:
        columns.append(np.frombuffer(data, kind, n * width, at).reshape((n, width) if width > 1 else (n,)))
        at += n * width * np.dtype(kind).itemsize
    return ids[local], keys[local], *columns


#: An exchanged anchor: 48 bits of its hash, the block's hash, steps of its first window, and count * 2 + whether it is a notice.
ANCHOR_ROW = [(np.uint32, 1), (np.uint16, 1), (np.uint64, 1), (np.uint32, 1), (np.uint8, 1)]


def _anchor_rows(blob) -> tuple[np.ndarray, ...]:
    """Ids, keys, hashes, blocks, first windows, counts and notices."""
    ids, keys, high, low, block, step, count = _unpack(blob, ANCHOR_ROW)
    return ids, keys, high.astype(np.uint64) << np.uint64(16) | low, block, np.cumsum(step, dtype=np.uint32), count >> 1, (count & 1).astype(bool)


def _rest(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.Array]:
    """An exchanged batch's rows that only pass, and the blobs that are to be compared here."""
    here = pa.array(np.asarray(batch.column(1)) == COMPARED)
    return batch.filter(pa.array(~np.asarray(here))), batch.column(2).filter(here)


def _found_rows(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    order = np.lexsort((keys, ids))
    ids, keys, values = ids[order], keys[order], values[order]
    fresh = runs(ids, keys)
    return _found(np.cumsum(fresh) - 1, values, ids[fresh], keys[fresh], buckets)


def gathered(exchanged: DataFrame, buckets: int) -> DataFrame:
    """One row per document with all its marks or hits; counts of prefixes as they are (their part as doc_id)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = []
        names = ["doc_id", "text_key", "kind", "data"]
        for batch in batches:
            for part, kind, blob in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if kind.as_py() == FOUND:
                    pieces.append(_unpack(blob, [(np.uint64, 1)]))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int64()), pa.array([0], pa.int64()), pa.array([COUNTS], pa.int32()), pa.array([blob.as_py()], pa.binary())], names)
        if not pieces:
            return
        ids, keys, values = (np.concatenate(c) for c in zip(*pieces, strict=True))
        order = np.lexsort((keys, ids))
        ids, keys, values = ids[order], keys[order], values[order]
        first = np.flatnonzero(runs(ids, keys))
        last = np.append(first[1:], len(ids))
        for a in range(0, len(first), 5_000):
            some = range(a, min(len(first), a + 5_000))
            data = pa.array([values[first[k] : last[k]].tobytes() for k in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[first[a : a + 5_000]]), pa.array(keys[first[a : a + 5_000]]), pa.array(np.full(len(some), FOUND, np.int32)), data], names)

    return exchanged.repartition(buckets, "bucket").mapInArrow(gather, MARKED)


def find_marks(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """Rows doc_id, text_key, kind, data: the marks (whole blocks and edges) of each document, and counts of prefixes.

    docs: doc_id (not null), text, text_key.
    """

    def settle(found: list[tuple], ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compare the anchors of a few slices among themselves; marks go on as rows, the rest as blobs."""
        h, block, document, begin, count = (np.concatenate(c) for c in zip(*found, strict=True))
        found.clear()
        order = np.lexsort((ids[document], block, h))
        h, block, document, begin, count = (c[order] for c in (h, block, document, begin, count))
        own = ids[document]
        fresh_block, fresh = runs(h, block), runs(h)
        whole = own > least_of(fresh_block, own)
        blocks = np.add.reduceat(fresh_block, np.flatnonzero(fresh), dtype=np.int32)[np.cumsum(fresh) - 1] if len(h) else own
        shared = (blocks > 1) & (-least_of(fresh, -own) > least_of(fresh, own))
        edge = shared & ~whole
        local = np.concatenate([packed_marks(begin[whole], count[whole], FULL), packed_marks(begin[edge], count[edge], EDGE)])
        yield _record(_found(np.concatenate([document[whole], document[edge]]), local, ids, keys, buckets))
        send = np.flatnonzero(~whole & ~shared | shared & fresh)
        send = send[np.lexsort((begin[send], document[send]))]
        h, begin = h[send], begin[send].astype(np.uint32)
        goal = (mixed(h) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(goal, kind="stable")
        step = np.empty(len(begin), np.uint32)  # modulo 2^32, within each bucket
        step[order] = np.diff(begin[order], prepend=np.uint32(0))
        first = order[np.flatnonzero(runs(goal[order]))]
        step[first] = begin[first]
        columns = [(h >> np.uint64(32)).astype(np.uint32), (h >> np.uint64(16)).astype(np.uint16), block[send], step, (count[send] * 2 + shared[send]).astype(np.uint8)]
        yield _record(_blobs(COMPARED, goal, buckets, columns, document[send], ids, keys))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = CountSketch(len(unit.prefixes)) if unit.prefixes else None
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            found, size = [], 0
            for a, b in slices(offsets, SLICE):
                symbols, at, _, _ = read(unit, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h, block, document, begin, count = anchors(symbols, at, unit)
                found.append((h, block, (document + a).astype(np.int32), begin - at[document], count.astype(np.int16)))
                if sketch:
                    prefix = _anchor_hash.prefix(symbols)
                    for row, k in enumerate(unit.prefixes):
                        place = np.arange(max(0, len(symbols) - k + 1))
                        sketch.add(row, _anchor_hash.between(prefix, place, place + k))
                size += int(offsets[b] - offsets[a])
                if size >= SETTLED or b == batch.num_rows:
                    yield from settle(found, ids, keys)
                    size = 0
        if sketch:
            yield _record([(part, COUNTS, data) for part, data in sketch.parts()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = []
        for batch in batches:
            passing, blobs = _rest(batch)
            yield passing
            pieces += [_anchor_rows(b) for b in blobs]
        if not pieces:
            return
        ids, keys, h, block, begin, count, notice = (np.concatenate(c) for c in zip(*pieces, strict=True))
        pieces.clear()
        # Most anchors stand alone; the rest is few enough to be sorted in full.
        order = np.argsort(h, kind="stable")
        alone = np.ones(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        alone[order[1:][same]] = alone[order[:-1][same]] = False
        keep = np.flatnonzero(~alone)
        ids, keys, h, block, begin, count, notice = (c[keep] for c in (ids, keys, h, block, begin, count, notice))
        order = np.lexsort((ids, block, h))
        ids, keys, h, block, begin, count, notice = (c[order] for c in (ids, keys, h, block, begin, count, notice))
        fresh_block, fresh = runs(h, block), runs(h)
        if not len(h):
            return
        group = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        blocks = np.add.reduceat(fresh_block, first)[group]
        noticed = np.logical_or.reduceat(notice, first)[group]
        several = (-least_of(fresh, -ids) > least_of(fresh, ids)) | noticed
        whole = ~notice & (ids > least_of(fresh_block, ids))
        edge = ~notice & ~whole & several & ((blocks > 1) | noticed)
        for chosen, kind in ((whole, FULL), (edge, EDGE)):
            if chosen.any():
                yield _record(_found_rows(ids[chosen], keys[chosen], packed_marks(begin[chosen], count[chosen], kind), buckets))

    spread = docs.select("doc_id", "text", "text_key").mapInArrow(sample, EXCHANGED)
    return gathered(spread.repartition(buckets, "bucket").mapInArrow(meet, EXCHANGED), buckets)


def edge_starts(marks: np.ndarray) -> np.ndarray:
    """First symbols of all windows of the edges among packed marks."""
    some = marks[(marks & np.uint64(1)) == EDGE]
    begin, count = (some >> np.uint64(16)).astype(np.int64), ((some >> np.uint64(1)) & np.uint64(0x7FFF)).astype(np.int64)
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def _window_id(columns: np.ndarray) -> np.ndarray:
    return columns[:, 0].astype(np.uint64) << np.uint64(32) | columns[:, 1]


def find_hits(docs: DataFrame, marks: DataFrame, unit: Unit, levels, buckets: int) -> DataFrame:
    """Rows doc_id, text_key, kind, data: the ids of edge windows that an earlier document has too. marks: one row per document, of which the edges are read."""

    def settle(columns: np.ndarray, goal: np.ndarray, document: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        hit = unit.repeated(columns, ids[document]) == 2
        yield _record(_found(document[hit], _window_id(columns[hit]), ids, keys, buckets))
        yield _record(_blobs(COMPARED, (goal[~hit] % np.uint64(buckets)).astype(np.int32), buckets, [columns[~hit]], document[~hit], ids, keys))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value if levels is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = buffer(batch.column(1))
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            tables, goals, owner, size = [], [], [], 0
            for i in range(batch.num_rows):
                edges = np.unique(np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64))
                starts = edge_starts(edges)
                if len(starts):
                    symbols = read(unit, raw[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])[0]
                    columns = unit.columns(symbols, starts)
                    once = np.unique(_window_id(columns), return_index=True)[1]  # each window of a document once
                    tables.append(columns[once])
                    goals.append(unit.route(symbols, starts[once], columns[once], level))
                    owner.append(np.full(len(tables[-1]), i, np.int32))
                    size += len(owner[-1])
                if tables and (size >= WINDOWS or i == batch.num_rows - 1):
                    yield from settle(np.concatenate(tables), np.concatenate(goals), np.concatenate(owner), ids, keys)
                    tables, goals, owner, size = [], [], [], 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = []
        for batch in batches:
            passing, blobs = _rest(batch)
            yield passing
            pieces += [_unpack(b, [(np.uint32, unit.width)]) for b in blobs]
        if not pieces:
            return
        ids, keys, columns = (np.concatenate(c) for c in zip(*pieces, strict=True))
        pieces.clear()
        hit = unit.repeated(columns, ids) == 2
        if hit.any():
            yield _record(_found_rows(ids[hit], keys[hit], _window_id(columns[hit]), buckets))

    joined = docs.join(marks.select("doc_id", "text_key", "marks"), ["doc_id", "text_key"]).select("doc_id", "text", "text_key", "marks")
    return gathered(joined.mapInArrow(expand, EXCHANGED).repartition(buckets, "bucket").mapInArrow(meet, EXCHANGED), buckets)


def without_repeats(docs: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept (binary: what is left), kept_sha256 of every row.

    A symbol goes if a window over it also starts in a document with a smaller doc_id, judged on the input. Null texts are
    empty. Rows without doc_id have no order: they keep everything and take nothing from others. Rows with equal ids are
    neither smaller; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    known = keyed.where("doc_id is not null")
    found = stored(find_marks(known, unit, buckets), "marks")
    levels = spark.sparkContext.broadcast(CountSketch.levels(found.where(f"kind = {COUNTS}").select(F.col("doc_id").cast("int").alias("part"), F.col("data").alias("counts")), len(unit.prefixes))) if unit.prefixes else None
    marks = found.where(f"kind = {FOUND}").select("doc_id", "text_key", F.col("data").alias("marks"))
    hits = stored(find_hits(known, marks, unit, levels, buckets), "hits").select("doc_id", "text_key", F.col("data").alias("hits"))
    both = marks.join(hits, ["doc_id", "text_key"], "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                symbols, at, starts, ends = read(unit, own, np.array([0, len(own)]))
                n = int(at[-1])
                covered = np.zeros(n, bool)
                if batch.column(2)[i].is_valid:
                    packed = np.unique(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64))
                    full = packed[(packed & np.uint64(1)) == FULL]
                    begin = (full >> np.uint64(16)).astype(np.int64)
                    end = begin + ((full >> np.uint64(1)) & np.uint64(0x7FFF)).astype(np.int64) - 1 + unit.length
                    if batch.column(3)[i].is_valid:
                        own_hits = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                        windows = edge_starts(packed)
                        windows = windows[np.isin(_window_id(unit.columns(symbols, windows)), own_hits)]
                        begin, end = np.append(begin, windows), np.append(end, windows + unit.length)
                    change = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                    covered = np.cumsum(change)[:n] > 0
                if unit.words:
                    kept = b" ".join(own[a:b].tobytes() for a, b in zip(starts[~covered].tolist(), ends[~covered].tolist(), strict=True)) if covered.any() else b" ".join(own.tobytes().split())
                else:
                    kept = own[~covered].tobytes()
                spans = int((covered[1:] & ~covered[:-1]).sum() + covered[:1].sum())
                rows.append((n, int(covered.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_units", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = keyed.join(both, ["doc_id", "text_key"], "left").select("doc_id", "text", "marks", "hits")
    return joined.mapInArrow(remove, "doc_id long, n_units long, n_removed long, n_spans long, kept binary, kept_sha256 string")
