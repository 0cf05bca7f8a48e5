"""Packing (operator 5): non-negative least squares over shallow length combinations, then greedy filling of what is left.

Each document becomes whole windows and one shorter rest. Only the histogram of rest lengths (at most `window` numbers)
reaches the driver; the plan made from it is a list of rank ranges per length, bounded by the number of combinations and
of lengths whatever the input's size, and every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buffer, slices, stored
from tidemark.llm.tokens import byte_symbols

WINDOW = 2048
#: Members of a combination at most, and combinations tried per length and depth.
DEPTH = 6
TRIES = 4
STEPS = 300
#: Pieces of a length that are placed one by one at most; more are placed by range.
FEW = 16

#: Letters that normalisation leaves alone but for case, and marks that the vocabulary splits from letters before them.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Words that one generation of a worker's table holds before it becomes the older one.
KEPT = 200_000
#: Words of one call of the library.
TOGETHER = 4000
SLICE = 4_000_000


class Encoder:
    """The library's tokenizer with what this worker has lately encoded, in two generations of bounded size.

    A generation that is full becomes the older one, and words that are seen again move back, so common words stay. Plain
    words (letters, then marks) skip the library's text steps, which would leave them as they are but for case: their letters are
    written as the vocabulary writes bytes, split at spaces, and told apart by their end-of-word tokens. If those don't come out one
    per word, and for all other words, each is encoded alone by the whole library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.plain = tokenizers.Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        self.symbols = {b: s for b, s in enumerate(byte_symbols()) if b != 0x20}
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self.release()

    def release(self) -> None:
        """Forget all words."""
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _keep(self, words: Iterable[bytes], codes: Iterable[bytes]) -> None:
        self.known.update(zip(words, codes, strict=True))

    def alone(self, names: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in names], add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def together(self, names: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(names), TOGETHER):
            some = names[i : i + TOGETHER]
            text = b" ".join(some).decode("latin-1").translate(self.symbols)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.closing[ids]) + 1) * 4
            if len(ends) != len(some):
                out += self.alone(some)
                continue
            coded = ids.tobytes()
            out += [coded[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]
        return out

    def table(self, distinct: set[bytes]) -> dict[bytes, bytes]:
        """A table with the identifiers of these words, little-endian unsigned 32-bit numbers; it holds until the next call.

        Lists of bytes side by side rather than of tuples: those would keep the garbage collector busy.
        """
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = distinct.difference(known)
        again = [*missing.intersection(older)]
        self._keep(again, map(older.__getitem__, again))
        missing.difference_update(again)
        odd, whole, stems, marks = [], [], [], []
        for word in missing:
            letters = word.rstrip(MARKS)
            if letters.isalpha():
                low = letters.lower()
            elif LETTERS.fullmatch(text := letters.decode()):
                low = text.lower().encode()
            else:
                odd.append(word)
                continue
            whole.append(word)
            stems.append(low)
            marks.append(word[len(letters) :])
        for names, encode in ((odd, self.alone), ([*{*marks}.difference(known, [b""])], self.alone), ([*{*stems}.difference(known)], self.together)):
            self._keep(names, encode(names))
        known[b""] = b""
        self._keep(whole, map(bytes.__add__, map(known.__getitem__, stems), map(known.__getitem__, marks)))
        return known


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_bytes(raw: np.ndarray, offsets: np.ndarray, path: str, end_id: int) -> list[bytes]:
    """Identifiers of each row and `end_id` after them, as little-endian unsigned 32-bit numbers.

    For vocabularies that drop white space a text's identifiers are those of its words one after another, so each
    distinct word is encoded once.
    """
    text, at = raw.tobytes(), offsets.tolist()
    split = [text[a:b].split() for a, b in itertools.pairwise(at)]  # of bytes: on the same six separators
    coded = encoder(path).table(set(itertools.chain.from_iterable(split)))
    end = np.array([end_id], "<u4").tobytes()
    return [b"".join(map(coded.__getitem__, words)) + end for words in split]


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Pieces of every document: whole windows, then the rest. `tie` tells texts with one doc_id apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            for a, b in slices(offsets, SLICE):
                ids = token_bytes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path, end_id)
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                parts = -(-counts // window)
                owner = np.repeat(np.arange(b - a), parts)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, counts[owner] - start)
                crc = [zlib.crc32(memoryview(ids[i])[4 * x : 4 * (x + window)]) for i, x in zip(owner.tolist(), start.tolist(), strict=True)]
                key, tie = (batch.column(k).take(pa.array(owner + a)) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([key, tie, *(pa.array(x, pa.int64()) for x in (start, length, crc, counts[owner]))], ["doc_id", "tie", "start", "length", "ids_crc32", "doc_tokens"])
        encoder(path).release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(work, f"doc_id {kind}, tie long, {PIECE}")


def combinations(counts: np.ndarray, window: int, depth: int = DEPTH, tries: int = TRIES) -> np.ndarray:
    """Length combinations that fill a window exactly: all pairs, and for each length some of three to `depth` members.

    The further members of a combination are quantiles of the histogram at low-discrepancy places, so common lengths
    occur in more combinations. Rows are sorted lengths padded with 0.
    """
    lengths = np.flatnonzero(counts)
    found = [np.pad(np.stack([a := lengths[(lengths <= window // 2) & (counts[window - lengths] > 0)], window - a], 1), ((0, 0), (0, depth - 2)))]
    total = np.cumsum(counts[lengths])
    rank = np.arange(len(lengths))
    for members in range(3, depth + 1):
        for t in range(tries):
            rows = [lengths]
            for m in range(members - 2):
                part = np.modf(rank * 0.6180339887 * (m + 1) + rank * 0.4142135623 * m + t / tries + 0.27 * m)[0]
                rows.append(lengths[np.searchsorted(total, part * total[-1], "right").clip(0, len(lengths) - 1)])
            last = window - np.sum(rows, 0)
            good = (last > 0) & (counts[last.clip(0, window)] > 0)
            found.append(np.pad(np.stack([*rows, last], 1)[good], ((0, 0), (0, depth - members))))
    return np.unique(np.sort(np.concatenate(found), 1), axis=0)


def repeats(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares for how often to use each combination: accelerated projected gradient."""
    target = counts.astype(float)
    target[0] = 0
    weight = 1 / np.sqrt(np.maximum(target, 1))
    use = np.bincount(combos.ravel(), minlength=len(counts))
    rate = 1 / max(1e-9, (weight**2 * use)[1:].max() * combos.shape[1])
    x = y = np.zeros(len(combos))
    pull = 1.0
    for _ in range(steps):
        made = np.bincount(combos.ravel(), np.repeat(y, combos.shape[1]), len(counts))
        gap = weight**2 * (made - target)
        gap[0] = 0
        new = np.maximum(0, y - rate * gap[combos].sum(1))
        after = (1 + np.sqrt(1 + 4 * pull * pull)) / 2
        y, x, pull = new + (pull - 1) / after * (new - x), new, after
    return x


def _choice(mask: int, mirror: int, gap: int, window: int, left: np.ndarray) -> int:
    """The length to put into a gap, of those in `mask` (`mirror`: window less each length); 0 if none fits."""
    pair = mask & (mirror >> (window - gap))
    fits = mask & ((1 << (gap + 1)) - 1)
    high = pair.bit_length() - 1
    if mask >> gap & 1:
        return gap
    if high > 0 and (2 * high != gap or left[high] > 1):
        return high
    return max(0, fits.bit_length() - 1)


def _place_many(plan: list[tuple], left: np.ndarray, used: np.ndarray, sequence: int, window: int) -> tuple[int, tuple | None]:
    """Add repeated sequences and runs to the plan until no length has more than FEW pieces; the next sequence, and the piece that the last run cut."""
    loose = left.copy()  # not yet known to fit nothing
    stuck: list[int] = []
    while (loose > FEW).any():
        now, gap, members = loose.copy(), window, []
        mask = sum(1 << int(i) for i in np.flatnonzero(now))
        mirror = sum(1 << (window - int(i)) for i in np.flatnonzero(now))
        while gap and (choice := _choice(mask, mirror, gap, window, now) if members else mask.bit_length() - 1):
            members.append(choice)
            gap -= choice
            now[choice] -= 1
            if not now[choice]:
                mask &= ~(1 << choice)
                mirror &= ~(1 << (window - choice))
        if gap:
            stuck.append(members[0])
            loose[members[0]] = 0
            continue
        own, need = np.unique(members, return_counts=True)
        n, offset = int((loose[own] // need).min()), 0
        for m in members:
            plan.append((m, int(used[m]), int(used[m]) + n, 0, m, sequence, offset))
            used[m] += n
            left[m] -= n
            loose[m] -= n
            offset += m
        sequence += n
    runs = [(m, int(left[m]) - FEW) for m in stuck if left[m] > FEW]
    end = sum(m * n for m, n in runs) // window * window  # what would stand in an unfilled sequence is left
    place, rest = 0, None
    for m, n in runs:
        whole = min(n, (end - place) // m)
        if whole:
            plan.append((m, int(used[m]), int(used[m]) + whole, 0, m, -1 - (sequence + place // window), place % window))
        place += whole * m
        if whole < n and place < end:
            part = end - place
            rank = int(used[m]) + whole
            plan.append((m, rank, rank + 1, 0, part, sequence + place // window, place % window))
            rest, place, whole = (m, rank, part), end, whole + 1
        used[m] += whole
        left[m] -= whole
        if place == end:
            break
    return sequence + end // window, rest


def packing_plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple]:
    """Rows (length, low, high, part_start, part_length, sequence, offset): the piece of rank r, low <= r < high, of that length
    puts its ids from part_start on into sequence + r - low, at the offset. A negative sequence, -1 - s, is a run: pieces
    stand one after another from the offset of sequence s on, cut wherever a sequence is full.

    Whole windows stand alone. Rounded-down repeats of the combinations follow, largest first. What is left is filled
    greedily: a single piece or a pair that fits exactly, else the longest that fits, else the longest one is cut. A
    sequence that needs no cut is repeated as often as its lengths last; of a length that nothing fits, all but FEW
    pieces form a run. So at most FEW pieces of each length are placed one by one. The last, unfilled sequence is cut to
    powers of two, which need no padding.
    """
    plan: list[tuple] = []
    left = np.zeros(window + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    used = np.zeros(window + 1, np.int64)
    sequence = int(left[window])
    if sequence:
        plan.append((window, 0, sequence, 0, window, 0, 0))
        left[window] = 0
    if left.any():
        combos = combinations(left, window)
        if len(combos):
            times = repeats(combos, left)
            for i in np.argsort(-times, kind="stable").tolist():
                members = combos[i][combos[i] > 0]
                own, need = np.unique(members, return_counts=True)
                n = int(min(np.floor(times[i] + 1e-6), (left[own] // need).min()))
                if n < 1:
                    continue
                offset = 0
                for m in members.tolist():
                    low = int(used[m])
                    plan.append((m, low, low + n, 0, m, sequence, offset))
                    used[m] += n
                    left[m] -= n
                    offset += m
                sequence += n
    sequence, rest = _place_many(plan, left, used, sequence, window)
    mask = sum(1 << int(i) for i in np.flatnonzero(left))
    mirror = sum(1 << (window - int(i)) for i in np.flatnonzero(left))

    def take(length: int) -> tuple[int, int]:
        nonlocal mask, mirror
        left[length] -= 1
        used[length] += 1
        if not left[length]:
            mask &= ~(1 << length)
            mirror &= ~(1 << (window - length))
        return length, int(used[length]) - 1

    open_pieces: list[tuple] = []
    while mask or rest:
        open_pieces, gap = [], window
        while gap and (mask or rest):
            if rest:
                (length, rank), begin = rest[:2], rest[2]
                rest = None
            else:
                (length, rank), begin = take(_choice(mask, mirror, gap, window, left) or mask.bit_length() - 1), 0
            part = min(gap, length - begin)
            open_pieces.append((length, rank, begin, part))
            gap -= part
            if begin + part < length:
                rest = (length, rank, begin + part)
        if not gap:
            offset = 0
            for length, rank, begin, part in open_pieces:
                plan.append((length, rank, rank + 1, begin, part, sequence, offset))
                offset += part
            sequence += 1
            open_pieces = []
    size = sum(p[3] for p in open_pieces)
    offset, room = 0, 1 << (size.bit_length() - 1) if size else 0
    for length, rank, begin, part in open_pieces:
        while part:
            now = min(part, room - offset)
            plan.append((length, rank, rank + 1, begin, now, sequence, offset))
            begin, part, offset = begin + now, part - now, offset + now
            if offset == room:
                size -= room
                offset, room, sequence = 0, 1 << (size.bit_length() - 1) if size else 0, sequence + 1
    return plan


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """One row per piece with its sequence and offset; each identifier lies in exactly one piece.

    Null and empty texts are the end identifier alone. Null or repeated doc_ids are packed like others. An empty table
    gives no rows. Ranks are taken per (length, salt), so a length that a third of all pieces share is spread over
    tasks. A document whose piece is cut (at most one piece a sequence) is encoded again for its checksums.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = stored(cut_documents(docs, vocabulary, window, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    plan = spark.createDataFrame(packing_plan(histogram, window), "length long, low long, high long, part_start long, part_length long, sequence long, offset long")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    # The plan has at most DEPTH ranges per combination, a few patterns and one run per length, and FEW single pieces of
    # each length, whatever the input's size; joined by length alone, a common length would be one task.
    found = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.low")) & (F.col("r.rank") < F.col("p.high"))).select(
        "doc_id", "tie", "start", F.col("r.length").alias("length"), "ids_crc32", "doc_tokens", "part_start", "part_length", "sequence", "offset", (F.col("r.rank") - F.col("p.low")).alias("nth"),
    )
    # In a run, a piece that goes over the end of its sequence has a second part at the start of the next.
    place = F.expr(f"""inline(if(sequence >= 0, array(struct(part_start, part_length, sequence + nth as sequence_id, offset)),
        transform(filter(array(0L, 1L), k -> k = 0 or (offset + nth * length) % {window}L + length > {window}L), k -> struct(
            if(k = 0, 0L, {window}L - (offset + nth * length) % {window}L) as part_start,
            if(k = 0, least(length, {window}L - (offset + nth * length) % {window}L), (offset + nth * length) % {window}L + length - {window}L) as part_length,
            -1L - sequence + (offset + nth * length) div {window}L + k as sequence_id,
            if(k = 0, (offset + nth * length) % {window}L, 0L) as offset))))""")
    placed = stored(found.select("doc_id", "tie", "start", "length", "ids_crc32", "doc_tokens", place), "placed")
    whole = F.col("part_length") == F.col("length")
    cut = placed.where(~whole)
    lists = cut.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "ids_crc32", "part_start", "part_length", "sequence_id", "offset")).alias("parts"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    again = texts.join(lists, texts["doc_id"].eqNullSafe(lists["doc_id"]) & (texts["tie"] == lists["tie"])).select(texts["doc_id"], "text", "parts")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                ids = np.frombuffer(token_bytes(raw[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i], vocabulary, end_id)[0], "<u4")
                key = batch.column(0)[i].as_py()
                for p in batch.column(2)[i].as_py():
                    if zlib.crc32(ids[p["start"] : p["start"] + window].tobytes()) == p["ids_crc32"]:
                        begin = p["start"] + p["part_start"]
                        rows.append((key, begin, p["part_length"], zlib.crc32(ids[begin : begin + p["part_length"]].tobytes()), len(ids), p["sequence_id"], p["offset"]))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7))], names)
        encoder(vocabulary).release()

    # A document that stands twice with one text encodes the parts of both; a place in a sequence holds one piece.
    parts = again.mapInArrow(encode, f"doc_id {kind}, {PIECE}, sequence_id long, offset long").dropDuplicates(["sequence_id", "offset"])
    return placed.where(whole).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").unionByName(parts)
