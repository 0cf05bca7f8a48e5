"""Fill-in-middle transformation (operator 11): a secondary sort puts the chunks of each document into output order.

Every text is cut into units and, at two points that a hash of its id names, into prefix, middle and suffix. Chunks of whole units
are dealt out by document and sorted within partitions by (document, output position), which is the DataFrame form of
`repartitionAndSortWithinPartitions`: Spark's sorter spills, and a task streams the chunks into incremental digests without ever
holding a document. The chunks that leave that stream carry the place which the output's own marks give them in the text;
sorting them once more within the same partitions, without a shuffle, restores the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffer, slices, stored

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents with a form by chance: from PLAIN_FROM on plain; of the others, below SPM_BELOW suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of a chunk; a longer unit is a chunk of its own.
CHUNK = 16_384
#: Bytes that are searched for a unit at once.
BLOCK = 1 << 16
#: Places of the parts in a restored text, and of the row that ends a document.
PART = 1 << 40
LAST = 1 << 60

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_continues = (np.arange(256) & 0xC0) == 0x80

ROW = "doc_id {kind}, tie long, part int, seq long, pos long, form string, n long, prefix_chars long, middle_chars long, chunk binary"
NAMES = ["doc_id", "tie", "part", "seq", "pos", "form", "n", "prefix_chars", "middle_chars", "chunk"]


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a unit (a run of A-Z and a-z, or any other single code point) starts at each byte; rows are apart."""
    letter = _letter[raw]
    fresh = ~letter & ~_continues[raw]
    fresh[1:] |= letter[1:] & ~letter[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    fresh[begins] = True
    return fresh


def place_of(fresh: np.ndarray, unit: int) -> int:
    """The byte at which the unit with this number starts; the length if there is none."""
    for a in range(0, len(fresh), BLOCK):
        own = fresh[a : a + BLOCK]
        here = int(np.count_nonzero(own))
        if unit < here:
            return a + int(np.flatnonzero(own)[unit])
        unit -= here
    return len(fresh)


def chunk_ends(fresh: np.ndarray, begin: int, end: int, most: int) -> list[int]:
    """Ends of chunks of whole units between two places, each at most `most` bytes unless one unit is longer."""
    ends, at = [], begin
    while end - at > most:
        window = np.flatnonzero(fresh[at + 1 : at + most + 1])
        if len(window):
            at += 1 + int(window[-1])
        else:
            further = place_of(fresh[at + most + 1 : end], 0)
            at = min(end, at + most + 1 + further)
        ends.append(at)
    if at < end:
        ends.append(end)
    return ends


def draws(doc_id, seed: int) -> list[int]:
    """Four 32-bit numbers of a document; a null id counts as the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def layout(text: bytes, fresh: np.ndarray, doc_id, seed: int) -> tuple[str, int, int, int]:
    """Form, number of units, end of the prefix and end of the middle (bytes)."""
    n = int(np.count_nonzero(fresh))
    first, second, third, fourth = draws(doc_id, seed)
    if not text or third % 100 >= PLAIN_FROM or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain", n, 0, 0
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return ("spm" if fourth % 100 < SPM_BELOW else "psm"), n, place_of(fresh, low), place_of(fresh, high)


def infill_chunks(docs: DataFrame, seed: int = 1, chunk: int = CHUNK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chunks of the transformed texts, in order within partitions: one row per chunk with its document and output position.

    Null texts are empty and give one empty chunk. Rows stay apart by content, by the number of their task and by their place
    in it, so repeated ids and repeated rows are transformed one by one; a task that is run again deals the same chunks
    to the same partitions, since the place within a task takes no part in that.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            keys, ties, parts = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for a, b in slices(offsets):
                here = offsets[a : b + 1] - offsets[a]
                own = raw[offsets[a] : offsets[b]]
                fresh = unit_starts(own, here)
                rows: list[tuple] = []
                for i in range(b - a):
                    low, high = int(here[i]), int(here[i + 1])
                    whole, starts = own[low:high].tobytes(), fresh[low:high]
                    form, n, x, y = layout(whole, starts, keys[a + i], seed)
                    if form == "plain":
                        order = [(b"", 0, len(whole))]
                        counts = (None, None)
                    else:
                        regions = {PREFIX: (0, x), MIDDLE: (x, y), SUFFIX: (y, len(whole))}
                        order = [(mark, *regions[mark]) for mark in ((PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE))]
                        counts = tuple(int(np.count_nonzero(~_continues[own[low + p : low + q]])) for p, q in ((0, x), (x, y)))
                    pos = 0
                    for mark, p, q in order:
                        for end in chunk_ends(starts, p, q, chunk) or [p]:
                            rows.append((keys[a + i], ties[a + i], parts[a + i], seq, pos, form, n, *counts, mark + whole[p:end]))
                            p, mark, pos = end, b"", pos + 1
                    seq += 1
                yield _batch(rows, batch.column(0).type)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.spark_partition_id().alias("part"))
    chunks = rows.mapInArrow(cut, ROW.format(kind=kind))
    return chunks.repartition("doc_id", "tie", "part").sortWithinPartitions("doc_id", "tie", "part", "seq", "pos")


_types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *_types], strict=True)], NAMES)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(name).to_pylist() for name in NAMES), strict=True)


class Unfolding:
    """Reads an output chunk by chunk and says where each piece of it belongs in the text, by the output's marks and form alone.

    A mark opens a chunk and never goes over two, as `infill_chunks` writes them.
    """

    #: Which part of the text follows each mark.
    place = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

    def __init__(self, form: str):
        self.marks = {"psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}.get(form, [])
        self.region = self.count = 0

    def pieces(self, chunk: bytes) -> Iterator[tuple[int, bytes]]:
        while self.marks and (at := chunk.find(self.marks[0])) >= 0:
            if at:
                yield self.region * PART + self.count, chunk[:at]
                self.count += 1
            mark = self.marks.pop(0)
            self.region, chunk = self.place[mark], chunk[at + len(mark) :]
        if chunk:
            yield self.region * PART + self.count, chunk
            self.count += 1


def unfolded(chunks: DataFrame) -> DataFrame:
    """Digest of each output, and its pieces with their places in the text, sorted within partitions: the texts again, in order.

    The last row of a document holds the output's digest instead of a piece.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, parser, tail = None, None, None, None
        kind = pa.int64()
        for batch in batches:
            kind, out = batch.column(0).type, []
            for row in _rows(batch):
                if row[:4] != now:
                    if now is not None:
                        out.append((*now, LAST, *tail, digest.digest()))
                    now, tail, digest, parser = row[:4], row[5:9], hashlib.sha256(), Unfolding(row[5])
                digest.update(row[9])
                out.extend((*now, place, *tail, piece) for place, piece in parser.pieces(row[9]))
            yield _batch(out, kind)
        if now is not None:
            yield _batch([(*now, LAST, *tail, digest.digest())], kind)

    return chunks.mapInArrow(work, chunks.schema).sortWithinPartitions("doc_id", "tie", "part", "seq", "pos")


def infill_digests(docs: DataFrame, seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """One row per document: units, form, sizes of prefix and middle, digest of the output and of the text restored from it."""
    pieces = unfolded(infill_chunks(docs, seed, chunk))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            out = []
            for row in _rows(batch):
                if row[4] < LAST:
                    digest.update(row[9])
                else:
                    out.append((row[0], row[6], row[5], row[7], row[8], row[9].hex(), digest.hexdigest()))
                    digest = hashlib.sha256()
            columns = [*zip(*out, strict=True)] if out else [()] * 7
            types = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return stored(pieces.mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"), "infill")


def infill_texts(docs: DataFrame, seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """doc_id, form and the whole transformed text of every document, for writers that want one row a document."""
    chunks = infill_chunks(docs, seed, chunk)
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, form, held = None, None, []

        def finished(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((key, pa.string(), pa.string()))], ["doc_id", "form", "output"])

        key = pa.int64()
        for batch in batches:
            key, out = batch.column(0).type, []
            for row in _rows(batch):
                if row[:4] != now:
                    if now is not None:
                        out.append((now[0], form, b"".join(held).decode()))
                    now, form, held = row[:4], row[5], []
                held.append(row[9])
            yield finished(out, key)
        if now is not None:
            yield finished([(now[0], form, b"".join(held).decode())], key)

    return chunks.mapInArrow(work, f"doc_id {kind}, form string, output string")


#: The same rows from whole texts. Units are listed one by one there, so it is meant for small tables.
SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n,
         CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix
  FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
