"""Tables in the shared folder, Arrow text buffers and rolling hashes used by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder

#: Drops the shuffle files of a query as soon as that query has been written.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Python worker holds at once; whole texts are wide rows.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of text that array code handles at once; a longer document is a slice of its own.
SLICE_BYTES = 2_000_000
#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATOR = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: A-Z to a-z, all other bytes unchanged.
LOWER = _lower


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder that all executors share and read it again: later jobs do not depend on this one's executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    before = {key: spark.conf.get(key) for key in (SHUFFLE_CLEANUP, ARROW_ROWS)}
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    spark.conf.set(ARROW_ROWS, str(min(2000, int(before[ARROW_ROWS]))))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the n + 1 offsets of its rows; null rows are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[raw]
    fresh = np.empty(len(raw), bool)
    fresh[0] = True
    fresh[1:] = ~inside[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(raw)]] = True
    over = np.empty(len(raw), bool)
    over[-1] = True
    over[:-1] = fresh[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(inside & fresh), np.flatnonzero(inside & over) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Powers of a rolling hash are products of one of STRIDE low ones and one high one, so no table grows with a text.
SHIFT = 12
STRIDE = 1 << SHIFT


def _powers(factor: int, n: int) -> np.ndarray:
    found = np.full(n, np.uint64(factor % (1 << 64)))
    found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


class Rolling:
    """Hashes of substrings by prefix sums: sum of T[b] * B^j modulo 2^64, brought back to power 0 by the inverse of B."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) * 2 + 1
        self.table = rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.low_up, self.low_down = _powers(self.base, STRIDE), _powers(self.inverse, STRIDE)
        self.high_down = np.ones(1, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over bytes (through a random table) or over 64-bit symbols."""
        n = len(values)
        high = _powers(pow(self.base, STRIDE, 1 << 64), n // STRIDE + 1)
        up = (high[:, None] * self.low_up[None, :]).ravel()[:n]
        up *= self.table[values] if values.dtype == np.uint8 else values
        out = np.empty(n + 1, np.uint64)
        out[0] = 0
        np.cumsum(up, out=out[1:])
        return out

    def down(self, places: np.ndarray) -> np.ndarray:
        """What brings a sum that starts at each place back to power 0."""
        rows = int(places.max()) // STRIDE + 1 if len(places) else 1
        if len(self.high_down) < rows:
            self.high_down = _powers(pow(self.inverse, STRIDE, 1 << 64), 2 * rows)
        return self.high_down[places >> SHIFT] * self.low_down[places & (STRIDE - 1)]

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefix[ends] - prefix[starts]) * self.down(starts))
