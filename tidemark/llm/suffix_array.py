"""Suffix-array dedup (operator 2): depth-limited radix sort of suffixes, by most-significant-digit passes.

Suffixes are ordered no further than their first 50 bytes. The first digit is the suffix's anchor (24 bytes), the second
the block around it; suffixes that stand alone after a digit, or whose whole block repeats, are settled and leave. The few
others are ordered by three further digits of 32 bits, an image of their 50 bytes: equal groups are the repeated windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import Rolling, mixed
from tidemark.llm.repeats import Unit, least_of, runs, without_repeats

LENGTH, ANCHOR, DIGITS = 50, 24, 3
_first, _second = Rolling(808), Rolling(909)


def digits(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Three 32-bit digits of each suffix's first LENGTH bytes: 96 bits of two independent hashes."""
    out = np.empty((len(starts), DIGITS), np.uint32)
    high = _first.between(_first.prefix(symbols), starts, starts + LENGTH)
    out[:, 0], out[:, 1] = high >> np.uint64(32), high
    out[:, 2] = _second.between(_second.prefix(symbols), starts, starts + LENGTH)
    return out


def radix_groups(columns: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """2 for suffixes that a smaller id has too, 1 for those of the smallest of several ids, 0 for the others.

    Each pass sorts what is left by one more digit within its group, and drops suffixes that then stand alone.
    """
    left = np.arange(len(ids))
    group = np.zeros(len(ids), np.int64)
    for d in range(columns.shape[1]):
        order = np.lexsort((columns[left, d], group))
        left, group = left[order], group[order]
        fresh = runs(group, columns[left, d])
        group = np.cumsum(fresh) - 1
        several = np.bincount(group)[group] > 1 if len(group) else fresh
        left, group = left[several], group[several]
    found = np.zeros(len(ids), np.int8)
    if len(left):
        fresh = runs(group)
        own = ids[left]
        least, most = least_of(fresh, own), -least_of(fresh, -own)
        found[left] = np.where(own > least, 2, np.where(most > least, 1, 0))
    return found


BYTES = Unit(words=False, length=LENGTH, anchor=ANCHOR, width=DIGITS, columns=digits, route=lambda symbols, starts, columns, levels: mixed(columns[:, 0].astype(np.uint64)), repeated=radix_groups)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256; see repeats.without_repeats for odd rows."""
    return without_repeats(docs, BYTES).withColumnRenamed("n_units", "n_bytes")
