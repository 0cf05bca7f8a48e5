"""Substring dedup (operator 3): prefix-partitioned suffix trees over words.

Suffixes (of 13 words) are dealt out by a prefix whose length varies: 4 words, or 8 or all 13 where the shorter prefix is so
frequent that its group would not fit a task. Each group's subtree is built from its sorted suffixes and the
lengths of their common prefixes; internal nodes 13 words deep are the repeats, their leaves the places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import Rolling, mixed
from tidemark.llm.repeats import Unit, _anchor_hash, least_of, without_repeats
from tidemark.llm.sketch import cell

LENGTH, ANCHOR = 13, 4
PREFIXES = (4, 8)
#: A prefix this many half doublings above the mean is extended.
FREQUENT = 6
_check = Rolling(1010)


def codes(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A check of 64 bits (as two columns), then 32 bits of each word."""
    out = np.empty((len(starts), 2 + LENGTH), np.uint32)
    check = _check.between(_check.prefix(symbols), starts, starts + LENGTH)
    out[:, 0], out[:, 1] = check >> np.uint64(32), check
    for i in range(LENGTH):
        out[:, 2 + i] = symbols[starts + i]
    return out


def prefix_route(symbols: np.ndarray, starts: np.ndarray, columns: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The hash of the shortest prefix that is not frequent, else of the whole suffix."""
    goal = columns[:, 0].astype(np.uint64) << np.uint64(32) | columns[:, 1]
    prefix = _anchor_hash.prefix(symbols)
    for i, k in reversed([*enumerate(PREFIXES)]):
        h = _anchor_hash.between(prefix, starts, starts + k)
        goal = np.where(levels[i][cell(h, i)] < FREQUENT, h, goal)
    return mixed(goal)


def tree_repeats(columns: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """2 for suffixes under a deep node that a smaller id has too, 1 for those of the smallest of several ids, 0 for the others.

    The tree is held as its leaves in order with the depth of the branching between neighbours. Leaves whose branchings
    on both sides are shallow (most of them) hang from no deep node and are never sorted past their prefix.
    """
    found = np.zeros(len(ids), np.int8)
    if not len(ids):
        return found
    prefix = columns[:, 2].astype(np.uint64) << np.uint64(32) | columns[:, 3]
    order = np.argsort(prefix, kind="stable")
    same = prefix[order][1:] == prefix[order][:-1]
    left = order[np.append(same, False) | np.append(False, same)]
    words = columns[left, 2:]
    order = np.lexsort([*(columns[left, i] for i in (1, 0)), *(words[:, i] for i in reversed(range(LENGTH)))])
    left, words = left[order], words[order]
    if not len(left):
        return found
    equal = words[1:] == words[:-1]
    depth = np.where(equal.all(1), LENGTH, np.argmin(equal, 1))
    deep = np.append(False, (depth >= LENGTH) & (columns[left, :2][1:] == columns[left, :2][:-1]).all(1))
    own = ids[left]
    least, most = least_of(~deep, own), -least_of(~deep, -own)
    found[left] = np.where(own > least, 2, np.where(most > least, 1, 0))
    return found


WORDS = Unit(words=True, length=LENGTH, anchor=ANCHOR, width=2 + LENGTH, columns=codes, route=prefix_route, repeated=tree_repeats, prefixes=PREFIXES)


def dedup_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept (words joined by a space, UTF-8) and kept_sha256; see repeats.without_repeats for odd rows."""
    return without_repeats(docs, WORDS).withColumnRenamed("n_units", "n_words")
