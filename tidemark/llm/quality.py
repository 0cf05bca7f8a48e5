"""Quality classifier (operator 12): histogram gradient-boosted trees over document statistics.

The model is fitted on a bounded sample of labelled rows: statistics are cut into quantile bins, and each node of a tree is split
where the histograms of gradients and curvatures gain most. Trees are complete and flattened into three arrays (statistic, limit,
leaf value), which numpy walks for all rows and all trees at once, level by level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, buffer, slices, stored

#: Labelled rows that a model is fitted on, at most; the rows with the smallest hash of their id.
FIT_ROWS = 20_000
BINS, TREES, DEPTH = 64, 80, 4
STEP, PULL, LEAST_WEIGHT = 0.15, 1.0, 1.0
SHOWN = 0.3

# Classes of bytes whose share of a text is a statistic.
_marks = "!#$%&*|<>{}[]()=_/\\@~^+\"'`-,.;:?0123456789"
_classes = [
    ("upper", range(65, 91)), ("lower", range(97, 123)), ("wide", range(128, 256)), ("digit", range(48, 58)), ("space", [32]), ("break", [10, 13]),
    ("control", [*range(0, 9), 11, 12, *range(14, 32), 127]), ("mark", [b for b in range(33, 127) if not chr(b).isalnum()]),
    ("bang", b"!"), ("bar", b"|"), ("symbol", b"#$%&*@~^+=_"), ("bracket", b"<>{}[]()/\\"), ("comma", b","), ("stop", b".?"), ("vowel", b"aeiouAEIOU"),
]
_class_table = np.zeros((256, len(_classes)))
for _k, (_, _members) in enumerate(_classes):
    _class_table[list(_members), _k] = 1

STATISTICS = [
    "log_bytes", *(f"share_{name}" for name, _ in _classes), "byte_entropy", "log_words", "word_bytes", "distinct_words", "commonest_word", "short_words", "upper_words", "mark_words",
    "log_lines", "line_bytes", "distinct_lines", "commonest_line", "closed_lines", "bar_lines", "words_again",
]
_n_word = STATISTICS.index("log_words")
_closers = tuple(bytes([b]) for b in b".!?:;\"'")


def _word_statistics(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    out = [np.log1p(n)]
    if n:
        own = Counter(words)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        times = np.fromiter(own.values(), np.int64, len(own))
        upper = sum(c for w, c in own.items() if len(w) > 2 and w.isupper())
        marked = sum(c for w, c in own.items() if not w[-1:].isalpha() and w[-1] < 128 and w[-1:] not in b".,;:?")
        out += [float(sizes @ times) / n, len(own) / n, int(times.max()) / n, int(times[sizes <= 3].sum()) / n, upper / n, marked / n]
    else:
        out += [0.0] * 6
    m = len(lines)
    out.append(np.log1p(m))
    if m:
        own = Counter(lines)
        out += [len(text) / m, len(own) / m, max(own.values()) / m, sum(line.rstrip().endswith(_closers) for line in lines) / m, sum(b"|" in line for line in lines) / m]
    else:
        out += [0.0] * 5
    again = sum(map(bytes.__eq__, words[1:], words[:-1])) if n > 1 else 0
    out.append(again / max(1, n - 1))
    return out


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; all zeros for an empty one."""
    rows = len(offsets) - 1
    histogram = np.zeros((rows, 256))
    out = np.zeros((rows, len(STATISTICS)))
    at = offsets.tolist()
    for i in range(rows):
        for a in range(at[i], at[i + 1], SLICE_BYTES):
            histogram[i] += np.bincount(raw[a : min(at[i + 1], a + SLICE_BYTES)], minlength=256)
        if at[i + 1] > at[i]:
            out[i, _n_word:] = _word_statistics(raw[at[i] : at[i + 1]].tobytes())
    size = np.maximum(1, np.diff(offsets))[:, None]
    part = histogram / size
    out[:, 0] = np.log1p(np.diff(offsets))
    out[:, 1 : 1 + len(_classes)] = part @ _class_table
    out[:, _n_word - 1] = -(part * np.log2(np.where(part > 0, part, 1))).sum(1)
    return out


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node k of a level has the children 2k + 1 and 2k + 2; a statistic above its limit goes right."""

    statistic: np.ndarray  # trees x (2^depth - 1)
    limit: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        trees, nodes = self.statistic.shape
        total = np.full(len(x), self.start)
        if trees:
            tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
            node = np.zeros((len(x), trees), np.int64)
            for _ in range(nodes.bit_length()):
                node = 2 * node + 1 + (x[row, self.statistic[tree, node]] > self.limit[tree, node])
            total = total + self.leaf[tree, node - nodes].sum(1)
        return 1 / (1 + np.exp(-total.clip(-40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, step: float = STEP, pull: float = PULL) -> Trees:
    """Boosted trees for a 0/1 label under log loss, by histograms over at most `bins` quantile bins of each statistic."""
    rows, columns = x.shape
    share = (y.sum() + 0.5) / (rows + 1)
    start = float(np.log(share / (1 - share)))
    nodes = 2**depth - 1
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) if rows else np.zeros(0) for k in range(columns)]
    if not rows or not (0 < y.sum() < rows):
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), start)
    # A value above an edge is in a later bin, so "bin > k" and "value > edge k" are the same question.
    binned = np.stack([np.searchsorted(edges[k], x[:, k], "left") for k in range(columns)], 1) + np.arange(columns) * bins
    usable = np.concatenate([np.arange(bins) < len(e) for e in edges]).reshape(columns, bins)
    raw = np.full(rows, start)
    statistic, limit, leaf = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            place = ((node - first)[:, None] * (columns * bins) + binned).ravel()
            g, h = (np.bincount(place, np.repeat(v, columns), width * columns * bins).reshape(width, columns, bins) for v in (gradient, curve))
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + pull) + (all_g - left_g) ** 2 / (all_h - left_h + pull) - all_g**2 / (all_h + pull)
            gain = np.where(usable & (left_h >= LEAST_WEIGHT) & (all_h - left_h >= LEAST_WEIGHT), gain, 0).reshape(width, -1)
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(width), best] > 1e-9):
                column, place_in = divmod(int(best[k]), bins)
                statistic[t, first + k], limit[t, first + k] = column, edges[column][place_in]
            own = statistic[t, node]
            node = 2 * node + 1 + (x[np.arange(rows), own] > limit[t, node])
        own = node - nodes
        sums, curves = (np.bincount(own, v, nodes + 1) for v in (gradient, curve))
        leaf[t] = step * sums / (curves + pull)
        raw = raw + leaf[t, own]
    return Trees(statistic, limit, leaf, start)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def _statistics_of(df: DataFrame, columns: str, finish) -> DataFrame:
    """Rows of `df` (its first column is the text) through `finish(statistics, other columns)`, a slice of texts at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer(batch.column(0))
            for a, b in slices(offsets):
                found = statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield finish(found, [batch.column(k).slice(a, b - a) for k in range(1, batch.num_columns)])

    return df.mapInArrow(work, columns)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Trees from labelled rows that are not held out; at most `rows` of them, the same ones each time.

    The statistics of those rows, a few dozen numbers each, are all that reaches the driver. Null labels and ids teach nothing; a
    repeated label row counts once, 1 only if all are 1. Without labels of both kinds every score is the share of label 1.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def finish(found: np.ndarray, others: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*found], pa.list_(pa.float64())), others[0]], ["x", "y"])

    sample = stored(_statistics_of(texts, "x array<double>, y double", finish), "statistics").orderBy(F.xxhash64("x"), "x", "y").limit(rows).toArrow()
    x = sample["x"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if len(sample) else np.zeros((0, len(STATISTICS)))
    return fit_trees(x, sample["y"].to_numpy() if len(sample) else np.zeros(0))


def scored(docs: DataFrame, model: Trees, key: str = "doc_id") -> DataFrame:
    """Key and score of every row; a null text is empty, and an empty one has all statistics 0."""
    kind = docs.schema[key].dataType.simpleString()

    def finish(found: np.ndarray, others: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([others[0], pa.array(model.score(found))], ["key", "score"])

    rows = docs.select(F.col("text").alias("text"), F.col(key).alias("key"))
    return _statistics_of(rows, f"key {kind}, score double", finish).withColumnRenamed("key", key)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by its text alone. Rows of docs stay as they are, repeated or not."""
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= SHOWN).cast("int").alias("predicted"))
