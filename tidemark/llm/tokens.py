"""Token counts (operator 6): byte-pair merging with a heap and a linked list, counting merges instead of emitting identifiers."""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffer, slices

#: Words whose counts a worker keeps; a full table is emptied, which costs time but changes no count.
KEPT_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if visible, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens of a byte-pair vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((left, right), rank)
        self.symbols = byte_symbols()
        # The library's own text steps, so that normalisation and word boundaries are its own; merging is ours.
        whole = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.byte_level = "ByteLevel" in json.dumps(spec.get("pre_tokenizer"))
        self.counts: dict[str, int] = {}

    def merge_count(self, word: str) -> int:
        """Tokens of one pre-split word: initial symbols minus merges.

        The heap holds adjacent pairs by (rank, position); symbols are a doubly linked list, and a popped pair whose
        symbols have changed meanwhile is stale and skipped. Symbols that the vocabulary lacks are dropped, as the
        library does without an unknown token.
        """
        text = [*word] if self.byte_level else [self.symbols[b] for b in word.encode()]
        if not text:
            return 0
        text[-1] += self.end
        text = [s for s in text if s in self.vocabulary]
        n = len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if text[i] is None or j < 0 or ranks.get((text[i], text[j])) != rank:
                continue
            text[i] += text[j]
            text[j] = None
            after[i] = k = after[j]
            count -= 1
            if k >= 0:
                before[k] = i
                if (r := ranks.get((text[i], text[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return count

    def plain(self, chunk: str) -> int:
        """Tokens of a text without special strings."""
        total = 0
        if chunk.isascii() and chunk.isalpha() and self.end:
            pieces = [chunk.lower()]
        else:
            clean = self.normalizer.normalize_str(chunk) if self.normalizer else chunk
            pieces = [p for p, _ in self.splitter.pre_tokenize_str(clean)] if self.splitter else [clean]
        for piece in pieces:
            found = self.counts.get(piece)
            if found is None:
                if len(self.counts) >= KEPT_WORDS:
                    self.counts.clear()
                found = self.counts[piece] = self.merge_count(piece)
            total += found
        return total

    def count(self, chunk: str) -> int:
        """Tokens of a text; each special string counts as one token, the longest first at each place."""
        if not any(s in chunk for s in self.special):
            return self.plain(chunk)
        pieces = self.special_pattern.split(chunk)
        return sum(map(self.plain, pieces)) + len(pieces) - 1


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter per worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def distinct_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the index of each word of the text among them, and the index of each row's first word."""
    text, at = raw.tobytes(), offsets.tolist()
    split = [text[a:b].split() for a, b in itertools.pairwise(at)]  # of bytes: on the same six separators
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
    every = [*itertools.chain.from_iterable(split)]
    names = [*dict.fromkeys(every)]
    place = dict(zip(names, range(len(names)), strict=True))
    return [w.decode() for w in names], np.fromiter(map(place.__getitem__, every), np.int64, len(every)), first


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Bytes and tokens of every whole text.

    White space never joins or splits differently around a word in the vocabularies meant here (those that drop white
    space), so a text's count is the sum over its distinct words of count times occurrences. Null and empty texts have
    no tokens. Rows keep their key, null or repeated as it is. One pass, no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            raw, offsets = buffer(batch.column(1))
            totals = np.zeros(batch.num_rows, np.int64)
            for a, b in slices(offsets):
                names, index, first = distinct_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                each = np.fromiter(map(count, names), np.int64, len(names))
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(each[index])])
                totals[a:b] = sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(totals)], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
