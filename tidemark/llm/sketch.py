"""A count sketch of bounded size, summed over all tasks, for choices that need to know what is frequent (never for results)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELLS, PART = 1 << 20, 1 << 15


def cell(hashes: np.ndarray, row: int, cells: int = CELLS) -> np.ndarray:
    """The cell of each 64-bit hash in a row of the sketch."""
    return ((hashes >> np.uint64(20 * (row % 2) + 8)) & np.uint64(cells - 1)).astype(np.int64)


class CountSketch:
    """One task's counts; each row counts things of one kind."""

    def __init__(self, rows: int, cells: int = CELLS):
        self.counts = np.zeros((rows, cells), np.uint32)

    def add(self, row: int, hashes: np.ndarray) -> None:
        places, counts = np.unique(cell(hashes, row, self.counts.shape[1]), return_counts=True)
        self.counts[row, places] += counts.astype(np.uint32)

    def parts(self) -> list[tuple[int, bytes]]:
        """Numbered, compressed pieces."""
        flat = self.counts.reshape(-1)
        return [(k, zlib.compress(flat[k * PART : (k + 1) * PART].tobytes(), 1)) for k in range(len(flat) // PART)]

    @staticmethod
    def levels(parts: DataFrame, rows: int, cells: int = CELLS) -> np.ndarray:
        """The sum of all tasks' parts (part, counts) as half doublings above a row's mean cell: rows * cells bytes."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
            for part, total in sums.items():
                quarters = np.floor(4 * np.log2(total + 1.0)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([quarters.tobytes()], pa.binary())], ["part", "quarters"])

        quarters = np.zeros(rows * cells, np.uint8)
        spread = min(rows * cells // PART, 64)
        for row in parts.repartition(spread, "part").mapInArrow(add, "part int, quarters binary").collect():  # rows * cells bytes
            quarters[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(row["quarters"], np.uint8)
        quarters = quarters.reshape(rows, cells)
        value = np.exp2(np.arange(256, dtype=np.float64) / 4)
        base = np.stack([4 * np.log2(1 + max(1.0, value[row].mean() - 1)) for row in quarters])[:, None]
        return np.floor((quarters - base) / 2).clip(0, 63).astype(np.uint8)
