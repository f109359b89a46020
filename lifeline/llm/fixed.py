"""Arrays of a fixed size that tasks fill, summed by Spark and read by the driver.

The size is a parameter and never follows the input: every task sends blocks of counts,
blocks of one number are added as they stream through a task, and the driver receives
the sum only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BLOCK = 1 << 17
SCHEMA = "block int, counts binary"


class Counts:
    """Counts of slots as one task fills them, in blocks that are made once a slot of theirs is named."""

    def __init__(self, size: int):
        self.blocks = -(-size // BLOCK)
        self.held: dict[int, np.ndarray] = {}

    def add(self, found: np.ndarray) -> None:
        found = np.sort(found)
        cut = np.searchsorted(found, np.arange(self.blocks + 1) * BLOCK)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            self.more(b, np.bincount(found[cut[b]:cut[b + 1]] - b * BLOCK, minlength=BLOCK))

    def more(self, block: int, counts: np.ndarray) -> None:
        if block in self.held:
            self.held[block] = self.held[block] + counts
        else:
            self.held[block] = counts

    def packed(self) -> Iterator[tuple[int, bytes]]:
        for b, c in self.held.items():
            yield b, zstandard.compress(c.tobytes(), 1)


def total(sent: DataFrame, size: int) -> np.ndarray:
    """The sum of rows (block, counts) as ``Counts.packed`` gives them."""
    def add(batches):
        counts = Counts(size)
        for batch in batches:
            for b, packed in zip(*(c.to_pylist() for c in batch.columns)):
                counts.more(b, np.frombuffer(zstandard.decompress(packed), np.int64))
        yield from _rows(counts)

    blocks = -(-size // BLOCK)
    out = np.zeros(blocks * BLOCK, np.int64)
    for row in sent.repartition(min(blocks, 64), "block").mapInArrow(add, SCHEMA).collect():  # ``size`` numbers, whatever the input
        out[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(zstandard.decompress(row.counts), np.int64)
    return out[:size]


def _rows(counts: Counts) -> Iterator[pa.RecordBatch]:
    for b, packed in counts.packed():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packed], pa.binary())], ["block", "counts"])


def summed(df: DataFrame, size: int, slots: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Count how often each slot below ``size`` is named by ``slots`` over the whole table."""
    def fill(batches):
        counts = Counts(size)
        for found in slots(batches):
            counts.add(found)
        yield from _rows(counts)

    return total(df.mapInArrow(fill, SCHEMA), size)
