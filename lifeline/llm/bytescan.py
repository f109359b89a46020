"""Words and hashes of whole Arrow batches of texts, as numpy arrays.

A batch is cut into pieces of bounded bytes, so that memory does not follow the batch;
a single longer text is a piece of its own. Texts are UTF-8; nulls count as empty.
Hashes are 64 bits wide: polynomial over randomised bytes, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32                                        # A-Z to a-z, as the contracts say
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)                       # digits, letters and everything beyond ASCII
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 1024), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Piece:
    """Rows ``first`` to ``first + rows`` of a batch; ``cuts`` are their byte borders in ``data``."""

    batch: pa.RecordBatch
    data: np.ndarray
    cuts: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.cuts) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.cuts[row]:self.cuts[row + 1]].tobytes()


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
            end = min(max(end, row + 1), len(texts))
            yield Piece(batch.slice(row, end - row), data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
            row = end


@dataclass
class Words:
    start: np.ndarray    # byte positions in the piece
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray    # per row: index of its first word; one more entry at the end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i] = hash state of the first i bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers(_BASE, len(data) + 1)[:len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


def words(piece: Piece, is_word: np.ndarray, fold: bool = True) -> Words:
    data = FOLD[piece.data] if fold else piece.data
    inside = is_word[data]
    n = len(data)
    left, right = np.ones(n, bool), np.ones(n, bool)     # a word begins / ends here if inside
    left[1:], right[:-1] = ~inside[:-1], ~inside[1:]
    borders = piece.cuts[1:-1]
    left[borders[borders < n]] = True
    right[borders[borders > 0] - 1] = True
    start, end = np.flatnonzero(inside & left), np.flatnonzero(inside & right) + 1
    first = np.searchsorted(start, piece.cuts)
    row = np.repeat(np.arange(piece.rows), np.diff(first))
    return Words(start, end, row, range_hash(prefix_sums(data), start, end), first)


def word_counts(piece: Piece, is_word: np.ndarray) -> np.ndarray:
    """Words of each row, without their hashes."""
    inside = is_word[piece.data]
    left = inside.copy()
    left[1:] &= ~inside[:-1]
    borders = piece.cuts[1:-1]
    borders = borders[borders < len(inside)]
    left[borders] = inside[borders]
    return np.diff(np.searchsorted(np.flatnonzero(left), piece.cuts))


def ngrams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a row, and the index of each one's first word."""
    h, total = found.hash, len(found.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[:total - n + 1].copy()
    for k in range(1, n):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[k:total - n + 1 + k])
    at = np.flatnonzero(found.row[:total - n + 1] == found.row[n - 1:])
    return acc[at], at
