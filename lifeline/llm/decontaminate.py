"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``n`` consecutive words of every item (a shorter item is one
pattern). For patterns of one length a table over blocks of two words tells how far the
search may move on: a block that ends no pattern, or only starts one, skips up to n - 1
words at once. Where the shift is zero, the hash of the block picks the patterns that end
with it, the hash of the whole window narrows them, and the words themselves are compared.

The items are broadcast in parts of bounded size (``PART_BYTES`` of text each, one
search step per part, chained within one pass over the documents), so neither the
documents nor a large benchmark are shuffled or joined, and nothing depends on keys.

Defined results: null and empty texts have no words, hits or items; items without words
have no pattern; equal items count each; items with a null id count as one with an
empty id; repeated rows are searched each on its own; an empty table gives an empty
table, an empty benchmark no hits. Input columns named like an added one are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline.llm import bytescan
from lifeline.llm.columns import without

PART_BYTES = 16 << 20
SHIFT_BITS = 20          # the shift table has 2 ** 20 bytes; equal slots only shorten shifts
MOST_SHIFT = 255
ADDED = ("n_words", "n_hit", "hit_spans", "items")


class Patterns:
    """Shift table, suffix buckets and words of all patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift = np.full(1 << SHIFT_BITS, min(length - self.block + 1, MOST_SHIFT), np.uint8)
        self.buckets: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = defaultdict(dict)

    def add(self, words: list[bytes], hashes: np.ndarray, item: str) -> None:
        ends = block_hashes(hashes, self.block)
        slots = (ends & np.uint64((1 << SHIFT_BITS) - 1)).astype(np.int64)
        distance = np.minimum(len(ends) - 1 - np.arange(len(ends)), MOST_SHIFT).astype(np.uint8)
        np.minimum.at(self.shift, slots, distance)
        bucket = self.buckets[int(ends[-1])].setdefault(int(window_hash(hashes, self.length)[0]), [])
        joined = b" ".join(words)
        for known, items in bucket:
            if known == joined:
                if item not in items:
                    items.append(item)
                return
        bucket.append((joined, [item]))

    def occurrences(self, found: bytescan.Words, data: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """First words of occurrences in a piece, and the items."""
        n, back = self.length, self.length - 1
        if len(found.hash) < n:
            return
        ends = block_hashes(found.hash, self.block)
        shifts = self.shift[(ends & np.uint64((1 << SHIFT_BITS) - 1)).astype(np.int64)].tobytes()
        lag = self.block - 1                             # shifts[i] is of the block ending at word i + lag
        limits = found.first[1:].tolist()
        for row in np.flatnonzero(np.diff(found.first) >= n).tolist():
            at, limit = int(found.first[row]) + back, limits[row]
            while at < limit:
                step = shifts[at - lag]
                if step:
                    at += step
                    continue
                bucket = self.buckets.get(int(ends[at - lag]))
                if bucket:
                    known = bucket.get(int(window_hash(found.hash[at - back:at + 1], n)[0]))
                    if known:
                        joined = b" ".join(
                            data[found.start[i]:found.end[i]].tobytes() for i in range(at - back, at + 1))
                        for words, items in known:
                            if words == joined:
                                yield at - back, items
                at += 1


def block_hashes(hashes: np.ndarray, block: int) -> np.ndarray:
    return hashes if block == 1 else bytescan.mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])


def window_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    acc = hashes[:len(hashes) - n + 1].copy()
    for k in range(1, n):
        acc = bytescan.mix(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[k:len(hashes) - n + 1 + k])
    return acc


def compile_patterns(items: Iterable[tuple[str, str]], n: int) -> dict[int, Patterns]:
    """Patterns by length, from (item id, text) rows."""
    by_length: dict[int, Patterns] = {}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in zip(("item", "text"), zip(*items))}) if items else None
    for piece in bytescan.pieces([batch] if batch else [], "text"):
        found, data = bytescan.words(piece, bytescan.ALPHANUMERIC), bytescan.FOLD[piece.data]
        names = piece.batch.column(0).to_pylist()
        texts = [data[s:e].tobytes() for s, e in zip(found.start.tolist(), found.end.tolist())]
        for row, name in enumerate(names):
            lo, hi = int(found.first[row]), int(found.first[row + 1])
            length = min(n, hi - lo)
            for at in range(lo, hi - length + 1) if length else ():
                by_length.setdefault(length, Patterns(length)).add(texts[at:at + length], found.hash[at:at + length], name)
    return by_length


_compiled: dict[tuple, dict[int, Patterns]] = {}


def compiled(items: list[tuple[str, str]], n: int) -> dict[int, Patterns]:
    """The patterns of the part this worker last used are kept for its next task."""
    key = (n, len(items), hash(tuple(items)))
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compile_patterns(items, n)
    return _compiled[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searcher(items, n: int, text: str):
    def search(batches):
        held = compiled(items.value, n)
        for piece in bytescan.pieces(batches, text):
            found, data = bytescan.words(piece, bytescan.ALPHANUMERIC), bytescan.FOLD[piece.data]
            spans = [[(s["start"], s["end"]) for s in x] for x in piece.batch.column("hit_spans").to_pylist()]
            names = [set(x) for x in piece.batch.column("items").to_pylist()]
            for length, patterns in held.items():
                for at, hit in patterns.occurrences(found, data):
                    row = int(found.row[at])
                    first = at - int(found.first[row])
                    spans[row].append((first, first + length))
                    names[row].update(hit)
            spans = [merged(x) for x in spans]
            new = {
                "n_words": pa.array(np.diff(found.first), pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
                "hit_spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], SPANS),
                "items": pa.array([sorted(x) for x in names], pa.list_(pa.string())),
            }
            names_of = piece.batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(c, piece.batch.column(i)) for i, c in enumerate(names_of)], names_of)
    return search


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def parts_of(benchmark: DataFrame, item: str, text: str, part_bytes: int) -> list[list[tuple[str, str]]]:
    """The items in parts of bounded size; a part is read from the table on its own."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // part_bytes))
    for part in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()]


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", n: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add n_words, n_hit, hit_spans (word positions, end exclusive) and items to each document."""
    spark = docs.sparkSession
    found = without(docs, *ADDED).select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("hit_spans"),
        F.array().cast("array<string>").alias("items"))
    for part in parts_of(benchmark, item, item_text, part_bytes):
        found = found.mapInArrow(_searcher(spark.sparkContext.broadcast(part), n, text), found.schema)
    return found
