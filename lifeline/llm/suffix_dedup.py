"""Removal of byte strings that occur more than once, by a sampled suffix order.

The difference-cover idea, distributed: name sampled suffixes by triples, recurse on the
names, and let the other suffixes follow from the next sampled one.

* Names: the name of 3 bytes is a hash of a triple of bytes, the name of 9 bytes one of a
  triple of such names, and so on (27, 81, then ``length``). Equal names are equal
  strings; a name is computed where the text is, so no level shuffles all positions.
* Sample: of the positions in which an 81-byte name lies within a ``length``-byte string,
  the one with the least name stands for the string. It depends on the string alone, so
  equal strings choose equal samples, wherever they start. About one position in sixty is
  a sample (a cover by residues would keep two of three).
* Samples are sorted by name over the cluster. A name met once ends there. The strings
  that one occurrence stands for start next to each other; where all occurrences agree on
  them, all are repeated. Only where they disagree is the text of the neighbourhood sent,
  its remaining suffixes are merged into one order of ``length``-byte names, and adjacent
  equal prefixes are the repeats.

A group of one sampled name is sent as texts only up to ``GROUP`` of them. The strings of
larger groups are dealt out by their own full names instead, so no task holds a group.
Exact copies of whole texts are matched by digest and never compared.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; an
overlap of repeats counts once; equal rows are copies of each other (all bytes go, if
long enough); null ids are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline.llm import bytescan, fixed
from lifeline.llm.bytescan import mix
from lifeline.llm.ngram_join import signed
from lifeline.llm.store import Scratch

SAMPLE = 81              # bytes of a sampled name: a power of three
FILTER_BITS = 1 << 23    # 1 MB filters of names and texts, fixed
GROUP = 20_000           # texts of a sampled name that meet in one task
CHUNK = 1 << 20          # starts looked at together
LOW = np.uint64((1 << 24) - 1)


def triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0xC2B2AE3D27D4EB4F)
               + (c ^ (c >> np.uint64(29))) * np.uint64(0x165667B19E3779F9))


def sampled_names(data: np.ndarray) -> np.ndarray:
    """Names of the SAMPLE bytes from each position on, by recursion on triples."""
    names, width = bytescan._RANDOM[data], 1
    while width < SAMPLE and len(names) > 2 * width:
        end = len(names) - 2 * width
        names = triple(names[:end], names[width:width + end], names[2 * width:])
        width *= 3
    return names if width == SAMPLE else np.zeros(0, np.uint64)


def full_names(names: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length`` bytes from the given positions on."""
    rest = length - SAMPLE
    return triple(names[starts], names[starts + rest // 2], names[starts + rest])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of this width."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:len(values) - size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[:len(values) - (width - size)], values[width - size:])
    return values


class Samples:
    """The samples of a piece: rows, names, contexts and the starts each stands for."""

    def __init__(self, piece: bytescan.Piece, length: int):
        found: list[tuple[np.ndarray, ...]] = []
        row_end = np.repeat(piece.cuts[1:], np.diff(piece.cuts))
        for at in range(0, len(piece.data), CHUNK):
            data = piece.data[at:at + CHUNK + length - 1]
            names = sampled_names(data)
            if len(data) < length:
                break
            # The upper bits order by name; the position decides between equal ones.
            packed = (names & ~LOW) | np.arange(len(names), dtype=np.uint64)
            chosen = (least(packed, length - SAMPLE + 1) & LOW).astype(np.int64)
            starts = np.flatnonzero(at + np.arange(len(chosen)) + length <= row_end[at:at + len(chosen)])
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (chosen[starts[1:]] != chosen[starts[:-1]]) | (np.diff(starts) != 1)
            first = starts[new]
            last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
            context = mix(full_names(names, first, length) * np.uint64(0xD6E8FEB86659FD93)
                          + full_names(names, last, length) + (last - first).astype(np.uint64))
            found.append((names[chosen[first]], context, first + at, last + at))
        empty = np.zeros(0, np.int64)
        self.name, self.context, self.first, self.last = (
            np.concatenate(x) for x in zip(*found)) if found else (empty.astype(np.uint64), empty.astype(np.uint64), empty, empty)
        self.row = np.searchsorted(piece.cuts, self.first, "right") - 1
        order = np.lexsort((self.context, self.name, self.row))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[1:] = (self.row[a] == self.row[b]) & (self.name[a] == self.name[b]) & (self.context[a] == self.context[b])
        self.extra = np.zeros(len(order), bool)          # repeats an earlier sample of its text
        self.extra[order[same]] = True
        self.known = self.extra.copy()                   # certainly repeated within its text
        self.known[order[:-1][same[1:]]] = True


def slot(names: np.ndarray) -> np.ndarray:
    return (mix(names) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def filter_of(df: DataFrame) -> np.ndarray:
    """Bits of the values of a long column; fixed size, false hits only."""
    def named(batches):
        for batch in batches:
            yield slot(np.asarray(batch.column(0)).view(np.uint64))

    return np.packbits(fixed.summed(df, FILTER_BITS, named) > 0)


def digest(text: bytes) -> tuple[int, str]:
    full = hashlib.sha256(text)
    return int.from_bytes(full.digest()[:8], "big", signed=True), full.hexdigest()


def runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist())


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").alias("text"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    def describe(batches):
        for piece in bytescan.pieces(batches, "text"):
            ids, whole = zip(*[digest(piece.text(r)) for r in range(piece.rows)])
            yield pa.RecordBatch.from_arrays([
                piece.batch.column(0), pa.array(ids, pa.int64()), pa.array(np.diff(piece.cuts), pa.int64()),
                pa.array(whole, pa.string())], ["id", "node", "n_bytes", "whole"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        describe, "id bigint, node bigint, n_bytes bigint, whole string")


def _names(docs: DataFrame, text: str, length: int) -> DataFrame:
    """The sampled names of all texts: how many of each, and whether their contexts agree."""
    def read(batches):
        for piece in bytescan.pieces(batches, "text"):
            s = Samples(piece, length)
            yield pa.RecordBatch.from_arrays([signed(s.name[~s.extra]), signed(s.context[~s.extra])], ["name", "context"])

    return _texts(docs, text).mapInArrow(read, "name bigint, context bigint").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")


def _occurrences(docs: DataFrame, text: str, length: int, repeated, mixed, hot) -> DataFrame:
    """Occurrences of repeated names: known repeats, agreeing ones, texts, or single strings."""
    names = ["name", "context", "node", "first", "last", "known", "text"]

    def read(batches):
        bits = [np.unpackbits(b.value).astype(bool) for b in (repeated, mixed, hot)]
        for piece in bytescan.pieces(batches, "text"):
            s = Samples(piece, length)
            at = slot(s.name)
            is_hot, is_mixed = bits[2][at], bits[1][at]
            # Further occurrences of a sample within its text are known; runs of them are one row.
            joined = s.extra & np.append(False, s.extra[:-1] & (s.row[1:] == s.row[:-1]) & (s.first[1:] == s.last[:-1] + 1))
            last = s.last.copy()
            heads = np.flatnonzero(~joined)
            if len(heads):
                last[heads] = s.last[np.append(heads[1:], len(joined)) - 1]
            send = ((bits[0][at] & ~s.extra & ~is_hot) | s.known) & ~joined
            offset = piece.cuts[s.row]
            node = np.array([digest(piece.text(r))[0] if c else 0 for r, c in enumerate(
                np.bincount(s.row[send | is_hot], minlength=piece.rows).tolist())], np.int64)
            chosen = np.flatnonzero(send)
            with_text = (is_mixed & ~s.extra)[chosen].tolist()
            data = piece.data
            # They match nothing any more and are dealt out by their place.
            key = np.where(s.extra[chosen], mix(node[s.row[chosen]].view(np.uint64) + s.first[chosen].astype(np.uint64)), s.name[chosen])
            yield pa.RecordBatch.from_arrays([
                signed(key), signed(s.context[chosen]), pa.array(node[s.row[chosen]]),
                pa.array(s.first[chosen] - offset[chosen]), pa.array(last[chosen] - offset[chosen]),
                pa.array(s.known[chosen]),
                pa.array([data[a:b + length].tobytes() if t else None for a, b, t in zip(
                    s.first[chosen].tolist(), s.last[chosen].tolist(), with_text)], pa.binary()),
            ], names)
            singles = np.flatnonzero(is_hot & ~s.extra)
            for i in singles.tolist():
                a, b = int(s.first[i]), int(s.last[i])
                full = full_names(sampled_names(data[a:b + length]), np.arange(b - a + 1), length)
                starts = np.arange(a, b + 1) - offset[i]
                yield pa.RecordBatch.from_arrays([
                    signed(full), signed(full), pa.array(np.full(len(full), node[s.row[i]])), pa.array(starts), pa.array(starts),
                    pa.array(np.zeros(len(full), bool)), pa.array([None] * len(full), pa.binary())], names)

    return _texts(docs, text).mapInArrow(
        read, "name bigint, context bigint, node bigint, first bigint, last bigint, known boolean, text binary")


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches again, cut so that no name stands on both sides of a cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.asarray(batch.column(0))
        cut = int(np.searchsorted(names, names[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _repeats(table: pa.Table, length: int) -> pa.RecordBatch:
    """Spans (node, first, last start) of strings that occur twice or more."""
    table = table.combine_chunks()
    columns = {c: table.column(c).to_numpy() for c in ("name", "context", "node", "first", "last", "known")}
    name, context = columns["name"], columns["context"]
    new_name = np.append(True, name[1:] != name[:-1])
    new_context = new_name | np.append(True, context[1:] != context[:-1])
    of_context = np.cumsum(new_context) - 1
    heads = np.flatnonzero(new_context)
    weight = np.bincount(of_context)                     # occurrences of each context
    sure = columns["known"] | (weight[of_context] > 1)
    spans = [np.stack([columns[c][sure] for c in ("node", "first", "last")])]
    # The others: merge the remaining suffixes of groups with differing contexts.
    of_name = np.cumsum(new_name) - 1
    several = np.bincount(of_name[heads]) > 1
    texts = table.column("text").combine_chunks()
    rows = heads[several[of_name[heads]] & ~np.asarray(texts.is_null())[heads]]
    if len(rows):
        size = columns["last"][rows] - columns["first"][rows] + 1
        buffer = np.frombuffer(b"".join(texts.take(pa.array(rows)).to_pylist()), np.uint8)
        begin = np.concatenate([[0], np.cumsum(size + length - 1)[:-1]])
        of_row = np.repeat(np.arange(len(rows)), size)
        starts = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) + begin[of_row]
        full = full_names(sampled_names(buffer), starts, length)
        order = np.argsort(full, kind="stable")
        differs = np.append(True, full[order[1:]] != full[order[:-1]])
        group = np.cumsum(differs) - 1
        total = np.bincount(group, weights=weight[of_context[rows]][of_row[order]])
        repeated = np.zeros(len(full), bool)
        repeated[order] = total[group] > 1
        edge = repeated & ~(np.append(False, repeated[:-1]) & np.append(False, of_row[1:] == of_row[:-1]))
        stop = repeated & ~(np.append(repeated[1:], False) & np.append(of_row[1:] == of_row[:-1], False))
        a, b = np.flatnonzero(edge), np.flatnonzero(stop)
        r = of_row[a]
        at = columns["first"][rows[r]]
        spans.append(np.stack([columns["node"][rows[r]], at + starts[a] - begin[r], at + starts[b] - begin[r]]))
    node, first, last = np.concatenate(spans, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(first), pa.array(last)], ["node", "first", "last"])


def _cut(docs: DataFrame, text: str, spans: DataFrame, chosen: np.ndarray, length: int) -> DataFrame:
    """Texts with spans: what is removed of them, and the digest of the rest."""
    bits = docs.sparkSession.sparkContext.broadcast(chosen)

    def send(batches):
        keep = np.unpackbits(bits.value).astype(bool)
        for piece in bytescan.pieces(batches, "text"):
            texts = [piece.text(r) for r in range(piece.rows)]
            nodes = np.array([digest(t)[0] for t in texts], np.int64)
            rows = np.flatnonzero(keep[slot(nodes.view(np.uint64))]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array([texts[r] for r in rows], pa.binary())], ["node", "text"])

    def cut(batches):
        for batch in batches:
            out = []
            for node, text_, first, last in zip(*[batch.column(c).to_pylist() for c in ("node", "text", "first", "last")]):
                gone = np.zeros(len(text_) + 1, np.int32)
                np.add.at(gone, np.array(first), 1)
                np.add.at(gone, np.array(last) + length, -1)
                covered = np.cumsum(gone[:-1]) > 0
                rest = np.frombuffer(text_, np.uint8)[~covered].tobytes()
                out.append((node, int(covered.sum()), sum(1 for _ in runs(covered)), hashlib.sha256(rest).hexdigest(), rest))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                ["node", "n_removed", "n_spans", "rest_sha256", "rest"])

    sent = _texts(docs, text).mapInArrow(send, "node bigint, text binary")
    grouped = spans.groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("s")).select(
        "node", F.col("s.first").alias("first"), F.col("s.last").alias("last"))
    return sent.join(grouped, "node").select("node", "text", "first", "last").mapInArrow(
        cut, "node bigint, n_removed bigint, n_spans bigint, rest_sha256 string, rest binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200,
                   with_rest: bool = False) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256[, rest]) for every document row.

    ``rest`` holds the remaining bytes, null where nothing was removed.
    """
    if length < SAMPLE or length - SAMPLE > 2 * SAMPLE:
        raise ValueError(f"length must lie between {SAMPLE} and {3 * SAMPLE}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    rows = scratch.keep(_rows(docs, key, text), "rows")
    names = scratch.keep(_names(docs, text, length), "names")
    filters = [spark.sparkContext.broadcast(filter_of(names.where(c).select("name"))) for c in (
        "true", "low <> high", f"low <> high AND n > {GROUP}")]
    met = _occurrences(docs, text, length, *filters).repartition("name").sortWithinPartitions("name", "context")

    def find(batches):
        for table in _whole_groups(batches):
            yield _repeats(table, length)

    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    single = copies.where("copies = 1").select("node")
    spans = scratch.keep(met.mapInArrow(find, "node bigint, first bigint, last bigint").join(single, "node", "left_semi"), "spans")
    cut = _cut(docs, text, spans, filter_of(spans.select("node").distinct()), length)
    cut = cut if with_rest else cut.drop("rest")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    done = rows.join(copies, "node").join(cut, "node", "left").select(
        "id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("rest_sha256", "whole")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("rest")).alias("rest")] if with_rest else []))
    return done
