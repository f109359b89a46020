"""Groups of documents whose word n-gram sets are similar, found by prefix-tree joins.

Steps, each a Spark job over the whole table:

1. Documents with equal sets form one class (an exact collapse; its members are never
   paired). A class is described by its size and a parity bitmap as wide as its set.
2. A global order of n-grams, rare ones first: counts in an array of fixed size
   (``SLOTS``), ties by hash. Any consistent order gives the same links; the counts only
   make groups small.
3. Two sets that are similar enough share an n-gram among the first ones of that order.
   Classes meet in the group of every such n-gram that another class of a fitting size has
   as well (groups of equal members meet once). A bitmap bounds the overlap of two sets from above, and
   classes joined by possible pairs form a cluster. No set is sent so far.
4. The sets of a cluster meet, ordered, in a prefix tree (most frequent n-gram first, so
   that long beginnings are shared). A traversal carries the overlap along shared paths
   and prunes a subtree once the remaining lengths cannot reach the wanted overlap. In
   larger groups it goes only to sets that the bitmaps, compared as matrices, allow. A
   group reports a spanning forest of its links, so n near copies give n - 1 of them.
5. Components of the links name the result.

Groups and clusters of more than ``BLOCK`` classes are cut into blocks. Blocks first meet
on their own, with one pivot in all of them; then only members that are still apart meet:
blocks of the largest part with blocks of the others, and the others among themselves.
Links are lost nowhere, and a large group of near copies costs about its size.

Defined results: null and empty texts have no n-grams, size 0 and are linked with nothing
(their component is their own id); texts of fewer words than n count as one n-gram;
repeated rows and equal sets share a component; null ids take part through their class,
and get the component's least known id; an empty table gives an empty table.
N-grams are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeline.llm import bytescan, fixed
from lifeline.llm.components import connected
from lifeline.llm.store import Scratch

SLOTS = 1 << 22          # counts that set the global order: 16 MB broadcast, fixed
FILTER_BITS = 1 << 23    # 1 MB filter of the classes whose sets are sent
BLOCK = 768              # classes of a group that meet at once
MIN_BITS = 64
BITS_EACH = 4            # bitmap bits for each element of a set
FEW = 16                 # sets of a group that are compared without matrices of bitmaps


class Shape:
    """Set sizes that a similarity of ``percent`` needs."""

    def __init__(self, n: int, percent: int):
        self.n, self.percent = n, percent

    def prefix(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))


# Sets of a piece of documents


def ngram_sets(piece: bytescan.Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, sorted within each row, and where the rows begin."""
    found = bytescan.words(piece, bytescan.NOT_SPACE)
    grams, at = bytescan.ngrams(found, n)
    row = found.row[at]
    short = [r for r in np.flatnonzero((np.diff(found.first) < n) & (np.diff(found.first) > 0)).tolist()]
    if short:
        whole = []
        for r in short:
            h = np.full(1, 0x51ED270B, np.uint64)
            for w in found.hash[found.first[r]:found.first[r + 1]]:
                h = bytescan.mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
            whole.append(h[0])
        grams = np.concatenate([grams, np.array(whole, np.uint64)])
        row = np.concatenate([row, np.array(short, row.dtype)])
        order = np.argsort(row, kind="stable")
        grams, row = grams[order], row[order]
    # Row by row: a sort of all rows at once takes ten times as long.
    cuts = np.searchsorted(row, np.arange(piece.rows + 1)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(piece.rows + 1))


def class_ids(grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One number per set, equal for equal sets (0 for empty ones)."""
    filled = np.flatnonzero(np.diff(cuts))
    out = np.zeros(len(cuts) - 1, np.uint64)
    if len(filled):
        first = np.add.reduceat(bytescan.mix(grams + np.uint64(0x1234567)), cuts[filled])
        second = np.bitwise_xor.reduceat(bytescan.mix(grams ^ np.uint64(0xABCDEF012345)), cuts[filled])
        out[filled] = bytescan.mix(first + bytescan.mix(second)) | np.uint64(1)
    return out


def bitmap(grams: np.ndarray) -> bytes:
    """Parity of the set's n-grams in each of a few times as many bits as it has elements."""
    bits = max(MIN_BITS, BITS_EACH << max(0, len(grams) - 1).bit_length())
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def most_common(a: int, bits_a: int, size_a: int, b: int, bits_b: int, size_b: int) -> int:
    """Upper bound of the intersection from two bitmaps (as integers)."""
    while bits_a > bits_b:
        bits_a //= 2
        a = (a >> bits_a) ^ (a & ((1 << bits_a) - 1))
    while bits_b > bits_a:
        bits_b //= 2
        b = (b >> bits_b) ^ (b & ((1 << bits_b) - 1))
    return (size_a + size_b - (a ^ b).bit_count()) // 2


class Bitmaps:
    """Bitmaps of a group's sets as matrices, one per width; bounds of one set with many others at once."""

    def __init__(self, maps: list[bytes], sizes: list[int], shape: Shape):
        self.shape, self.sizes = shape, np.array(sizes, np.int64)
        width = np.array([len(m) // 8 for m in maps])
        self.width, self.row, self.members, self.matrix = width.tolist(), np.zeros(len(maps), np.int64), {}, {}
        for w in np.unique(width).tolist():
            at = self.members[w] = np.flatnonzero(width == w)
            self.row[at] = np.arange(len(at))
            self.matrix[w, w] = np.frombuffer(b"".join([maps[i] for i in at.tolist()]), np.uint64).reshape(len(at), w)

    def folded(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.matrix:
            own = self.matrix[width, width]
            self.matrix[width, to] = np.bitwise_xor.reduce(own.reshape(len(own), width // to, to), axis=1)
        return self.matrix[width, to]

    def allow(self, i: int, free: np.ndarray) -> np.ndarray:
        """The places of those among ``free`` (flags) that may be similar to the set at ``i``."""
        size, own, found = int(self.sizes[i]), self.width[i], []
        for w, at in self.members.items():
            at = at[free[at]]
            both = size + self.sizes[at]
            wanted = -(-self.shape.percent * both // (100 + self.shape.percent))
            fit = np.minimum(self.sizes[at], size) >= wanted
            at, both, wanted = at[fit], both[fit], wanted[fit]
            if len(at):
                to = min(w, own)
                differ = self.folded(w, to)[self.row[at]] ^ self.folded(own, to)[self.row[i]]
                found.append(at[(both - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)) // 2 >= wanted])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def parts(self) -> list[int]:
        """The first member that each member reaches by pairs that the bitmaps allow."""
        root, free = np.arange(len(self.sizes)), np.ones(len(self.sizes), bool)
        for i in range(len(root)):
            reached, free[i] = [i] if free[i] else [], False
            while reached and free.any():
                more = self.allow(reached.pop(), free)
                root[more], free[more] = i, False
                reached.extend(more.tolist())
        return root.tolist()


# Prefix tree


class PrefixTree:
    """Sets as rows of an ordered sequence table; nodes are intervals of equal beginnings."""

    def __init__(self, sequences: list[np.ndarray], shape: Shape):
        packed = sorted(range(len(sequences)), key=lambda i: sequences[i].tobytes())
        self.order, self.sequences, self.shape = packed, [sequences[i] for i in packed], shape
        self.sizes = np.array([len(s) for s in self.sequences])
        self.shared = np.zeros(len(packed), np.int64)    # with the sequence before
        for i in range(1, len(packed)):
            a, b = self.sequences[i - 1], self.sequences[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[i] = differ[0] if len(differ) else m

    def similar(self, probe: np.ndarray, skip: np.ndarray) -> Iterator[int]:
        """Positions of the sequences similar to a set, leaving out those in ``skip``."""
        wanted, size = np.sort(probe), len(probe)
        left = np.concatenate([[0], np.cumsum(~skip)])
        stack = [(0, len(self.sequences), 0, 0)]
        while stack:
            lo, hi, depth, common = stack.pop()
            if left[hi] == left[lo]:
                continue
            leaf = hi - lo == 1
            end = len(self.sequences[lo]) if leaf else int(self.shared[lo + 1:hi].min())
            edge = self.sequences[lo][depth:end]
            if len(edge):
                at = np.minimum(np.searchsorted(wanted, edge), size - 1)
                common += int((wanted[at] == edge).sum())
            # The rest of the longest sequence, and of the probe, bound what can still come.
            longest, shortest = int(self.sizes[lo:hi].max()), int(self.sizes[lo:hi].min())
            if common + longest - end < self.shape.overlap(size, longest) or size < self.shape.overlap(size, shortest):
                continue
            if leaf:
                if common >= self.shape.overlap(size, longest):
                    yield lo
                continue
            borders = [lo, *(lo + 1 + np.flatnonzero(self.shared[lo + 1:hi] == end)).tolist(), hi]
            stack.extend((a, b, end, common) for a, b in zip(borders, borders[1:]))


def forest(ids: list[int], sequences: list[np.ndarray], shape: Shape) -> list[tuple[int, int]]:
    """A spanning forest of the links within a group: no link is lost, none repeated."""
    tree = PrefixTree(sequences, shape)
    maps = Bitmaps([bitmap(s) for s in tree.sequences], tree.sizes, shape) if len(ids) > FEW else None
    root = np.arange(len(ids))
    for i in range(len(ids)):
        if i and root[i] == root[i - 1] and (root == root[i]).all():
            break
        skip = root == root[i]
        skip[:i] = True                                  # these have probed the tree themselves
        if maps:
            near = maps.allow(i, ~skip)
            if not len(near):
                continue
            skip[:] = True
            skip[near] = False
        for j in tree.similar(tree.sequences[i], skip):
            a, b = root[i], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
    # As stars: they settle sooner than chains.
    return [(ids[tree.order[i]], ids[tree.order[r]]) for i, r in enumerate(root.tolist()) if i != r]


# Streams of grouped rows


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal leading columns, as lists of the other columns."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def streamed(schema: pa.Schema, rows: Iterable[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(schema, held)
            held = []
    if held:
        yield batch_of(schema, held)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """All rows of a key in one task, one key after the other. Keys are cut to blocks before."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


# The join


def _classes(docs: DataFrame, key: str, text: str, n: int, slots: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The class of every row, and in rows of their own the tasks' counts of n-grams (block, counts)."""
    kinds = dict(docs.dtypes)
    schema = "id bigint, size bigint, node bigint, bits binary, mark bigint, " + "".join(f"`{c}` {kinds[c]}, " for c in carry) + fixed.SCHEMA

    def describe(batches):
        counts, batch = fixed.Counts(slots), None
        for piece in bytescan.pieces(batches, "text"):
            batch = piece.batch
            grams, cuts = ngram_sets(piece, n)
            counts.add((grams & np.uint64(slots - 1)).astype(np.int64))
            maps = [bitmap(grams[cuts[r]:cuts[r + 1]]) if cuts[r + 1] > cuts[r] else None for r in range(piece.rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(cuts)), signed(class_ids(grams, cuts)), pa.array(maps, pa.binary()),
                 batch.column(2), *(batch.column(c) for c in carry), pa.nulls(piece.rows, pa.int32()), pa.nulls(piece.rows, pa.binary())],
                ["id", "size", "node", "bits", "mark", *carry, "block", "counts"])
        for block, packed in counts.packed():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), *(batch.column(c).type for c in carry))]
                + [pa.array([block], pa.int32()), pa.array([packed], pa.binary())],
                ["id", "size", "node", "bits", "mark", *carry, "block", "counts"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), _mark(text), *carry).mapInArrow(describe, schema)


def _mark(text: str) -> Column:
    """What rows of equal texts share, known without their n-grams."""
    return F.xxhash64(F.col(f"`{text}`")).alias("mark")


def _ordered(grams: np.ndarray, cuts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sets with their elements in global order, rare ones first."""
    # Sets are sorted already, so places stand for n-grams among equal counts.
    key = counts[(grams & np.uint64(len(counts) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    ends = cuts.tolist()
    for a, b in zip(ends, ends[1:]):
        key[a:b].sort()
    return grams[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _prefixes(docs: DataFrame, text: str, shape: Shape, counts) -> DataFrame:
    """Rows (gram, node, size) for the leading n-grams of each set."""
    def lead(batches):
        for piece in bytescan.pieces(batches, "text"):
            grams, cuts = ngram_sets(piece, shape.n)
            nodes, size = class_ids(grams, cuts), np.diff(cuts)
            grams = _ordered(grams, cuts, counts.value)
            take = np.where(size > 0, size - -(-shape.percent * size // 100) + 1, 0)
            rank = np.arange(len(grams)) - np.repeat(cuts[:-1], size)
            chosen = rank < np.repeat(take, size)
            yield pa.RecordBatch.from_arrays(
                [signed(grams[chosen]), signed(np.repeat(nodes, take)), pa.array(np.repeat(size, take), pa.int32())],
                ["gram", "node", "size"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(lead, "gram bigint, node bigint, size int")


def _fitting(leading: DataFrame, shape: Shape) -> DataFrame:
    """The leading rows, each once, with another class of a fitting size next to them in their n-gram's group.

    Rows are ordered by (gram, size, node) over the cluster, so a hot n-gram spreads over tasks;
    only neighbours matter, and rows at the border of a task stay. Most n-grams are met in
    one class only and go here, after one shuffle.
    """
    def fits(batches):
        gram, node, size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        kept = False                                     # of the row held over: already known to fit
        for batch in batches:
            if not batch.num_rows:
                continue
            first = not len(gram)
            gram, node, size = (np.append(old, batch.column(c).to_numpy()) for old, c in ((gram, "gram"), (node, "node"), (size, "size")))
            new = np.append(True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]))
            gram, node, size = gram[new], node[new], size[new]
            near = (gram[1:] == gram[:-1]) & (size[:-1] * 100 >= shape.percent * size[1:])
            good = np.append(first or kept, near) | np.append(near, False)
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][good[:-1]]) for x in (gram, node, size)], ["gram", "node", "size"])
            gram, node, size, kept = gram[-1:], node[-1:], size[-1:], bool(good[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, node, size)], ["gram", "node", "size"])

    order = "gram", "size", "node"
    return leading.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(fits, leading.schema)


def _sets(docs: DataFrame, text: str, n: int, counts, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, grams) of the wanted classes, in global order. One text stands for a class; a filter
    of a fixed size keeps most others back unread, the join afterwards removes the rest."""
    nodes = wanted.select("node").distinct()
    keep = _filter(docs, rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark")).select("mark"))

    def chosen(batches):
        bits = np.unpackbits(keep.value).astype(bool)
        for batch in batches:
            some = batch.filter(pa.array(bits[_filter_slot(np.asarray(batch.column(1)).view(np.uint64))]))
            if some.num_rows:
                yield some

    def send(batches):
        for piece in bytescan.pieces(chosen(batches), "text"):
            grams, cuts = ngram_sets(piece, n)
            ids, filled = class_ids(grams, cuts), np.flatnonzero(np.diff(cuts)).tolist()
            grams = _ordered(grams, cuts, counts.value)
            yield pa.RecordBatch.from_arrays([
                signed(ids[filled]),
                pa.array([grams[cuts[r]:cuts[r + 1]].tobytes() for r in filled], pa.binary())], ["node", "grams"])

    sent = docs.select(F.col(f"`{text}`").alias("text"), _mark(text)).mapInArrow(send, "node bigint, grams binary")
    return sent.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _filter(docs: DataFrame, values: DataFrame):
    """Broadcast bits of the values of a long column, of a fixed size; false hits only."""
    def slot(batches):
        for batch in batches:
            yield _filter_slot(np.asarray(batch.column(0)).view(np.uint64))

    return docs.sparkSession.sparkContext.broadcast(np.packbits(fixed.summed(values, FILTER_BITS, slot) > 0))


def _filter_slot(nodes: np.ndarray) -> np.ndarray:
    return (bytescan.mix(nodes) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _trees(assigned: DataFrame, sets: DataFrame, shape: Shape) -> DataFrame:
    """Links (a, b) found by the prefix trees of the groups (key, x, y)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def grow(batches):
        def links():
            for _, rows in groups(batches, 3):
                if len(rows) > 1:
                    yield from forest([r[0] for r in rows], [np.frombuffer(r[1], np.uint64)[::-1] for r in rows], shape)
        yield from streamed(schema, links())

    rows = assigned.join(sets, "node").select("key", "x", "y", "node", "grams")
    return by_key(rows, "key", "x", "y").mapInArrow(grow, "a bigint, b bigint")


def _possible(grouped: DataFrame, shape: Shape) -> DataFrame:
    """A spanning forest of the pairs in each group (key, x, y) whose bitmaps allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches):
        def pairs():
            for _, held in groups(batches, 3):
                if len(held) < 2:
                    continue
                if len(held) > FEW:
                    root = Bitmaps([r[2] for r in held], [r[1] for r in held], shape).parts()
                    yield from ((held[i][0], held[r][0]) for i, r in enumerate(root) if i != r)
                    continue
                maps = [(int.from_bytes(r[2], "little"), 8 * len(r[2]), r[1]) for r in held]
                root = list(range(len(held)))
                for i, x in enumerate(maps):
                    for j in range(i):
                        a, b = root[i], root[j]
                        if a != b and most_common(*x, *maps[j]) >= shape.overlap(x[2], maps[j][2]):
                            root = [min(a, b) if r == a or r == b else r for r in root]
                yield from ((held[i][0], held[r][0]) for i, r in enumerate(root) if i != r)
        yield from streamed(schema, pairs())

    return by_key(grouped.select("key", "x", "y", "node", "size", "bits"), "key", "x", "y").mapInArrow(
        meet, "a bigint, b bigint")


def blocks_first(rows: DataFrame) -> DataFrame:
    """Groups (key, x, y) of the blocks of each key, the key's pivot in every block.

    ``rows`` has key, node, members (rows of the key) and pivot (one of its nodes).
    """
    count = F.ceil(F.col("members") / BLOCK).cast("long")
    every = F.sequence(F.lit(0).cast("long"), count - 1)
    own = F.array(F.pmod(F.xxhash64("node"), count))
    return rows.select("*", F.explode(F.when(F.col("node") == F.col("pivot"), every).otherwise(own)).alias("x")).withColumn(
        "y", F.col("x"))


def blocks_apart(rows: DataFrame) -> DataFrame:
    """Groups (key, x, y) in which all members of a key meet that have different parts.

    ``rows`` has key, node and part. Members of a key's largest part meet the others only.
    """
    per = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all")).where("top.n < `all`")
    placed = rows.join(top, "key").select(
        *[F.col(f"`{c}`") for c in rows.columns], (F.col("part") == F.col("top.part")).alias("_main"),
        F.ceil(F.col("top.n") / BLOCK).cast("long").alias("_mains"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("long").alias("_others"))
    # Blocks 0 .. others - 1 hold the other parts, the next ones the largest.
    own = F.when(F.col("_main"), F.col("_others") + F.pmod(F.xxhash64("node"), F.col("_mains"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("_others")))
    last = F.when(F.col("_main"), F.col("_others") - 1).otherwise(F.col("_others") + F.col("_mains") - 1)
    return placed.select("*", own.alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_facing")).select(
        *[F.col(f"`{c}`") for c in rows.columns], F.least("_own", "_facing").alias("x"), F.greatest("_own", "_facing").alias("y"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90,
                   slots: int = SLOTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, n_shingles, component) for every document row: its set's size and the
    least id it reaches by links of at least ``percent`` Jaccard similarity.

    ``carry`` names columns that go along with each row; then ``group`` is added too, one
    number per component (null for empty sets), which holds without ids or with repeated ones.
    """
    spark, shape = docs.sparkSession, Shape(n, percent)
    scratch = Scratch(spark, "ngrams")
    described = scratch.keep(_classes(docs, key, text, n, slots, carry), "rows")
    rows = described.where("block IS NULL").drop("block", "counts")
    seen = fixed.total(described.where("block IS NOT NULL").select("block", "counts"), slots)
    counts = spark.sparkContext.broadcast(np.minimum(seen, (1 << 32) - 1).astype(np.uint32))

    leading = scratch.keep(_prefixes(docs, text, shape, counts).where("node <> 0"), "leading")
    fitting = scratch.keep(_fitting(leading, shape), "fitting")
    scratch.drop(leading)
    # Of the groups with the same members one is enough.
    chosen = fitting.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("sum"),
        F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot <> other").groupBy(
        "n", "sum", "pivot", "other").agg(F.min("gram").alias("gram")).select(
        F.col("gram").alias("key"), F.col("n").alias("members"), "pivot")
    met = fitting.drop("size").withColumnRenamed("gram", "key").join(chosen, "key")
    facts = rows.where("node <> 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    members = scratch.keep(met.join(facts, "node"), "members")

    pairs = scratch.keep(_possible(blocks_first(members), shape), "pairs")
    clusters = connected(pairs, scratch)
    large = members.where(F.col("members") > BLOCK)
    if large.limit(1).count():
        parts = large.join(clusters, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
        pairs = pairs.unionByName(scratch.keep(_possible(blocks_apart(parts), shape), "pairs"))
        clusters = connected(pairs, scratch)

    sized = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    placed = scratch.keep(clusters.join(sized, "root").select(
        F.col("root").alias("key"), "node", "members", F.col("root").alias("pivot")), "clusters")
    first = blocks_first(placed)
    links = scratch.keep(_trees(first, _sets(docs, text, n, counts, rows, placed), shape), "links")
    parts = connected(links, scratch)
    large = placed.where(F.col("members") > BLOCK)
    if large.limit(1).count():
        apart = scratch.keep(blocks_apart(large.join(parts, "node", "left").withColumn(
            "part", F.coalesce("root", "node")).drop("root")), "apart")
        links = links.unionByName(scratch.keep(_trees(apart, _sets(docs, text, n, counts, rows, apart), shape), "links"))
        parts = connected(links, scratch)

    classes = rows.where("node <> 0").groupBy("node").agg(F.min("id").alias("least")).join(parts, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "least")
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component")), "root").select(
        "node", "component", F.col("root").alias("group"))
    return rows.join(named, "node", "left").select(
        "id", F.col("size").alias("n_shingles"),
        F.when(F.col("node") == 0, F.col("id")).otherwise(F.col("component")).alias("component"),
        *((*carry, "group") if carry else ()))
