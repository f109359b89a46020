"""Divergence of the sources of a language, by term frequencies.

Frequencies come from single-pass in-memory indexing. A task adds the terms of its
documents to a dictionary of postings (source, count, documents) until that holds
``BLOCK`` postings, writes it out as a run in term order, and starts anew. Runs are dealt
by a hash of (language, term), so a shard holds every run of its terms; Spark's
external sort merges them there, and equal neighbours are added up.

A language keeps the terms in at least ``MIN_DOCS`` of its documents, V of them. With
count >= 0 of a term in a group (language, source) and N the group's sum over kept
terms, p = 1 + floor(SCALE * (count + 5) / (N + 5 V)), all in integers. The distance of
two groups sums abs(p - q) over all kept terms. It is never formed term by term for
all pairs: for terms that neither holds it is V * abs(p0 - q0), p0 being p of count
0; what a group's own terms change against another's p0 follows from the histogram of
its p; only terms that both hold need to meet, and those corrections are summed inside
the tasks as the terms' postings stream by.

Rows: null text, language and source count as empty texts; an empty table gives no rows;
repeated rows count again; groups without any term take part with count 0; other columns
are ignored, whatever they are called. Equal values rank by the bytes of the item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeline.llm.store import Scratch

SCALE = 1_000_000_000
PRIOR = 5
MIN_DOCS = 30
#: Postings that a task holds before it writes a run.
BLOCK = 600_000
#: Characters of a long text that are split at a time.
PIECE = 1 << 20
#: Sources of a tile of the pair corrections, and tiles that a task holds before it sends them on.
TILE = 512
TILES = 16

#: UTF-8 bytes of terms, A-Z folded; all others become blanks.
FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: A posting is one number: occurrences, and documents from this bit on.
ONE = 1 << 40
RUN = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
CORRECTION = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64())])


def terms_of(text: bytes) -> Counter:
    """Counts of a text's terms; a long text is split piece by piece, between terms."""
    text = text.translate(FOLDED)
    if len(text) <= PIECE:
        return Counter(text.split())
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) % (len(text) + 1)       # not found: the text's end
        counts.update(text[at:end].split())
        at = end
    return counts


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of postings, of each group in term order; a row without a term records a group."""
    block: dict[tuple[str, str], dict[bytes, int]] = {}
    held = 0

    def run() -> Iterator[pa.RecordBatch]:
        for (lang, source), postings in block.items():
            terms = sorted(postings)
            numbers = np.fromiter(map(postings.__getitem__, terms), np.int64, len(terms))
            columns = [
                pa.repeat(pa.scalar(lang, pa.string()), len(terms) + 1), pa.repeat(pa.scalar(source, pa.string()), len(terms) + 1),
                pa.array([*terms, None], pa.binary()).cast(pa.string()),
                pa.array(np.append(numbers % ONE, 0)), pa.array(np.append(numbers // ONE, 0))]
            yield from pa.table(columns, schema=RUN).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text")):
            postings = block.setdefault((lang, source), {})
            held -= len(postings)
            known = postings.get
            for term, n in terms_of(text.as_buffer().to_pybytes()).items():
                postings[term] = known(term, 0) + n + ONE
            held += len(postings)
            if held >= BLOCK:
                yield from run()
                block, held = {}, 0
    if block:
        yield from run()


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), digits by threes:
    no product passes a thousand times the divisor."""
    below = total + terms * PRIOR
    rest, whole = count + PRIOR, F.lit(0).cast("long")
    for _ in range(3):
        grown = rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", grown, below), grown % below
    return whole + 1


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms that two sources of a language hold, for each such pair (a < b).

    A term's row has the numbers of its sources, their p and p0. A tile holds the sums of
    two ranges of numbers; when a task holds ``TILES`` of them, they are sent on.
    """
    tiles: dict[tuple[str, int, int], np.ndarray] = {}

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, x, y), tile in tiles.items():
            a, b = np.nonzero(tile)
            if len(a):
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(a), pa.string()), pa.array(a + x * TILE), pa.array(b + y * TILE),
                    pa.array(tile[a, b])], schema=CORRECTION)
        tiles.clear()

    for batch in batches:
        for lang, number, p, p0 in zip(*(batch.column(c).to_pylist() for c in ("lang", "number", "p", "p0"))):
            number, p, p0 = np.array(number), np.array(p), np.array(p0)
            order = np.argsort(number)
            number, p, p0 = number[order], p[order], p0[order]
            starts = np.flatnonzero(np.diff(number // TILE, prepend=-1))
            ranges = [(int(number[s]) // TILE, slice(s, e)) for s, e in zip(starts, [*starts[1:], len(number)])]
            for i, (x, a) in enumerate(ranges):
                for y, b in ranges[i:]:
                    both = (np.abs(p[a, None] - p[b]) - np.abs(p[a, None] - p0[b]) - np.abs(p0[a, None] - p[b])
                            + np.abs(p0[a, None] - p0[b]))
                    if x == y:
                        both = np.triu(both, 1)
                    if (lang, x, y) not in tiles:
                        if len(tiles) >= TILES:
                            yield from send()
                        tiles[lang, x, y] = np.zeros((TILE, TILE), np.int64)
                    tiles[lang, x, y][np.ix_(number[a] - x * TILE, number[b] - y * TILE)] += both
    yield from send()


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (lang, source, term, n, of_lang) of the terms that each language keeps, and a
    row without a term for every group."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(name)
                         for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    # Both aggregations and the window run in one shard: they need the rows of a (language, term) together, no more.
    shards = rows.mapInArrow(runs, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    merged = shards.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return merged.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("of_lang"), F.sum("docs").over(term).alias("in_docs")
    ).where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).drop("in_docs")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): the distance of every other source of
    the language (part ``pair``), and the ``top`` terms that a group has more of than its
    language (part ``term``)."""
    scratch = Scratch(docs.sparkSession, "audit")
    freq = scratch.keep(frequencies(docs, text, lang, source, min_docs), "frequencies")

    # One row per group: its total, and the language's terms and total.
    groups = freq.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = freq.where("term IS NOT NULL").groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("of_lang_total"))
    zero = F.lit(0).cast("long")
    order = Window.partitionBy("lang").orderBy("source")
    groups = groups.join(langs, "lang", "left").select(
        "lang", "source", "total", F.coalesce("terms", zero).alias("terms"), F.coalesce("of_lang_total", zero).alias("of_lang_total"),
        (F.row_number().over(order) - 1).cast("long").alias("number"),
        F.when(F.col("terms") > 0, probability(zero, F.col("total"), F.col("terms"))).otherwise(zero).alias("p0"))
    groups = scratch.keep(groups, "groups")

    held = freq.where("n > 0").join(groups, ["lang", "source"]).select(
        "lang", "source", "number", "term", "p0", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        probability(F.col("of_lang"), F.col("of_lang_total"), F.col("terms")).alias("q"))
    held = scratch.keep(held, "held")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    shared = held.groupBy("lang", "term").agg(
        F.collect_list(F.struct("number", "p", "p0")).alias("all")).where(F.size("all") > 1).select(
        "lang", F.col("all.number").alias("number"), F.col("all.p").alias("p"), F.col("all.p0").alias("p0"))
    both = shared.mapInArrow(corrections, "lang string, a long, b long, both long").groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))

    # A group's own terms against another's p0: a sum over the different p of the group.
    own = held.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "source").agg(
        F.collect_list(F.struct("p", "n")).alias("histogram"))
    sides = groups.join(own, ["lang", "source"], "left").select(
        "lang", "source", "number", "terms", "p0", F.coalesce("histogram", F.array().cast("array<struct<p:bigint,n:bigint>>")).alias("histogram"))
    a, b = (sides.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in sides.columns[1:]]) for s in "ab")

    def against(histogram: str, mine: Column, other: Column) -> Column:
        return F.aggregate(histogram, zero, lambda s, x: s + x["n"] * (F.abs(x["p"] - other) - F.abs(mine - other)))

    p, q = F.col("p0_a"), F.col("p0_b")
    # One row per pair of the result, made once and read from both of its sides.
    pairs = a.join(b, "lang").where("number_a < number_b").join(
        both.select("lang", F.col("a").alias("number_a"), F.col("b").alias("number_b"), "both"), ["lang", "number_a", "number_b"], "left").select(
        "lang", "source_a", "source_b",
        (F.col("terms_a") * F.abs(p - q) + against("histogram_a", p, q) + against("histogram_b", q, p) + F.coalesce("both", zero)).alias("value"))
    ends = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                             F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = pairs.select("lang", ends.alias("end"), "value").select(
        "lang", "end.source", F.lit("pair").alias("part"), "end.item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(words)
