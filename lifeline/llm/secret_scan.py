"""Secrets in texts: fixed shapes, and random-looking strings told by character models.

Two first-order Markov models of characters are trained from labelled strings: one of
random strings (values of the fixed shapes found in the sample, and generated
hexadecimal, base 32, base 62 and base 64 strings), one of ordinary identifiers (the other words
of the sample, and neighbouring words joined the ways identifiers are). A candidate is a long run
of token characters; the log-likelihood ratio of the two models, summed over its
transitions, decides. DataFrame functions only.

Training uses the texts of about ``sample`` rows, chosen by hash (documented bound); the
scan reads all of every text. No shuffle in the scan: each row is judged on its own.

Offsets are code points. Defined results: null and empty texts have no spans; repeated
rows are judged each on its own; an empty table gives an empty table, and a model
trained on generated strings and smoothing alone; input columns named like an added
one are replaced. Places of many spans in one text cost their number, and its 64th
part squared in reference copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeline.llm.columns import let, unused, whole_text, without

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]{16,})"
HEX = r"()((?<![0-9a-f])[0-9a-f]{24,})"
CANDIDATE = r"()((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,})"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SIZE = len(ALPHABET) + 1                                 # and one for any other character
LEAST_VALUE = 6
BLOCK = 64                                               # matches whose places are summed together
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
ADDED = (*KINDS, "n_assign", "n_access", "n_hex", "n_random")


def marked_spans(text: Column, pattern: str, least: int = 1) -> Column:
    """Leftmost non-overlapping matches with places; group 2 must have ``least`` characters.

    Matches are wrapped in control characters that the text itself no longer has, and the
    lengths of the pieces between them add up to the places: first over blocks of pieces,
    then inside each block, so that no array grows match by match.
    """
    def step(state: Column, piece: Column) -> Column:
        head = F.instr(piece, "\x02") - 1
        tail = F.instr(piece, "\x03") - 1
        start, end = state["at"], state["at"] + tail - 1
        span = F.array(F.struct(
            start.alias("start"), end.alias("end"),
            F.substring(piece, head + 2, tail - head - 1).alias("value")))
        return F.struct(
            (state["at"] + F.length(piece) - 2).alias("at"),
            F.when(tail - head - 1 >= least, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    def of_block(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])

    def places(blocks: Column, first: Column) -> Column:
        """Where each block begins, and behind them the end of the text."""
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, p: n + F.length(p) - 2))
        return F.aggregate(sizes, F.array(first), lambda known, n: F.concat(known, F.array(F.element_at(known, -1) + n)))

    def spans(pieces: Column) -> Column:
        first = F.length(F.get(pieces, F.lit(0))).cast("long")
        blocks = F.transform(F.sequence(F.lit(2), F.size(pieces), F.lit(BLOCK)), lambda i: F.slice(pieces, i, F.lit(BLOCK)))
        several = let(blocks, lambda b: F.flatten(F.zip_with(b, F.slice(places(b, first), F.lit(1), F.size(b)), of_block)))
        few = of_block(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), first)
        return F.when(F.size(pieces) <= BLOCK, few).otherwise(several)

    return let(F.split(F.regexp_replace(text, pattern, "\x01$1\x02$2\x03"), "\x01", -1), spans)


def shaped(docs: DataFrame, text: str, clean: str = "_clean") -> DataFrame:
    """Add the text without marks, as ``clean``, and the spans of the fixed shapes."""
    plain = F.regexp_replace(whole_text(F.col(f"`{text}`")), "[\x01-\x03]", "\x04")
    found = without(docs, *ADDED).select("*", plain.alias(clean))
    return found.select(
        "*", marked_spans(F.col(clean), ASSIGN, LEAST_VALUE).alias("assign"),
        F.when(F.contains(clean, F.lit("AKIA")), marked_spans(F.col(clean), ACCESS)).otherwise(
            F.array().cast(SPAN)).alias("access"),
        marked_spans(F.col(clean), HEX).alias("hex"))


def codes(value: Column) -> Column:
    """The places of a string's characters in the alphabet."""
    return F.transform(F.split(value, ""), lambda c: F.when(
        F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(F.lit(SIZE - 1)))


def transitions(value: Column) -> Column:
    """Numbers of the pairs of neighbouring characters."""
    return F.get(F.transform(F.array(codes(value)), lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))),
        lambda i: F.get(c, i - 1) * SIZE + F.coalesce(F.get(c, i), F.lit(SIZE - 1)))), F.lit(0))


def labelled_strings(docs: DataFrame, text: str, key: str, sample: int, generated: int) -> DataFrame:
    """Rows (value, random) of the training sample."""
    spark = docs.sparkSession
    share = max(1, docs.count() // max(1, sample))
    rows = shaped(docs.where(F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(share)) == 0).select(F.col(f"`{text}`").alias("text")), "text")
    values = rows.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select("s.value")
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.col("_clean"), ASSIGN, " "), HEX, " "), r"[^A-Za-z]+"),
                     lambda w: F.length(w) >= 3)
    names = rows.select(words.alias("w")).select(F.explode(F.transform("w", lambda x, i: F.concat(
        F.lower(x), F.when(i % 3 == 0, "_").otherwise(""), F.when(i % 3 == 1, F.initcap(F.coalesce(F.get("w", i + 1), F.lit(""))))
        .otherwise(F.lower(F.coalesce(F.get("w", i + 1), F.lit(""))))))).alias("value"))
    n = F.col("id").cast("string")
    digits = F.sha2(n, 512)
    made = spark.range(generated).select(F.explode(F.array(
        digits, F.upper(F.conv(F.substring(digits, 1, 15), 16, 36)),
        F.regexp_replace(F.base64(F.unhex(digits)), "=", ""),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(n, F.lit("+")), 256))), "[=+/]", ""))).alias("value"))
    return values.unionByName(made).select("value", F.lit(True).alias("random")).unionByName(
        names.select("value", F.lit(False).alias("random")))


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of every transition, as text (random over ordinary)."""

    ratios: str

    def score(self, value: Column) -> Column:
        table = F.split(F.lit(self.ratios), ",").cast("array<double>")
        return F.aggregate(transitions(value), F.lit(0.0), lambda a, t: a + F.get(table, t))


def train(labelled: DataFrame, smoothing: float = 0.5) -> Models:
    """Transition counts of both classes; the driver receives one row of fixed size."""
    counts = labelled.select("random", F.explode(transitions(F.col("value"))).alias("t")).groupBy("t").agg(
        F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    every = labelled.sparkSession.range(SIZE * SIZE).join(counts, F.col("id") == F.col("t"), "left").select(
        "id", F.floor(F.col("id") / SIZE).alias("c"), (F.coalesce("r", F.lit(0)) + smoothing).alias("r"),
        (F.coalesce("o", F.lit(0)) + smoothing).alias("o"))
    rows = every.groupBy("c").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    ratio = F.round(F.log(F.col("r") / F.col("rs")) - F.log(F.col("o") / F.col("os")), 6).cast("string")
    listed = every.join(rows, "c").agg(F.sort_array(F.collect_list(F.struct("id", ratio.alias("x")))).alias("all"))
    return Models(listed.select(F.array_join(F.transform("all", lambda s: s["x"]), ",")).first()[0])


def scan(docs: DataFrame, models: Models, text: str = "text", least_ratio: float = 12.0, least_mean: float = 0.6) -> DataFrame:
    """Add the spans of every kind; ``random`` ones overlap none of the fixed shapes.

    A candidate counts with a summed ratio of at least ``least_ratio`` and an average of
    ``least_mean`` a transition, and if it mixes letters with digits or cases.
    """
    clean_, base_, long_ = unused(docs, "_clean", "_base", "_long")
    found = shaped(docs, text, clean_)
    base = F.concat("assign", "access", "hex")

    def fits(s: Column) -> Column:
        mixed = s["value"].rlike("[A-Za-z]") & (s["value"].rlike("[0-9]") | (s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")))
        score = models.score(s["value"])
        clear = ~F.exists(base_, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return mixed & clear & (score >= F.greatest(F.lit(float(least_ratio)), F.lit(float(least_mean)) * (s["end"] - s["start"])))

    kept = [F.col(f"`{c}`") for c in without(docs, *ADDED).columns]
    return found.select("*", base.alias(base_), marked_spans(F.col(clean_), CANDIDATE).alias(long_)).select(
        *kept, "assign", "access", "hex", F.filter(long_, fits).alias("random"))


def joined(*kinds: str) -> Column:
    """Spans as kind:start:end by start, then by kind as listed."""
    def listed(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("kind"),
            F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("text")))

    parts = [listed(i, kind) for i, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: s["text"]), ",")


def default_models(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 2000, generated: int = 2000) -> Models:
    return train(labelled_strings(docs, text, key, sample, generated))
