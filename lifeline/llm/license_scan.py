"""Licences of documents: header passages by TF-IDF cosine, then inheritance by path.

A passage is a line that holds a word of the templates' rarest ones (their anchors). Its
words, and those of every template, become sparse TF-IDF vectors; words are weighted by
their frequency among all passages. The best template names the passage's licence if the
cosine is high enough. A document with a licence of its own has the one of its best
passage. A document that mostly consists of such passages, or has the name of a licence
file, also speaks for its directory: every other document without a licence inherits
from the nearest directory above it, by joining the list of its own directories.

DataFrame functions only. Texts are never shuffled: passages are cut out where the text
is, words are joined with the broadcast template vocabulary (the templates are a
parameter; at most ``MOST_WORDS`` rows, checked), and a directory gives at most one row to
the joins, so a hot directory multiplies nothing.

Defined results: null and empty texts have no passage; null paths have no directory, and
inherit nothing; ties go to the first template by name, and to the shorter passage
number; several licence files of one directory count by best cosine, then name; repeated
rows are judged each on its own; an empty table gives an empty table; input columns named
like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeline.llm.columns import unused, whole_text, without
from lifeline.llm.store import Scratch

# Licence notices as they are commonly written; fixed values.
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms are permitted under the BSD License.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under the CC0 1.0 Universal dedication.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, under the MIT License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
}
ANCHOR = r"(?i)(licen[cs]ed?|copyright|redistribution|permission|public domain|creative commons|\bcc0\b)"
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
MOST_WORDS = 10_000
ADDED = ("n_passages", "own_licence", "own_cosine", "licence", "inherited_from", "is_licence_file")


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits; dots and hyphens inside a word split it."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def template_terms(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (licence, variant, term, tf)."""
    listed = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(i).alias("variant"), F.lit(text).alias("text"))
                       for name, texts in sorted(templates.items()) for i, text in enumerate(texts)])
    rows = spark.range(1).select(F.explode(listed).alias("t")).select(
        "t.licence", "t.variant", F.explode(terms(F.col("t.text"))).alias("term"))
    counted = rows.groupBy("licence", "variant", "term").agg(F.count(F.lit(1)).alias("tf"))
    if counted.count() > MOST_WORDS:
        raise ValueError("too many template words to broadcast")
    return counted


def passages(docs: DataFrame, key: Column, text: str) -> DataFrame:
    """Rows (row, line, term, tf, words) of the lines that hold an anchor."""
    lines = F.filter(F.transform(F.split(whole_text(F.col(f"`{text}`")), "\n", -1), lambda x, i: F.struct(
        i.alias("line"), x.alias("text"))), lambda s: s["text"].rlike(ANCHOR))
    cut = docs.where(F.col(f"`{text}`").rlike(ANCHOR)).select(key.alias("row"), F.explode(lines).alias("p"))
    return cut.select("row", F.col("p.line").alias("line"), terms(F.col("p.text")).alias("all")).select(
        "row", "line", F.size("all").alias("words"), F.explode("all").alias("term")).groupBy("row", "line", "words", "term").agg(
        F.count(F.lit(1)).alias("tf"))


def cosines(found: DataFrame, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (row, line, words, licence, cosine): the best template of each passage."""
    spark = found.sparkSession
    of_templates = template_terms(spark, templates)
    vocabulary = of_templates.select("term").distinct()
    n = found.select("row", "line").distinct().count()
    df = found.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One row per template word: bounded.
    idf = vocabulary.join(df, "term", "left").select(
        "term", (F.log(F.lit(1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    rare = F.log(F.lit(1.0 + n)) + 1
    weighted = of_templates.join(idf, "term").select("licence", "variant", "term", (F.col("tf") * F.col("idf")).alias("w"), "idf")
    norms = weighted.groupBy("licence", "variant").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    vectors = weighted.join(norms, ["licence", "variant"])
    scored = found.join(F.broadcast(idf), "term", "left").select(
        "row", "line", "words", "term", (F.col("tf") * F.coalesce("idf", rare)).alias("v"))
    lengths = scored.groupBy("row", "line", "words").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    products = scored.join(F.broadcast(vectors), "term").groupBy("row", "line", "licence", "variant", "t_norm").agg(
        F.sum(F.col("v") * F.col("w")).alias("product"))
    each = products.join(lengths, ["row", "line"]).select(
        "row", "line", "words", "licence", F.round(F.col("product") / (F.col("norm") * F.col("t_norm")), 6).alias("cosine"))
    best = F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), F.col("licence")))
    return each.groupBy("row", "line", "words").agg(best.alias("b")).select("row", "line", "words", "b.licence", "b.cosine")


def directories(path: Column) -> Column:
    """The directories above a file, the nearest first; the root is the empty text."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, F.size(parts) - i), "/"))


def scan(docs: DataFrame, path: Column, key: str = "doc_id", text: str = "text", least: float = 0.75,
         file_share: float = 0.5, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Add the licence columns to every row of ``docs``; the text is left out."""
    raw = without(docs, *ADDED)
    row_, path_, size_, in_, best_, dir_, near_ = unused(raw, "_row", "_path", "_size", "_in", "_best", "_dir", "_near")
    # A row is known by its key and digest: null or repeated keys do not mix texts.
    row = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    size = F.size(F.filter(F.split(whole_text(F.col(f"`{text}`")), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""))
    found = passages(raw, row, text)
    copies = raw.where(F.col(f"`{text}`").rlike(ANCHOR)).groupBy(row.alias("row")).agg(F.count(F.lit(1)).alias("copies"))
    found = Scratch(docs.sparkSession, "licences").keep(
        found.join(copies, "row").withColumn("tf", (F.col("tf") / F.col("copies")).cast("long")).drop("copies"), "passages")
    good = cosines(found, templates).where(F.col("cosine") >= least)
    of_row = good.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum("words").alias(in_),
        F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), F.col("licence"), F.col("line"))).alias(best_))
    kept = [F.col(f"`{c}`") for c in raw.columns if c != text]
    rows = raw.select(*kept, row.alias(row_), path.alias(path_),
                      F.when(F.col(f"`{text}`").rlike(ANCHOR), size).otherwise(F.lit(0)).alias(size_))
    judged = rows.join(of_row.withColumnRenamed("row", row_), row_, "left").select(
        *kept, path_, F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
        F.col(best_)["licence"].alias("own_licence"), F.col(best_)["cosine"].alias("own_cosine"),
        (F.col(best_).isNotNull() & (F.element_at(F.split(path_, "/"), -1).rlike(FILE_NAME) | (
            F.col(in_) >= F.col(size_) * F.lit(file_share)))).alias("is_licence_file"))
    judged = judged.withColumn("is_licence_file", F.coalesce("is_licence_file", F.lit(False)))
    files = judged.where(F.col("is_licence_file") & F.col(path_).isNotNull()).select(
        F.get(directories(F.col(path_)), F.lit(0)).alias("_dir"), "own_licence", "own_cosine")
    speaks = files.groupBy("_dir").agg(F.min_by("own_licence", F.struct(-F.col("own_cosine"), F.col("own_licence"))).alias("_licence"))
    # Without a licence of its own: the directories of many rows are the same few, so each
    # distinct directory is looked up once.
    places = judged.where(F.col("own_licence").isNull() & F.col(path_).isNotNull()).select(
        F.get(directories(F.col(path_)), F.lit(0)).alias("_dir")).distinct()
    above = places.select("_dir", F.posexplode(F.concat(F.array("_dir"), F.when(
        F.col("_dir") != "", directories(F.col("_dir"))).otherwise(F.array().cast("array<string>")))).alias("_far", "_up"))
    nearest = above.join(speaks.withColumnRenamed("_dir", "_up"), "_up").groupBy("_dir").agg(
        F.min(F.struct("_far", "_up", "_licence")).alias(near_)).withColumnRenamed("_dir", dir_)
    home = F.when(F.col("own_licence").isNull(), F.get(directories(F.col(path_)), F.lit(0)))
    return judged.withColumn(dir_, home).join(nearest, dir_, "left").select(
        *kept, "n_passages", "own_licence", "own_cosine", "is_licence_file",
        F.coalesce("own_licence", F.col(near_)["_licence"]).alias("licence"), F.col(near_)["_up"].alias("inherited_from"))
