"""Line-first cleaning of documents, in DataFrame functions only.

Every line is judged on its own: punctuation rules (no sentence end, or too many
decorated words), navigation rules (separators between most words, or a bare menu
entry) and boilerplate rules (fixed site phrases). Failing lines are removed; a
document that loses too much of its text that way is rejected. Document statistics
(words, symbols, repeated lines and repeated five-word windows) fail it beforehand.

No shuffle: each document is one row from scan to result, and each step is linear or
sorts the windows of one text. Defined results: a null text counts as empty; an empty
text has zero counts, ``base_failed`` and is not kept; repeated rows are judged each
on its own; an empty table gives an empty table; input columns named like an added
column are replaced by it, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeline.llm.columns import SPACE, characters, let, occurrences, whole_text, unused, without, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"""[.!?…。！？]["'”’»)\]]*([\x20\x09-\x0D]|$)"""
DECORATION = r"[#*$%&!?|<>~=_]{2,}"
SEPARATOR = r"[|»›•·]"
MENU_ENTRY = (r"(?i)^[\x20\x09-\x0D]*(home|menu|search|log ?in|sign (in|up)|register|next|previous|share|"
              r"read more|back to top|skip to (main )?content|contact( us)?|about( us)?)[\x20\x09-\x0D]*$")
BOILERPLATE = (r"(?i)(all rights reserved|(privacy|cookie) policy|uses cookies|terms of (use|service)|"
               r"(enable|requires) javascript|lorem ipsum|click here|subscribe to our|sign up for our newsletter)")
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
         "n_lines", "n_bad_punctuation", "n_navigation", "n_boilerplate", "line_chars", "clean_chars",
         "clean_text", "kept")


def repeated_words(found: Column) -> Column:
    """Words inside five-word windows that occur at least twice in the text."""
    hashed = F.transform(found, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def starts(s: Column) -> Column:
            def twice(x: Column, i: Column) -> Column:
                return F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(
                    x["h"] == F.get(s, i + 1)["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["at"]))

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.coalesce(
                F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(let(ordered, starts), spread)).otherwise(
            F.lit(0).cast("long"))

    return F.when(F.size(found) > WINDOW, let(let(hashed, windows), covered)).otherwise(F.lit(0).cast("long"))


def line_verdict(line: Column) -> Column:
    """The first rule a line fails, or null."""
    n = occurrences(line, f"[^{SPACE}]+")
    return (
        F.when(line.rlike(BOILERPLATE), "boilerplate")
        .when((occurrences(line, SEPARATOR) * 4 >= n) | line.rlike(MENU_ENTRY), "navigation")
        .when(~line.rlike(SENTENCE_END) | (occurrences(line, DECORATION) * 4 >= n), "punctuation")
    )


def quality_rules(docs: DataFrame, text: str = "text", max_lost: float = 0.3, min_words: int = 10,
                  max_repeat_percent: int = 20) -> DataFrame:
    """Add the statistics, the cleaned text and ``kept`` to each document.

    Blank lines neither fail nor count as lost. ``max_lost`` is the share of the
    characters of non-blank lines that may be removed.
    """
    whole = whole_text(F.col(f"`{text}`"))
    text_, words_, lines_, judged_ = unused(docs, "_text", "_words", "_lines", "_judged")
    judged = docs.select(
        "*", whole.alias(text_), words(whole).alias(words_),
        F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias(lines_))
    judged = judged.select("*", F.transform(lines_, lambda x: F.struct(
        x.alias("line"), line_verdict(x).alias("rule"))).alias(judged_))

    def failing(rule: str) -> Column:
        return F.size(F.filter(judged_, lambda x: x["rule"] == rule)).cast("long")

    def chars(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    good = F.transform(F.filter(judged_, lambda x: x["rule"].isNull()), lambda x: x["line"])
    counted = judged.select(
        *[F.col(f"`{c}`") for c in without(docs, *ADDED).columns],
        F.size(words_).cast("long").alias("n_words"),
        F.length(F.translate(text_, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        characters(F.col(text_), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(words_)).alias("n_repeat_words"),
        F.size(lines_).cast("long").alias("n_lines"),
        failing("punctuation").alias("n_bad_punctuation"),
        failing("navigation").alias("n_navigation"),
        failing("boilerplate").alias("n_boilerplate"),
        chars(F.col(lines_)).alias("line_chars"),
        chars(good).alias("clean_chars"),
        F.array_join(good, "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    lost = (F.col("line_chars") - F.col("clean_chars")) > F.col("line_chars") * F.lit(float(max_lost))
    return counted.select("*", failed.alias("base_failed"), (~failed & ~lost).alias("kept"))
