"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters that are escaped in terminal text.
CONTROL = "[\\x{00}-\\x{1f}\\x{7f}-\\x{9f}]"
MISSING = "-"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` removes only spaces)."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def words(c: Column) -> Column:
    """Split on runs of white space; no empty words."""
    return F.filter(F.split(c, "(?U)\\s+"), lambda w: w != "")


def first_word(c: Column) -> Column:
    return F.get(words(c), F.lit(0))


def joined_or(parts: Column, fallback: Column) -> Column:
    """Non-empty parts joined by one space, else the fallback."""
    return F.coalesce(blank_to_null(F.array_join(F.filter(parts, lambda p: p != ""), " ")), fallback)


def or_dash(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(MISSING))


def escape_controls(c: Column) -> Column:
    """Write control characters as \\xhh; text without any is passed through."""
    code = lambda ch: F.ascii(ch)
    escaped = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(
                ch.rlike(CONTROL), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(code(ch)), 2, "0")))
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(CONTROL), escaped).otherwise(c)


def shorten(c: Column, width: int) -> Column:
    """At most ``width`` characters, marking a cut with three dots if they fit."""
    cut = F.left(c, F.lit(width)) if width <= 3 else F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))
    return F.when(F.char_length(c) <= width, c).otherwise(cut)


def padded(c: Column, width: int) -> Column:
    """Pad on the right to ``width`` without ever cutting."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.char_length(c), F.lit(0))))


def base_name(c: Column) -> Column:
    """Last element of a path; ``.`` if empty, ``/`` if only slashes."""
    bare = F.regexp_replace(c, "/+$", "")
    return (
        F.when(c == "", F.lit("."))
        .when(bare == "", F.lit("/"))
        .otherwise(F.element_at(F.split(bare, "/"), -1))
    )
