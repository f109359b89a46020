"""Small column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times.

    A plain column used inside a lambda is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def characters(text: Column, chosen: str) -> Column:
    """How many characters of the text are among the chosen ones."""
    return F.length(text) - F.length(F.translate(text, chosen, ""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator is about to add, whatever their case."""
    new = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of the input has them, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found
