"""Readable lines and the searchable text of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.functions.text import (
    base_name, blank_to_null, escape_controls, first_word, or_dash, padded, shorten,
)

# Column widths and labels of the readable log.
KIND_WIDTH, PID_WIDTH, PARENT_WIDTH = 6, 8, 24
LABELS = {S.START: "Start:", S.EXEC: "Exec:", S.STOP: "Stop:", S.GAP: "Gap:"}
OTHER_LABEL = "Event:"


def parent_executable(parent_chain: Column) -> Column:
    """Base name of the nearest parent's executable, or of its command's first word."""
    parent = F.get(parent_chain, F.lit(0))
    path = F.coalesce(
        blank_to_null(parent.getField("exe")), first_word(parent.getField("command"))
    )
    return F.coalesce(base_name(path), F.lit("-"))


def log_line(show_ppid: bool = False, show_parent: bool = False) -> Column:
    """One line per event, read from the columns of LIFECYCLE_EVENT."""
    text = or_dash(F.coalesce(
        blank_to_null(escape_controls(F.col("command"))), escape_controls(F.col("exe"))
    ))
    known = F.col("kind").isin(S.START, S.EXEC, S.STOP)
    label = F.lit(OTHER_LABEL)
    for kind, shown in LABELS.items():
        label = F.when(F.col("kind") == kind, F.lit(shown)).otherwise(label)
    number = lambda c: F.when(known, F.coalesce(c, F.lit(0)).cast("string")).otherwise("")
    cells = [padded(label, KIND_WIDTH), padded(number(F.col("pid")), PID_WIDTH)]
    if show_ppid:
        cells.append(padded(number(F.col("ppid")), PID_WIDTH))
    if show_parent:
        name = shorten(escape_controls(parent_executable(F.col("parent_chain"))), PARENT_WIDTH)
        cells.append(padded(F.when(known, name).otherwise(""), PARENT_WIDTH))
    message = escape_controls(F.coalesce(F.col("message"), F.lit("")))
    return F.concat_ws(" ", *cells, F.when(known, text).otherwise(message))


def diagnostic_line() -> Column:
    return F.concat(
        F.lit("backend="), F.coalesce(F.col("backend"), F.lit("")),
        F.lit(" diagnostic="), F.coalesce(F.col("message"), F.lit("")),
    )


def fallback_line(backend: Column, error: Column) -> Column:
    return F.concat(
        F.lit("backend="), backend, F.lit(f" fallback={S.POLL} reason="),
        F.coalesce(error, F.lit("")),
    )


def search_text() -> Column:
    """Lower-case text of an event and its ancestors, one value per line."""
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    own = F.array(
        *[text(F.col(n)) for n in
          ("kind", "process_id", "command", "exe", "cwd", "user", "uid", "tty", "session")],
        number(F.col("pid")), number(F.col("ppid")), text(F.col("message")),
    )
    ancestors = F.flatten(F.transform(
        F.coalesce(F.col("parent_chain"), F.array().cast("array<" + S.SUMMARY.simpleString() + ">")),
        lambda p: F.array(text(p["command"]), text(p["exe"]), text(p["user"]), number(p["pid"])),
    ))
    return F.lower(F.array_join(F.concat(own, ancestors), "\n"))
