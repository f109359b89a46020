"""Bounded, searchable and sortable views of an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeline.functions.render import search_text

RETAINED = 2048  # fixed value: events a recent view keeps
TIMELINE, DURATION, PID, COMMAND = "timeline", "duration", "pid", "command"
POSITION = "arrival"


def arrivals(events: DataFrame) -> DataFrame:
    """Add the comparable arrival position of each event of the whole stream."""
    return events.withColumn(POSITION, F.struct("order_key", "host_id", "kind"))


def recent(events: DataFrame, retained: int = RETAINED) -> DataFrame:
    """The latest arrivals, kept before any filter (a top-k; no full sort)."""
    return arrivals(events).orderBy(F.col(POSITION).desc()).limit(retained)


def recent_per_host(events: DataFrame, retained: int = RETAINED) -> DataFrame:
    """The latest arrivals of each host.

    Spark turns ``row_number <= k`` into a group limit before the shuffle, so a
    hot host sends at most k rows per task.
    """
    order = Window.partitionBy("host_id").orderBy(F.col(POSITION).desc())
    return arrivals(events).withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= retained).drop("_n")


def matching(events: DataFrame, needle: str) -> DataFrame:
    """Events whose text, or whose ancestors' text, contains the needle in any case."""
    if not needle:
        return events
    return events.where(F.contains(search_text(), F.lower(F.lit(needle))))


def sort_columns(mode: str = TIMELINE) -> list[Column]:
    """Ascending arrival breaks every tie."""
    first = {
        TIMELINE: [], DURATION: [F.coalesce("duration_ms", F.lit(0)).desc()],
        PID: [F.coalesce("pid", F.lit(0)).asc()], COMMAND: [F.lower(F.coalesce("command", F.lit(""))).asc()],
    }[mode]
    return [*first, F.col(POSITION).asc()]


def reversed_columns(mode: str = TIMELINE) -> list[Column]:
    first = {
        TIMELINE: [], DURATION: [F.coalesce("duration_ms", F.lit(0)).asc()],
        PID: [F.coalesce("pid", F.lit(0)).desc()], COMMAND: [F.lower(F.coalesce("command", F.lit(""))).desc()],
    }[mode]
    return [*first, F.col(POSITION).desc()]


def page(view: DataFrame, mode: str = TIMELINE, scroll: int = 0, limit: int = 20) -> DataFrame:
    """The last ``limit`` rows of the sorted view, moved back by ``scroll`` rows.

    ``selected`` marks the last visible row.
    """
    taken = view.orderBy(*reversed_columns(mode)).offset(scroll).limit(limit)
    order = Window.orderBy(*reversed_columns(mode))  # over at most ``limit`` rows
    return taken.withColumn("selected", F.row_number().over(order) == 1).orderBy(*sort_columns(mode))


def clamp_scroll(scroll: int, rows: int) -> int:
    return max(0, min(scroll, rows - 1))


def summary(view: DataFrame) -> DataFrame:
    """Latest known source and number of retained (not of filtered) events."""
    named = F.when(F.coalesce("backend", F.lit("")) != "", F.col(POSITION))
    return view.agg(
        F.max_by("backend", named).alias("backend"), F.count(F.lit(1)).alias("events")
    )
