"""Where events go: structured rows, readable lines, diagnostics, a recent view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.functions.render import diagnostic_line, log_line
from lifeline.operators.views import POSITION, recent, summary


def append_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Structured rows, partitioned by day so that later reads prune."""
    events.withColumn("event_date", F.to_date("event_time")).write.mode(mode) \
        .partitionBy("event_date").parquet(path)


def log_lines(events: DataFrame, show_ppid: bool = False, show_parent: bool = False) -> DataFrame:
    return events.withColumn("line", log_line(show_ppid, show_parent))


def _ordered(lines: DataFrame) -> DataFrame:
    """Each host's lines in its order; hosts are dealt to tasks by ranges, a long one to several."""
    return lines.repartitionByRange("host_id", "order_key.pos").sortWithinPartitions("host_id", "order_key").select("line")


def append_log(events: DataFrame, path: str, show_ppid: bool = False, show_parent: bool = False,
               mode: str = "append") -> None:
    """Readable lines, each host's in order from file to file; errors surface as job failures."""
    _ordered(log_lines(events, show_ppid, show_parent)).write.mode(mode).text(path)


def log_batches(path: str, show_ppid: bool = False, show_parent: bool = False):
    """Sink of a stream: the lines of each micro-batch in a folder of its own, so that a repeated one leaves one copy."""
    def write(events: DataFrame, batch: int) -> None:
        append_log(events, f"{path}/batch={batch}", show_ppid, show_parent, mode="overwrite")

    return write


def diagnostics(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == S.GAP).select(
        "host_id", "order_key", diagnostic_line().alias("line"))


def append_diagnostics(events: DataFrame, path: str, mode: str = "append") -> None:
    lines = events.where(F.col("kind") == S.GAP).withColumn("line", diagnostic_line())
    _ordered(lines).write.mode(mode).text(path)


def refresh_recent(previous: DataFrame | None, events: DataFrame, path: str) -> None:
    """Overwrite the recent view with the latest of the previous view and new events."""
    both = events if previous is None else previous.select(*events.columns).unionByName(events)
    recent(both).drop(POSITION).coalesce(1).write.mode("overwrite").parquet(path)


def recent_summary(view: DataFrame) -> DataFrame:
    return summary(view)
