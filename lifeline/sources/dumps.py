"""Process tables landed as text: ``ps`` listings and ``/proc`` files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeline.functions.clock import start_ns_of_ticks
from lifeline.functions.identity import process_id
from lifeline.functions.text import blank_to_null, joined_or, words
from lifeline.sources.tables import captured, integer

# Field positions after the command of a stat line, and how many there must be.
STAT_FIELDS, STAT_PPID, STAT_SESSION, STAT_TTY, STAT_START = 20, 1, 3, 4, 19


def ps_lines(lines: DataFrame) -> DataFrame:
    """Parse ``ps`` lines (PID, parent, user, command...); ``reject`` tells why a line is unusable.

    ``lines`` has ``line`` and optionally ``collector_pid``; other columns stay.
    """
    cells = words(F.col("line"))
    parsed = lines.withColumn("_w", cells).withColumns({
        "pid": integer(F.get("_w", F.lit(0))), "ppid": integer(F.get("_w", F.lit(1))),
    })
    collector = F.col("collector_pid") if "collector_pid" in lines.columns else F.lit(None)
    reject = (
        F.when(F.size("_w") < 4, "fewer than four fields")
        .when(F.col("pid").isNull(), "PID is not an integer")
        .when(F.col("ppid").isNull(), "parent PID is not an integer")
        .when(F.coalesce(F.col("pid") == collector, F.lit(False)), "collector")
    )
    return captured(parsed.withColumns({
        "reject": reject, "process_id": F.col("pid").cast("string"),
        "user": F.get("_w", F.lit(2)), "exe": F.get("_w", F.lit(3)),
        "command": F.array_join(F.slice("_w", F.lit(4), F.greatest(F.size("_w") - 3, F.lit(0))), " "),
    }).drop("_w"))


def ps_processes(lines: DataFrame) -> DataFrame:
    return ps_lines(lines).where(F.col("reject").isNull()).drop("reject", "line")


def ps_quarantine(lines: DataFrame) -> DataFrame:
    """Unusable lines with the reason; the collector's own line is not one."""
    return ps_lines(lines).where(F.col("reject").isNotNull() & (F.col("reject") != "collector")) \
        .select(*lines.columns, "reject")


def stat_fields(text: Column) -> dict[str, Column]:
    """Fields of a stat line; the command lies between the first ``(`` and the last ``)``."""
    shape = "(?s)^[^(]*\\((.*)\\)([^)]*)$"
    rest = words(F.regexp_extract(text, shape, 2))
    usable = text.rlike(shape) & (F.size(rest) >= STAT_FIELDS) & integer(F.get(rest, F.lit(STAT_PPID))).isNotNull()
    pick = lambda c: F.when(usable, c)
    return {
        "short_name": pick(F.regexp_extract(text, shape, 1)),
        "ppid": pick(integer(F.get(rest, F.lit(STAT_PPID)))),
        "session": pick(F.get(rest, F.lit(STAT_SESSION))),
        "tty_number": pick(F.get(rest, F.lit(STAT_TTY))),
        "start_token": pick(F.get(rest, F.lit(STAT_START))),
    }


def command_line(raw: Column, fallback: Column) -> Column:
    """NUL-separated arguments joined by spaces, else the fallback."""
    return joined_or(F.split(F.coalesce(raw, F.lit("")), "\\x{00}"), fallback)


def owner_uid(status: Column) -> Column:
    """Second word of the first line that starts with ``Uid:``."""
    line = F.regexp_extract(F.concat(F.lit("\n"), status), "\\n(Uid:[^\\n]*)", 1)
    return blank_to_null(F.get(words(line), F.lit(1)))


def terminal(link: Column, number: Column) -> Column:
    """Terminal device if descriptor 0 is one, else the device number unless zero."""
    return F.when(F.startswith(link, F.lit("/dev/")), link).when(number != "0", number)


def proc_processes(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Assemble processes from rows of (host_id, scan_id, pid, file, content).

    Files are ``stat``, ``cmdline``, ``exe``, ``cwd``, ``status`` and ``fd0``. Only
    a usable stat is required. Rows also carry captured_ns and booted_ns.
    """
    keys = keys or ["host_id", "scan_id", "pid"]
    names = ("stat", "cmdline", "exe", "cwd", "status", "fd0")
    wide = files.groupBy(*keys).agg(
        F.max("captured_ns").alias("captured_ns"), F.max("booted_ns").alias("booted_ns"),
        *[F.max(F.when(F.col("file") == n, F.col("content"))).alias(f"_{n}") for n in names],
    )
    parsed = wide.withColumns(stat_fields(F.col("_stat"))).where(F.col("start_token").isNotNull())
    return captured(parsed.withColumns({
        "process_id": process_id(F.col("pid"), F.col("start_token")),
        "command": command_line(F.col("_cmdline"), F.col("short_name")),
        "exe": F.col("_exe"), "cwd": F.col("_cwd"), "uid": owner_uid(F.col("_status")),
        "tty": terminal(F.col("_fd0"), F.col("tty_number")),
        "started_ns": start_ns_of_ticks(F.col("start_token"), F.col("booted_ns"), F.col("captured_ns")),
    })).select(
        *keys, "process_id", "ppid", "command", "exe", "cwd", "uid", "tty", "session", "started_ns",
        "captured_ns",
    )
