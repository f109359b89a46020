"""Clock conversions. Nanoseconds are longs; unsigned 64-bit inputs are decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, epochs and limits.
SECOND_NS, MILLI_NS = 1_000_000_000, 1_000_000
TICKS_PER_SECOND = 100
LONG_MAX = 9_223_372_036_854_775_807
UNSIGNED_MAX = "18446744073709551615"
START_SLACK_NS = SECOND_NS
FILETIME_EPOCH = 116_444_736_000_000_000
FILETIME_AHEAD_NS = 60 * SECOND_NS
FILETIME_BEHIND_NS = 24 * 3600 * SECOND_NS
RESYNC_POLLS, RESYNC_MIN_NS, RESYNC_MAX_NS = 10, SECOND_NS, 30 * SECOND_NS
_WIDE = "decimal(38,0)"


def unsigned(c: Column) -> Column:
    """Text of an unsigned 64-bit integer as a decimal, else null."""
    value = F.when(c.rlike("^[0-9]+$"), F.ltrim(c, F.lit("0")))
    value = F.when(value == "", F.lit("0")).when(F.char_length(value) <= 20, value).try_cast(_WIDE)
    return F.when(value <= F.lit(UNSIGNED_MAX).cast(_WIDE), value)


def boot_ns(uptime: Column, captured_ns: Column) -> Column:
    """Boot time from the first word of an uptime text (seconds, maybe with a fraction)."""
    first = F.get(F.split(F.regexp_replace(uptime, "(?U)^\\s+", ""), "(?U)\\s+"), F.lit(0))
    seconds = F.when(first.rlike("^\\+?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), first).try_cast("decimal(29,9)")
    elapsed = F.floor(seconds * SECOND_NS).cast(_WIDE)
    return F.when(elapsed <= LONG_MAX, captured_ns - elapsed.try_cast("long"))


def start_ns_of_ticks(token: Column, booted_ns: Column, captured_ns: Column) -> Column:
    """Start time from clock ticks since boot; null if unusable or after the capture."""
    ticks = unsigned(token)
    offset = (ticks * (SECOND_NS // TICKS_PER_SECOND)).cast(_WIDE)
    started = F.when(offset <= LONG_MAX, booted_ns.cast(_WIDE) + offset)
    return F.when(started <= captured_ns.cast(_WIDE) + START_SLACK_NS, started).try_cast("long")


def event_ns_of_kernel(
    kernel_ns: Column, anchor_mono: Column, anchor_wall: Column, anchor_valid: Column, observed_ns: Column
) -> Column:
    """Wall time of a monotonic stamp by its anchor; the observed time if that is impossible."""
    delta = kernel_ns.cast(_WIDE) - anchor_mono.cast(_WIDE)
    usable = F.coalesce(anchor_valid, F.lit(False)) & (kernel_ns != 0) & (F.abs(delta) <= LONG_MAX)
    return F.when(usable, (anchor_wall.cast(_WIDE) + delta).try_cast("long")).otherwise(observed_ns)


def event_ns_of_filetime(filetime: Column, observed_ns: Column) -> Column:
    """Wall time of 100 ns file-time units; the observed time if out of bounds."""
    value = (filetime.cast(_WIDE) - FILETIME_EPOCH) * 100
    seen = observed_ns.cast(_WIDE)
    usable = (filetime > 0) & value.between(seen - FILETIME_BEHIND_NS, seen + FILETIME_AHEAD_NS)
    return F.when(usable, value.try_cast("long")).otherwise(observed_ns)


def resync_interval_ns(poll_ns: Column) -> Column:
    return F.least(F.greatest(poll_ns * RESYNC_POLLS, F.lit(RESYNC_MIN_NS)), F.lit(RESYNC_MAX_NS))


def exit_code_of_wait_status(status: Column) -> Column:
    """Exit code of a 32-bit wait status: plain exit, 128 + signal, or the raw status."""
    signal = status.bitwiseAND(F.lit(0x7F))
    return (
        F.when(signal == 0, F.shiftright(status, 8).bitwiseAND(F.lit(0xFF)))
        .when(signal != 0x7F, signal + 128)
        .otherwise(status)
        .cast("long")
    )


def lifetime_ms(stop_ns: str, started_ns: str, captured_ns: str) -> str:
    """SQL text: whole milliseconds lived, from the start or else the first capture; never negative."""
    lived = f"({stop_ns} - coalesce({started_ns}, {captured_ns}))"
    return f"(CASE WHEN {lived} < 0 THEN 0L ELSE {lived} END div {MILLI_NS}L)"
