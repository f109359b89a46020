"""Completeness auditing: lost, damaged and unreadable input becomes gap events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.operators.ordered import WIDTH, running

BEFORE, AFTER = 0, 3  # phases around the events of a position
CPU_KEY = ["host_id", "boot_id", "client", "cpu"]
# Sequence numbers of the connector wrap at 32 bits; message texts.
SEQUENCE_MODULUS = 4_294_967_296
SEQUENCE_GAP = "process connector sequence gap on cpu %d; expected sequence %d, received %d"
ENDPOINT_SEQUENCE_GAP = "macOS Endpoint Security sequence gap; expected sequence %s, received %s"
RECEIVE_OVERFLOW = "process connector receive queue overflowed; lifecycle records are missing"
TRUNCATED = "process connector receive buffer was truncated; lifecycle records may be missing"
OVERRUN = "process connector reported a netlink overrun; lifecycle records are missing"
MALFORMED = "process connector returned a malformed netlink message; lifecycle records may be missing"
QUEUE_OVERFLOW = {
    S.WINDOWS_ETW: "Windows ETW callback queue overflowed; expected every lifecycle notice, dropped %d notices",
    S.MACOS_ENDPOINT: "macOS Endpoint Security callback queue overflowed; expected every lifecycle notice, dropped %d notices",
}
RESYNC_FAILED = {
    S.LINUX_CONNECTOR: "process connector resync failed; expected a complete process table, received error ",
    S.WINDOWS_ETW: "Windows ETW resync failed; expected a complete process table, received error ",
    S.MACOS_ENDPOINT: "macOS Endpoint Security resync failed; expected a complete process table, received error ",
}


def gap_events(rows: DataFrame, message: str, backend: str, sub: str | int = 0,
               event_ns: str = "observed_ns", phase: str | int = BEFORE) -> DataFrame:
    """Gap events at the rows' positions (SQL texts); rows need host_id, pos and observed_ns.

    Diagnostics of a receive batch precede all its notices: rows with ``batch_pos``
    (the batch's first position) stand there, others before the notice of their own
    position. A grown loss counter is noticed after it. The forced scan follows at a
    later position.
    """
    at = "coalesce(batch_pos, pos)" if "batch_pos" in rows.columns else "pos"
    return S.as_events(rows.selectExpr(
        "host_id", f"{S.order_key(at, phase, 0, sub)} AS order_key", f"'{S.GAP}' AS kind",
        f"{event_ns} AS event_ns", "observed_ns", f"{backend} AS backend", f"{message} AS message",
    ))


def sequence_text(cpu: str, expected: str, seq: str) -> str:
    """SQL text of a message, from SQL texts; so are the next two."""
    return f"format_string('{SEQUENCE_GAP}', {cpu}, {expected}, {seq})"


def endpoint_text(expected: str, seq: str) -> str:
    return f"format_string('{ENDPOINT_SEQUENCE_GAP}', CAST({expected} AS string), CAST({seq} AS string))"


def lost_text(backend: str, lost: str) -> str:
    texts = " ".join(f"WHEN '{b}' THEN format_string('{t}', {lost})" for b, t in QUEUE_OVERFLOW.items())
    return f"CASE {backend} {texts} END"


def _filled(df: DataFrame, *names: str) -> DataFrame:
    """Optional key columns; a missing or null one is one key of its own."""
    return df.withColumns({n: F.coalesce(n, F.lit("")) if n in df.columns else F.lit("") for n in names})


def sequence_breaks(records: DataFrame, width: int | None = WIDTH,
                    cursors: DataFrame | None = None) -> DataFrame:
    """Rows whose 32-bit sequence does not follow the previous one of their CPU.

    Arrival order counts; every record moves the cursor, thread records too, so
    irrelevant records must not be filtered out before. ``client`` (optional)
    tells the collector's runs apart: each counts from its own first record.
    ``cursors`` (host_id, boot_id, client, cpu, seq) continues from an earlier batch.
    """
    rows = _filled(records, "boot_id", "client").withColumn("seq", F.expr("CAST(seq AS bigint)"))
    seen = running(rows, CPU_KEY, "pos", {"_prev": "struct(pos, seq)"}, inclusive=False, width=width)
    previous = "_prev.seq"
    if cursors is not None:
        seen = seen.join(cursors.selectExpr(*CPU_KEY, "seq AS _cursor"), CPU_KEY, "left")
        previous = "coalesce(_prev.seq, _cursor)"
    return seen.selectExpr(
        *[f"`{c}`" for c in rows.columns], f"pmod({previous} + 1, {SEQUENCE_MODULUS}L) AS expected_seq"
    ).where("seq <> expected_seq")


def sequence_gaps(records: DataFrame, width: int | None = WIDTH,
                  cursors: DataFrame | None = None) -> DataFrame:
    breaks = sequence_breaks(records, width, cursors)
    return gap_events(breaks, sequence_text("cpu", "expected_seq", "seq"), f"'{S.LINUX_CONNECTOR}'", "cpu")


def last_sequences(records: DataFrame) -> DataFrame:
    """Cursor of each CPU after these records."""
    return _filled(records, "boot_id", "client").groupBy(*CPU_KEY).agg(
        F.expr("max_by(CAST(seq AS bigint), pos) AS seq"), F.max("pos").alias("pos")
    )


def endpoint_breaks(records: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """Breaks of the endpoint sequence: one global cursor if flagged, else one per kind.

    Sequence 0 is ignored and does not move a cursor. Every run of the collector
    (``client``, optional) has cursors of its own.
    """
    rows = _filled(records, "client").where("seq <> 0").selectExpr(
        "*", "CASE WHEN global_sequence THEN '' ELSE kind END AS _cursor")
    seen = running(rows, ["host_id", "client", "_cursor"], "pos", {"_prev": "struct(pos, seq)"}, inclusive=False, width=width)
    return seen.selectExpr("*", "_prev.seq + 1 AS expected_seq").where("seq <> expected_seq").drop("_prev", "_cursor")


def endpoint_gaps(records: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """Endpoint breaks as events; they carry the event time of their notice if known."""
    text = endpoint_text("expected_seq", "seq")
    stamp = "event_ns" if "event_ns" in records.columns else "observed_ns"
    return gap_events(endpoint_breaks(records, width), text, f"'{S.MACOS_ENDPOINT}'", event_ns=stamp)


def lost_increases(counters: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """Rows where a cumulative loss counter passes everything its run reported before, with the growth.

    A restarted collector (another ``client``, optional) counts from zero again.
    """
    seen = running(_filled(counters, "client"), ["host_id", "backend", "client"], "pos", {"_reported": "lost_total"}, inclusive=False, width=width)
    return seen.selectExpr("*", "lost_total - coalesce(_reported, 0) AS lost").where("lost > 0").drop("_reported")


def lost_gaps(counters: DataFrame, width: int | None = WIDTH) -> DataFrame:
    return gap_events(lost_increases(counters, width), lost_text("backend", "lost"), "backend", phase=AFTER)


def completeness_summary(counters: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """Notices lost and gaps reported per host and source."""
    return lost_increases(counters, width).groupBy("host_id", "backend").agg(
        F.sum("lost").alias("lost"), F.count(F.lit(1)).alias("gaps")
    )


def gap_counts(events: DataFrame) -> DataFrame:
    return events.where(f"kind = '{S.GAP}'").groupBy("host_id", "backend").agg(
        F.count(F.lit(1)).alias("count")
    )


def batch_gaps(batches: DataFrame) -> DataFrame:
    """Quality flags of receive batches; damage is not reported on top of truncation.

    With ``batch_pos`` they stand before the batch's first notice.
    """
    flags = (
        ("receive_overflow", RECEIVE_OVERFLOW), ("truncated", TRUNCATED), ("overrun", OVERRUN),
        ("malformed AND NOT coalesce(truncated, false)", MALFORMED),
    )
    reasons = ", ".join(
        f"CASE WHEN {flag} THEN struct({sub} AS sub, '{text}' AS text) END"
        for sub, (flag, text) in enumerate(flags) if flag.split()[0] in batches.columns
    )
    rows = batches.selectExpr("*", f"explode(array_compact(array({reasons}))) AS _reason")
    return gap_events(rows, "_reason.text", f"'{S.LINUX_CONNECTOR}'", "_reason.sub")


def damaged(batches: DataFrame) -> DataFrame:
    """Receive batches that force a reconciliation."""
    flags = [f for f in ("receive_overflow", "truncated", "overrun", "malformed") if f in batches.columns]
    return batches.where(" OR ".join(f"coalesce({f}, false)" for f in flags) or "false")


def resync_gaps(manifest: DataFrame, backend: str | None = None) -> DataFrame:
    """One gap per reconciliation scan that could not be read; without a backend, of the rows' own (``backend``)."""
    source = f"'{backend}'" if backend else "backend"
    texts = " ".join(f"WHEN '{b}' THEN '{t}'" for b, t in RESYNC_FAILED.items())
    return gap_events(manifest.where("NOT success"), f"concat(CASE {source} {texts} END, coalesce(error, ''))", source)
