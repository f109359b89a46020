"""Differences between successive process tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.functions.clock import lifetime_ms
from lifeline.functions.identity import changed
from lifeline.operators.ordered import SCAN_WIDTH, SLICE, WIDTH, neighbours, ordinals, over

SCAN_KEY = ["host_id", "scan_id"]
PROCESS_KEY = ["host_id", "process_id"]
# Events of one scan: changes and starts first, then stops.
PHASE_GAP, PHASE_CHANGE, PHASE_STOP = 0, 1, 2
# Fixed value: gap text of a failed scan.
SCAN_FAILED = "process snapshot failed; expected a complete process table, received error "


def dedup_scan(scans: DataFrame) -> DataFrame:
    """One row per process ID of a scan: the last one written wins."""
    return _first(scans, [*SCAN_KEY, "process_id"], F.col("row_pos").desc())


def one_per_pid(processes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per PID: latest start wins, then the greatest process ID."""
    return _first(processes, [*(keys or SCAN_KEY), "pid"], F.col("started_ns").desc_nulls_last(), F.col("process_id").desc())


def _first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Ranks are cut off before the shuffle (window group limit)."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").select(*keys, *[c for c in rows.columns if c not in keys])


def scan_ordinals(manifest: DataFrame, width: int = WIDTH) -> DataFrame:
    """Number each host's successful scans and give the time of the following one."""
    good = ordinals(
        manifest.where("success").select(*SCAN_KEY, "pos", "observed_ns"),
        ["host_id"], "pos", "ordinal", width,
    )
    return neighbours(
        good, ["host_id"], "ordinal",
        following={"next_observed_ns": "observed_ns", "next_pos": "pos"}, width=width,
    ).select(
        *SCAN_KEY, F.col("pos").alias("scan_pos"), "ordinal", "observed_ns",
        "next_observed_ns", "next_pos",
    )


def attach_manifest(scans: DataFrame, numbered: DataFrame) -> DataFrame:
    """Scan rows of successful scans with their ordinal and times.

    A plain equi-join: Spark broadcasts the numbered manifest when its measured
    size allows, otherwise both sides shuffle on (host, scan).
    """
    return scans.join(numbered, SCAN_KEY)


def failed_scan_gaps(manifest: DataFrame, backend: str = S.POLL) -> DataFrame:
    """One gap per scan that could not be read."""
    return S.as_events(manifest.where("NOT success").selectExpr(
        "host_id", f"{S.order_key('pos', PHASE_GAP)} AS order_key", f"'{S.GAP}' AS kind",
        "observed_ns AS event_ns", "observed_ns", f"'{backend}' AS backend",
        f"concat('{SCAN_FAILED}', coalesce(error, '')) AS message",
    ))


def first_observation(prepared: DataFrame, width: int = SCAN_WIDTH) -> DataFrame:
    """Carry the first capture and the first known start through each presence run.

    ``prepared`` comes from ``attach_manifest`` and is unique on (host, scan,
    process). Adds ``run_start`` (ordinal), ``first_captured_ns``,
    ``first_started_ns``, the previous row's command and executable, and whether
    the process is present in the next scan. Runs are cut into slices of scans;
    only a run crossing a slice border contributes one summary row per border.
    """
    part = [*PROCESS_KEY, SLICE]
    local = neighbours(
        prepared, PROCESS_KEY, "ordinal",
        previous={"_prev": "ordinal", "previous_command": "command", "previous_exe": "exe"},
        following={"_next": "ordinal"}, width=width,
    ).selectExpr(
        "*", f"max(CASE WHEN _prev IS NULL THEN ordinal END) {over(part, 'ordinal')} AS _run"
    )
    earliest = lambda c: (
        f"max(CASE WHEN {c} IS NOT NULL THEN struct(coalesce(_run, -1L) AS run, -ordinal AS o, {c} AS v) END) "
        f"{over(part, 'ordinal')}")
    local = local.selectExpr(
        "*", f"{earliest('captured_ns')} AS _c", f"{earliest('started_ns')} AS _s"
    ).selectExpr(
        "*", "CASE WHEN _c.run = coalesce(_run, -1L) THEN _c.v END AS _captured",
        "CASE WHEN _s.run = coalesce(_run, -1L) THEN _s.v END AS _started",
    )
    kept = [*[f"`{c}`" for c in prepared.columns], "previous_command", "previous_exe"]
    # A slice's last scan hands its open run to the next slice.
    edge = local.where(f"ordinal % {width}L = {width - 1}L AND _next IS NOT NULL").selectExpr(
        *part, f"max(CASE WHEN _run IS NOT NULL THEN struct({SLICE} AS s, _run AS run, _captured AS v) END) "
               f"{over(PROCESS_KEY, SLICE)} AS _head", "_started",
    )
    carried = edge.selectExpr(
        *part, "_head", "max(CASE WHEN _started IS NOT NULL THEN "
                        f"struct(_head.s AS s, -{SLICE} AS o, _started AS v) END) {over(PROCESS_KEY, SLICE)} AS _known",
    ).selectExpr(
        *PROCESS_KEY, f"{SLICE} + 1 AS {SLICE}", "_head.run AS _in_run", "_head.v AS _in_captured",
        "CASE WHEN _known.s = _head.s THEN _known.v END AS _in_started",
    )
    return local.join(carried, part, "left").selectExpr(
        *kept, "coalesce(_run, _in_run) AS run_start",
        "CASE WHEN _run IS NULL THEN coalesce(_in_captured, _captured) ELSE _captured END AS first_captured_ns",
        "CASE WHEN _run IS NULL THEN coalesce(_in_started, _started) ELSE _started END AS first_started_ns",
        "_next IS NOT NULL AS in_next_scan",
    )


def snapshot_diff(prepared: DataFrame, backend: str = S.POLL, width: int = SCAN_WIDTH) -> DataFrame:
    """Start, exec and stop events of every pair of successive successful scans.

    The first successful scan of a host is a silent baseline. Stops take their
    time from the scan that missed the process. ``lookup_ordinal`` names the scan
    in which parents are to be looked up (this one; for stops the last present).
    """
    def event(kind: str, phase: int, pos: str, event_ns: str, observed: str, duration: str = "CAST(NULL AS bigint)"):
        return (f"struct('{kind}' AS kind, {S.order_key(pos, phase, 'pid')} AS order_key, {event_ns} AS event_ns, "
                f"{observed} AS observed_ns, {duration} AS duration_ms)")

    lived = lifetime_ms("next_observed_ns", "first_started_ns", "first_captured_ns")
    shown = f"""CASE
        WHEN run_start = ordinal AND ordinal > 0 THEN
          {event(S.START, PHASE_CHANGE, 'scan_pos', 'coalesce(first_started_ns, observed_ns)', 'observed_ns')}
        WHEN run_start < ordinal AND {changed('previous_command', 'previous_exe', 'command', 'exe')} THEN
          {event(S.EXEC, PHASE_CHANGE, 'scan_pos', 'observed_ns', 'observed_ns')} END"""
    gone = f"""CASE WHEN NOT in_next_scan AND next_observed_ns IS NOT NULL THEN
          {event(S.STOP, PHASE_STOP, 'next_pos', 'next_observed_ns', 'next_observed_ns', lived)} END"""
    events = first_observation(prepared, width).selectExpr(
        "*", f"explode(array_compact(array({shown}, {gone}))) AS _event"
    ).drop("observed_ns").selectExpr(
        "*", "_event.*", f"'{backend}' AS backend", "ordinal AS lookup_ordinal",
        "timestamp_micros(_event.event_ns div 1000) AS event_time",
    )
    return S.conform(events, S.T.StructType([
        *S.LIFECYCLE_EVENT.fields, S.T.StructField("lookup_ordinal", S.T.LongType())
    ]))


def last_exit_codes(notices: DataFrame) -> DataFrame:
    """Last known exit code of each PID."""
    return (
        notices.where("exit_code IS NOT NULL")
        .groupBy("host_id", "pid").agg(F.max_by("exit_code", "pos").alias("exit_code"))
    )


def pair_diff(
    previous: DataFrame, following: DataFrame, observed_ns: int, pos: int = 0,
    exit_codes: DataFrame | None = None, backend: str = S.POLL,
) -> DataFrame:
    """Events between two process tables, each unique on (host, process ID).

    ``observed_ns`` and ``pos`` are the moment and position of the second table.
    """
    pack = lambda df, name: df.selectExpr(*PROCESS_KEY, f"{S.process_struct()} AS {name}")
    differs = changed("_a.command", "_a.exe", "_b.command", "_b.exe")
    events = pack(previous, "_a").join(pack(following, "_b"), PROCESS_KEY, "full_outer").selectExpr(
        *PROCESS_KEY, "_a", "coalesce(_b, _a) AS _p",
        f"""CASE WHEN _a IS NULL THEN '{S.START}' WHEN _b IS NULL THEN '{S.STOP}'
                 WHEN {differs} THEN '{S.EXEC}' END AS kind""",
    ).where("kind IS NOT NULL").selectExpr("*", "_p.pid AS pid")
    if exit_codes is not None:
        events = events.join(exit_codes.select("host_id", "pid", "exit_code"), ["host_id", "pid"], "left")
    else:
        events = events.selectExpr("*", "CAST(NULL AS bigint) AS exit_code")
    lived = lifetime_ms(f"{observed_ns}L", "_p.started_ns", "_p.captured_ns")
    rest = [c for c in S.PROCESS_COLUMNS if c not in ("process_id", "pid", "started_ns", "captured_ns")]
    return S.as_events(events.selectExpr(
        *PROCESS_KEY, "pid", "kind", *[f"_p.`{c}` AS `{c}`" for c in rest], f"{observed_ns}L AS observed_ns",
        f"CASE WHEN kind = '{S.START}' THEN coalesce(_p.started_ns, {observed_ns}L) ELSE {observed_ns}L END AS event_ns",
        f"CASE WHEN kind = '{S.STOP}' THEN {lived} END AS duration_ms",
        f"CASE WHEN kind = '{S.STOP}' THEN exit_code END AS exit_code", f"'{backend}' AS backend",
        S.order_key(str(pos), f"CASE WHEN kind = '{S.STOP}' THEN {PHASE_STOP} ELSE {PHASE_CHANGE} END", "pid") + " AS order_key",
    ))


def only_started(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Processes of the second table whose ID the first lacks."""
    return following.join(previous.select(*PROCESS_KEY), PROCESS_KEY, "left_anti")


def only_stopped(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Processes of the first table whose ID the second lacks."""
    return previous.join(following.select(*PROCESS_KEY), PROCESS_KEY, "left_anti")
