"""Tracing of a command and its descendants over process-table scans.

A trace selects, scan by scan, its root while it runs, every PID it already
tracks, and the children of selected PIDs. Equivalently: a presence run of a PID
(successive scans holding that PID) is a member from the first scan in which
its parent's run is a member, to the run's end. That first scan is found by
passing minima along parent edges between runs, for all traces at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.functions import identity as I
from lifeline.operators.diff import one_per_pid
from lifeline.operators.hierarchy import surviving_pids, with_ancestors
from lifeline.operators.ordered import (
    HOT_ROWS, SCAN_WIDTH, SLICE, WIDTH, as_of, by_heat, neighbours, ordinals, running,
)
from lifeline.operators.replay import ABSENT, SCAN, SEED, lifecycle_events, replay_rows
from lifeline.session import materialise

RUN = ["host_id", "pid", "run"]
MEMBER = ["trace_id", *RUN, "after_exit"]
# Gap texts.
SCAN_FAILED = "trace snapshot failed; expected a complete process table, received error "
TAIL_ENDED = "trace tail ended with observed descendant process ids %s still running"
CANCELLED = "trace stopped before the command and all observed descendants completed"


def presence_runs(prepared: DataFrame, width: int = SCAN_WIDTH) -> DataFrame:
    """Add ``run`` (first ordinal of the PID's presence run) and ``run_ends``.

    ``prepared`` comes from ``attach_manifest`` with one process per PID.
    """
    # Stored, as ``running`` reads its input for the slices and for their summaries.
    near = materialise(neighbours(prepared, ["host_id", "pid"], "ordinal", previous={"_prev": "ordinal"},
                                  following={"_next": "ordinal"}, width=width), "trace-near")
    return running(near, ["host_id", "pid"], "ordinal",
                   {"run": "CASE WHEN _prev IS NULL THEN ordinal END"}, width=width) \
        .selectExpr(*[f"`{c}`" for c in prepared.columns], "run", "_next IS NULL AS run_ends")


def parent_edges(runs: DataFrame, width: int = SCAN_WIDTH) -> DataFrame:
    """Intervals of scans in which a run's parent PID belongs to another run."""
    parents = runs.select("host_id", "ordinal", F.col("pid").alias("ppid"), F.col("run").alias("parent_run"))
    pairs = runs.where("ppid > 0 AND ppid <> pid").select(*RUN, "ordinal", "ppid").join(
        parents, ["host_id", "ordinal", "ppid"]
    )
    key = ["host_id", "pid", "ppid", "parent_run"]
    near = materialise(neighbours(pairs, key, "ordinal", previous={"_prev": "ordinal"}, width=width), "trace-near")
    islands = running(near, key, "ordinal", {"_from": "CASE WHEN _prev IS NULL THEN ordinal END"}, width=width)
    return islands.groupBy(*RUN, "ppid", "parent_run", "_from").agg(
        F.max("ordinal").alias("last")
    ).withColumnRenamed("_from", "first")


def trace_bounds(requests: DataFrame, numbered: DataFrame) -> DataFrame:
    """Requests with the ordinals of their first scan, exit, tail end and last scan.

    Each wanted moment becomes a row on the axis it is measured on (position or
    observed time), so that one as-of look-up finds the first scan after all of them.
    """
    moments = requests.selectExpr("trace_id", "host_id", """explode(array(
        struct('begin' AS name, 'pos' AS axis, -started_pos AS _m),
        struct('cut' AS name, 'pos' AS axis, -exited_pos AS _m),
        struct('cancel' AS name, 'pos' AS axis, -cancelled_pos AS _m),
        struct('tail' AS name, 'time' AS axis, 1 - exited_ns - greatest(tail_ns, 1L) AS _m),
        struct('quiet' AS name, 'time' AS axis, 1 - exited_ns - 2 * poll_ns AS _m))) AS _x""") \
        .selectExpr("trace_id", "host_id", "_x.*").where("_m IS NOT NULL")
    axes = numbered.selectExpr("host_id", "ordinal", """explode(array(
        struct('pos' AS axis, -scan_pos AS _m), struct('time' AS axis, -observed_ns AS _m))) AS _x""") \
        .selectExpr("host_id", "ordinal", "_x.*")
    found = as_of(moments, axes, ["host_id", "axis"], "_m", "struct(ordinal)", "_f", at_same_pos=False)
    wide = found.groupBy("trace_id").agg(*[
        F.expr(f"max(CASE WHEN name = '{n}' THEN _f.ordinal END) AS _{n}")
        for n in ("begin", "cut", "cancel", "tail", "quiet")
    ])
    last = numbered.groupBy("host_id").agg(F.max("ordinal").alias("_last"))
    return requests.join(last, ["host_id"]).join(wide, ["trace_id"], "left").selectExpr(
        *[f"`{c}`" for c in requests.columns], "_begin AS begin", "_cut AS cut",
        "CASE WHEN _tail IS NOT NULL THEN greatest(_tail, _cut) END AS tail_end",
        "CASE WHEN _quiet IS NOT NULL THEN greatest(_quiet, _cut) END AS quiet",
        "least(_last, _cancel - 1) AS final",
    )


def trace_membership(requests: DataFrame, runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (trace, run) with the first ordinal ``since`` and last ``until``.

    ``requests`` comes from ``trace_bounds``. A root's own run is cut at its exit;
    what holds its PID later is a member only through its parent.
    """
    extent = runs.groupBy(*RUN).agg(F.max("ordinal").alias("_end"))
    roots = requests.join(
        extent.withColumnRenamed("pid", "root_pid"), ["host_id", "root_pid"]
    ).select(
        "trace_id", "host_id", F.col("root_pid").alias("pid"), "run", F.lit(False).alias("after_exit"),
        F.greatest("run", "begin").alias("since"),
        F.least(F.col("_end"), F.col("cut") - 1, F.col("final")).alias("until"), "begin",
    ).where("begin IS NOT NULL AND since <= until").drop("begin")
    ends = edges.join(extent, RUN).select(
        "host_id", F.col("ppid"), "parent_run", "pid", "run", "first", "last", "_end"
    )
    ends = materialise(ends, "trace-edges")
    limits = requests.select("trace_id", "root_pid", "begin", "cut", "final")
    level = materialise(roots, "trace-members")
    members = level
    while not level.isEmpty():
        parents = level.select(
            "trace_id", "host_id", F.col("pid").alias("ppid"), F.col("run").alias("parent_run"),
            F.col("since").alias("_since"), F.col("until").alias("_until"),
        )
        reached = (
            ends.join(parents, ["host_id", "ppid", "parent_run"]).join(limits, ["trace_id"])
            .withColumn("is_root", F.col("pid") == F.col("root_pid"))
            .where("NOT is_root OR cut IS NOT NULL")
            .withColumn("since", F.greatest("first", "_since", F.when(F.col("is_root"), F.col("cut"))))
            .where("since <= least(last, _until)")
            .groupBy("trace_id", *RUN, F.col("is_root").alias("after_exit")).agg(
                F.min("since").alias("since"), F.max(F.least("_end", "final")).alias("until"))
        )
        known = members.groupBy(*MEMBER).agg(F.min("since").alias("_before"))
        level = materialise(
            reached.join(known, MEMBER, "left")
            .where("_before IS NULL OR since < _before").drop("_before"),
            "trace-members",
        )
        members = members.unionByName(level)
    return materialise(members.groupBy(*MEMBER).agg(
        F.min("since").alias("since"), F.max("until").alias("until")
    ), "trace-members")


def trace_finish(requests: DataFrame, members: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Requests with the ordinal of their last scan (``finish``) and whether it ended.

    A trace ends at the first scan past its tail, or at the first one two polls
    after the exit that sees no member. The latter is the first ordinal, from
    there on, that the members' intervals leave uncovered.
    """
    alive = members.join(requests.select("trace_id", "quiet"), ["trace_id"]).where(
        "quiet IS NOT NULL AND until >= quiet"
    ).withColumn("since", F.greatest("since", "quiet")).withColumn(
        "_at", F.col("since")
    )

    def sweep(part: DataFrame, width: int | None) -> DataFrame:
        return running(part, ["trace_id"], "_at", {"_covered": "until"}, inclusive=False, width=width)

    swept = by_heat(alive, ["trace_id"], sweep, hot_rows, WIDTH).withColumn(
        "_covered", F.greatest(F.coalesce("_covered", F.col("quiet") - 1), F.col("quiet") - 1)
    )
    gaps = swept.groupBy("trace_id").agg(
        F.min(F.when(F.col("since") > F.col("_covered") + 1, F.col("_covered") + 1)).alias("_hole"),
        (F.max("until") + 1).alias("_after"),
    )
    settled = requests.join(gaps, ["trace_id"], "left").withColumn(
        "_empty", F.coalesce("_hole", "_after", "quiet")
    ).withColumn("_done", F.least("tail_end", "_empty"))
    ended = F.coalesce(F.col("_done") <= F.col("final"), F.lit(False))
    return settled.withColumn("ended", ended).withColumn(
        "finish", F.when(F.col("ended"), F.col("_done")).otherwise(F.col("final"))
    ).drop("_hole", "_after", "_empty", "_done")


def _root_process(requests: DataFrame) -> DataFrame:
    return requests.select(
        "trace_id", "host_id", F.col("root_pid").alias("pid"), F.col("started_pos").alias("pos"),
        F.col("started_ns").alias("event_ns"), F.col("started_ns").alias("observed_ns"),
        F.col("parent_pid").alias("ppid"), F.array_join("argv", " ").alias("command"),
        F.get("argv", F.lit(0)).alias("exe"), F.lit(None).alias("cwd"), F.lit(None).alias("user"),
        F.lit(None).alias("uid"), F.lit(None).alias("tty"), F.lit(None).alias("session"),
        I.provisional_id(I.TRACE_ROOT, F.col("root_pid"), F.col("started_ns")).alias("process_id"),
        "started_ns", F.col("started_ns").alias("captured_ns"), "exited_pos", "exited_ns", "exit_code",
        "cancelled_pos",
    )


def root_parents(requests: DataFrame, runs: DataFrame, numbered: DataFrame) -> DataFrame:
    """The root's parent, per trace, in the last scan before the trace began."""
    scans = numbered.selectExpr("host_id", "scan_pos AS _m", "ordinal")
    begun = requests.selectExpr("trace_id", "host_id", "parent_pid AS pid", "started_pos AS _m")
    last = as_of(begun, scans, ["host_id"], "_m", "struct(ordinal)", "_f", at_same_pos=False, dense=True)
    summary = f"CAST(struct({', '.join(f'`{c}`' for c in S.SUMMARY_COLUMNS)}) AS {S.SUMMARY.simpleString()}) AS parent"
    filled = runs if "user" in runs.columns else runs.selectExpr("*", "CAST(NULL AS string) AS user")
    return last.where("pid > 0").selectExpr("trace_id", "host_id", "pid", "_f.ordinal AS ordinal").join(
        filled.selectExpr("host_id", "ordinal", "pid", summary), ["host_id", "ordinal", "pid"]
    ).select("trace_id", "parent")


def _with_root_parents(opening: DataFrame, parents: DataFrame) -> DataFrame:
    return S.as_events(opening.drop("parent_chain").join(parents, ["trace_id"], "left").selectExpr(
        "*", "array_compact(array(parent)) AS parent_chain"))


def _with_root_stops(events: DataFrame, settled: DataFrame, parents: DataFrame) -> DataFrame:
    """The reaped root's stop sees the members and its own parent from before the trace."""
    known = settled.select("trace_id", "root_pid", "exited_pos").join(parents, ["trace_id"])
    own = "kind = 'stop' AND pid = root_pid AND order_key.pos = exited_pos AND size(parent_chain) = 0 AND parent IS NOT NULL"
    return S.as_events(events.join(known, ["trace_id"], "left").withColumn(
        "parent_chain", F.expr(f"CASE WHEN {own} THEN array(parent) ELSE parent_chain END")))


def _with_chains(events: DataFrame, runs: DataFrame, members: DataFrame, settled: DataFrame,
                 numbered: DataFrame) -> DataFrame:
    filled = lambda df: df if "user" in df.columns else df.selectExpr("*", "CAST(NULL AS string) AS user")
    located = materialise(
        events.drop("parent_chain").selectExpr("*", "order_key.pos AS scan_pos")
        .join(numbered.select("host_id", "scan_pos", "ordinal"), ["host_id", "scan_pos"], "left")
        .join(settled.selectExpr("trace_id", "coalesce(cut - 1, final) AS _exit"), ["trace_id"]), "trace-events")
    shown = with_ancestors(located.where("kind <> 'stop'"), filled(runs), ["host_id", "ordinal"])
    stops = located.where("kind = 'stop'").withColumn("ordinal", F.expr("coalesce(ordinal - 1, _exit)"))
    ended = with_ancestors(stops, filled(members), ["trace_id", "host_id", "ordinal"])
    return S.as_events(shown.unionByName(ended))


def trace(prepared: DataFrame, numbered: DataFrame, requests: DataFrame,
          manifest: DataFrame | None = None, chains: bool = False, hot_rows: int = HOT_ROWS,
          width: int = SCAN_WIDTH) -> DataFrame:
    """Start, exec, stop and gap events of every requested trace.

    ``chains`` adds ancestors: a starting root knows its direct parent; starts and
    execs see their whole scan; stops see the members of the scan before.
    """
    runs = materialise(presence_runs(one_per_pid(
        prepared, ["host_id", "scan_id", "ordinal", "scan_pos", "observed_ns", "next_observed_ns", "next_pos"]
    ), width), "trace-runs")
    bounds = materialise(trace_bounds(S.conform(requests, S.TRACE_REQUEST), numbered), "trace-bounds")
    members = trace_membership(bounds, runs, parent_edges(runs, width))
    settled = materialise(trace_finish(bounds, members, hot_rows), "trace-bounds")
    live = members.join(settled.select("trace_id", "root_pid", "finish"), ["trace_id"]).where(
        "since <= finish").withColumn("until", F.least("until", "finish"))

    # With chains, what the replay and the ancestors read several times is stored.
    kept = materialise if chains else lambda df, name: df
    seen = kept(runs.join(live, RUN).where("ordinal BETWEEN since AND until"), "trace-seen")
    missing = {c: "NULL" for c in S.PROCESS_COLUMNS if c not in seen.columns}
    none, nobody, family = "CAST(NULL AS bigint) AS exit_code", f"{S.null_of(S.PROCESS)} AS cand", f"'{S.TRACE}' AS family"
    base = ("trace_id", "host_id", "pid")
    present = seen.selectExpr(
        *base, "scan_pos AS pos", f"'{SCAN}' AS kind", family, "observed_ns AS event_ns", "observed_ns", none,
        f"{S.process_struct(**missing)} AS cand", "true AS solid",
    )
    # A member missing from the next scan stops there; an active root does not.
    lost = seen.where(
        "run_ends AND next_pos IS NOT NULL AND ordinal < finish AND (pid <> root_pid OR after_exit)"
    ).selectExpr(
        *base, "next_pos AS pos", f"'{ABSENT}' AS kind", family, "next_observed_ns AS event_ns",
        "next_observed_ns AS observed_ns", none, nobody, "false AS solid",
    )
    root = _root_process(S.conform(requests, S.TRACE_REQUEST))
    seeds = root.selectExpr(
        *base, "pos", f"'{SEED}' AS kind", family, "event_ns", "observed_ns", none,
        f"{S.process_struct()} AS cand", "true AS solid",
    )
    exits = root.where(
        "exited_pos IS NOT NULL AND (cancelled_pos IS NULL OR exited_pos < cancelled_pos)"
    ).selectExpr(
        *base, "exited_pos AS pos", f"'{S.STOP}' AS kind", family, "exited_ns AS event_ns",
        "exited_ns AS observed_ns", "exit_code", f"{S.process_struct()} AS cand", "false AS solid",
    )
    rows = kept(present.unionByName(lost).unionByName(seeds).unionByName(exits), "trace-rows")
    states = replay_rows(rows, align_all=True, hot_rows=hot_rows, keys=["trace_id", "host_id", "pid"])
    opening = S.as_events(root.drop("exit_code").selectExpr(
        "*", f"'{S.START}' AS kind", f"'{S.TRACE}' AS backend", f"{S.order_key('pos', 1, 'pid')} AS order_key"))
    later = lifecycle_events(states)
    if chains:
        parents = materialise(root_parents(bounds, runs, numbered), "trace-parents")
        opening = _with_root_parents(opening, parents)
        later = _with_root_stops(_with_chains(later, runs, seen, settled, numbered), settled, parents)
    events = opening.unionByName(later)
    for gap in _trace_gaps(settled, numbered, live, manifest):
        events = events.unionByName(gap)
    return events


def _trace_gaps(settled: DataFrame, numbered: DataFrame, live: DataFrame,
                manifest: DataFrame | None) -> list[DataFrame]:
    left = surviving_pids(
        live.where("until = finish").join(settled.where("ended").select("trace_id"), ["trace_id"], "left_semi"),
        ["trace_id", "host_id", "finish"],
    ).join(
        numbered.select("host_id", F.col("ordinal").alias("finish"), F.col("scan_pos").alias("pos"), "observed_ns"),
        ["host_id", "finish"],
    )
    gaps = [_labelled(left, F.format_string(TAIL_ENDED, F.col("pids_text")), 9)]
    stopped = settled.where("cancelled_pos IS NOT NULL AND NOT ended").select(
        "trace_id", "host_id", F.col("cancelled_pos").alias("pos"), F.col("cancelled_ns").alias("observed_ns"))
    gaps.append(_labelled(stopped, F.lit(CANCELLED), 9))
    if manifest is not None:
        within = _failed_within(settled, numbered, manifest.where("NOT success").select("host_id", "pos", "observed_ns", "error"))
        gaps.append(_labelled(within, F.concat(F.lit(SCAN_FAILED), F.coalesce("error", F.lit(""))), 0))
    return gaps


def _failed_within(settled: DataFrame, numbered: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed scans after each trace's start and before its last scan.

    They are numbered per host. Two as-of look-ups give a trace the numbers it
    spans, so that it meets exactly those, however sparse positions are.
    """
    counted = materialise(ordinals(failed, ["host_id"], "pos", "_n"), "trace-failed")
    spans = settled.join(
        numbered.select("host_id", F.col("ordinal").alias("finish"), F.col("scan_pos").alias("_to")), ["host_id", "finish"])
    ends = spans.selectExpr("trace_id", "host_id", "explode(array(struct('low' AS name, started_pos AS _m), "
                            "struct('high' AS name, _to - 1 AS _m))) AS _x").select("trace_id", "host_id", "_x.*")
    found = as_of(ends, counted.withColumnRenamed("pos", "_m"), ["host_id"], "_m", "struct(_n)", "_f", dense=True)
    return found.groupBy("trace_id", "host_id").agg(*[
        F.expr(f"coalesce(max(CASE WHEN name = '{n}' THEN _f._n END), -1L) AS _{n}") for n in ("low", "high")
    ]).where("_high > _low").withColumn("_n", F.explode(F.expr("sequence(_low + 1, _high)"))).join(counted, ["host_id", "_n"])


def _labelled(rows: DataFrame, message, sub: int) -> DataFrame:
    return S.as_events(rows.withColumn("message", message).selectExpr(
        "trace_id", "host_id", f"{S.order_key('pos', 3 if sub else 0, 0, sub)} AS order_key",
        f"'{S.GAP}' AS kind", "observed_ns AS event_ns", "observed_ns", f"'{S.TRACE}' AS backend", "message",
    ))
