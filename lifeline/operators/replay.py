"""Replay of ordered change notices, and their reconciliation with process tables.

State is the process of a (host, PID) at a position. Rows that can change it:

``seed``    known before the first notice (a baseline table or an earlier batch)
``start``, ``exec``, ``stop``   notices
``scan``    the PID is present in a reconciliation scan
``absent``  the PID is missing from a reconciliation scan

A row's effect depends only on rows of its own (host, PID), so one shuffle and
one sort serve all windows. Whether a start on a live PID begins a new
generation can depend on a chain of earlier answers (start times within two
seconds of the first one). The windows assume that it does; a stretch where the
assumption first fails is handed, from that row to the next stop, to a streaming
fold over IDs and start times that keeps one of each in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.functions import identity as I
from lifeline.functions.clock import event_ns_of_kernel, lifetime_ms
from lifeline.operators import fold
from lifeline.operators.ordered import HOT_ROWS, WIDTH, as_of, by_heat, running
from lifeline.session import materialise

KEY = ["host_id", "pid"]
SEED, SCAN, ABSENT = fold.SEED, fold.SCAN, fold.ABSENT
# Notice kinds as landed and as emitted.
KINDS = {"fork": S.START, "exec": S.EXEC, "exit": S.STOP, "start": S.START, "stop": S.STOP}

_T = S.T
STATE_ROWS = _T.StructType([
    *[_T.StructField(n, t) for n, t in (
        ("host_id", _T.LongType()), ("pid", _T.LongType()), ("pos", _T.LongType()),
        ("kind", _T.StringType()), ("family", _T.StringType()), ("event_ns", _T.LongType()),
        ("observed_ns", _T.LongType()), ("exit_code", _T.LongType()),
        ("before", S.PROCESS), ("before_pos", _T.LongType()),
        ("after", S.PROCESS), ("after_pos", _T.LongType()),
        ("renewed", _T.BooleanType()), ("cand", S.PROCESS), ("trace_id", _T.LongType()),
    )]
])


def wall_times(notices: DataFrame, anchors: DataFrame, width: int = WIDTH) -> DataFrame:
    """Event time of kernel-stamped notices by the latest clock anchor before them."""
    key = ["host_id", "boot_id"]
    fill = lambda df: df.withColumn(
        "boot_id", F.coalesce("boot_id", F.lit("")) if "boot_id" in df.columns else F.lit("")
    )
    timed = as_of(
        fill(notices), fill(anchors), key, "pos", "struct(monotonic_ns, wall_ns, valid)", "_anchor",
        dense=True, width=width,
    )
    return timed.withColumn("event_ns", event_ns_of_kernel(
        F.col("kernel_ns"), F.col("_anchor.monotonic_ns"), F.col("_anchor.wall_ns"),
        F.col("_anchor.valid"), F.col("observed_ns"),
    )).drop("_anchor")


def candidates(notices: DataFrame) -> DataFrame:
    """The process each notice describes on its own (``cand``).

    ``solid`` tells that it replaces what is known: details were readable, or the
    source always describes its processes. Otherwise it is a stand-in with a
    provisional ID, used only for a PID nothing is known of.
    """
    kinds = " ".join(f"WHEN '{landed}' THEN '{kind}'" for landed, kind in KINDS.items())
    rows = S.conform(notices, S.NOTICE).withColumn("kind", F.expr(f"CASE kind {kinds} END"))
    linux, windows, stop = "family = 'linux'", "family = 'windows'", f"kind = '{S.STOP}'"
    readable = f"(proc IS NOT NULL AND kind <> '{S.STOP}')"
    process = S.process_struct(
        process_id=f"""CASE
            WHEN {linux} AND {readable} THEN proc.process_id
            WHEN {linux} THEN concat_ws(':', '{I.CONNECTOR}', pid, kernel_ns)
            WHEN {windows} AND {stop} THEN concat_ws(':', '{I.ETW}', pid, event_ns)
            WHEN {windows} THEN concat_ws(':', pid, coalesce(proc.started_ns, event_ns))
            WHEN proc.started_ns IS NULL THEN concat_ws(':', '{I.ES}', pid, pid_version)
            ELSE concat_ws(':', pid, proc.started_ns) END""",
        ppid=f"""CASE
            WHEN {linux} AND {readable} AND kind = '{S.START}' AND ppid > 0 THEN ppid
            WHEN {linux} AND {readable} THEN proc.ppid
            WHEN {linux} AND kind <> '{S.START}' THEN 0
            ELSE coalesce(ppid, 0) END""",
        started_ns=f"""CASE
            WHEN {linux} AND {readable} THEN proc.started_ns
            WHEN {linux} OR ({windows} AND {stop}) THEN event_ns
            WHEN {windows} THEN coalesce(proc.started_ns, event_ns)
            ELSE proc.started_ns END""",
        captured_ns="observed_ns",
        **{c: f"CASE WHEN {readable} OR NOT ({linux}) THEN proc.`{c}` END"
           for c in ("command", "exe", "cwd", "user", "uid", "tty", "session")},
    )
    return rows.selectExpr(
        *KEY, "pos", "kind", "family", "event_ns", "observed_ns", "exit_code", f"{process} AS cand",
        f"NOT ({stop}) AND ({readable} OR NOT ({linux})) AS solid",
    )


def table_rows(processes: DataFrame, kind: str, family: str | None = None) -> DataFrame:
    """Seed or scan rows from process-table rows that carry ``pos`` and ``observed_ns``."""
    missing = {c: "NULL" for c in S.PROCESS_COLUMNS if c not in processes.columns}
    return processes.selectExpr(
        *KEY, "pos", f"'{kind}' AS kind", f"'{family}' AS family" if family else "family",
        "observed_ns AS event_ns", "observed_ns", "CAST(NULL AS bigint) AS exit_code",
        f"{S.process_struct(**missing)} AS cand", "true AS solid",
    )


def absences(rows: DataFrame, scans: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row that may leave a PID live: its absence from the host's next scan.

    Only the first scan after a row matters, because a scan either confirms the
    PID (a new row) or ends it. So there are at most as many absences as rows,
    and no product of scans and PIDs. An absence of a dead PID has no effect.
    """
    times = scans.selectExpr("host_id", "-pos AS _npos", "pos", "observed_ns")
    living = rows.where(f"kind <> '{S.STOP}'").selectExpr(*KEY, "-pos AS _npos", "family")
    following = as_of(
        living, times, ["host_id"], "_npos", "struct(pos, observed_ns)", "_scan",
        at_same_pos=False, dense=True, width=width,
    ).where("_scan IS NOT NULL").selectExpr(*KEY, "_scan.*", "family").dropDuplicates([*KEY, "pos"])
    present = rows.where(f"kind = '{SCAN}'").select(*KEY, "pos")
    return following.join(present, [*KEY, "pos"], "left_anti").selectExpr(
        *KEY, "pos", f"'{ABSENT}' AS kind", "family", "observed_ns AS event_ns", "observed_ns",
        "CAST(NULL AS bigint) AS exit_code", f"{S.null_of(S.PROCESS)} AS cand", "false AS solid",
    )


def replay_rows(rows: DataFrame, align_all: bool = False, hot_rows: int = HOT_ROWS,
                width: int = WIDTH, fold_all: bool = False, keys: list[str] = KEY) -> DataFrame:
    """State before and after every row (STATE_ROWS).

    ``align_all`` renames any provisional ID on reconciliation; by default only
    the Linux connector's. ``fold_all`` sends every live stretch through the fold
    (used to check the two paths against each other).
    """
    return by_heat(
        rows, keys, lambda part, w: _replay(part, w, align_all, fold_all, keys), hot_rows, width
    )


def _replay(rows: DataFrame, width: int | None, align_all: bool, fold_all: bool,
            keys: list[str]) -> DataFrame:
    ends = f"kind IN ('{S.STOP}', '{ABSENT}')"
    never = f"{-(1 << 62)}L"
    step = running(rows, keys, "pos", {"_stop": f"CASE WHEN {ends} THEN pos END"}, inclusive=False, width=width).selectExpr(
        "*", f"coalesce(_stop, {never}) AS stretch")
    # What follows a stop depends on nothing before it: a hot PID spreads over its stretches.
    part = [*keys, "stretch"] if width else keys
    step = running(step, part, "pos", {"_live": f"CASE WHEN NOT ({ends}) THEN pos END"}, inclusive=False).selectExpr(
        "*", "coalesce(_live > stretch, false) AS found")
    # Rows that replace the known process: stand-ins do so only if nothing is known.
    replaces = f"(NOT ({ends}) AND (kind = '{S.START}' OR solid OR NOT found))"
    step = running(step, part, "pos", {
        "_last": f"CASE WHEN {replaces} THEN struct(pos, cand AS c) END",
    }, inclusive=False)
    renamed = I.is_provisional("_last.c.process_id") if align_all else \
        f"(family = 'linux' AND startswith(_last.c.process_id, '{I.CONNECTOR}:'))"
    near = I.same_generation("pid", "_last.c.process_id", "_last.c.started_ns",
                             "pid", "cand.process_id", "cand.started_ns")
    confirms = f"coalesce(_last.c.process_id = cand.process_id OR ({renamed} AND {near}), false)"
    step = step.selectExpr(
        "*", f"NOT ({ends}) AND (kind = '{S.START}' OR NOT found OR (kind = '{SCAN}' AND NOT {confirms})) AS fresh")
    step = running(step, part, "pos", {"_gen": "CASE WHEN fresh THEN pos END"})
    step = running(step, part, "pos", {
        "_first": "CASE WHEN fresh THEN struct(pos, cand.captured_ns AS v) END",
        "_known": f"""CASE WHEN {replaces} AND cand.started_ns IS NOT NULL
                      THEN struct(_gen AS gen, -pos AS o, cand.started_ns AS v) END""",
    }, inclusive=False)
    before = S.process_struct("_last.c", captured_ns="_first.v",
                              started_ns="CASE WHEN _known.gen = _first.pos THEN _known.v END")
    step = step.selectExpr(
        "*", f"CASE WHEN found THEN {before} END AS before", "CASE WHEN found THEN _first.pos END AS before_pos")
    merged = I.same_generation("pid", "before.process_id", "before.started_ns",
                               "pid", "cand.process_id", "cand.started_ns")
    suspect = f"found AND NOT ({ends})" if fold_all else f"kind = '{S.START}' AND found AND {merged}"
    step = running(step, part, "pos", {"_merge": f"CASE WHEN {suspect} THEN pos END"}).selectExpr(
        *[f"`{c}`" for c in rows.columns], "before", "before_pos", "found", "fresh", "stretch",
        "coalesce(_merge > stretch, false) AS _folded")
    direct = _outcome(step.where("NOT _folded"))
    return direct.unionByName(_folded(step.where("_folded").drop("_folded"), align_all, keys))


def _outcome(step: DataFrame) -> DataFrame:
    """State rows from rows with their state ``before`` and whether they are ``fresh``."""
    kept = "(found AND NOT fresh)"
    keeping = S.process_struct(
        "cand", captured_ns="coalesce(before.captured_ns, cand.captured_ns)",
        started_ns="coalesce(before.started_ns, cand.started_ns)")
    moved = S.process_struct("before", ppid="cand.ppid")
    ends = f"kind IN ('{S.STOP}', '{ABSENT}')"
    return S.conform(step.selectExpr(
        "*",
        f"""CASE WHEN {ends} THEN NULL WHEN {kept} AND solid THEN {keeping}
                 WHEN {kept} AND kind = '{S.START}' THEN {moved} WHEN {kept} THEN before ELSE cand END AS after""",
        f"CASE WHEN {ends} THEN NULL WHEN {kept} THEN before_pos ELSE pos END AS after_pos",
        "found AND fresh AS renewed",
    ), STATE_ROWS)


def _folded(step: DataFrame, align_all: bool, keys: list[str]) -> DataFrame:
    """State rows of stretches whose starts depend on a chain of earlier answers.

    Each stretch opens with its exact state. A fold over IDs and start times
    decides which rows are fresh; stretches are independent, so those of one hot
    PID spread over many tasks. The states then follow by windows as usual.
    """
    part = [*keys, "stretch"]
    decided = step.selectExpr(
        "*", "cand.process_id AS _id", "cand.started_ns AS _start",
        "before.process_id AS _old_id", "before.started_ns AS _old_start",
    ).repartition(*part).sortWithinPartitions(*part, "pos").mapInArrow(
        _decider(align_all, part),
        _T.StructType([*step.schema.fields, _T.StructField("opens", _T.BooleanType())]),
    )
    # The state before a stretch's first row becomes a row of its own, half a position earlier.
    columns = [c for c in decided.columns if c not in ("before", "opens")]
    seed = {"kind": f"'{SEED}'", "pos": "pos * 2 - 1", "cand": "before", "solid": "true", "fresh": "true"}
    as_row = lambda changes: "struct(" + ", ".join(f"{changes.get(c, f'`{c}`')} AS `{c}`" for c in columns) + ")"
    both = decided.selectExpr(f"""explode(array_compact(array(
        CASE WHEN opens THEN {as_row(seed)} END, {as_row({'pos': 'pos * 2'})}))) AS _r""").select("_r.*")
    rows = running(both, part, "pos", {"_gen": "CASE WHEN fresh THEN pos END"})
    rows = running(rows, part, "pos", {
        "_last": "CASE WHEN fresh OR solid THEN struct(pos, cand AS c) END",
        "_ppid": f"CASE WHEN fresh OR solid OR kind = '{S.START}' THEN struct(pos, cand.ppid AS v) END",
        "_first": f"""CASE WHEN fresh THEN struct(pos, cand.captured_ns AS v,
                      CASE WHEN kind = '{SEED}' THEN before_pos ELSE pos div 2 END AS at) END""",
        "_known": """CASE WHEN (fresh OR solid) AND cand.started_ns IS NOT NULL
                     THEN struct(_gen AS gen, -pos AS o, cand.started_ns AS v) END""",
    }, inclusive=False)
    before = S.process_struct("_last.c", ppid="_ppid.v", captured_ns="_first.v",
                              started_ns="CASE WHEN _known.gen = _first.pos THEN _known.v END")
    kept = [f"`{c}`" for c in step.columns if c not in ("pos", "before", "before_pos", "found")]
    return _outcome(rows.where("pos % 2 = 0").selectExpr(
        *kept, "pos div 2 AS pos", f"{before} AS before", "_first.at AS before_pos", "true AS found"))


def _decider(align_all: bool, part: list[str]):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, old, old_start = None, None, None
        for batch in batches:
            read = lambda *names: zip(*[batch.column(n).to_pylist() for n in names])
            fresh, opens = [], []
            places = read(*part)
            rows = read("kind", "solid", "family", "_id", "_start", "_old_id", "_old_start")
            for place, (kind, solid, family, new, start, before, before_start) in zip(places, rows):
                first = place != stretch
                if first:
                    stretch, old, old_start = place, before, before_start
                opens.append(first)
                if kind == S.START:
                    renews = not fold.same_process(old, old_start, new, start)
                elif kind == SCAN:
                    renews = old != new and not (
                        fold.alignable(family, old, align_all) and fold.same_process(old, old_start, new, start))
                else:
                    renews = False
                fresh.append(renews)
                if renews:
                    old, old_start = new, start
                elif solid:
                    old, old_start = new, start if old_start is None else old_start
            names = [n for n in batch.schema.names if not n.startswith("_")]
            kept = [pa.array(fresh, pa.bool_()) if n == "fresh" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(opens, pa.bool_())], names=[*names, "opens"])

    return decide


def replay(notices: DataFrame, baseline: DataFrame | None = None, scans: DataFrame | None = None,
           scan_times: DataFrame | None = None, **options) -> DataFrame:
    """State rows of a notice stream.

    ``baseline``: process rows with ``pos`` before the first notice.
    ``scans`` / ``scan_times``: reconciliation scans in the notices' position
    space, one process per PID, and one row per readable scan; a host's state
    is replaced by each of them.
    """
    rows = candidates(notices)
    if baseline is not None:
        rows = rows.unionByName(table_rows(baseline, SEED))
    if scans is not None:
        rows = materialise(rows.unionByName(table_rows(scans, SCAN)), "replay-rows")
        rows = rows.unionByName(materialise(
            absences(rows, scan_times, options.get("width", WIDTH)), "replay-absences"))
    return replay_rows(rows, **options)


def lifecycle_events(states: DataFrame) -> DataFrame:
    """Events of state rows, without parent chains.

    A replaced process first gets an implicit stop without exit code. Every
    notice yields its event; scan rows yield a start, an exec or nothing.
    """
    lived = lambda p: lifetime_ms("event_ns", f"{p}.started_ns", f"{p}.captured_ns")
    none = "CAST(NULL AS bigint)"

    def event(kind: str, subject: str, sub: int | str, when: str = "event_ns", code: str = none, duration: str = none):
        return (f"struct('{kind}' AS kind, {sub} AS sub, {when} AS event_ns, {subject} AS p, "
                f"CAST({code} AS bigint) AS exit_code, {duration} AS duration_ms)")

    differs = I.changed("before.command", "before.exe", "after.command", "after.exe")
    implicit = f"CASE WHEN renewed THEN {event(S.STOP, 'before', 0, duration=lived('before'))} END"
    main = f"""CASE
        WHEN kind = '{S.START}' THEN {event(S.START, 'after', 1)}
        WHEN kind = '{S.EXEC}' THEN {event(S.EXEC, 'after', 1)}
        WHEN kind = '{S.STOP}' AND before IS NOT NULL THEN
            {event(S.STOP, 'before', 1, code='exit_code', duration=lived('before'))}
        WHEN kind = '{S.STOP}' THEN {event(S.STOP, 'cand', 1, code='exit_code', duration=lived('cand'))}
        WHEN kind = '{ABSENT}' AND before IS NOT NULL THEN {event(S.STOP, 'before', 1, duration=lived('before'))}
        WHEN kind = '{SCAN}' AND (renewed OR before IS NULL) THEN
            {event(S.START, 'after', 1, 'coalesce(after.started_ns, event_ns)')}
        WHEN kind = '{SCAN}' AND {differs} THEN {event(S.EXEC, 'after', 1)} END"""
    # Rows of streams may be gaps, with their message and part of the position.
    reported = "message" in states.columns
    gap = f", CASE WHEN kind = '{S.GAP}' THEN {event(S.GAP, S.null_of(S.PROCESS), 'part')} END" if reported else ""
    sources = " ".join(f"WHEN '{f}' THEN '{b}'" for f, b in S.BACKEND_OF_FAMILY.items())
    # A trace replaces a PID in place; a table difference stops old IDs after all starts.
    phase = f"""CASE WHEN _e.kind = '{S.GAP}' THEN CASE WHEN _e.sub = 0 THEN 0 ELSE 3 END
                     WHEN _e.kind = '{S.STOP}' AND (kind = '{ABSENT}' OR (kind = '{SCAN}' AND family <> '{S.TRACE}'))
                     THEN 2 ELSE 1 END"""
    return S.as_events(
        states.where(f"kind <> '{SEED}'")
        .selectExpr("*", f"explode(array_compact(array({implicit}, {main}{gap}))) AS _e")
        .selectExpr(
            "host_id", S.order_key("pos", phase, "coalesce(pid, 0)", "_e.sub") + " AS order_key", "_e.kind AS kind",
            "_e.event_ns AS event_ns", "observed_ns",
            *[f"_e.p.`{c}` AS `{c}`" for c in S.PROCESS_COLUMNS if c not in ("started_ns", "captured_ns")],
            "_e.duration_ms AS duration_ms", "_e.exit_code AS exit_code",
            f"CASE family {sources} ELSE family END AS backend", "trace_id", *(["message"] if reported else []),
        )
    )


def live_state(states: DataFrame) -> DataFrame:
    """The processes alive after the last row, as seed rows of a following batch."""
    last = states.groupBy(*KEY).agg(
        F.max_by(F.struct("after", "family", "observed_ns"), "pos").alias("s"), F.max("pos").alias("pos")
    ).where("s.after IS NOT NULL")
    return last.selectExpr(
        *KEY, "pos", "s.family AS family", "s.observed_ns AS observed_ns",
        *[f"s.after.`{c}` AS `{c}`" for c in S.PROCESS_COLUMNS if c != "pid"],
    )


def process_versions(states: DataFrame, hot_rows: int = HOT_ROWS, width: int = WIDTH) -> DataFrame:
    """One row per generation and version: valid from its position to the next row's."""
    def close(part: DataFrame, w: int | None) -> DataFrame:
        return running(part, KEY, "_npos", {"_following": "_npos"}, inclusive=False, width=w)

    closed = by_heat(states.selectExpr("*", "-pos AS _npos"), KEY, close, hot_rows, width)
    return closed.where("after IS NOT NULL").selectExpr(
        *KEY, "pos AS valid_from_pos", "-_following AS valid_to_pos", "after_pos AS generation_pos",
        *[f"after.`{c}` AS `{c}`" for c in S.PROCESS_COLUMNS if c != "pid"],
    )


def process_lifetimes(states: DataFrame) -> DataFrame:
    """One row per ended generation, with how and when it ended.

    Each generation ends in exactly one row - a stop, an absence or a replacement
    - and that row knows the whole generation, so nothing is grouped.
    """
    ended = f"kind = '{S.STOP}' OR renewed OR (kind = '{ABSENT}' AND before IS NOT NULL)"
    return states.where(ended).selectExpr("*", "coalesce(before, cand) AS _p").selectExpr(
        *KEY, "pos AS stop_pos", "before_pos AS generation_pos", "_p.process_id AS process_id",
        "_p.started_ns AS started_ns", "event_ns AS stop_ns",
        f"{lifetime_ms('event_ns', '_p.started_ns', '_p.captured_ns')} AS duration_ms",
        f"CASE WHEN kind = '{S.STOP}' THEN exit_code END AS exit_code", f"kind <> '{S.STOP}' AS implicit",
    )


def version_facts(states: DataFrame) -> DataFrame:
    """Who held each PID from which position on: the look-up side of parent searches."""
    return states.selectExpr("host_id", "pid AS _next", "pos", "after")


def _before_itself(rows: DataFrame) -> str:
    return f"kind = '{S.STOP}'" if "kind" in rows.columns else "false"


def temporal_parents(rows: DataFrame, states: DataFrame,
                     hot_rows: int = HOT_ROWS, width: int = WIDTH) -> DataFrame:
    """Attach ``parent``: the process that held the parent PID at the row's ``pos``.

    An as-of look-up, linear in rows and states: a parent with many children and
    many versions costs their sum, not their product. Pass stored states if
    their computation is not to be repeated. Stops see the table before their
    position: at a scan, a parent that vanishes or is replaced with its child.
    """
    seeking = rows.selectExpr("*", "CASE WHEN ppid > 0 THEN ppid END AS _next")
    looked = as_of(
        seeking.where("_next IS NOT NULL"), version_facts(states), ["host_id", "_next"], "pos",
        "struct(after)", "_found", hot_rows=hot_rows, width=width, strict=_before_itself(rows),
    ).selectExpr(*[f"`{c}`" for c in rows.columns], "_found.after AS parent")
    alone = seeking.where("_next IS NULL").selectExpr(
        *[f"`{c}`" for c in rows.columns], f"{S.null_of(S.PROCESS)} AS parent")
    return looked.unionByName(alone)


def temporal_ancestors(rows: DataFrame, states: DataFrame, hot_rows: int = HOT_ROWS,
                       width: int = WIDTH) -> DataFrame:
    """Attach ``parent_chain`` as of each row's position (stops: before it); one as-of look-up per level."""
    facts = materialise(version_facts(states), "versions")
    summary = S.SUMMARY.simpleString()
    sought = rows.selectExpr(
        "*", "CASE WHEN ppid > 0 AND ppid <> pid THEN ppid END AS _first", f"{_before_itself(rows)} AS _strict")
    # Only who seeks climbs, as narrow rows; the chain is joined on at the end.
    key = ["host_id", "pid", "pos", "_first", "_strict"]
    climbing = materialise(sought.where("_first IS NOT NULL").select(*key).distinct().selectExpr(
        "*", "_first AS _next", f"CAST(array() AS array<{summary}>) AS parent_chain", "array(pid) AS _seen"), "climb")
    up = ", ".join(f"_found.after.`{c}`" for c in S.SUMMARY_COLUMNS)
    finished = [climbing.where("_next IS NULL")]
    climbing = climbing.where("_next IS NOT NULL")
    while not climbing.isEmpty():
        looked = materialise(as_of(
            climbing, facts, ["host_id", "_next"], "pos", "struct(after)", "_found",
            hot_rows=hot_rows, width=width, strict="_strict",
        ).selectExpr(
            *key,
            """CASE WHEN _found.after.ppid > 0 AND NOT array_contains(array_append(_seen, _next), _found.after.ppid)
                    THEN _found.after.ppid END AS _next""",
            f"""CASE WHEN _found.after IS NULL THEN parent_chain
                     ELSE array_append(parent_chain, CAST(struct({up}) AS {summary})) END AS parent_chain""",
            "array_append(_seen, _next) AS _seen",
        ), "climb")
        finished.append(looked.where("_next IS NULL"))
        climbing = looked.where("_next IS NOT NULL")
    chains = reduce(DataFrame.unionByName, finished).select(*key, "parent_chain")
    return sought.join(chains, key, "left").selectExpr(
        *[f"`{c}`" for c in rows.columns], f"coalesce(parent_chain, CAST(array() AS array<{summary}>)) AS parent_chain")


def details_as_of(notices: DataFrame, processes: DataFrame, hot_rows: int = HOT_ROWS,
                  width: int = WIDTH) -> DataFrame:
    """Fill missing notice details from the latest scan row of the PID before them.

    ``processes`` carries ``pos`` in the notices' position space. Optional: a
    collector normally delivers the details it read.
    """
    missing = {c: "NULL" for c in S.PROCESS_COLUMNS if c not in processes.columns}
    facts = processes.selectExpr(*KEY, "pos", f"{S.process_struct(**missing)} AS _p")
    found = as_of(notices, facts, KEY, "pos", "struct(_p)", "_found", at_same_pos=False,
                  hot_rows=hot_rows, width=width)
    return found.withColumn("proc", F.coalesce("proc", "_found._p")).drop("_found")
