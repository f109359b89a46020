"""Replay of notices, and their reconciliation with scans, on engine state.

A stream's rows are those of the batch replay, told apart by ``kind``, and one row that
ends each scan (``scan_end``). A scan's process rows wait until it has ended; then
they replace what is known, and PIDs it does not show are absent. Rows reach the state, wait
in it and leave it as tables: the engine would hand a row over value by value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lifeline import schemas as S
from lifeline.operators import fold
from lifeline.operators.replay import STATE_ROWS, candidates, lifecycle_events, table_rows
from lifeline.streaming.engine import (
    TABLE, TableRow, dealt, get_tables, listed, put_tables, replace_tables, rows_of, stateful, table_of, tables_of, tuples)

SCAN_END = "scan_end"
_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
#: What lands: notices with the process each describes, scan rows and ends of scans.
INPUT = S.struct_of(
    ("host_id", _L), ("pid", _L), ("pos", _L), ("kind", _S), ("family", _S), ("event_ns", _L), ("observed_ns", _L),
    ("exit_code", _L), ("cand", S.PROCESS), ("solid", _B), ("success", _B))
PID = S.struct_of(("pid", _L))
KNOWN = S.struct_of(("process", S.PROCESS), ("pos", _L), ("family", _S))
LIVE = T.StructType([*PID.fields, *KNOWN.fields])
REPLAY_BUCKETS = 32      # a bucket's rows of a micro-batch are in memory at once
NUMBER = S.PROCESS_COLUMNS.index("command")
NOTHING = (None, None, None)
StateRow = Row(*STATE_ROWS.fieldNames())


def notice_rows(notices: DataFrame) -> DataFrame:
    return S.conform(candidates(notices), INPUT)


def scan_rows(scans: DataFrame, ends: DataFrame) -> DataFrame:
    """Process rows (with ``pos`` and ``observed_ns`` of their scan) and the ends of scans."""
    finished = ends.selectExpr("host_id", "pos", f"'{SCAN_END}' AS kind", "observed_ns",
                               "success" if "success" in ends.columns else "true AS success")
    return S.conform(table_rows(scans, fold.SCAN), INPUT).unionByName(S.conform(finished, INPUT))


class Known:
    """The live processes of one key: read at once, written back at the end of a batch if any has changed."""

    def __init__(self, store):
        self.store, self.changed = store, False
        found = get_tables((v[0] for v in store.get()), to_arrow_schema(LIVE))
        self.live = {pid: state for pid, *state in tuples(found)}

    def get(self, pid: int):
        return self.live.get(pid)

    def put(self, pid: int, value) -> None:
        self.changed = True
        self.live.pop(pid, None) if value is None else self.live.update({pid: value})

    def write(self) -> None:
        if self.changed:
            replace_tables(self.store, table_of([(pid, *state) for pid, state in self.live.items()], LIVE))


def apply(known: Known, host: int, pid: int, pos: int, kind: str, family: str | None, event_ns, observed_ns,
          exit_code, cand, solid: bool) -> Row:
    """State row of one input row; the known process moves on."""
    before, before_pos = (known.get(pid) or (None, None, None))[:2]
    process, fresh = fold.after(kind, family, before, cand, solid)
    at = None if process is None else pos if fresh else before_pos
    known.put(pid, None if process is None else (process, at, family))
    return StateRow(host, pid, pos, kind, family, event_ns, observed_ns, exit_code, before, before_pos, process, at,
                    before is not None and fresh, cand, None)


def thin(processes: pa.StructArray) -> list[tuple | None]:
    """What a step looks at of each process; in place of its command, its number."""
    read = {c: listed(processes.field(c)) for c in ("process_id", "ppid", "started_ns", "captured_ns")}
    read["command"] = range(len(processes))
    found = list(zip(*[read.get(c, repeat(None)) for c in S.PROCESS_COLUMNS]))
    for i in np.flatnonzero(processes.is_null().to_numpy(zero_copy_only=False)):
        found[i] = None
    return found


def whole(found: list[tuple | None], processes: pa.StructArray) -> pa.StructArray:
    """The processes of thin ones."""
    numbers = lambda at: pa.array([None if p is None else p[at] for p in found], pa.int64())
    at = numbers(NUMBER)
    shown = processes.take(at)
    moved = {S.PROCESS_COLUMNS[i]: numbers(i) for i in (fold.PPID, fold.STARTED, fold.CAPTURED)}
    return pa.StructArray.from_arrays(
        [moved[c] if c in moved else shown.field(c) for c in S.PROCESS_COLUMNS], fields=list(processes.type), mask=at.is_null())


def folded(live: pa.Table, rows: pa.Table) -> tuple[pa.Table, pa.Table, pa.Table]:
    """State rows of one key's INPUT, its LIVE processes afterwards, and rows of scans that have not ended.

    Only positions, kinds, IDs and times pass through Python; processes are taken
    by their numbers, as columns.
    """
    processes = pa.concat_arrays([t[c].combine_chunks() for t, c in ((live, "process"), (rows, "cand"))])
    known = thin(processes)
    cands, known = known[live.num_rows:], known[:live.num_rows]
    now = {pid: state for pid, *state in zip(listed(live["pid"]), known, listed(live["pos"]), listed(live["family"]))}
    pids, places, kinds, families, solids, successes = (
        listed(rows[c]) for c in ("pid", "pos", "kind", "family", "solid", "success"))
    found = []

    def step(row: int, pid: int, kind: str, family: str | None, cand: tuple | None, solid: bool) -> None:
        before, before_pos, _ = now.get(pid, NOTHING)
        process, fresh = fold.after(kind, family, before, cand, solid)
        at = None if process is None else places[row] if fresh else before_pos
        if process is not None:
            now[pid] = process, at, family
        elif before is not None:
            del now[pid]
        found.append((row, pid, kind, family, before, before_pos, process, at, before is not None and fresh))

    # A scan's own rows come before its end, whatever their order in the files.
    shown: dict[int, dict[int, int]] = {}
    for i in np.lexsort((np.array([k == SCAN_END for k in kinds], bool), rows["pos"].fill_null(0).to_numpy())).tolist():
        kind = kinds[i]
        if kind == fold.SCAN:
            shown.setdefault(places[i], {})[pids[i]] = i
        elif kind == SCAN_END:
            here = shown.get(places[i], {})
            shown.clear()        # rows come in order: what is left of a scan has an end before this one
            if successes[i]:
                for pid in [p for p in now if p not in here]:
                    step(i, pid, fold.ABSENT, now[pid][2], None, False)
                for pid, row in here.items():
                    step(row, pid, fold.SCAN, families[row], cands[row], solids[row])
        else:
            step(i, pids[i], kind, families[i], cands[i], solids[i])

    of, pid, kind, family, before, before_pos, after, after_pos, renewed = zip(*found) if found else [()] * 9
    at = pa.array(of, pa.int64())
    absent = pc.equal(pa.array(kind, pa.string()), fold.ABSENT).fill_null(False)
    own = pc.if_else(absent, pa.scalar(None, pa.int64()), at)    # an absence has only its scan's place and time
    observed = rows["observed_ns"].take(at)
    states = pa.Table.from_arrays([
        rows["host_id"].take(at), pa.array(pid, pa.int64()), rows["pos"].take(at), pa.array(kind, pa.string()),
        pa.array(family, pa.string()), pc.if_else(absent, observed, rows["event_ns"].take(at)), observed,
        rows["exit_code"].take(own), whole(before, processes), pa.array(before_pos, pa.int64()), whole(after, processes),
        pa.array(after_pos, pa.int64()), pa.array(renewed, pa.bool_()), rows["cand"].take(own), pa.nulls(len(found), pa.int64()),
    ], schema=to_arrow_schema(STATE_ROWS))
    state = list(now.values())
    left = pa.Table.from_arrays([
        pa.array(list(now), pa.int64()), whole([s[0] for s in state], processes), pa.array([s[1] for s in state], pa.int64()),
        pa.array([s[2] for s in state], pa.string())], schema=to_arrow_schema(LIVE))
    return states, left, rows.take(pa.array([i for scan in shown.values() for i in scan.values()], pa.int64()))


class Replay(StatefulProcessor):
    """State: a bucket's live processes, and rows of scans that have not ended; both are packed tables."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getListState("live", TABLE)
        self.waiting = handle.getListState("waiting", TABLE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        schema = to_arrow_schema(INPUT)
        landed = get_tables((r.rows for r in rows), schema)
        if pc.any(pc.equal(landed["kind"], SCAN_END)).as_py():
            landed = pa.concat_tables([get_tables((v[0] for v in self.waiting.get()), schema), landed]).combine_chunks()
            self.waiting.clear()
        states, live, waiting = folded(get_tables((v[0] for v in self.live.get()), to_arrow_schema(LIVE)), landed)
        if waiting.num_rows:
            self.waiting.appendList(put_tables(waiting))
        if states.num_rows:
            replace_tables(self.live, live)
        yield from map(TableRow, (v for v, in put_tables(states)))

    def close(self) -> None:
        pass


def replayed(rows: DataFrame, buckets: int = REPLAY_BUCKETS) -> DataFrame:
    """State rows (as of the batch replay) of a stream of INPUT rows."""
    key = ["host_id", "bucket"]
    spread = tables_of(dealt(rows, "pid", f"kind = '{SCAN_END}'", buckets), key, INPUT)
    return rows_of(stateful(spread, key, Replay(), TABLE), STATE_ROWS)


def replay_events(rows: DataFrame, buckets: int = REPLAY_BUCKETS) -> DataFrame:
    return lifecycle_events(replayed(rows, buckets))
