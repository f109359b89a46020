"""Tracing of commands and their descendants while scans arrive, on engine state.

A trace lives from its request to its end: at every readable scan it selects its root while
that runs, every PID it already tracks, and the children of selected PIDs. It ends
at the first scan past its tail, or at the first one two polls after the exit that
shows no member, or when it is cancelled; its state is dropped then. Hosts are the
keys: a trace follows parents over a whole process table, and a scan waits, as rows
of the state, until its end has landed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lifeline import schemas as S
from lifeline.functions import identity as I
from lifeline.operators import fold
from lifeline.operators.replay import STATE_ROWS, lifecycle_events
from lifeline.operators.trace import CANCELLED, SCAN_FAILED, TAIL_ENDED
from lifeline.streaming.engine import dealt, get_rows, packed, put_rows, stateful

REQUEST, EXIT, CANCEL, PROCESS, SCAN_END = "request", "exit", "cancel", "process", "scan_end"
#: At one position a scan comes first: it belongs to what was known before.
ORDER = {PROCESS: 0, SCAN_END: 1, REQUEST: 2, CANCEL: 3, EXIT: 4}
_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
INPUT = S.struct_of(
    ("host_id", _L), ("pos", _L), ("what", _S), ("trace_id", _L), ("at_ns", _L), ("exit_code", _L), ("poll_ns", _L),
    ("tail_ns", _L), ("scan_id", _L), ("success", _B), ("error", _S), ("proc", S.PROCESS))
MEMBER = S.struct_of(("pid", _L), ("process", S.PROCESS), ("pos", _L))
FAILED = S.struct_of(("pos", _L), ("at_ns", _L), ("error", _S))
TRACE = S.struct_of(
    ("root_pid", _L), ("root", S.PROCESS), ("poll_ns", _L), ("tail_ns", _L), ("exited_ns", _L),
    ("known", T.ArrayType(MEMBER)), ("members", T.ArrayType(_L)), ("failed", T.ArrayType(FAILED)))
#: Rows of PROCESS in Arrow's format.
TABLE = T.BinaryType()
WAITING = S.struct_of(("scan_id", _L), ("table", TABLE))
DEALT = T.StructType([*INPUT.fields, T.StructField("table", TABLE)])
TRACE_BUCKETS = 16       # a bucket unpacks every table of its host
PACKED_ROWS = 50_000     # process rows that a task packs at a time
FOUND = T.StructType([*STATE_ROWS.fields, T.StructField("message", _S), T.StructField("part", T.IntegerType())])
FoundRow = Row(*FOUND.fieldNames())
PID, PARENT, STARTED, ID = (S.PROCESS_COLUMNS.index(c) for c in ("pid", "ppid", "started_ns", "process_id"))


def request_rows(requests: DataFrame) -> DataFrame:
    """Requests, exits and cancellations at their positions."""
    asked = S.conform(requests, S.TRACE_REQUEST)
    root = S.process_struct(
        process_id=f"concat_ws(':', '{I.TRACE_ROOT}', root_pid, started_ns)", pid="root_pid", ppid="parent_pid",
        command="array_join(argv, ' ')", exe="argv[0]", captured_ns="started_ns",
        **{c: "NULL" for c in ("cwd", "user", "uid", "tty", "session")})
    return S.conform(asked.selectExpr("host_id", "trace_id", "poll_ns", "tail_ns", "exit_code", f"""explode(array_compact(array(
        CASE WHEN started_pos IS NOT NULL THEN struct('{REQUEST}' AS what, started_pos AS pos, started_ns AS at_ns, {root} AS proc) END,
        CASE WHEN exited_pos IS NOT NULL THEN struct('{EXIT}' AS what, exited_pos AS pos, exited_ns AS at_ns, {S.null_of(S.PROCESS)} AS proc) END,
        CASE WHEN cancelled_pos IS NOT NULL THEN struct('{CANCEL}' AS what, cancelled_pos AS pos, cancelled_ns AS at_ns, {S.null_of(S.PROCESS)} AS proc) END
        ))) AS _x""").selectExpr("*", "_x.*"), INPUT)


def scan_rows(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    """Process rows at the position of their scan's attempt, and the ends of scans."""
    missing = {c: "NULL" for c in S.PROCESS_COLUMNS if c not in scans.columns}
    places = manifest.select("host_id", "scan_id", "pos")
    shown = scans.join(places, ["host_id", "scan_id"]).selectExpr(
        "host_id", "pos", f"'{PROCESS}' AS what", "scan_id", f"{S.process_struct(**missing)} AS proc")
    ends = manifest.selectExpr("host_id", "pos", f"'{SCAN_END}' AS what", "scan_id", "success", "error", "observed_ns AS at_ns")
    return S.conform(shown, INPUT).unionByName(S.conform(ends, INPUT))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Process rows of each scan in one value, for every ``PACKED_ROWS`` rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= PACKED_ROWS:
            yield _packed(held)
            held, count = [], 0
    if count:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    scans = table.select(["host_id", "pos", "scan_id"]).append_column("_row", pa.array(range(table.num_rows), pa.int64()))
    groups = scans.group_by(["host_id", "pos", "scan_id"], use_threads=False).aggregate([("_row", "list")])
    processes, values = table["proc"].combine_chunks(), []
    for rows in groups["_row_list"]:
        part = pa.RecordBatch.from_struct_array(processes.take(rows.values))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as writer:
            writer.write_batch(part)
        values.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays(
        [*[groups[c].combine_chunks() for c in ("host_id", "pos", "scan_id")], pa.array(values, pa.binary())],
        names=["host_id", "pos", "scan_id", "table"])


def packed_tables(rows: DataFrame) -> DataFrame:
    """Process rows (INPUT) as few values per scan."""
    return rows.select("host_id", "pos", "scan_id", "proc").mapInArrow(
        _pack, S.struct_of(("host_id", _L), ("pos", _L), ("scan_id", _L), ("table", TABLE)))


def unpacked_table(table: bytes) -> Iterator[tuple]:
    for batch in pa.ipc.open_stream(bytes(table)):
        yield from zip(*[column.to_pylist() for column in batch.columns])


class Table:
    """A readable scan: one process per PID, and the children of each."""

    def __init__(self, tables: list[bytes]):
        self.of: dict[int, tuple] = {}
        rank = lambda p: (p[STARTED] is not None, p[STARTED] or 0, p[ID])
        for p in chain.from_iterable(map(unpacked_table, tables)):
            if p[PID] not in self.of or rank(p) > rank(self.of[p[PID]]):
                self.of[p[PID]] = p
        self.children: dict[int, list[int]] = defaultdict(list)
        for pid, p in self.of.items():
            if p[PARENT] and p[PARENT] > 0 and p[PARENT] != pid:
                self.children[p[PARENT]].append(pid)

    def reached(self, selected: set[int], without: int | None) -> set[int]:
        """The selected PIDs and their descendants; ``without`` is entered by none of them."""
        found, ahead = set(selected), list(selected)
        while ahead:
            for child in self.children.get(ahead.pop(), ()):
                if child not in found and child != without:
                    found.add(child)
                    ahead.append(child)
        return found


class Trace:
    """One trace between two rows of its host."""

    def __init__(self, host: int, trace: int, state: tuple):
        self.host, self.trace = host, trace
        self.root_pid, root, self.poll_ns, self.tail_ns, self.exited_ns, known, members, failed = state
        self.root = tuple(root)
        self.known = {m[0]: (tuple(m[1]), m[2]) for m in known}
        self.members, self.failed = set(members), [tuple(f) for f in failed]

    def state(self) -> tuple:
        return (self.root_pid, self.root, self.poll_ns, self.tail_ns, self.exited_ns,
                [(pid, *v) for pid, v in sorted(self.known.items())], sorted(self.members), self.failed)

    def row(self, pid: int, pos: int, kind: str, at_ns: int, cand: tuple | None, solid: bool, exit_code=None) -> Row:
        before, before_pos = self.known.pop(pid, (None, None))
        process, fresh = fold.after(kind, S.TRACE, before, cand, solid, align_all=True)
        at = None if process is None else pos if fresh else before_pos
        if process is not None:
            self.known[pid] = process, at
        return FoundRow(self.host, pid, pos, kind, S.TRACE, at_ns, at_ns, exit_code, before, before_pos, process, at,
                        before is not None and fresh, cand, self.trace, None, None)

    def gap(self, pos: int, at_ns: int, message: str, part: int) -> Row:
        return FoundRow(self.host, None, pos, S.GAP, S.TRACE, at_ns, at_ns, None, None, None, None, None, False, None,
                        self.trace, message, part)

    def exit(self, pos: int, at_ns: int, code: int | None) -> Iterator[Row]:
        self.exited_ns = at_ns
        self.members.discard(self.root_pid)      # what holds its PID later is a member only through a parent
        yield self.row(self.root_pid, pos, S.STOP, at_ns, self.root, False, code)

    def scan(self, pos: int, at_ns: int, table: Table) -> Iterator[Row]:
        exited = self.exited_ns is not None
        selected = {p for p in self.members if p in table.of}
        if not exited and self.root_pid in table.of:
            selected.add(self.root_pid)
        selected = table.reached(selected, None if exited else self.root_pid)
        for pid in sorted(self.members - selected - (set() if exited else {self.root_pid})):
            yield self.row(pid, pos, fold.ABSENT, at_ns, None, False)
        for pid in sorted(selected):
            yield self.row(pid, pos, fold.SCAN, at_ns, table.of[pid], True)
        self.members = selected
        for failed_pos, failed_ns, error in self.failed:
            yield self.gap(failed_pos, failed_ns, SCAN_FAILED + (error or ""), 0)
        self.failed = []

    def over(self, at_ns: int) -> bool:
        if self.exited_ns is None:
            return False
        return at_ns >= self.exited_ns + max(self.tail_ns or 0, 1) or (
            not self.members and at_ns >= self.exited_ns + 2 * (self.poll_ns or 0))


class Tracing(StatefulProcessor):
    """State: the traces of a bucket that have not ended, and packed rows of scans that have not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.traces = handle.getMapState("traces", S.struct_of(("trace_id", _L)), TRACE)
        self.waiting = handle.getListState("waiting", packed(WAITING))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        host = key[0]
        waiting: dict[int, list[bytes]] = defaultdict(list)
        for scan, table in get_rows(self.waiting):
            waiting[scan].append(table)
        live = {t[0]: Trace(host, t[0], tuple(state)) for t, state in self.traces.iterator()}
        before = set(live)
        ordered = sorted(rows, key=lambda r: (r.pos, ORDER[r.what]))
        for r in ordered:
            if r.what == PROCESS:
                waiting[r.scan_id].append(r.table)
            elif r.what == SCAN_END:
                yield from self.ended(r, waiting.pop(r.scan_id, []), live)
            elif r.what == REQUEST:
                root = tuple(r.proc.values())
                trace = live[r.trace_id] = Trace(host, r.trace_id, (root[PID], root, r.poll_ns, r.tail_ns, None, (), (), ()))
                yield trace.row(root[PID], r.pos, S.START, r.at_ns, root, True)
            elif r.trace_id in live and r.what == EXIT:
                yield from live[r.trace_id].exit(r.pos, r.at_ns, r.exit_code)
            elif r.trace_id in live:
                yield live.pop(r.trace_id).gap(r.pos, r.at_ns, CANCELLED, 9)
        for t in before - live.keys():
            self.traces.removeKey((t,))
        for t, trace in live.items():
            self.traces.updateValue((t,), trace.state())
        put_rows(self.waiting, [(scan, table) for scan, tables in waiting.items() for table in tables])

    @staticmethod
    def ended(end: Row, tables: list[bytes], live: dict[int, Trace]) -> Iterator[Row]:
        if not end.success:
            for trace in live.values():
                trace.failed.append((end.pos, end.at_ns, end.error))
            return
        if not live:
            return
        table = Table(tables)
        for t in sorted(live):
            trace = live[t]
            yield from trace.scan(end.pos, end.at_ns, table)
            if trace.over(end.at_ns):
                if trace.members:
                    pids = "[" + " ".join(map(str, sorted(trace.members))) + "]"
                    yield trace.gap(end.pos, end.at_ns, TAIL_ENDED % pids, 9)
                del live[t]

    def close(self) -> None:
        pass


def trace_events(rows: DataFrame, buckets: int = TRACE_BUCKETS) -> DataFrame:
    """Start, exec, stop and gap events of a stream of INPUT rows."""
    shown = f"what = '{PROCESS}'"
    tables = packed_tables(rows.where(shown)).withColumn("what", F.lit(PROCESS))
    both = S.conform(rows.where(f"NOT ({shown})"), DEALT).unionByName(S.conform(tables, DEALT))
    spread = dealt(both, "trace_id", f"what IN ('{PROCESS}', '{SCAN_END}')", buckets)
    return lifecycle_events(stateful(spread, ["host_id", "bucket"], Tracing(), FOUND))
