"""Differences between successive process tables on engine state.

A scan lands as its process rows and one row that ends it (``pid`` null). Process rows wait
until the end is known; a readable end compares them with the table before, an
unreadable one drops them. A host's table is dealt to buckets by process ID.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lifeline import schemas as S
from lifeline.functions.clock import lifetime_ms
from lifeline.operators import fold
from lifeline.operators.diff import PHASE_CHANGE, PHASE_STOP, SCAN_FAILED
from lifeline.streaming.engine import BUCKETS, dealt, get_rows, packed, put_rows, stateful

_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
END = (("pos", _L), ("observed_ns", _L), ("success", _B), ("error", _S))
INPUT = S.struct_of(("host_id", _L), ("scan_id", _L), *END, *S.PROCESS_FIELDS)
WAITING = S.struct_of(("scan_id", _L), ("process", S.PROCESS))
#: A process of the last table, with its first capture and first known start.
TABLE = S.struct_of(("process", S.PROCESS), ("captured_ns", _L), ("started_ns", _L))
CHANGES = S.struct_of(
    ("host_id", _L), ("pos", _L), ("observed_ns", _L), ("kind", _S), ("process", S.PROCESS), ("captured_ns", _L),
    ("started_ns", _L), ("message", _S))
Change = Row(*CHANGES.fieldNames())
COMMAND, EXE = (S.PROCESS_COLUMNS.index(c) for c in ("command", "exe"))


def compared(before: list[tuple] | None, shown: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The new table and the changes (kind, process, first capture, first start); no changes without a table before."""
    known = {r[0][fold.ID]: r for r in before or ()}
    table, changes = [], []
    for process in sorted(shown, key=lambda p: p[fold.ID]):
        old = known.pop(process[fold.ID], None)
        captured, started = (old[1:] if old else (None, None))
        row = (process, process[fold.CAPTURED] if captured is None else captured,
               process[fold.STARTED] if started is None else started)
        table.append(row)
        if old is None:
            changes.append((S.START, *row))
        elif (old[0][COMMAND], old[0][EXE]) != (process[COMMAND], process[EXE]):
            changes.append((S.EXEC, *row))
    changes += [(S.STOP, *row) for row in known.values()]
    return table, changes if before is not None else []


class ScanDiff(StatefulProcessor):
    """State: the last table, whether there was one, and rows of scans that have not ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getListState("table", packed(TABLE))
        self.begun = handle.getValueState("begun", S.struct_of(("pos", _L)))
        self.waiting = handle.getListState("waiting", packed(WAITING))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ends, waiting = [], [(r[0], tuple(r[1])) for r in get_rows(self.waiting)]
        for row in rows:
            scan, process = row[1], tuple(row[len(END) + 2:len(INPUT)])
            ends.append(tuple(row)) if process[0] is None else waiting.append((scan, process))
        before = None
        for host, scan, pos, observed_ns, success, error, *_ in sorted(ends, key=lambda r: r[2]):
            shown = [p for s, p in waiting if s == scan]
            waiting = [w for w in waiting if w[0] != scan]
            if not success:
                if key[1] == 0:
                    yield Change(host, pos, observed_ns, S.GAP, None, None, None, SCAN_FAILED + (error or ""))
                continue
            if before is None and self.begun.exists():
                before = [(tuple(r[0]), r[1], r[2]) for r in get_rows(self.table)]
            before, changes = compared(before, shown)
            self.begun.update((pos,))
            for kind, *rest in changes:
                yield Change(host, pos, observed_ns, kind, *rest, None)
        if before is not None:
            put_rows(self.table, before)
        put_rows(self.waiting, waiting)

    def close(self) -> None:
        pass


def change_events(changes: DataFrame, backend: str = S.POLL) -> DataFrame:
    """Events of CHANGES rows."""
    stop, start, gap = f"kind = '{S.STOP}'", f"kind = '{S.START}'", f"kind = '{S.GAP}'"
    phase = f"CASE WHEN {gap} THEN 0 WHEN {stop} THEN {PHASE_STOP} ELSE {PHASE_CHANGE} END"
    return S.as_events(changes.selectExpr(
        "host_id", S.order_key("pos", phase, "coalesce(process.pid, 0)") + " AS order_key", "kind",
        f"CASE WHEN {start} THEN coalesce(started_ns, observed_ns) ELSE observed_ns END AS event_ns", "observed_ns",
        *[f"process.`{c}` AS `{c}`" for c in S.PROCESS_COLUMNS if c not in ("started_ns", "captured_ns")],
        f"CASE WHEN {stop} THEN {lifetime_ms('observed_ns', 'started_ns', 'captured_ns')} END AS duration_ms",
        f"'{backend}' AS backend", "message"))


def scan_changes(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """CHANGES of a stream of INPUT rows."""
    spread = dealt(rows, "process_id", "process_id IS NULL", buckets)
    return stateful(spread, ["host_id", "bucket"], ScanDiff(), CHANGES)


def scan_events(rows: DataFrame, backend: str = S.POLL, buckets: int = BUCKETS) -> DataFrame:
    return change_events(scan_changes(rows, buckets), backend)
