"""A host's choice between its native source and polled scans, while both land.

A host's health lands first (what was asked for, whether it is there), its failure where
it happened. ``auto`` uses native rows until then and scans from then on, for good;
a named source never changes. The first table after the change is a silent baseline.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lifeline import schemas as S
from lifeline.operators import fold
from lifeline.operators.replay import candidates, lifecycle_events
from lifeline.streaming.engine import (
    TABLE, TABLE_ROWS, TableRow, dealt, get_tables, put_table, put_tables, replace_tables, rows_of, stateful, table_of, tables_of, tuples)
from lifeline.streaming.replay import REPLAY_BUCKETS, Known, apply
from lifeline.streaming.scans import TABLE as POLLED, WAITING, compared
from lifeline.streaming.trace import FOUND, FoundRow

HEALTH, FAILURE, NOTICE, PROCESS, SCAN_END = "health", "failure", "notice", "process", "scan_end"
#: At one position the source's own rows come before its failure.
ORDER = {HEALTH: 0, NOTICE: 1, PROCESS: 2, SCAN_END: 3, FAILURE: 4}
_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
INPUT = S.struct_of(
    ("host_id", _L), ("pid", _L), ("pos", _L), ("kind", _S), ("family", _S), ("event_ns", _L), ("observed_ns", _L),
    ("exit_code", _L), ("cand", S.PROCESS), ("solid", _B), ("what", _S), ("requested", _S), ("available", _B),
    ("backend", _S), ("error", _S), ("scan_id", _L), ("success", _B))
AT = {name: i for i, name in enumerate(INPUT.fieldNames())}
CHOICE = S.struct_of(("requested", _S), ("source", _S), ("backend", _S), ("begun", _B))


def health_rows(health: DataFrame) -> DataFrame:
    """One row per host (``failed_pos`` null if it never failed): its health, and its failure."""
    return S.conform(health.selectExpr(
        "host_id", "requested", "available", "backend", "error", "observed_ns", f"""explode(array_compact(array(
            struct('{HEALTH}' AS what, -1L AS pos),
            CASE WHEN failed_pos IS NOT NULL THEN struct('{FAILURE}' AS what, CAST(failed_pos AS bigint) AS pos) END))) AS _x""").selectExpr(
        "*", "_x.*"), INPUT)


def notice_rows(notices: DataFrame) -> DataFrame:
    return S.conform(candidates(notices).selectExpr("*", f"'{NOTICE}' AS what"), INPUT)


def scan_rows(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    """Process rows at the position of their scan's attempt, and the ends of scans."""
    missing = {c: "NULL" for c in S.PROCESS_COLUMNS if c not in scans.columns}
    shown = scans.join(manifest.select("host_id", "scan_id", "pos"), ["host_id", "scan_id"]).selectExpr(
        "host_id", "pid", "pos", "scan_id", f"'{PROCESS}' AS what", f"{S.process_struct(**missing)} AS cand")
    ends = manifest.selectExpr("host_id", "pos", "scan_id", f"'{SCAN_END}' AS what", "success", "error", "observed_ns")
    return S.conform(shown, INPUT).unionByName(S.conform(ends, INPUT))


class Fallback(StatefulProcessor):
    """State: the source in use, its live processes, and the polled table with rows of open scans."""

    def __init__(self, collector: str):
        self.collector = collector

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.choice = handle.getValueState("choice", CHOICE)
        self.live = handle.getListState("live", TABLE)
        self.table = handle.getListState("table", TABLE)
        self.waiting = handle.getListState("waiting", TABLE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        landed = get_tables((r.rows for r in rows), to_arrow_schema(INPUT))
        found = self.found(key, landed)
        while part := [tuple(row) for row in islice(found, TABLE_ROWS)]:
            yield TableRow(put_table(table_of(part, FOUND)))

    def found(self, key, landed: pa.Table) -> Iterator[Row]:
        host, bucket = key
        requested, source, backend, begun = self.choice.get() if self.choice.exists() else (None, None, None, False)
        known, waiting, before = Known(self.live), defaultdict(list), None
        # Process rows wait unread until an end lands.
        if pc.any(pc.equal(landed["what"], SCAN_END)).as_py():
            for scan, process in tuples(get_tables((v[0] for v in self.waiting.get()), to_arrow_schema(WAITING))):
                waiting[scan].append(process)
            self.waiting.clear()
            if begun:
                before = tuples(get_tables((v[0] for v in self.table.get()), to_arrow_schema(POLLED)))
        # Every value of a row by its name's place; the first ten are those of a replay.
        for row in sorted(tuples(landed), key=lambda r: (r[AT["pos"]], ORDER[r[AT["what"]]])):
            what, pos, at_ns, error = (row[AT[c]] for c in ("what", "pos", "observed_ns", "error"))
            if what == HEALTH:
                requested, backend, available = row[AT["requested"]], row[AT["backend"]], row[AT["available"]]
                source = S.POLL if requested == S.POLL or (requested == S.AUTO and not available) else backend if available else None
                if source == S.POLL != requested and bucket == 0:
                    yield self.gap(host, pos, at_ns, S.POLL, f"backend {requested} was unavailable and {self.collector} "
                                                             f"started with {S.POLL}: {error or ''}")
            elif what == FAILURE and source not in (None, S.POLL):
                if requested == S.AUTO and bucket == 0:
                    yield self.gap(host, pos, at_ns, backend, f"backend {backend} failed and {self.collector} "
                                                              f"switched to {S.POLL}: {error or ''}")
                source = S.POLL if requested == S.AUTO else None
            elif what == NOTICE and source not in (None, S.POLL):
                yield FoundRow(*apply(known, *row[:10]), None, None)
            elif what == PROCESS:
                waiting[row[AT["scan_id"]]].append(row[AT["cand"]])
            elif what == SCAN_END:
                shown = waiting.pop(row[AT["scan_id"]], [])
                if source == S.POLL and row[AT["success"]]:
                    previous = {r[0][fold.ID]: r[0] for r in before or ()}
                    before, changes = compared(before, shown)
                    for kind, process, captured, started in changes:
                        yield self.change(host, pos, at_ns, kind, previous.get(process[fold.ID]), first(process, captured, started))
        known.write()
        if before is not None:
            replace_tables(self.table, table_of(before, POLLED))
        left = put_tables(table_of([(scan, process) for scan, shown in waiting.items() for process in shown], WAITING))
        if left:
            self.waiting.appendList(left)
        self.choice.update((requested, source, backend, begun or before is not None))

    @staticmethod
    def change(host: int, pos: int, at_ns: int, kind: str, old: tuple | None, process: tuple) -> Row:
        """A difference between polled tables, as a state row."""
        stop = kind == S.STOP
        pid = process[S.PROCESS_COLUMNS.index("pid")]
        return FoundRow(host, pid, pos, fold.ABSENT if stop else fold.SCAN, S.POLL, at_ns, at_ns, None,
                        process if stop else old, pos, None if stop else process, pos, False, None, None, None, None)

    @staticmethod
    def gap(host: int, pos: int, at_ns: int, backend: str, message: str) -> Row:
        return FoundRow(host, None, pos, S.GAP, backend, at_ns, None, None, None, None, None, None, False, None, None, message, 9)

    def close(self) -> None:
        pass


def first(process: tuple, captured: int | None, started: int | None) -> tuple:
    values = list(process)
    values[fold.CAPTURED], values[fold.STARTED] = captured, started
    return tuple(values)


def fallback_events(rows: DataFrame, collector: str = "collector", buckets: int = REPLAY_BUCKETS) -> DataFrame:
    """Events of a stream of INPUT rows: native, then polled ones, and a gap where they meet."""
    key = ["host_id", "bucket"]
    spread = dealt(rows, "pid", f"what IN ('{HEALTH}', '{FAILURE}', '{SCAN_END}')", buckets)
    return lifecycle_events(rows_of(stateful(tables_of(spread, key, INPUT), key, Fallback(collector), TABLE), FOUND))
