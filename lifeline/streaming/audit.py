"""Sequence gaps, endpoint gaps and loss counters on engine state.

One processor serves all three: every cursor (a CPU of a run of a collector, a kind of
endpoint notice, a loss counter) keeps one number. Cursors known before the stream
began may be handed over as a table of the same columns.

A cursor may have all rows of a micro-batch. They are cut into slices of positions first, each
compared within itself; only a slice's ends, and the rows in which a counter passes all
before them in the slice, meet the cursor's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lifeline import schemas as S
from lifeline.operators import gaps
from lifeline.operators.ordered import SLICE, slice_of
from lifeline.streaming.engine import stateful

SEQUENCE, ENDPOINT, LOST = "sequence", "endpoint", "lost"
SLICED = 1 << 16         # positions per slice of a cursor
_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
CURSOR = ["audit", "host_id", "boot_id", "client", "cursor"]
#: What lands: one number of one cursor.
INPUT = S.struct_of(
    ("audit", _S), ("host_id", _L), ("boot_id", _S), ("client", _S), ("cursor", _S), ("pos", _L), ("number", _L),
    ("event_ns", _L), ("observed_ns", _L))
FOUND = T.StructType([*INPUT.fields, T.StructField("expected", _L)])
#: Rows that break within their slice (``expected``), and ends of slices.
CUT = T.StructType([*FOUND.fields, T.StructField("first", _B), T.StructField("last", _B)])
NUMBER = S.struct_of(("number", _L))
FoundRow = Row(*FOUND.fieldNames())


def _filled(df: DataFrame, **columns: str) -> DataFrame:
    named = {"boot_id": "coalesce(boot_id, '')" if "boot_id" in df.columns else "''",
             "client": "coalesce(client, '')" if "client" in df.columns else "''", "event_ns": "observed_ns", **columns}
    return S.conform(df.selectExpr("host_id", "pos", "observed_ns", *[f"{e} AS {c}" for c, e in named.items()]), INPUT)


def sequence_rows(records: DataFrame) -> DataFrame:
    return _filled(records, audit=f"'{SEQUENCE}'", cursor="CAST(cpu AS string)", number="CAST(seq AS bigint)")


def endpoint_rows(records: DataFrame) -> DataFrame:
    """Sequence 0 moves no cursor and is left out."""
    return _filled(records.where("seq <> 0"), audit=f"'{ENDPOINT}'", number="CAST(seq AS bigint)",
                   cursor="CASE WHEN global_sequence THEN '' ELSE kind END",
                   event_ns="event_ns" if "event_ns" in records.columns else "observed_ns")


def lost_rows(counters: DataFrame) -> DataFrame:
    return _filled(counters, audit=f"'{LOST}'", cursor="backend", number="lost_total")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CUT rows of slices, each of them whole in this task."""
    table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    table = table.filter(pc.or_kleene(pc.not_equal(table["audit"], LOST), pc.is_valid(table["number"])))
    table = table.sort_by([(c, "ascending") for c in (*CURSOR, SLICE, "pos")]).combine_chunks()
    rows = table.num_rows
    if not rows:
        return
    begins = np.ones(rows, bool)
    begins[1:] = False
    for column in (*CURSOR, SLICE):
        codes = table[column].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    ends = np.append(begins[1:], True)
    audit = table["audit"]
    number = table["number"].combine_chunks()
    before = pa.concat_arrays([pa.nulls(1, pa.int64()), number[:-1]])
    following = pc.add(before, 1)
    wrapped = pc.if_else(pc.equal(following, gaps.SEQUENCE_MODULUS), 0, following)
    expected = pc.if_else(pc.equal(audit, SEQUENCE), wrapped, following)
    lost = pc.equal(audit, LOST).to_numpy().astype(bool)
    breaks = pc.not_equal(number, expected).fill_null(False).to_numpy(zero_copy_only=False) & ~begins & ~lost
    # A counter's rows that pass all before them in the slice.
    numbers = pd.Series(number.fill_null(0).to_numpy())
    so_far = numbers.groupby(np.cumsum(begins)).cummax().to_numpy()
    passes = np.append(True, so_far[1:] > so_far[:-1]) | begins
    first, last = np.where(lost, passes, begins), np.where(lost, passes, ends)
    expected = pc.if_else(pa.array(breaks), expected, pa.nulls(rows, pa.int64()))
    found = table.drop_columns([SLICE]).append_column("expected", expected) \
        .append_column("first", pa.array(first)).append_column("last", pa.array(last)).filter(pa.array(breaks | first | last))
    yield from found.combine_chunks().to_batches(max_chunksize=10_000)


def cut(rows: DataFrame, width: int = SLICED) -> DataFrame:
    """Breaks within slices of ``width`` positions, and the slices' ends (CUT)."""
    sliced = S.conform(rows, INPUT).selectExpr("*", f"{slice_of('pos', width)} AS {SLICE}")
    return sliced.repartition(*CURSOR, SLICE).mapInArrow(_cut, CUT)


class Cursor(StatefulProcessor):
    """State: the last number of a cursor; of a counter, the greatest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", NUMBER)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((initialState.number,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        audit = key[0]
        for *row, _, first, ends in sorted((tuple(r)[:len(CUT)] for r in rows), key=lambda r: r[5]):
            number = row[6]
            if audit == LOST:
                if number > (last or 0):
                    yield FoundRow(*row, last or 0)
                last = max(number, last or 0)
                continue
            if first and last is not None:
                expected = last + 1
                if audit == SEQUENCE:
                    expected %= gaps.SEQUENCE_MODULUS
                if number is not None and number != expected:
                    yield FoundRow(*row, expected)
            if ends:
                last = number
        self.last.update((last,))

    def close(self) -> None:
        pass


def audit_events(rows: DataFrame, cursors: DataFrame | None = None, width: int = SLICED) -> DataFrame:
    """Gap events of a stream of INPUT rows; ``cursors`` (INPUT columns) continues from an earlier run."""
    sliced = cut(rows, width)
    met = stateful(sliced.where("first OR last"), CURSOR, Cursor(), FOUND, None if cursors is None else S.conform(cursors, INPUT))
    found = met.unionByName(sliced.where("expected IS NOT NULL").select(*FOUND.fieldNames()))
    kind = lambda sequence, endpoint, lost: (
        f"CASE audit WHEN '{SEQUENCE}' THEN {sequence} WHEN '{ENDPOINT}' THEN {endpoint} ELSE {lost} END")
    return gaps.gap_events(
        found, kind(gaps.sequence_text("CAST(cursor AS bigint)", "expected", "number"), gaps.endpoint_text("expected", "number"),
                    gaps.lost_text("cursor", "number - expected")),
        kind(f"'{S.LINUX_CONNECTOR}'", f"'{S.MACOS_ENDPOINT}'", "cursor"), kind("CAST(cursor AS int)", "0", "0"),
        event_ns="event_ns", phase=kind(gaps.BEFORE, gaps.BEFORE, gaps.AFTER))
