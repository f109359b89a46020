"""The latest events while they arrive: each trigger passes on only what enters the view.

Every task first drops what cannot be among the latest ``size`` of its own rows. Every
bucket of hosts keeps the places of its latest ``size`` events as list state and
passes on rows that come after the least of them. The view is the latest ``size`` of all
that was passed on, at most ``size`` rows per bucket and trigger, whatever arrived.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lifeline import schemas as S
from lifeline.operators.views import RETAINED, recent
from lifeline.streaming.engine import BUCKETS, dealt, get_rows, packed, put_rows, stateful

_L, _S = T.LongType(), T.StringType()
PLACE = S.struct_of(("pos", _L), ("phase", _L), ("pid", _L), ("sub", _L), ("host_id", _L), ("kind", _S))
Event = Row(*S.LIFECYCLE_EVENT.fieldNames())


def place(row: Row) -> tuple:
    key = row.order_key
    return key["pos"], key["phase"], key["pid"], key["sub"], row.host_id, row.kind


def _latest(size: int):
    """Of a task's rows the latest ``size``, few more than that held at any time."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows > 4 * size:
                held = _top(held, size)
        if held is not None:
            yield from _top(held, size).combine_chunks().to_batches()

    return keep


def _top(table: pa.Table, size: int) -> pa.Table:
    key = table["order_key"].combine_chunks()
    parts = {**{c: key.field(c) for c in ("pos", "phase", "pid", "sub")}, "host_id": table["host_id"], "kind": table["kind"]}
    order = pa.table(parts).append_column("_row", pa.array(range(table.num_rows), pa.int64())).sort_by([(c, "descending") for c in parts])
    return table.take(order["_row"][:size])


class Latest(StatefulProcessor):
    """State: the places of the latest events of a bucket."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getListState("places", packed(PLACE))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Bounded: of the batch too, only the latest rows are held.
        arrived = heapq.nlargest(self.size, rows, key=place)
        kept = heapq.nlargest(self.size, get_rows(self.places) + [place(r) for r in arrived])
        yield from (Event(*r[:len(S.LIFECYCLE_EVENT)]) for r in arrived if place(r) >= kept[-1])
        put_rows(self.places, kept)

    def close(self) -> None:
        pass


def entering(events: DataFrame, size: int = RETAINED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a stream of LIFECYCLE_EVENT that enter the view."""
    own = S.conform(events, S.LIFECYCLE_EVENT).mapInArrow(_latest(size), S.LIFECYCLE_EVENT)
    return stateful(dealt(own, "host_id", buckets=buckets), ["bucket"], Latest(size), S.LIFECYCLE_EVENT)


def view(passed_on: DataFrame, size: int = RETAINED) -> DataFrame:
    """The latest events of all that a stream has passed on so far."""
    return recent(passed_on, size)
