"""Running streams on the engine's own state.

State lives in Spark's RocksDB store, versioned by micro-batch together with the
checkpoint and the output's log, so a lost executor or driver repeats a batch from the
state it started with. A processor sees one key at a time. Keys that may be hot (a
host) are dealt to ``BUCKETS`` parts wherever rows of one PID suffice; rows that
concern all of them (the end of a scan) go to every part.

Rows of a key are sorted by position within a micro-batch; between micro-batches
they must land in the order of positions, as collectors append them.

The engine hands rows to Python value by value. Where that would take longer than the work, a
task packs the rows of each key first, and a processor reads and gives out tables (``tables_of``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

BUCKETS = 8
#: Rows in one value of a list state.
PACK = 500
#: Rows in Arrow's format, as one value.
TABLE = T.StructType([T.StructField("rows", T.BinaryType())])
TableRow = Row(*TABLE.fieldNames())
TABLE_ROWS = 10_000      # rows in one such value that a processor makes
PACKED_ROWS = 200_000    # rows that a task packs at a time
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def landed(spark: SparkSession, folder: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """Stream of a folder to which collectors append files; at most ``files`` per micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)


def start(events: DataFrame, folder: str, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Append a stream's rows to ``folder``/events, each micro-batch once."""
    writer = events.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with rocksdb(events.sparkSession):
        return writer.start(f"{folder}/events")


def start_batches(events: DataFrame, folder: str, each: Callable[[DataFrame, int], None], available_now: bool = True,
                  interval: str = "1 second") -> StreamingQuery:
    """Hand each micro-batch with its number to ``each``, which must bear repetition."""
    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with rocksdb(events.sparkSession):
        return writer.start()


def output(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows written so far."""
    return spark.read.schema(schema).parquet(f"{folder}/events")


def dealt(rows: DataFrame, by: str, everywhere: str = "false", buckets: int = BUCKETS) -> DataFrame:
    """Add ``bucket``, by the hash of a column; rows for which ``everywhere`` (SQL text) holds go to all."""
    return rows.selectExpr("*", f"""explode(CASE WHEN {everywhere} THEN sequence(0, {buckets - 1})
        ELSE array(CAST(pmod(xxhash64(`{by}`), {buckets}) AS int)) END) AS bucket""")


def stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: T.StructType,
             initial: DataFrame | None = None) -> DataFrame:
    """Run a processor per key; ``initial`` (same keys) is handed over before the first row."""
    return rows.groupBy(*[F.col(k) for k in keys]).transformWithState(
        processor, schema, "Append", "None", None if initial is None else initial.groupBy(*[F.col(k) for k in keys]))


def packed(row: T.StructType) -> T.StructType:
    """Type of a list state's values: many rows each."""
    return T.StructType([T.StructField("rows", T.ArrayType(row))])


def put_rows(state, rows: list[tuple]) -> None:
    """Replace a list state's rows; every value costs the engine a call, so they hold many rows."""
    values = [(rows[i:i + PACK],) for i in range(0, len(rows), PACK)]
    state.put(values) if values else state.clear()


def get_rows(state) -> list[tuple]:
    return [tuple(row) for value in state.get() for row in value[0]]


def put_table(table: pa.Table | pa.RecordBatch) -> bytes:
    """One value of TABLE."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def put_tables(table: pa.Table) -> list[tuple[bytes]]:
    """Rows of TABLE: as many as a table's length asks for."""
    return [(put_table(table.slice(i, TABLE_ROWS)),) for i in range(0, table.num_rows, TABLE_ROWS)]


def get_tables(values: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    """The rows of TABLE values, one after the other."""
    return pa.Table.from_batches([b for v in values for b in pa.ipc.open_stream(bytes(v))], schema).combine_chunks()


def replace_tables(state, table: pa.Table) -> None:
    """Replace the rows of a list state of TABLE values."""
    values = put_tables(table)
    state.put(values) if values else state.clear()


def listed(column: pa.Array | pa.ChunkedArray) -> list:
    """A column's values as Python's; integers beside nulls keep their digits."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False).tolist()
    found = values.fill_null(0).to_numpy().tolist()
    for i in np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)):
        found[i] = None
    return found


def tuples(table: pa.Table) -> list[tuple]:
    """A table's rows as Python's, structs as tuples."""
    def values(column) -> list:
        if not pa.types.is_struct(column.type):
            return listed(column)
        column = column.combine_chunks()
        found = list(zip(*[listed(column.field(i)) for i in range(column.type.num_fields)]))
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
            found[i] = None
        return found

    return list(zip(*[values(column) for column in table.columns]))


def table_of(rows: list[tuple], schema: T.StructType) -> pa.Table:
    """The table of ``tuples``."""
    def column(values, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_struct(kind):
            return pa.array(values, kind)
        nothing = (None,) * kind.num_fields
        fields = zip(*[nothing if v is None else v for v in values]) if len(values) else nothing
        return pa.StructArray.from_arrays([pa.array(f or (), kind.field(i).type) for i, f in enumerate(fields)], fields=list(kind),
                                          mask=pa.array([v is None for v in values], pa.bool_()))

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.Table.from_arrays([column(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _of_keys(batches: list[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    table = table.take(pc.sort_indices(table.select(keys), [(k, "ascending") for k in keys])).combine_chunks()
    begins = np.zeros(table.num_rows, bool)
    begins[0] = True
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        begins[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(begins)
    rows = table.select(schema.names).cast(schema)
    values = [put_table(rows.slice(i, j - i)) for i, j in zip(at, [*at[1:], table.num_rows])]
    return pa.RecordBatch.from_arrays(
        [*[table[k].combine_chunks().take(pa.array(at)) for k in keys], pa.array(values, pa.binary())], names=[*keys, "rows"])


def tables_of(rows: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """``keys`` and the rows (``schema``) of each of them as few TABLE values."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, arrow = [], 0, to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= PACKED_ROWS:
                yield _of_keys(held, keys, arrow)
                held, count = [], 0
        if count:
            yield _of_keys(held, keys, arrow)

    return rows.mapInArrow(pack, T.StructType([*[rows.schema[k] for k in keys], *TABLE.fields]))


def rows_of(tables: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows (``schema``) of TABLE values."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("rows"):
                yield from pa.ipc.open_stream(value.as_buffer())

    return tables.select("rows").mapInArrow(unpack, schema)
