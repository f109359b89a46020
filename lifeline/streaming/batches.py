"""A sink whose commits name the micro-batch: a repeated batch leaves one copy.

Tasks write files aside; the commit puts them in the folder of their batch, in place of
whatever an earlier try of it left there. A failed write fails the query, and what it wrote is
removed. The folder is reached through the file system its address names, so driver
and executors share it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from lifeline.streaming.engine import rocksdb

NAME = "lifeline_batches"
STAGED = "_staged"


@dataclass
class Written(WriterCommitMessage):
    file: str | None


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class BatchWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = located(self.path)
        file, writer = f"{root}/{STAGED}/{uuid.uuid4().hex}.parquet", None
        schema = to_arrow_schema(self.schema)
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    files.create_dir(f"{root}/{STAGED}", recursive=True)
                    writer = pq.ParquetWriter(file, schema, filesystem=files, coerce_timestamps="us")
                writer.write_batch(batch.cast(schema))
        if writer is None:
            return Written(None)
        writer.close()
        return Written(file)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803  the engine's name
        files, root = located(self.path)
        folder = f"{root}/batch={batchId}"
        if files.get_file_info(folder).type != pafs.FileType.NotFound:
            files.delete_dir(folder)
        files.create_dir(folder, recursive=True)
        for i, message in enumerate(m for m in messages if m is not None and m.file):
            files.move(message.file, f"{folder}/part-{i:05d}.parquet")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        files, _ = located(self.path)
        for message in messages:
            if message is not None and message.file and files.get_file_info(message.file).type != pafs.FileType.NotFound:
                files.delete_file(message.file)


class Batches(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> BatchWriter:  # noqa: N802  the engine's name
        return BatchWriter(self.options["path"], schema)


def start(events: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Write a stream's rows below ``path``, a folder per micro-batch."""
    events.sparkSession.dataSource.register(Batches)
    writer = events.writeStream.format(NAME).option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with rocksdb(events.sparkSession):
        return writer.start()


def written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of committed batches; files put aside are never seen."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*")
