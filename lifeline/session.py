"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; safe to call on any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode a temporary one, with a warning, if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    warnings.warn("spark.checkpoint.dir is not set: intermediate tables go to a temporary folder of this machine", stacklevel=2)
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lifeline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_stored: list[list[tuple[SparkSession, str]]] = [[]]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own; removed at the end of the innermost ``stored`` block, or of Python."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _stored[-1].append((spark, path))
    return path


def _remove(folders: list[tuple[SparkSession, str]]) -> None:
    for spark, path in folders:
        if spark.sparkContext._jsc is None:              # the session has ended
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    folders.clear()


@contextmanager
def stored() -> Iterator[None]:
    """Remove the intermediate tables made inside once their results have been written."""
    _stored.append([])
    try:
        yield
    finally:
        _remove(_stored.pop())


@atexit.register
def _at_exit() -> None:
    for folders in _stored:
        try:
            _remove(folders)
        except Exception:  # noqa: BLE001  the engine may have ended before Python
            return


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage by writing a table in the shared folder.

    A written table outlives any executor, keeps its columns prunable and gives
    the next round real size statistics to plan with.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
