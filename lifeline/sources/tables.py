"""Landed process tables and their clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeline import schemas as S
from lifeline.functions.identity import process_id
from lifeline.functions.text import blank_to_null, first_word, strip
from lifeline.operators.diff import attach_manifest, dedup_scan, scan_ordinals


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landed Parquet table under a fixed schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def unify(*platforms: DataFrame) -> DataFrame:
    """One table from tables whose platforms know different fields."""
    whole = platforms[0]
    for other in platforms[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole


def process_scans(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of successful scans, unique per process, with ordinals and times."""
    return attach_manifest(dedup_scan(scans), scan_ordinals(manifest))


def captured(df: DataFrame) -> DataFrame:
    """Strip the text fields of a captured process; blanks become nulls."""
    return df.withColumns({
        c: blank_to_null(strip(F.col(c))) for c in ("command", "exe", "cwd", "user") if c in df.columns
    })


def macos_processes(raw: DataFrame) -> DataFrame:
    """Defaults of macOS tables: raw has pid, ppid, args, path, comm, uid, tdev, started_ns.

    The command falls back to the short name, the executable to the first word
    of the command; device -1 means no terminal. PIDs of zero or less are kernel rows.
    """
    command = F.coalesce(blank_to_null(F.col("args")), F.col("comm"))
    return captured(raw.where(F.col("pid") > 0).withColumn("command", command).withColumns({
        "exe": F.coalesce(blank_to_null(F.col("path")), first_word(F.col("command"))),
        "tty": F.when(F.col("tdev") != -1, F.col("tdev").cast("string")),
        "process_id": process_id(F.col("pid"), F.col("started_ns")),
    }).drop("args", "path", "comm", "tdev"))


def windows_processes(raw: DataFrame) -> DataFrame:
    """Defaults of Windows tables: raw has pid, ppid, image, detail_command, detail_exe, started_ns.

    Details are optional; the image name stands in for both texts, and an
    unknown start leaves the PID alone as the ID.
    """
    return captured(raw.withColumns({
        "command": F.coalesce(blank_to_null(F.col("detail_command")), F.col("image")),
        "exe": F.coalesce(blank_to_null(F.col("detail_exe")), F.col("image")),
        "process_id": process_id(F.col("pid"), F.col("started_ns")),
    }).drop("image", "detail_command", "detail_exe"))


def resolve_users(df: DataFrame, names: DataFrame) -> DataFrame:
    """User of each host's UID; an unknown UID names itself and a blank one stays blank.

    A plain left join: Spark broadcasts the names if they are small by its own
    measure, and otherwise splits skewed keys (AQE). Of several names of one
    (host, UID) the greatest counts, so that no row is multiplied.
    """
    known = names.groupBy("host_id", "uid").agg(F.max("user").alias("_name"))
    return df.join(known, ["host_id", "uid"], "left").withColumn(
        "user", F.coalesce(blank_to_null(F.col("_name")), blank_to_null(F.col("uid")))
    ).drop("_name")


def integer(c: Column) -> Column:
    """Signed decimal text as a long, else null."""
    return F.when(c.rlike("^[+-]?[0-9]+$"), c).try_cast("long")


PROCESS_SCHEMA = S.PROCESS_SCAN
