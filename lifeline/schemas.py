"""Column contracts shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
_U64 = T.DecimalType(20, 0)


def struct_of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


PROCESS_FIELDS = (
    ("process_id", _S), ("pid", _L), ("ppid", _L), ("command", _S), ("exe", _S),
    ("cwd", _S), ("user", _S), ("uid", _S), ("tty", _S), ("session", _S),
    ("started_ns", _L), ("captured_ns", _L),
)
PROCESS = struct_of(*PROCESS_FIELDS)
PROCESS_COLUMNS = tuple(name for name, _ in PROCESS_FIELDS)

SUMMARY_FIELDS = (("pid", _L), ("process_id", _S), ("command", _S), ("exe", _S), ("user", _S))
SUMMARY = struct_of(*SUMMARY_FIELDS)
SUMMARY_COLUMNS = tuple(name for name, _ in SUMMARY_FIELDS)

PROCESS_SCAN = struct_of(
    ("host_id", _L), ("boot_id", _S), ("scan_id", _L), *PROCESS_FIELDS, ("row_pos", _L)
)
SCAN_MANIFEST = struct_of(
    ("host_id", _L), ("scan_id", _L), ("pos", _L), ("success", _B), ("error", _S),
    ("observed_ns", _L), ("booted_ns", _L), ("collector_pid", _L), ("backend", _S),
)
NOTICE = struct_of(
    ("host_id", _L), ("boot_id", _S), ("family", _S), ("pos", _L), ("kind", _S), ("pid", _L),
    ("ppid", _L), ("exit_code", _L), ("kernel_ns", _U64), ("event_ns", _L), ("observed_ns", _L),
    ("pid_version", _L), ("proc", PROCESS),
)
SEQ_RECORD = struct_of(
    ("host_id", _L), ("boot_id", _S), ("family", _S), ("pos", _L), ("cpu", _L), ("kind", _S),
    ("seq", _U64), ("global_sequence", _B), ("relevant", _B), ("observed_ns", _L),
)
NOTICE_BATCH = struct_of(
    ("host_id", _L), ("batch_id", _L), ("pos", _L), ("truncated", _B), ("overrun", _B),
    ("malformed", _B), ("receive_overflow", _B), ("lost_total", _L), ("observed_ns", _L),
    ("backend", _S),
)
CLOCK_ANCHOR = struct_of(
    ("host_id", _L), ("boot_id", _S), ("pos", _L), ("monotonic_ns", _U64), ("wall_ns", _L),
    ("valid", _B),
)
UID_NAME = struct_of(("uid", _S), ("user", _S))
SOURCE_HEALTH = struct_of(
    ("host_id", _L), ("requested", _S), ("backend", _S), ("available", _B), ("failed_pos", _L),
    ("error", _S), ("observed_ns", _L),
)
TRACE_REQUEST = struct_of(
    ("trace_id", _L), ("host_id", _L), ("root_pid", _L), ("parent_pid", _L),
    ("argv", T.ArrayType(_S)), ("started_ns", _L), ("started_pos", _L), ("exited_ns", _L),
    ("exit_code", _L), ("exited_pos", _L), ("poll_ns", _L), ("tail_ns", _L),
    ("cancelled_ns", _L), ("cancelled_pos", _L),
)
ORDER_KEY = struct_of(("pos", _L), ("phase", T.IntegerType()), ("pid", _L), ("sub", T.IntegerType()))
LIFECYCLE_EVENT = struct_of(
    ("host_id", _L), ("order_key", ORDER_KEY), ("kind", _S), ("event_ns", _L),
    ("event_time", T.TimestampType()), ("observed_ns", _L), ("process_id", _S), ("pid", _L),
    ("ppid", _L), ("command", _S), ("exe", _S), ("cwd", _S), ("user", _S), ("uid", _S),
    ("tty", _S), ("session", _S), ("duration_ms", _L), ("exit_code", _L), ("backend", _S),
    ("count", _L), ("message", _S), ("parent_chain", T.ArrayType(SUMMARY)), ("trace_id", _L),
)

# Event kinds and source names.
START, EXEC, STOP, GAP = "start", "exec", "stop", "gap"
AUTO, POLL = "auto", "poll"
LINUX_CONNECTOR = "linux-proc-connector"
WINDOWS_ETW = "windows-etw"
MACOS_ENDPOINT = "macos-endpoint-security"
TRACE = "trace"
BACKEND_OF_FAMILY = {"linux": LINUX_CONNECTOR, "windows": WINDOWS_ETW, "macos": MACOS_ENDPOINT}


def conforming(df: DataFrame, schema: T.StructType) -> list[str]:
    """SQL texts of the columns of ``schema``; absent ones are typed nulls."""
    have = set(df.columns)
    return [
        f"CAST({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the columns of ``schema``; absent ones become typed nulls."""
    return df.selectExpr(*conforming(df, schema))


def order_key(pos: str, phase: str | int, pid: str | int = 0, sub: str | int = 0) -> str:
    """SQL text: an event's place in its host's stream - position, phase, PID, part."""
    return (
        f"struct(CAST({pos} AS bigint) AS pos, CAST({phase} AS int) AS phase, "
        f"CAST({pid} AS bigint) AS pid, CAST({sub} AS int) AS sub)"
    )


def as_events(df: DataFrame) -> DataFrame:
    """Conform to LIFECYCLE_EVENT, deriving the timestamp from the nanoseconds."""
    timed = df if "event_time" in df.columns else df.selectExpr(
        "*", "timestamp_micros(event_ns div 1000) AS event_time")
    return conform(timed, LIFECYCLE_EVENT)


def process_struct(source: str = "", **overrides: str) -> str:
    """SQL text: struct of the twelve process fields, from columns unless overridden.

    ``source`` is a struct column to read the fields from.
    """
    prefix = f"{source}." if source else ""
    return "struct(" + ", ".join(
        f"CAST({overrides.get(name, f'{prefix}`{name}`')} AS {kind.simpleString()}) AS `{name}`"
        for name, kind in PROCESS_FIELDS
    ) + ")"


def null_of(kind: T.DataType) -> str:
    return f"CAST(NULL AS {kind.simpleString()})"
