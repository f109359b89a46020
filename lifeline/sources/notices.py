"""Raw change records of three families, normalised to one notice table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.functions.clock import event_ns_of_filetime, exit_code_of_wait_status

# Record kinds and opcodes, provider, and the message versions that bring a field.
FORK, EXEC, EXIT = 0x00000001, 0x00000002, 0x80000000
OPCODE_START, OPCODE_STOP = 1, 2
PROCESS_PROVIDER = "process"
TTY_SINCE, START_SINCE, CWD_SINCE, GLOBAL_SEQUENCE_SINCE = 2, 3, 3, 4


def linux_records(raw: DataFrame) -> DataFrame:
    """Typed connector records with ``relevant``: raw has host_id, pos, cpu, seq, what,
    process_pid, process_tgid (for forks the child's), parent_tgid, exit_status, kernel_ns,
    observed_ns.

    Thread records and unknown kinds keep their sequence number but are not relevant.
    """
    what = F.col("what")
    kind = F.when(what == FORK, "fork").when(what == EXEC, "exec").when(what == EXIT, "exit")
    return raw.withColumns({
        "family": F.lit("linux"), "kind": kind,
        "relevant": kind.isNotNull() & (F.col("process_pid") == F.col("process_tgid")),
        "pid": F.col("process_tgid"),
        "ppid": F.when(what == FORK, F.col("parent_tgid")),
        "exit_code": F.when(what == EXIT, exit_code_of_wait_status(F.col("exit_status"))),
    })


def linux_notices(records: DataFrame) -> DataFrame:
    """Notices of relevant records; audit sequences before this step, not after."""
    return S.conform(records.where("relevant"), S.NOTICE)


def windows_notices(raw: DataFrame) -> DataFrame:
    """Raw has provider, opcode, property_*, payload_*, header_pid, filetime, observed_ns.

    A property counts if present, for the PID only if non-zero; the payload comes
    next and for the PID the record header last.
    """
    nonzero = lambda c: F.nullif(F.col(c), F.lit(0))
    stop = F.col("opcode") == OPCODE_STOP
    rows = raw.where(
        (F.col("provider") == PROCESS_PROVIDER) & F.col("opcode").isin(OPCODE_START, OPCODE_STOP)
    ).withColumns({
        "family": F.lit("windows"), "kind": F.when(stop, S.STOP).otherwise(S.START),
        "pid": F.coalesce(nonzero("property_pid"), nonzero("payload_pid"), nonzero("header_pid")),
        "ppid": F.coalesce("property_parent", "payload_parent", F.lit(0)),
        "exit_code": F.when(stop, F.coalesce("property_status", "payload_status")),
        "event_ns": event_ns_of_filetime(F.col("filetime"), F.col("observed_ns")),
    })
    return S.conform(rows.where(F.col("pid").isNotNull()), S.NOTICE)


def macos_records(raw: DataFrame) -> DataFrame:
    """Self-described endpoint records: raw has message_version, kind, pid, ppid, uid, tty,
    session, pid_version, started_ns, event_ns, exe, args, cwd, exit_status, seq, global_seq.
    """
    version = F.col("message_version")
    since = lambda n, c: F.when(version >= n, F.col(c))
    rows = raw.where(F.col("kind").isin("fork", "exec", "exit") & (F.col("pid") > 0)).withColumns({
        "family": F.lit("macos"), "tty": since(TTY_SINCE, "tty"),
        "started_ns": F.nullif(since(START_SINCE, "started_ns"), F.lit(0)),
        "cwd": F.when(F.col("kind") == "exec", since(CWD_SINCE, "cwd")),
        "command": F.when(F.col("kind") == "exec", F.array_join("args", " ")).otherwise(F.col("exe")),
        "exit_code": F.when(F.col("kind") == "exit", exit_code_of_wait_status(F.col("exit_status"))),
        "global_sequence": version >= GLOBAL_SEQUENCE_SINCE,
        "seq": F.when(version >= GLOBAL_SEQUENCE_SINCE, F.col("global_seq")).otherwise(F.col("seq")),
    })
    return rows


def macos_notices(records: DataFrame) -> DataFrame:
    """Notices with their process; attach user names to ``records`` beforehand."""
    names = set(records.columns)
    filled = records if "user" in names else records.withColumn("user", F.col("uid"))
    process = S.process_struct(process_id="NULL", captured_ns="observed_ns")
    return S.conform(filled.withColumn("proc", F.expr(process)), S.NOTICE)


def unify_notices(*families: DataFrame) -> DataFrame:
    whole = families[0]
    for other in families[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole
