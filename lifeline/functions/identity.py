"""Process identity: IDs, generations and change tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of provisional IDs and the start tolerance.
CONNECTOR, ETW, ES, TRACE_ROOT = "connector", "etw", "es", "trace"
PROVISIONAL = (CONNECTOR, ETW, ES, TRACE_ROOT)
GENERATION_TOLERANCE_NS = 2_000_000_000


def process_id(pid: Column, token: Column) -> Column:
    """``pid:token``, or ``pid`` alone when the token is missing."""
    return F.concat_ws(":", pid.cast("string"), F.nullif(token.cast("string"), F.lit("")))


def provisional_id(prefix: str, pid: Column, token: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), pid.cast("string"), token.cast("string"))


def is_provisional(process_id: str) -> str:
    """SQL text: the ID is a stand-in until a stable one is known."""
    return (
        f"(contains({process_id}, ':') AND substring_index({process_id}, ':', 1) IN "
        f"({', '.join(repr(p) for p in PROVISIONAL)}))"
    )


def same_generation(pid_a: str, id_a: str, start_a: str, pid_b: str, id_b: str, start_b: str) -> str:
    """SQL text: same PID, and equal IDs or a provisional ID with known starts at most 2 s apart."""
    near = f"coalesce(abs({start_a} - {start_b}) <= {GENERATION_TOLERANCE_NS}, false)"
    return (
        f"coalesce({pid_a} = {pid_b} AND ({id_a} = {id_b} OR "
        f"(({is_provisional(id_a)} OR {is_provisional(id_b)}) AND {near})), false)"
    )


def changed(command_a: str, exe_a: str, command_b: str, exe_b: str) -> str:
    """SQL text: command or executable differs; a missing text equals a missing text."""
    return f"(NOT ({command_a} <=> {command_b} AND {exe_a} <=> {exe_b}))"
