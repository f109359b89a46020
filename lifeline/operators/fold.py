"""One step of a replay in Python: what a row does to the process known for its PID.

Shared by streams, whose state is the engine's, and by the batch replay's rare fold.
Processes are tuples in the order of ``PROCESS_COLUMNS``.
"""

from __future__ import annotations

from lifeline import schemas as S
from lifeline.functions import identity as I

SEED, SCAN, ABSENT = "seed", "scan", "absent"
_AT = {name: i for i, name in enumerate(S.PROCESS_COLUMNS)}
ID, PPID, STARTED, CAPTURED = (_AT[c] for c in ("process_id", "ppid", "started_ns", "captured_ns"))


def provisional(text: str) -> bool:
    return ":" in text and text.split(":", 1)[0] in I.PROVISIONAL


def same_process(old: str, old_start: int | None, new: str, new_start: int | None) -> bool:
    """Equal IDs, or a provisional one and known starts at most two seconds apart."""
    if old == new:
        return True
    if old_start is None or new_start is None or not (provisional(old) or provisional(new)):
        return False
    return abs(old_start - new_start) <= I.GENERATION_TOLERANCE_NS


def alignable(family: str | None, old: str, align_all: bool) -> bool:
    """Whether a scan may give a stable ID to a process known by this one."""
    return (align_all and provisional(old)) or (family == "linux" and old.startswith(I.CONNECTOR + ":"))


def keeps(kind: str, family: str | None, old: tuple, new: tuple, align_all: bool = False) -> bool:
    """Whether a row that shows ``new`` continues the live process ``old``."""
    if kind == S.START:
        return same_process(old[ID], old[STARTED], new[ID], new[STARTED])
    if kind == SCAN:
        return old[ID] == new[ID] or (
            alignable(family, old[ID], align_all) and same_process(old[ID], old[STARTED], new[ID], new[STARTED]))
    return True


def after(kind: str, family: str | None, old: tuple | None, new: tuple | None, solid: bool,
          align_all: bool = False) -> tuple[tuple | None, bool]:
    """The process after a row, and whether it is a new generation."""
    if kind in (S.STOP, ABSENT):
        return None, False
    if old is None or not keeps(kind, family, old, new, align_all):
        return new, True
    if solid:
        known = list(new)
        known[STARTED] = new[STARTED] if old[STARTED] is None else old[STARTED]
        known[CAPTURED] = new[CAPTURED] if old[CAPTURED] is None else old[CAPTURED]
        return tuple(known), False
    if kind == S.START:
        return (*old[:PPID], new[PPID], *old[PPID + 1:]), False
    return old, False
