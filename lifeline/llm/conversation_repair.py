"""Repair of conversations whose turns were damaged.

Rows are dealt out by conversation and sorted by turn, so a conversation streams through
one task in Arrow batches, and only a few numbers are carried from batch to batch:

1. from the last turn to the first, a dynamic program over four states of the role order
   ``(s?(ua)+)?`` carries the cost of repairing what follows. Each row gets a
   back-pointer of 15 bits: which edit each state chooses there. It travels with the row, so
   Spark's external sort spills it, and no conversation is held in memory;
2. from the first turn to the last, the back-pointers are followed from the start state,
   faults are counted and the repaired turns are hashed as they pass.

Both need rows of one conversation in one task in two orders: one shuffle, then local
sorts. Hashing a conversation in its order allows no more than one task for it; that task
keeps a hash and the string of edits, whatever the length.

Edits: keep a row (free), set its role to what the order needs (2), delete it (3), insert
an empty turn of the needed role (2). Blank and duplicate rows must go; a truncated row
that stays adds 1. In every state at most one role may follow, so the four edits
lead apart and the least letter among the cheapest edits gives the least string.

Rows: null conversation ids are one conversation of their own; null texts and roles count
as one space, null turns come first and count for no gap; turns of equal number are
ordered by role and text; repeated rows are turns like others (and so duplicates); an
empty table gives no rows; columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Costs of the edits, and the roles of inserted turns.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: State -> role initials that may follow and the states they lead to: nothing yet, after
#: a system turn, after a user turn, after an assistant turn.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role that an edit may give in each state.
NEEDED = ("u", "u", "a", "u")
MAY_END = (True, False, False, True)
STATES = range(4)
EDITS = "DIKR"
BITS = 3                       # of an edit in a back-pointer

FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
STOPPED = r"[.!?][\x20\x09-\x0D]*\z"
SEEN = r"[^\x20\x09-\x0D]"


def with_inserts(costs: list[tuple[int, str]]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Let every state also insert the turn it needs; ties take the least letter."""
    best = list(costs)
    for _ in STATES:           # an insertion may need another after it
        for state in STATES:
            after = best[FOLLOWS[state][NEEDED[state]]][0] + INSERT
            best[state] = min(best[state], (after, "I"))
    return tuple(c for c, _ in best), tuple(e for _, e in best)


def pointer(edits: tuple[str, ...]) -> int:
    return sum(EDITS.index(e) << (BITS * s) for s, e in enumerate(edits))


def edit_of(code: int, state: int) -> str:
    return EDITS[code >> (BITS * state) & ((1 << BITS) - 1)]


#: Of a repaired end: the costs of the four states, and their edits ("D" where nothing is left to do).
END = with_inserts([(0, "D") if MAY_END[s] else (1 << 30, "K") for s in STATES])


@lru_cache(maxsize=100_000)
def before(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs before a row and the row's back-pointer, from the costs after it.

    Costs are relative to their least, so few different ones occur.
    """
    extra = TRUNCATED if fault == CUT else 0
    costs = []
    for state in STATES:
        choices = [(after[state] + DELETE, "D")]
        if fault not in (BLANK, DUPLICATE):
            if initial in FOLLOWS[state]:
                choices.append((after[FOLLOWS[state][initial]] + extra, "K"))
            choices.append((after[FOLLOWS[state][NEEDED[state]]] + REROLE + extra, "R"))
        costs.append(min(choices))
    total, edits = with_inserts(costs)
    least = min(total)
    return tuple(c - least for c in total), pointer(edits)


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add a back-pointer to every row; rows come by conversation, last turn first."""
    current: object = backward              # no conversation yet
    costs = END[0]
    for batch in batches:
        codes = []
        for conversation, gone, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "initial", "fault"))):
            if conversation != current:
                current, costs = conversation, END[0]
            code = 0
            if not gone:
                costs, code = before(costs, initial, fault)
            codes.append(code)
        yield batch.append_column("code", pa.array(codes, pa.int32()))


class Repair:
    """One conversation as its rows pass in the order of turns."""

    def __init__(self, conversation):
        self.conversation = conversation
        self.state, self.cost, self.turns_seen, self.rows = 0, 0, 0, 0
        self.first = self.last = None
        self.counts = [0, 0, 0, 0]
        self.illegal, self.previous = 0, None
        self.edits: list[str] = []
        self.hash, self.kept = hashlib.sha256(), 0

    def write(self, role: str, text: str) -> None:
        if self.kept:
            self.hash.update(b"\n")
        self.hash.update(role.encode() + b":" + text.encode())
        self.kept += 1

    def insert(self) -> None:
        initial = NEEDED[self.state]
        self.edits.append("I")
        self.cost += INSERT
        self.write(ROLES[initial], "")
        self.state = FOLLOWS[self.state][initial]

    def add(self, turn, role: str, text: str, initial: str, fault: int, code: int) -> None:
        if turn is not None:
            if turn != self.last:
                self.turns_seen += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.counts[fault] += 1
        if self.rows and (self.previous + initial) not in ("su", "ua", "au"):
            self.illegal += 1
        self.previous, self.rows = initial, self.rows + 1
        while (edit := edit_of(code, self.state)) == "I":
            self.insert()
        self.edits.append(edit)
        if edit == "D":
            self.cost += DELETE
            return
        if edit == "R":
            self.cost += REROLE
            initial = NEEDED[self.state]
            role = ROLES[initial]
        self.cost += TRUNCATED if fault == CUT else 0
        self.write(role, text)
        self.state = FOLLOWS[self.state][initial]

    def result(self) -> tuple:
        while END[1][self.state] == "I":
            self.insert()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns_seen
        return (self.conversation, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.edits), self.hash.hexdigest())


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def forward(kind: pa.DataType):
    """Results from rows with back-pointers; rows come by conversation, first turn first."""
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in COLUMNS[1:7]], *[(c, pa.string()) for c in COLUMNS[7:]]])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair: Repair | None = None
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "initial", "fault", "code"))
            for conversation, gone, *row in zip(*columns):
                if repair is None or repair.conversation != conversation:
                    if repair is not None:
                        done.append(repair.result())
                    repair = Repair(conversation)
                if not gone:
                    repair.add(*row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
        if repair is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(repair.result(), schema.types)], schema=schema)

    return follow


def damaged(rows: DataFrame) -> DataFrame:
    """The stated damage, by crc32 of ``conv_id:turn``; dropped rows stay, marked ``gone``, so that no conversation is lost."""
    space = F.lit(" ")

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), space)

    way = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(way == 0, "").when(way == 1, "").when(way == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(way == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"), (way == 0).alias("gone"), F.explode(F.when(way == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    ).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): its faults, and the
    cheapest repair of its role order."""
    dealt = rows.repartition("conv_id")
    order = ("turn", "role", "text")
    # Partitioned by conversation already, so this needs a sort and no shuffle.
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~F.col("text").rlike(SEEN), BLANK).when(earlier, DUPLICATE).when(~F.col("text").rlike(STOPPED), CUT).otherwise(FINE)
    facts = dealt.select(
        "conv_id", "turn", "role", "text", "gone", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))
    last_first = facts.sortWithinPartitions("conv_id", *[F.desc_nulls_last(c) for c in order])
    coded = last_first.mapInArrow(backward, f"{_ddl(facts)}, code int")
    first_first = coded.sortWithinPartitions("conv_id", *[F.asc_nulls_first(c) for c in order])
    kind = dict(facts.dtypes)["conv_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    follow = forward(to_arrow_type(facts.schema["conv_id"].dataType))
    return first_first.mapInArrow(follow, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS[1:7]) + ", audit string, repaired_sha256 string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)
