import hashlib
import random
import re
import zlib
from functools import lru_cache

from lifeline.llm import conversation_repair as repairing
from lifeline.llm import queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conversation, turn, role, text in rows:
        text, role = (" " if text is None else text), (" " if role is None else role)
        way = zlib.crc32(f"{' ' if conversation is None else conversation}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows, faults):
    """Least (cost, edits) over all edit strings of bounded insertions, with the repaired turns; tried one by one."""
    @lru_cache(None)
    def best(at, form, left):
        found = []
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", form):
            found.append((0, "", ()))
        if left:
            found += [step(INSERT, "I", (role, ""), best(at, short(form + role[0]), left - 1)) for role in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            found.append(step(3, "D", None, best(at + 1, form, 3)))
            if faults[at] in (None, "truncated"):
                more = faults[at] == "truncated"
                found.append(step(more, "K", (role, text), best(at + 1, short(form + (role[:1] or "?")), 3)))
                found += [step(2 + more, "R", (r, text), best(at + 1, short(form + r[0]), 3)) for r in ("user", "assistant")]
        return min(found, default=(10 ** 9, "", ()))

    INSERT = 2

    def short(form):
        """Repeated pairs change nothing in what may follow."""
        return re.sub("^(s?)(ua)+(?=ua)", r"\1", form) if re.fullmatch("s?(ua)*u?", form) else "x"

    def step(cost, edit, turn, rest):
        return cost + rest[0], edit + rest[1], ((turn,) if turn else ()) + rest[2]

    return best(0, "", 3)


def expected(conversation, rows):
    rows = damage(rows)
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.strip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = cheapest(tuple(rows), tuple(faults))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (conversation, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r))
    return sorted((expected(c, r) for c, r in out.items()), key=str)


def run(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in repairing.repair(repairing.damaged(turns)).collect()), key=str)


def test_random_conversations(spark):
    chance = random.Random(4)
    rows = []
    for conversation in range(150):
        for turn in range(chance.randint(1, 7)):
            rows.append((
                conversation or None, chance.choice([turn, turn, turn, turn + 1, None]),
                chance.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                chance.choice(["Yes.", "No!", "cut off", "", None, " \n", "Ends. ", "é?  ", f"turn {turn}."])))
    chance.shuffle(rows)
    assert run(spark, rows) == grouped(rows)


def test_query_on_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, SF)
    assert got.columns == list(repairing.COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == grouped(rows)


def test_conversation_over_many_batches(spark):
    """State is carried across Arrow batches; a long conversation equals the concatenation of its parts."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(400)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r[0]: r for r in run(spark, rows)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = damage(rows[:400])
    assert len(got[1][7].replace("I", "")) == len(left) and got[1][1] == 400 - len({r[0] for r in left}) - (left[0][0] + 399 - left[-1][0])
    assert got[2] == expected(2, rows[400:])


def test_no_rows_and_other_columns(spark):
    assert run(spark, []) == []
    turns = spark.createDataFrame([(1, 1, "user", "Hi.", 9, "x")], SCHEMA + ", code int, gone string")
    assert [tuple(r) for r in repairing.repair(repairing.damaged(turns)).collect()] == [expected(1, [(1, 1, "user", "Hi.")])]


def test_dropped_conversations_stay(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert run(spark, [(7, turn, "user", "Hi.")]) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
