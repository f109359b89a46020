"""Snapshot differences on literal cases and against a literal loop."""

import random

import pytest
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.operators import diff as D

SECOND = 10**9
SCAN = ("host_id long, scan_id long, process_id string, pid long, ppid long, command string, exe string, "
        "started_ns long, captured_ns long, row_pos long")
MANIFEST = "host_id long, scan_id long, pos long, success boolean, error string, observed_ns long"


def scans(spark, rows):
    return spark.createDataFrame(rows, SCAN)


def run(spark, rows, manifest, **options):
    prepared = D.attach_manifest(scans(spark, rows), D.scan_ordinals(spark.createDataFrame(manifest, MANIFEST)))
    return D.snapshot_diff(prepared, **options), prepared


def good(host, scan, seconds):
    return (host, scan, scan, True, None, seconds * SECOND)


def test_literal_cases(spark):
    # Literal cases of the behaviour that must be met.
    s = SECOND
    rows = [
        (1, 0, "7:1", 7, 1, "a", "/a", 10 * s, 20 * s, 0), (1, 1, "7:1", 7, 1, "a", "/a", 11 * s, 21 * s, 0),
        (2, 0, "7:1", 7, 1, "a", "/a", None, 20 * s, 0), (2, 1, "7:1", 7, 1, "a", "/a", 10 * s, 21 * s, 0),
        (3, 0, "7:1", 7, 1, "worker --mode one", "/bin/worker", 1 * s, 1 * s, 0),
        (3, 1, "7:1", 7, 1, "worker --mode two", "/bin/worker-v2", 1 * s, 1 * s, 0),
        (4, 0, "1:1", 1, 0, "init", "/init", 1 * s, 1 * s, 0), (4, 1, "1:1", 1, 0, "init", "/init", 1 * s, 1 * s, 0),
        (4, 1, "2:1", 2, 1, "child", "/child", 10 * s, 12 * s, 0),
        (5, 0, "7:1", 7, 1, "a", "/a", 10 * s, 19 * s, 0),
    ]
    manifest = [good(h, k, t) for h in range(1, 6) for k, t in ((0, 5), (1, 12 if h == 4 else 25))]
    events, prepared = run(spark, rows, manifest)
    first = {r["host_id"]: (r["first_started_ns"], r["first_captured_ns"])
             for r in D.first_observation(prepared).where("ordinal = 1 AND pid = 7").collect()}
    assert first[1] == (10 * s, 20 * s) and first[2] == (10 * s, 20 * s)
    got = {(r["host_id"], r["kind"], r["pid"]): r for r in events.collect()}
    assert set(got) == {(3, "exec", 7), (4, "start", 2), (5, "stop", 7)}
    assert (got[3, "exec", 7]["command"], got[3, "exec", 7]["exe"]) == ("worker --mode two", "/bin/worker-v2")
    assert (got[4, "start", 2]["event_ns"], got[4, "start", 2]["observed_ns"]) == (10 * s, 12 * s)
    assert got[5, "stop", 7]["duration_ms"] == 15000
    assert events.drop("lookup_ordinal").schema.simpleString() == S.LIFECYCLE_EVENT.simpleString()


def history(seed, hosts=6, length=25):
    rng = random.Random(seed)
    rows, manifest, tables = [], [], {}
    for host in range(hosts):
        table = {}
        for k in range(length):
            for pid in range(1, 7):
                roll = rng.random()
                if pid in table and roll < 0.12:
                    del table[pid]
                elif pid not in table and roll < 0.5:
                    table[pid] = [f"{pid}:{rng.choice([1, 1, k])}", pid, rng.randrange(0, 7), rng.choice("ab"), "/x", None, 0]
                elif pid in table:
                    table[pid][3] = rng.choice("aab")
                if pid in table:
                    table[pid][5] = rng.choice([None, None, (k * 10 - 3) * SECOND])
                    table[pid][6] = (k * 10 + 1) * SECOND
            ok = rng.random() > 0.2
            manifest.append((host, k, k * 3, ok, None if ok else "E", (k * 10 + 2) * SECOND))
            if ok:
                tables[host, k] = {r[0]: tuple(r) for r in table.values()}
                rows += [(host, k, *r, 0) for r in table.values()]
    return rows, manifest, tables


def expected_events(manifest, tables):
    out, state = [], {}
    for host, k, pos, ok, _, now in manifest:
        if not ok:
            continue
        new = {i: list(r) for i, r in tables[host, k].items()}
        if host not in state:
            state[host] = new
            continue
        old = state[host]
        for i, r in new.items():
            if i in old:
                r[6] = old[i][6]
                r[5] = old[i][5] if old[i][5] is not None else r[5]
                if old[i][3] != r[3]:
                    out.append((host, pos, "exec", i, now, now, None))
            else:
                out.append((host, pos, "start", i, r[5] if r[5] is not None else now, now, None))
        for i, r in old.items():
            if i not in new:
                began = r[5] if r[5] is not None else r[6]
                out.append((host, pos, "stop", i, now, now, max(0, now - began) // 10**6))
        state[host] = new
    return sorted(map(str, out))


@pytest.mark.parametrize("width", [2, 3, 7, 4096])
def test_diff_equals_loop(spark, width):
    rows, manifest, tables = history(11)
    events, _ = run(spark, rows, manifest, width=width)
    got = events.selectExpr("host_id", "order_key.pos", "kind", "process_id", "event_ns", "observed_ns", "duration_ms").collect()
    assert sorted(str(tuple(r)) for r in got) == expected_events(manifest, tables)


def test_failed_scan_is_a_gap_and_skipped(spark):
    rows = [(0, k, "1:1", 1, 0, "a", "/a", 1, 1, 0) for k in (0, 2)]
    manifest = [good(0, 0, 1), (0, 1, 1, False, "denied", 2 * SECOND), good(0, 2, 3)]
    events, _ = run(spark, rows, manifest)
    assert events.count() == 0
    gap = D.failed_scan_gaps(spark.createDataFrame(manifest, MANIFEST)).collect()
    assert [g["message"] for g in gap] == [
        "process snapshot failed; expected a complete process table, received error denied"]


def test_pair_diff_and_duplicates(spark):
    full = [c for c in S.PROCESS.fieldNames()]
    table = lambda rows: spark.createDataFrame(
        [tuple({**dict.fromkeys(full), **r}[c] for c in full) + (1,) for r in rows],
        S.T.StructType([*S.PROCESS.fields, S.T.StructField("host_id", S.T.LongType())]))
    a = table([dict(process_id="1:1", pid=1, command="a", started_ns=SECOND, captured_ns=0),
               dict(process_id="2:1", pid=2, command="b", captured_ns=0), dict(process_id="3:1", pid=3, command=None)])
    b = table([dict(process_id="2:1", pid=2, command="b2", captured_ns=0), dict(process_id="3:1", pid=3, command=None),
               dict(process_id="4:1", pid=4, started_ns=7)])
    codes = D.last_exit_codes(spark.createDataFrame(
        [(1, 1, 1, 5), (1, 1, 2, 6), (1, 1, 3, None), (1, 2, 1, 9)], "host_id long, pid long, pos long, exit_code long"))
    got = {r["pid"]: r for r in D.pair_diff(a, b, 3 * SECOND, exit_codes=codes).collect()}
    assert {p: r["kind"] for p, r in got.items()} == {1: "stop", 2: "exec", 4: "start"}
    assert got[1]["exit_code"] == 6 and got[1]["duration_ms"] == 2000 and got[2]["exit_code"] is None
    assert got[4]["event_ns"] == 7
    assert [r["pid"] for r in D.only_started(a, b).collect()] == [4]
    assert [r["pid"] for r in D.only_stopped(a, b).collect()] == [1]
    twice = scans(spark, [(0, 0, "1:1", 1, 0, "old", "/a", 5, 1, 1), (0, 0, "1:1", 1, 0, "new", "/a", 4, 1, 2),
                          (0, 0, "1:2", 1, 0, "late", "/a", 9, 1, 3), (0, 0, "1:3", 1, 0, "none", "/a", None, 1, 4)])
    once = D.dedup_scan(twice)
    assert {r["process_id"]: r["command"] for r in once.collect()} == {"1:1": "new", "1:2": "late", "1:3": "none"}
    assert [r["command"] for r in D.one_per_pid(once).collect()] == ["late"]


@pytest.mark.parametrize("size", [10, 100, 1000])
def test_burst(spark, size):
    import bench

    kinds = bench.burst(spark, size).groupBy("kind").agg(F.count(F.lit(1))).collect()
    assert [tuple(k) for k in kinds] == [("start", size)]
