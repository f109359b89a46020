"""Notice replay on literal cases and against a literal loop over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.operators import replay as R
from lifeline.operators.reconcile import align_ids, due_scans
from lifeline.session import materialise

SECOND = 10**9
PROC = S.PROCESS.fieldNames()
LANDED = ("host_id long, family string, pos long, kind string, pid long, ppid long, exit_code long, kernel_ns long, "
          "event_ns long, observed_ns long, pid_version long, proc " + S.PROCESS.simpleString())


def proc(**given):
    return tuple(given.get(c) for c in PROC)


def notice(pos, kind, pid, family="linux", at=0, ppid=None, code=None, kernel=None, details=None, version=None, host=0):
    return (host, family, pos, kind, pid, ppid, code, kernel, at, at, version, details)


def run(spark, rows, **options):
    return R.replay(spark.createDataFrame(rows, LANDED), **options)


def brief(states):
    ordered = R.lifecycle_events(states).orderBy("host_id", "order_key")
    return [(r["kind"], r["pid"], r["process_id"], r["event_ns"], r["duration_ms"], r["exit_code"]) for r in ordered.collect()]


def test_kernel_stamped_life(spark):
    rows = spark.createDataFrame([
        notice(1, "fork", 20, ppid=7, kernel=110, at=99), notice(2, "exec", 20, kernel=120, at=99),
        notice(3, "exit", 20, kernel=130, at=99, code=4)], LANDED)
    anchors = spark.createDataFrame([(0, 0, 100, 30 * SECOND, True)],
                                    "host_id long, pos long, monotonic_ns long, wall_ns long, valid boolean")
    states = R.replay(R.wall_times(rows, anchors))
    one = "connector:20:110"
    assert brief(states) == [
        ("start", 20, one, 30 * SECOND + 10, None, None), ("exec", 20, one, 30 * SECOND + 20, None, None),
        ("stop", 20, one, 30 * SECOND + 30, 0, 4)]
    assert R.live_state(states).count() == 0
    started = states.where("kind = 'start'").select("after.*").first()
    assert (started["ppid"], started["started_ns"]) == (7, 30 * SECOND + 10)


def test_known_process_of_each_family(spark):
    base = spark.createDataFrame([
        (0, 0, "windows", 5, "7:1", 7, 1, "w", "/w", 1, 2), (1, 0, "macos", 5, "7:5", 7, 1, "m", "/m", 5, 6)],
        "host_id long, pos long, family string, observed_ns long, process_id string, pid long, ppid long, "
        "command string, exe string, started_ns long, captured_ns long")
    states = run(spark, [
        notice(1, "stop", 7, "windows", at=3_000_001, code=23),
        notice(1, "exec", 7, "macos", at=9, details=proc(started_ns=5, command="new", exe="/n"), host=1)], baseline=base)
    assert brief(states) == [("stop", 7, "7:1", 3_000_001, 3, 23), ("exec", 7, "7:5", 9, None, None)]
    after = states.where("kind = 'exec'").select("after.*").first()
    assert (after["captured_ns"], after["started_ns"], after["command"]) == (6, 5, "new")
    assert [r["host_id"] for r in R.live_state(states).collect()] == [1]


def test_unknown_stops(spark):
    states = run(spark, [
        notice(1, "exit", 3, at=50, kernel=9, ppid=8, code=1), notice(2, "stop", 4, "windows", at=60, ppid=8),
        notice(3, "exit", 5, "macos", at=70, ppid=8, version=2, details=proc(command="c")),
        notice(4, "exec", 6, at=80, kernel=10, ppid=8)])
    rows = R.lifecycle_events(states).orderBy("order_key").collect()
    assert [(r["process_id"], r["ppid"], r["duration_ms"]) for r in rows] == [
        ("connector:3:9", 0, 0), ("etw:4:60", 8, 0), ("es:5:2", 8, 0), ("connector:6:10", 0, None)]


@pytest.mark.parametrize("fold_all", [False, True])
def test_starts_on_a_live_pid(spark, fold_all):
    s = SECOND
    detail = lambda start: proc(process_id=f"1:{start}", pid=1, ppid=2, started_ns=start)
    states = run(spark, [
        # reuse: implicit stop without a code
        notice(1, "fork", 1, at=10 * s, kernel=1), notice(2, "fork", 1, at=20 * s, kernel=2),
        # merge within two seconds: the old row stays, its parent changes
        notice(1, "fork", 1, at=10 * s, kernel=1, ppid=4, host=1), notice(2, "fork", 1, at=11 * s, kernel=2, ppid=5, host=1),
        # three forks 1.5 s apart: the third is compared with the first
        notice(1, "fork", 1, at=10 * s, kernel=1, host=2), notice(2, "fork", 1, at=11 * s + s // 2, kernel=2, host=2),
        notice(3, "fork", 1, at=13 * s, kernel=3, host=2), notice(4, "exit", 1, at=14 * s, kernel=4, code=0, host=2),
        # readable details confirm a provisional start and bring the stable ID
        notice(1, "fork", 1, at=10 * s, kernel=1, host=3), notice(2, "fork", 1, at=11 * s, details=detail(11 * s), host=3),
        # exec keeps the start across unchecked generations
        notice(1, "fork", 1, at=10 * s, kernel=1, host=4), notice(2, "exec", 1, at=90 * s, details=detail(80 * s), host=4),
    ], fold_all=fold_all)
    got = {}
    for r in R.lifecycle_events(states).orderBy("host_id", "order_key").collect():
        got.setdefault(r["host_id"], []).append((r["kind"], r["process_id"], r["ppid"], r["duration_ms"]))
    c = "connector:1:"
    assert got[0] == [("start", c + "1", 0, None), ("stop", c + "1", 0, 10000), ("start", c + "2", 0, None)]
    assert got[1] == [("start", c + "1", 4, None), ("start", c + "1", 5, None)]
    assert got[2] == [("start", c + "1", 0, None), ("start", c + "1", 0, None), ("stop", c + "1", 0, 3000),
                      ("start", c + "3", 0, None), ("stop", c + "3", 0, 1000)]
    assert got[3] == [("start", c + "1", 0, None), ("start", f"1:{11 * s}", 2, None)]
    assert got[4][1][1] == f"1:{80 * s}"
    live = {r["host_id"]: r["started_ns"] for r in R.live_state(states).collect()}
    assert live[3] == 10 * s and live[4] == 10 * s


def loop(rows, align_all=False):
    """Fold over every row of a (host, PID), one after another."""
    out, state = [], {}
    provisional = lambda i: i.split(":")[0] in ("connector", "etw", "es", "trace") and ":" in i

    def same(a, b):
        if a["process_id"] == b["process_id"]:
            return True
        known = a["started_ns"] is not None and b["started_ns"] is not None
        return (provisional(a["process_id"]) or provisional(b["process_id"])) and known and \
            abs(a["started_ns"] - b["started_ns"]) <= 2 * SECOND

    def stop(r, p, code=None):
        began = p["started_ns"] if p["started_ns"] is not None else p["captured_ns"]
        out.append((r["host_id"], r["pos"], "stop", p["process_id"], p["ppid"], p["command"], r["event_ns"],
                    max(0, r["event_ns"] - began) // 10**6, code))

    def show(r, kind, p, at=None):
        out.append((r["host_id"], r["pos"], kind, p["process_id"], p["ppid"], p["command"], at or r["event_ns"], None, None))

    for r in sorted(rows, key=lambda r: r["pos"]):
        key, kind = (r["host_id"], r["pid"]), r["kind"]
        old, new = state.get(key), r["cand"] and dict(r["cand"])
        if kind in ("stop", "absent"):
            if kind == "stop" or old:
                stop(r, old or new, r["exit_code"])
            state[key] = None
            continue
        keep = lambda: {**new, **{k: old[k] if old[k] is not None else new[k]
                                  for k in ("captured_ns", "started_ns")}}
        if kind == "start":
            if old and same(old, new):
                new = keep() if r["solid"] else {**old, "ppid": new["ppid"]}
            elif old:
                stop(r, old)
            show(r, "start", new)
        elif kind == "exec":
            if old:
                new = keep() if r["solid"] else old
            show(r, "exec", new)
        elif kind == "scan":
            alike = old and (old["process_id"] == new["process_id"] or (
                old["process_id"].startswith("connector:") and r["family"] == "linux" and same(old, new)))
            if alike:
                new = keep()
                if (old["command"], old["exe"]) != (new["command"], new["exe"]):
                    show(r, "exec", new)
            else:
                if old:
                    stop(r, old)
                show(r, "start", new, new["started_ns"])
        state[key] = new
    return sorted(map(str, out))


def stream(seed, hosts=5, length=260):
    """Crowded notices (many within two seconds) and reconciliation scans at every 20th position."""
    rng = random.Random(seed)
    rows, scans, times = [], [], []
    for host in range(hosts):
        family = ("linux", "linux", "windows", "macos", "linux")[host % 5]
        at = 0
        for pos in range(1, length):
            at += rng.randrange(0, SECOND)
            if pos % 20 == 0:
                times.append((host, pos, at))
                for pid in range(1, 5):
                    if rng.random() < 0.6:
                        began = rng.choice([None, at - rng.randrange(0, 6 * SECOND)])
                        scans.append((host, pos, at, family, rng.choice([f"{pid}:{began}", str(pid)]), pid,
                                      rng.randrange(0, 5), rng.choice("xy"), "/s", began, at))
                continue
            kind = rng.choice(["fork", "fork", "exec", "exit"])
            pid = rng.randrange(1, 5)
            began = rng.choice([None, at - rng.randrange(0, 4 * SECOND)])
            details = proc(process_id=rng.choice([f"{pid}:{began}", f"{pid}:7"]), pid=pid, ppid=rng.randrange(0, 5),
                           command=rng.choice("ab"), exe="/x", started_ns=began, captured_ns=at)
            if family == "linux" and rng.random() < 0.6:
                details = None
            rows.append(notice(pos, kind, pid, family, at=at, ppid=rng.choice([None, 0, 3]), kernel=pos,
                               code=pos % 7 if kind == "exit" else None, details=details, version=pos % 3, host=host))
    return rows, scans, times


SCANS = ("host_id long, pos long, observed_ns long, family string, process_id string, pid long, ppid long, "
         "command string, exe string, started_ns long, captured_ns long")


@pytest.mark.parametrize("options", [{}, {"fold_all": True}, {"hot_rows": 30, "width": 16}])
def test_replay_and_reconciliation_equal_loop(spark, options):
    rows, scans, times = stream(4)
    notices = spark.createDataFrame(rows, LANDED)
    scan = spark.createDataFrame(scans, SCANS)
    clock = spark.createDataFrame(times, "host_id long, pos long, observed_ns long")
    plain = R.candidates(notices).unionByName(R.table_rows(scan, R.SCAN))
    every = [r.asDict(recursive=True) for r in plain.collect()]
    held = {(r["host_id"], r["pid"], r["pos"]) for r in every if r["kind"] == "scan"}
    for host, pos, at in times:  # all absences, also of PIDs nothing is known of
        every += [dict(host_id=host, pid=pid, pos=pos, kind="absent", family=None, event_ns=at, cand=None, exit_code=None,
                       solid=False) for pid in range(1, 5) if (host, pid, pos) not in held]
    states = R.replay(notices, scans=scan, scan_times=clock, **options)
    got = R.lifecycle_events(states).selectExpr(
        "host_id", "order_key.pos", "kind", "process_id", "ppid", "command", "event_ns", "duration_ms", "exit_code")
    assert sorted(str(tuple(r)) for r in got.collect()) == loop(every)


def test_versions_parents_and_chains(spark):
    rows = [
        notice(1, "fork", 10, at=1, kernel=1, ppid=0), notice(2, "fork", 11, at=2, kernel=2, ppid=10),
        notice(3, "fork", 12, at=3, kernel=3, ppid=11), notice(4, "exit", 10, at=4, kernel=4, code=0),
        notice(5, "exec", 12, at=5, kernel=5), notice(6, "fork", 10, at=6, kernel=6, ppid=12),
        notice(7, "exit", 12, at=7, kernel=7, code=0)]
    states = materialise(run(spark, rows), "states")     # read many times below
    events = R.lifecycle_events(states).withColumn("pos", F.col("order_key.pos"))
    for options in ({}, {"hot_rows": 1, "width": 2}):
        parents = {r["pos"]: r["parent"] and r["parent"]["process_id"]
                   for r in R.temporal_parents(events, states, **options).collect()}
        c = "connector:"
        assert parents == {1: None, 2: c + "10:1", 3: c + "11:2", 4: None, 5: c + "11:2", 6: c + "12:3", 7: c + "11:2"}
        chains = {r["pos"]: [p["pid"] for p in r["parent_chain"]] for r in R.temporal_ancestors(
            events.drop("parent_chain"), states, **options).collect()}
        # at 7 the parent of 11 is PID 10 again, whose parent 12 is the process itself
        assert chains == {1: [], 2: [10], 3: [11, 10], 4: [], 5: [11], 6: [12, 11], 7: [11, 10]}
        versions = sorted((r["pid"], r["valid_from_pos"], r["valid_to_pos"])
                          for r in R.process_versions(states, **options).collect())
        assert versions == [(10, 1, 4), (10, 6, None), (11, 2, None), (12, 3, 5), (12, 5, 7)]
    lives = sorted((r["pid"], r["generation_pos"], r["stop_pos"]) for r in R.process_lifetimes(states).collect())
    assert lives == [(10, 1, 4), (12, 3, 7)]


def test_details_as_of(spark):
    notices = spark.createDataFrame([notice(5, "exec", 1), notice(15, "exec", 1), notice(15, "exec", 2)], LANDED)
    table = spark.createDataFrame([(0, 1, 3, "a"), (0, 1, 10, "b")], "host_id long, pid long, pos long, command string")
    got = {(r["pid"], r["pos"]): r["proc"] and r["proc"]["command"] for r in R.details_as_of(notices, table).collect()}
    assert got == {(1, 5): "a", (1, 15): "b", (2, 15): None}


def test_alignment_and_due_scans(spark):
    schema = "host_id long, pid long, process_id string, started_ns long"
    old = spark.createDataFrame([(0, 1, "connector:1:5", 10 * SECOND), (0, 2, "connector:2:5", 10 * SECOND),
                                 (0, 3, "es:3:1", 10 * SECOND), (0, 4, "4:4", 10 * SECOND)], schema)
    new = spark.createDataFrame([(0, 1, "1:9", 12 * SECOND), (0, 2, "2:9", 12 * SECOND + 1), (0, 3, "3:9", 10 * SECOND),
                                 (0, 4, "4:4", 0)], schema)
    got = {r["pid"]: (r["process_id"], r["aligned"]) for r in align_ids(old, new).collect()}
    assert got == {1: ("1:9", True), 2: ("connector:2:5", False), 3: ("es:3:1", False), 4: ("4:4", False)}
    manifest = spark.createDataFrame([(0, i, i * 10, True, i * SECOND // 2) for i in range(8)],
                                     "host_id long, scan_id long, pos long, success boolean, observed_ns long")
    forced = spark.createDataFrame([(0, 22), (0, 25)], "host_id long, pos long")
    assert sorted(r["scan_id"] for r in due_scans(manifest, SECOND // 5).collect()) == [0, 4]
    # 3 is forced and re-arms the timer: the next one is due at 7.
    assert sorted(r["scan_id"] for r in due_scans(manifest, SECOND // 5, forced).collect()) == [0, 3, 7]


def test_due_scans_equal_a_timer(spark):
    rng = random.Random(12)
    rows, marks, expected = [], [], set()
    for host in range(5):
        at, armed, places = 0, None, sorted(rng.sample(range(1000), 120))
        forcing = sorted(rng.sample(range(1000), 0 if host == 0 else 8))
        for i, pos in enumerate(places):
            at += rng.choice([-SECOND // 3, 0, SECOND // 9, SECOND // 2, 3 * SECOND])
            rows.append((host, i, pos, True, at))
            now = max(r[4] for r in rows if r[0] == host)
            before = places[i - 1] if i else -1
            if armed is None or now >= armed or any(before <= f < pos for f in forcing):
                expected.add((host, pos))
                armed = now + 2 * SECOND
        marks += [(host, f) for f in forcing]
    manifest = spark.createDataFrame(rows, "host_id long, scan_id long, pos long, success boolean, observed_ns long")
    forced = spark.createDataFrame(marks, "host_id long, pos long")
    got = due_scans(manifest, SECOND // 5, forced, width=16)
    assert got.columns == manifest.columns and {(r["host_id"], r["pos"]) for r in got.collect()} == expected
