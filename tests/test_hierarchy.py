"""Parents, chains and closures."""

import random

from lifeline.operators import hierarchy as H

TABLE = "host_id long, pid long, ppid long, process_id string, command string, exe string, user string"


def table(spark, parents, host=0):
    return spark.createDataFrame([(host, p, q, f"{p}:1", f"c{p}", f"/b/{p}", "u") for p, q in parents], TABLE)


def chains(spark, parents):
    rows = table(spark, parents)
    got = H.with_ancestors(rows.select("host_id", "pid", "ppid"), rows, ["host_id"])
    return {r["pid"]: [p["pid"] for p in r["parent_chain"]] for r in got.collect()}


def walk(parents, pid):
    above, seen, up = dict(parents), {pid}, dict(parents)[pid]
    chain = []
    while up > 0 and up not in seen and up in above:
        chain.append(up)
        seen.add(up)
        up = above[up]
    return chain


def test_chains(spark):
    cycle = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 99), (7, -1), (8, 6)]
    got = chains(spark, cycle)
    assert got == {1: [2, 3], 2: [3, 1], 3: [1, 2], 4: [1, 2, 3], 5: [], 6: [], 7: [], 8: [6]}
    deep = [(i, i - 1) for i in range(1, 24)]
    assert chains(spark, deep)[23] == list(range(22, 0, -1))
    rng = random.Random(1)
    wild = [(p, rng.randrange(0, 40)) for p in range(1, 40)]
    assert chains(spark, wild) == {p: walk(wild, p) for p, _ in wild}


def test_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(H, "materialise", lambda df, name="step", keep=H.materialise: rounds.append(name) or keep(df, name))
    rows = table(spark, [(i, i - 1) for i in range(1, 1001)])
    got = H.with_ancestors(rows.select("host_id", "pid", "ppid").where("pid > 998"), rows, ["host_id"])
    assert {r["pid"]: len(r["parent_chain"]) for r in got.collect()} == {999: 998, 1000: 999} and len(rounds) <= 12
    rounds.clear()
    root = spark.createDataFrame([(1, 0, 1)], "trace_id long, host_id long, pid long")
    levels = {r["pid"]: r["level"] for r in H.descendants(root, rows, ["host_id"]).collect()}
    assert levels == {i: i - 1 for i in range(1, 1001)} and rounds.count("above") <= 11


def test_parent_lookup(spark):
    rows = table(spark, [(1, 0), (2, 1), (3, 9)])
    got = {r["pid"]: r["parent"] and r["parent"]["process_id"] for r in H.with_parent(rows, rows, ["host_id"]).collect()}
    assert got == {1: None, 2: "1:1", 3: None}


def test_closures(spark):
    rows = table(spark, [(10, 1), (11, 10), (12, 11), (20, 1), (30, 31), (31, 30)])
    roots = spark.createDataFrame([(1, 0, 10), (2, 0, 12), (3, 0, 30), (4, 0, 77), (5, 0, 10), (5, 0, 11)],
                                  "trace_id long, host_id long, pid long")
    got = {}
    for r in H.descendants(roots, rows, ["host_id"]).collect():
        got.setdefault(r["trace_id"], []).append(r["pid"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [10, 11, 12], 2: [12], 3: [30, 31], 5: [10, 11, 12]}
    # re-parented: 12 is still found from its own tracked PID
    late = table(spark, [(12, 1)])
    tracked = spark.createDataFrame([(1, 0, 12)], "trace_id long, host_id long, pid long")
    assert [r["pid"] for r in H.descendants(tracked, late, ["host_id"]).collect()] == [12]


def test_survivors(spark):
    rows = spark.createDataFrame([(1, 3), (1, 1), (1, 20)], "trace_id long, pid long")
    assert H.surviving_pids(rows, ["trace_id"]).first()["pids_text"] == "[1 3 20]"
