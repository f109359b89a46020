"""Traces against closure over a graph of (PID, scan), in batch and as a stream."""

import random

from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.operators import diff as D
from lifeline.operators.trace import trace
from lifeline.plans.catalog import streamed
from lifeline.streaming import trace as live

SECOND = 10**9
COLUMNS = ["kind", "pid", "process_id", "command", "event_ns", "duration_ms", "exit_code", "message"]


def reach(scans, req):
    """Member nodes (PID, scan number), the scan of the exit and the last scan, by closure over a graph.

    Sources are the root's places before the exit. Edges lead from a PID to itself in the
    next scan (the root's only after the exit), and from a parent to its children in a scan.
    """
    tables = [table for _, _, table in scans]
    root, cut = req["root_pid"], len(scans)
    if req["exited_pos"] is not None:
        cut = next((i for i, (pos, _, _) in enumerate(scans) if pos > req["exited_pos"]), cut)
    begun = next((i for i, (pos, _, _) in enumerate(scans) if pos > req["started_pos"]), len(scans))
    nodes = {(root, i) for i in range(begun, cut) if root in tables[i]}
    while True:
        later = {(p, i + 1) for p, i in nodes if i + 1 < len(scans) and p in tables[i + 1] and not (p == root and i < cut)}
        below = {(c, i) for p, i in nodes for c, r in tables[i].items() if r["ppid"] == p > 0 and c != p}
        if (later | below) <= nodes:
            break
        nodes |= later | below
    for i in range(max(cut, begun), len(scans)):
        since = scans[i][1] - req["exited_ns"]
        if since >= max(req["tail_ns"], 1) or (since >= 2 * req["poll_ns"] and not any(n == i for _, n in nodes)):
            return {(p, n) for p, n in nodes if n <= i}, cut, i
    return nodes, cut, None


def spell(seen, ended, code):
    """Events of one PID from what was seen of it, [(moment, process)], to its end (a moment or None)."""
    out, life = [], []

    def close(at, code=None):
        first = next((p["started_ns"] for _, p in life if p["started_ns"] is not None), life[0][1]["captured_ns"])
        last = life[-1][1]
        out.append(("stop", last["pid"], last["process_id"], last["command"], at, max(0, at - first) // 10**6, code, None))

    for at, p in seen:
        known = next((x["started_ns"] for _, x in life if x["started_ns"] is not None), None)
        near = known is not None and p["started_ns"] is not None and abs(known - p["started_ns"]) <= 2 * SECOND
        goes_on = life and (p["process_id"] == life[-1][1]["process_id"] or (life[-1][1]["process_id"].startswith("trace:") and near))
        if life and not goes_on:
            close(at)
            life.clear()
        what = (p["pid"], p["process_id"], p["command"])
        if not life:
            out.append(("start", *what, at if p["started_ns"] is None else p["started_ns"], None, None, None))
        elif (life[-1][1]["command"], life[-1][1]["exe"]) != (p["command"], p["exe"]):
            out.append(("exec", *what, at, None, None, None))
        life.append((at, p))
    if ended is not None:
        close(ended, code)
    return out


def expected_events(scans, req):
    """Events of one trace over [(pos, observed_ns, {pid: process})], PID by PID."""
    nodes, cut, finish = reach(scans, req)
    last = len(scans) - 1 if finish is None else finish
    root, begun = req["root_pid"], req["started_ns"]
    asked = dict(process_id=f"trace:{root}:{begun}", pid=root, command=" ".join(req["argv"]), exe=req["argv"][0],
                 started_ns=begun, captured_ns=begun)
    at = lambda p, i: (scans[i][1], scans[i][2][p])
    out = spell([(begun, asked)] + [at(root, i) for i in range(cut) if (root, i) in nodes], req["exited_ns"], req["exit_code"])
    for pid in {p for p, _ in nodes}:
        places = [i for i in range(last + 1) if (pid, i) in nodes and not (pid == root and i < cut)]
        first = [i for i in places if i - 1 not in places]
        for begin, following in zip(first, [*first[1:], last + 2]):
            span = [i for i in places if begin <= i < following]
            out += spell([at(pid, i) for i in span], scans[span[-1] + 1][1] if span[-1] < last else None, None)
    if finish is not None and (left := sorted(p for p, i in nodes if i == finish)):
        text = " ".join(map(str, left))
        out.append(("gap", None, None, None, scans[finish][1], None, None,
                    f"trace tail ended with observed descendant process ids [{text}] still running"))
    return out


def history(rng, host, length):
    scans, table = [], {}
    for step in range(length):
        for pid in range(1, 9):
            roll = rng.random()
            if pid in table and roll < 0.12:
                del table[pid]
            elif pid not in table and roll < 0.45:
                table[pid] = dict(pid=pid, ppid=rng.randrange(0, 9), process_id=f"{pid}:{step}",
                                  command=rng.choice("ab"), exe="/x",
                                  started_ns=rng.choice([None, (step * 10 + 100) * SECOND]),
                                  captured_ns=(step * 10 + 101) * SECOND)
            elif pid in table and roll < 0.6:
                table[pid] = {**table[pid], **rng.choice([
                    dict(command=rng.choice("abc")), dict(ppid=rng.randrange(0, 9)),
                    dict(process_id=f"{pid}:{step}", captured_ns=(step * 10 + 101) * SECOND)])}
        scans.append((step * 10, (step * 10 + 102) * SECOND, {p: dict(r) for p, r in table.items()}))
    return scans


def walk(table, pid):
    chain, seen, up = [], {pid}, table[pid]["ppid"] if pid in table else 0
    while up > 0 and up not in seen and up in table:
        chain.append(up)
        seen.add(up)
        up = table[up]["ppid"]
    return chain


SCAN = ("host_id long, scan_id long, process_id string, pid long, ppid long, command string, "
        "exe string, started_ns long, captured_ns long, row_pos long")
MANIFEST = "host_id long, scan_id long, pos long, success boolean, error string, observed_ns long"


def request(**given):
    return tuple(given.get(f) for f in S.TRACE_REQUEST.fieldNames())


def test_trace_equals_closure(spark):
    rng = random.Random(5)
    rows, manifest, requests, expected = [], [], [], {}
    for host in range(12):
        scans = history(rng, host, 14)
        for pos, seen, table in scans:
            manifest.append((host, pos // 10, pos, True, None, seen))
            rows += [(host, pos // 10, r["process_id"], r["pid"], r["ppid"], r["command"], r["exe"],
                      r["started_ns"], r["captured_ns"], 0) for r in table.values()]
        for k in range(4):
            begin = rng.randrange(0, 6)
            end = begin + rng.randrange(0, 7)
            ends = rng.random() < 0.85
            req = dict(trace_id=host * 10 + k, host_id=host, root_pid=rng.randrange(1, 9), parent_pid=0,
                       argv=["a", "b"][: rng.randrange(1, 3)], started_ns=(begin * 10 + 99) * SECOND,
                       started_pos=begin * 10 - 5, exited_ns=(end * 10 + 99) * SECOND if ends else None,
                       exit_code=3 if ends else None, exited_pos=end * 10 - 2 if ends else None,
                       poll_ns=rng.choice([2, 6, 15]) * SECOND, tail_ns=rng.choice([0, 15, 40, 500]) * SECOND,
                       cancelled_ns=None, cancelled_pos=None)
            requests.append(tuple(req[f] for f in S.TRACE_REQUEST.fieldNames()))
            expected[req["trace_id"]] = expected_events(scans, req)
    scans = spark.createDataFrame(rows, SCAN)
    table = spark.createDataFrame(manifest, MANIFEST)
    numbered = D.scan_ordinals(table)
    got = trace(D.attach_manifest(scans, numbered), numbered,
                spark.createDataFrame(requests, S.TRACE_REQUEST))
    landed = live.request_rows(spark.createDataFrame(requests, S.TRACE_REQUEST)).unionByName(live.scan_rows(scans, table))
    key = lambda e: tuple(str(v) for v in e)
    for found in (got, streamed(spark, landed, "pos", live.INPUT, live.trace_events, 5)):
        actual = {}
        for row in found.select("trace_id", *COLUMNS).collect():
            actual.setdefault(row[0], []).append(tuple(row[1:]))
        for trace_id, events in expected.items():
            assert sorted(actual.get(trace_id, []), key=key) == sorted(events, key=key), trace_id
    assert sum(len(e) for e in expected.values()) > 300


def test_chains_gaps_and_cancellation(spark):
    s = SECOND
    row = lambda scan, pid, ppid: (0, scan, f"{pid}:1", pid, ppid, f"c{pid}", f"/b/{pid}", None, scan * s, 0)
    tables = {0: [(1, 0), (2, 1)], 1: [(1, 0), (2, 1), (5, 2), (6, 5)], 3: [(1, 0), (2, 1), (5, 2), (6, 5), (7, 6)],
              4: [(1, 0), (2, 1), (5, 2), (6, 5)], 5: [(1, 0), (5, 1), (6, 5)]}
    scans = spark.createDataFrame([row(k, p, q) for k, t in tables.items() for p, q in t], SCAN)
    manifest = spark.createDataFrame(
        [(0, k, k * 10, k in tables, None if k in tables else "E", (k + 1) * s) for k in range(6)], MANIFEST)
    numbered = D.scan_ordinals(manifest)
    base = dict(host_id=0, root_pid=5, parent_pid=2, argv=["c5"], started_ns=0, started_pos=5, poll_ns=1, tail_ns=0)
    requests = spark.createDataFrame([
        request(trace_id=1, exited_ns=5 * s + 1, exited_pos=45, exit_code=9, **base),
        request(trace_id=2, cancelled_ns=4 * s + 5, cancelled_pos=35, **base)], S.TRACE_REQUEST)
    events = trace(D.attach_manifest(scans, numbered), numbered, requests, manifest, chains=True)
    got = {1: [], 2: []}
    for r in events.orderBy("order_key").collect():
        chain = [p["pid"] for p in r["parent_chain"] or []]
        got[r["trace_id"]].append((r["kind"], r["pid"], r["order_key"]["pos"], chain, r["message"]))
    failed = "trace snapshot failed; expected a complete process table, received error E"
    opening = [("start", 5, 5, [2], None), ("stop", 5, 10, [], None), ("start", 5, 10, [2, 1], None),
               ("start", 6, 10, [5, 2, 1], None), ("gap", None, 20, [], failed), ("start", 7, 30, [6, 5, 2, 1], None)]
    assert got[1] == opening + [
        ("stop", 7, 40, [6, 5], None), ("stop", 5, 45, [2], None),
        ("gap", None, 50, [], "trace tail ended with observed descendant process ids [6] still running")]
    landed = live.request_rows(requests).unionByName(live.scan_rows(scans, manifest))
    brief = lambda df: sorted((r["trace_id"], r["order_key"]["pos"], r["kind"], str(r["pid"]), str(r["message"]))
                              for r in df.collect())
    assert brief(streamed(spark, landed, "pos", live.INPUT, live.trace_events, 4)) == brief(events)
    assert got[2] == opening + [
        ("gap", None, 35, [], "trace stopped before the command and all observed descendants completed")]


def test_stream_packs_tables(spark):
    """A scan's rows reach the traces as one value per task that read them, with all that they tell."""
    scans = spark.range(0, 600, 1, 2).selectExpr(
        "id % 2 AS host_id", "id % 3 AS scan_id", "CAST(id AS string) AS process_id", "id AS pid", "1L AS ppid", "'c' AS command",
        "CASE WHEN id % 2 = 0 THEN 1700000000123456789 + id END AS started_ns", "id AS captured_ns").cache()
    manifest = spark.range(6).selectExpr(
        "id % 2 AS host_id", "id div 2 AS scan_id", "id div 2 AS pos", "true AS success", "CAST(NULL AS string) AS error", "id AS observed_ns")
    rows = live.scan_rows(scans, manifest).where(f"what = '{live.PROCESS}'").coalesce(1)
    tables = live.packed_tables(rows).collect()
    assert len(tables) == 6
    found = {(t.host_id, t.scan_id, *p) for t in tables for p in live.unpacked_table(t.table)}
    assert found == {(r.host_id, r.scan_id, *r.proc) for r in rows.collect()} and len(found) == 600


def test_replay_reads_stored_rows(spark, monkeypatch):
    """What the replay reads several times is stored: events with chains no longer read the runs they come from."""
    from lifeline.operators import trace as tracing

    read, store = {}, tracing.materialise
    monkeypatch.setattr(tracing, "materialise", lambda df, name: read.update({name: df.inputFiles()}) or store(df, name))
    scans = spark.range(40).selectExpr(
        "0L AS host_id", "id div 10 AS scan_id", "CAST(id % 10 AS string) AS process_id", "id % 10 AS pid", "0L AS ppid", "'c' AS command",
        "'/c' AS exe", "CAST(NULL AS string) AS uid", "id AS started_ns", "id AS captured_ns")
    manifest = spark.range(4).selectExpr("0L AS host_id", "id AS scan_id", "id * 10 AS pos", "true AS success", "id AS observed_ns")
    numbered = D.scan_ordinals(manifest)
    asked = spark.createDataFrame([request(trace_id=1, host_id=0, root_pid=5, parent_pid=0, argv=["c"], started_ns=0, started_pos=-5,
                                           poll_ns=1, tail_ns=0)], S.TRACE_REQUEST)
    trace(D.attach_manifest(scans, numbered), numbered, asked, chains=True)
    files = read["trace-events"]
    assert any("/trace-rows-" in f for f in files) and not any("/trace-runs-" in f for f in files)
