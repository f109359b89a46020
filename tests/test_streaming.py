"""Streams equal their batch twins for several splits of what lands, over restarts."""

import pytest
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.operators import diff as D, gaps as G, replay as R
from lifeline.plans.bindings import landed
from lifeline.plans.catalog import streamed
from lifeline.streaming import audit, engine, replay as live, scans as scanning
from tests_support import LANDED, SCANS, history, stream

COLUMNS = ["host_id", "kind", "pid", "process_id", "event_ns", "duration_ms", "exit_code", "message"]


def rows(df):
    return sorted(str(tuple(r)) for r in df.selectExpr("order_key.pos", *COLUMNS).collect())


@pytest.fixture(scope="module")
def fed(spark):
    """Notices of three families with crowded starts, and reconciliation scans among them."""
    notices, scans, times = stream(9, hosts=3, length=120)
    return (S.conform(spark.createDataFrame(notices, LANDED), S.NOTICE), spark.createDataFrame(scans, SCANS),
            spark.createDataFrame(times, "host_id long, pos long, observed_ns long"))


@pytest.mark.parametrize("files", [2, 5])
def test_replay(spark, fed, files):
    notices, scans, times = fed
    both = live.notice_rows(notices).unionByName(live.scan_rows(scans, times))
    events = streamed(spark, both, "pos", live.INPUT, live.replay_events, files)
    assert rows(events) == rows(R.lifecycle_events(R.replay(notices, scans=scans, scan_times=times)))


def test_restart_continues(spark, fed, tmp_path):
    """A query that ended continues from its checkpoint when more files have landed."""
    notices = live.notice_rows(fed[0])
    middle = notices.selectExpr("percentile_approx(pos, 0.5) AS p").first().p
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (f"pos <= {middle}", f"pos > {middle}"):
        notices.where(part).coalesce(1).write.mode("append").parquet(source)
        events = live.replay_events(engine.landed(spark, source, live.INPUT))
        engine.start(events, folder).awaitTermination()
    assert rows(engine.output(spark, folder, events.schema)) == rows(R.lifecycle_events(R.replay(fed[0])))
    assert spark.conf.get(engine.PROVIDER, None) != engine.ROCKSDB


def test_scans_with_late_ends(spark):
    """Process rows may arrive in an earlier batch than the row that ends their scan."""
    found, manifest, _ = history(21, hosts=3, length=9)
    scans = spark.createDataFrame([r[:-1] for r in found], "host_id long, scan_id long, process_id string, pid long, "
                                  "ppid long, command string, exe string, started_ns long, captured_ns long")
    ends = spark.createDataFrame(manifest, "host_id long, scan_id long, pos long, success boolean, error string, observed_ns long")
    schema = S.T.StructType([*scanning.INPUT.fields, S.T.StructField("arrival", S.T.LongType())])
    mixed = S.conform(
        scans.withColumn("arrival", F.col("scan_id") * 2).unionByName(
            ends.withColumn("arrival", F.col("scan_id") * 2 + 1), allowMissingColumns=True), schema).cache()
    events = streamed(spark, mixed, "arrival", schema, scanning.scan_events, 6)
    batch = D.snapshot_diff(D.attach_manifest(scans, D.scan_ordinals(ends))).drop("lookup_ordinal").unionByName(
        D.failed_scan_gaps(ends))
    assert rows(events) == rows(batch)


def test_many_rows_wait_for_an_end(spark):
    """A table of more rows than one state value holds; large integers beside nulls keep their digits."""
    base = 1_700_000_000_123_456_789
    shown = lambda scan, skip: spark.range(3 * engine.PACK).where(f"id % 7 <> {skip}").selectExpr(
        "1L AS host_id", f"{scan}L AS scan_id", "CAST(id AS string) AS process_id", "id AS pid", "1L AS ppid", "'c' AS command",
        "'/c' AS exe", f"CASE WHEN id % 2 = 0 THEN {base}L + id END AS started_ns", f"{base}L + id AS captured_ns")
    scans = shown(0, 3).unionByName(shown(1, 5))
    ends = spark.range(2).selectExpr("1L AS host_id", "id AS scan_id", "id AS pos", "true AS success",
                                     f"{base}L + 9000000000 * (id + 1) AS observed_ns")
    mixed = scans.withColumn("arrival", F.col("scan_id") * 2).unionByName(
        ends.withColumn("arrival", F.col("scan_id") * 2 + 1), allowMissingColumns=True)
    schema = S.T.StructType([*scanning.INPUT.fields, S.T.StructField("arrival", S.T.LongType())])
    make = lambda df: scanning.scan_events(df, buckets=1)
    events = streamed(spark, mixed, "arrival", schema, make, 4)
    assert rows(events) == rows(D.snapshot_diff(D.attach_manifest(scans, D.scan_ordinals(ends.withColumn("error", F.lit(None).cast("string"))))).drop("lookup_ordinal"))


def test_audits_and_known_cursors(spark):
    """All three audits in one stream; cursors known before it count."""
    seq = spark.createDataFrame([(0, p, p % 2, s, p * 10) for p, s in enumerate([5, 4294967295, 6, 0, 9, 2])],
                                "host_id long, pos long, cpu long, seq long, observed_ns long")
    end = spark.createDataFrame(
        [(0, p, k, s, k == "g", p * 10, p) for p, (k, s) in enumerate([("g", 3), ("a", 1), ("g", 0), ("g", 5), ("a", 2), ("b", 7), ("a", 9)])],
        "host_id long, pos long, kind string, seq long, global_sequence boolean, observed_ns long, event_ns long")
    lost = spark.createDataFrame([(0, p, n, p, "windows-etw") for p, n in enumerate([0, 2, 2, 5, 1, 7])],
                                 "host_id long, pos long, lost_total long, observed_ns long, backend string")
    both = audit.sequence_rows(seq).unionByName(audit.endpoint_rows(end)).unionByName(audit.lost_rows(lost))
    batch = G.sequence_gaps(seq).unionByName(G.endpoint_gaps(end)).unionByName(G.lost_gaps(lost))
    assert rows(streamed(spark, both, "pos", audit.INPUT, audit.audit_events, 3)) == rows(batch)
    known = audit.sequence_rows(spark.createDataFrame([(0, -1, 0, 2, 0)], seq.schema))
    found = streamed(spark, both, "pos", audit.INPUT, lambda df: audit.audit_events(df, known), 2)
    assert [r for r in rows(found) if r not in rows(batch)] == [
        "(0, 0, 'gap', None, None, 0, None, None, 'process connector sequence gap on cpu 0; expected sequence 3, received 5')"]
    assert len(rows(found)) == len(rows(batch)) + 1


def test_landed_files_are_in_order(spark):
    folder = landed(spark.range(10).selectExpr("id AS pos"), "pos", S.struct_of(("pos", S.T.LongType())), 3)
    assert sorted(r.pos for r in spark.read.parquet(folder).collect()) == list(range(10))


def test_fallback(spark):
    """One host of each kind; what lands around the failure is told apart by position."""
    from lifeline.sources import fallback as F10
    from lifeline.streaming import fallback as switching

    notices, _, _ = stream(3, hosts=5, length=60)
    frame = S.conform(spark.createDataFrame(notices, LANDED), S.NOTICE)
    health = spark.createDataFrame(
        [(0, "auto", True, 31), (1, "auto", False, None), (2, "poll", True, None), (3, "named", True, 20), (4, "auto", True, None)],
        "host_id long, requested string, available boolean, failed_pos long").selectExpr(
        "*", "'native' AS backend", "'E' AS error", "host_id AS observed_ns")
    scans = spark.range(5).selectExpr("id AS host_id", "explode(sequence(0, 5)) AS scan_id").selectExpr(
        "host_id", "CAST(scan_id AS bigint) AS scan_id", "explode(sequence(1, 6)) AS pid").where("(pid + scan_id + host_id) % 4 <> 0").selectExpr(
        "host_id", "scan_id", "concat(pid, ':1') AS process_id", "CAST(pid AS bigint) AS pid", "1L AS ppid",
        "concat('c', scan_id div 3) AS command", "'/c' AS exe", "CASE WHEN pid % 2 = 0 THEN scan_id * 1000000 END AS started_ns",
        "scan_id * 1000000 + 1 AS captured_ns")
    manifest = spark.range(5).selectExpr("id AS host_id", "explode(sequence(0, 5)) AS k").selectExpr(
        "host_id", "CAST(k AS bigint) AS scan_id", "k * 10L + 1 AS pos", "true AS success", "CAST(NULL AS string) AS error", "k * 1000000L + 500 AS observed_ns")
    rows_in = switching.health_rows(health).unionByName(switching.notice_rows(frame)).unionByName(switching.scan_rows(scans, manifest))
    got = streamed(spark, rows_in, "pos", switching.INPUT, switching.fallback_events, 3)
    numbered = D.scan_ordinals(F10.polled_attempts(manifest, health))
    polled = D.snapshot_diff(D.attach_manifest(scans, numbered)).drop("lookup_ordinal")
    assert rows(got) == rows(F10.choose(R.lifecycle_events(R.replay(frame)), polled, health))


def test_recent_view(spark):
    from lifeline.operators import views
    from lifeline.streaming import recent

    notices, _, _ = stream(5, hosts=4, length=80)
    events = R.lifecycle_events(R.replay(S.conform(spark.createDataFrame(notices, LANDED), S.NOTICE))).cache()
    make = lambda df: recent.entering(df, 20, 2)
    passed = streamed(spark, events.withColumn("_pos", F.col("order_key.pos")), "_pos", S.LIFECYCLE_EVENT, make, 4)
    assert rows(recent.view(passed, 20)) == rows(views.recent(events, 20)) and passed.count() < events.count()


def test_repeated_batch_leaves_one_copy(spark, tmp_path):
    from lifeline.streaming import batches

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).coalesce(1).write.mode("append").parquet(source)
    stream_of = lambda: spark.readStream.schema("id long").parquet(source).selectExpr("id", "id * 2 AS twice")
    batches.start(stream_of(), out, str(tmp_path / "a")).awaitTermination()
    # Another checkpoint begins with batch 0 again: its rows replace those of the first try.
    batches.start(stream_of(), out, str(tmp_path / "b")).awaitTermination()
    got = batches.written(spark, out, S.struct_of(("id", S.T.LongType()), ("twice", S.T.LongType())))
    assert sorted(r.twice for r in got.collect()) == list(range(0, 20, 2))
    writer = batches.BatchWriter(out, got.schema)
    import pyarrow as pa

    left = writer.write(iter([pa.RecordBatch.from_pydict({"id": [1], "twice": [2]})]))
    writer.abort([left, None], 1)
    assert got.count() == 10 and not list((tmp_path / "out" / batches.STAGED).iterdir())
    with pytest.raises(Exception):
        batches.start(spark.readStream.schema("id long").parquet(source).selectExpr("raise_error('x') AS id"), out, str(tmp_path / "c")).awaitTermination()
    assert got.count() == 10


def test_no_task_meets_a_whole_cursor(spark):
    """Of one cursor's rows only breaks and ends of slices go to its state; the slices' order is that of positions."""
    lacking = "id % 97 <> 0 AND id % 100 <> 1"
    seq = spark.range(4_000).where(lacking).selectExpr("0L AS host_id", "id AS pos", "0L AS cpu", "id + 4294965296 AS seq", "id AS observed_ns") \
        .withColumn("seq", F.expr("seq % 4294967296"))
    cut = audit.cut(audit.sequence_rows(seq), 500)
    assert cut.where("first OR last").count() == 16 and cut.count() < 120
    lost = spark.range(4_000).selectExpr("0L AS host_id", "id AS pos", "(id * 7919) % 3989 AS lost_total", "id AS observed_ns", "'windows-etw' AS backend")
    both = audit.sequence_rows(seq).unionByName(audit.lost_rows(lost))
    got = streamed(spark, both, "pos", audit.INPUT, lambda df: audit.audit_events(df, width=500), 3)
    assert rows(got) == rows(G.sequence_gaps(seq).unionByName(G.lost_gaps(lost)))


def test_parts_land_as_many_files(spark):
    """A part is written by all tasks, and large inputs land in more parts than asked for."""
    from lifeline.plans.bindings import landings

    schema = S.struct_of(("pos", S.T.LongType()))
    seen = [spark.read.parquet(folder).count() for folder in landings(spark.range(1_000, numPartitions=4).selectExpr("id AS pos"), "pos", schema, 2, 100)]
    assert seen == list(range(100, 1_001, 100))
    folder = landed(spark.range(1_000, numPartitions=4).selectExpr("id AS pos"), "pos", schema, 1)
    assert len(spark.read.parquet(folder).inputFiles()) > 1
    assert [spark.read.parquet(f).count() for f in landings(spark.range(0).selectExpr("id AS pos"), "pos", schema, 1)] == [0]


def test_recent_view_drops_early(spark):
    """A task hands on no more rows than the view holds, the latest ones."""
    from lifeline.streaming import recent

    events = S.as_events(spark.range(3_000, numPartitions=1).selectExpr(
        "0L AS host_id", f"{S.order_key('(id * 7919) % 3001', 1, 'id % 3')} AS order_key", "'start' AS kind", "id AS event_ns"))
    kept = events.mapInArrow(recent._latest(20), S.LIFECYCLE_EVENT).select("order_key.pos").collect()
    assert sorted(r.pos for r in kept) == sorted((i * 7919) % 3001 for i in range(3_000))[-20:]


def test_crowded_positions_land_in_parts(spark):
    """Rows may stand at the last positions, as those of large scans do; no part has more than asked for, and none is lost."""
    from lifeline.plans.bindings import landings

    schema = S.struct_of(("pos", S.T.LongType()), ("id", S.T.LongType()))
    crowded = spark.range(1_000, numPartitions=4).selectExpr("CASE WHEN id < 100 THEN id * 1000 ELSE 99900 + id div 10 END AS pos", "id")
    seen = [spark.read.parquet(folder).agg(F.count("*"), F.max("pos")).first() for folder in landings(crowded, "pos", schema, 3, 200)]
    counts = [c for c, _ in seen]
    assert counts[-1] == 1_000 and max(b - a for a, b in zip([0, *counts], counts)) <= 200
    assert all(seen[i][1] <= seen[i + 1][1] for i in range(len(seen) - 1))
    last = [spark.read.parquet(folder) for folder in landings(crowded, "pos", schema, 3, 200)][-1]
    assert sorted(last.collect()) == sorted(crowded.collect())


def test_replay_reaches_the_state_as_tables(spark):
    """The engine hands over a few values per key, not a row per notice, and they hold every row."""
    notices = spark.range(6_000, numPartitions=2).selectExpr(
        "id % 3 AS host_id", "id AS pos", "id % 50 AS pid", "'start' AS kind", "CASE WHEN id % 2 = 0 THEN id + 1700000000123456789 END AS event_ns")
    dealt = engine.dealt(S.conform(notices, live.INPUT), "pid", "false", 4)
    tables = engine.tables_of(dealt, ["host_id", "bucket"], live.INPUT)
    assert tables.count() <= 2 * 3 * 4
    assert sorted(map(str, engine.rows_of(tables, live.INPUT).collect())) == sorted(map(str, dealt.select(*live.INPUT.fieldNames()).collect()))
    one_host = tables.where("host_id = 1 AND bucket = 0")
    assert engine.rows_of(one_host, live.INPUT).exceptAll(dealt.where("host_id = 1 AND bucket = 0").drop("bucket")).count() == 0


@pytest.mark.parametrize("pieces", [1, 4])
def test_columns_equal_a_row_after_another(pieces):
    """Scans that failed, ended late, never ended or have a row twice, unknown families and kinds, missing starts."""
    import random

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    rng, rows = random.Random(17), []
    process = lambda pid, at: {**dict.fromkeys(S.PROCESS.fieldNames()), "process_id": rng.choice([f"connector:{pid}:{at}", f"{pid}:1", str(pid)]),
                               "pid": pid, "ppid": rng.choice([None, 0, 4]), "command": rng.choice("ab"),
                               "started_ns": rng.choice([None, at]), "captured_ns": rng.choice([None, at + 1])}
    for pos in range(0, 600, 2):
        pid, at = rng.randrange(6), 1_700_000_000_123_456_789 + pos * 400_000_000
        same = {**dict.fromkeys(live.INPUT.fieldNames()), "host_id": 1, "pos": pos, "observed_ns": at}
        rows.append({**same, "pid": pid, "kind": rng.choice(["start", "exec", "stop", None]), "family": rng.choice(["linux", "windows", None]),
                     "event_ns": rng.choice([None, at]), "exit_code": rng.choice([None, 3]), "cand": process(pid, at), "solid": rng.random() < 0.5})
        if pos % 30 == 0:
            shown = [{**same, "pos": pos + 1, "pid": p, "kind": "scan", "family": "linux", "event_ns": at, "cand": process(p, at), "solid": True}
                     for p in rng.sample(range(6), 3)]
            rows += [*shown, shown[0]] + [{**same, "pos": pos + 1, "kind": live.SCAN_END, "success": rng.choice([True, True, False, None])}] * (pos % 90 != 0)

    class Plain(dict):
        put = dict.__setitem__
        get = dict.get
        all = lambda self: [p for p, v in self.items() if v is not None]

    values = lambda r: tuple(tuple(v.values()) if isinstance(v, dict) else v for v in r.values())
    known, waiting, want = Plain(), [], []
    for r in rows:
        host, pid, pos, kind, family, _, at, *_ = row = values(r)
        if kind == "scan":
            waiting.append(row)
        elif kind == live.SCAN_END:
            here = {w[1]: w for w in waiting if w[2] == pos}
            waiting = [w for w in waiting if w[2] > pos]
            if row[10]:
                want += [live.apply(known, host, p, pos, "absent", known.get(p)[2], at, at, None, None, False) for p in known.all() if p not in here]
                want += [live.apply(known, *w[:10]) for w in here.values()]
        else:
            want.append(live.apply(known, *row[:10]))

    schema = to_arrow_schema(live.INPUT)
    left, open_rows, got = pa.Table.from_pylist([], to_arrow_schema(live.LIVE)), pa.Table.from_pylist([], schema), []
    for i in range(pieces):
        part = rows[len(rows) * i // pieces:len(rows) * (i + 1) // pieces]
        rng.shuffle(part)
        landed_rows = pa.concat_tables([open_rows, pa.Table.from_pylist(part, schema)]).combine_chunks()
        stored = engine.get_tables([v for v, in engine.put_tables(left)], left.schema)
        states, left, open_rows = live.folded(stored, landed_rows)
        got += [values(r) for r in states.to_pylist()]
    assert len(got) > 300 and sorted(map(str, got)) == sorted(str(tuple(w)) for w in want)
    assert {p: known[p] for p in known.all()} == {r["pid"]: (tuple(r["process"].values()), r["pos"], r["family"]) for r in left.to_pylist()}


def test_tables_keep_rows():
    """Rows become columns and rows again: null structs, integers beyond doubles beside nulls, no rows."""
    from lifeline.streaming.trace import FOUND

    big = 1_700_000_000_123_456_789
    process = (f"1:{big}", 1, None, "c", None, None, None, None, None, None, big, None)
    width = len(FOUND) - 1
    rows = [(1, *(None,) * width), tuple(process if f.name in ("before", "after") else {"long": big, "string": "x", "boolean": False, "integer": 3}.get(
        f.dataType.typeName()) for f in FOUND.fields)]
    for some in (rows, rows[:1], []):
        values = engine.put_tables(engine.table_of(some, FOUND))
        assert engine.tuples(engine.get_tables((v for v, in values), engine.to_arrow_schema(FOUND))) == some
