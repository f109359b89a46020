"""Order of diagnostics, restarted collectors, parents at scans, and the polling watch after a failure."""

from lifeline import schemas as S
from lifeline.operators import gaps
from lifeline.operators import replay as R
from lifeline.operators.reconcile import due_scans
from lifeline.sources import fallback


def test_batch_diagnostics_precede_its_notices(spark):
    batch = spark.createDataFrame([(0, 19, 10, True)], "host_id long, pos long, batch_pos long, overrun boolean")
    flags = gaps.batch_gaps(batch.selectExpr("*", "0L AS observed_ns"))
    record = "host_id long, pos long, batch_pos long, cpu long, seq long, observed_ns long"
    lost = gaps.sequence_gaps(spark.createDataFrame([(0, 5, 1, 0, 1, 0), (0, 15, 10, 0, 9, 0)], record))
    assert [r["order_key"]["pos"] for r in flags.unionByName(lost).collect()] == [10, 10]


def test_restarted_collectors_count_anew(spark):
    rows = [(0, 1, "a", 5), (0, 2, "b", 0), (0, 3, "b", 3)]
    df = spark.createDataFrame(rows, "host_id long, pos long, client string, n long").selectExpr(
        "*", "'windows-etw' AS backend", "n AS lost_total", "n AS seq", "0L AS cpu", "0L AS observed_ns", "true AS global_sequence",
        "'start' AS kind")
    assert sorted(r["lost"] for r in gaps.lost_increases(df).collect()) == [3, 5]
    assert [(r["pos"], r["expected_seq"]) for r in gaps.sequence_breaks(df).collect()] == [(3, 1)]
    assert gaps.endpoint_breaks(df).count() == 0


def test_the_interval_is_exact_to_the_nanosecond(spark):
    """A poll of one second gives ten seconds: one nanosecond less is not due, all of them are."""
    first, interval = 1_700_000_010_000_000_000, 10_000_000_000
    rows = [(0, 1, 10, first), (0, 2, 20, first + interval - 1), (0, 3, 30, first + interval)]
    manifest = spark.createDataFrame(rows, "host_id long, scan_id long, pos long, observed_ns long")
    assert sorted(r["scan_id"] for r in due_scans(manifest, 1_000_000_000).collect()) == [1, 3]


def test_parents_that_vanish_with_their_child(spark):
    facts = spark.createDataFrame([(0, 10, 1, "10:1"), (0, 10, 5, None)], "host_id long, pid long, pos long, id string")
    blank = {c: "NULL" for c in S.PROCESS_COLUMNS}
    states = facts.selectExpr("host_id", "pid", "pos", "CASE WHEN id IS NOT NULL THEN " + S.process_struct(
        **{**blank, "process_id": "id", "pid": "pid"}) + " END AS after")
    rows = spark.createDataFrame([(0, 11, 10, 5, "stop"), (0, 12, 10, 5, "start")], "host_id long, pid long, ppid long, pos long, kind string")
    got = {r["pid"]: r["parent"] and r["parent"]["process_id"] for r in R.temporal_parents(rows, states).collect()}
    assert got == {11: "10:1", 12: None}
    chains = {r["pid"]: [p["pid"] for p in r["parent_chain"]] for r in R.temporal_ancestors(rows, states).collect()}
    assert chains == {11: [10], 12: []}


def test_polling_begins_after_the_failure(spark):
    manifest = spark.createDataFrame([(h, p) for h in range(4) for p in (10, 20, 30)], "host_id long, pos long")
    health = spark.createDataFrame(
        [(0, "auto", True, 15), (1, "auto", False, None), (2, "poll", True, None), (3, "auto", True, None)],
        "host_id long, requested string, available boolean, failed_pos long")
    got = sorted(tuple(r) for r in fallback.polled_attempts(manifest, health).collect())
    assert got == [(0, 20), (0, 30), *[(h, p) for h in (1, 2) for p in (10, 20, 30)]]


def test_stored_tables_are_removed(spark):
    import os

    from lifeline.plans.catalog import QUERIES
    from lifeline.session import shared_folder, stored

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with stored():
        QUERIES["ancestor_chain"](spark, "/root/testdata/sf0.001").count()
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
