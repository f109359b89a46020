"""Completeness auditing on literal cases, whole and sliced."""

import pytest

from lifeline.operators import gaps
from lifeline.operators.diff import failed_scan_gaps  # noqa: F401

RECORD = "host_id long, pos long, cpu long, seq long, observed_ns long"


def messages(df):
    return [r["message"] for r in df.orderBy("host_id", "order_key").collect()]


@pytest.mark.parametrize("width", [None, 1, 2, 1 << 20])
def test_connector_sequences(spark, width):
    rows = [(0, 1, 2, 10, 0), (0, 2, 2, 12, 0),                      # a gap
            (1, 1, 2, 4294967295, 0), (1, 2, 2, 0, 0),               # wraps without a gap
            (2, 1, 0, 5, 0), (2, 2, 1, 9, 0), (2, 3, 0, 6, 0), (2, 4, 1, 8, 0), (2, 5, 1, 9, 0)]  # out of order
    got = messages(gaps.sequence_gaps(spark.createDataFrame(rows, RECORD), width))
    say = "process connector sequence gap on cpu {}; expected sequence {}, received {}".format
    assert got == [say(2, 11, 12), say(1, 10, 8)]


def test_cursors_continue(spark):
    first = spark.createDataFrame([(0, 1, 2, 10, 0)], RECORD)
    later = spark.createDataFrame([(0, 2, 2, 12, 0), (0, 3, 3, 1, 0)], RECORD)
    assert messages(gaps.sequence_gaps(later, cursors=gaps.last_sequences(first))) == [
        "process connector sequence gap on cpu 2; expected sequence 11, received 12"]


@pytest.mark.parametrize("width", [None, 2])
def test_endpoint_sequences(spark, width):
    rows = [(0, 1, "start", 20, True), (0, 2, "exec", 0, True), (0, 3, "stop", 23, True), (0, 4, "exec", 24, True),
            (1, 1, "start", 5, False), (1, 2, "stop", 1, False), (1, 3, "start", 6, False), (1, 4, "stop", 4, False)]
    df = spark.createDataFrame(rows, "host_id long, pos long, kind string, seq long, global_sequence boolean")
    got = messages(gaps.endpoint_gaps(df.selectExpr("*", "0L AS observed_ns"), width))
    say = "macOS Endpoint Security sequence gap; expected sequence {}, received {}".format
    assert got == [say(21, 23), say(2, 4)]


@pytest.mark.parametrize("width", [None, 3])
def test_loss_counters(spark, width):
    rows = [(0, p, "windows-etw", n, 0) for p, n in enumerate([0, 3, 3, 2, 3, 7])] + [
        (0, 9, "macos-endpoint-security", 1, 0)]
    df = spark.createDataFrame(rows, "host_id long, pos long, backend string, lost_total long, observed_ns long")
    say = "{} callback queue overflowed; expected every lifecycle notice, dropped {} notices".format
    assert messages(gaps.lost_gaps(df, width)) == [
        say("Windows ETW", 3), say("Windows ETW", 4), say("macOS Endpoint Security", 1)]
    totals = {r["backend"]: (r["lost"], r["gaps"]) for r in gaps.completeness_summary(df, width).collect()}
    assert totals == {"windows-etw": (7, 2), "macos-endpoint-security": (1, 1)}


def test_batch_flags(spark):
    rows = [(0, 1, True, False, True, False), (0, 2, False, True, True, False), (0, 3, False, False, False, True)]
    df = spark.createDataFrame(
        rows, "host_id long, pos long, truncated boolean, overrun boolean, malformed boolean, receive_overflow boolean")
    events = gaps.batch_gaps(df.selectExpr("*", "0L AS observed_ns"))
    assert messages(events) == [gaps.TRUNCATED, gaps.OVERRUN, gaps.MALFORMED, gaps.RECEIVE_OVERFLOW]
    assert gaps.gap_counts(events).first()["count"] == 4


def test_failed_resync(spark):
    df = spark.createDataFrame([(0, 1, False, "E", 5), (0, 2, True, None, 6)],
                               "host_id long, pos long, success boolean, error string, observed_ns long")
    got = gaps.resync_gaps(df, "windows-etw").first()
    assert got["message"] == "Windows ETW resync failed; expected a complete process table, received error E"
    assert (got["event_ns"], got["backend"]) == (5, "windows-etw")
