"""Search, orders, pages, retention and sinks."""

import pytest

from lifeline import schemas as S
from lifeline import sinks
from lifeline.operators import views as V


def events(spark, rows):
    names = S.LIFECYCLE_EVENT.fieldNames()
    made = []
    for pos, given in enumerate(rows):
        given = {"host_id": 0, "kind": "start", **given, "order_key": (pos, 1, given.get("pid"), 0)}
        made.append(tuple(given.get(n) for n in names))
    return spark.createDataFrame(made, S.LIFECYCLE_EVENT)


def test_search(spark):
    chain = [(3, "3:1", "Parent Cmd", "/p", "Root")]
    df = events(spark, [dict(pid=1, command="coverage"), dict(kind="gap", message="Coverage LOST here"),
                        dict(pid=42, parent_chain=chain)])
    find = lambda text: [r["order_key"]["pos"] for r in V.matching(df, text).collect()]
    assert find("coverage lost") == [1] and find("COVERAGE") == [0, 1] and find("") == [0, 1, 2]
    assert find("parent cmd") == [2] and find("root") == [2] and find("\n42\n0\n") == [2] and find("nothing") == []


@pytest.mark.parametrize("mode, expected", [
    (V.TIMELINE, [0, 1, 2, 3, 4]), (V.DURATION, [3, 1, 0, 2, 4]), (V.PID, [2, 4, 1, 0, 3]), (V.COMMAND, [4, 0, 2, 1, 3])])
def test_orders_and_pages(spark, mode, expected):
    df = events(spark, [dict(pid=7, command="a", duration_ms=10), dict(pid=6, command="B", duration_ms=50),
                        dict(pid=1, command="A"), dict(pid=9, command="c", duration_ms=60), dict(pid=1)])
    view = V.recent(df)
    seen = lambda scroll, limit: [
        (r["order_key"]["pos"], r["selected"]) for r in V.page(view, mode, scroll, limit).collect()]
    assert [p for p, _ in seen(0, 10)] == expected
    assert seen(0, 2) == [(expected[3], False), (expected[4], True)]
    assert seen(2, 2) == [(expected[1], False), (expected[2], True)]
    assert seen(4, 3) == [(expected[0], True)] and seen(9, 3) == []
    assert [r["order_key"]["pos"] for r in df.collect()] == [0, 1, 2, 3, 4]
    assert V.clamp_scroll(9, 5) == 4 and V.clamp_scroll(-1, 5) == 0 and V.clamp_scroll(3, 0) == 0


def test_retention_and_summary(spark):
    df = events(spark, [dict(pid=i, backend="poll" if i < 3 else None, host_id=i % 2) for i in range(6)])
    assert sorted(r["pid"] for r in V.recent(df, 4).collect()) == [2, 3, 4, 5]
    assert sorted(r["pid"] for r in V.recent_per_host(df, 2).collect()) == [2, 3, 4, 5]
    assert tuple(V.summary(V.recent(df, 4)).first()) == ("poll", 4)
    assert tuple(V.summary(V.recent(df, 2)).first()) == (None, 2)


def test_sinks(spark, tmp_path):
    df = events(spark, [dict(pid=1, command="a", event_ns=0), dict(kind="gap", message="m", backend="poll", event_ns=0)])
    sinks.append_events(S.as_events(df.drop("event_time")), f"{tmp_path}/events")
    sinks.append_events(S.as_events(df.drop("event_time")), f"{tmp_path}/events")
    assert spark.read.parquet(f"{tmp_path}/events").count() == 4
    sinks.append_log(df, f"{tmp_path}/log")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/log").collect()] == ["Start: 1        a", "Gap:            m"]
    sinks.append_diagnostics(df, f"{tmp_path}/diagnostics")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/diagnostics").collect()] == ["backend=poll diagnostic=m"]
    sinks.refresh_recent(None, df, f"{tmp_path}/recent-a")
    view = spark.read.schema(df.schema).parquet(f"{tmp_path}/recent-a")
    sinks.refresh_recent(view, df, f"{tmp_path}/recent-b")
    assert spark.read.parquet(f"{tmp_path}/recent-b").count() == 4
