"""Scalar expressions on literal cases."""

from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.functions import clock, identity, render, text

SECOND = 10**9


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_text(spark):
    assert column(spark, ["safe\x1b[2J\nname\x9b31m", "plain", "\x7f\x00é\U0001f600", ""], text.escape_controls) == [
        "safe\\x1b[2J\\x0aname\\x9b31m", "plain", "\\x7f\\x00é\U0001f600", ""]
    assert column(spark, ["αβγδε", "abc", "abcd"], lambda c: text.shorten(c, 4)) == ["α...", "abc", "abcd"]
    assert column(spark, ["αβγδε"], lambda c: text.shorten(c, 3)) == ["αβγ"]
    assert column(spark, ["ab", "abcdef"], lambda c: text.padded(c, 4)) == ["ab  ", "abcdef"]
    assert column(spark, ["/a/b/", "/", "///", "x", "", "a//b"], text.base_name) == ["b", "/", "/", "x", ".", "b"]
    assert column(spark, ["\t a b  ", "x", None], text.strip) == ["a b", "x", None]
    assert column(spark, [" a b\tc  ", ""], text.words) == [["a", "b", "c"], []]
    assert column(spark, ["", None, "x"], text.or_dash) == ["-", "-", "x"]


def test_identity(spark):
    assert column(spark, ["12", "", None], lambda c: identity.process_id(F.lit(7), c)) == ["7:12", "7", "7"]
    ids = ["connector:1:2", "etw:1:2", "es:1:2", "trace:1:2", "7:1", "connector", "7", "estate:1"]
    made = column(spark, ids, lambda c: F.expr(identity.is_provisional("v")))
    assert made == [True] * 4 + [False] * 4
    cases = [  # first ID, start, second ID, start, same
        ("42:100", 1_000_000_000, "42:101", 1_010_000_000, False),
        ("connector:42:1", 1_000_000_000, "42:101", 1_010_000_000, True),
        ("connector:42:1", 1_000_000_000, "42:101", 3_000_000_000, True),
        ("connector:42:1", 1_000_000_000, "42:101", 3_000_000_001, False),
        ("42:101", 3_000_000_000, "trace:42:1", 1_000_000_000, True),
        ("connector:42:1", None, "42:101", 1, False), ("42:1", None, "42:1", 5, True),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                                 "i int, a string, s long, b string, t long, same boolean")
    check = F.expr(identity.same_generation("1", "a", "s", "1", "b", "t"))
    assert [r[0] for r in rows.orderBy("i").select(check).collect()] == [c[4] for c in cases]
    assert rows.select(F.expr(identity.same_generation("1", "a", "s", "2", "a", "s"))).distinct().collect()[0][0] is False


def test_start_times(spark):
    cases = [  # token, boot, captured, start (seconds)
        ("250", 100, 110, 102.5), ("invalid", 100, 110, None), ("1300", 100, 110, None), ("1100", 100, 110, 111),
        ("-5", 100, 110, None), ("+5", 100, 110, None), ("", 100, 110, None), ("0", 100, 110, 100), ("250", None, 110, None),
        ("18446744073709551615", 100, 110, None), ("18446744073709551616", 100, 110, None), ("000250", 100, 110, 102.5),
    ]
    rows = spark.createDataFrame(
        [(i, t, b and b * SECOND, c * SECOND) for i, (t, b, c, _) in enumerate(cases)], "i int, t string, b long, c long")
    got = rows.orderBy("i").select(clock.start_ns_of_ticks(F.col("t"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == [None if c[3] is None else int(c[3] * SECOND) for c in cases]
    boots = column(spark, ["12.25 40.0", "", "-3.0 1", "x", "5"], lambda c: clock.boot_ns(c, F.lit(100 * SECOND)))
    assert boots == [87_750_000_000, None, None, None, 95_000_000_000]


def test_event_times(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([110, 90, 0, 100])], "i int, k long").selectExpr("i", "CAST(k AS decimal(20,0)) AS k")
    made = clock.event_ns_of_kernel(F.col("k"), F.lit(100), F.lit(30 * SECOND), F.lit(True), F.lit(7))
    assert [r[0] for r in rows.orderBy("i").select(made).collect()] == [
        30 * SECOND + 10, 30 * SECOND - 10, 7, 30 * SECOND]
    invalid = clock.event_ns_of_kernel(F.col("k"), F.lit(100), F.lit(30 * SECOND), F.lit(False), F.lit(7))
    assert {r[0] for r in rows.select(invalid).collect()} == {7}
    far = clock.event_ns_of_kernel(F.lit("18446744073709551615").cast("decimal(20,0)"), F.lit(1), F.lit(1), F.lit(True), F.lit(7))
    assert rows.select(far).first()[0] == 7
    now = 1_700_000_000 * SECOND
    unit = lambda at: at // 100 + 116_444_736_000_000_000
    cases = [(unit(now), now), (unit(now + 60 * SECOND), now + 60 * SECOND), (unit(now + 60 * SECOND) + 1, now),
             (unit(now - 86_400 * SECOND), now - 86_400 * SECOND), (unit(now - 86_400 * SECOND) - 1, now), (0, now), (-5, now)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, f long")
    got = rows.orderBy("i").select(clock.event_ns_of_filetime(F.col("f"), F.lit(now))).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]


def test_codes_and_durations(spark):
    status = [7 << 8, 137, 0x7F, 0x80 | 11, 0, 0x17F, 9]
    assert column(spark, status, clock.exit_code_of_wait_status, "long") == [7, 137, 127, 139, 0, 383, 137]
    rows = spark.createDataFrame([(25, 10, 19), (25, None, 19), (5, 10, 1), (25, None, None)], "e long, s long, c long")
    ns = rows.selectExpr("e * 1000000000L AS e", "s * 1000000000L AS s", "c * 1000000000L AS c")
    assert [r[0] for r in ns.selectExpr(clock.lifetime_ms("e", "s", "c")).collect()] == [15000, 6000, 0, None]
    polls = column(spark, [10**7, 10**8, 10**9, 10**10], clock.resync_interval_ns, "long")
    assert polls == [10**9, 10**9, 10**10, 3 * 10**10]


def event(**given):
    return tuple(given.get(name) for name in S.LIFECYCLE_EVENT.fieldNames())


def lines(spark, events, **options):
    df = spark.createDataFrame(events, S.LIFECYCLE_EVENT)
    return [r[0] for r in df.select(render.log_line(**options)).collect()]


def test_log_lines(spark):
    parent = [(4, "4:1", "ChatGPT --x", "/Applications/ChatGPT.app/Contents/MacOS/ChatGPT", "u")]
    worker = dict(pid=9, ppid=4, command="sample-worker")
    start = event(kind="start", parent_chain=parent, **worker)
    assert lines(spark, [event(kind="stop", **worker)]) == ["Stop:  9        sample-worker"]
    assert lines(spark, [start], show_ppid=True) == ["Start: 9        4        sample-worker"]
    assert lines(spark, [start], show_parent=True) == ["Start: 9        ChatGPT                  sample-worker"]
    assert lines(spark, [event(kind="start", pid=7, command="worker\x1b[2J")]) == ["Start: 7        worker\\x1b[2J"]
    assert lines(spark, [event(kind="start", pid=7, exe="/bin/w"), event(kind="exec", pid=7)]) == [
        "Start: 7        /bin/w", "Exec:  7        -"]
    assert lines(spark, [event(kind="other", message="odd")]) == ["Event:          odd"]
    long = "x" * 200
    every = [event(kind=k, pid=123, ppid=4, command=long, message=long, parent_chain=parent)
             for k in ("start", "exec", "stop", "gap")]
    for ppid in (False, True):
        for shown in (False, True):
            made = lines(spark, every, show_ppid=ppid, show_parent=shown)
            assert len({m.index(long) for m in made}) == 1 and all(m.endswith(long) for m in made)
    wide = [(4, "4:1", "first second", None, "u")]
    df = spark.createDataFrame([event(parent_chain=wide), event(parent_chain=[]), event()], S.LIFECYCLE_EVENT)
    assert [r[0] for r in df.select(render.parent_executable(F.col("parent_chain"))).collect()] == ["first", "-", "-"]
    gap = spark.createDataFrame([event(kind="gap", backend="poll", message="m")], S.LIFECYCLE_EVENT)
    assert gap.select(render.diagnostic_line()).first()[0] == "backend=poll diagnostic=m"
