"""Text and record sources on literal cases."""

from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.operators import replay as R
from lifeline.sources import dumps, fallback, notices, tables


def test_ps_lines(spark):
    lines = ["100 50 jer /bin/ps -axo pid=,ppid=,user=,command=", "101 50 jer /bin/ps aux", "  7\t1  root   a  b ", "x y",
             "z 1 u c", "8 q u c", "", "+9 -1 u c", "10 1 u 　c"]
    df = spark.createDataFrame([(line,) for line in lines], "line string").withColumn("collector_pid", F.lit(100))
    got = {r["pid"]: (r["process_id"], r["ppid"], r["user"], r["exe"], r["command"]) for r in dumps.ps_processes(df).collect()}
    assert got == {101: ("101", 50, "jer", "/bin/ps", "/bin/ps aux"), 7: ("7", 1, "root", "a", "a b"),
                   9: ("9", -1, "u", "c", "c"), 10: ("10", 1, "u", "c", "c")}
    bad = {r["line"]: r["reject"] for r in dumps.ps_quarantine(df).collect()}
    assert bad == {"x y": "fewer than four fields", "": "fewer than four fields", "z 1 u c": "PID is not an integer",
                   "8 q u c": "parent PID is not an integer"}


def test_proc_files(spark):
    rest = " S 5 6 9 34816 " + "0 " * 14 + "250 0"
    files = {
        1: {"stat": "1 (a (b) c)" + rest, "cmdline": "run\0\0--x\0\0", "status": "Name:\tx\nUid:\t5\t6\n",
            "fd0": "/dev/pts/1", "exe": " /bin/a ", "cwd": "/w"},
        2: {"stat": "2 (name)" + rest.replace("34816", "0"), "cmdline": "\0\0", "status": "Uid:\n", "fd0": "pipe:1"},
        3: {"stat": "3 (short) S 5 6", "cmdline": "x"}, 4: {"cmdline": "x"}, 5: {"stat": "5 no parens" + rest},
        6: {"stat": "6 (n)" + rest.replace(" 5 6", " p 6")}, 7: {"stat": "7 (two\nlines)" + rest},
    }
    rows = [(0, 0, pid, name, text, 110 * 10**9, 100 * 10**9) for pid, f in files.items() for name, text in f.items()]
    df = spark.createDataFrame(rows, "host_id long, scan_id long, pid long, file string, content string, "
                                     "captured_ns long, booted_ns long")
    got = {r["pid"]: r for r in dumps.proc_processes(df).collect()}
    assert set(got) == {1, 2, 7}
    one, two = got[1], got[2]
    assert [one[c] for c in ("process_id", "ppid", "command", "exe", "cwd", "uid", "tty", "session", "started_ns")] == [
        "1:250", 5, "run --x", "/bin/a", "/w", "5", "/dev/pts/1", "9", 102_500_000_000]
    assert [two[c] for c in ("command", "exe", "uid", "tty")] == ["name", None, None, None]
    assert got[7]["command"] == "two\nlines" and got[7]["tty"] == "34816"


def test_platform_defaults(spark):
    mac = spark.createDataFrame(
        [(0, 1, "a", "/a", "k", 3, 5), (7, 1, " x y ", "", "n", -1, 5), (8, 1, "", "/p", "n", 2, 5)],
        "pid long, ppid long, args string, path string, comm string, tdev long, started_ns long")
    got = {r["pid"]: (r["process_id"], r["command"], r["exe"], r["tty"]) for r in tables.macos_processes(mac).collect()}
    assert got == {7: ("7:5", "x y", "x", None), 8: ("8:5", "n", "/p", "2")}
    win = spark.createDataFrame([(7, 1, "i.exe", "", "", None), (8, 1, "i.exe", "c", "e", 9)],
                                "pid long, ppid long, image string, detail_command string, detail_exe string, started_ns long")
    got = {r["pid"]: (r["process_id"], r["command"], r["exe"]) for r in tables.windows_processes(win).collect()}
    assert got == {7: ("7", "i.exe", "i.exe"), 8: ("8:9", "c", "e")}


def test_users(spark):
    df = spark.createDataFrame([(0, "1000"), (1, "1000"), (0, "1"), (0, ""), (0, None)], "host_id long, uid string")
    names = spark.createDataFrame([(0, "1000", "jer"), (1, "1000", "ann"), (1, "1000", "amy"), (0, "1", "")],
                                  "host_id long, uid string, user string")
    got = sorted(((r["host_id"], r["uid"], r["user"]) for r in tables.resolve_users(df, names).collect()), key=str)
    assert got == [(0, "", None), (0, "1", "1"), (0, "1000", "jer"), (0, None, None), (1, "1000", "ann")]


def test_linux_records(spark):
    schema = ("host_id long, pos long, cpu long, seq long, what long, process_pid long, process_tgid long, parent_tgid long, "
              "exit_status long, kernel_ns long, observed_ns long, event_ns long")
    rows = [(0, 1, 4, 12, 1, 20, 20, 10, None, 900, 1, 1), (0, 2, 4, 13, 0x80000000, 20, 20, None, 7 << 8, 901, 1, 1),
            (0, 3, 4, 14, 1, 21, 20, 10, None, 902, 1, 1), (0, 4, 4, 15, 64, 20, 20, None, None, 903, 1, 1)]
    records = notices.linux_records(spark.createDataFrame(rows, schema))
    got = [(r["kind"], r["pid"], r["ppid"], r["exit_code"], r["relevant"], r["seq"]) for r in records.orderBy("pos").collect()]
    assert got[0] == ("fork", 20, 10, None, True, 12)
    assert got[1][:4] == ("exit", 20, None, 7)
    assert [g[4] for g in got] == [True, True, False, False] and [g[5] for g in got] == [12, 13, 14, 15]
    assert notices.linux_notices(records).count() == 2


def test_windows_and_macos_records(spark):
    now = 1_700_000_000 * 10**9
    unit = now // 100 + 116_444_736_000_000_000
    schema = ("host_id long, pos long, provider string, opcode long, property_pid long, payload_pid long, header_pid long, "
              "property_parent long, payload_parent long, property_status long, payload_status long, filetime long, observed_ns long")
    rows = [(0, 1, "process", 1, 5, 6, 7, 0, 3, 1, 1, unit, now), (0, 2, "process", 2, 0, 6, 7, None, 3, None, 4294967295, 0, now),
            (0, 3, "process", 2, None, None, 7, None, None, None, None, unit, now), (0, 4, "process", 1, 0, 0, 0, 1, 1, 1, 1, 0, now),
            (0, 5, "process", 3, 5, 6, 7, 1, 1, 1, 1, 0, now), (0, 6, "other", 1, 5, 6, 7, 1, 1, 1, 1, 0, now)]
    got = notices.windows_notices(spark.createDataFrame(rows, schema)).orderBy("pos").collect()
    assert [(r["kind"], r["pid"], r["ppid"], r["exit_code"], r["event_ns"]) for r in got] == [
        ("start", 5, 0, None, now), ("stop", 6, 3, 4294967295, now), ("stop", 7, 0, None, now)]
    schema = ("host_id long, pos long, message_version long, kind string, pid long, ppid long, uid string, tty string, session string, "
              "pid_version long, started_ns long, event_ns long, observed_ns long, exe string, args array<string>, cwd string, "
              "exit_status long, seq long, global_seq long")
    rows = [(0, v, v, kind, 9, 1, "5", "/dev/t", "2", 3, start, 10, 11, "/bin/e", ["a", "b"], "/w", 256, 1, 2)
            for v, kind, start in ((1, "exec", 5), (2, "fork", 5), (3, "exec", 0), (4, "exit", 7))]
    records = notices.macos_records(spark.createDataFrame(rows, schema))
    seqs = {r["pos"]: (r["seq"], r["global_sequence"]) for r in records.collect()}
    assert seqs == {1: (1, False), 2: (1, False), 3: (1, False), 4: (2, True)}
    made = {r["pos"]: r for r in R.candidates(notices.macos_notices(records)).collect()}
    shown = {p: tuple(r["cand"][c] for c in ("process_id", "command", "cwd", "tty", "started_ns", "user", "captured_ns"))
             for p, r in made.items()}
    assert shown == {1: ("es:9:3", "a b", None, None, None, "5", 11), 2: ("es:9:3", "/bin/e", None, "/dev/t", None, "5", 11),
                     3: ("es:9:3", "a b", "/w", "/dev/t", None, "5", 11), 4: ("9:7", "/bin/e", None, "/dev/t", 7, "5", 11)}
    assert made[4]["exit_code"] == 1 and made[1]["exit_code"] is None


def test_fallback(spark):
    def source(backend, hosts, positions):
        rows = spark.createDataFrame([(h, p) for h in hosts for p in positions], "host_id long, pos long")
        return S.as_events(rows.selectExpr(
            "host_id", S.order_key("pos", 1) + " AS order_key", "'start' AS kind", "pos AS event_ns", f"'{backend}' AS backend"))

    health = spark.createDataFrame([
        (0, "auto", "n", True, None, None, 1), (1, "auto", "n", True, 2, "died", 5), (2, "auto", "n", False, None, "none", 6),
        (3, "poll", "n", True, None, None, 1), (4, "n", "n", True, 2, "died", 5)], S.SOURCE_HEALTH)
    hosts = range(5)
    got = {h: [] for h in hosts}
    chosen = fallback.choose(source("n", hosts, [1, 2, 3]), source("poll", hosts, [1, 2, 3]), health, "tool")
    for r in chosen.orderBy("host_id", "order_key").collect():
        got[r["host_id"]].append((r["kind"], r["backend"], r["order_key"]["pos"], r["message"], r["observed_ns"]))
    native = lambda *p: [("start", "n", i, None, None) for i in p]
    polled = lambda *p: [("start", "poll", i, None, None) for i in p]
    assert got[0] == native(1, 2, 3) and got[3] == polled(1, 2, 3) and got[4] == native(1, 2)
    assert got[1] == native(1, 2) + [("gap", "n", 2, "backend n failed and tool switched to poll: died", None)] + polled(3)
    assert got[2] == [("gap", "poll", -1, "backend auto was unavailable and tool started with poll: none", None)] + polled(1, 2, 3)
