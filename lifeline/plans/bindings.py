"""Process-shaped views over the general test tables, in Spark and in SQL.

The test tables hold no process data; these views derive it with plain
expressions over whole tables. ``SQL`` states the same views for the checker.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeline import schemas as S
from lifeline.session import configure, materialise, new_folder

DAY_NS = 86_400_000_000_000
EPOCH_NS = 1_704_067_200_000_000_000  # 2024-01-01, the first day of the event table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def events(spark: SparkSession, sf_dir: str, pace: int = 1) -> DataFrame:
    """Events with host, PID, parent PID, day and nanoseconds; time runs ``pace`` times faster."""
    return table(spark, sf_dir, "events").select(
        F.expr("user_id % 10").alias("host_id"), (F.col("user_id") + 1).alias("pid"),
        F.expr("""CASE WHEN user_id div 10 = 0 THEN 0
                  ELSE 10 * ((user_id div 10) div 3) + user_id % 10 + 1 END""").alias("ppid"),
        F.expr(f"(unix_micros(CAST(ts AS timestamp)) * 1000 - {EPOCH_NS}) div {DAY_NS}").alias("scan_id"),
        (ns("ts") if pace == 1 else F.expr(f"{EPOCH_NS} + (unix_micros(CAST(ts AS timestamp)) * 1000 - {EPOCH_NS}) div {pace}"))
        .alias("ts_ns"), "event_id", "user_id", "event_type", "value",
    )


SQL = {}
SQL["v_event"] = f"""
  SELECT user_id % 10 AS host_id, user_id + 1 AS pid,
         CASE WHEN user_id // 10 = 0 THEN 0 ELSE 10 * ((user_id // 10) // 3) + user_id % 10 + 1 END AS ppid,
         (epoch_ns(ts) - {EPOCH_NS}) // {DAY_NS} AS scan_id,
         epoch_ns(ts) AS ts_ns, event_id, user_id, event_type, value
  FROM events"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One process-table scan per host and day; a user seen that day is a process."""
    grouped = events(spark, sf_dir).groupBy("host_id", "scan_id", "pid", "ppid", "user_id").agg(
        F.max_by("event_type", "event_id").alias("command"), F.min("ts_ns").alias("captured_ns"),
        F.max("event_id").alias("row_pos"),
    )
    return grouped.select(
        "host_id", "scan_id", F.col("pid").cast("string").alias("process_id"), "pid", "ppid",
        "command", F.concat(F.lit("/bin/"), "command").alias("exe"),
        (F.lit(1000) + F.col("user_id") % 7).cast("string").alias("uid"),
        (F.lit(1000) + F.col("user_id") % 7).cast("string").alias("user"),
        F.when(F.col("user_id") % 3 != 0, F.col("captured_ns")).alias("started_ns"),
        "captured_ns", "row_pos",
    )


SQL["v_scan"] = """
  SELECT host_id, scan_id, CAST(pid AS VARCHAR) AS process_id, pid, ppid, command,
         '/bin/' || command AS exe, CAST(1000 + user_id % 7 AS VARCHAR) AS uid,
         CAST(1000 + user_id % 7 AS VARCHAR) AS "user",
         CASE WHEN user_id % 3 <> 0 THEN captured_ns END AS started_ns, captured_ns, row_pos
  FROM (SELECT host_id, scan_id, pid, ppid, user_id, arg_max(event_type, event_id) AS command,
               min(ts_ns) AS captured_ns, max(event_id) AS row_pos
        FROM v_event GROUP BY ALL)"""


def manifest(spark: SparkSession, sf_dir: str, failures: bool = False) -> DataFrame:
    """One attempt per host and day with events, at position ten times the day; some fail if asked for."""
    success = (F.col("host_id") * 7 + F.col("scan_id")) % 11 != 0
    return events(spark, sf_dir).select("host_id", "scan_id").distinct().select(
        "host_id", "scan_id", (F.col("scan_id") * 10).alias("pos"),
        (success if failures else F.lit(True)).alias("success"),
        F.when(~success, F.lit("table unreadable")).alias("error"),
        ((F.col("scan_id") + 1) * DAY_NS + EPOCH_NS).alias("observed_ns"),
    )


SQL["v_manifest"] = f"""
  SELECT DISTINCT host_id, scan_id, (host_id * 7 + scan_id) % 11 <> 0 AS success,
         (scan_id + 1) * {DAY_NS} + {EPOCH_NS} AS observed_ns FROM v_event"""
SQL["v_numbered"] = """
  SELECT host_id, scan_id, observed_ns,
         row_number() OVER (PARTITION BY host_id ORDER BY scan_id) - 1 AS ordinal,
         lead(observed_ns) OVER (PARTITION BY host_id ORDER BY scan_id) AS next_observed_ns,
         lead(scan_id * 10) OVER (PARTITION BY host_id ORDER BY scan_id) AS next_pos
  FROM v_manifest"""
SQL["v_numbered_ok"] = SQL["v_numbered"] + " WHERE success"

def notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a Linux notice; details are readable where the value is above 50."""
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "fork").when(
        F.col("event_type").isin("click", "view"), "exec").otherwise("exit")
    none = F.lit(None).cast("string")
    proc = F.struct(
        F.concat_ws(":", F.col("pid").cast("string"), F.col("event_id").cast("string")).alias("process_id"),
        "pid", "ppid", F.col("event_type").alias("command"),
        F.concat(F.lit("/bin/"), "event_type").alias("exe"), none.alias("cwd"), none.alias("user"),
        none.alias("uid"), none.alias("tty"), none.alias("session"),
        F.col("ts_ns").alias("started_ns"), F.col("ts_ns").alias("captured_ns"),
    )
    return e.select(
        "host_id", F.lit("linux").alias("family"), F.col("event_id").alias("pos"), kind.alias("kind"),
        "pid", "ppid", ((F.col("event_id") * 37) % 65536).alias("exit_status"),
        F.col("ts_ns").alias("event_ns"), F.col("ts_ns").alias("observed_ns"),
        F.when(F.col("event_id") % 40 == 0, 0)
        .otherwise(F.col("ts_ns") - EPOCH_NS - (F.col("event_id") % 3) * 250)
        .cast("decimal(20,0)").alias("kernel_ns"),
        F.when((F.col("value") > 50) & (kind != "exit"), proc).alias("proc"), "event_id",
    )


SQL["v_notice"] = f"""
  SELECT host_id, event_id AS pos, pid, ppid, (event_id * 37) % 65536 AS exit_status, ts_ns AS event_ns,
         CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'exec' WHEN 'view' THEN 'exec'
              ELSE 'stop' END AS kind,
         CASE WHEN event_id % 40 = 0 THEN 0 ELSE ts_ns - {EPOCH_NS} - (event_id % 3) * 250 END AS kernel_ns,
         value > 50 AND event_type IN ('signup', 'click', 'view') AS readable, event_type, event_id
  FROM v_event"""


def anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock anchor was read at every 500th event of the stream."""
    e = events(spark, sf_dir).where("event_id % 500 = 0")
    return e.select(
        "host_id", F.col("event_id").alias("pos"),
        (F.col("ts_ns") - EPOCH_NS).cast("decimal(20,0)").alias("monotonic_ns"),
        F.col("ts_ns").alias("wall_ns"), F.lit(True).alias("valid"),
    )


SQL["v_anchor"] = f"""
  SELECT host_id, event_id AS pos, ts_ns - {EPOCH_NS} AS monotonic_ns, ts_ns AS wall_ns
  FROM v_event WHERE event_id % 500 = 0"""


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two customer-shaped process tables that differ in members and commands, and exit codes.

    The remainders decide who is present in which table; both cover all customers.
    """
    base = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("host_id"),
        F.concat_ws(":", F.col("c_custkey").cast("string"), "c_nationkey").alias("process_id"),
        F.col("c_custkey").alias("pid"), F.lit(0).cast("long").alias("ppid"),
        F.col("c_mktsegment").alias("command"), F.col("c_name").alias("exe"),
        *[F.lit(None).cast("string").alias(c) for c in ("cwd", "user", "uid", "tty", "session")],
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 1_000_000_007).alias("started_ns"),
        (F.col("c_custkey") * 1_000_000_007 + 500_000_000).alias("captured_ns"),
    )
    previous = base.where("pid % 7 <> 0")
    following = base.where("pid % 5 <> 0").withColumn("command", F.when(
        F.col("pid") % 11 == 0, F.concat("command", F.lit(" v2"))).otherwise(F.col("command")))
    codes = base.where("pid % 3 = 0").select(
        "host_id", "pid", F.col("pid").alias("pos"), (F.col("pid") % 13).alias("exit_code"))
    return previous, following, codes


PAIR_OBSERVED_NS = 3_000_000_000_000
SQL["v_pair"] = """
  SELECT CAST(c_nationkey AS BIGINT) AS host_id, c_custkey || ':' || c_nationkey AS process_id, c_custkey AS pid,
         c_mktsegment AS command, c_name AS exe,
         CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 1000000007 END AS started_ns,
         c_custkey * 1000000007 + 500000000 AS captured_ns
  FROM customer"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as one host's process tree."""
    return table(spark, sf_dir, "customer").select(
        F.lit(0).cast("long").alias("host_id"), F.col("c_custkey").alias("pid"),
        F.expr("CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE c_custkey div 3 END").alias("ppid"),
        F.col("c_custkey").cast("string").alias("process_id"), F.col("c_mktsegment").alias("command"),
        F.col("c_name").alias("exe"), F.lit(None).cast("string").alias("user"),
    )


SQL["v_tree"] = """
  SELECT c_custkey AS pid, CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE c_custkey // 3 END AS ppid FROM customer"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tokens of all orders; some are not numbers."""
    boot = ns("o_orderdate")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 50 == 0, "invalid").otherwise((key * 37).cast("string")).alias("token"),
        boot.alias("booted_ns"),
        (boot + key * 370_000_000 + (key % 5 - 3) * 1_000_000_000).alias("captured_ns"),
        F.concat(key.cast("string"), F.lit("."), F.lpad((key % 100).cast("string"), 2, "0"),
                 F.lit(" "), key.cast("string")).alias("uptime"),
    )


SQL["v_ticks"] = """
  SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'invalid' ELSE CAST(o_orderkey * 37 AS VARCHAR) END AS token,
         epoch_ns(o_orderdate) AS booted_ns,
         epoch_ns(o_orderdate) + o_orderkey * 370000000 + (o_orderkey % 5 - 3) * 1000000000 AS captured_ns
  FROM orders"""


def filetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File times of all events, some out of bounds."""
    e = events(spark, sf_dir)
    units = F.expr("ts_ns div 100") + 116_444_736_000_000_000
    kind = F.col("event_id") % 4
    return e.select("event_id", F.col("ts_ns").alias("observed_ns"), (
        F.when(kind == 1, units + 120 * 10_000_000).when(kind == 2, units - 25 * 3600 * 10_000_000)
        .when(kind == 3, 0).otherwise(units)).cast("long").alias("filetime"))


SQL["v_filetime"] = """
  SELECT event_id, ts_ns AS observed_ns, CASE event_id % 4 WHEN 1 THEN ts_ns // 100 + 116444736000000000 + 1200000000
         WHEN 2 THEN ts_ns // 100 + 116444736000000000 - 900000000000 WHEN 3 THEN 0
         ELSE ts_ns // 100 + 116444736000000000 END AS filetime FROM v_event"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one CPU's records with a wrapping sequence; every 97th was lost."""
    return events(spark, sf_dir).where("event_id % 97 <> 0").select(
        F.lit(0).cast("long").alias("host_id"), F.col("event_id").alias("pos"),
        F.lit(0).cast("long").alias("cpu"), F.col("event_type").alias("kind"),
        ((F.col("event_id") + 4_294_962_296) % 4_294_967_296).alias("seq"),
        (F.col("event_id") % 3 != 0).alias("relevant"), F.col("ts_ns").alias("observed_ns"),
    )


SQL["v_seq"] = """
  SELECT event_id AS pos, (event_id + 4294962296) % 4294967296 AS seq, ts_ns AS observed_ns
  FROM v_event WHERE event_id % 97 <> 0"""


def endpoint_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered per run of the collector on a host (hosts below 5) or there per kind; some zeros, some lost."""
    from lifeline.operators.ordered import ordinals

    e = events(spark, sf_dir).withColumn("client", F.expr("CAST(event_id div 3000 AS string)")).withColumn(
        "global_sequence", F.col("host_id") < 5).withColumn(
        "_cursor", F.when(F.col("global_sequence"), "").otherwise(F.col("event_type")))
    numbered = ordinals(e, ["host_id", "client", "_cursor"], "event_id", "_n")
    return numbered.where("event_id % 97 <> 0").select(
        "host_id", "client", F.col("event_id").alias("pos"), F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 89 == 0, 0).otherwise(F.col("_n") + 1).cast("long").alias("seq"),
        "global_sequence", F.col("ts_ns").alias("event_ns"), F.col("ts_ns").alias("observed_ns"),
    )


SQL["v_seq_kind"] = """
  SELECT * FROM (SELECT host_id, event_id AS pos, CASE WHEN host_id < 5 THEN '' ELSE event_type END AS cursor_key,
         event_id // 3000 AS client, CASE WHEN event_id % 89 = 0 THEN 0 ELSE row_number() OVER (
           PARTITION BY host_id, event_id // 3000, CASE WHEN host_id < 5 THEN '' ELSE event_type END ORDER BY event_id) END AS seq,
         ts_ns AS observed_ns FROM v_event) WHERE pos % 97 <> 0"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss counter read at each event: a fiftieth of the host's events since the collector's start."""
    from lifeline.operators.ordered import ordinals

    runs = events(spark, sf_dir).withColumn("client", F.expr("CAST(event_id div 3000 AS string)"))
    return ordinals(runs, ["host_id", "client"], "event_id", "_n").select(
        "host_id", "client", F.col("event_id").alias("pos"),
        F.expr("(_n + 1) div 50").alias("lost_total"), F.col("ts_ns").alias("observed_ns"),
        F.when(F.col("host_id") % 2 == 0, "windows-etw").otherwise("macos-endpoint-security").alias("backend"),
    )


SQL["v_lost"] = """
  SELECT host_id, event_id AS pos, ts_ns AS observed_ns,
         CAST(event_id // 3000 AS VARCHAR) AS client,
         row_number() OVER (PARTITION BY host_id, event_id // 3000 ORDER BY event_id) // 50 AS lost_total,
         CASE WHEN host_id % 2 = 0 THEN 'windows-etw' ELSE 'macos-endpoint-security' END AS backend
  FROM v_event"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receive batches of a hundred events with quality flags."""
    return events(spark, sf_dir).groupBy(F.expr("event_id div 100").alias("batch_id")).agg(
        F.max("event_id").alias("pos"), F.min("event_id").alias("batch_pos"), F.max("ts_ns").alias("observed_ns")
    ).select(
        F.lit(0).cast("long").alias("host_id"), "batch_id", "pos", "batch_pos", "observed_ns",
        (F.col("batch_id") % 7 == 0).alias("truncated"), (F.col("batch_id") % 11 == 0).alias("overrun"),
        (F.col("batch_id") % 3 == 0).alias("malformed"), (F.col("batch_id") % 13 == 5).alias("receive_overflow"),
    )


SQL["v_batch"] = """
  SELECT event_id // 100 AS batch_id, min(event_id) AS pos, max(ts_ns) AS observed_ns FROM v_event GROUP BY 1"""


def aligned_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A provisional process of every event, and the same PIDs with stable IDs and shifted starts."""
    signup = events(spark, sf_dir).select(
        "host_id", F.col("event_id").alias("pid"), "event_id", "ts_ns")
    previous = signup.select(
        "host_id", "pid",
        F.concat_ws(":", F.lit("connector"), F.col("pid").cast("string"), F.col("ts_ns").cast("string")).alias("process_id"),
        F.col("ts_ns").alias("started_ns"))
    following = signup.select(
        "host_id", "pid",
        F.concat_ws(":", F.col("pid").cast("string"), F.col("event_id").cast("string")).alias("process_id"),
        (F.col("ts_ns") + (F.col("event_id") % 9 - 4) * 1_000_000_000).alias("started_ns"))
    return previous, following


SQL["v_signup"] = "SELECT host_id, event_id AS pid, event_id, ts_ns FROM v_event"


def uid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of UIDs 1000 to 1004 on each host, derived from the users that hold them."""
    uid = F.lit(1000) + F.col("user_id") % 7
    return events(spark, sf_dir).where("user_id % 7 < 5").select(
        "host_id", uid.cast("string").alias("uid"),
        F.concat_ws("-", F.lit("user"), (F.col("user_id") % 7).cast("string"), F.col("host_id").cast("string")).alias("user")
    ).distinct()


SQL["v_uid"] = """
  SELECT DISTINCT host_id, CAST(1000 + user_id % 7 AS VARCHAR) AS uid, 'user-' || (user_id % 7) || '-' || host_id AS "user"
  FROM v_event WHERE user_id % 7 < 5"""


def ps_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ps line for every part; some are too short."""
    key = F.col("p_partkey")
    text = key.cast("string")
    return table(spark, sf_dir, "part").select(
        F.when(key % 20 == 0, "x y").otherwise(F.concat(
            F.lit("  "), text, F.lit(" "), F.expr("p_partkey div 3").cast("string"), F.lit(" "), "p_brand",
            F.lit("  "), "p_name", F.lit(" "), "p_type")).alias("line"),
        F.lit(101).cast("long").alias("collector_pid"),
    )


def proc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one process per part, one row per file."""
    p = table(spark, sf_dir, "part")
    key, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = F.when(key % 4 == 0, F.concat("p_name", F.lit(") x("))).otherwise(F.col("p_name"))
    rest = F.when(key % 20 == 0, F.lit(" S 1 2")).otherwise(F.concat(
        F.lit(" S "), F.expr("p_partkey div 3").cast("string"), F.lit(" 9 "), (key % 6).cast("string"), F.lit(" "),
        (key % 3).cast("string"), F.repeat(F.lit(" 0"), F.lit(14)), F.lit(" "), (key * 11).cast("string")))
    cmdline = F.when(key % 6 == 0, "").otherwise(F.concat(
        "p_name", F.lit("\0\0"), "p_type", F.lit("\0\0")))
    status = F.when(key % 8 == 0, "Name:\tx").otherwise(F.concat(
        F.lit("Name:\tx\nUid:\t"), (key % 5).cast("string"), F.lit("\t0\t0\t0\nGid:\t7")))
    link = F.when(key % 2 == 0, F.concat(F.lit("/dev/pts/"), text)).otherwise(F.concat(F.lit("pipe:"), text))
    parts = {"stat": F.concat(text, F.lit(" ("), name, F.lit(")"), rest), "cmdline": cmdline,
             "status": status, "fd0": link, "exe": F.concat(F.lit(" /opt/"), "p_brand", F.lit(" "))}
    listed = F.array(*[F.struct(F.lit(k).alias("file"), v.alias("content")) for k, v in parts.items()])
    return p.select(
        (key % 10).alias("host_id"), F.lit(0).cast("long").alias("scan_id"), key.alias("pid"),
        F.lit(EPOCH_NS).alias("booted_ns"), (F.lit(EPOCH_NS) + 200_000_000_000).alias("captured_ns"),
        F.explode(listed).alias("_f"),
    ).select("host_id", "scan_id", "pid", "booted_ns", "captured_ns", "_f.file", "_f.content")


def native_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All suppliers as raw macOS and Windows process rows with missing fields."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    missing = lambda n, c: F.when(key % n != 0, c).otherwise("")
    name = F.concat(F.col("s_name"), F.lit("  --serve "))
    start = key * 1_000_000_007 + EPOCH_NS
    macos = s.select(
        (key - 3).alias("pid"), F.lit(1).cast("long").alias("ppid"), missing(2, name).alias("args"),
        missing(3, F.concat(F.lit("/usr/bin/"), "s_name")).alias("path"), F.col("s_name").alias("comm"),
        F.col("s_nationkey").cast("string").alias("uid"), (key % 4 - 1).alias("tdev"), start.alias("started_ns"))
    windows = s.select(
        key.alias("pid"), F.lit(4).cast("long").alias("ppid"), F.concat("s_name", F.lit(".exe")).alias("image"),
        missing(2, name).alias("detail_command"), missing(3, F.concat(F.lit("C:\\"), "s_name")).alias("detail_exe"),
        F.col("s_nationkey").cast("string").alias("uid"), F.when(key % 5 != 0, start).alias("started_ns"))
    return macos, windows


def raw_linux(spark: SparkSession, sf_dir: str, hosts: str = "user_id % 3 = 0", pace: int = 1) -> DataFrame:
    """Linux records; of a mixed fleet a third of the users', else of all."""
    e = events(spark, sf_dir, pace).where(hosts)
    what = F.when(F.col("event_type") == "signup", 0x00000001).when(
        F.col("event_type").isin("click", "view"), 0x00000002).when(
        F.col("event_type") == "purchase", 0x80000000).otherwise(0x00000004)
    return e.select(
        "host_id", F.col("event_id").alias("pos"), (F.col("event_id") % 4).alias("cpu"), F.col("event_id").alias("seq"),
        what.cast("long").alias("what"), F.col("pid").alias("process_tgid"), F.col("ppid").alias("parent_tgid"),
        (F.col("pid") + F.when(F.col("event_id") % 6 == 0, 1).otherwise(0)).alias("process_pid"),
        ((F.col("event_id") * 37) % 65536).alias("exit_status"),
        (F.col("ts_ns") - EPOCH_NS).cast("decimal(20,0)").alias("kernel_ns"), F.col("ts_ns").alias("observed_ns"),
        F.col("ts_ns").alias("event_ns"),
    )


def raw_windows(spark: SparkSession, sf_dir: str, pace: int = 1) -> DataFrame:
    e = events(spark, sf_dir, pace).where("user_id % 3 = 1")
    i = F.col("event_id")
    return e.select(
        "host_id", i.alias("pos"), F.when(i % 10 == 0, "other").otherwise("process").alias("provider"),
        (i % 3 + 1).alias("opcode"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, 0).otherwise(F.col("pid")).cast("long").alias("property_pid"),
        F.when(i % 2 == 0, F.col("pid") + 100000).alias("payload_pid"),
        F.when(i % 7 == 0, 0).otherwise(F.col("pid") + 200000).cast("long").alias("header_pid"),
        F.when(i % 4 == 0, F.col("ppid")).alias("property_parent"),
        F.when(i % 2 == 0, F.col("ppid") + 100000).alias("payload_parent"),
        F.when(i % 8 < 4, i % 300).alias("property_status"), F.when(i % 2 == 0, i % 7).alias("payload_status"),
        (F.expr("ts_ns div 100") + 116_444_736_000_000_000).alias("filetime"), F.col("ts_ns").alias("observed_ns"),
    )


def raw_macos(spark: SparkSession, sf_dir: str, pace: int = 1) -> DataFrame:
    e = events(spark, sf_dir, pace).where("user_id % 3 = 2")
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "fork").when(
        F.col("event_type").isin("click", "view"), "exec").when(F.col("event_type") == "error", "other").otherwise("exit")
    return e.select(
        "host_id", i.alias("pos"), (i % 5 + 1).alias("message_version"), kind.alias("kind"),
        (F.col("pid") * F.when(i % 20 == 0, 0).otherwise(1)).alias("pid"), "ppid",
        (F.lit(1000) + F.col("user_id") % 7).cast("string").alias("uid"),
        F.concat(F.lit("/dev/tty"), (i % 3).cast("string")).alias("tty"), (i % 9).cast("string").alias("session"),
        (i % 11).alias("pid_version"), F.when(i % 4 == 0, 0).otherwise(F.col("ts_ns") - 5).cast("long").alias("started_ns"),
        F.col("ts_ns").alias("event_ns"), F.col("ts_ns").alias("observed_ns"),
        F.concat(F.lit("/bin/"), "event_type").alias("exe"),
        F.array(F.col("event_type"), F.lit("-x"), i.cast("string")).alias("args"), F.lit("/home").alias("cwd"),
        ((i * 37) % 65536).alias("exit_status"), i.alias("seq"), (i * 2).alias("global_seq"),
    )


def resync_scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The daily scans as reconciliation scans among the notices (positions doubled)."""
    e = events(spark, sf_dir)
    days = e.groupBy("scan_id").agg((F.max("event_id") * 2 + 1).alias("pos"))
    times = e.select("host_id", "scan_id").distinct().join(days, ["scan_id"]).withColumn(
        "observed_ns", (F.col("scan_id") + 1) * DAY_NS + EPOCH_NS)
    rows = scan(spark, sf_dir).join(times, ["host_id", "scan_id"]).withColumn("family", F.lit("linux"))
    return rows, times.select("host_id", "pos", "observed_ns")


def resync_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily scans as attempts among the notices (positions doubled); some fail."""
    days = events(spark, sf_dir).groupBy("scan_id").agg((F.max("event_id") * 2 + 1).alias("pos"))
    return manifest(spark, sf_dir, True).drop("pos").join(days, ["scan_id"])


def trace_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is the root of one trace, begun on its first day (scan positions times ten)."""
    first = events(spark, sf_dir).groupBy("user_id", "host_id", "pid", "ppid").agg(
        F.min("scan_id").alias("day"), F.min_by("event_type", "event_id").alias("name"))
    end = F.col("day") + 3 + F.col("user_id") % 7
    return first.select(
        F.col("user_id").alias("trace_id"), "host_id", F.col("pid").alias("root_pid"), F.col("ppid").alias("parent_pid"),
        F.array(F.concat(F.lit("/bin/"), "name"), F.lit("run")).alias("argv"),
        (F.col("day") * DAY_NS + EPOCH_NS).alias("started_ns"), (F.col("day") * 10 - 5).alias("started_pos"),
        ((end + 1) * DAY_NS + EPOCH_NS + 3_600_000_000_000).alias("exited_ns"), (F.col("user_id") % 5).alias("exit_code"),
        (end * 10 + 5).alias("exited_pos"), F.expr(f"{DAY_NS}L div 4").alias("poll_ns"),
        (F.col("user_id") % 4 * DAY_NS).alias("tail_ns"),
    )


def ended_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests; a sixth of them is cancelled, half of those without an exit."""
    stop = F.col("started_pos") + F.lit(32) + F.col("trace_id") % 4 * 10
    asked = trace_requests(spark, sf_dir)
    exits = {c: F.when(F.col("trace_id") % 12 != 5, F.col(c)) for c in ("exited_ns", "exit_code", "exited_pos")}
    halted = F.col("trace_id") % 6 == 5
    return asked.withColumns({
        **exits, "cancelled_pos": F.when(halted, stop),
        "cancelled_ns": F.when(halted, F.expr("started_ns") + (stop - F.col("started_pos")) * (DAY_NS // 10))})


LANDED_ROWS = 4_000_000  # rows that land at a time, unless more have one position
BINS = 10_000            # ranges of positions whose rows are counted


def landing_ranges(kept: DataFrame, parts: int, most: int) -> list[tuple[int, int]]:
    """Positions (``_at``) cut evenly into ``parts``, and those again that hold more than ``most`` rows, where their rows are."""
    low, high = kept.agg(F.min("_at"), F.max("_at")).first()
    low, high = low or 0, high or 0
    size = (high - low) // parts + 1
    step = size * parts // BINS + 1
    counted = kept.where("_at IS NOT NULL").groupBy(
        F.expr(f"(_at - {low}L) div {size}L").alias("part"), F.expr(f"(_at - {low}L) % {size}L div {step}L").alias("bin"))
    bins: dict[int, list] = {}
    for row in counted.agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("rows")).orderBy("part", "bin").collect():
        bins.setdefault(row["part"], []).append((row["first"], row["rows"]))
    ranges = []
    for part in range(parts):
        begin, held = low + part * size, 0
        for first, count in bins.get(part, []):
            if held and held + count > most:
                ranges.append((begin, first - 1))
                begin, held = first, 0
            held += count
        ranges.append((begin, low + (part + 1) * size - 1))
    return ranges


def landings(rows: DataFrame, pos: str, schema: T.StructType, parts: int = 3, most: int = LANDED_ROWS) -> Iterator[str]:
    """The folder to which rows of successive positions are appended, once after each part.

    A part may be many files, written by as many tasks; its rows are in no order.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "landed")
    kept = materialise(rows.selectExpr(*S.conforming(rows, schema), f"`{pos}` AS _at"), "landing")
    ranges = landing_ranges(kept, parts, most)
    if len(ranges) > parts:
        # Many parts: each row is put where its part alone is read. Rows often come in order; dealt anew, all tasks have some of every part.
        begins = ", ".join(f"{begin}L" for begin, _ in ranges)
        aside = new_folder(spark, "landing-parts")
        kept.repartition(F.xxhash64(*kept.columns)).withColumn("_part", F.expr(f"size(filter(array({begins}), x -> x <= _at))")).write.partitionBy("_part").parquet(aside)
        kept = spark.read.schema(T.StructType([*kept.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(aside)
    for i, (begin, end) in enumerate(ranges):
        part = kept.where(F.col("_part") == i + 1) if "_part" in kept.columns else kept.where(F.col("_at").between(begin, end))
        part.select(*schema.fieldNames()).write.mode("append").parquet(folder)
        yield folder


def landed(rows: DataFrame, pos: str, schema: T.StructType, files: int = 3) -> str:
    """The folder of ``landings`` after the last part."""
    for folder in landings(rows, pos, schema, files):
        pass
    return folder


def with_views(query: str, *names: str, **changed: str) -> str:
    """Prefix a query with the views it needs, in order; ``changed`` states some of them otherwise."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({changed.get(n, SQL[n])})" for n in names) + "\n" + query
