"""One query per operator over the test tables; ``oracles`` states each in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline import sinks
from lifeline.functions import clock, identity
from lifeline.functions.render import fallback_line, parent_executable
from lifeline.operators import diff, gaps, hierarchy, reconcile, replay, trace as tracing, views
from lifeline.plans import bindings as B
from lifeline.plans.watch import watch_native, watch_notices, watch_poll
from lifeline.session import materialise, new_folder
from lifeline.sources import dumps, fallback, notices, tables
from lifeline.streaming import audit, batches, engine, fallback as switching, recent as live_view, replay as replaying, scans as scanning, trace as live_tracing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def numbered_scans(manifest: DataFrame) -> DataFrame:
    """The numbered manifest, stored so that joins know its size."""
    return materialise(diff.scan_ordinals(manifest), "manifest")


def prepared(spark: SparkSession, sf: str, failures: bool = False) -> DataFrame:
    return diff.attach_manifest(B.scan(spark, sf), numbered_scans(B.manifest(spark, sf, failures)))


def scan_events(spark: SparkSession, sf: str, failures: bool = False) -> DataFrame:
    return diff.snapshot_diff(prepared(spark, sf, failures))


DIFF_COLUMNS = ("host_id", "kind", "event_ns", "observed_ns", "process_id", "pid", "ppid", "command",
                "exe", "uid", "duration_ms", "backend")


@query
def snapshot_diff(spark, sf):
    return scan_events(spark, sf).select(*DIFF_COLUMNS, "lookup_ordinal")


@query
def failed_scans(spark, sf):
    """Diff across failed scans, with a gap for each of them."""
    events = scan_events(spark, sf, True).drop("lookup_ordinal").unionByName(
        diff.failed_scan_gaps(B.manifest(spark, sf, True)))
    return events.select(*DIFF_COLUMNS, "message")


@query
def snapshot_pair_diff(spark, sf):
    previous, following, codes = B.pair(spark, sf)
    events = diff.pair_diff(previous, following, B.PAIR_OBSERVED_NS, exit_codes=diff.last_exit_codes(codes))
    return events.select("host_id", "kind", "event_ns", "process_id", "pid", "command", "exe",
                         "duration_ms", "exit_code")


@query
def started_or_stopped(spark, sf):
    """Members of only one of two tables."""
    previous, following, _ = B.pair(spark, sf)
    pick = lambda df, side: df.select("host_id", "process_id", "command", F.lit(side).alias("side"))
    return pick(diff.only_started(previous, following), "started").unionByName(
        pick(diff.only_stopped(previous, following), "stopped"))


@query
def first_observation(spark, sf):
    return diff.first_observation(prepared(spark, sf)).select(
        "host_id", "scan_id", "process_id", "run_start", "first_captured_ns", "first_started_ns", "in_next_scan")


def raw_scan(spark, sf):
    """Every event is one raw process row, so scans hold many rows per process."""
    return B.events(spark, sf).select(
        "host_id", "scan_id", F.concat_ws(":", F.col("pid").cast("string"), (F.col("event_id") % 3).cast("string")).alias("process_id"),
        "pid", "ppid", F.col("event_type").alias("command"),
        F.when(F.col("event_id") % 4 != 0, F.expr("ts_ns div 10000000000000")).alias("started_ns"),
        F.col("event_id").alias("row_pos"))


@query
def scan_dedup(spark, sf):
    return diff.dedup_scan(raw_scan(spark, sf)).select(
        "host_id", "scan_id", "process_id", "pid", "command", "started_ns", "row_pos")


@query
def one_per_pid(spark, sf):
    return diff.one_per_pid(diff.dedup_scan(raw_scan(spark, sf))).select(
        "host_id", "scan_id", "pid", "process_id", "command", "started_ns")


@query
def parent_lookup(spark, sf):
    scan = B.scan(spark, sf)
    found = hierarchy.with_parent(scan, scan, diff.SCAN_KEY)
    chain = F.when(F.col("parent").isNotNull(), F.array("parent"))
    return found.select("host_id", "scan_id", "pid", F.col("parent.process_id").alias("parent_id"),
                        F.col("parent.command").alias("parent_command"),
                        parent_executable(chain).alias("parent_exe"))


def chain_text(chain):
    return F.array_join(F.transform(chain, lambda p: p["pid"].cast("string")), "/")


@query
def ancestor_chain(spark, sf):
    scan = B.scan(spark, sf)
    chained = hierarchy.with_ancestors(scan.select("host_id", "scan_id", "pid", "ppid"), scan, diff.SCAN_KEY)
    return chained.select("host_id", "scan_id", "pid", F.size("parent_chain").alias("depth").cast("long"),
                          chain_text("parent_chain").alias("chain"))


@query
def tree_chain(spark, sf):
    tree = B.tree(spark, sf)
    chained = hierarchy.with_ancestors(tree.select("host_id", "pid", "ppid"), tree, ["host_id"])
    return chained.select("pid", F.size("parent_chain").alias("depth").cast("long"), chain_text("parent_chain").alias("chain"))


@query
def descendants(spark, sf):
    """Descendants of every process of the tree."""
    tree = B.tree(spark, sf)
    roots = tree.select(F.col("pid").alias("trace_id"), "host_id", "pid")
    return hierarchy.descendants(roots, tree, ["host_id"]).select(
        F.col("trace_id").alias("root"), "pid", F.col("level").cast("long").alias("level"))


@query
def process_ids(spark, sf):
    n = B.notice(spark, sf)
    token = F.when(F.col("pos") % 4 != 0, F.col("pos").cast("string")).otherwise("")
    chosen = F.coalesce(*[
        F.when(F.col("pos") % 5 == i, identity.provisional_id(p, F.col("pid"), F.col("kernel_ns")))
        for i, p in enumerate(identity.PROVISIONAL)
    ], identity.process_id(F.col("pid"), token))
    return n.select("pos", chosen.alias("process_id")).withColumn(
        "provisional", F.expr(identity.is_provisional("process_id")))


@query
def start_times(spark, sf):
    t = B.ticks(spark, sf)
    return t.select("o_orderkey",
                    clock.start_ns_of_ticks(F.col("token"), F.col("booted_ns"), F.col("captured_ns")).alias("started_ns"),
                    clock.boot_ns(F.col("uptime"), F.col("captured_ns")).alias("boot_ns"))


def exit_coded(n):
    return n.withColumn("exit_code", F.when(
        F.col("kind") == "exit", clock.exit_code_of_wait_status(F.col("exit_status"))))


@query
def kernel_times(spark, sf):
    return replay.wall_times(B.notice(spark, sf), B.anchor(spark, sf)).select("host_id", "pos", "event_ns")


@query
def file_times(spark, sf):
    return B.filetime(spark, sf).select("event_id", clock.event_ns_of_filetime(
        F.col("filetime"), F.col("observed_ns")).alias("event_ns"))


@query
def exit_codes(spark, sf):
    return B.notice(spark, sf).select("pos", clock.exit_code_of_wait_status(F.col("exit_status")).alias("exit_code"))


@query
def last_exit_codes(spark, sf):
    return diff.last_exit_codes(exit_coded(B.notice(spark, sf)))


@query
def ps_ingest(spark, sf):
    return dumps.ps_processes(B.ps_lines(spark, sf)).select("process_id", "pid", "ppid", "user", "exe", "command")


@query
def ps_quarantine(spark, sf):
    return dumps.ps_quarantine(B.ps_lines(spark, sf)).groupBy("line", "reject").agg(F.count(F.lit(1)).alias("lines"))


@query
def proc_text_ingest(spark, sf):
    return dumps.proc_processes(B.proc_files(spark, sf)).select(
        "host_id", "pid", "process_id", "ppid", "command", "exe", "uid", "tty", "session", "started_ns")


@query
def platform_defaults(spark, sf):
    macos, windows = B.native_tables(spark, sf)
    both = tables.unify(
        tables.macos_processes(macos).withColumn("platform", F.lit("macos")),
        tables.windows_processes(windows).withColumn("platform", F.lit("windows")))
    return both.select("platform", "process_id", "pid", "ppid", "command", "exe", "tty", "uid", "started_ns")


NOTICE_COLUMNS = ("host_id", "family", "pos", "kind", "pid", "ppid", "exit_code", "event_ns")


@query
def linux_records(spark, sf):
    return notices.linux_records(B.raw_linux(spark, sf, "true")).select(
        "pos", "cpu", "seq", "kind", "relevant", F.when(F.col("relevant"), F.col("pid")).alias("pid"),
        F.when(F.col("relevant"), F.col("ppid")).alias("ppid"),
        F.when(F.col("relevant"), F.col("exit_code")).alias("exit_code"))


def all_notices(spark, sf, pace=1):
    return notices.unify_notices(
        notices.linux_notices(notices.linux_records(B.raw_linux(spark, sf, pace=pace))),
        notices.windows_notices(B.raw_windows(spark, sf, pace)),
        notices.macos_notices(tables.resolve_users(
            notices.macos_records(B.raw_macos(spark, sf, pace)), B.uid_names(spark, sf))))


@query
def notice_normalise(spark, sf):
    """Three families in one table, with the ID each notice gives its process."""
    rows = replay.candidates(all_notices(spark, sf))
    return rows.select("host_id", "family", "pos", "kind", "pid", "event_ns", "exit_code", "solid",
                       *[F.col(f"cand.{c}").alias(c) for c in
                         ("process_id", "ppid", "command", "cwd", "user", "tty", "started_ns")])


@query
def mixed_replay(spark, sf):
    """Replay of all three families together."""
    return mixed_columns(replay.lifecycle_events(replay.replay(all_notices(spark, sf))))


@query
def crowded_replay(spark, sf):
    """The same notices within two minutes: notices of a PID follow each other within about two seconds."""
    return mixed_columns(replay.lifecycle_events(replay.replay(all_notices(spark, sf, 20_000))))


def mixed_columns(events):
    return events.select("host_id", F.col("order_key.pos").alias("pos"), F.col("order_key.sub").cast("long").alias("sub"),
                         "kind", "process_id", "pid", "ppid", "command", "event_ns", "duration_ms", "exit_code", "backend")


@query
def user_names(spark, sf):
    return tables.resolve_users(B.scan(spark, sf), B.uid_names(spark, sf)).select("host_id", "scan_id", "pid", "uid", "user")


GAP_COLUMNS = ("host_id", "event_ns", "backend", "message")


def positioned(events):
    return events.select(F.col("order_key.pos").alias("pos"), F.col("order_key.sub").cast("long").alias("sub"), *GAP_COLUMNS)


@query
def sequence_gaps(spark, sf):
    return positioned(gaps.sequence_gaps(B.sequences(spark, sf)))


@query
def endpoint_gaps(spark, sf):
    return positioned(gaps.endpoint_gaps(B.endpoint_sequences(spark, sf)))


@query
def lost_counters(spark, sf):
    return positioned(gaps.lost_gaps(B.losses(spark, sf)))


@query
def completeness(spark, sf):
    return gaps.completeness_summary(B.losses(spark, sf))


@query
def batch_quality(spark, sf):
    return positioned(gaps.batch_gaps(B.batches(spark, sf)))


@query
def resync_failures(spark, sf):
    """Failed scans of hosts whose sources are native."""
    native = F.element_at(F.array(*[F.lit(b) for b in (S.LINUX_CONNECTOR, S.WINDOWS_ETW, S.MACOS_ENDPOINT)]),
                          (F.col("host_id") % 3 + 1).cast("int"))
    return positioned(gaps.resync_gaps(B.manifest(spark, sf, True).withColumn("backend", native)))


REPLAY_COLUMNS = ("kind", "process_id", "pid", "ppid", "command", "exe", "event_ns", "duration_ms", "exit_code")


def replayed(spark, sf):
    return replay.replay(exit_coded(B.notice(spark, sf)))


def replay_columns(events):
    return events.select("host_id", F.col("order_key.pos").alias("pos"),
                         F.col("order_key.sub").cast("long").alias("sub"), *REPLAY_COLUMNS)


@query
def replay_events(spark, sf):
    return replay_columns(replay.lifecycle_events(replayed(spark, sf)))


@query
def lifetimes(spark, sf):
    return replay.process_lifetimes(replayed(spark, sf))


@query
def process_versions(spark, sf):
    return replay.process_versions(replayed(spark, sf)).select(
        "host_id", "pid", "valid_from_pos", "valid_to_pos", "process_id", "command", "started_ns")


@query
def temporal_parent(spark, sf):
    states = materialise(replayed(spark, sf), "states")
    events = replay.lifecycle_events(states).withColumn("pos", F.col("order_key.pos"))
    return replay.temporal_parents(events, states).select(
        "host_id", "pos", F.col("order_key.sub").cast("long").alias("sub"), "kind", "pid",
        F.col("parent.process_id").alias("parent_id"), F.col("parent.command").alias("parent_command"))


@query
def temporal_chain(spark, sf):
    states = materialise(replayed(spark, sf), "states")
    events = replay.lifecycle_events(states).withColumn("pos", F.col("order_key.pos")).drop("parent_chain")
    return replay.temporal_ancestors(events, states).select(
        "host_id", "pos", F.col("order_key.sub").cast("long").alias("sub"), "kind", "pid",
        F.array_join(F.transform("parent_chain", lambda p: p["process_id"]), "/").alias("chain"))


@query
def align_ids(spark, sf):
    previous, following = B.aligned_pairs(spark, sf)
    return reconcile.align_ids(previous, following).select("host_id", "pid", "process_id", "started_ns", "aligned")


@query
def reconcile_events(spark, sf):
    """Notices with the daily scans as reconciliation."""
    n = exit_coded(B.notice(spark, sf)).withColumn("pos", F.col("pos") * 2)
    rows, times = B.resync_scan(spark, sf)
    return replay_columns(replay.lifecycle_events(replay.replay(n, scans=rows, scan_times=times)))


@query
def due_scans(spark, sf):
    """An attempt at each event, in time sped up so far that many share an interval; some gaps force one."""
    attempts = B.events(spark, sf).select(
        "host_id", F.col("event_id").alias("scan_id"), (F.col("event_id") * 10).alias("pos"),
        F.expr("ts_ns div 20000").alias("observed_ns"))
    forced = gaps.lost_increases(B.losses(spark, sf)).where("lost_total % 5 = 0").select("host_id", (F.col("pos") * 10 + 5).alias("pos"))
    return reconcile.due_scans(attempts, 3_000_000_000, forced).select("host_id", "scan_id", "pos")


@query
def detail_asof(spark, sf):
    rows, _ = B.resync_scan(spark, sf)
    n = exit_coded(B.notice(spark, sf)).withColumn("pos", F.col("pos") * 2).withColumn(
        "proc", F.lit(None).cast(S.PROCESS))
    return replay.details_as_of(n, rows).select(
        "host_id", "pos", "pid", F.col("proc.command").alias("command"), F.col("proc.captured_ns").alias("captured_ns"))


def health(spark, sf):
    return B.events(spark, sf).groupBy("host_id").agg(
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.max("event_id").alias("last_pos")
    ).select(
        "host_id", F.when(F.col("host_id") % 4 == 3, S.POLL).when(F.col("host_id") % 4 == 2, S.LINUX_CONNECTOR)
        .otherwise(S.AUTO).alias("requested"),
        F.lit(S.LINUX_CONNECTOR).alias("backend"), (F.col("host_id") % 5 != 0).alias("available"),
        F.when(F.col("host_id") % 2 == 1, F.expr("last_pos div 2 * 2")).alias("failed_pos"),
        F.lit("socket closed").alias("error"), F.when(F.col("host_id") % 5 != 0, F.col("last_ns"))
        .otherwise(F.col("first_ns")).alias("observed_ns"))


@query
def source_fallback(spark, sf):
    """Native events until the source fails, scan differences afterwards."""
    n = exit_coded(B.notice(spark, sf)).withColumn("pos", F.col("pos") * 2)
    native = replay.lifecycle_events(replay.replay(n))
    e = B.events(spark, sf)
    days = e.groupBy("scan_id").agg((F.max("event_id") * 2 + 1).alias("pos"))
    manifest = B.manifest(spark, sf).drop("pos").join(days, ["scan_id"])
    numbered = numbered_scans(fallback.polled_attempts(manifest, health(spark, sf)))
    polled = diff.snapshot_diff(diff.attach_manifest(B.scan(spark, sf), numbered)).drop("lookup_ordinal")
    return fallback_columns(fallback.choose(native, polled, health(spark, sf)))


def fallback_columns(events):
    return events.select("host_id", F.col("order_key.pos").alias("pos"), "kind", "pid", "event_ns", "backend", "message")


@query
def fallback_log(spark, sf):
    return health(spark, sf).select("host_id", fallback_line(F.col("backend"), F.col("error")).alias("line"))


def trace_columns(events, *more):
    return events.select("trace_id", "host_id", F.col("order_key.pos").alias("pos"), "kind", "pid", "process_id",
                         "command", "event_ns", "duration_ms", "exit_code", "message", *more)


@query
def trace(spark, sf):
    numbered = numbered_scans(B.manifest(spark, sf))
    return trace_columns(tracing.trace(
        diff.attach_manifest(B.scan(spark, sf), numbered), numbered, B.trace_requests(spark, sf)))


@query
def stream_trace(spark, sf):
    """The same traces, followed while the scans arrive."""
    rows = live_tracing.request_rows(B.trace_requests(spark, sf)).unionByName(
        live_tracing.scan_rows(B.scan(spark, sf), B.manifest(spark, sf)))
    # A row may belong to many traces: smaller parts bound what a bucket gives out at a time.
    return trace_columns(streamed(spark, rows, "pos", live_tracing.INPUT, live_tracing.trace_events, most=500_000))


@query
def trace_chains(spark, sf):
    """Traces over scans of which some fail, with cancelled requests and the ancestors of every event."""
    manifest = B.manifest(spark, sf, True)
    numbered = numbered_scans(manifest)
    events = tracing.trace(diff.attach_manifest(B.scan(spark, sf), numbered), numbered, B.ended_requests(spark, sf),
                           manifest, chains=True)
    return trace_columns(events.withColumn("chain", chain_text("parent_chain")), "chain")


def chained_events(spark, sf):
    """Scan differences with the ancestors seen in the scan that shows the process."""
    ready = prepared(spark, sf)
    events = diff.snapshot_diff(ready).drop("parent_chain").withColumnRenamed("lookup_ordinal", "ordinal")
    return hierarchy.with_ancestors(events, ready, ["host_id", "ordinal"])


@query
def log_lines(spark, sf):
    """The four layouts of the readable log; commands carry control characters."""
    events = chained_events(spark, sf).withColumn(
        "command", F.concat("command", F.char(F.col("pid") % 159 + 1))).drop("ordinal")
    events = events.unionByName(diff.failed_scan_gaps(B.manifest(spark, sf, True)))
    both = sinks.log_lines(events).withColumnRenamed("line", "plain")
    for name, ppid, parent in (("with_ppid", True, False), ("with_parent", False, True), ("with_both", True, True)):
        both = sinks.log_lines(both, ppid, parent).withColumnRenamed("line", name)
    return both.select("host_id", "kind", "pid", "observed_ns", "plain", "with_ppid", "with_parent", "with_both")


@query
def long_names(spark, sf):
    """Log lines of processes whose parents' executables have names of up to 24 characters and beyond."""
    tree = B.tree(spark, sf).withColumn("exe", F.concat(
        F.lit("/opt/"), "exe", F.when(F.col("pid") % 3 != 0, F.concat(F.lit(" "), F.expr("left(command, pid % 12)"))).otherwise("")))
    found = hierarchy.with_parent(tree, tree, ["host_id"]).selectExpr(
        "*", f"'{S.START}' AS kind", "CAST(NULL AS bigint) AS event_ns", "array_compact(array(parent)) AS parent_chain")
    return sinks.log_lines(S.as_events(found), True, True).select("pid", "line")


@query
def diagnostics_log(spark, sf):
    return sinks.diagnostics(diff.failed_scan_gaps(B.manifest(spark, sf, True))).select("host_id", "line")


@query
def search(spark, sf):
    """Events naming user 1003 or a purchase, themselves or through an ancestor."""
    events = chained_events(spark, sf)
    either = views.matching(events, "PurChase").withColumn("needle", F.lit("purchase")).unionByName(
        views.matching(events, "\n1003\n").withColumn("needle", F.lit("user")))
    return either.select("needle", "host_id", "kind", "pid", "observed_ns")


@query
def recent_view(spark, sf):
    """A page of the latest events in each of the four orders."""
    view = materialise(views.recent(scan_events(spark, sf).drop("lookup_ordinal"), 500), "recent")
    pages = None
    for mode in (views.TIMELINE, views.DURATION, views.PID, views.COMMAND):
        part = views.page(view, mode, scroll=7, limit=40).withColumn("mode", F.lit(mode))
        pages = part if pages is None else pages.unionByName(part)
    return pages.select("mode", "host_id", "kind", "pid", "command", "observed_ns", "selected")


@query
def recent_hosts(spark, sf):
    events = scan_events(spark, sf).drop("lookup_ordinal")
    return views.recent_per_host(events, 50).select("host_id", "kind", "pid", "observed_ns")


@query
def recent_summary(spark, sf):
    events = scan_events(spark, sf).drop("lookup_ordinal")
    return views.summary(views.recent(events))


@query
def gap_counts(spark, sf):
    events = gaps.batch_gaps(B.batches(spark, sf)).unionByName(gaps.lost_gaps(B.losses(spark, sf))).unionByName(
        diff.failed_scan_gaps(B.manifest(spark, sf, True)))
    return gaps.gap_counts(events)


WATCHED = ("host_id", "kind", "pid", "process_id", "event_ns", "duration_ms", "backend", "message")


@query
def polled_watch(spark, sf):
    """Scans with failures, user names and chains, as one event table."""
    events = watch_poll(B.scan(spark, sf), B.manifest(spark, sf, True), B.uid_names(spark, sf))
    return events.select(F.col("order_key.pos").alias("pos"), *WATCHED, "user", chain_text("parent_chain").alias("chain"))


@query
def noticed_watch(spark, sf):
    """Notices with chains, and the gaps of sequences, batches and counters."""
    events = watch_notices(
        exit_coded(B.notice(spark, sf)), records=B.sequences(spark, sf), endpoint_records=B.endpoint_sequences(spark, sf),
        batches=B.batches(spark, sf), counters=B.losses(spark, sf))
    return events.select(F.col("order_key.pos").alias("pos"), *WATCHED, chain_text("parent_chain").alias("chain"))


@query
def native_watch(spark, sf):
    """Notices, rare readings of loss counters, and daily scans of which forced and due ones act; some fail.

    Columns pos, phase, order_pid and sub are the place of each event in its host's order.
    """
    n = exit_coded(B.notice(spark, sf)).withColumn("pos", F.col("pos") * 2)
    counters = B.losses(spark, sf).where("pos % 500 = 0").withColumn("pos", F.col("pos") * 2)
    attempts = B.resync_attempts(spark, sf).withColumn("backend", F.lit(S.LINUX_CONNECTOR))
    scans = B.scan(spark, sf).withColumn("family", F.lit("linux"))
    events = watch_native(n, scans, attempts, 3_000_000_000, counters=counters, interval_ns=3 * B.DAY_NS)
    return events.select(
        "host_id", F.col("order_key.pos").alias("pos"), *[F.col(f"order_key.{c}").cast("long").alias(a) for c, a in
                                                           (("phase", "phase"), ("pid", "order_pid"), ("sub", "sub"))],
        "kind", "process_id", "pid", "ppid", "command", "event_ns", "duration_ms", "exit_code", "message")


def streamed(spark, rows, pos, schema, make, files: int = 3, most: int = B.LANDED_ROWS):
    """All that a stream writes that takes one landed part after the other, a micro-batch each."""
    folder = new_folder(spark, "stream")
    for source in B.landings(rows, pos, schema, files, most):
        events = make(engine.landed(spark, source, schema))
        engine.start(events, folder).awaitTermination()
    return engine.output(spark, folder, events.schema)


@query
def stream_sequence_gaps(spark, sf):
    return positioned(streamed(spark, audit.sequence_rows(B.sequences(spark, sf)), "pos", audit.INPUT, audit.audit_events))


@query
def stream_endpoint_gaps(spark, sf):
    return positioned(streamed(spark, audit.endpoint_rows(B.endpoint_sequences(spark, sf)), "pos", audit.INPUT, audit.audit_events))


@query
def stream_lost(spark, sf):
    return positioned(streamed(spark, audit.lost_rows(B.losses(spark, sf)), "pos", audit.INPUT, audit.audit_events))


@query
def stream_replay(spark, sf):
    rows = replaying.notice_rows(exit_coded(B.notice(spark, sf)))
    return replay_columns(streamed(spark, rows, "pos", replaying.INPUT, replaying.replay_events))


@query
def stream_reconcile(spark, sf):
    """Notices with the daily scans as reconciliation, in one stream."""
    n = exit_coded(B.notice(spark, sf)).withColumn("pos", F.col("pos") * 2)
    rows = replaying.notice_rows(n).unionByName(replaying.scan_rows(*B.resync_scan(spark, sf)))
    return replay_columns(streamed(spark, rows, "pos", replaying.INPUT, replaying.replay_events))


@query
def stream_snapshot_diff(spark, sf):
    """Process rows and the rows that end each scan; some scans failed."""
    rows = B.scan(spark, sf).unionByName(B.manifest(spark, sf, True), allowMissingColumns=True)
    return streamed(spark, rows, "scan_id", scanning.INPUT, scanning.scan_events).select(*DIFF_COLUMNS, "message")


@query
def stream_log(spark, sf):
    """Readable lines that a stream of notices has written, a folder per micro-batch."""
    rows = replaying.notice_rows(exit_coded(B.notice(spark, sf)))
    folder = new_folder(spark, "stream")
    for source in B.landings(rows, "pos", replaying.INPUT, 2):
        events = replaying.replay_events(engine.landed(spark, source, replaying.INPUT))
        engine.start_batches(events, folder, sinks.log_batches(f"{folder}/log")).awaitTermination()
    return spark.read.text(f"{folder}/log").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("lines"))


@query
def stream_fallback(spark, sf):
    """Native notices until each host's source fails, scans afterwards, in one stream."""
    n = exit_coded(B.notice(spark, sf)).withColumn("pos", F.col("pos") * 2)
    manifest = B.resync_attempts(spark, sf).withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
    rows = switching.health_rows(health(spark, sf)).unionByName(switching.notice_rows(n)).unionByName(
        switching.scan_rows(B.scan(spark, sf), manifest))
    return fallback_columns(streamed(spark, rows, "pos", switching.INPUT, switching.fallback_events))


@query
def stream_recent(spark, sf):
    """The latest 2,048 events of a stream, of which each trigger passes on what enters."""
    events = S.conform(scan_events(spark, sf), S.LIFECYCLE_EVENT).withColumn("_pos", F.col("order_key.pos"))
    passed = streamed(spark, events, "_pos", S.LIFECYCLE_EVENT, live_view.entering)
    return live_view.view(passed).select("host_id", F.col("order_key.pos").alias("pos"), "kind", "pid", "command", "observed_ns")


@query
def stream_sink(spark, sf):
    """Replayed events read back from the sink that names its batches."""
    rows = replaying.notice_rows(exit_coded(B.notice(spark, sf)))
    folder = new_folder(spark, "sink")
    for source in B.landings(rows, "pos", replaying.INPUT):
        events = replaying.replay_events(engine.landed(spark, source, replaying.INPUT))
        batches.start(events, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return replay_columns(batches.written(spark, f"{folder}/rows", events.schema))
