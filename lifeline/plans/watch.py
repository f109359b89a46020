"""Whole watches: from landed input to one attributed event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from lifeline import schemas as S
from lifeline.operators import diff, gaps, reconcile, replay
from lifeline.operators.hierarchy import with_ancestors
from lifeline.session import materialise
from lifeline.sources import tables


def watch_poll(scans: DataFrame, manifest: DataFrame, names: DataFrame | None = None,
               backend: str = S.POLL, chains: bool = True) -> DataFrame:
    """Events between process tables with their ancestors, and a gap per failed scan.

    ``scans`` is unique per process (see ``diff.dedup_scan``) with one process per
    PID wherever chains are wanted; ``names`` resolves UIDs to users.
    """
    numbered = materialise(diff.scan_ordinals(manifest), "manifest")
    ready = diff.attach_manifest(tables.resolve_users(scans, names) if names is not None else scans, numbered)
    events = diff.snapshot_diff(ready, backend)
    if chains:
        index = diff.one_per_pid(ready.select("host_id", "ordinal", "started_ns", "ppid", *S.SUMMARY_COLUMNS),
                                 ["host_id", "ordinal"])
        events = with_ancestors(
            events.drop("parent_chain").withColumnRenamed("lookup_ordinal", "ordinal"), index, ["host_id", "ordinal"])
    return S.as_events(events).unionByName(diff.failed_scan_gaps(manifest, backend))


def watch_notices(
    notices: DataFrame, baseline: DataFrame | None = None, anchors: DataFrame | None = None,
    scans: DataFrame | None = None, scan_times: DataFrame | None = None,
    records: DataFrame | None = None, endpoint_records: DataFrame | None = None,
    batches: DataFrame | None = None, counters: DataFrame | None = None, chains: bool = True, **options,
) -> DataFrame:
    """Events of a notice stream with the ancestors of their moment, and all its gaps."""
    timed = notices if anchors is None else replay.wall_times(notices, anchors)
    states = materialise(replay.replay(timed, baseline, scans, scan_times, **options), "states")
    events = replay.lifecycle_events(states)
    if chains:
        events = S.as_events(replay.temporal_ancestors(
            events.drop("parent_chain").selectExpr("*", "order_key.pos AS pos"), states))
    audits = ((gaps.sequence_gaps, records), (gaps.endpoint_gaps, endpoint_records),
              (gaps.batch_gaps, batches), (gaps.lost_gaps, counters))
    found = [audit(rows) for audit, rows in audits if rows is not None]
    return reduce(DataFrame.unionByName, [events, *found])


def watch_native(
    notices: DataFrame, scans: DataFrame, attempts: DataFrame, poll_ns: int, baseline: DataFrame | None = None,
    records: DataFrame | None = None, endpoint_records: DataFrame | None = None, batches: DataFrame | None = None,
    counters: DataFrame | None = None, chains: bool = False, interval_ns: int | None = None,
) -> DataFrame:
    """A native source as a closed loop, in one order of positions.

    Missing or damaged records are gaps; each gap forces the next scan attempt
    (``attempts``: a manifest with ``backend``), which re-arms the reconciliation timer. A readable
    acting scan replaces the known processes, an unreadable one is a gap and leaves them.
    """
    audits = ((gaps.sequence_breaks, gaps.sequence_gaps, records), (gaps.endpoint_breaks, gaps.endpoint_gaps, endpoint_records),
              (gaps.damaged, gaps.batch_gaps, batches), (gaps.lost_increases, gaps.lost_gaps, counters))
    audits = [(breaks, events, rows) for breaks, events, rows in audits if rows is not None]
    forcing = [breaks(rows).select("host_id", "pos") for breaks, _, rows in audits]
    acting = materialise(reconcile.due_scans(
        attempts, poll_ns, reduce(DataFrame.unionByName, forcing) if forcing else None, interval_ns=interval_ns), "acting")
    good = acting.where("success")
    shown = scans.join(good.select("host_id", "scan_id", "pos", "observed_ns"), ["host_id", "scan_id"])
    found = [events(rows) for _, events, rows in audits]
    return reduce(DataFrame.unionByName, [
        watch_notices(notices, baseline, scans=shown, scan_times=good.select("host_id", "pos", "observed_ns"), chains=chains),
        gaps.resync_gaps(acting), *found])
