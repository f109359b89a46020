"""Reconciliation helpers: identity alignment and the choice of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline.functions import identity as I
from lifeline.functions.clock import resync_interval_ns
from lifeline.operators.doubling import reached
from lifeline.operators.ordered import WIDTH, as_of, ordinals, running
from lifeline.session import materialise


def align_ids(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Previous rows, provisional connector IDs renamed to the table's stable IDs.

    A row is renamed if the next table's process of the same PID has an ID that
    is unknown so far and starts within two seconds. Both tables hold one process
    per (host, PID), so the equi-join pairs at most one row with one row and the
    time test is a residual; adds ``aligned``.
    """
    newcomers = following.join(
        previous.select("host_id", "process_id"), ["host_id", "process_id"], "left_anti"
    ).select(
        "host_id", "pid", F.col("process_id").alias("_id"), F.col("started_ns").alias("_started")
    )
    paired = previous.join(newcomers, ["host_id", "pid"], "left")
    match = I.same_generation("pid", "process_id", "started_ns", "pid", "_id", "_started")
    return paired.selectExpr(
        "*", f"startswith(process_id, '{I.CONNECTOR}:') AND {match} AS aligned"
    ).withColumn("process_id", F.expr("CASE WHEN aligned THEN _id ELSE process_id END")).drop("_id", "_started")


def due_scans(manifest: DataFrame, poll_ns: int, forced: DataFrame | None = None, width: int = WIDTH,
              interval_ns: int | None = None) -> DataFrame:
    """Scan attempts that act as reconciliation: a timer that every one of them re-arms.

    A host's first attempt acts, and so does the first one after each forcing position
    (``forced``: host_id, pos of gaps). After any of these the next one acts that comes
    an interval or more later. Which those are follows attempt by attempt; here every
    attempt names its successor, and the chains from the forced ones are followed by
    doubling. ``interval_ns`` replaces the interval that follows from the poll. Time does not run backwards: an attempt with an earlier clock counts as
    simultaneous with the latest before it.
    """
    host = ["host_id"]
    interval = resync_interval_ns(F.lit(poll_ns).cast("long")) if interval_ns is None else F.lit(interval_ns).cast("long")
    attempts = running(ordinals(manifest, host, "pos", "_n", width), host, "_n", {"_clock": "observed_ns"}, width=width)
    attempts = materialise(attempts.withColumn("_until", F.col("_clock") + interval), "attempts")
    begins = attempts.where("_n = 0").select("host_id", "_n")
    if forced is not None:
        following = as_of(forced.selectExpr("host_id", "-pos AS _m").distinct(), attempts.selectExpr("host_id", "-pos AS _m", "_n"),
                          host, "_m", "struct(_n)", "_f", at_same_pos=False, dense=True, width=width)
        begins = begins.unionByName(following.where("_f IS NOT NULL").selectExpr("host_id", "_f._n AS _n")).distinct()
    begins = materialise(begins, "begins")
    # A forced attempt re-arms the timer too, so no chain goes past the next one.
    marked = attempts.join(begins.withColumn("_begins", F.lit(True)), [*host, "_n"], "left")
    marked = materialise(running(marked, host, "_n", {"_from": "CASE WHEN _begins THEN _n END"}, width=width).select(
        "host_id", "_n", "_from", "_clock", "_until"), "attempts")
    later = as_of(marked.selectExpr("host_id", "_n", "_from", "-_until AS _m"),
                  marked.selectExpr("host_id", "-_clock AS _m", "struct(-_n AS n, _from AS begun) AS _j"),
                  host, "_m", "_j", "_f", dense=True, width=width)
    jumps = later.selectExpr("host_id", "_n", "CASE WHEN _f.begun = _from THEN -_f.n END AS _to")
    acting = reached(begins, jumps, host, "_n", "_to")
    return attempts.join(acting, [*host, "_n"]).select(*manifest.columns)
