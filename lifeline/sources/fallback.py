"""Choice between a host's native source and its polled scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline import schemas as S


def polled_attempts(manifest: DataFrame, health: DataFrame) -> DataFrame:
    """Scan attempts that polling makes itself: those after the failure, or all of them.

    Falling back starts a new polling watch, whose first table is a silent baseline.
    Number and diff these attempts only, so that no scan from before takes part.
    """
    h = health.select("host_id", "requested", "available", "failed_pos")
    auto = F.col("requested") == S.AUTO
    return manifest.join(h, ["host_id"]).where(
        (F.col("requested") == S.POLL) | (auto & ~F.col("available")) | (auto & (F.col("pos") > F.col("failed_pos")))
    ).select(*manifest.columns)


def choose(native: DataFrame, polled: DataFrame, health: DataFrame, collector: str = "collector") -> DataFrame:
    """Native events up to the first failure, polled events after it, and one gap.

    ``health`` has one row per host. ``auto`` falls back at the start if the native
    source is unavailable, or for good at its first failure; a named source never
    falls back. ``polled`` comes from ``polled_attempts``. Gap rows leave the
    observation time unset.
    """
    h = health.select(
        "host_id", "requested", "available", "failed_pos",
        F.col("backend").alias("_backend"), F.col("error").alias("_error"), F.col("observed_ns").alias("_at"),
    )
    auto = F.col("requested") == S.AUTO
    pos = F.col("order_key.pos")
    failed = auto & F.col("available") & F.col("failed_pos").isNotNull()
    kept = native.join(h, ["host_id"]).where(
        F.col("available") & (F.col("requested") != S.POLL)
        & (F.col("failed_pos").isNull() | (pos <= F.col("failed_pos")))
    ).select(*native.columns)
    after = polled.join(h, ["host_id"]).where(
        (F.col("requested") == S.POLL) | (auto & ~F.col("available")) | (failed & (pos > F.col("failed_pos")))
    ).select(*native.columns)
    gaps = h.where(failed | (auto & ~F.col("available")))
    unavailable = F.concat(
        F.lit("backend "), F.col("requested"), F.lit(f" was unavailable and {collector} started with {S.POLL}: "),
        F.coalesce("_error", F.lit("")))
    switched = F.concat(
        F.lit("backend "), F.col("_backend"), F.lit(f" failed and {collector} switched to {S.POLL}: "),
        F.coalesce("_error", F.lit("")))
    gap = S.as_events(gaps.withColumn("message", F.when(F.col("available"), switched).otherwise(unavailable)).selectExpr(
        "host_id", S.order_key("CASE WHEN available THEN failed_pos ELSE -1 END", 9) + " AS order_key",
        f"'{S.GAP}' AS kind", "_at AS event_ns",
        f"CASE WHEN available THEN _backend ELSE '{S.POLL}' END AS backend", "message",
    ))
    return kept.unionByName(after).unionByName(gap)
