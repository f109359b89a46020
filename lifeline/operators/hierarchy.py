"""Parents, ancestor chains and descendant closures inside process tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline import schemas as S
from lifeline.session import materialise


def parent_index(processes: DataFrame, keys: list[str]) -> DataFrame:
    """Look-up side of parent joins: unique on the keys and ``_next`` (a PID)."""
    return processes.select(
        *keys, F.col("pid").alias("_next"), F.col("ppid").alias("_parent_ppid"),
        F.struct(*S.SUMMARY_COLUMNS).cast(S.SUMMARY).alias("_parent"),
    )


def with_parent(rows: DataFrame, processes: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the parent found by PID in the same table as ``parent`` (null if absent)."""
    return (
        rows.withColumn("_next", F.when(F.col("ppid") > 0, F.col("ppid")))
        .join(parent_index(processes, keys), [*keys, "_next"], "left")
        .withColumnRenamed("_parent", "parent").drop("_next", "_parent_ppid")
    )


def with_ancestors(rows: DataFrame, processes: DataFrame, keys: list[str]) -> DataFrame:
    """Attach ``parent_chain``, nearest first, from a table unique on keys and PID.

    The walk ends at a parent PID of zero or less, a missing parent or a PID
    already seen. Siblings share their walk: each distinct parent holds one chain, which
    is joined on at the end, cut off where the row's own PID comes up. Every round
    appends to each chain the chain of its last element, so chains double and a
    depth of n takes log2(n) rounds; in a cycle they end with their first repetition.
    """
    sought = rows.withColumn("_first", F.when((F.col("ppid") > 0) & (F.col("ppid") != F.col("pid")), F.col("ppid")))
    asked = sought.where("_first IS NOT NULL").select(*keys, F.col("_first").alias("_next"))
    passed = processes.where("ppid > 0").select(*keys, F.col("ppid").alias("_next"))
    climbing = materialise(asked.unionByName(passed).distinct().join(parent_index(processes, keys), [*keys, "_next"]).select(
        *keys, F.col("_next").alias("_first"), F.array("_parent").alias("_chain"),
        F.when(F.col("_parent_ppid") > 0, F.col("_parent_ppid")).alias("_next")), "ancestors")
    while not climbing.where("_next IS NOT NULL").isEmpty():
        further = climbing.select(*keys, F.col("_first").alias("_next"), F.col("_chain").alias("_more"), F.col("_next").alias("_beyond"))
        longer = climbing.join(further, [*keys, "_next"], "left").withColumn(
            "_both", F.when(F.col("_more").isNull(), F.col("_chain")).otherwise(F.concat("_chain", "_more")))
        once = F.array_distinct("_both")
        climbing = materialise(longer.select(
            *keys, "_first", once.alias("_chain"), F.when(F.size(once) == F.size("_both"), F.col("_beyond")).alias("_next")), "ancestors")
    own = F.array_position(F.transform("_chain", lambda p: p["pid"]), F.col("pid"))
    chain = F.when(own > 0, F.slice("_chain", 1, (own - 1).cast("int"))).otherwise(F.col("_chain"))
    return sought.join(climbing.drop("_next"), [*keys, "_first"], "left").select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.coalesce(chain, F.array().cast(S.T.ArrayType(S.SUMMARY))).alias("parent_chain"))


def descendants(roots: DataFrame, processes: DataFrame, keys: list[str], label: str = "trace_id") -> DataFrame:
    """Every process reachable downwards from each label's roots, roots included, with its ``level``.

    ``roots`` has the label, the keys and ``pid``; ``processes`` is unique on the
    keys and PID. Round k knows the ancestor 2^k levels above every process and adds what
    lies that far below anything found, so levels double. A process has one
    parent, so it is reached once, except for roots below roots or in a cycle: the
    least level counts.
    """
    member = [label, *keys, "pid"]
    tree = materialise(processes.select(*keys, "pid", "ppid"), "tree")
    found = materialise(
        roots.select(*member).join(tree.select(*keys, "pid"), [*keys, "pid"], "left_semi")
        .dropDuplicates(member).withColumn("level", F.lit(0)), "descendants")
    above, distance = tree.select(*keys, F.col("pid").alias("_child"), F.col("ppid").alias("pid")), 1
    while True:
        below = above.join(found, [*keys, "pid"]).groupBy(label, *keys, F.col("_child").alias("pid")).agg(
            (F.min("level") + distance).alias("level"))
        fresh = materialise(below.join(found.select(*member), member, "left_anti").select(*member, "level"), "descendants")
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
        further = above.select(*keys, F.col("_child").alias("pid"), F.col("pid").alias("_beyond"))
        above = materialise(above.join(further, [*keys, "pid"]).select(*keys, "_child", F.col("_beyond").alias("pid")), "above")
        distance *= 2


def surviving_pids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ascending distinct PIDs per group, also as the text ``[1 2 3]``."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("pid")).alias("pids")).withColumn(
        "pids_text", F.concat(F.lit("["), F.array_join(F.col("pids").cast("array<string>"), " "), F.lit("]"))
    )
