"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline.llm.store import Scratch


def connected(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every linked node; the root is the least node it reaches.

    ``links`` has long columns a and b. Each half round is one combined minimum and one
    join on the node, whose hot side adaptive execution can split; links never multiply.
    Rounds are written, so a lost executor costs a task; they end when the table's count
    and sum of hashes stay. Null ends and self links are ignored; repeated links count
    once; no links give an empty table.
    """
    edges = scratch.keep(_both_ways(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")), "links")
    state = _state(edges)
    for _ in range(most_rounds):
        large = _star(_mirrored(edges), larger=True)
        small = scratch.keep(_star(large, larger=False), "links")
        scratch.drop(edges)
        edges, before, state = small, state, _state(small)
        if state == before:
            roots = edges.select(F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                roots.select(F.col("root").alias("node"), "root"))
    raise RuntimeError("components did not settle")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: link larger neighbours to the least of a node's neighbours and itself.
    Small star (links point from the larger end): link smaller neighbours and itself to it."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = edges.join(least, edges["a"] == least["node"])
    if larger:                                           # repeats go with the small star's
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()
