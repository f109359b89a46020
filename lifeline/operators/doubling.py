"""Closure along successor functions in logarithmic rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline.session import materialise


def reached(starts: DataFrame, jumps: DataFrame, keys: Sequence[str], at: str, to: str) -> DataFrame:
    """All places (``keys``, ``at``) that are starts or follow from one by jumps.

    ``jumps`` gives at most one ``to`` per place, without cycles. Every round doubles
    the jumps' length and takes all places one jump away, so a chain of n places
    needs log2(n) rounds; each round's tables are written, so lineage stays short.
    """
    place = [*keys, at]
    found = materialise(starts.select(*place).distinct(), "reached")
    jumps = materialise(jumps.where(F.col(to).isNotNull()).select(*place, to), "jumps")
    while not jumps.isEmpty():
        ahead = found.join(jumps, place).select(*keys, F.col(to).alias(at))
        found = materialise(found.unionByName(ahead).distinct(), "reached")
        following = jumps.select(*keys, F.col(at).alias(to), F.col(to).alias("_beyond"))
        jumps = materialise(jumps.join(following, [*keys, to]).select(*place, F.col("_beyond").alias(to)), "jumps")
    return found
