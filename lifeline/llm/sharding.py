"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size:
slot ``(offset + j * skip) mod size`` comes j-th. Shards take turns; each claims the
first slot of its order that is still free, until the table is full. Shares differ by
at most one slot, and a shard that leaves frees little more than its own slots. A
document hashes to a slot, and the broadcast table names the shard.

The table has ``size`` rows, a parameter that does not grow with the documents; it is
filled once by a short loop while the plan is made and broadcast (16 bytes a row, at
most ``MOST_SLOTS`` rows, checked). Placement itself is DataFrame functions: no
shuffle, and a hot source spreads evenly since the key is the document.

Defined results: a null key hashes as the empty text; repeated keys share a shard; an
empty table gives an empty table; input columns named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeline.llm.columns import without

DIGITS = 15              # hexadecimal digits of MD5 used as a number
MOST_SLOTS = 1 << 21     # 32 MB broadcast


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def table_size(shards: int, slots_per_shard: int = 100) -> int:
    """Smallest prime with at least this many slots for each shard."""
    size = max(2, shards * slots_per_shard)
    while not is_prime(size):
        size += 1
    return size


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """Index of the shard of each slot."""
    if not shards or not is_prime(size) or size > MOST_SLOTS or len(set(shards)) < len(shards):
        raise ValueError("needs different shard names and a prime table size within bounds")
    offsets = [number(f"offset:{s}") % size for s in shards]
    skips = [number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    tried, table, free = [0] * len(shards), [-1] * size, size
    while free:
        for i in range(len(shards)):
            while table[slot := (offsets[i] + tried[i] * skips[i]) % size] >= 0:
                tried[i] += 1
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """Rows (slot, shard); the table travels as one literal text."""
    table = ",".join(map(str, fill_table(shards, size)))
    return spark.range(1).select(
        F.posexplode(F.split(F.lit(table), ",")).alias("slot", "shard")
    ).select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))


def place(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", size: int | None = None) -> DataFrame:
    """Add the table slot and the shard index of each row."""
    size = size or table_size(len(shards))
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") % F.lit(size)
    rows = without(docs, "slot", "shard")
    keep = [F.col(f"`{c}`") for c in rows.columns]
    # Within MOST_SLOTS, so the broadcast side is bounded whatever the input.
    table = F.broadcast(lookup_table(docs.sparkSession, shards, size))
    if key.lower() in ("slot", "shard"):
        raise ValueError("the key may not be named like an added column")
    return rows.select(*keep, slot.alias("slot")).join(table, "slot").select(*keep, "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write one folder per shard; each shard's rows are dealt over several tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns if c != "shard"]), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
