"""Placement of rows on shards through a permutation-filled lookup table.

Each shard has its own order of preference over a table of prime size; in turns, each claims the first slot of its
order that is still free. Shards hold almost equal shares, and when one goes, few slots of the others change.
The table depends on the shard names and its size alone. It is broadcast (its size is checked), so placing a row
takes one hash and one lookup, in the row's own stage, however often a key occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 1_000_003
SLOTS_PER_SHARD = 100  # at least; keeps shares within about one percent of each other


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}|{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that holds each slot."""
    if not _is_prime(size) or size > MAX_TABLE_SIZE:
        raise ValueError(f"the table size must be a prime up to {MAX_TABLE_SIZE}, not {size}")
    if not shards or len(set(shards)) < len(shards) or len(shards) * SLOTS_PER_SHARD > size:
        raise ValueError(f"give 1 to {size // SLOTS_PER_SHARD} different shards for {size} slots")
    slot = [_number(name, "offset") % size for name in shards]
    step = [_number(name, "step") % (size - 1) + 1 for name in shards]
    table, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            while table[slot[shard]] >= 0:
                slot[shard] = (slot[shard] + step[shard]) % size
            table[slot[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) for all slots."""
    names, places = F.lit("\n".join(shards)), F.lit(",".join(map(str, fill_table(shards, size))))
    if any("\n" in name for name in shards):
        raise ValueError("shard names must not hold line breaks")
    return (
        spark.range(1)
        .select(F.split(names, "\n").alias("names"), F.posexplode(F.split(places, ",")).alias("slot", "place"))
        .select("slot", F.element_at("names", F.col("place").cast("int") + 1).alias("shard"))
    )


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key; all null keys share one."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """`df` with the columns slot and shard, replaced if they exist in any case.

    Equal keys go to one shard. Null keys have a shard like any key; repeated rows are kept; other columns pass
    through untouched, whatever their names; an empty table stays empty. Nothing is shuffled.
    """
    table = lookup_table(df.sparkSession, shards, size).withColumnsRenamed({"slot": "_table_slot", "shard": "_table_shard"})
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), slot_of(F.col(f"`{key}`"), size).alias("_slot"))
    placed = rows.join(F.broadcast(table), F.col("_slot") == F.col("_table_slot"))
    return placed.select(
        *[F.col(f"_row.`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")],
        F.col("_slot").alias("slot"), F.col("_table_shard").alias("shard"),
    )
