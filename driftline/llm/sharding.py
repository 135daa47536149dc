"""Sharding: keys are placed by a lookup table that the shards fill in turn, each by its own permutation of the slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards and slots of the registered query. The slots are a prime, over a hundred for each shard.
SHARDS, SLOTS = 32, 4099
#: A table of more slots is not broadcast (it would be over a few MB).
MOST_SLOTS = 1 << 20


def number(text: Column) -> Column:
    """The first 32 bits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) that owns each slot.

    A shard prefers the slots in steps of its own from a place of its own, both from md5 of its name. In
    turn each shard claims its most preferred free slot, until none is free. Shares differ by one slot at
    most; a shard that goes leaves nearly all other slots as they are.
    """
    from hashlib import md5

    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names, one at least")
    if slots < max(3, len(shards)) or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime, no fewer than the shards and at most {MOST_SLOTS}")

    def hashed(text: str) -> int:
        return int(md5(text.encode()).hexdigest()[:8], 16)

    at = [hashed(f"{name}/offset") % slots for name in shards]
    step = [hashed(f"{name}/skip") % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        owner[at[shard]] = shard
    return owner


def assign_shards(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with slot (int) and shard (its place in ``shards``), by a broadcast of the table, ``slots`` rows at most.

    Equal keys go together, a null key goes where the empty text goes. No row is shuffled. An empty table
    gives an empty result; columns named slot or shard are replaced.
    """
    owners = ",".join(map(str, lookup_table(shards, slots)))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))
    keyed = df.drop("slot", "shard").withColumn("slot", F.pmod(number(F.coalesce(key, F.lit(""))), F.lit(slots)).cast("int"))
    return keyed.join(F.broadcast(table), "slot").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")
