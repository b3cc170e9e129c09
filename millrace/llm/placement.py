"""Consistent sharding by a look-up table that shards fill in turns of their preference."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards, and slots of the table: a prime, over a hundred for each shard, so loads differ by less than one slot's share.
SHARDS, SLOTS = 16, 2039
#: Slots of a table that is broadcast (16 bytes each).
MOST_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard of each slot.

    Each name permutes the slots: from an offset in steps of a skip, both hashes of
    the name; every step reaches all slots as their number is prime. Shards take
    turns, and in its turn a shard claims the first slot of its order that is free.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(names) or slots > MOST_SLOTS:
        raise ValueError(f"the number of slots must be a prime from the number of shards to {MOST_SLOTS}")
    offset = [_number(f"offset:{n}") % slots for n in names]
    skip = [_number(f"skip:{n}") % (slots - 1) + 1 if slots > 2 else 1 for n in names]
    at, owner, left = [0] * len(names), [-1] * slots, slots
    while True:
        for i in range(len(names)):
            slot = (offset[i] + at[i] * skip[i]) % slots
            while owner[slot] >= 0:
                at[i] += 1
                slot = (offset[i] + at[i] * skip[i]) % slots
            owner[slot], left = i, left - 1
            at[i] += 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's md5, modulo the table; null keys are the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, key_col: str = "doc_id", names: Sequence[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """(doc_id, slot, shard) for each row, by a broadcast of the table: no shuffle.

    A placement depends on the key alone: repeated keys go to one shard, null keys
    all to the shard of the empty text, and when a shard is added or removed few
    others move. To spread one hot key, give a key that names single rows. Other
    columns are ignored.
    """
    names = [f"shard-{i}" for i in range(SHARDS)] if names is None else list(names)
    owner = lookup_table(names, slots)
    table = docs.sparkSession.createDataFrame(list(enumerate(owner)), "slot long, shard long")
    keyed = docs.select(F.col(key_col), slot_of(F.col(key_col), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key_col, "slot", "shard")


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", names: Sequence[str] | None = None, slots: int = SLOTS, files_per_shard: int = 1) -> None:
    """Write all columns as Parquet, one folder `__shard=i` for each shard.

    A shard's rows are spread over files_per_shard tasks by slot and by row, so
    neither a large shard nor a hot key makes one task write everything.
    """
    names = [f"shard-{i}" for i in range(SHARDS)] if names is None else list(names)
    owner = lookup_table(names, slots)
    table = docs.sparkSession.createDataFrame(list(enumerate(owner)), "__slot long, __shard long")
    placed = docs.withColumn("__slot", slot_of(F.col(key_col), slots)).join(F.broadcast(table), "__slot").drop("__slot")
    part = F.monotonically_increasing_id() % files_per_shard
    placed.withColumn("__part", part).repartition(len(names) * files_per_shard, "__shard", "__part").drop("__part").write.partitionBy("__shard").parquet(path)


def moved_share(before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> float:
    """Share of slots whose shard, by name, differs between two sets of shards."""
    a, b = lookup_table(before, slots), lookup_table(after, slots)
    return sum(before[x] != after[y] for x, y in zip(a, b)) / slots
