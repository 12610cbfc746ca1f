"""Point and batched lookups, positioned reads and hash-table statistics (OP-04, OP-23, OP-32, OP-39 to OP-44)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Status, StoreError
from ..functions.hashing import SEGMENTS, SLOTS, hash_slot, lock_segment

#: Fixed value: entries of a slot's overflow list.
LISTED = 256


def get(df: DataFrame, key: object, column: str = "key") -> DataFrame:
    """Rows of one key; the predicate reaches the scan."""
    return df.where(F.col(column) == F.lit(key))


def multi_get(df: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """Every probe with its record's columns, null where there is none, and a ``status``. df: unique keys.

    The join is left to the optimiser: small probe sets are broadcast by their measured size, larger ones are merged.
    Hot probes are reduced to one before the join and come back after it.
    """
    asked = probes.select(key).groupBy(key).agg(F.count("*").alias("_n"))
    found = asked.join(df.withColumn("_there", F.lit(True)), key, "left")
    status = F.when(F.col("_there"), Status.SUCC.name).otherwise(Status.NOT_FOUND.name)
    return found.withColumn("status", status).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_there", "_n", "_i")


def index(df: DataFrame, keys: list[str], slot: str = "slot") -> DataFrame:
    """The last slot of every key of a group (OP-39); with no group column, of every key (OP-40)."""
    return df.groupBy(*keys).agg(F.max(slot).alias(slot))


def positioned_read(addresses: DataFrame, values: DataFrame, at: list[str]) -> DataFrame:
    """Values at given places, say group and slot (OP-23); places without a value fall out."""
    return addresses.join(values, at)


def cached_read(addresses: DataFrame, values: DataFrame, at: list[str]) -> DataFrame:
    """The same for addresses that many ask for (OP-24): each is read once, and its value goes to all who asked."""
    asked = addresses.groupBy(*at).agg(F.count("*").alias("_n"))
    return positioned_read(asked, values, at).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n", "_i")


def hash_slots(df: DataFrame, key: str = "key_long", slots: int = SLOTS) -> DataFrame:
    """Each key's home slot and lock segment in a table of ``slots`` places (OP-58, OP-60)."""
    return df.withColumn("hash_slot", hash_slot(F.col(key), slots)).withColumn("segment", lock_segment(F.col("hash_slot"), slots))


def collisions(df: DataFrame, key: str = "key_long", slots: int = SLOTS) -> DataFrame:
    """How many slots hold how many keys (OP-42, OP-43): ``keys_in_slot, n_slots``."""
    filled = df.groupBy(hash_slot(F.col(key), slots).alias("s")).agg(F.count("*").alias("keys_in_slot"))
    return filled.groupBy("keys_in_slot").agg(F.count("*").alias("n_slots"))


def chained(df: DataFrame, key: str = "key_long", slots: int = SLOTS) -> DataFrame:
    """Slots with an overflow list for colliding keys (OP-43): ``hash_slot, keys_in_slot, listed, refused``.

    A lone key lies in its slot; with a second one all go to the list, which refuses what is over LISTED. A key written
    again takes its old place, so keys count once.
    """
    n = F.col("keys_in_slot")
    filled = df.select(key).distinct().groupBy(hash_slot(F.col(key), slots).alias("hash_slot")).agg(F.count("*").alias("keys_in_slot"))
    return filled.withColumns({"listed": F.when(n > 1, F.least(n, F.lit(LISTED).cast("long"))).otherwise(0), "refused": F.greatest(n - LISTED, F.lit(0).cast("long"))})


def probing(df: DataFrame, key: str = "key_long", slots: int = SLOTS, refuse: bool = True) -> DataFrame:
    """Linear probing that wraps around (OP-42): ``hash_slot, keys_in_slot, arriving, looks`` of each slot that is a key's home.

    arriving: keys of earlier homes that look at the slot too, as their own are taken; looks: looks that inserts take from
    this slot on up to the next home. Neither depends on the order of inserts, and the sum of ``looks`` is what all inserts
    take. A key written again counts once; more keys than slots raise StoreError, or if they are not to be refused, each key
    that finds no place behind its home passes the table's end once, and is counted in the slots it looks at from there on.

    Between homes the row of waiting keys gets one shorter a slot, so the keys that arrive are the running sum of keys less
    slots, above its least value so far. Running values are taken within a lock segment; a row a segment, SEGMENTS at most,
    goes to the driver to carry them on from segment to segment and from the last slot to the first.
    """
    home, n = F.col("hash_slot"), F.col("keys_in_slot")
    filled = df.select(key).distinct().groupBy(hash_slot(F.col(key), slots).cast("long").alias("hash_slot")).agg(F.count("*").alias("keys_in_slot"))
    so_far = Window.partitionBy("segment").orderBy("hash_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = filled.withColumn("segment", lock_segment(home, slots, min(SEGMENTS, slots)))
    level = level.withColumn("level", F.sum("keys_in_slot").over(so_far) - n - home).withColumn("least", F.min("level").over(so_far))
    level = level.withColumn("following", F.lead("hash_slot").over(Window.partitionBy("segment").orderBy("hash_slot")))
    ends = level.groupBy("segment").agg(F.sum("keys_in_slot").alias("n"), F.min("level").alias("least"), F.min("hash_slot").alias("first")).orderBy("segment").collect()
    total = sum(e.n for e in ends)
    if refuse and total > slots:
        raise StoreError(Status.FULL, f"{total} keys for {slots} slots")
    before, lows = 0, []
    for e in ends:
        lows.append(before + e.least)
        before += e.n
    low = -max(0, total - slots - min(lows, default=0))
    carried, before = [], 0
    for i, e in enumerate(ends):
        carried.append((e.segment, before, low, ends[i + 1].first if i + 1 < len(ends) else ends[0].first + slots))
        before, low = before + e.n, min(low, lows[i])
    ends_of = F.broadcast(df.sparkSession.createDataFrame(carried, "segment int, before long, low long, beyond long"))
    waiting = F.col("arriving") + n
    found = level.join(ends_of, "segment").withColumn("arriving", F.col("before") + F.col("level") - F.least(F.col("before") + F.col("least"), F.col("low")))
    found = found.withColumn("m", F.least(waiting, F.coalesce("following", "beyond") - home))
    return found.select("hash_slot", "keys_in_slot", "arriving", (F.col("m") * waiting - F.expr("m * (m - 1) div 2")).alias("looks"))
