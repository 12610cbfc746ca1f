"""Deterministic Bloom filters as relations of set bits (OP-45, OP-46, OP-48)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bloom_position

#: Hashes and bits a key of the 1 % filter, and of the 3 % one.
ONE_PERCENT = (7, 10.0989)
THREE_PERCENT = (6, 8.656)


def size_in_bits(keys: int, per_key: float = ONE_PERCENT[1]) -> int:
    """Bits for so many keys, rounded up to whole 64-bit words."""
    return math.ceil(math.ceil(per_key * keys) / 64) * 64


def _positions(df: DataFrame, bits: int, hashes: int, key: str) -> DataFrame:
    return df.withColumn("bit", F.explode(F.array(*[bloom_position(F.col(key), F.lit(i), bits) for i in range(hashes)])))


def build(df: DataFrame, block: list[str], bits: int, hashes: int = ONE_PERCENT[0], key: str = "key_long") -> DataFrame:
    """The set bits of each block's filter: ``block..., bit``, no bit twice."""
    return _positions(df.select(*block, key), bits, hashes, key).select(*block, "bit").distinct()


def as_words(filters: DataFrame, block: list[str]) -> DataFrame:
    """Filters in stored form: 64-bit words that have a bit set, ``block..., word, bits``."""
    return filters.groupBy(*block, F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))


#: Bytes of turned filters that are broadcast at once.
ROUND_BYTES = 32 << 20


def turned(filters: DataFrame, block: list[str], bits: int) -> DataFrame:
    """Filters turned on their side: ``others..., _chunk, _sets``. For 64 blocks together, each bit has one number that says in which of them it is set."""
    *others, last = block
    lane = F.pmod(F.col(last), F.lit(64)).cast("int")
    sets = filters.groupBy(*others, F.floor(F.col(last) / 64).cast("long").alias("_chunk"), "bit").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), lane)).alias("_set"))
    held = sets.groupBy(*others, "_chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("bit").cast("long").alias("bit"), "_set"))).alias("_held"))
    end = F.array(F.struct(F.lit(bits).cast("long").alias("bit"), F.lit(0).cast("long").alias("_set")))
    zeros = lambda e, i: F.array_repeat(F.lit(0).cast("long"), (e["bit"] - F.coalesce(F.get("_held", i - 1)["bit"], F.lit(-1).cast("long")) - 1).cast("int"))
    dense = F.flatten(F.transform(F.concat("_held", end), lambda e, i: F.concat(zeros(e, i), F.array(e["_set"]))))
    return held.select(*others, "_chunk", dense.alias("_sets"))


def probe(filters: DataFrame, probes: DataFrame, block: list[str], bits: int, hashes: int = ONE_PERCENT[0], key: str = "key_long") -> DataFrame:
    """Blocks that may hold each probe: all of its bits are set there. The last of the block's columns is a number. Equal positions of one key count once.

    A probe looks its bits up in the turned filters of 64 blocks, and what all of them have in common is the answer; no row of
    a probe and a filter is shuffled. Every probe meets every filter, so time and rows grow with their product. Turned filters
    are broadcast in rounds of ROUND_BYTES at most; their number, one count, is all that the driver asks for.
    """
    *others, last = block
    chunk = [*others, "_chunk"]
    n = filters.select(*others, F.floor(F.col(last) / 64).alias("_chunk")).distinct().count()
    rounds = max(1, -(-n // max(1, ROUND_BYTES // (8 * (bits + 1)))))
    parts = int(filters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = turned(filters, block, bits)
    # By a hash, since a repartition by the key itself is dropped behind the distinct, and few large tasks are left.
    asked = probes.select(key).distinct().repartition(parts, F.xxhash64(key)).select(key, *[bloom_position(F.col(key), F.lit(i), bits).cast("int").alias(f"_b{i}") for i in range(hashes)])
    # Never null, or else the bits of every probe are worked out once more, to leave out nulls before the distinct.
    common = F.coalesce(functools.reduce(lambda a, b: a.bitwiseAND(b), [F.get("_sets", F.col(f"_b{i}")) for i in range(hashes)]), F.lit(0).cast("long"))
    found = None
    for i in range(rounds):
        own = sets.where(F.pmod(F.hash(*chunk), F.lit(rounds)) == i) if rounds > 1 else sets
        met = asked.join(F.broadcast(own), common != 0).select(key, *chunk, common.alias("_all"))
        found = found.unionByName(met) if found else met
    lanes = found.withColumn("_lane", F.explode(F.array(*map(F.lit, range(64))))).where(F.getbit("_all", F.col("_lane")) == 1)
    return lanes.select(key, *others, (F.col("_chunk") * 64 + F.col("_lane")).cast(filters.schema[last].dataType).alias(last))
