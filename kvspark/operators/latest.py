"""Last write wins, distinct keys, tiers and generations (OP-03, OP-79, OP-80, OP-99 to OP-102)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: records of one memtable generation.
GENERATION = 131072


def latest(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of every key the row of greatest ``seq``. Combined before the shuffle, so that hot keys cost one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(seq)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def raw_visits(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Every key as often as it was written, each time with its latest values: counted, not joined."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"), F.count("*").alias("_n"))
    return best.select(*keys, "_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("visit")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "visit")


def generation(seq: str = "seq", size: int = GENERATION):
    """The memtable generation of a record (OP-99)."""
    return F.floor(F.col(seq) / size).cast("long")


def compacted(df: DataFrame, keys: list[str], seq: str = "seq", size: int = GENERATION) -> DataFrame:
    """Minor compaction: the latest row of each key within each generation (OP-100)."""
    marked = df.withColumn("generation", generation(seq, size))
    return latest(marked, ["generation", *keys], seq)


def tiered(tiers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of every key the row of the first tier that has it, with its number ``tier`` (OP-101)."""
    every = None
    for i, tier in enumerate(tiers):
        tier = tier.withColumn("tier", F.lit(i))
        every = tier if every is None else every.unionByName(tier)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("tier")).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
