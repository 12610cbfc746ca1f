"""Where records lie: groups, slots, addresses, files, windows, zones (OP-12 to OP-16, OP-34, OP-57, OP-59, OP-70, OP-81 to OP-83, OP-97)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import pack_address, value_offset
from ..schema import GROUPS, VALUE_BYTES, group_of
from .ordering import quantile_cuts, range_of

#: Records of a 256 MB window, and of a 128 MB file slice.
WINDOW = 65536
SLICE = 32768


def routed(df: DataFrame, key: str = "key_long") -> DataFrame:
    """With the group of each key."""
    return df.withColumn("grp", group_of(F.col(key)))


def slotted(df: DataFrame, group: str = "grp", seq: str = "seq") -> DataFrame:
    """With the ordinal of each record in its group, in order of arrival; ``seq`` is a long.

    A group may hold any share of the records, so that its order is not left to one task: arrival is cut into ranges of
    about equal counts, and a slot is the group's records in earlier ranges plus the place in its own.
    """
    marked = df.withColumns({"_of": F.struct(group), "_cut": range_of(F.col(seq), quantile_cuts(df, seq))})  # structs of nulls are equal
    before = Window.partitionBy("_of").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    base = marked.groupBy("_of", "_cut").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = marked.withColumn("_in", F.row_number().over(Window.partitionBy("_of", "_cut").orderBy(seq)))
    found = placed.join(base, ["_of", "_cut"])
    return found.withColumn("slot", (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_of", "_cut", "_in", "_before")


def addressed(df: DataFrame) -> DataFrame:
    """With offset, one-based live address and packed address of each slot."""
    offset = value_offset(F.col("slot"), VALUE_BYTES)
    return df.withColumns({"value_offset": offset, "live_address": offset + 1, "address": pack_address(F.col("grp"), offset)})


def windowed(df: DataFrame, records: int = WINDOW) -> DataFrame:
    """With the window that each slot is read in."""
    return df.withColumn("window", F.floor(F.col("slot") / records).cast("long"))


def sliced(df: DataFrame, records: int = SLICE, step: int = GROUPS) -> DataFrame:
    """With the number of the file that each slot lies in (a full file rolls to the number ``step`` higher), and its place there."""
    return df.withColumns({"file_no": (F.col("grp") + F.floor(F.col("slot") / records) * step).cast("long"), "file_slot": F.col("slot") % records})


def round_robin(df: DataFrame, writers: int = 64, seq: str = "seq") -> DataFrame:
    """With the log that each record goes to when writers take turns."""
    return df.withColumn("log_no", (F.col(seq) % writers).cast("int"))


def writer_affine(df: DataFrame, writers: int = 64) -> DataFrame:
    """With the log of the task that writes each record (OP-14): all records of a task go to one log, no log is locked."""
    return df.withColumn("log_no", F.pmod(F.spark_partition_id(), F.lit(writers)))


def non_empty(df: DataFrame, key: str = "key_long") -> DataFrame:
    """The groups that have records (OP-37): ``grp``. Key 0 is a key like any other."""
    return routed(df, key).select("grp").distinct()


def group_stats(df: DataFrame, key: str = "key_long") -> DataFrame:
    """Records and key limits of each group, and of all (``grp`` null): one pass."""
    return routed(df, key).rollup("grp").agg(F.count("*").alias("n"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def well_distributed(df: DataFrame, key: str = "key_long") -> DataFrame:
    """Whether the last group has records (OP-38)."""
    return df.agg((F.max(group_of(F.col(key))) == GROUPS - 1).alias("well_distributed"), F.count_distinct(group_of(F.col(key))).alias("n_groups"))


def sign_counts(df: DataFrame, key: str = "key_long") -> DataFrame:
    k = F.col(key)
    return df.agg(F.count_if(k > 0).alias("n_positive"), F.count_if(k < 0).alias("n_negative"), F.count_if(k == 0).alias("n_zero"))


def zone_map(df: DataFrame, zone: list[str], key: str = "key_long", record: int = 16) -> DataFrame:
    """Smallest and largest key, records and bytes of each zone (OP-83)."""
    return df.groupBy(*zone).agg(F.min(key).alias("smallest"), F.max(key).alias("largest"), F.count("*").alias("n"), (F.count("*") * record).alias("file_size"))


#: Ranges of keys by which zones and probes meet.
RANGES = 1024


def zone_candidates(zones: DataFrame, probes: DataFrame, key: str = "key_long") -> DataFrame:
    """Zones that may hold each probe; limits count as inside (OP-34). Probes are made distinct first.

    The keys that zones span are cut into RANGES ranges; a zone stands in each that it touches, and a probe meets the zones
    of its own by an equal join. Two numbers, the span's ends, go to the driver.
    """
    low, high = zones.agg(F.min("smallest"), F.max("largest")).first()
    width = max(1.0, ((high or 0) - (low or 0)) / RANGES)
    # Rounding never turns the order of two keys, so a key between limits lies in a range between theirs.
    place = lambda k: F.floor((k.cast("double") - float(low or 0)) / width)
    spread = zones.withColumn("_range", F.explode(F.sequence(place(F.col("smallest")), place(F.col("largest")))))
    asked = probes.select(key).distinct().withColumn("_range", place(F.col(key)))
    return asked.join(spread, "_range").where(F.col(key).between(F.col("smallest"), F.col("largest"))).drop("_range")
