"""Recovery and manifest queries (OP-21, OP-22, OP-27, OP-30, OP-84 to OP-86, OP-102)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import all_zero, be_to_int, file_kind, file_number, int_to_be
from ..schema import VALUE_BYTES, key_to_long, long_to_key


def valid_prefix(df: DataFrame, sizes: DataFrame, group: str = "grp", record: int = VALUE_BYTES) -> DataFrame:
    """Records whose value lies whole in its group's file; a torn last one is left out. sizes: group, ``bytes``."""
    whole = sizes.select(group, F.floor(F.col("bytes") / record).cast("long").alias("n_valid"))
    return df.join(whole, group).where(F.col("slot") < F.col("n_valid"))


def trim_zero_tail(df: DataFrame, page: int, group: str = "grp", value: str = "value", slot: str = "slot") -> DataFrame:
    """Per group ``n_slots, n_real``: slots up to the first all-zero value of the last page of ``page`` records."""
    flags = df.select(group, F.col(slot).alias("slot"), all_zero(F.col(value)).alias("zero"))  # a bit, not the value, is shuffled
    n = flags.groupBy(group).agg((F.max("slot") + 1).alias("n_slots"), F.max(F.when(F.col("zero"), F.col("slot"))).alias("last_zero"))
    # Only groups with a zero in their last page have anything to trim.
    some = n.where(F.col("last_zero") >= F.col("n_slots") - page)
    first = flags.where("zero").join(some, group).where(F.col("slot") >= F.col("n_slots") - page).groupBy(group).agg(F.min("slot").alias("first"))
    return n.join(first, group, "left").select(group, "n_slots", F.coalesce("first", "n_slots").alias("n_real"))


def edit_records(edits: DataFrame, order: str = "edit_no") -> DataFrame:
    """Manifest edits in stored form, 32 bytes each, with their order: what a manifest table is appended with (OP-27)."""
    n = lambda c: int_to_be(F.col(c))
    record = F.concat(n("compacted_log"), n("file_no"), n("file_size"), long_to_key(F.col("smallest")), long_to_key(F.col("largest")), n("next_file"))
    return edits.select(order, record.alias("record"))


def edits(records: DataFrame, order: str = "edit_no") -> DataFrame:
    """The edits that ``edit_records`` stored."""
    n = lambda at: be_to_int(F.substring("record", at, 4)).cast("long")
    k = lambda at: key_to_long(F.substring("record", at, 8))
    return records.select(order, n(1).alias("compacted_log"), n(5).alias("file_no"), n(9).alias("file_size"), k(13).alias("smallest"), k(21).alias("largest"), n(29).alias("next_file"))


def replay(manifest: DataFrame, order: str = "edit_no") -> DataFrame:
    """What a manifest says in the end: the last edit's numbers, and the files of all edits in order. One row."""
    last = lambda c: F.max_by(c, order).alias(c)
    return manifest.agg(last("compacted_log"), last("next_file"), F.count("*").alias("n_files"), F.sum("file_size").alias("total_size"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def unrecorded(logs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Logs that no edit has compacted, in need of redo. logs: ``log_no``."""
    return logs.join(manifest.select(F.col("compacted_log").alias("log_no")), "log_no", "left_anti")


def orphans(tables: DataFrame, manifest: DataFrame) -> DataFrame:
    """Table files that the manifest does not name. tables: ``file_no``."""
    return tables.join(manifest.select("file_no"), "file_no", "left_anti")


def inventory(files: DataFrame, base: int = 64, name: str = "name") -> DataFrame:
    """Of each base number (file number modulo ``base``): its value logs in order, and the latest."""
    logs = files.withColumn("n", file_number(F.col(name))).where(file_kind(F.col(name)).isin("log"))
    return logs.groupBy((F.col("n") % base).alias("base")).agg(F.sort_array(F.collect_list("n")).alias("files"), F.max("n").alias("latest"))
