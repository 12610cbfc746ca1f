"""Sharding by sampled splitters (operator 10).

Keys are ``(xxhash64(text), xxhash64(doc_id, place of the row))``: equal texts lie side by side, and a
group of equal texts or even of equal rows larger than a range is still divided by the second half. A size-weighted sample of keys gives
quantile boundaries of many narrow ranges; records are range-partitioned over them. Exact bytes and
rows of each range are then known, so every record's place in the global byte order is known without
one global sort, and a range that overfills its shard is subdivided at the byte where the shard ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored

RESERVED = 8


def _sample(keys: DataFrame, total: int, wanted: int) -> np.recarray:
    """About ``wanted`` keys, each drawn with a chance in proportion to its size (Poisson sampling).

    The draw is a hash of the key, so that a recomputed task draws the same rows. A key whose expected
    count is over 1 is weighted by it. The result is bounded by ``wanted`` and does not grow with the data.
    """
    chance = F.col("size") * F.lit(float(wanted)) / F.lit(float(total))
    uniform = (F.shiftrightunsigned(F.xxhash64("k1", "k2", "size"), 11)).cast("double") / F.lit(float(1 << 53))
    rows = keys.withColumn("w", chance).where(uniform < F.col("w")).select("k1", "k2", F.greatest("w", F.lit(1.0)).alias("w"))
    got = rows.toPandas()
    order = np.lexsort((got.k2.to_numpy(), got.k1.to_numpy()))
    return np.rec.fromarrays([got[c].to_numpy()[order] for c in ("k1", "k2", "w")], names="k1,k2,w")


def splitters(sample: np.recarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys at the ``1/ranges`` quantiles of the sample's weight."""
    if not len(sample):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    weight = np.cumsum(sample.w)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    keys = np.unique(np.rec.fromarrays([sample.k1[at], sample.k2[at]], names="k1,k2"))
    return keys.k1.astype(np.int64), keys.k2.astype(np.int64)


def range_of(k1: np.ndarray, k2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """The number of splitters below or at each key, in (k1, k2) order."""
    low, high = np.searchsorted(s1, k1, "left"), np.searchsorted(s1, k1, "right")
    for i in np.flatnonzero(high - low):
        low[i] += np.searchsorted(s2[low[i] : high[i]], k2[i], "right")
    return low


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 64, draws_per_range: int = 32) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row of ``docs``; bytes a shard are equal to within one record.

    size: UTF-8 bytes of the text plus 8; a null text has none and crc32 0. Null ids are kept and sort by
    their hash like any other key; keys are stored once, so a row's place in its input decides but once. Repeated rows each take their own slot. No rows: no rows. Other columns
    of ``docs`` are not read, so their names cannot clash. Only (id, size, crc, two hashes) are shuffled,
    never the texts; to the driver go the sample, and one row a range (``shards * ranges_per_shard``).
    """
    spark = docs.sparkSession
    ready(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + RESERVED).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("k2"),
    ))
    total = keys.agg(F.sum("size")).first()[0] or 0
    s1, s2 = splitters(_sample(keys, max(total, 1), shards * ranges_per_shard * draws_per_range), shards * ranges_per_shard)

    @F.pandas_udf("int")
    def find(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(range_of(k1.to_numpy(), k2.to_numpy(), s1, s2).astype(np.int32))

    ranged = keys.withColumn("range", find("k1", "k2"))
    in_range = Window.partitionBy("range").orderBy("k1", "k2", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"row": F.row_number().over(Window.partitionBy("range").orderBy("k1", "k2", "size", "crc")), "upto": F.sum("size").over(in_range)})
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").collect()
    bytes_before = np.cumsum([0, *(r.bytes for r in sums)])[:-1].tolist()
    rows_before = np.cumsum([0, *(r.rows for r in sums)])[:-1].tolist()
    bases = spark.createDataFrame([(r.range, b, n) for r, b, n in zip(sums, bytes_before, rows_before)], "range int, bytes_before long, rows_before long")
    # A record belongs to the shard in which its middle byte lies.
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") + F.floor(F.col("size") / 2)
    ranked = stored(placed.join(F.broadcast(bases), "range").select(
        "id", "size", "crc", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(total, 1)))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row") - 1).alias("rank"),
    ))
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.col("first")).alias("slot"))
