"""Range scans and global order without a single-task sort (OP-05, OP-33, OP-73 to OP-77)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GROUP_BITS, GROUPS, group_of, long_to_key, order_by


def in_range(df: DataFrame, lower: bytes | None = None, upper: bytes | None = None, key: str = "key") -> DataFrame:
    """Rows of ``lower <= key < upper`` by unsigned bytes; a null bound is open. Both reach the scan."""
    if lower is not None:
        df = df.where(F.col(key) >= F.lit(lower))
    if upper is not None:
        df = df.where(F.col(key) < F.lit(upper))
    return df


def in_long_range(df: DataFrame, lower: int | None = None, upper: int | None = None, key: str = "key_long") -> DataFrame:
    """The same over a signed long key."""
    if lower is not None:
        df = df.where(F.col(key) >= lower)
    if upper is not None:
        df = df.where(F.col(key) < upper)
    return df


def groups_between(lower: bytes | None, upper: bytes | None, bits: int = GROUP_BITS) -> tuple[int, int]:
    """The first and last group that an unsigned key range may touch, for partition pruning."""
    top = lambda b: int.from_bytes(b[:8].ljust(8, b"\0"), "big")
    low = 0 if lower is None else top(lower) >> (64 - bits)
    if upper is None:
        return low, (1 << bits) - 1
    last = top(upper) - (len(upper) <= 8)  # the bound itself is out; a longer bound leaves its own first 8 bytes in
    return low, max(-1, last) >> (64 - bits)


def ranked_by_group(df: DataFrame, order: str = "unsigned", key: str = "key_long", name: str = "pos") -> DataFrame:
    """``df`` with each row's global position (from 1) in one of the key orders; keys have to be unique.

    Groups are ranges of every order, so that a position is the number of rows in earlier groups plus the row's place
    in its own: a sort a group, and one row a group of counts, instead of one sort of everything in one task. Groups are
    cut further at key quantiles, as many as shuffle partitions, whether keys spread over groups or not; the broadcast
    counts have a row a group and a row a cut at most.
    """
    k = F.col(key)
    marked = df.withColumns({"_grp": group_of(k), "_cut": range_of(k, quantile_cuts(df, key))})
    before = Window.orderBy(*_group_order(order), F.col("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    base = marked.groupBy("_grp", "_cut").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_grp", "_cut").orderBy(k))
    return marked.withColumn("_in", inside).join(F.broadcast(base), ["_grp", "_cut"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_grp", "_cut", "_in", "_before")


def _group_order(order: str) -> list[Column]:
    g = F.col("_grp")
    if order == "unsigned":
        return [g.asc()]
    if order == "signed":
        return [F.when(g >= GROUPS // 2, g - GROUPS).otherwise(g).asc()]
    if order == "live":
        return [(g < GROUPS // 2).asc(), F.when(g >= GROUPS // 2, -g).otherwise(g).asc()]
    order_by(order)
    raise AssertionError


#: Cuts up to which a row's range is found by comparisons in generated code; they would not fit a method much beyond.
TREE = 256


def quantile_cuts(df: DataFrame, key: str) -> list[int]:
    """Quantiles of a long column that cut it into as many ranges as there are shuffle partitions, or fewer if values repeat.

    That setting follows the data's size, and so does the list, the only thing that reaches the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    return sorted({min(int(x), (1 << 63) - 1) for x in df.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n)})


def range_of(k: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below k; 0 for null."""
    if len(cuts) > TREE:
        return _searched(k, cuts)

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.coalesce(k >= cuts[mid], F.lit(False)), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


def _searched(k: Column, cuts: list[int]) -> Column:
    """The same by halving steps over an array: the place grows by a step if the cut at its end is not above k."""
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    held = F.expr(f"array({','.join(f'{c}L' if c > -(1 << 63) else '(-9223372036854775807L - 1L)' for c in cuts)})")
    fits = lambda at: F.coalesce(F.get(held, at - 1) <= k, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def globally_sorted(df: DataFrame, order: str = "unsigned", key: str = "key_long") -> DataFrame:
    """Range-partitioned and sorted, for ordered visits."""
    return df.orderBy(*order_by(order, key))


def sorted_in_groups(df: DataFrame, key: str = "key_long") -> DataFrame:
    """Key ranges as partitions, each sorted, with no order of partitions promised to the reader (OP-73)."""
    return df.repartitionByRange(F.col(key)).sortWithinPartitions(key)


def encoded(df: DataFrame, key: str = "key_long") -> DataFrame:
    return df.withColumn("key", long_to_key(F.col(key)))
