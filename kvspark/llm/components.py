"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


#: Edges in one file between rounds.
TOGETHER = 1 << 18
#: Keys with no more rows than this are never dealt over several parts.
FEW = 64


def hub_join(rows: DataFrame, one: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """``rows`` joined to ``one`` (one row a key) on ``key``, with the rows of frequent keys dealt over several tasks.

    ``one`` has a column ``n``: how many rows bear its key; it is not returned. total: the number of rows, or a bound of it.
    A key with more rows than a quarter of a shuffle partition's share has its row of ``one`` repeated, and its rows go to
    the repetitions by a hash of ``by``. There are at most four such keys a shuffle partition, whatever the data: that
    list is broadcast.
    """
    limit = max(FEW, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.ceil(F.col("n") / limit).cast("int")
    hubs = F.broadcast(one.where(F.col("n") > limit).select(key, parts.alias("_parts")))
    dealt = rows.join(hubs, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    return dealt.join(one.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n"), [key, "_part"]).drop("_part")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """``node, root``: for every node of ``edges`` (columns ``a``, ``b``, not null), the smallest node it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round joins every edge to the smallest
    neighbour of its end, so that paths shrink by a constant factor and stars stay as they are; it ends when a round
    changes nothing. Rounds are cut by tables in the shared folder, the last of which stays; only a count and a checksum
    a round reach the driver. Minima are combined before the shuffle, and a hub's edges are dealt over several tasks.
    files: at most so many hold the edges at first; the number of shuffle partitions if not given.
    """

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        moved = hub_join(near, least, "a", "b", total)
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    distinct = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = written(distinct.coalesce(files) if files else distinct)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        old, seen = path, state
        # Edges get fewer from round to round; so should the files and tasks that hold them.
        e, path = written(star(star(e, True, 2 * state[0]), False, 2 * state[0]).coalesce(1 + state[0] // TOGETHER))
        discard(e.sparkSession, old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
