"""The store, the raw log source and streams."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kvspark.errors import Status, StoreError
from kvspark.schema import long_to_key
from kvspark.sources import logs
from kvspark.store import KVStore
from kvspark.streaming import ingest

KEYS = [0, 1, -1, -(1 << 63), (1 << 63) - 1, 5]


def records(spark, rows):
    return spark.createDataFrame(rows, "k long, value binary, seq long").select(long_to_key(F.col("k")).alias("key"), "value", "seq")


def key(n: int) -> bytes:
    return n.to_bytes(8, "big", signed=True)


def test_put_get_range_and_reopen(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), prefix_bits=3)
    with pytest.raises(StoreError) as e:
        store.get(key(0))
    assert e.value.status is Status.NOT_FOUND
    store.put(records(spark, [(k, b"first", i) for i, k in enumerate(KEYS)]))
    store.put(records(spark, [(5, b"second", 100)]), bloom=True)
    again = KVStore.open(spark, str(tmp_path / "s"), prefix_bits=3)
    assert again.get(key(5)) == b"second" and again.get(key(0)) == b"first"
    with pytest.raises(StoreError):
        again.get(key(77))
    unsigned = sorted(KEYS, key=lambda n: n % (1 << 64))
    assert [k for k, _ in again.pairs()] == [key(n) for n in unsigned]
    assert [k for k, _ in again.pairs(key(1), key(5))] == [key(1)]
    assert [r.key for r in again.range(order="signed").collect()] == [key(n) for n in sorted(KEYS)]
    seen = []
    again.visit(lambda k, v: seen.append((k, v)), key(5), None)
    assert seen[0] == (key(5), b"second")
    probes = spark.createDataFrame([(key(5),), (key(9),)], "key binary")
    assert {bytes(r.key): r.status for r in again.multi_get(probes).collect()} == {key(5): "SUCC", key(9): "NOT_FOUND"}
    small = again.compact(str(tmp_path / "c"))
    assert small.records().count() == len(KEYS) and small.get(key(5)) == b"second"
    small.close()
    with pytest.raises(StoreError) as e:
        small.get(key(5))
    assert e.value.status is Status.NOT_SUPPORTED


def test_bad_records_are_refused(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError) as e:
        store.put(spark.createDataFrame([(b"short", b"v", 1)], "key binary, value binary, seq long"))
    assert e.value.status is Status.INVALID_ARGUMENT
    with pytest.raises(StoreError):
        store.put(spark.range(1))


def test_point_read_prunes_directories(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), prefix_bits=3)
    store.put(records(spark, [(k, b"v", i) for i, k in enumerate(KEYS)]))
    rows = store.records().where((F.col("prefix") == 0) & (F.col("key") == F.lit(key(1))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan and "EqualTo(key" in plan


def test_raw_logs_round_trip_and_torn_tail(spark, tmp_path):
    logs.register(spark)
    path = str(tmp_path / "logs")
    rows = [(g, s, key(g * 100 + s), bytes([g, s, 1, 2])) for g in (0, 3) for s in range(5)]
    df = spark.createDataFrame(rows, logs.SCHEMA)
    df.repartition("grp").sortWithinPartitions("grp", "slot").write.format("kvlog").mode("append").option("valueBytes", "4").option("slice", "2").save(path)
    assert {f"{n:06d}.log" for n in (0, 1024, 2048, 3, 1027, 2051)} <= set(os.listdir(path)) and not [x for x in os.listdir(path) if x.endswith("tmp")]
    read = spark.read.format("kvlog").option("valueBytes", "4")
    assert sorted(map(tuple, read.load(path).collect())) == sorted(rows)
    with open(f"{path}/002048.log", "ab") as f:  # a torn value behind the last whole one
        f.write(b"xyz")
    assert read.load(path).count() == 10
    os.truncate(f"{path}/002051.log", 3)
    assert read.load(path).count() == 9
    only = spark.read.format("kvlog").option("valueBytes", "4").option("values", "false").option("groups", "3").load(path).collect()
    assert {r.grp for r in only} == {3} and all(r.value is None for r in only)


def test_appends_go_on_behind_what_is_there(spark, tmp_path):
    logs.register(spark)
    path = str(tmp_path / "logs")
    write = lambda rows, mode="append": spark.createDataFrame(rows, logs.SCHEMA).coalesce(1).sortWithinPartitions("grp", "slot").write.format("kvlog").mode(mode).option("valueBytes", "1").option("slice", "4").save(path)
    rows = [(1, s, key(s), bytes([s])) for s in range(13)] + [(2, 0, key(99), b"z")]
    write(rows[:10])
    write(rows[10:])
    read = spark.read.format("kvlog").option("valueBytes", "1").load(path)
    assert sorted(map(tuple, read.collect())) == sorted(rows) and read.rdd.getNumPartitions() == 5
    late = logs.LogWriter({"path": path, "valuebytes": "1"})
    late.rounds = {}
    (tmp_path / "logs" / "000001.log.7.tmp").write_bytes(b"x")
    with pytest.raises(ValueError):
        late.commit([logs.Written([(f"{path}/000001.log.7.tmp", f"{path}/000001.log")])])
    assert read.count() == 14 and not [x for x in os.listdir(path) if x.endswith("tmp")]
    write(rows[:2], "overwrite")
    assert sorted(map(tuple, spark.read.format("kvlog").option("valueBytes", "1").load(path).collect())) == rows[:2]


def test_windowed_counts(spark, tmp_path):
    import datetime as dt

    landed, at = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    spark.createDataFrame([(at + dt.timedelta(seconds=s), k) for s, k in ((0, "a"), (30, "a"), (59, "b"), (60, "a"), (7200, "b"))], "ts timestamp, event_type string").coalesce(1).write.parquet(landed)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(landed)
    made = ingest.windowed_counts(stream)
    query = made.writeStream.outputMode("update").format("memory").queryName("counts_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r["n"] for r in spark.table("counts_out").collect()) == 5


def test_running_latest(spark, tmp_path):
    landed = str(tmp_path / "in")
    spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 3), (2, 5.0, 2)], "key_long long, value double, seq long").coalesce(1).write.parquet(landed)
    spark.createDataFrame([(1, 0.5, 2), (2, 6.0, 9)], "key_long long, value double, seq long").coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema("key_long long, value double, seq long").option("maxFilesPerTrigger", 1).parquet(landed)
    query = ingest.running_latest(stream).writeStream.outputMode("update").format("memory").queryName("latest_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    best = {}
    for r in spark.table("latest_out").collect():
        if r.seq >= best.get(r.key_long, (0, 0))[0]:
            best[r.key_long] = (r.seq, r.value)
    assert best == {1: (3, 2.0), 2: (9, 6.0)}


def test_what_the_driver_holds_of_logs_does_not_grow_with_files(spark, tmp_path):
    """A group's files are one run for the commit and one range a share for the reader; a large group is divided."""
    logs.register(spark)
    path = str(tmp_path / "logs")
    rows = [(1, s, key(s), bytes([s])) for s in range(200)] + [(g, 0, key(-g), b"z") for g in (5, 9)]
    spark.createDataFrame(rows, logs.SCHEMA).coalesce(1).sortWithinPartitions("grp", "slot").write.format("kvlog").mode("append").option("valueBytes", "1").option("slice", "2").save(path)
    assert len([x for x in os.listdir(path) if x.endswith(".log")]) == 102
    shares = logs.LogReader({"path": path, "valuebytes": "1", "tasks": "4"}).partitions()
    assert [sum(b - a for _, a, b in x.files) for x in shares] == [25, 26, 25, 26] and sum(len(x.files) for x in shares) == 6
    for options in ({"tasks": "4"}, {"tasks": "7"}, {}):
        read = spark.read.format("kvlog").options(valueBytes="1", **options).load(path)
        assert sorted(map(tuple, read.collect())) == sorted(rows)
    message = logs.Written(runs=[(1, 100, 3)])
    assert sum(1 for _ in message.moves(path, ("keyLog", "log"))) == 200
    assert list(message.moves(path, ("log",)))[1] == (f"{path}/001025.log.3.tmp", f"{path}/001025.log")


def test_writers_of_logs_are_not_coalesced(spark, sf_dir):
    from kvspark.plans import queries

    rows = spark.range(1000).select((F.col("id") % 50).cast("int").alias("grp"), "id", F.col("id").alias("slot"))
    assert queries._by_group(rows).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_parts_of_a_visit_are_made_where_they_lie_and_come_in_order(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), prefix_bits=3)
    store.put(records(spark, [(k * 7919 % 4001, b"v%d" % k, k) for k in range(4000)]))
    parts = store.visit_parts(lambda pairs: (lambda all_: (len(all_), [k for k, _ in all_], os.getpid()))(list(pairs)), "n long, keys array<binary>, pid long", key(100), key(3000))
    assert [bytes(k) for p in parts for k in p["keys"]] == [key(n) for n in range(100, 3000)] and sum(p.n for p in parts) == 2900
    assert os.getpid() not in {p.pid for p in parts}


def test_the_visit_query_sends_no_pairs_to_the_driver(spark, sf_dir, monkeypatch):
    from kvspark.plans.queries import QUERIES

    monkeypatch.setattr(KVStore, "pairs", lambda *_: pytest.fail("pairs came to the driver"))
    row = QUERIES["kv_store_visit"](spark, sf_dir).head()
    assert row.n > 0 and row.first_key == 64 and row.ascending
