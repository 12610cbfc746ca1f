"""Codecs, orders, lookups, recovery: edge cases with known results."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvspark.functions import codec, hashing
from kvspark.operators import bloom, latest, layout, lookup, ordering, recovery
from kvspark.schema import group_of, key_to_long, long_to_key, order_by

EDGES = [0, 1, -1, -(1 << 63), -(1 << 63) + 1, (1 << 63) - 1]


@pytest.fixture
def keys(spark):
    return spark.createDataFrame([(k,) for k in EDGES], "k long")


def test_key_codecs_round_trip(keys):
    k = F.col("k")
    rows = keys.select("k", key_to_long(long_to_key(k)).alias("be"), codec.le_to_long(codec.long_to_le(k)).alias("le"), group_of(k).alias("g"), F.length(long_to_key(k)).alias("n")).collect()
    assert all(r.k == r.be == r.le and r.n == 8 for r in rows)
    assert [r.g for r in rows] == [0, 0, 1023, 512, 512, 511]


def test_three_orders(spark):
    rows = spark.createDataFrame([(k,) for k in (-2, -1, -(1 << 63) + 1, 0, 5, (1 << 63) - 1)], "key_long long")
    low, high = -(1 << 63) + 1, (1 << 63) - 1
    want = {"signed": [low, -2, -1, 0, 5, high], "unsigned": [0, 5, high, low, -2, -1], "live": [-2, -1, low, 0, 5, high]}
    for order, keys in want.items():
        assert [r.key_long for r in rows.orderBy(*order_by(order)).collect()] == keys
        ranked = ordering.ranked_by_group(rows, order).orderBy("pos").collect()
        assert [r.key_long for r in ranked] == keys and [r.pos for r in ranked] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        order_by("other")


@pytest.mark.parametrize("lower, upper, want", [(2, 4, [2, 3]), (None, 2, [1]), (4, None, [4]), (None, None, [1, 2, 3, 4]), (3, 3, []), (4, 2, [])])
def test_range_edges(spark, lower, upper, want):
    rows = ordering.encoded(spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "key_long long"))
    as_key = lambda n: None if n is None else n.to_bytes(8, "big")
    assert sorted(r.key_long for r in ordering.in_range(rows, as_key(lower), as_key(upper)).collect()) == want
    assert sorted(r.key_long for r in ordering.in_long_range(rows, lower, upper).collect()) == want


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
@settings(max_examples=200, deadline=None)
def test_groups_between_covers_the_range(a, b, k):
    low, high = ordering.groups_between(a.to_bytes(8, "big"), b.to_bytes(8, "big"))
    if a <= k < b:
        assert low <= k >> 54 <= high


def test_latest_distinct_visits_and_tiers(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (0, 4, "z"), (None, 5, "n")], "key_long long, seq long, value string")
    got = {r.key_long: r.value for r in latest.latest(rows, ["key_long"]).collect()}
    assert got == {1: "c", 0: "z", None: "n"}
    assert latest.distinct_keys(rows, ["key_long"]).count() == 3
    visits = [(r.key_long, r.value) for r in latest.raw_visits(rows, ["key_long"]).collect()]
    assert sorted(visits, key=str) == sorted([(1, "c")] * 3 + [(0, "z"), (None, "n")], key=str)
    tiers = [rows.where("seq > 2").drop("seq"), rows.where("seq <= 2").drop("seq").dropDuplicates(["key_long"])]
    assert {r.key_long: r.tier for r in latest.tiered(tiers, ["key_long"]).collect()} == {1: 0, 0: 0, None: 0}


def test_multi_get_keeps_every_probe(spark):
    rows = spark.createDataFrame([(0, "zero"), (7, "seven")], "key long, value string")
    probes = spark.createDataFrame([(0,), (7,), (7,), (9,)], "key long")
    got = sorted((r.key, r.value or "", r.status) for r in lookup.multi_get(rows, probes).collect())
    assert got == [(0, "zero", "SUCC"), (7, "seven", "SUCC"), (7, "seven", "SUCC"), (9, "", "NOT_FOUND")]


def test_torn_and_zero_tails(spark):
    rows = spark.createDataFrame([(0, i, bytes(4) if i >= 5 else b"x\0\0y") for i in range(8)] + [(1, i, bytes(4) if i == 1 else b"abcd") for i in range(3)], "grp int, slot long, value binary")
    sizes = spark.createDataFrame([(0, 8 * 4096 - 1), (1, 3 * 4096)], "grp int, bytes long")
    assert sorted((r.grp, r.slot) for r in recovery.valid_prefix(rows, sizes).collect()) == [(0, i) for i in range(7)] + [(1, i) for i in range(3)]
    assert {r.grp: (r.n_slots, r.n_real) for r in recovery.trim_zero_tail(rows, page=4).collect()} == {0: (8, 5), 1: (3, 1)}


def test_bloom_has_no_false_negatives(spark):
    rows = spark.range(500).select((F.col("id") * 7919).alias("key_long"), F.lit(0).alias("block"))
    bits = bloom.size_in_bits(500)
    filters = bloom.build(rows, ["block"], bits)
    assert bloom.probe(filters, rows, ["block"], bits).count() == 500
    others = spark.range(500).select((F.col("id") * 7919 + 1).alias("key_long"))
    assert bloom.probe(filters, others, ["block"], bits).count() < 30
    assert bloom.size_in_bits(4096) == 41408


def test_zone_limits_are_candidates(spark):
    zones = layout.zone_map(spark.createDataFrame([(0, 10), (0, 20), (1, 21), (1, 30)], "z int, key_long long"), ["z"])
    probes = spark.createDataFrame([(10,), (20,), (21,), (31,)], "key_long long")
    assert sorted((r.key_long, r.z) for r in layout.zone_candidates(zones, probes).collect()) == [(10, 0), (20, 0), (21, 1)]


def test_crc32c_known_vector(spark):
    row = spark.createDataFrame([(b"123456789", b"", None)], "a binary, b binary, c binary").select(hashing.crc32c("a").alias("a"), hashing.crc32c("b").alias("b"), hashing.crc32c("c").alias("c"), hashing.crc32c_masked("a").alias("m")).head()
    crc = 0xE3069283
    assert (row.a, row.b, row.c) == (crc, 0, 0)
    assert row.m == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_varints(spark):
    numbers = [0, 127, 128, 16383, 16384, 1 << 35, (1 << 63) - 1, -1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.varint_size(F.col("n")).alias("size"), codec.varint(F.col("n")).alias("b"), codec.varint_value(codec.varint(F.col("n"))).alias("back")).collect()
    assert [r.size for r in rows] == [1, 1, 2, 2, 3, 6, 9, 10] == [len(r.b) for r in rows]
    assert [r.back for r in rows] == numbers
    row = spark.createDataFrame([(b"abc",)], "b binary").select(codec.length_prefixed(F.col("b")).alias("p")).head()
    assert bytes(row.p) == b"\x03abc"


def test_varints_of_large_squares_are_whole(spark):
    """What kv_varint_size makes of keys whose numbers take more than seven bytes."""

    def plain(n: int) -> bytes:
        out = []
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    numbers = [37 * s * s for s in (3900623, 3900624, 8999999, 53999999, 499000000)]
    n = F.col("n")
    rows = spark.createDataFrame([(x,) for x in numbers], "n long").select(codec.varint_size(n).alias("size"), codec.varint(n).alias("b"), codec.varint_value(codec.varint(n)).alias("back")).collect()
    assert [bytes(r.b) for r in rows] == [plain(x) for x in numbers] and rows[2].b.hex() == "a5ebc7c594b8a905"
    assert [r.size for r in rows] == [7, 8, 8, 9, 9] == [len(r.b) for r in rows] and [r.back for r in rows] == numbers


def test_separators_and_successors():
    assert hashing.separator_of(b"abcz", b"abfz") == b"abd"
    assert hashing.separator_of(b"abc", b"abd") == b"abc"
    assert hashing.separator_of(b"ab", b"abc") == b"ab"
    assert hashing.successor_of(b"\xff\x01z") == b"\xff\x02"
    assert hashing.successor_of(b"\xff\xff") == b"\xff\xff"


def test_content_hash_and_compare(spark):
    def plain(b: bytes) -> int:
        h = len(b)
        for x in b:
            h = (h * 31 + (x - 256 if x > 127 else x)) & 0xFFFFFFFF
        h = h - (1 << 32) if h > 0x7FFFFFFF else h
        return h or 1

    values = [b"", b"\x80", b"abc", bytes(8), b"\xff" * 9]
    rows = spark.createDataFrame([(v,) for v in values], "b binary").select(codec.content_hash(F.col("b")).alias("h"), codec.compare_bytes(F.col("b"), F.lit(b"abc")).alias("c"), codec.all_zero(F.col("b")).alias("z")).collect()
    assert [r.h for r in rows] == [plain(v) for v in values]
    assert [r.c for r in rows] == [-1, 1 if b"\x80" > b"abc" else -1, 0, -1, 1]
    assert [r.z for r in rows] == [True, False, False, True, False]


def test_file_names(spark):
    names = ["000012.log", "1234567.keyLog", "12.log", "000001.txt", "000003.sst"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(codec.file_number(F.col("name")).alias("n"), codec.file_kind(F.col("name")).alias("k")).collect()
    assert [(r.n, r.k) for r in rows] == [(12, "log"), (1234567, "keyLog"), (None, None), (None, None), (3, "sst")]


def _home(key: int, slots: int) -> int:
    folded = ((key >> 32) ^ key) & 0xFFFFFFFF
    return (folded ^ (folded >> 16)) & (slots - 1)


@pytest.mark.parametrize("keys, slots", [([], 16), ([5], 16), (list(range(16)), 16), ([15, 31, 47, 63, 14, 30], 16), ([3, 3, 19, 35, 51, 12, 13, 15, 31, 47, 2], 16),
                                         ([(i * 7919) ** 3 % 90001 for i in range(1000)], 1024), ([1023 + 1024 * i for i in range(600)], 1024)])
def test_linear_probing_takes_the_looks_of_real_inserts(spark, keys, slots):
    taken, arriving, looks, homes = {}, {}, {}, {}
    for key in dict.fromkeys(keys):
        at, home = _home(key, slots), _home(key, slots)
        homes[home] = homes.get(home, 0) + 1
        while True:
            looks[at] = looks.get(at, 0) + 1
            if at != home:
                arriving[at] = arriving.get(at, 0) + 1
            if at not in taken:
                taken[at] = key
                break
            at = (at + 1) % slots
    found = {r.hash_slot: r for r in lookup.probing(spark.createDataFrame([(k,) for k in keys], "key_long long"), slots=slots).collect()}
    assert {s: r.keys_in_slot for s, r in found.items()} == homes
    assert {s: r.arriving for s, r in found.items()} == {s: arriving.get(s, 0) for s in homes}
    marks = sorted(homes)
    for s, after in zip(marks, marks[1:] + [marks[0] + slots] if marks else []):
        assert found[s].looks == sum(looks.get(x % slots, 0) for x in range(s, after))


def test_linear_probing_refuses_more_keys_than_slots(spark):
    from kvspark.errors import Status, StoreError

    with pytest.raises(StoreError) as refused:
        lookup.probing(spark.range(17).withColumnRenamed("id", "key_long"), slots=16)
    assert refused.value.status == Status.FULL


@pytest.mark.parametrize("keys, slots", [(list(range(40)), 16), ([15 + 16 * i for i in range(20)], 16), ([3, 3, *range(16, 35)], 16), ([(i * 7919) ** 3 % 90001 for i in range(1500)], 1024)])
def test_linear_probing_counts_more_keys_than_slots(spark, keys, slots):
    """Two rounds over the slots: what waits at the end of the first arrives in the second."""
    homes, waiting, arriving, looked = {}, 0, {}, {}
    for key in dict.fromkeys(keys):
        homes[_home(key, slots)] = homes.get(_home(key, slots), 0) + 1
    for _ in range(2):
        for s in range(slots):
            arriving[s], looked[s] = waiting, waiting + homes.get(s, 0)
            waiting = max(0, looked[s] - 1)
    found = {r.hash_slot: r for r in lookup.probing(spark.createDataFrame([(k,) for k in keys], "key_long long"), slots=slots, refuse=False).collect()}
    assert {s: (r.keys_in_slot, r.arriving) for s, r in found.items()} == {s: (homes[s], arriving[s]) for s in homes}
    marks = sorted(homes)
    for s, after in zip(marks, marks[1:]):
        assert found[s].looks == sum(looked[x] for x in range(s, after))


def test_overflow_lists_hold_256(spark):
    rows = spark.range(300).select((F.col("id") * 16).alias("key_long")).unionByName(spark.createDataFrame([(1,), (1,), (2,), (18,)], "key_long long"))
    found = {r.hash_slot: tuple(r)[1:] for r in lookup.chained(rows, slots=16).collect()}
    assert found == {0: (300, 256, 44), 1: (1, 0, 0), 2: (2, 2, 0)}


def test_cached_read_gives_all_who_asked(spark):
    values = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "grp int, slot long, value string")
    asked = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 9)], "grp int, slot long")
    assert sorted(r.value for r in lookup.cached_read(asked, values, ["grp", "slot"]).collect()) == ["b", "b", "c"]


@pytest.mark.parametrize("n", [1, 2, 3, 256, 257, 511, 512, 1000])
def test_ranges_by_tree_and_by_search_are_the_same(spark, n):
    import bisect

    cuts = sorted({(i * 7919) % 30011 - 15000 for i in range(n - 1)} | {-(1 << 63)})
    values = [*cuts, *(c + 1 for c in cuts), *(c - 1 for c in cuts[1:]), (1 << 63) - 1, None]
    rows = spark.createDataFrame([(v,) for v in values], "k long").select("k", ordering.range_of(F.col("k"), cuts).alias("one"), ordering._searched(F.col("k"), cuts).alias("other")).collect()
    for r in rows:
        assert r.one == r.other == (0 if r.k is None else bisect.bisect_right(cuts, r.k))


@pytest.mark.parametrize("parts", ["4", "600"])
def test_slots_and_positions_do_not_depend_on_the_number_of_ranges(spark, parts):
    """Most rows are of one group; ranges are found by comparisons, or by search if there are many."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(3000).select((F.col("id") * 31 % 3001).alias("key_long"), F.when(F.col("id") % 5 > 0, 7).otherwise(F.col("id") % 3).alias("grp"), (F.col("id") * 1000003 % 3001).alias("seq"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        slots = layout.slotted(rows).coalesce(4).collect()
        ranks = ordering.ranked_by_group(rows).coalesce(4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert [r.pos for r in sorted(ranks, key=lambda r: r.key_long)] == list(range(1, 3001))
    for group in {r.grp for r in slots}:
        own = sorted((r for r in slots if r.grp == group), key=lambda r: r.seq)
        assert [r.slot for r in own] == list(range(len(own)))


def test_slots_of_no_rows_and_of_null_groups(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (3, 9)], "grp int, seq long")
    assert sorted((str(r.grp), r.seq, r.slot) for r in layout.slotted(rows).collect()) == [("3", 9, 0), ("None", 1, 0), ("None", 2, 1)]
    assert layout.slotted(rows.where("seq > 100")).collect() == []
