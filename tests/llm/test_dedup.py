"""SimHash near-dedup, components and line dedup against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from contextlib import nullcontext

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kvspark.llm import line_dedup, simhash
from kvspark.llm.components import components


def plain_fingerprint(text, words=4):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("words", [1, 4, 5])
def test_fingerprints(docs, words):
    got = simhash.fingerprints(docs.select("doc_id", "text"), words).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    assert all(r.fp & (1 << 64) - 1 == plain_fingerprint(text[r.id], words) for r in got)


@pytest.mark.parametrize("budget, agree, spread", [(4, 2, 10), (4, 2, 3), (2, 1, 6), (6, 2, 12), (4, 3, 8)])
def test_links_give_the_components_of_all_pairs(spark, budget, agree, spread):
    """Balls of fingerprints around a few centres: dense groups, chains and lone ones."""
    rnd = np.random.default_rng(spread)
    centres = rnd.integers(0, 1 << 64, 6, dtype=np.uint64)
    fps = set()
    for i in range(400):
        fp = int(centres[i % 6])
        for b in rnd.choice(64, rnd.integers(0, spread), replace=False):
            fp ^= 1 << int(b)
        fps.add(fp)
    fps = sorted(np.array(list(fps), np.uint64).view(np.int64).tolist())
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.argwhere(np.bitwise_count(u[:, None] ^ u[None, :]) <= budget)
    want = plain_components([(fps[a], fps[b]) for a, b in near if a < b], fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, budget, agree)).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_large_buckets_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    centre = 0x0123456789ABCDEF
    fps = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)})
    got = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    assert {r.root for r in got} == {min(fps)} and len(got) == len(fps)


def test_near_dedup_rows(docs, empty, nameless):
    rows = simhash.near_dedup(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(text)
    fp = {i: plain_fingerprint(text[i]) for i in ids}
    want = plain_components([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in rows) == sorted((r.doc_id, fp[r.doc_id], want[r.doc_id]) for r in docs.collect())
    assert simhash.near_dedup(empty).count() == 0
    assert [r.component_id for r in simhash.near_dedup(nameless).collect()].count(None) == 3


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def plain_lines(rows, least=10):
    """rows: (id or None, text). The kept text of each."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    owner = defaultdict(lambda: 1 << 63)
    for i, text in rows:
        for x in (text or "").split("\n"):
            owner[key(x)] = min(owner[key(x)], (1 << 63) - 1 if i is None else i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if len(key(x)) < least or owner[key(x)] == ((1 << 63) - 1 if i is None else i))) for i, t in rows]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (4, 3), (7, 3)])
def test_line_dedup(docs, batches, fanout):
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    rows = got.collect()
    want = plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.text) for r in rows) == sorted(want)
    assert all(r.id == "mine" and r.n_lines - r.n_dropped >= 0 for r in rows)


def test_line_dedup_without_ids_or_rows(nameless, empty):
    got = line_dedup.dedup_lines(nameless).collect()
    assert sorted(r.text for r in got) == ["", "a line that is long enough", "more", "more"]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_have_few_files_and_meet_batches_unshuffled(spark, tmp_path):
    """Every part costs a file for each run and pages of memory: executors grew by them."""
    keys = spark.range(400).selectExpr("id AS rid", "id % 300 AS h1", "id % 7 AS h2")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = line_dedup.Runs(spark, at=f"file://{tmp_path}/runs")
        for a in (0, 100, 200, 300):
            state.add(keys.where(f"rid >= {a} AND rid < {a + 100}"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "32"
        assert len(state.runs()) == 2 and all(len(list(run.glob("part-*"))) <= 4 for run in (tmp_path / "runs").iterdir())
        with state._dealt():
            rows = state.unseen(keys.groupBy("h1", "h2").agg(F.min("rid").alias("owner")))
            assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert rows.count() == 0 and state.owners().count() == keys.select("h1", "h2").distinct().count()
        state.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_runs_have_few_files_where_the_session_holds_its_partitions(spark, tmp_path, monkeypatch):
    """Rows then come in as many parts as the session says; a bucket is one file all the same, and the runs are right."""
    monkeypatch.setattr(line_dedup.Runs, "_dealt", lambda self: nullcontext())
    keys = spark.range(400).selectExpr("id AS rid", "id % 300 AS h1", "id % 7 AS h2")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        state = line_dedup.Runs(spark, at=f"file://{tmp_path}/runs")
        for a in (0, 100, 200, 300):
            state.add(keys.where(f"rid >= {a} AND rid < {a + 100}"))
        assert len(state.runs()) == 2 and all(len(list(run.glob("part-*"))) <= 4 for run in (tmp_path / "runs").iterdir())
        want = keys.groupBy("h1", "h2").agg(F.min("rid").alias("owner"))
        assert sorted(map(tuple, state.owners().select("h1", "h2", "owner").collect())) == sorted(map(tuple, want.collect()))
        assert state.unseen(want).count() == 0
        state.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_lines_of_ten_code_points_count(spark):
    rows = spark.createDataFrame([(1, "éééééééééé\nééééééééé"), (2, "éééééééééé\nééééééééé\nx")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(rows).collect()} == {1: "éééééééééé\nééééééééé", 2: "ééééééééé\nx"}


def test_query_digests(spark, duck, sf_dir):
    from kvspark.llm.queries import ORACLE, QUERIES

    from ..conftest import against

    for name in ORACLE:
        against(spark, duck, sf_dir, QUERIES[name], ORACLE[name])
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in QUERIES["op3_decontaminate"](spark, sf_dir).collect()}


@pytest.mark.parametrize("copies", [0, 900])
def test_a_component_of_most_rows_is_dealt_over_tasks(spark, copies):
    """A component of nine tenths of the fingerprints, and a fingerprint of nine tenths of the rows: same rows, no hot task."""
    from pyspark.sql import functions as F

    from kvspark.llm.components import hub_join

    hub, others = (copies or 900), [f"lone text number {i} with words of its own {i * 7} {i * 11}" for i in range(100)]
    centre = 0x0F0F0F0F00FF00FF
    fps = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(60) for b in range(a, 60)})[:hub]
    if copies:
        docs = spark.createDataFrame([(i, "the same words again and again") for i in range(hub)] + [(hub + i, t) for i, t in enumerate(others)], "doc_id long, text string")
        rows = simhash.near_dedup(docs).collect()
        assert len(rows) == hub + 100 and {r.component_id for r in rows if r.doc_id < hub} == {0}
        return
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    assert len(got) == len(fps) and set(got.values()) == {min(fps)}
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(2 + i, i) for i in range(100)], "root long, fp long")
    one = rows.groupBy("root").agg(F.min("fp").alias("least"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = hub_join(rows, one, "root", "fp", 1000)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert joined.count() == 1000 and joined.columns == ["root", "fp", "least"]
        assert joined.where("root = 1").agg(F.count("*"), F.min("least"), F.max("least"), F.count_distinct("fp")).first() == (900, 0, 0, 900)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 600  # of 1,000; the key alone has 900
