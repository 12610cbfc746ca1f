"""Language ID and the quality classifier: held-out accuracy and edge cases. The pipeline against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvspark.llm import language, quality, simhash

from .conftest import DOCS, documents, words
from .test_dedup import plain_lines
from .test_similar import plain_groups
from .test_texts import plain_hits


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, words(i + 50, 40, kind), kind, "s", None) for i in range(60) for kind in ("en" if i % 2 else "fr",)]
    return spark.createDataFrame(rows, DOCS)


def test_language_held_out(corpus, docs):
    rows = language.predict(corpus).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.lang_score <= 1 for r in rows) and any(r.held for r in rows)
    model = language.learn(corpus)
    got = {r.doc_id: r for r in language.identify(docs.withColumn("lang_pred", F.lit("mine")), model).collect()}
    for i, text, *_ in documents():
        letters = any(c.isalpha() for c in text or "")
        assert (got[i].lang_pred == "und") == (not letters) and got[i].lang_pred in ("en", "fr", "und")
        assert (got[i].lang_score == 0) == (not letters) and got[i].id == "mine"


def test_language_mixture_and_nothing_learned(spark, corpus, empty):
    model = language.learn(corpus)
    both = spark.createDataFrame([(1, words(900, 200) + " " + words(901, 100, "fr"))], "doc_id long, text string")
    got = language.identify(both, model).head()
    assert set(got.lang_shares) == {"en", "fr"} and got.lang_pred == max(got.lang_shares, key=got.lang_shares.get) and abs(sum(got.lang_shares.values()) - 1) < 1e-3
    nothing = language.predict(corpus.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language.predict(empty).count() == 0


def test_letters():
    for text, want in (("", False), (None, False), ("12 !", False), ("é", True), ("中", True), ("²½", False), ("-" * 70 + "é" * 3, True), ("🙂", False), ("x", True)):
        assert language.has_letter(None if text is None else text.encode()) is want


@pytest.fixture(scope="module")
def rated(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in words(i, 30).split()) if bad and i % 8 else (words(i, 1) + " ") * 40 if bad else words(i, rnd.randint(5, 60)) + "."
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")


def test_quality_held_out(rated):
    docs, labels = rated
    rows = quality.predict(docs.withColumn("quality_score", F.lit("mine")), labels).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(rows) == 240 and len(held) > 40
    assert sum(r.quality_predicted == int(r.doc_id % 4 != 0) for r in held) / len(held) > 0.95


def test_quality_edges(rated, docs, empty):
    texts, labels = rated
    model = quality.learn(texts, labels)
    got = quality.rate(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.quality_score <= 1 and r.quality_predicted == int(r.quality_score >= 0.5) for r in got)
    assert quality.rate(empty, model).count() == 0
    none = quality.predict(texts, labels.limit(0)).select("quality_score").distinct().collect()
    assert len(none) == 1
    only = quality.train(np.random.default_rng(0).random((20, len(quality.FEATURES))), np.ones(20))
    assert (only.score(np.zeros((1, len(quality.FEATURES)))) > 0.9).all()


def test_features_are_finite():
    for _, text, *_ in documents():
        x = quality.features(None if text is None else text.encode())
        assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()


def test_pipeline_against_plain_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in one.collect())
    assert {i for i, _ in kept} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    two = stages["line_dedup"](spark, one, sf_dir)
    kept = sorted(plain_lines(kept))
    rows = two.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == kept and all(r.n_chars == len(r.text) for r in rows)
    three = stages["simhash_near_dedup"](spark, two, sf_dir)
    roots = plain_groups(dict(kept))
    kept = [(i, t) for i, t in kept if roots[i] == i]
    assert sorted((r.doc_id, r.text) for r in three.collect()) == kept
    four = stages["decontaminate"](spark, three, sf_dir)
    kept = [(i, t) for i, t in kept if not plain_hits(t, items, 10)[1]]
    assert sorted((r.doc_id, r.text) for r in four.collect()) == kept and four.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {i for i, _ in kept}


def test_pipeline_stages_take_awkward_rows(spark, docs, empty, nameless, sf_dir):
    import corpus_pipeline

    for rows in (docs, empty, nameless):
        at = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, sf_dir)
            if name != "pack":
                assert out.columns == rows.columns
                at = out
            out.count()


def test_stages_that_shuffle_documents_give_few_files(spark, docs, sf_dir):
    """A file costs the executor that creates it child processes: there are not as many as shuffle partitions."""
    import corpus_pipeline

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        for name in ("line_dedup", "simhash_near_dedup", "pack"):
            assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).rdd.getNumPartitions() <= 16, name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_layouts_cover_all_bits():
    for budget, agree in ((4, 2), (6, 2), (4, 3)):
        for top, blocks in simhash.layouts(budget, agree):
            assert sum(w for _, w in blocks) == 64 and sorted(b for s, w in blocks for b in range(s, s + w)) == list(range(64))
            assert top == sum(w for _, w in blocks[:agree])
        fps = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
        assert all((simhash._restored(simhash._arranged(fps, b), b) == fps).all() for _, b in simhash.layouts(budget, agree))
