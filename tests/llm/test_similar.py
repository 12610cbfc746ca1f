"""Groups by shingle similarity against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kvspark.llm import similar

from .test_dedup import plain_components


def plain_groups(texts: dict) -> dict:
    """The smallest id of each id's group, from the Jaccard similarity of all pairs."""

    def sets(text):
        found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    held = {i: sets(t) for i, t in texts.items()}
    pairs = [(a, b) for a in held for b in held if a < b and (9 * len(held[a] & held[b]) >= 4 * (len(held[a]) + len(held[b])))]
    return plain_components(pairs, list(held))


def grouped(spark, texts: dict) -> dict:
    marked, roots = similar.groups(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3))
    root = {r.node: r.root for r in roots.collect()}
    rows = [(r.id, root.get(r.node, r.node)) for r in marked.collect()]
    least = {}
    for i, at in rows:
        least[at] = min(i, least.get(at, i))
    return {i: least[at] for i, at in rows}


def edited(rnd: random.Random, words: list[str], n: int) -> str:
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.random()}"
    return " ".join(words)


def corpus() -> dict:
    """Near copies on both sides of 0.8, a hot group, a passage common to unlike texts, short and wordless texts."""
    rnd = random.Random(5)
    some = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    out = []
    for size in (30, 150, 600):
        for edits in range(1, 14):
            base = some(size)
            out += [" ".join(base), edited(rnd, base, max(1, size * edits // 500))]
    hot, passage = some(120), some(60)
    out += [edited(rnd, hot, 1 + i % 4) for i in range(60)] + [" ".join(passage + some(25)) for _ in range(30)]
    return dict(enumerate([*out, "", None, " \n", "one two", "ONE  two", "one two three", out[0].upper()]))


@pytest.mark.parametrize("bucket, batch", [(1 << 12, 1 << 16), (8, 50)])
def test_groups_are_those_of_all_similar_pairs(spark, monkeypatch, bucket, batch):
    monkeypatch.setattr(similar, "BUCKET", bucket)
    monkeypatch.setattr(similar, "BATCH", batch)
    monkeypatch.setattr(similar, "PAIRS", batch)
    texts = corpus()
    want = plain_groups(texts)
    assert grouped(spark, texts) == want and 30 < len(set(want.values())) < len(texts)


def test_no_rows_and_awkward_rows(docs, empty):
    marked, roots = similar.groups(empty.select("doc_id", "text"))
    assert marked.count() == roots.count() == 0
    marked, _ = similar.groups(docs.select("doc_id", "text"))
    assert marked.count() == docs.count()


def test_pipeline_keeps_no_near_copy_of_similarity_four_fifths(spark, sf_dir):
    import corpus_pipeline

    texts = corpus()
    want = plain_groups(texts)
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, rows, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))


def test_shingle_sets():
    assert len(similar.shingle_set(None)) == len(similar.shingle_set(b" \n")) == 0
    assert (similar.shingle_set(b"A b c d e f") == similar.shingle_set(b"a  b c d e f")).all()
    assert similar.node_of(np.array([1, 2], np.uint64)) != similar.node_of(np.array([1, 3], np.uint64))


def test_pipeline_keeps_one_row_of_a_group(spark, sf_dir):
    import corpus_pipeline

    one, two, three = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(7, one, "s"), (7, one, "s"), (7, one, "t"), (None, one, "s"), (9, one.upper(), "s"), (None, two, "s"), (None, two, "s"), (3, three, "s"), (3, two + " x", "s")]
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(3, two + " x"), (3, three), (7, one)]
