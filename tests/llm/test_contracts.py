"""The registered queries against their contracts, and plain versions of the two classifiers."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvspark.llm import chat, decontaminate, fingerprint, language, line_dedup, quality, sharding
from kvspark.llm.queries import QUERIES, tokenizer_path

from .conftest import words
from .test_dedup import plain_components, plain_fingerprint, plain_lines
from .test_texts import TURNS, turn


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows_of(spark, sf_dir, name):
    found = next(f for n, f in QUERIES.items() if n.startswith(name))(spark, sf_dir)
    return dict(found.dtypes), found.collect()


def test_op1(spark, sf_dir, texts):
    kinds, rows = rows_of(spark, sf_dir, "op1_")
    assert kinds == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], list(fp))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, f"{fp[i]:016x}", want[i]) for i in fp)


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name, modulus, held", [("op4_", 5, 0), ("op6_", 3, 1)])
def test_op4_and_op6(spark, sf_dir, texts, name, modulus, held):
    kinds, rows = rows_of(spark, sf_dir, name)
    assert {r.doc_id: r.held_out for r in rows} == {i: crc(i) % modulus == held for i in texts} and len(rows) == len(texts)
    assert all(0 <= r.score <= 1 for r in rows) and kinds["score"] == "double" and kinds["held_out"] == "boolean"
    if name == "op4_":
        assert kinds["lang_pred"] == "string" and all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) for r in rows)
    else:
        assert kinds["predicted"] == "int" and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_op7(spark, sf_dir, texts):
    kinds, rows = rows_of(spark, sf_dir, "op7_")
    ids = sorted(texts)
    text = {i: texts[i] or "" for i in ids}
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    own = {r.doc_id: r for r in rows}
    assert sorted(own) == ids and len(rows) == len(ids) and kinds["n_chars"] == "bigint" and kinds["near_next"] == "double"
    for i in ids:
        cut = len(text[i]) // 4
        edited = text[i][: len(text[i]) - cut] + text[after[i]][:cut]
        assert (own[i].n_chars, own[i].edited_sha256) == (len(text[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert own[i].near_next == fingerprint.likeness(bytes.fromhex(own[i].fingerprint), bytes.fromhex(own[after[i]].fingerprint))
        assert own[i].near_edited == fingerprint.likeness(bytes.fromhex(own[i].fingerprint), bytes.fromhex(own[i].edited_fingerprint))


def test_op8_and_op9(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    kinds, rows = rows_of(spark, sf_dir, "op8_")
    assert kinds == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    got, ends = Counter(), {}
    for r in rows:
        whole = np.array([*ids[r.doc_id], 0], "<u4")
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(whole)
        got[r.doc_id] += r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert got == {i: len(x) + 1 for i, x in ids.items()}
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    kinds, rows = rows_of(spark, sf_dir, "op9_")
    assert kinds["over_limit"] == "boolean" and kinds["n_tokens"] == kinds["n_bytes"] == "bigint"
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((i, len((t or "").encode()), len(ids[i]), len(ids[i]) > 512) for i, t in texts.items())


def test_op10(spark, sf_dir, texts):
    kinds, rows = rows_of(spark, sf_dir, "op10_")
    assert (kinds["shard"], kinds["slot"], kinds["grown_shard"], kinds["text_crc32"]) == ("int", "bigint", "int", "bigint") and {r.law for r in rows} == {"bytes"}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    for shard in range(24):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    largest = max(r.size for r in rows)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert all(abs(sums[s] - sum(sums.values()) / 24) <= largest for s in range(24))


def test_op2_op3_op5_columns(spark, sf_dir):
    kinds, rows = rows_of(spark, sf_dir, "op2_")
    assert any(r.conv_id == -7 and r.n_turns == 2 for r in rows) and kinds["loss_sha256"] == "string"
    assert rows_of(spark, sf_dir, "op3_")[0]["contaminated"] == "boolean" and rows_of(spark, sf_dir, "op5_")[0]["n_dropped"] == "bigint"


# Plain versions


def plain_mixture(model: language.Mixture, text: bytes) -> tuple[np.ndarray, float]:
    """The proportions and the penalised likelihood of the best nested set, by long plain EM over every size."""
    bucket, c = language.trigrams(text)
    p, c = model.p[bucket].astype(float), np.asarray(c, float)
    n, k_all = c.sum(), p.shape[1]

    def em(members: list[int], rounds: int) -> tuple[np.ndarray, float]:
        share = np.zeros(k_all)
        share[members] = 1 / len(members)
        for _ in range(rounds):
            w = p * share
            share = (w * (c / w.sum(1))[:, None]).sum(0) / n
        return share, float((c * np.log((p * share).sum(1))).sum())

    order = np.argsort(-em(list(range(k_all)), language.ROUNDS)[0], kind="stable")
    best = int((c[:, None] * np.log(p)).sum(0).argmax())
    share, value = np.eye(k_all)[best], em([best], 1)[1] / language.OVERLAP
    for k in range(2, k_all + 1):
        own, like = em(order[:k].tolist(), language.ROUNDS)
        like = like / language.OVERLAP - (k - 1) * language.PRICE * np.log1p(n)
        if like > value:
            share, value = own, like
    return share, value


def test_mixtures_against_plain_em():
    rnd = np.random.default_rng(4)
    tongues = {f"l{j}": ["".join(chr(97 + int(x)) for x in rnd.integers(0, 26, rnd.integers(2, 8))) for _ in range(40)] for j in range(6)}
    counts = np.zeros((6, language.BUCKETS))
    say = lambda j, n: " ".join(rnd.choice(tongues[f"l{j}"], n))
    for j in range(6):
        bucket, c = language.trigrams(say(j, 3000).encode())
        counts[j, bucket] += c
    model = language.Mixture(list(tongues), counts)
    texts = [say(j, 60) for j in range(6)] + [" ".join(say(j, 40) for j in js) for js in ((0, 1), (2, 3, 4), (0, 2, 4, 5), (0, 1, 2, 3, 4), range(6))] + ["x", "ab", say(3, 4000)]
    found = [language.trigrams(t.encode()) for t in texts]
    chosen, _ = model.infer(found)
    for text, own in zip(texts, chosen):
        share, _ = plain_mixture(model, text.encode())
        assert np.allclose(own, share, atol=5e-3), (text[:40], own, share)
    assert [(own > 0.01).sum() for own in chosen[6:11]] == [2, 3, 4, 5, 6]


def test_scores_are_sums_of_tables():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(float)
    model = quality.train(x, y, rounds=20)
    for row, got in zip(x[:50], model.score(x[:50])):
        logit = model.intercept + sum(table[sum(cut <= value for cut in cuts)] for cuts, table, value in zip(model.cuts, model.tables, row))
        logit += sum(table[sum(cut <= row[f] for cut in model.coarse[f]), sum(cut <= row[k] for cut in model.coarse[k])] for f, k, table in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-logit))) < 1e-9


def test_a_frequent_id_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, None), (3, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert quality.learn(docs, labels).intercept == pytest.approx(np.log(1.5 / 2.5), abs=1e-6)


# Awkward inputs


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="<|>\\elgabturn end\x01\x02 x", min_size=1, max_size=30), st.lists(st.integers(0, 30), max_size=5))
def test_any_split_of_a_text_reads_back_the_same(spark, text, cuts):
    cuts = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    parts = [("text", text[a:b], None, None) for a, b in zip(cuts, cuts[1:])]
    image = ("image", None, "a.png", 1.0)
    said = [turn(1, 0, "user", *parts), turn(1, 1, "assistant", *parts, ("text", None, None, None)), turn(2, 0, "assistant", ("text", text, None, None), image, ("text", text, None, None))]
    made = chat.format_chat(spark.createDataFrame(said, TURNS).coalesce(1))
    got = {r.conv_id: r for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(x) for x in got[1].t] == [("user", text), ("assistant", text)] and got[1].loss == text
    assert [tuple(x) for x in got[2].t] == [("assistant", f"{text}<|image 0.1|>{text}")]


@pytest.mark.parametrize("limit", [0.0, 0.3, 1.0])
def test_blocks_of_items_do_not_change_what_is_cut(spark, monkeypatch, limit):
    rnd = random.Random(8)
    said = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    docs = spark.createDataFrame([(i, said(rnd.randint(0, 50))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, said(6)) for i in range(9)], "item_id long, text string").coalesce(1)
    cut = lambda: sorted((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items, window=4, max_coverage=limit).collect())
    whole = cut()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    assert cut() == whole


def test_a_state_of_runs_goes_on(spark, tmp_path):
    rows = [(i, "\n".join(words(s, 4) for s in random.Random(i).sample(range(30), 6))) for i in range(24)]
    at = f"file://{tmp_path}/state"
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    got = [(r.doc_id, r.text) for a in (0, 8, 16) for r in line_dedup.dedup_lines(frame(rows[a : a + 8]), batches=2, at=at).collect()]
    assert sorted(got) == sorted(plain_lines(rows))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, words(i, 12)) for i in range(80)] + [(5, words(100 + i, 12)) for i in range(80)] + [(5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r.doc_id for r in fingerprint.against_next(docs).collect()) == Counter(i for i, _ in rows)
    keyed = docs.select(F.coalesce("doc_id", F.lit(fingerprint.FIRST)).alias("k"), F.xxhash64("text").alias("tie"))
    assert len(fingerprint._cuts(keyed, 8)[0]) == 7


def test_equal_rows_are_spread_over_shards(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 400 + [(i, f"other {i}") for i in range(2, 202)], "doc_id long, text string")
    rows = sharding.shard(docs, shards=6).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r.size for r in rows)


def test_collision_rate_of_many_terms():
    """More terms than rows in the tables of variates, so that terms share them."""
    sampler, rnd = fingerprint.Sampler(samples=1024), random.Random(6)
    a = Counter({f"w{i}": rnd.randint(1, 5) for i in range(20_000)})
    b = Counter({(k if rnd.random() < 0.7 else k + "x"): v for k, v in a.items()})
    jaccard = sum(min(a[k], b[k]) for k in a | b) / sum(max(a[k], b[k]) for k in a | b)
    text = lambda c: " ".join(k for k, v in c.items() for _ in range(v)).encode()
    assert abs(fingerprint.likeness(sampler.of(text(a)), sampler.of(text(b))) - jaccard) < 0.05
