"""Chat formatting, decontamination, fingerprints, tokens, packing and sharding against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvspark.llm import chat, decontaminate, fingerprint, packing, sharding, tokens
from kvspark.llm.queries import tokenizer_path

from .conftest import documents

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# Chat


TURNS = "conv_id long, turn long, role string, parts " + chat.PARTS


def turn(conv, n, role, *parts):
    return conv, n, role, [(k, t, r, u) for k, t, r, u in parts]


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "<|end|>", "\\e\\l\\g", "<|turn user|>\\", "<<|>|>|", "", "\\", "|", "<", "日本 🙂\n\n", "<|image 0.0|>"]
    rows = [turn(1, i, "assistant" if i % 2 else "us<|er|>\\", ("text", t, None, None)) for i, t in enumerate(hard)]
    rows += [turn(2, 5, None, ("text", None, None, None)), turn(2, None, "assistant", ("text", "first", None, None)), (2, 6, "user", None), turn(None, 0, "user", ("text", "lost", None, None))]
    rows += [turn(3, 1, "user", ("text", "tie b", None, None)), turn(3, 1, "user", ("text", "tie a", None, None)), turn(3, 1, "user", ("text", "tie a", None, None))]
    chats = chat.format_chat(spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("mine"))).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in chats.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "us<|er|>\\", t) for i, t in enumerate(hard)]
    assert got[1].loss == "".join(hard[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "first"), ("", ""), ("user", "")]
    assert [t.text for t in got[3].turns] == ["tie a", "tie a", "tie b"]
    assert got[None].turns[0].text == "lost" and len(got) == 4


def test_chat_parts(spark):
    rows = [turn(1, 0, "user", ("text", "see ", None, None), ("image", None, "a.png", 392.0), ("text", " and <|image 9.9|>", None, None), ("audio", None, "b.wav", 1.5)), turn(1, 1, "assistant", ("document", None, "c.pdf", 2.0), ("image", None, None, None))]
    got = chat.format_chat(spark.createDataFrame(rows, TURNS)).head()
    assert got.formatted == "<|turn user|>see <|image 0.1|> and \\limage 9.9\\g<|audio 0.3|><|end|><|turn assistant|><|document 1.0|><|image 1.1|><|end|>"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in got.attachments] == [(0, 1, "image", "a.png", 2), (0, 3, "audio", "b.wav", 38), (1, 0, "document", "c.pdf", 2048), (1, 1, "image", None, 0)]
    assert got.attachment_tokens == 2088
    assert chat.digests(chat.format_chat(spark.createDataFrame([], TURNS))).count() == 0


def test_chat_runs_no_python(spark, sf_dir):
    from kvspark.llm.queries import QUERIES

    plan = QUERIES["op2_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Decontamination


def plain_hits(text, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = cut(text)
    hit, names = set(), set()
    for name, item in items:
        w = cut(item)
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(found) - n + 1):
            if tuple(found[i : i + n]) in wins:
                hit.update(range(i, i + n))
                names.add(str(name))
    return len(found), hit, names


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_decontamination_against_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abcde") for _ in range(n))
    items = [(i, text(rnd.randint(1, 9))) for i in range(12)] + [(12, None), (13, "..."), (14, "é-È 7"), (15, "a b c a b c a b c"), (15, "c c c c c c")]
    texts = [text(rnd.randint(0, 60)) for _ in range(25)] + [None, "", "É é È 7", "A,B;c!a-b/c a b c a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.marked(docs, bench, window=4).collect():
        n, hit, names = plain_hits(texts[r.id], items, 4)
        assert (r.n_words, {p for s in r.spans for p in range(s.start, s.stop)}, r["items"]) == (n, hit, sorted(names))
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_decontaminate_cuts_spans_and_drops_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Clean words before. {item.upper()}! And a good deal of clean text that goes on behind it for quite some while longer", "k"), (2, item, "k"), (3, "clean", None), (4, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, max_coverage=0.5).collect()}
    assert got[1].text == "Clean words before. ! And a good deal of clean text that goes on behind it for quite some while longer"
    assert set(got) == {1, 3, 4} and got[3].text == "clean" and got[4].text is None and got[1].spans == "k"
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench, max_coverage=0.0).collect()} == {3, 4}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 4
    assert decontaminate.marked(docs.limit(0), bench).count() == 0
    assert decontaminate.marked(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


# Fingerprints


def test_collision_rate_is_generalised_jaccard():
    sampler = fingerprint.Sampler(samples=2048)
    rnd = random.Random(1)
    for share in (0.0, 0.3, 0.6, 0.9):
        a = Counter({f"w{i}": rnd.randint(1, 9) for i in range(150)})
        b = Counter({(k if rnd.random() < share else k + "x"): rnd.choice([v, v, 2 * v]) for k, v in a.items()})
        jaccard = sum(min(a[k], b[k]) for k in a | b) / sum(max(a[k], b[k]) for k in a | b)
        text = lambda c: " ".join(k for k, v in c.items() for _ in range(v)).encode()
        assert abs(fingerprint.likeness(sampler.of(text(a)), sampler.of(text(b))) - jaccard) < 0.05


def test_long_texts_are_scored_in_blocks(monkeypatch):
    sampler, text = fingerprint.Sampler(), " ".join(f"w{i % 700}" for i in range(2000)).encode()
    whole = sampler.of(text)
    monkeypatch.setattr(fingerprint, "BLOCK", 64)
    assert sampler.of(text) == whole


@pytest.mark.parametrize("parts", [1, 4])
def test_against_next(spark, docs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in fingerprint.against_next(docs.dropDuplicates(["doc_id"])).collect()}
        own = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
        repeated = fingerprint.against_next(docs).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    text = {i: t or "" for i, t, *_ in documents()}
    ids = sorted(text)
    assert set(got) == set(ids) and repeated == docs.count()
    for i, after in zip(ids, ids[1:] + ids[:1]):
        cut = len(text[i]) // 4
        edited = text[i][: len(text[i]) - cut] + text[after][:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text[i]), hashlib.sha256(edited.encode()).hexdigest(), own[i])
        assert r.edited_fingerprint == fingerprint.Sampler().of(edited.encode()).hex() and 0 <= r.near_edited <= 1
        if text[i] == text[after]:
            assert r.near_next == 1


def test_against_next_gives_few_files(spark, docs):
    """Ranges are as many as shuffle partitions, files are not; what a task takes one after another is as it was."""
    rows = docs.dropDuplicates(["doc_id"])
    want = sorted(map(tuple, fingerprint.against_next(rows).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = fingerprint.against_next(rows)
        assert found.rdd.getNumPartitions() <= 16
        assert sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_against_next_of_few_rows(spark, empty, nameless):
    assert fingerprint.against_next(empty).count() == 0
    one = fingerprint.against_next(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprint.against_next(nameless).count() == 4


# Tokens


PIECES = st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "é", "ñ", "1", "23", "½", "!", "?!", "_", "<|endoftext|>", "<|", "|>", "𝔸", "　", "\xa0", "\x1c", "\x85", "՘", "中文", "ing", "tion", " word", "\r\n", "aaaa", "-----"]), max_size=10).map("".join)


@given(PIECES)
@settings(max_examples=250, deadline=None)
def test_every_prefix_counts_as_the_library_counts_it(library, text):
    counter = tokens.loaded(tokens.Prefixes, PATH)
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.of_text(text).tolist() == want and counter.count([text, text]) == [want[-1]] * 2


@given(st.lists(st.text(max_size=40) | PIECES, max_size=8))
@settings(max_examples=150, deadline=None)
def test_whole_counts_and_ids(library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.loaded(tokens.Prefixes, PATH).count(texts) == [len(x) for x in want]
    ids = tokens.loaded(packing.Ids, PATH)
    assert [np.frombuffer(ids.of(t), "<u4").tolist() for t in texts] == want


def test_libraries_agree_on_common_code_points(library):
    """The words of every code point that is cut without the tokenizer's own cutter."""
    words = tokens.Words(PATH)
    for c in [*range(0x530), *range(0x2010, 0x2028), 0x20AC]:
        text = f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}!{chr(c)}'s"
        assert words.plain(text)
        assert words.cut(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_count_tokens_rows(docs, empty, library):
    text = {i: t or "" for i, t, *_ in documents()}
    rows = tokens.count_tokens(docs, PATH, prefixes=True).withColumn("at5", tokens.fit(F.lit(5))).withColumn("fits7", tokens.within(7)).collect()
    assert len(rows) == docs.count()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in rows:
        t = text[r.doc_id]
        assert (r.n_bytes, r.n_tokens, len(r.prefix_tokens), r.at5) == (len(t.encode()), count(t), len(t) + 1, count(t[:5]))
        assert count(t[: r.fits7]) <= 7 and tokens.loaded(tokens.Prefixes, PATH).longest_within(np.array(r.prefix_tokens), 7) == r.fits7
    short = {(r.doc_id, r.n_tokens) for r in tokens.count_tokens(docs, PATH).collect()}
    assert short == {(r.doc_id, r.n_tokens) for r in rows}
    assert tokens.count_tokens(empty, PATH).count() == 0


# Packing


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
@settings(max_examples=100, deadline=None)
def test_patterns_hold_every_piece(histogram):
    found = packing.patterns(histogram, 64)
    assert all(0 < sum(own) <= 64 and n > 0 for own, n in found)
    assert Counter({k: v for k, v in sum((Counter({k: v * n for k, v in Counter(own).items()}) for own, n in found), Counter()).items()}) == Counter(histogram)


@pytest.mark.parametrize("length", [16, 1024])
def test_pack_rows(docs, empty, library, length):
    rows = packing.pack(docs, PATH, length=length).collect()
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t, *_ in documents()}
    times = Counter(r.doc_id for r in docs.collect())
    covered, sequences = Counter(), {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and 0 < r.length <= length
        covered.update((r.doc_id, p) for p in range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == Counter({(i, p): times[i] for i in ids for p in range(len(ids[i]))})
    for own in sequences.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= length
    assert sum(r.length for r in rows) / (length * len(sequences)) > 0.9
    assert packing.pack(empty, PATH).count() == 0


def test_pieces_are_stored_in_few_files(docs, monkeypatch):
    """Files, each of which costs an executor a child process, are as few as the pieces ask for, however many tasks encode."""
    seen = []
    monkeypatch.setattr(packing, "stored", lambda df, f=packing.stored: seen.append(f(df)) or seen[-1])
    got = packing.pack(docs.repartition(16), PATH, length=64)
    assert seen[0].rdd.getNumPartitions() == 1
    want = packing.pack(docs.coalesce(1), PATH, length=64)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)
    assert got.select("sequence_id", "offset").distinct().count() == got.count()


# Sharding


def test_shard_rows(spark, docs, empty):
    many = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text in a third of all rows', repeat(CAST(id * 7919 AS STRING), CAST(1 + id % 9 AS INT))) AS text", "1 AS shard", "'x' AS k1")
    for df, shards in ((many, 24), (docs, 5)):
        rows = sharding.shard(df, shards=shards).collect()
        source = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == source
        sums, counts = Counter(), Counter()
        for r in rows:
            sums[r.shard] += r["size"]
            counts[r.shard] += 1
        assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s, n in counts.items() for i in range(n))
        largest, ideal = max(r["size"] for r in rows), sum(sums.values()) / shards
        assert all(abs(sums[s] - ideal) <= largest for s in range(shards))
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(docs.limit(1)).collect()[0].slot == 0


def test_splitters_follow_the_weights():
    sample = np.rec.fromarrays([np.arange(100), np.zeros(100, np.int64), np.r_[np.ones(50), np.full(50, 3.0)]], names="k1,k2,w")
    s1, s2 = sharding.splitters(sample, 4)
    assert s1.tolist() == [49, 66, 83] or abs(s1[0] - 50) <= 1
    assert sharding.range_of(np.array([0, s1[0], 99]), np.zeros(3, np.int64), s1, s2).tolist() == [0, 1, 3]


# Long texts


LONG = {
    "blanks": "a" + " " * 2_000_000 + "b", "newlines": "\n" * 2_000_000 + "x", "letters": "x" * 2_000_000, "one word of other letters": "漢字" * 300_000,
    "other letters": "".join(random.Random(1).choice("中文字漢，。のはعربي") for _ in range(400_000)), "marks": "漢" + "!?" * 100_000 + "'" * 70_000 + "s" * 100_000 + "　" * 70_000 + "x漢",
}


@pytest.mark.parametrize("name", LONG)
def test_ids_of_long_texts(library, name):
    assert np.array_equal(np.frombuffer(packing.Ids(PATH).of(LONG[name]), "<u4"), library.encode(LONG[name], add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x", "ab", "漢", "é", " ", "  ", "\n", "\t", "1", "'", "'re", "s", "!", "　", "<|endoftext|>", "word "]), min_size=20, max_size=200).map("".join))
def test_slices_are_cut_without_a_trace(library, text):
    ids = packing.Ids(PATH) if not hasattr(test_slices_are_cut_without_a_trace, "ids") else test_slices_are_cut_without_a_trace.ids
    test_slices_are_cut_without_a_trace.ids = ids
    before = packing.SLICE, packing.KEPT
    packing.SLICE, packing.KEPT = 12, 6
    try:
        got = np.frombuffer(ids.of(text), "<u4").tolist()
    finally:
        packing.SLICE, packing.KEPT = before
    assert got == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        whole = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        (tmp_path / "v.json").write_text(json.dumps(whole | change), encoding="utf-8")
        with pytest.raises(ValueError):
            packing.Ids(str(tmp_path / "v.json"))
