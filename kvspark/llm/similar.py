"""SimHash near-dedup at a stated shingle similarity (operator 1 with a wide error budget and an exact check behind it).

Texts whose sets of shingles have a Jaccard similarity of 0.8 differ in about ten of 64 fingerprint bits and hardly ever in
more than 18. With so wide a budget there are no blocks of bits that two fingerprints must agree on and that tell texts
apart, so the trie is joined with itself in buckets of another kind: texts that share a smallest shingle under one of
``MINS`` permutations. Two texts of similarity 0.8 share none of five with a chance of 0.2 ** 5. In a bucket, trie nodes
descend together, errors are added up, and pairs beyond the budget are pruned. What is left is confirmed on the whole sets,
which come to the bucket's task: no pair leaves it but those of a spanning forest of confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, ready, stored, utf8
from .components import components, hub_join
from .simhash import _majority, _Sets, descend, shingles

#: The least similarity, P / Q.
P, Q = 4, 5
#: Bits by which fingerprints of such texts may differ.
BUDGET = 18
#: Smallest shingles whose buckets a text enters, and further ones by which too large a bucket is divided.
MINS, FURTHER = 5, 8
#: Texts of a bucket, and shingles of theirs, that meet in one task (twice that, if a bucket is cut).
BUCKET, SHINGLES = 1 << 12, 1 << 20
#: Pairs that are confirmed at once; links found prune the next ones.
PAIRS = 1 << 12
#: The label of rows that have a near one already: where all have it, no more are asked for.
ASKED = -(1 << 40)
#: Texts whose sets are handed on at once.
ROWS = 256
#: Pairs or shingles that are worked on at once.
BATCH = 1 << 16
#: Bits of the filter that tells which texts are read again; more texts than that are only told apart less well.
FILTER = 1 << 22
_DRAW = np.random.RandomState(11)
_TURN, _FACTOR = (_DRAW.randint(0, 1 << 63, MINS + FURTHER, np.int64).astype(np.uint64) for _ in range(2))
_FACTOR = _FACTOR << np.uint64(1) | np.uint64(1)
_MINS = [f"m{i}" for i in range(MINS + FURTHER)]
EDGES = "a long, b long"


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct shingles' hashes in ascending order; empty for a text without words."""
    return np.unique(shingles(text, words))


def node_of(held: np.ndarray) -> int:
    """The name of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).view(np.int64))


def smallest(held: np.ndarray) -> np.ndarray:
    """The set's smallest shingle under each permutation; a set without shingles has zeros."""
    if not len(held):
        return np.zeros(len(_TURN), np.uint64)
    best = None
    for at in range(0, len(held), BATCH):
        own = held[at : at + BATCH]
        if best is not None:
            own = np.concatenate([best, own])
        best = own[((own[None, :] ^ _TURN[:, None]) * _FACTOR[:, None]).argmin(1)]
    return best


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``id, node, text_key, fp, n`` and the smallest shingles of every row of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = utf8(batch.column(1))
            out = np.zeros((len(texts), 4 + len(_MINS)), np.int64)
            for i, text in enumerate(texts):
                held = shingle_set(text, words)
                fp = np.uint64(_majority(held) if len(held) else 0)
                out[i, :4] = node_of(held), text_key(text), fp.view(np.int64), len(held)
                out[i, 4:] = smallest(held).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], ["id", "node", "text_key", "fp", "n", *_MINS])

    longs = ", ".join(f"{c} long" for c in ["node", "text_key", "fp", "n", *_MINS])
    return docs.mapInArrow(run, f"id {docs.schema[0].dataType.simpleString()}, {longs}")


def text_key(text: bytes | None) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text or b"")).view(np.int64))


def _sized(rows: DataFrame, total: int) -> DataFrame:
    """Rows (bucket, node, fp, n) of buckets of two or more, with the number of ``parts`` into which the bucket is cut."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n").alias("shingles")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / BUCKET), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
    return hub_join(rows, sizes.select("bucket", "n", parts.alias("parts")), "bucket", "node", total)


def _shared(nodes: DataFrame, total: int) -> DataFrame:
    """``bucket, node, fp, n, parts``: who meets whom.

    A bucket of more than BUCKET texts is divided by each of the FURTHER permutations in turn, so that two similar texts
    in it share one of the smaller buckets with a chance of 1 - 0.2 ** 8; one that is still too large is cut into parts,
    and every two parts meet.
    """
    spread = nodes.select("node", "fp", "n", F.explode(F.array_distinct(F.array(*_MINS[:MINS]))).alias("bucket"))
    met = _sized(spread, MINS * total)
    again = met.where("parts > 1").select("bucket", "node").join(nodes.select("node", "fp", "n", *_MINS[MINS:]), "node")
    again = again.select("node", "fp", "n", F.explode(F.array_distinct(F.transform(F.array(*_MINS[MINS:]), lambda m: F.xxhash64("bucket", m)))).alias("bucket"))
    return met.where("parts = 1").unionByName(_sized(again, FURTHER * MINS * total))


MEETING = "bucket long, p long, q long, fp long, node long, n long"
_KEY = ["bucket", "p", "q"]


def _dealt(shared: DataFrame) -> DataFrame:
    """Rows of one meeting together and in trie order: the columns of MEETING."""
    at = shared.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("p"), F.greatest(o, F.col("part")).alias("q")))
    met = at.select("bucket", "fp", "node", "n", F.explode(cells).alias("cell")).select("bucket", F.col("cell.p").cast("long").alias("p"), F.col("cell.q").cast("long").alias("q"), "fp", "node", "n")
    return met.repartition(*_KEY).sortWithinPartitions(*_KEY, "fp")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of whole meetings, and the sets in a seventh column if there is one."""
    held: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns[:6]], 1)
        own: list[np.ndarray] = []
        if batch.num_columns > 6:
            column = batch.column(6)
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy().copy()
            own = [flat[a:b] for a, b in zip(ends, ends[1:])]
        # The last meeting may go on in the next batch.
        same = (rows[:, :3] == rows[-1, :3]).all(1)
        cut = 0 if same.all() else len(rows) - int(np.argmin(same[::-1]))
        if cut or held and (held[0][-1, :3] != rows[0, :3]).any():
            yield np.concatenate([*held, rows[:cut]]), sets + own[:cut]
            held, sets = [], []
        held.append(rows[cut:])
        sets = sets + own[cut:]
    if held:
        yield np.concatenate(held), sets


class _Leaves:
    """The sets of rows, seen from leaves: a leaf whose rows lie in several sets has a label of its own."""

    def __init__(self, sets: _Sets, first: np.ndarray, whole: bool):
        self.sets, self.first, self.whole = sets, first, whole

    @property
    def label(self) -> np.ndarray:
        if self.whole:
            return self.sets.label[self.first]
        low, high = (f.reduceat(self.sets.label, self.first) for f in (np.minimum, np.maximum))
        return np.where(low == high, low, -1 - np.arange(len(low)))


def _pairs(rows: np.ndarray, sets: _Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one meeting each, of near fingerprints; those wholly in one set of ``sets`` are pruned."""
    new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])
    first = np.flatnonzero(new | np.concatenate([[True], rows[1:, 3] != rows[:-1, 3]]))  # a leaf is a run of equal fingerprints
    last = np.append(first[1:], len(rows))
    wide = last - first > 1
    for s, e in zip(first[wide].tolist(), last[wide].tolist()):
        for at in range(s, e - 1):
            yield np.full(e - 1 - at, at), np.arange(at + 1, e)
    starts = np.flatnonzero(new[first])
    roots = np.stack([starts, np.append(starts[1:], len(first))], 1)
    # Signed order is trie order but for the first bit, whose halves are swapped.
    leaves = np.ascontiguousarray(rows[first, 3]).view(np.uint64) ^ np.uint64(1 << 63)
    for a, b in descend(leaves, roots[roots[:, 1] - roots[:, 0] > 1], 0, BUDGET, _Leaves(sets, first, not wide.any())):
        thin = ~(wide[a] | wide[b])
        yield first[a[thin]], first[b[thin]]
        for x, y in zip(a[~thin].tolist(), b[~thin].tolist()):
            for at in range(first[x], last[x]):
                yield np.full(last[y] - first[y], at), np.arange(first[y], last[y])


def _fitting(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows may be similar by their sizes."""
    m, n = rows[a, 5], rows[b, 5]
    return Q * np.minimum(m, n) >= P * np.maximum(m, n)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have another in their meeting whose fingerprint and size are near."""
    for rows, _ in _meetings(batches):
        sets, found = _Sets(len(rows)), np.zeros(len(rows), bool)
        for a, b in _pairs(rows, sets):
            fits = _fitting(rows, a, b)
            found[a[fits]] = found[b[fits]] = True
            sets.label[found] = ASKED
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[found].T], [*_KEY, "fp", "node", "n"])


class _Overlaps:
    """Exact sizes of the intersections of many pairs of a few sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        flat = np.concatenate(sets)
        value, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        often = times > 1  # what only one set holds is in no intersection
        self.words = -(-int(often.sum()) // 64)
        self.bits = None
        if self.words * len(sets) <= 1 << 21 and self.words <= 4096:
            rank = np.cumsum(often) - 1
            keep = often[place]
            owner, at = np.repeat(np.arange(len(sets)), list(map(len, sets)))[keep], rank[place[keep]]
            self.bits = np.zeros((len(sets), max(1, self.words)), np.uint64)
            np.bitwise_or.at(self.bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())], np.int64)
        return np.bitwise_count(self.bits[a] & self.bits[b]).sum(1, dtype=np.int64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: a spanning forest of the links of each meeting. Sets that a link has joined are not compared again."""
    for rows, held in _meetings(batches):
        sets, overlaps, edges = _Sets(len(rows)), _Overlaps(held), []
        for a, b in _pairs(rows, sets):
            for at in range(0, len(a), PAIRS):
                x, y = a[at : at + PAIRS], b[at : at + PAIRS]
                open_ = (sets.label[x] != sets.label[y]) & _fitting(rows, x, y)
                x, y = x[open_], y[open_]
                if len(x):
                    linked = (P + Q) * overlaps.of(x, y) >= P * (rows[x, 5] + rows[y, 5])
                    edges += sets.union(x[linked], y[linked])
        if edges:
            a, b = (rows[np.concatenate([e[i] for e in edges]), 4] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _bits(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - FILTER.bit_length() + 1)).astype(np.int64)


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each of FILTER parts of the keys' range (one column), set if a key lies there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER, bool)
        for batch in batches:
            seen[_bits(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    tables = keys.coalesce(max(1, min(keys.rdd.getNumPartitions(), 64))).mapInArrow(run, "bits binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.uint8))
    return np.unpackbits(tables.treeAggregate(np.zeros(FILTER // 8, np.uint8), np.bitwise_or, np.bitwise_or)).astype(bool)


def _sets_of(texts: DataFrame, words: int, wanted: np.ndarray) -> DataFrame:
    """``node, held`` of the texts whose key lies in a wanted part."""
    packed = np.packbits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        for batch in _slices(batches):
            found = {}
            for text in utf8(batch.column(0)):
                if wanted[_bits(np.array([text_key(text)], np.int64))[0]]:
                    held = shingle_set(text, words)
                    found[node_of(held)] = held.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["node", "held"])

    return texts.mapInArrow(run, "node long, held array<long>")


def groups(docs: DataFrame, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """``id, node, n_copies`` of every row of ``docs`` (id, text), and ``node, root`` of the nodes that have a similar other.

    Rows of one node have equal shingle sets; texts without words share one. Nodes of one root are linked by pairs of
    similarity 0.8 or more. Each bucket's task confirms what it has to and gives a spanning forest of its links, so a group
    of near copies costs a few edges a text, not its pairs, and neither do texts that are nearly near copies. Nulls are
    empty texts; repeated rows share a node; no rows give none. Texts are read once, and those with a near fingerprint
    in a bucket again; what is shuffled is about 250 bytes a distinct text, and the sets of the latter once a bucket.
    """
    ready(docs.sparkSession)
    files = few(docs.sparkSession)
    texts = docs.select(docs.columns[1])
    marked = stored(sketches(docs, words))
    nodes = stored(marked.groupBy("node").agg(F.min("text_key").alias("text_key"), *(F.max(c).alias(c) for c in ["fp", "n", *_MINS])).coalesce(files))
    near = stored(_dealt(_shared(nodes, nodes.count())).mapInArrow(_near, MEETING))
    asked = near.select("node").distinct()
    wanted = _filter(nodes.join(asked, "node", "left_semi").select("text_key"))
    held = _sets_of(texts, words, wanted).join(asked, "node", "left_semi").groupBy("node").agg(F.first("held").alias("held"))
    met = near.join(held, "node").repartition(*_KEY).sortWithinPartitions(*_KEY, "fp")
    return marked.select("id", "node"), components(met.select(*_KEY, "fp", "node", "n", "held").mapInArrow(_linked, EDGES), files)
