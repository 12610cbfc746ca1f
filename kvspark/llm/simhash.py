"""SimHash near-dedup by a binary-trie self-join (operator 1).

Fingerprints are 64-bit SimHashes of word shingles. Equal fingerprints are one trie leaf. The trie is joined with
itself: node pairs descend together, the bits by which they differ are added up, and a pair whose errors exceed the
budget is dropped. To distribute this, the 64 bits are cut into ``budget + 2`` blocks; two fingerprints within the
budget agree on at least two whole blocks, so that for each pair of blocks the trie is built with those bits on top,
and only node pairs below an equal top (errors so far: none) need to be descended: a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored, utf8
from .components import components, hub_join

#: Node pairs that are descended at once; the rest wait, so that memory is bounded.
FRONT = 1 << 18
#: Leaves of one bucket in one task; larger buckets are cut into node pairs of this size.
BUCKET = 1 << 13
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(text: bytes | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """The hashes of a UTF-8 text's word shingles, repeats included."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    flat = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    last = ends[words - 1 :].tolist() or [len(flat)]
    starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[s:e], seed) for s, e in zip(starts, last)), np.uint64, len(last))


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text's word shingles, each counted as often as it occurs."""
    hashes = shingles(text, words, seed)
    return _majority(hashes) if len(hashes) else 0


def _majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    parts = hashes.view(np.uint8).reshape(-1, 8)
    if len(parts) < 64:
        counts = np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(parts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``id, fp`` (a signed long) of every row of ``docs`` (id, text), and ``place``, the row's number in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array(np.arange(len(fps), dtype=np.int32))], ["id", "fp", "place"])

    return docs.mapInArrow(run, f"id {docs.schema[0].dataType.simpleString()}, fp long, place int")


def layouts(budget: int, agree: int = 2) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of ``agree`` of ``budget + agree`` blocks: the bits on top, and all blocks ``(shift, width)`` in trie order.

    Two fingerprints within the budget agree on some such choice whole. More blocks that agree mean smaller buckets
    and more copies of each fingerprint: two suit up to about a billion fingerprints, three more than that.
    """
    n = budget + agree
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]
    return [(sum(blocks[i][1] for i in top), [blocks[i] for i in top] + [b for i, b in enumerate(blocks) if i not in top]) for top in combinations(range(n), agree)]


def _arranged(fp: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in trie order, the first in the highest bits."""
    out, left = np.zeros(len(fp), np.uint64), 64
    for shift, width in blocks:
        left -= width
        out |= (fp >> np.uint64(shift) & np.uint64((1 << width) - 1)) << np.uint64(left)
    return out


def _restored(leaf: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The inverse of ``_arranged``."""
    out, left = np.zeros(len(leaf), np.uint64), 64
    for shift, width in blocks:
        left -= width
        out |= (leaf >> np.uint64(left) & np.uint64((1 << width) - 1)) << np.uint64(shift)
    return out


class _Sets:
    """Union-find over the leaves of one batch; labels are smallest leaf numbers."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unites the sets of each a and its b; returns those of the pairs that did so, one for each set that went."""
        label, used = self.label, []
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            np.minimum.at(label, high, low)
            did = np.flatnonzero(label[high] == low)
            did = did[np.unique(high[did], return_index=True)[1]]
            used.append((a[did], b[did]))
            while (label[label] != label).any():
                label[:] = label[label]
        return used


def trie_links(leaves: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Labels of the components that links of at most ``budget`` differing bits make within each root.

    leaves: distinct values (uint64), sorted within each root. roots: each root's low and high in ``leaves``, int64
    of shape (n, 2). depth: the number of top bits in which all leaves of a root agree.
    """
    n = len(leaves)
    sets = _Sets(n)
    # Neighbours in trie order are the cheapest links; with them most of a dense group is one set at once.
    if n > 1:
        # Only within a root; links between buckets are true as well, but are other tasks' work.
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, roots[:, 0] + 1, 1)
        np.add.at(inside, roots[:, 1], -1)
        near = np.flatnonzero((np.bitwise_count(leaves[1:] ^ leaves[:-1]) <= budget) & (np.cumsum(inside)[1:n] > 0))
        sets.union(near, near + 1)
    for a, b in descend(leaves, roots, depth, budget, sets):
        sets.union(a, b)
    return sets.label


def descend(leaves: np.ndarray, roots: np.ndarray, depth: int, budget: int, sets: _Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves within the budget, many at once; node pairs that lie wholly in one set of ``sets`` are pruned.

    The caller may unite sets between two steps. Arguments as for ``trie_links``.
    """
    stack = [(np.concatenate([roots, roots], 1), np.zeros(len(roots), np.int64), depth)]
    while stack:
        pairs, errors, level = stack.pop()
        if len(pairs) > FRONT:
            half = len(pairs) // 2
            stack += [(pairs[half:], errors[half:], level), (pairs[:half], errors[:half], level)]
            continue
        a0, a1, b0, b1 = pairs.T
        same = (a0 == b0) & (a1 == b1)
        alive = ~(same & (a1 - a0 == 1))
        single = alive & (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            linked = np.bitwise_count(leaves[a0[single]] ^ leaves[b0[single]]) <= budget
            if linked.any():
                yield a0[single][linked], b0[single][linked]
        alive &= ~single
        # Nodes that lie wholly in one and the same set have no link left to find.
        if alive.any():
            alive[alive] = ~_one_set(sets.label, a0[alive], a1[alive], b0[alive], b1[alive])
        pairs, errors, same = pairs[alive], errors[alive], same[alive]
        if not len(pairs) or level == 64:
            continue
        a0, a1, b0, b1 = pairs.T
        am, bm = _split(leaves, a0, a1, level), _split(leaves, b0, b1, level)
        apart = errors < budget
        made = [((a0, am, b0, bm), errors, np.ones(len(a0), bool)), ((am, a1, bm, b1), errors, np.ones(len(a0), bool)),
                ((a0, am, bm, b1), errors + 1, apart), ((am, a1, b0, bm), errors + 1, apart & ~same)]
        new = [np.stack(p, 1)[k & (p[0] < p[1]) & (p[2] < p[3])] for p, _, k in made]
        err = [e[k & (p[0] < p[1]) & (p[2] < p[3])] for p, e, k in made]
        stack.append((np.concatenate(new), np.concatenate(err), level + 1))


def _split(leaves: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Where in each range of leaves the bit of this level turns to 1: a binary search of all ranges at once."""
    bit = np.uint64(63 - level)
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        ones = ((leaves[np.minimum(mid, len(leaves) - 1)] >> bit) & np.uint64(1)).astype(bool)
        high = np.where(open_ & ones, mid, high)
        low = np.where(open_ & ~ones, mid + 1, low)
    return low


def _one_set(label: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether all leaves of both ranges carry one label."""
    change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    return (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (label[a0] == label[b0])


def links(fps: DataFrame, budget: int = 4, agree: int = 2) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) whose components are those of all links.

    A bucket yields at most one edge a leaf, never its pairs. A bucket of more than BUCKET leaves is cut by a hash of
    the leaf into parts of about that size, and every two of its parts meet in a task of their own.
    """
    plans = layouts(budget, agree)
    spread = fps.select("fp").mapInArrow(_spreader(plans), "plan short, leaf long, top long")
    spread = spread.withColumn("bucket", F.shiftleft(F.col("plan").cast("long"), 48).bitwiseOR(F.col("top")))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = hub_join(spread, sizes.withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int")), "bucket", "leaf", len(plans) * fps.count())
    part = F.pmod(F.xxhash64("leaf"), F.col("parts")).cast("int")
    met = met.withColumn("part", part).select("plan", "top", "leaf", "part", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("p"), F.greatest(o, F.col("part")).alias("q")))).alias("cell"))
    met = met.select("plan", "top", "cell.p", "cell.q", "leaf")
    tasks = met.repartition("plan", "top", "p", "q").sortWithinPartitions("plan", "top", "p", "q", "leaf")
    return tasks.mapInArrow(_runner(plans, budget), "a long, b long").distinct()


def _spreader(plans: list[tuple[int, list[tuple[int, int]]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, (top, blocks) in enumerate(plans):
                leaf = _arranged(fp, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int16)), pa.array(leaf.view(np.int64)), pa.array((leaf >> np.uint64(64 - top)).view(np.int64))], ["plan", "leaf", "top"])

    return run


def _runner(plans: list[tuple[int, list[tuple[int, int]]]], budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(5)], 1)
            if held:
                rows = np.concatenate([*held, rows])
            # The last bucket may go on in the next batch.
            same = (rows[:, :4] == rows[-1, :4]).all(1)
            cut = len(rows) if not same.any() else int(np.argmax(same))
            held = [rows[cut:]]
            if cut:
                yield from _solve(rows[:cut], plans, budget)
        if held and len(held[0]):
            yield from _solve(held[0], plans, budget)

    return run


def _solve(rows: np.ndarray, plans: list[tuple[int, list[tuple[int, int]]]], budget: int) -> Iterator[pa.RecordBatch]:
    """Edges of whole buckets. Signed order and trie order differ only by the top bit, in which a bucket agrees."""
    leaves = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(1)]))
    ends = np.append(starts[1:], len(rows))
    big = ends - starts > 1
    starts, ends = starts[big], ends[big]
    if not len(starts):
        return
    label = trie_links(leaves, np.stack([starts, ends], 1), min(top for top, _ in plans), budget)
    moved = np.flatnonzero(label != np.arange(len(label)))
    for plan in np.unique(rows[moved, 0]).tolist():
        own = moved[rows[moved, 0] == plan]
        a, b = (_restored(leaves[at], plans[plan][1]).view(np.int64) for at in (own, label[own]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, budget: int = 4, agree: int = 2) -> DataFrame:
    """``id, fp, component_id`` for every row of ``docs``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; shingles are ``words`` of them, repeats
    counted; a shorter text is one shingle. Null and wordless texts have fingerprint zero and link like any other.
    component_id: the smallest id reachable over links of at most ``budget`` differing bits, the row's own included;
    null ids are never smallest, and a component of null ids alone has a null one. Repeated rows stay, each with the
    same result. No rows: no rows. Other columns are not read. Texts are read once; what is shuffled are fingerprints. The rows
    of a frequent fingerprint, and the fingerprints of a large component, are dealt over several tasks.
    """
    ready(docs.sparkSession)
    marked = stored(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words))
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    texts, rows = distinct.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    roots = components(links(distinct.select("fp"), budget, agree))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = hub_join(rooted, least, "root", "fp", texts).select("fp", "component_id", F.col("copies").alias("n"))
    return hub_join(marked, of, "fp", "place", rows).select(F.col("id").alias(id_col), "fp", "component_id")
