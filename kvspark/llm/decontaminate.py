"""Benchmark decontamination with a generalised suffix automaton (operator 3).

The normalised test items become one automaton over words: every run of words in any item is a path from its start.
Training texts are streamed through it; at each word the state is the longest suffix read so far that occurs in an
item. Where that length reaches a window's, the window's words are hit; the state's item set says whose they are.
Words that no item has lead back to the start, so only runs of known words are streamed at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ready, utf8, written

#: ASCII bytes that are no word characters become blanks; capitals become small; bytes of other code points stay.
_TABLE = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256)).lower()
_WORD = re.compile(rb"[^ ]+")
#: UTF-8 bytes of test items in one automaton. More items make more automata, each streamed over all texts.
BLOCK_BYTES = 1 << 20


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """A suffix automaton of several word sequences, with the items each state's windows belong to.

    items: (item id, words). window: words a window has; an item of fewer words is one window of all of them.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        #: The same, once all is built, as one map from ``state << 32 | word``.
        self.step: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        holders: list[set[str]] = [set()]
        ends: list[tuple[int, int, str]] = []
        for name, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
            holders += [set() for _ in range(len(self.length) - len(holders))]
            state = 0
            for word in sequence:  # every prefix's own state; its suffixes follow over links
                state = self.next[state][self.vocabulary[word]]
                holders[state].add(name)
            if 0 < len(sequence) < window:
                ends.append((state, len(sequence), name))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for state in order:
            if self.length[self.link[state]] >= window:
                holders[self.link[state]] |= holders[state]
        # Whole short items that are suffixes of a state's paths: (words, item), found over links from short to long.
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.length)
        for state, n, name in ends:
            self.short[state] += ((n, name),)
        for state in reversed(order):
            if self.link[state] > 0 and self.short[self.link[state]]:
                self.short[state] += self.short[self.link[state]]
        self.items = [tuple(sorted(x)) if n >= window else () for x, n in zip(holders, self.length)]
        self.least = min([window, *(n for _, n, _ in ends)])
        self.step = {state << 32 | word: to for state, following in enumerate(self.next) for word, to in following.items()}
        self.next = []

    def _extend(self, last: int, word: int) -> int:
        """The state for the path of ``last`` and one more word (Blumer et al.), in the form for several sequences."""
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, word, q)
        made = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._copy(p, word, q)
        return made

    def _copy(self, p: int, word: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint rising spans ``[start, end)`` of hit words, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, text, repeat(-1)), np.int32, len(text))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not len(edge):
            return spans, found
        starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= self.least
        step, link, size = self.step, self.link, self.length
        for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
            state, n = 0, 0
            for i, word in enumerate(ids[start:stop].tolist(), start):
                while (to := step.get(state << 32 | word)) is None and state:
                    state = link[state]
                    n = size[state]
                if to is None:
                    continue
                state, n = to, n + 1
                # The state's paths may all be longer than what was read of a window; go to the state of the last words.
                hit = 0
                if n >= self.window:
                    hit, at = self.window, state
                    while size[link[at]] >= self.window:
                        at = link[at]
                    found.update(self.items[at])
                for length, name in self.short[state]:
                    if length <= n:
                        hit = max(hit, length)
                        found.add(name)
                if hit:
                    low = i + 1 - hit
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append((low, i + 1))
        return spans, found


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Normalised items, in blocks of bounded size; the caller holds one block and the next."""
    block, size = [], 0
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    for name, text in rows.toLocalIterator():
        block.append((name, words(bytes(text or b""))))
        size += len(text or b"")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def marked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``id, n_words, spans array<struct<start,stop>>, items array<string>`` for every row of ``docs``.

    spans: the word positions that lie in an occurrence of a window of any item, as disjoint rising ranges; items: the
    ids, as sorted text, whose windows occur. Null texts have no words; items that are null, wordless or without an id
    have no window; items that share an id count once. No items: no spans. No rows: no rows. The items' automata are the
    only thing sent to all tasks: blocks of BLOCK_BYTES of item text, each streamed over all texts in turn.
    """
    spark = docs.sparkSession
    ready(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {narrow.schema[0].dataType.simpleString()}, n_words long, spans array<struct<start:int,stop:int>>, items array<string>"
    kind = f"{schema}, text string"
    out = narrow.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:int,stop:int>>"), "items": F.array().cast("array<string>")}).select("id", "n_words", "spans", "items", "text")
    return _streamed(out, _blocks(items, item_id, item_text), window, lambda held: _streamer(held), kind, lambda held: _streamer(held), kind).drop("text")


def _streamed(out: DataFrame, blocks: Iterator[list[tuple[str, list[bytes]]]], window: int, mark, schema, last, last_schema) -> DataFrame:
    """Each block's automaton over all rows: ``mark`` for all but the last, ``last`` for that.

    One automaton is held at a time, here and by the tasks: what a block marked is written to the shared folder before
    the next block begins, and the table before it goes. Most benchmarks are one block and nothing is written.
    """
    spark = out.sparkSession
    block, path = next(blocks, []), None
    while (after := next(blocks, None)) is not None:
        held = spark.sparkContext.broadcast(Automaton(block, window))
        old = path
        out, path = written(out.mapInArrow(mark(held), schema))
        held.destroy()
        if old:
            discard(spark, old)
        block = after
    return out.mapInArrow(last(spark.sparkContext.broadcast(Automaton(block, window))), last_schema)


_SPANS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _streamer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = held.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text, old, known in zip(utf8(batch.column(4)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = words(text)
                own, names = automaton.match(found)
                n_words.append(len(found))
                spans.append([{"start": a, "stop": b} for a, b in united(own, [(x["start"], x["stop"]) for x in old])])
                items.append(sorted(names.union(known)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS_TYPE), pa.array(items, pa.list_(pa.string())), batch.column(4)], ["id", "n_words", "spans", "items", "text"])

    return run


def united(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The positions of two lists of spans, as disjoint rising spans."""
    if not b:
        return a
    out: list[tuple[int, int]] = []
    for start, stop in sorted(a + b):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    out, done = [], 0
    for start, stop in spans:
        out.append(text[done : at[start][0]])
        done = at[stop - 1][1]
    return b"".join([*out, text[done:]])


#: Carries the spans of earlier blocks beside the columns of the documents.
_SPANS = "_decontaminate_spans"


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.2) -> DataFrame:
    """``docs`` without the text of benchmark items: hit spans are cut out; documents hit in more than ``max_coverage``
    of their words go. With ``max_coverage`` 0 every document with a span goes. All columns are kept, texts that are
    not hit byte for byte. The spans of all blocks of items are united on the whole text before it is judged and cut, so
    the result does not depend on how items fall into blocks. Null, empty and wordless texts have no span and stay;
    items that are null, wordless or without an id have no window; repeated rows are judged alike. No items: all rows
    stay; no rows: no rows. Only a column of the name ``_decontaminate_spans`` would clash and is refused.
    """
    ready(docs.sparkSession)
    if _SPANS in docs.columns:
        raise ValueError(f"a column is named {_SPANS}")
    marked_type = "array<struct<start:int,stop:int>>"
    out = docs.withColumn(_SPANS, F.array().cast(marked_type))

    def judged(held, final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton: Automaton = held.value
            for batch in batches:
                texts, keep, spans = utf8(batch.column(text_col)), [], []
                for i, (text, old) in enumerate(zip(texts, batch.column(_SPANS).to_pylist())):
                    found = words(text)
                    own = united(automaton.match(found)[0], [(x["start"], x["stop"]) for x in old])
                    spans.append([{"start": a, "stop": b} for a, b in own])
                    keep.append(sum(b - a for a, b in own) <= max_coverage * len(found))
                    if final and own and keep[-1]:
                        texts[i] = _cut(text, own)
                made = {text_col: pa.array(texts, pa.binary()).cast(pa.string())} if final else {_SPANS: pa.array(spans, _SPANS_TYPE)}
                names = [x for x in batch.schema.names if not final or x != _SPANS]
                cut = pa.RecordBatch.from_arrays([made[x] if x in made else batch.column(x) for x in names], names)
                yield cut.filter(pa.array(keep, pa.bool_())) if final else cut

        return run

    return _streamed(out, _blocks(items, item_id, item_text), window, lambda held: judged(held, False), out.schema, lambda held: judged(held, True), docs.schema)


def item_digest(names: "F.Column") -> "F.Column":
    return F.sha2(F.concat_ws(",", names).cast("binary"), 256)
