"""Packing by shortest-pack-first over the length histogram (operator 8).

Documents become token ids with one id 0 at the end and are cut at every multiple of the sequence length; what is left
over is a shorter piece. Only the histogram of piece lengths goes to the driver. There, lengths are placed longest
first, each into the pack pattern that is shortest so far, and patterns carry counts, so that the work depends on
the number of lengths and not on that of pieces. Patterns are joined back to pieces by rank among equal lengths.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored, utf8
from .tokens import WORDS, Words, byte_alphabet, loaded


#: Code points that a library is given at once.
SLICE = 1 << 16
#: Tokens of a long word that may be given back.
KEPT = 256
#: Rows that are encoded before their pieces are handed on.
ROWS = 256
#: Shuffle partitions whose pieces are stored as one file.
TOGETHER = 8
#: Between a letter or digit and a blank behind it every library begins a new word.
_BORDER = regex.compile(r"[A-Za-z0-9](?=[ \n])")
_LAST_BORDER = regex.compile(r"(?r)[A-Za-z0-9](?=[ \n])")


class Ids:
    """Token ids of texts, as the ``tokenizers`` file at ``path`` gives them, as little-endian unsigned 32-bit numbers.

    The file's vocabulary is a byte-level BPE whose ids are the merges' ranks, so ordinary text is encoded by the faster
    library for such ranks. Special strings, and texts with code points on which the two libraries' Unicode tables may
    differ, are left to the file's own tokenizer. Both see at most ``SLICE`` code points at once; where a text has no
    place to cut it in, its words are cut here and encoded one by one.
    """

    def __init__(self, path: str):
        import tiktoken

        self.words = Words(path)
        back = {letter: byte for byte, letter in enumerate(byte_alphabet())}
        vocabulary, merges = self.words.model()
        if any(vocabulary[a + b] >= vocabulary[c + d] for (a, b), (c, d) in zip(merges, merges[1:])):
            raise ValueError("the vocabulary's ids are not in order of merging")
        ranks = {bytes(map(back.__getitem__, token)): i for token, i in vocabulary.items() if token not in self.words.special}
        self.library = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if len(text) <= SLICE:
            return self._short(text)
        return b"".join(self._long(text))

    def _short(self, text: str) -> bytes:
        if self.words.plain(text):
            return self.library.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _long(self, text: str) -> Iterator[bytes]:
        for segment, special in self.words.segments(text):
            if special:
                yield np.array([self.words.special_ids[segment]], "<u4").tobytes()
                continue
            at = 0
            while at < len(segment):
                if len(segment) - at <= SLICE:
                    end, whole = len(segment), True
                elif m := _LAST_BORDER.search(segment, at, at + SLICE):
                    end, whole = m.end(), True
                else:
                    m = _BORDER.search(segment, at + SLICE - 1)
                    end, whole = m.end() if m else len(segment), False
                own = segment[at:end]
                if whole:
                    yield self._short(own)
                else:
                    for word in self._words(own):
                        yield from self._word(word.encode("utf-8", "replace"))
                at = end

    def _word(self, word: bytes) -> Iterator[bytes]:
        """The ids of one word. Tokens side by side are a word's encoding if every two neighbours are that of their own bytes."""
        encode, bytes_of = self.library._encode_single_piece, self.library.decode_single_token_bytes
        at, held = 0, []
        while at < len(word):
            new = encode(word[at : at + SLICE])
            if held and encode(bytes_of(held[-1]) + bytes_of(new[0])) != [held[-1], new[0]]:
                # The window before saw too little of the word: give its last token back.
                at -= len(bytes_of(held.pop()))
                if not held:
                    raise ValueError("a word whose encoding has no border within a window")
                continue
            at += SLICE
            if at < len(word):
                kept = max(1, len(new) - KEPT)
                at -= sum(len(bytes_of(x)) for x in new[kept:])
                new = new[:kept]
            held += new
            yield np.array(held[:-KEPT], "<u4").tobytes()
            held = held[-KEPT:]
        yield np.array(held, "<u4").tobytes()

    def _words(self, text: str) -> Iterator[str]:
        if self.words.plain(text):
            yield from (m[0] for m in self.words.pattern.finditer(text))
            return
        at, end = 0, SLICE
        while at < len(text):
            # A word that outgrows its window goes on from its last character, which is of the word's kind unless it
            # may begin a suffix or a blank word; then the whole window is taken anew.
            first = max(at, end - SLICE)
            if first > at and (text[first] == "'" or text[first].isspace()):
                first = at
            ends = self._ends(text, first, end)
            if not ends:
                end += SLICE - 1
                continue
            if first != at:
                ends = ends[:1]
            for a, b in zip([at, *ends], ends):
                yield text[a:b]
            at, end = ends[-1], ends[-1] + SLICE

    def _ends(self, text: str, first: int, end: int) -> list[int]:
        """Where the words of ``text[first:end]`` end, but for those that might end elsewhere in the whole text."""
        ends = [first + b for _, (_, b) in self.words.tokenizer.pre_tokenizer.pre_tokenize_str(text[first:end])]
        return ends if end >= len(text) else [b for b in ends if b <= end - 4]


def pieces(docs: DataFrame, path: str, length: int = 1024) -> DataFrame:
    """``id, start, length, crc, tokens``: every document's ids and a final 0, cut at multiples of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: Ids = loaded(Ids, path)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(utf8(part.column(1))):
                    found = memoryview(ids.of((text or b"").decode("utf-8", "replace")) + b"\0\0\0\0")
                    n = len(found) // 4
                    for start in range(0, n, length):
                        own = found[4 * start : 4 * (start + length)]
                        rows.append((i, start, len(own) // 4, zlib.crc32(own), n))
                at, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)], ["id", "start", "length", "crc", "tokens"])

    return docs.mapInArrow(run, f"id {docs.schema[0].dataType.simpleString()}, start long, length long, crc long, tokens long")


def patterns(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """(piece lengths, packs of this kind) that hold every piece of ``histogram`` (length -> pieces).

    Longest lengths first; each goes to the pattern that is shortest so far and still has room, as many at once as
    there are packs of it. New packs are opened only when none has room.
    """
    open_: list[tuple[int, int, tuple[int, ...], int]] = []  # (filled, tie, pieces, packs), a heap: shortest first
    done: list[tuple[tuple[int, ...], int]] = []
    tie = 0

    def put(filled: int, own: tuple[int, ...], packs: int) -> None:
        nonlocal tie
        tie += 1
        if packs:
            heapq.heappush(open_, (filled, tie, own, packs))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if open_ and open_[0][0] + size <= length:
                filled, _, own, packs = heapq.heappop(open_)
                # The whole group takes one each; those that stay shortest take more in the next turn.
                used = min(left, packs)
                put(filled + size, (*own, size), used)
                put(filled, own, packs - used)
                left -= used
            else:
                fits = length // size
                packs, rest = divmod(left, fits)
                put(fits * size, (size,) * fits, packs)
                put(rest * size, (size,) * rest, 1 if rest else 0)
                left = 0
        # Packs without room for the next length may still take later ones, unless they are full.
        while open_ and open_[0][0] >= length:
            done.append(heapq.heappop(open_)[2:])
    return done + [x[2:] for x in open_]


def slots(found: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every place in a pattern: piece length, packs, the first pack's number, offset; sorted by length."""
    rows, first = [], 0
    for own, packs in found:
        offset = 0
        for size in own:
            rows.append((size, packs, first, offset))
            offset += size
        first += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece of every row of ``docs``.

    path: a byte-level BPE file of the ``tokenizers`` library, found on every executor. Null texts are empty and have
    the final id only. Repeated rows are packed each by itself; null ids too. No rows: no rows. Other columns are not
    read. Texts are read once and not shuffled; pieces (a few numbers each) are stored together and ranked among equal lengths in as many
    groups as there are shuffle partitions, so that a frequent length, like the full one, is spread out.
    """
    spark = docs.sparkSession
    ready(spark)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = pieces(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, length).withColumn("part", F.pmod(F.xxhash64("id", "start"), F.lit(groups)).cast("int"))
    # Shuffled before they are stored: there are as many tasks as texts ask for, but few files.
    cut = stored(found.repartition("length", "part").coalesce(-(-groups // TOGETHER)))
    counted = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    size, packs, first, offset = slots(patterns(histogram, length))
    begins = np.cumsum(packs) - packs
    starts = np.searchsorted(size, size)
    low = begins - begins[starts] if len(size) else begins  # the first rank that a place takes
    key = size * (1 << 48) + low

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "start", "crc")) - 1
    ranked = cut.withColumn("rank", rank).join(base, ["length", "part"]).select("id", "start", "length", "crc", "tokens", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            at = np.searchsorted(key, n * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + rank - low[at]), pa.array(offset[at])], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"`{id_col}` {cut.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
