"""Exact token counts of every prefix of a text (operator 9), and the words that byte-level BPE works on.

Byte-level BPE cuts a text into words and encodes each by itself. Within a word, the encoding of each prefix ends in
one token, and that token is the only one compatible with the encoding of the prefix before it: the two, put
together and encoded anew, stay those two. So a prefix's count is the count at its last token's start plus one, a
dynamic programme over byte positions. What words have in common is kept: chunks between single blanks repeat often.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, utf8

#: Fixed: how the vocabulary's tokenizer cuts a text into words, and the suffixes it cuts off as words of their own.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Code points beyond those on which regular expression libraries of all Unicode versions agree; texts with them go to
#: the tokenizer's own cutter.
_ODD = re.compile("[^\x00-\u052f\u2010-\u2027\u20ac]")
#: Entries and bytes of one generation of a cache. There are two; what the older holds and is not asked for again is forgotten.
GENERATION, GENERATION_BYTES = 1 << 18, 40 << 20


def byte_alphabet() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Cache:
    """A bounded map: two generations of at most GENERATION entries and about GENERATION_BYTES bytes each."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def get(self, key):
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.add({key: value})

    def among(self, keys: set) -> dict:
        """What is known of the keys."""
        young, old = self.young.get, self.old.get
        found = {k: v for k in keys if (v := young(k)) is not None}
        if len(found) < len(keys) and self.old:
            again = {k: v for k in keys - found.keys() if (v := old(k)) is not None}
            self.add(again)
            found |= again
        return found

    def add(self, values: dict) -> None:
        """Keys are texts, or numbers beside small values."""
        size = 150 * len(values) + sum(2 * len(k) for k in values if type(k) is str)
        if len(self.young) + len(values) > GENERATION or self.size + size > GENERATION_BYTES:
            self.old, self.young, self.size = self.young, {}, 0
        self.size += size
        self.young.update(values)


class Words:
    """The tokenizer at ``path``, and texts cut as it cuts them. The library is loaded only for texts that need it."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            named = json.load(f)
        cutter = named["pre_tokenizer"] or {}
        if named["normalizer"] or named["model"].get("type") != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("not a byte-level BPE that takes texts as they are and cuts them into words by its own pattern")
        self.special_ids = {t["content"]: t["id"] for t in named["added_tokens"]}
        self.special = list(self.special_ids)
        self.pattern = regex.compile(WORDS)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.odd = regex.compile("|".join([r"\s\s", *map(regex.escape, self.special)]))

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def model(self) -> tuple[dict[str, int], list[tuple[str, str]]]:
        """The vocabulary and the merges in order; read anew each time, as they are needed only to build tables."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]

    def cut(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if text.isascii() or _ODD.search(text) is None:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def plain(self, text: str) -> bool:
        """Whether a text has neither special strings nor code points that libraries see differently."""
        return self.at_special.search(text) is None and (text.isascii() or _ODD.search(text) is None)

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in order, cut at special strings; True for those."""
        done = 0
        for m in self.at_special.finditer(text):
            if m.start() > done:
                yield text[done : m.start()], False
            yield m[0], True
            done = m.end()
        if done < len(text):
            yield text[done:], False


def _char_ends(data: bytes) -> np.ndarray:
    """The places of the last bytes of UTF-8 characters."""
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.flatnonzero(np.append(starts[1:], True))


class IntMap:
    """A fixed map from whole numbers to whole numbers, for many lookups at once; -1 for keys that it has not."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        wrong = np.flatnonzero((there != keys) & (there >= 0))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            there, want = self.keys[at], keys[wrong]
            hit = there == want
            out[wrong[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            wrong, at = wrong[on], at[on]
        return out


#: Words of more bytes are rare and taken one by one.
SHORT = 1024
#: Bytes of text whose new words are worked out together.
TOGETHER = 2 << 20
#: Chunks of more characters are not kept.
CHUNK = 64
#: Adds a number to every count of a chunk.
_ADDED = [bytes(min(255, i + n) for i in range(256)) for n in range(256)]
_BLANKS = regex.compile(r"\s{2,}")


class Prefixes:
    """Token counts of all prefixes, by dynamic programming over a byte-level BPE vocabulary (a ``tokenizers`` file).

    Ids are in order of merging: a byte's is below 256 (or it is no merge's), a merge's is above those of its halves.
    """

    def __init__(self, path: str):
        self.words = Words(path)
        letters = byte_alphabet()
        self.byte_of = {letter: byte for byte, letter in enumerate(letters)}
        ids, merges = self.words.model()
        if any(ids[a + b] <= max(ids[a], ids[b]) for a, b in merges) or max(ids.values()) >= 1 << 16:
            raise ValueError("the vocabulary's ids are not in order of merging")
        n = max(ids.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        for a, b in merges:
            self.left[ids[a + b]], self.right[ids[a + b]] = ids[a], ids[b]
        pair = np.array([(ids[a] << 16 | ids[b], ids[a + b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.merge = IntMap(pair[:, 0], pair[:, 1])
        whole = np.flatnonzero(self.left != np.arange(n))
        whole = whole[self._apart(self.left[whole], self.right[whole], whole)]
        alone = np.zeros(n, bool)
        alone[[i for t, i in ids.items() if len(t) == 1]] = True
        alone[whole] = True
        for i in whole.tolist():  # rising ids: halves come first
            alone[i] &= alone[self.left[i]] and alone[self.right[i]]
        # The vocabulary as a tree over bytes: (node, byte) -> node; node -> id, of tokens that their own bytes give.
        nodes, edges, own = {"": 0}, [], {}
        for token, i in ids.items():
            if token in self.words.special or not alone[i]:
                continue
            for k in range(1, len(token) + 1):
                if token[:k] not in nodes:
                    nodes[token[:k]] = len(nodes)
                    edges.append((nodes[token[: k - 1]] << 8 | self.byte_of[token[k - 1]], nodes[token[:k]]))
            own[nodes[token]] = i
        edge = np.array(edges, np.int64).reshape(-1, 2)
        self.tree = IntMap(edge[:, 0], edge[:, 1])
        self.token = np.full(len(nodes), -1, np.int64)
        self.token[list(own)] = list(own.values())
        self.edges = dict(edges)
        self.chunks, self.kept, self.pairs = Cache(), Cache(), Cache()
        self.fresh: dict[str, bytes | list[int]] = {}

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = 1 << 20) -> np.ndarray:
        """Whether bytes that encode to tokens a and b by themselves still do so side by side.

        Goes back in time: as long as no merge across the border came before ``limit``, the later-made of the two
        tokens at the border is undone, and its half at the border takes its place. Equal merges happen from the left.
        """
        out = np.ones(len(a), bool)
        x, y, at = np.asarray(a, np.int64), np.asarray(b, np.int64), np.arange(len(a))
        limit = np.broadcast_to(np.asarray(limit, np.int64), x.shape)
        while len(at):
            across = self.merge.get(x << 16 | y)
            bad = (across >= 0) & (across < limit)
            out[at[bad]] = False
            newest_x = x > y
            halves_x, halves_y = self.right[x], self.left[y]
            on = ~bad & np.where(newest_x, halves_x != x, halves_y != y)
            limit = np.where(newest_x, x, y + 1)[on]
            x, y, at = np.where(newest_x, halves_x, x)[on], np.where(newest_x, y, halves_y)[on], at[on]
        return out

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Counts of the prefixes of words of at most SHORT bytes: entry (w, i) is that of the first i bytes of word w."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        byte = np.frombuffer(b"".join(words[i].ljust(longest, b"\0") for i in order.tolist()), np.uint8).reshape(len(words), longest)
        byte = np.ascontiguousarray(byte.T).astype(np.int64)
        long = [int(n) for n in np.searchsorted(-size[order], -np.arange(longest + 1), "right")]  # words of at least i bytes come first
        last, count = np.full((longest + 1, len(words)), -1, np.int64), np.zeros((longest + 1, len(words)), np.int32)
        for start in range(longest):
            # Tokens are tried at each place as they begin, so that of the same end the longest is found first.
            row, node = np.arange(long[start + 1]), np.zeros(long[start + 1], np.int64)
            for end in range(start + 1, longest + 1):
                on = row < long[end]
                row, node = row[on], node[on]
                if not len(row):
                    break
                node = self.tree.get(node << 8 | byte[end - 1, row]).astype(np.int64)
                row, node = row[node >= 0], node[node >= 0]
                token = self.token[node]
                new = np.flatnonzero((token >= 0) & (last[end, row] < 0))
                if start:
                    new = new[self._apart(last[start, row[new]], token[new])]
                last[end, row[new]], count[end, row[new]] = token[new], count[start, row[new]] + 1
        out = np.empty((len(words), longest + 1), np.int32)
        out[order] = count.T
        return out

    def _long(self, word: bytes) -> list[int]:
        """The same programme for one long word, a byte at a time; its time is in proportion to its length."""
        n, edges, known = len(word), self.edges, self.pairs
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            node, before = 0, last[start]
            for end in range(start, n):
                if (node := edges.get(node << 8 | word[end])) is None:
                    break
                token = int(self.token[node])
                if token < 0 or last[end + 1] >= 0:
                    continue
                if start:
                    pair = before << 16 | token
                    if (fits := known.get(pair)) is None:
                        fits = bool(self._apart(np.array([before]), np.array([token]))[0])
                        known.put(pair, fits)
                    if not fits:
                        continue
                last[end + 1], count[end + 1] = token, count[start] + 1
        return count[1:]

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of every text."""
        return [int(x[-1]) for x in self.counts(texts)]

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For every text ``n_chars + 1`` counts: entry i is the number of tokens of its first i characters by themselves.

        A blank between two characters that are no white space always begins a word, so that texts fall into chunks
        there, and chunks repeat: the counts of a chunk's prefixes are kept, and a text's are those of its chunks, each
        with the tokens of the chunks before it added. What is not yet known is worked out for all texts at once.
        """
        known = self.chunks.young.get
        split, new, odd = [], set(), set()
        for i, text in enumerate(texts):
            first, *rest = text.split(" ")
            own = list(map(known, rest))
            missing = {p for p, v in zip(rest, own) if v is None} if None in own else ()
            new.update(missing)
            if not first or first[-1].isspace():
                odd.add(i)
            split.append((first, rest, own, missing))
        blank = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        if blank:
            odd.update(i for i, x in enumerate(split) if not blank.isdisjoint(x[3]))
            new -= blank
        found = self.chunks.among(new)
        new = list(new - found.keys())
        firsts = [i for i in range(len(texts)) if i not in odd]
        made = self._assembled([*(" " + p for p in new), *(split[i][0] for i in firsts)])
        fresh = dict(zip(new, made))
        of_first = dict(zip(firsts, made[len(new) :]))
        self.chunks.add({p: v for p, v in fresh.items() if len(p) <= CHUNK})
        found |= fresh
        out = []
        for i, (_, rest, own, missing) in enumerate(split):
            if i in odd:
                out.append(self.of_text(texts[i]))
                continue
            parts = [of_first[i], *([found[p] if v is None else v for p, v in zip(rest, own)] if missing else own)]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            try:
                flat = np.frombuffer(b"".join(parts), np.uint8)
            except TypeError:  # some are lists
                flat = np.concatenate([np.frombuffer(x, np.uint8) if type(x) is bytes else x for x in parts])
            last = flat[np.cumsum(sizes) - 1].astype(np.int32)
            whole = np.zeros(len(flat) + 1, np.int32)
            np.add(flat, np.repeat(np.cumsum(last, dtype=np.int32) - last, sizes), out=whole[1:])
            out.append(whole)
        return out

    def _assembled(self, chunks: list[str]) -> list[bytes | list[int]]:
        """Counts of the prefixes of each chunk, from one character on; as bytes where none is over 255."""
        # A blank and letters are one word; most chunks are.
        alone = [x for x in chunks if x[1:].isalpha() and x[0] == " " and len(x) <= CHUNK and (x.isascii() or _ODD.search(x) is None)]
        made = dict(zip(alone, self._grown(alone)))
        odd, words_of = self.words.odd.search, self.words.cut
        cut = {x: () if odd(x) else words_of(x) for x in chunks if x not in made}
        self._learn({w for words in cut.values() for w in words})
        known = self.fresh.get
        for chunk, words in cut.items():
            own = b""
            for w in words:
                grown = known(w)
                if type(grown) is not bytes or own and own[-1] + len(grown) * 4 > 255 and own[-1] + max(grown) > 255:
                    own = b""
                    break
                own = own + grown.translate(_ADDED[own[-1]]) if own else grown
            made[chunk] = own or self.of_text(chunk)[1:].tolist()
        return [made[x] for x in chunks]

    def _learn(self, words: set[str]) -> None:
        """Put the counts of the words' prefixes into ``fresh``, and into ``kept`` too; long words are left out."""
        self.fresh = self.kept.among(words)
        new = [w for w in words - self.fresh.keys() if len(w) <= SHORT and (w.isascii() or len(w.encode("utf-8", "surrogatepass")) <= SHORT)]
        made = dict(zip(new, self._grown(new)))
        for w in made.keys() & set(SUFFIXES):
            if len(w) > 2:
                # The apostrophe stands alone until the suffix is complete.
                made[w] = bytes([1, *(1 + x for x in self._grown([w[1:-1]])[0]), made[w][-1]])
        self.fresh |= made
        self.kept.add(made)

    def _grown(self, words: list[str]) -> list[bytes | list[int]]:
        """Counts of the prefixes, in characters, of words of at most SHORT bytes."""
        by_size: dict[int, list[int]] = {}
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        for i, b in enumerate(data):
            by_size.setdefault((len(b) - 1).bit_length(), []).append(i)
        out: list[bytes | list[int]] = [b""] * len(words)
        for same in by_size.values():
            own = [data[i] for i in same]
            counts = self.of_words(own)[:, 1:]
            width = counts.shape[1]
            byte = np.frombuffer(b"".join([b.ljust(width + 1, b"\0") for b in own]), np.uint8).reshape(len(own), width + 1)
            # The last bytes of characters: those not followed by a byte that goes on with one.
            ends = ((byte[:, 1:] & 0xC0) != 0x80) & (np.arange(width) < np.fromiter(map(len, own), np.int64, len(own))[:, None])
            stops = np.cumsum(ends.sum(1)).tolist()
            flat = counts[ends]
            small = flat.astype(np.uint8).tobytes()
            for i, a, b in zip(same, [0, *stops], stops):
                out[i] = small[a:b]
                if width > 255 and flat[a:b].max(initial=0) > 255:
                    out[i] = flat[a:b].tolist()
        return out

    def of_text(self, text: str) -> np.ndarray:
        """``n_chars + 1`` counts: entry i is the number of tokens of ``text[:i]`` by itself."""
        out = np.zeros(len(text) + 1, np.int32)
        done = 0
        before = ""
        for segment, special in self.words.segments(text):
            base = out[done]
            if special:
                # Until its last character comes, it is ordinary text behind the segment before it.
                whole = self._ordinary(before + segment[:-1])
                out[done : done + len(segment)] = out[done - len(before)] + whole[len(before) :]
                out[done + len(segment)] = base + 1
                out[done] = base
                before = ""
            else:
                out[done : done + len(segment) + 1] = base + self._ordinary(segment)
                before = segment
            done += len(segment)
        return out

    def _ordinary(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int32)
        done = 0
        words = self.words.cut(text)
        runs = list(_BLANKS.finditer(text))
        own = self.fresh
        self._learn({*words, *(m[0] for m in runs)})
        own, self.fresh = self.fresh, own
        for word in words:
            out[done + 1 : done + len(word) + 1] = out[done] + self._by_char(word, own)
            done += len(word)
        for run in runs:
            # A run of white space at a prefix's end is one word; what follows may take its last character away.
            out[run.start() + 1 : run.end() + 1] = out[run.start()] + self._by_char(run[0], own)
        return out

    def _by_char(self, word: str, known: dict) -> np.ndarray:
        if (grown := known.get(word)) is not None:
            return np.frombuffer(grown, np.uint8).astype(np.int32) if type(grown) is bytes else np.array(grown, np.int32)
        data = word.encode("utf-8", "surrogatepass")
        counts = np.array(self._long(data), np.int32)
        return counts if len(data) == len(word) else counts[_char_ends(data)]

    def longest_within(self, counts: np.ndarray, budget: int) -> int:
        """The length in characters of the longest prefix of at most ``budget`` tokens."""
        if counts[-1] <= budget:
            return len(counts) - 1
        fits = np.flatnonzero(counts <= budget)
        return int(fits[-1]) if len(fits) else 0


_loaded: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One instance for each Python worker, so that its caches last longer than a task."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False, budgets: tuple[int, ...] = ()) -> DataFrame:
    """``id, n_bytes, n_tokens`` for every row of ``docs``; for each of ``budgets`` also ``within_BUDGET long``, and with
    ``prefixes`` also ``prefix_tokens array<int>``.

    path: a byte-level BPE file of the ``tokenizers`` library, found on every executor; special strings inside texts
    count as one token, as they do there by default. The counts of all prefixes of a text are made and answer all: entry i
    is the exact count of the first i code points, whatever comes after them. within_BUDGET: the code points of the
    longest prefix of no more tokens. prefix_tokens stores the counts; see ``fit`` and ``within``. Null texts are empty: no
    tokens, one entry 0. Rows are independent; repeated rows repeat, no rows give none, other columns are not read. No
    shuffle. Several texts are worked on at once, but no more than TOGETHER bytes or one text.
    """
    ready(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    answers = [f"within_{x}" for x in budgets]
    schema = f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long" + "".join(f", {x} long" for x in answers) + ", prefix_tokens array<int>" * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Prefixes = loaded(Prefixes, path)
        for batch in batches:
            texts = [x or b"" for x in utf8(batch.column(1))]
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (size + len(texts[high]) <= TOGETHER or high == low):
                    size += len(texts[high])
                    high += 1
                found = counter.counts([x.decode("utf-8", "replace") for x in texts[low:high]])
                columns = [batch.column(0).slice(low, high - low), pa.array(list(map(len, texts[low:high])), pa.int64()), pa.array([int(x[-1]) for x in found], pa.int64())]
                columns += [pa.array([counter.longest_within(x, budget) for x in found], pa.int64()) for budget in budgets]
                columns += [pa.array(found, pa.list_(pa.int32()))] * prefixes
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", *answers, "prefix_tokens"][: len(columns)])
                low = high

    return narrow.mapInArrow(run, schema)


def within(budget: int, prefix_tokens: str = "prefix_tokens") -> "F.Column":
    """The length in code points of the longest prefix of at most ``budget`` tokens, from stored counts alone."""
    fits = F.filter(F.transform(F.col(prefix_tokens), lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(fits), F.lit(0))


def fit(length: "F.Column", prefix_tokens: str = "prefix_tokens") -> "F.Column":
    """The token count of the first ``length`` code points, from stored counts alone."""
    return F.get(F.col(prefix_tokens), F.least(length, F.size(prefix_tokens) - 1))
