"""Quality classifier: a generalised additive model with pairwise interactions (operator 6).

Texts become a few numbers. For each, and for the most telling pairs of them, a lookup table over its bins is learned by
cyclic boosting: in turn, each table is nudged by a shallow tree fitted to the gradient of its own bins, so that no
feature is favoured. A score is the sum of table entries through a logistic function.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ready, utf8

#: Names of the features, in order.
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "blanks", "stops", "bangs", "symbols", "other_bytes",
    "distinct_words", "top_word", "same_neighbours", "distinct_pairs", "repeated_lines", "log_line", "ended_lines", "marked_words", "shouted_words", "pipes",
)
_ALPHA = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_BLANK = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_STOP = np.array([b in b".,;:?'\"" for b in range(256)])
_SYMBOL = np.array([b in b"#$%&*+/<=>@\\^_`{|}~" for b in range(256)])
_KINDS = np.stack([_ALPHA, _UPPER, _DIGIT, _BLANK, _STOP, _SYMBOL]).astype(np.float64)
#: A word with a mark repeated at its end, or in capitals.
_MARKED = re.compile(rb"([!-/:-@\[-`{-~])\1+(?=\s|$)")
_SHOUTED = re.compile(rb"(?<![^\s])[A-Z]{2,}[!-/:-@]*(?=\s|$)")


def features(text: bytes | None) -> list[float]:
    """The FEATURES of a whole UTF-8 text; null is empty, and every share of nothing is 0."""
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, upper, digits, blanks, stops, symbols = (_KINDS @ counts).tolist()
    other = float(counts[128:].sum())
    words = text.split()
    w = len(words) or 1
    bag = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    k = len(lines) or 1
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(np.log1p(lengths.max())), (letters + other) / n, upper / (letters or 1), digits / n, blanks / n, stops / n,
        float(counts[33]) / n, symbols / n, other / n, len(bag) / w, max(bag.values(), default=0) / w, sum(map(bytes.__eq__, words, words[1:])) / w, pairs / max(1, w - 1),
        1 - len(set(lines)) / k, float(np.log1p(n / k)), sum(x[-1:] in b".!?" for x in lines) / k, len(_MARKED.findall(text)) / w, len(_SHOUTED.findall(text)) / w, float(counts[124]) / w,
    ]


@dataclass
class Additive:
    """bins: cut points of each feature; tables: a score for each bin; pairs: tables over two features' coarse bins."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, f], "right")]
        for f, g, table in self.pairs:
            out += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x).clip(-40, 40)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Value and gain of leaves with these sums of gradients and curvatures."""
    return g / (h + ridge), g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A regression tree over ordered bins of at most ``leaves`` leaves, grown best first; its value in each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    spans = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        m = np.arange(a + 1, b)
        gain = _leaf(cg[m] - cg[a], ch[m] - ch[a], ridge)[1] + _leaf(cg[b] - cg[m], ch[b] - ch[m], ridge)[1] - _leaf(cg[b] - cg[a], ch[b] - ch[a], ridge)[1]
        at = int(gain.argmax())
        return float(gain[at]), int(m[at])

    while len(spans) < leaves:
        (gain, at), i = max((best(*s), i) for i, s in enumerate(spans))
        if gain <= 1e-9:
            break
        a, b = spans[i]
        spans[i : i + 1] = [(a, at), (at, b)]
    out = np.empty(len(g))
    for a, b in spans:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a], ridge)[0]
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree of depth two over two features' bins: one cut of the rows and one of the columns of each part."""
    best, value = 0.0, np.zeros_like(g)
    for a in range(1, len(g)):
        trial, gain = np.empty_like(g), 0.0
        for part in (slice(0, a), slice(a, None)):
            cg, ch = np.cumsum(g[part].sum(0)), np.cumsum(h[part].sum(0))
            left, right = _leaf(cg[:-1], ch[:-1], ridge), _leaf(cg[-1] - cg[:-1], ch[-1] - ch[:-1], ridge)
            b = int((left[1] + right[1]).argmax())
            gain += left[1][b] + right[1][b]
            trial[part, : b + 1], trial[part, b + 1 :] = left[0][b], right[0][b]
        if gain > best:
            best, value = gain, trial
    return value, best


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, ridge: float = 2.0) -> Additive:
    """Fit main tables, pick the pairs that explain most of what they leave, and fit those. One class alone gives its rate."""
    cut = lambda n: [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    fine, rough = cut(bins), cut(coarse)
    model = Additive(fine, [np.zeros(len(c) + 1) for c in fine], rough)
    if not len(y):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(fine)]
    logit = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(at):
            g, h = slopes()
            n = len(fine[f]) + 1
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), 4, ridge)
            model.tables[f] += step
            logit += step[b]
    rough_at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(rough)]

    def grid(f: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(rough[f]) + 1, len(rough[k]) + 1
        flat = rough_at[f] * shape[1] + rough_at[k]
        g, h = slopes()
        return flat, np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)

    able = [(f, k) for f in range(len(FEATURES)) for k in range(f) if len(rough[f]) and len(rough[k])]
    gains = sorted(((_cross(*grid(f, k)[1:], ridge)[1], f, k) for f, k in able), reverse=True)[:n_pairs]
    model.pairs = [(f, k, np.zeros((len(rough[f]) + 1, len(rough[k]) + 1))) for _, f, k in gains]
    for _ in range(rounds // 3):
        for f, k, table in model.pairs:
            flat, g, h = grid(f, k)
            step = rate * _cross(g, h, ridge)[0]
            table += step
            logit += step.ravel()[flat]
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 20000) -> Additive:
    """A model of ``labels``' 0/1 column from the texts of the same ids; rows of null id or label teach nothing.

    About ``rows`` labelled rows are learned from, drawn by a hash of the id: a documented bound on the work of fitting.
    Repeated labels of one id are averaged and rounded, and of repeated texts the smallest counts, so that order does
    not matter and a frequent id adds one row. Only drawn labels are joined.
    """
    ready(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(label_col)).cast("int").alias("label"))
    rate = rows / max(1, known.count())
    known = known.where(F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "id"), 11).cast("double") / float(1 << 53) < rate)
    # At most a few more than ``rows`` ids of a fixed width: small enough to broadcast at any size of the tables.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    # An id with many rows teaches by one text, so that what is drawn stays bounded.
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    table = described(texts, "text", ["id", "label"]).toPandas()
    order = np.lexsort((table.label, table.id))
    x = np.array(table.f.to_list(), np.float64).reshape(-1, len(FEATURES))[order]
    return train(x, table.label.to_numpy(np.float64)[order])


def described(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the features ``f`` of every row."""
    narrow = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = docs.select(*keep).withColumn("f", F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(x) for x in utf8(batch.column(len(keep)))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], [*keep, "f"])

    return narrow.mapInArrow(run, schema)


def rate(docs: DataFrame, model: Additive, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1; higher: label 1 likelier) and ``quality_predicted`` (1 from 0.5 on).

    Null and empty texts have a score as well: that of a text whose features are all 0. Columns of these names are
    replaced. Rows are independent: repeats repeat, no rows give none. No shuffle.
    """
    spark = docs.sparkSession
    ready(spark)
    kept = docs.drop("quality_score", "quality_predicted")
    held = spark.sparkContext.broadcast(model)
    schema = kept.withColumns({"quality_score": F.lit(0.0), "quality_predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in utf8(batch.column(text_col))], np.float64).reshape(-1, len(FEATURES))
            score = held.value.score(x)
            made = {"quality_score": pa.array(score), "quality_predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in schema.names], schema.names)

    return kept.mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held: int = 1, rows: int = 20000) -> DataFrame:
    """``rate`` for every row, having learned from labels whose crc32(id) mod ``modulus`` is not ``held``."""
    return rate(docs, learn(docs, labels.where(~fold(id_col, modulus, held)), id_col, text_col, label_col, rows), text_col)
