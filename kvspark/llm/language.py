"""Language ID by multilingual mixture inference (operator 4).

Each language is a distribution over hashed byte trigrams, learned from labelled documents. A document is taken as a
mixture: expectation-maximisation finds the proportions that make its trigrams likeliest, over all languages and then
over nested sets of the foremost ones, as many as there are; the set of greatest likelihood less a price for each language wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ready, utf8

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: Trigrams overlap, so a document has about a third as many independent ones.
OVERLAP = 3.0
#: Log-likelihood that one more language costs, for each natural log unit of trigrams.
PRICE = 1.0
ROUNDS = 12
#: Distinct trigrams of documents that are inferred together.
FLAT = 1 << 17
#: ASCII letters are lower-cased, other ASCII is blank, bytes of other code points stay.
_LETTERS = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256)).lower()

_ASCII_LETTER = re.compile(rb"[a-z]")


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's trigrams and how often each occurs. Trigrams around a blank's both sides are left out."""
    a = np.frombuffer(b" " + text.translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:])[a[1:-1] != 32]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(17)
    if len(bucket) < 4096:
        return np.unique(bucket, return_counts=True)
    counts = np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def has_letter(text: bytes | None) -> bool:
    """Whether any code point of the text is a letter of any script."""
    if not text:
        return False
    folded = text.translate(_LETTERS)
    if text.isascii():
        return not folded.isspace()
    return _ASCII_LETTER.search(folded) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Mixture:
    """languages: their names; counts: trigram counts (languages x BUCKETS)."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.1):
        self.languages = languages
        p = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1]) if len(languages) else counts
        self.p = np.ascontiguousarray(p.T, np.float32)
        self.log_p = np.log(self.p)

    def _em(self, r: np.ndarray, c: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after ROUNDS rounds from ``share``, and their log-likelihoods. Languages of share 0 stay out."""
        for _ in range(ROUNDS):
            w = r * share[doc]
            w *= (c / w.sum(1))[:, None]
            share = np.add.reduceat(w, starts, axis=0) / n[:, None]
        return share, np.add.reduceat(c * np.log((r * share[doc]).sum(1)), starts)

    def infer(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """For documents with a trigram each: proportions over the chosen languages, and the score of the foremost."""
        sizes = np.array([len(b) for b, _ in docs])
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(docs)), sizes)
        bucket, c = np.concatenate([b for b, _ in docs]), np.concatenate([c for _, c in docs]).astype(np.float32)
        r, n = self.p[bucket], np.add.reduceat(c, starts)
        single = np.add.reduceat(c[:, None] * self.log_p[bucket], starts, axis=0).astype(np.float64) / OVERLAP
        best = single.argmax(1)
        rows = np.arange(len(docs))
        chosen = np.zeros((len(docs), len(self.languages)), np.float32)
        chosen[rows, best] = 1
        surest = np.exp(single - single.max(1, keepdims=True))
        score = 1 / surest.sum(1)
        if len(self.languages) > 1:
            share, all_ = self._em(r, c, doc, starts, n, np.full(chosen.shape, 1 / chosen.shape[1], np.float32))
            # The log-likelihood is concave: no mixture's lies further above this one's than its largest slope exceeds n.
            slope = np.add.reduceat(r * (c / (r * share[doc]).sum(1))[:, None], starts, axis=0).max(1)
            most = (all_ + np.maximum(slope - n, 0)) / OVERLAP
            price = PRICE * np.log1p(n)
            value = single[rows, best]
            order = np.argsort(-share, axis=1, kind="stable")
            # Sets grow by the next foremost language as long as all languages together could pay for one more.
            for k in range(2, len(self.languages) + 1):
                open_ = np.flatnonzero(most - (k - 1) * price > value)
                if not len(open_):
                    break
                keep = np.isin(doc, open_)
                start = np.zeros((len(open_), len(self.languages)), np.float32)
                np.put_along_axis(start, order[open_, :k], np.float32(1 / k), 1)
                own, like = self._em(r[keep], c[keep], np.searchsorted(open_, doc[keep]), np.cumsum(sizes[open_]) - sizes[open_], n[open_], start)
                like = like / OVERLAP - (k - 1) * price[open_]
                wins = like > value[open_]
                value[open_[wins]] = like[wins]
                chosen[open_[wins]] = own[wins]
                score[open_[wins]] = own[wins].max(1)
        return chosen, score


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 5000) -> Mixture:
    """A model of the languages in ``labelled``. Rows of null language or text teach nothing.

    Of each language, about ``rows_per_language`` rows are learned from, drawn by a hash of the id: a documented bound
    on the work of fitting, which does not grow with the data. All rows are counted to set the draw.
    """
    ready(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Mixture([], np.zeros((0, BUCKETS)))
    rate = F.element_at(F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, rows_per_language / sizes[k]))]), F.col("lang"))
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "id"), 11).cast("double") / float(1 << 53) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                if text:
                    bucket, c = trigrams(text)
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] += c
        for lang, own in sums.items():
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(own[found])], ["lang", "bucket", "n"])

    total = drawn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, total.lang.to_numpy().astype(str)), total.bucket] = total.n
    return Mixture(names, counts)


def identify(docs: DataFrame, model: Mixture, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_shares`` (map of the chosen languages' proportions).

    Null texts and texts with no letter of any script are ``und`` with score 0 and no shares; so is all, if nothing was
    learned. Every other text gets a learned language, short and very long ones too. Columns of these names in
    ``docs`` are replaced; rows are independent, so repeats repeat and no rows give none. No shuffle; the model (a
    fixed number of buckets for each language) goes to all tasks.
    """
    spark = docs.sparkSession
    ready(spark)
    own = ("lang_pred", "lang_score", "lang_shares")
    kept = docs.drop(*own)
    held = spark.sparkContext.broadcast(model)
    schema = kept.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_shares": F.lit(None).cast("map<string,double>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture: Mixture = held.value
        for batch in batches:
            texts = utf8(batch.column(text_col))
            pred, score, shares = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            waiting: list[int] = []
            found: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def settle() -> None:
                nonlocal size
                if found:
                    for i, own_shares, own_score in zip(waiting, *mixture.infer(found)):
                        best = int(own_shares.argmax())
                        pred[i], score[i] = mixture.languages[best], min(1.0, float(own_score))
                        shares[i] = [(mixture.languages[j], float(own_shares[j])) for j in np.flatnonzero(own_shares > 0)]
                waiting.clear()
                found.clear()
                size = 0

            for i, text in enumerate(texts):
                if mixture.languages and has_letter(text):
                    waiting.append(i)
                    found.append(trigrams(text))
                    size += len(found[-1][0])
                    if size > FLAT:
                        settle()
            settle()
            made = {"lang_pred": pa.array(pred, pa.string()), "lang_score": pa.array(score, pa.float64()), "lang_shares": pa.array(shares, pa.map_(pa.string(), pa.float64()))}
            yield pa.RecordBatch.from_arrays([made[x] if x in made else batch.column(x) for x in schema.names], schema.names)

    return kept.mapInArrow(run, schema)


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, held: int = 0, rows_per_language: int = 5000) -> DataFrame:
    """``identify`` for every row, having learned from rows whose crc32(id) mod ``modulus`` is not ``held``."""
    model = learn(docs.where(~fold(id_col, modulus, held)), id_col, text_col, lang_col, rows_per_language)
    return identify(docs, model, text_col)
