"""Document fingerprints by consistent weighted sampling (operator 7).

A text is a bag of words with their counts as weights. For each of SAMPLES samples, every term has two gamma variates
and a uniform one; from its weight they give a level and a score, and the term of least score is sampled (Ioffe, 2010).
Two texts sample the same (term, level) with a chance that equals the generalised Jaccard similarity of their bags,
so that the share of equal slots estimates it. Variates are looked up by three independent parts of a term's hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, ready, utf8
from .sharding import range_of, splitters

SAMPLES = 128
ROWS = 4096
#: Terms that are scored at once.
BLOCK = 2048
FIRST = -(1 << 63)
#: Keys drawn for each range of documents.
DRAWS = 64


class Sampler:
    """Signatures of weighted terms. All draws follow from ``seed``."""

    def __init__(self, samples: int = SAMPLES, seed: int = 7):
        draw = np.random.RandomState(seed)
        shape = (ROWS, samples)
        self.r = draw.gamma(2.0, 1.0, shape).astype(np.float32).clip(1e-3)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, shape).clip(1e-6)).astype(np.float32)
        self.beta = draw.uniform(0.0, 1.0, shape).astype(np.float32)
        self.samples = samples
        self.each = np.arange(samples)

    def of(self, text: bytes) -> bytes:
        """The signature of a UTF-8 text: 16 bits a sample; all zero if it has no words."""
        bag = Counter(text.lower().split())
        if not bag:
            return bytes(2 * self.samples)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, bag), np.uint64, len(bag))
        logs = np.log(np.fromiter(bag.values(), np.float32, len(bag)))
        least, term, level = None, None, None
        for at in range(0, len(bag), BLOCK):
            h, log = hashes[at : at + BLOCK], logs[at : at + BLOCK, None]
            i, j, k = ((h >> np.uint64(s)) % np.uint64(ROWS) for s in (0, 20, 40))
            beta = self.beta[k]
            t = np.floor(log * self.inverse[i] + beta)
            score = self.log_c[j] - self.r[i] * (t - beta + np.float32(1))
            best = score.argmin(0)
            s, x, y = score[best, self.each], h[best], t[best, self.each]
            if least is None:
                least, term, level = s, x, y
            else:
                less = s < least
                least, term, level = np.where(less, s, least), np.where(less, x, term), np.where(less, y, level)
        mixed = (term ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(48)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal slots of two signatures."""
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``id, n_chars, fingerprint`` (lowercase hex, 4 digits a sample) of every row. Null and wordless texts give zeros."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            texts = [x or b"" for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.decode("utf-8", "replace")) for x in texts], pa.int64()), pa.array([sampler.of(x).hex() for x in texts], pa.string())], [id_col, "n_chars", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def _cuts(keyed: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the keys (k, tie), from about DRAWS distinct keys a range drawn by their hash."""
    total = keyed.count()
    chance = min(1.0, DRAWS * parts / max(1, total))
    drawn = keyed.where(F.shiftrightunsigned(F.xxhash64(F.lit("cut"), "k", "tie"), 11).cast("double") / float(1 << 53) < chance)
    sample = drawn.groupBy("k", "tie").agg(F.count("*").cast("double").alias("w")).toPandas().sort_values(["k", "tie"])
    return splitters(np.rec.fromarrays([sample.k.to_numpy(), sample.tie.to_numpy(), sample.w.to_numpy()], names="k1,k2,w"), parts)


def _bucket_of(k1: np.ndarray, k2: np.ndarray):
    @F.pandas_udf("int")
    def bucket(k: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(range_of(k.to_numpy(), tie.to_numpy(), k1, k2).astype(np.int32))

    return bucket


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint beside that of its edited text and of the next document.

    The next document follows in ascending order of id, ties by a hash of the text and nulls first; after the last
    comes the first. The edited text has its last quarter (``n_chars // 4`` code points) replaced by as many from the
    start of the next text, or all that it has. Null texts are empty; a single row is its own next. No rows: no rows.

    Pairs of id and text hash are dealt to ranges of about equal counts, so that a range holds runs of neighbours, and many
    rows without an id, or of one, still make many ranges; the first document of each range is also copied to the range
    before it. That is the one shuffle, of compressed texts; to the driver go DRAWS keys and one more a range. Rows that
    repeat both id and text lie in one range, whose rows are streamed. A task takes several ranges, one after another, where
    there are more than ``few``: each task makes a file. Ids have to be numbers.
    """
    spark = docs.sparkSession
    ready(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("k"), F.xxhash64(text).alias("tie"), text.alias("text"))
    cuts = _cuts(keyed.select("k", "tie"), parts) if parts > 1 else (np.zeros(0, np.int64),) * 2
    bucket = _bucket_of(*cuts)
    firsts = sorted((r.b, *r.first) for r in keyed.select(bucket("k", "tie").alias("b"), F.struct("k", "tie").alias("key")).groupBy("b").agg(F.min("key").alias("first")).collect())
    to = {(k, tie): firsts[i - 1][0] for i, (_, k, tie) in enumerate(firsts)}  # the first's copy goes to the last range
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, packer = Sampler(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            b = batch.column(3).to_numpy(zero_copy_only=False)
            texts = utf8(batch.column(4))
            rows = np.arange(len(b))
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            halo = np.array([i for i, x in enumerate(keys) if x in to], np.int64)
            take = pa.array(np.concatenate([rows, halo]))
            signed, packed = pa.array([sampler.of(x) for x in texts], pa.binary()), pa.array([packer.compress(x) for x in texts], pa.binary())
            buckets = np.concatenate([b, np.array([to[keys[i]] for i in halo.tolist()], np.int32)]).astype(np.int32)
            halos = np.concatenate([np.zeros(len(rows), np.int8), np.ones(len(halo), np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(halos), batch.column(1).take(take), batch.column(2).take(take), batch.column(0).take(take), packed.take(take), signed.take(take)], ["b", "halo", "k", "tie", "id", "packed", "signed"])

    dealt = keyed.select("id", "k", "tie", bucket("k", "tie").alias("b"), "text").mapInArrow(sign, f"b int, halo byte, k long, tie long, id {kind}, packed binary, signed binary")
    runs = dealt.repartitionById(max(parts, len(cuts[0]) + 1), F.col("b")).sortWithinPartitions("b", "halo", "k", "tie")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, unpacker = Sampler(), zstandard.ZstdDecompressor()
        last = None
        for batch in batches:
            out: list[tuple] = []
            for b, halo, id_, packed, signed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6))):
                row = (b, halo, id_, unpacker.decompress(packed, max_output_size=1 << 31).decode("utf-8", "replace"), signed)
                if last is not None and not last[1] and last[0] == b:
                    text, cut = last[3], len(last[3]) // 4
                    edited = (text[: len(text) - cut] + row[3][:cut]).encode("utf-8", "surrogatepass")
                    own = sampler.of(edited)
                    out.append((last[2], len(text), hashlib.sha256(edited).hexdigest(), last[4].hex(), own.hex(), likeness(last[4], own), likeness(last[4], signed)))
                last = row
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [batch.schema.field(4).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    found = runs.mapInArrow(compare, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.coalesce(few(spark))
