"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``.
Between stages the documents are written as Parquet and read again; a stage that shuffles them gives few files (``few``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvspark.llm import decontaminate, language, line_dedup, packing, similar
from kvspark.llm.common import few, fold, shared_dir, table
from kvspark.llm.queries import tokenizer_path

#: A document stays if a single language makes up this share of it at least.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that no language makes up by half; names the language where it is null.

    Learns from rows whose crc32(doc_id) mod 5 is not 0. If no row names a language, only letterless texts go.
    """
    model = language.learn(docs.where(~fold("doc_id", 5, 0)))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model)
    share = F.element_at("lang_shares", F.col("lang_pred"))
    found = found.where((F.col("lang_pred") != language.UNDETERMINED) & (share >= LEAST_SHARE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; no document goes."""
    return _counted(line_dedup.dedup_lines(docs), docs).coalesce(few(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by sets of five-word shingles of similarity 0.8 or more.

    It is the one of the smallest id; a row without an id stays only if its group has none with one. Of rows that share
    that id one stays.
    """
    # Rows that are equal in every column share both hashes.
    row = F.struct(F.xxhash64(*docs.columns).alias("kept_1"), F.xxhash64(F.lit("other"), *docs.columns).alias("kept_2"))
    marked, roots = similar.groups(docs.select(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", row.alias("row")).alias("id"), "text"), words=5)
    # Copies are reduced to one row a set before sets meet their roots.
    least = marked.groupBy("node").agg(F.min("id").alias("id")).join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("id").alias("id"))
    found = docs.withColumns({c: row[c] for c in ("kept_1", "kept_2")}).join(least.select("id.row.*"), ["kept_1", "kept_2"], "left_semi")
    found = found.withColumn("kept_place", F.row_number().over(Window.partitionBy("kept_1", "kept_2").orderBy("kept_1")))
    return found.where("kept_place = 1").select(*docs.columns).coalesce(few(spark))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document with a span of ten words or more of a benchmark item, or a whole shorter item.

    The coverage limit is 0: what surrounds a leaked passage often leaks its answer too, so no text is kept with a hole.
    """
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences of at most 1024."""
    return packing.pack(docs, tokenizer_path(), length=1024).coalesce(few(spark))


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the number of code points brought up to date if they have it."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontaminate", no_benchmark),
    ("pack", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline_{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{at}/{i}_{name}")
        docs = spark.read.parquet(path)
    return docs


#: Tokens, SimHash and mixtures are beyond SQL: tests hold it against a brute-force version.
ORACLE_SQL = None
