"""Key-value views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import hashed_key


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small unique non-negative keys: ``key_long, seq, value``."""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key_long"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))


def kv_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique keys spread over all 64 bits."""
    return kv_orders(spark, sf_dir).withColumn("key_long", hashed_key(F.col("key_long")))


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys, each written many times."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("key_long"), F.col("event_id").alias("seq"), "value")


def kv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large values."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key_long"), F.col("doc_id").alias("seq"), F.col("text").alias("value"))
