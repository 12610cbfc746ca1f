"""A key-value store as a Parquet table in key-prefix partitions (OP-01 to OP-07, OP-08, OP-25)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .errors import Status, StoreError
from .operators.latest import latest
from .operators.lookup import multi_get
from .operators.ordering import globally_sorted, groups_between, in_range
from .schema import KEY_BYTES, KV, group_of, with_key_long


STORED = T.StructType([*KV.fields, T.StructField("prefix", T.IntegerType())])


class KVStore:
    """Records ``(key, value, seq)`` under ``path``; the record of greatest ``seq`` is a key's current one.

    Directories are the top ``prefix_bits`` bits of the key, so point and range reads prune them; within a file rows
    are sorted by key, so row-group statistics prune further. Handles are cheap and hold no state: every read sees the
    files that are there when it runs.
    """

    def __init__(self, spark: SparkSession, path: str, prefix_bits: int = 6):
        if not path:
            raise StoreError(Status.IO_ERROR, "a store needs a path")
        self.spark, self.path, self.bits, self.closed = spark, path.rstrip("/"), prefix_bits, False

    @classmethod
    def open(cls, spark: SparkSession, path: str, prefix_bits: int = 6) -> KVStore:
        return cls(spark, path, prefix_bits)

    def close(self) -> None:
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise StoreError(Status.NOT_SUPPORTED, "the store is closed")

    def records(self) -> DataFrame:
        """All records ever put, with ``prefix``."""
        self._open()
        try:
            return self.spark.read.schema(STORED).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], STORED)
            raise StoreError(Status.IO_ERROR, str(e)) from e

    def put(self, df: DataFrame, bloom: bool = False) -> None:
        """Append records. One shuffle, by prefix and key, so that each directory gets few, sorted files."""
        self._open()
        if not {"key", "value", "seq"} <= set(df.columns):
            raise StoreError(Status.INVALID_ARGUMENT, "records have key, value and seq")
        rows = with_key_long(df.select(*[F.col(f.name).cast(f.dataType) for f in KV.fields]))
        bad = F.raise_error(F.lit(f"INVALID_ARGUMENT: keys have {KEY_BYTES} bytes"))
        rows = rows.withColumn("prefix", F.when(F.length("key") == KEY_BYTES, group_of(F.col("key_long"), self.bits)).otherwise(bad.cast("int"))).drop("key_long")
        writer = rows.repartitionByRange("prefix", "key").sortWithinPartitions("prefix", "key", "seq").write.mode("append").partitionBy("prefix")
        if bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        try:
            writer.parquet(self.path)
        except Exception as e:
            raise StoreError(Status.INVALID_ARGUMENT if "INVALID_ARGUMENT" in str(e) else Status.CORRUPTION, str(e)[:500]) from e

    def current(self) -> DataFrame:
        """The latest record of every key."""
        return latest(self.records().drop("prefix"), ["key"])

    def _of(self, key: bytes) -> int:
        return int.from_bytes(key[:8].ljust(8, b"\0"), "big") >> (64 - self.bits)

    def get(self, key: bytes) -> bytes:
        """The current value of a key; StoreError NOT_FOUND if it has none. For many keys use ``multi_get``."""
        hit = latest(self.records().where((F.col("prefix") == self._of(key)) & (F.col("key") == F.lit(key))).drop("prefix"), ["key"]).select("value").head()
        if hit is None:
            raise StoreError(Status.NOT_FOUND, key.hex())
        return bytes(hit.value)

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """``key, value, seq, status`` for every row of ``probes`` (key). Only directories that are asked for are read."""
        asked = with_key_long(probes.select("key")).select("key", group_of(F.col("key_long"), self.bits).alias("prefix"))
        hit = self.records().join(asked.distinct(), ["prefix", "key"], "left_semi").drop("prefix")
        return multi_get(latest(hit, ["key"]), probes)

    def range(self, lower: bytes | None = None, upper: bytes | None = None, order: str = "unsigned") -> DataFrame:
        """Current records of ``lower <= key < upper`` in key order; null bounds are open."""
        low, high = groups_between(lower, upper, self.bits)
        rows = in_range(self.records().where(F.col("prefix").between(low, high)), lower, upper).drop("prefix")
        return globally_sorted(with_key_long(latest(rows, ["key"])), order).drop("key_long")

    def visit(self, visitor: Callable[[bytes, bytes], None], lower: bytes | None = None, upper: bytes | None = None) -> None:
        """Call ``visitor`` with every pair of a range, in order, on the driver, a partition at a time. All pairs are sent to
        the driver; for what a visitor gathers of a large range there is ``visit_parts``."""
        for key, value in self.pairs(lower, upper):
            visitor(key, value)

    def visit_parts(self, visitor: Callable[[Iterator[tuple[bytes, bytes]]], tuple], schema: str, lower: bytes | None = None, upper: bytes | None = None) -> list[Row]:
        """What ``visitor`` makes of each partition of a range, in order of keys. It runs where the partition lies, is given the
        partition's pairs in order, and returns one row of ``schema``, the only thing that is sent to the driver."""

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = (pair for batch in batches for pair in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist()))
            row = (TaskContext.get().partitionId(), *visitor(pairs))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        kind = T._parse_datatype_string(f"_part int, {schema}")
        arrow = to_arrow_schema(kind)
        types, names = list(arrow.types), list(arrow.names)
        return self.range(lower, upper).select("key", "value").mapInArrow(made, kind).orderBy("_part").drop("_part").collect()

    def pairs(self, lower: bytes | None = None, upper: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        for row in self.range(lower, upper).select("key", "value").toLocalIterator(prefetchPartitions=True):
            yield bytes(row.key), bytes(row.value)

    def compact(self, path: str) -> KVStore:
        """A new store at ``path`` of the current records alone."""
        made = KVStore(self.spark, path, self.bits)
        made.put(self.current(), bloom=True)
        return made
