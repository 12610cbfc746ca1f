"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Texts can be long, so that a batch of Spark's default of 10,000 rows may not fit; a session that names a number keeps it.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package; bound Arrow batches; name a checkpoint folder if none is named and all runs on one machine."""
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, "1024")
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local["):
            raise RuntimeError("name a folder that the driver and all executors see in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kvspark-checkpoint-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    ready(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and where it lies.

    Unlike a checkpoint, which keeps the size that was estimated for its plan, a table has a size of its own: in a loop
    of joins, estimates are multiplied until the numbers themselves take minutes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def few(spark: SparkSession) -> int:
    """Into how many files a result goes: an eighth of the shuffle partitions, but four for each core of the cluster at least.

    For ``coalesce`` behind the last step, which leaves a frame of fewer partitions as it is. Each file costs the executor
    that creates it a few processes beside its bytes.
    """
    return max(4 * spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a decode and an encode for each row."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def fold(doc_id: str, modulus: int, held: int) -> "F.Column":
    """True where crc32 of the id as text leaves ``held``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == held, F.lit(False))
