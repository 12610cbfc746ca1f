"""Line dedup with levelled sorted runs (operator 5).

State is a set of runs in the shared folder: tables ``(h1, h2, owner)``, bucketed by and sorted on the 128-bit
line key, so that a batch merge-joins them with no shuffle of their own. A batch (a range of ids, in rising
order) reduces its lines to one row a key, anti-joins every run, and adds what is new as a run of level 0.
``fanout`` runs of one level are merged into one run of the next level.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ready, shared_dir, utf8

#: Stands for a null id: such rows count as one document after all others.
LAST = (1 << 63) - 1
KEYS = "rid long, h1 long, h2 long"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Shuffle partitions whose keys make one bucket of a run: a key takes 24 bytes, however long its line.
TOGETHER = 8


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of a line, or None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def keys_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each document and distinct line key in it. docs: (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, found = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for text in utf8(batch.column(1)):
                own = {line_key(x, min_chars) for x in (text or b"").split(b"\n")}
                own.discard(None)
                counts.append(len(own))
                found.extend(own)
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["rid", "h1", "h2"])

    return docs.mapInArrow(run, KEYS)


class Runs:
    """The levelled runs of one dedup state, in the folder ``at`` or a new one of the shared folder.

    A run's folder says its level and buckets, and counts once it is whole, so a state that was opened before can be opened
    again and goes on with the next batch. While it is open, its runs are tables of the session.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, at: str | None = None):
        self.spark, self.fanout, self.name = spark, fanout, f"line_runs_{uuid.uuid4().hex}"
        self.dir, self.levels, self.written = at or f"{shared_dir(spark)}/{self.name}", [[]], 0
        self.buckets = -(-int(spark.conf.get(PARTITIONS)) // TOGETHER)
        self.folders: dict[str, str] = {}
        for folder, number, level, buckets in sorted(self._found(), key=lambda x: x[1]):
            name = self._named(folder, level)
            spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{self.dir}/{folder}'")
            self.written = max(self.written, number + 1)

    @contextmanager
    def _dealt(self) -> Iterator[None]:
        """Shuffles here have as many parts as runs have buckets, so that a bucket meets its keys as it lies and is one file.

        Each part costs a task, a file for each run and, whatever it holds, a page of memory for each sort.
        """
        whole = self.spark.conf.get(PARTITIONS)
        self.spark.conf.set(PARTITIONS, str(self.buckets))
        try:
            yield
        finally:
            self.spark.conf.set(PARTITIONS, whole)

    def _found(self) -> list[tuple[str, int, int, int]]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.dir)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
        whole = [x for x in names if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{x}/_SUCCESS"))]
        return [(x, *map(int, m.groups())) for x in whole if (m := re.fullmatch(r"run_(\d+)_level_(\d+)_buckets_(\d+)", x))]

    def _named(self, folder: str, level: int) -> str:
        name = f"{self.name}_{folder}"
        self.folders[name] = f"{self.dir}/{folder}"
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _write(self, rows: DataFrame, level: int) -> None:
        folder, self.written = f"run_{self.written:06d}_level_{level}_buckets_{self.buckets}", self.written + 1
        # By the number of the bucket, so that each is one file in whatever parts the rows come.
        bucket = F.pmod(F.hash("h1", "h2"), F.lit(self.buckets))
        (rows.repartitionById(self.buckets, bucket).write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.dir}/{folder}").saveAsTable(f"{self.name}_{folder}"))
        self._named(folder, level)

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key is in no run."""
        for name in self.runs():
            keys = keys.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Take in one batch, whose ids all lie above those of earlier batches. keys: as ``keys_of`` gives them."""
        with self._dealt():
            first = keys.groupBy("h1", "h2").agg(F.min("rid").alias("owner"))
            self._write(self.unseen(first), 0)
            level = 0
            while len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                self._write(self._rows(old), level + 1)
                self.levels[level] = []
                for name in old:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                    discard(self.spark, self.folders.pop(name))
                level += 1

    def close(self) -> None:
        """Take the runs out of the session's catalog; their folders stay."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _rows(self, runs: list[str]) -> DataFrame:
        """The rows of runs, without their bucketing: a union of bucketed tables is written as it lies, several files a bucket."""
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(*map(self.folders.__getitem__, runs))

    def owners(self) -> DataFrame:
        """Every key once, with the smallest id that holds it. Read without the bucketing, so that a hot key's join can be split."""
        return self._rows(self.runs())


def _batches(docs: DataFrame, n: int) -> list[tuple[int | None, int | None]]:
    """``n`` ranges [low, high) of rid of about as many documents each, rising."""
    at = [] if n < 2 else docs.approxQuantile("rid", [i / n for i in range(1, n)], 0.01)
    cuts = sorted({int(x) for x in at})
    return list(zip([None, *cuts], [*cuts, None]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3, at: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and two more columns ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. A key of ``min_chars`` code
    points or more keeps its lines only in the document of the smallest id that holds it, all of them there.
    A null or empty text is one empty line and gives an empty text. Null ids count as one document behind all
    others; rows that share an id count as one document. No rows: no rows. Columns of ``docs`` named ``n_lines``
    or ``n_dropped`` are replaced; all others are carried along unread. Ids have to be numbers. at: a folder that holds
    the runs of earlier calls, whose ids were all smaller; lines known there go here too, and this call's are added.
    Keys are told apart by 128 bits; the lost lines of one text by 64 of them.
    """
    spark = docs.sparkSession
    ready(spark)
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    narrow = docs.select(rid.alias("rid"), F.col(text_col).alias("text"))
    state = Runs(spark, fanout, at)
    for low, high in _batches(docs.select(F.col(id_col).cast("long").alias("rid")), batches):
        # On the id column itself, so that the filter reaches the scan.
        part = docs
        if low is not None:
            part = part.where((F.col(id_col) >= low) | F.col(id_col).isNull() if high is None else F.col(id_col) >= low)
        if high is not None:
            part = part.where(F.col(id_col) < high)
        state.add(keys_of(part.select(rid.alias("rid"), F.col(text_col).alias("text")), min_chars))
    state.close()
    lost = keys_of(narrow, min_chars).join(state.owners(), ["h1", "h2"]).where("owner <> rid").groupBy("rid").agg(F.collect_list("h1").alias("_ld_lost"))
    kept = docs.drop("n_lines", "n_dropped").withColumn("_ld_rid", rid).join(lost.withColumnRenamed("rid", "_ld_rid"), "_ld_rid", "left").drop("_ld_rid")
    names = [x for x in kept.columns if x != "_ld_lost"]
    schema = kept.select(*names).withColumn(text_col, F.lit("").cast("string")).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(utf8(batch.column(text_col)), batch.column("_ld_lost").to_pylist()):
                lines = (text or b"").split(b"\n")
                left = lines
                if lost:
                    lost = set(lost)
                    left = [x for x in lines if (k := line_key(x, min_chars)) is None or int.from_bytes(k[:8], "little", signed=True) not in lost]
                texts.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            own = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[x] if x in own else batch.column(x) for x in schema.names], schema.names)

    return kept.mapInArrow(cut, schema)
