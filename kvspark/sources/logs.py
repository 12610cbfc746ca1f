"""Raw key and value logs as a data source, ``format("kvlog")`` (OP-09, OP-12, OP-13, OP-19, OP-20, OP-31).

Fixed format: group g has a file ``%06d.keyLog`` of 8-byte keys and a file ``%06d.log`` of values of one width, matched by
ordinal, under the number g; when a file has its full count of records, the next has the number g + 1024, and so on.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass, field
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.layout import SLICE
from ..schema import GROUPS, KEY_BYTES, VALUE_BYTES

SCHEMA = "grp int, slot long, key binary, value binary"
#: Records that are read at once, and files that are looked up or moved at once.
BATCH = 1024
#: Threads that give files their names.
MOVERS = 8
NAME = re.compile(r"(\d{6,})\.(log|keyLog)")


def _opened(options: dict) -> tuple[fs.FileSystem, str]:
    path = options["path"]
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    """Some files: of each group those from one place in its row of files up to another, ``(group, from, to)``."""

    def __init__(self, files: list[tuple[int, int, int]]):
        super().__init__(files)
        self.files = files


def _numbers(options: dict) -> Iterator[tuple[int, str]]:
    """The number and kind of each file; none if there is no folder yet. A local folder is never held as a whole."""
    system, path = _opened(options)
    if isinstance(system, fs.LocalFileSystem):
        if not os.path.isdir(path):
            return
        with os.scandir(path) as found:
            for entry in found:
                if m := NAME.fullmatch(entry.name):
                    yield int(m[1]), m[2]
    else:
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if m := NAME.fullmatch(info.base_name):
                yield int(m[1]), m[2]


class LogReader(DataSourceReader):
    """A task reads one file, or a share of all if a number of tasks is named. A record counts if its value lies whole in its
    file and its key is there; slots run on from file to file of a group. The driver counts the files of each group; tasks
    look up their numbers and sizes."""

    def __init__(self, options: dict):
        self.options = options
        self.width = int(options.get("valuebytes", VALUE_BYTES))
        self.values = options.get("values", "true").lower() == "true"
        self.keys = options.get("keys", "true").lower() == "true"
        self.tasks = int(options.get("tasks", 0))
        self.groups = {int(x) for x in options["groups"].split(",")} if options.get("groups") else None

    def partitions(self) -> list[Files]:
        counts = Counter(number % GROUPS for number, kind in _numbers(self.options) if kind == "log" and (self.groups is None or number % GROUPS in self.groups))
        total = sum(counts.values())
        n = min(self.tasks or total, total)
        shares: list[Files] = []
        own, at = [], 0
        for group in sorted(counts):
            done = 0
            while done < counts[group]:
                to = min(counts[group], done + total * (len(shares) + 1) // n - at)
                own.append((group, done, to))
                at, done = at + to - done, to
                if at == total * (len(shares) + 1) // n:
                    shares.append(Files(own))
                    own = []
        return shares or [Files([])]

    def _sized(self, partition: Files) -> Iterator[tuple[int, int, int, int]]:
        """The files of a share: (group, number, records, slot of the first)."""
        system, path = _opened(self.options)
        held: dict[int, array] = {group: array("q") for group, _, _ in partition.files}
        for number, kind in _numbers(self.options):
            if kind == "log" and number % GROUPS in held:
                held[number % GROUPS].append(number)
        for group, start, end in partition.files:
            slot, numbers = 0, sorted(held.pop(group))[:end]
            for at in range(0, len(numbers), BATCH):
                part = numbers[at : at + BATCH]
                sizes = [x.size or 0 for x in system.get_file_info([f"{path}/{number:06d}.log" for number in part])]
                keys = [x.size or 0 for x in system.get_file_info([f"{path}/{number:06d}.keyLog" for number in part])] if self.keys else sizes
                for i, number in enumerate(part):
                    n = min(sizes[i] // self.width, keys[i] // KEY_BYTES if self.keys else sizes[i])
                    if at + i >= start:
                        yield group, number, n, slot
                    slot += n

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, path = _opened(self.options)
        cut = lambda b, w, k: [b[i * w : (i + 1) * w] for i in range(k)]
        rows: tuple[list, ...] = ([], [], [], [])

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["grp", "slot", "key", "value"])
            for x in rows:
                x.clear()
            return batch

        for group, number, n, slot in self._sized(partition):
            with ExitStack() as held:
                keys = held.enter_context(system.open_input_file(f"{path}/{number:06d}.keyLog")) if self.keys and n else None
                values = held.enter_context(system.open_input_file(f"{path}/{number:06d}.log")) if self.values and n else None
                for at in range(0, n, BATCH):
                    k = min(BATCH, n - at)
                    if len(rows[0]) + k > BATCH:
                        yield made()
                    rows[0].extend([group] * k)
                    rows[1].extend(range(slot + at, slot + at + k))
                    rows[2].extend(cut(keys.read_at(k * KEY_BYTES, at * KEY_BYTES), KEY_BYTES, k) if keys else [None] * k)
                    rows[3].extend(cut(values.read_at(k * self.width, at * self.width), self.width, k) if values else [None] * k)
        if rows[0]:
            yield made()


@dataclass
class Written(WriterCommitMessage):
    """Files by temporary and final name; and runs of a group's files by first number, count and task, whose names follow from these."""

    files: list[tuple[str, str]] = field(default_factory=list)
    runs: list[tuple[int, int, int]] = field(default_factory=list)

    def moves(self, path: str, kinds: tuple[str, ...]) -> Iterator[tuple[str, str]]:
        yield from self.files
        for first, count, task in self.runs:
            for i in range(count):
                for kind in kinds:
                    name = f"{path}/{first + i * GROUPS:06d}.{kind}"
                    yield f"{name}.{task}.tmp", name


class LogWriter(DataSourceWriter):
    """Rows of a group have to come to one task, in order of slot: ``repartition("grp").sortWithinPartitions("grp", "slot")``.
    Files get their names when the job commits; a lost task leaves only temporary ones. What is appended to a group goes to
    new files behind its last, so its slots run on; two appends at once to one group are refused when they commit."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.options, self.overwrite = options, overwrite
        self.keys = options.get("keys", "true").lower() == "true"
        self.kinds = ("keyLog", "log") if self.keys else ("log",)
        self.rounds: dict[int, int] = {}
        for number, _ in () if overwrite else _numbers(options):
            self.rounds[number % GROUPS] = max(self.rounds.get(number % GROUPS, 0), number // GROUPS + 1)
        self.width = int(options.get("valuebytes", VALUE_BYTES))
        self.slice = int(options.get("slice", SLICE))

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        system, path = _opened(self.options)
        system.create_dir(path, recursive=True)
        task = TaskContext.get().taskAttemptId()
        runs: list[tuple[int, int, int]] = []
        group, n, keys, values = None, 0, None, None

        def turn(number: int):
            if runs and number == runs[-1][0] + runs[-1][1] * GROUPS:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1, task)
            else:
                runs.append((number, 1, task))
            pair = [] if self.keys else [None]
            for kind in self.kinds:
                pair.append(system.open_output_stream(f"{path}/{number:06d}.{kind}.{task}.tmp"))
            return pair

        def close() -> None:
            for file in (keys, values):
                if file:
                    file.close()

        for row in iterator:
            if self.keys and len(row.key) != KEY_BYTES or len(row.value) != self.width:
                raise ValueError(f"INVALID_ARGUMENT: keys have {KEY_BYTES} bytes and values {self.width}")
            if row.grp != group or n % self.slice == 0:
                close()
                if row.grp != group:
                    group, n = row.grp, 0
                keys, values = turn(group + GROUPS * (self.rounds.get(group, 0) + n // self.slice))
            if keys:
                keys.write(bytes(row.key))
            values.write(bytes(row.value))
            n += 1
        close()
        return Written(runs=runs)

    def _moves(self, messages: list[Written | None], path: str) -> Iterator[tuple[tuple[str, str], ...]]:
        """Some moves at a time, so that no list of all files is made."""
        return batched((x for message in messages if message for x in message.moves(path, self.kinds)), BATCH)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _opened(self.options)
        if self.overwrite:
            for number, kind in _numbers(self.options):
                system.delete_file(f"{path}/{number:06d}.{kind}")
        elif any(x.type != fs.FileType.NotFound for some in self._moves(messages, path) for x in system.get_file_info([name for _, name in some])):
            self.abort(messages)
            raise ValueError("another append to the same groups was faster")
        with ThreadPoolExecutor(MOVERS) as pool:
            for some in self._moves(messages, path):
                list(pool.map(lambda x: system.move(*x), some))

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _opened(self.options)
        for some in self._moves(messages, path):
            for temporary, _ in some:
                system.delete_file(temporary)


class KVLog(DataSource):
    """Options: path (a folder that all executors see, or a URI), valuebytes, slice, values (false: keys alone), keys (false: values alone),
    groups, tasks."""

    @classmethod
    def name(cls) -> str:
        return "kvlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(KVLog)
