"""Structured Streaming over records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..store import KVStore


def append_to(store: KVStore, records: DataFrame, checkpoint: str) -> StreamingQuery:
    """Put every micro-batch of a stream of (key, value, seq). A repeated batch repeats records of equal ``seq``, which
    the last-write-wins view shows once."""
    return records.writeStream.foreachBatch(lambda batch, _: store.put(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_latest(records: DataFrame) -> DataFrame:
    """A stream of (key_long, value double, seq) as a stream of the latest so far of each key, whenever it changes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, value = state.get if state.exists else (None, None)
        before = seq
        for frame in frames:
            row = frame.loc[frame.seq.idxmax()]
            if seq is None or row.seq > seq:
                seq, value = int(row.seq), float(row.value)
        state.update((seq, value))
        if seq != before:
            yield pd.DataFrame({"key_long": [key[0]], "value": [value], "seq": [seq]})

    return records.select("key_long", "value", "seq").groupBy("key_long").applyInPandasWithState(
        step, "key_long long, value double, seq long", "seq long, value double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records in event-time windows, closed once the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select("window.start", "n")
