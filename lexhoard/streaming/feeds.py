"""Streaming forms of the incremental update."""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lexhoard.functions.ids import content_fingerprint
from lexhoard.plans.store import HashedTable

#: Changes given out at once.
OUT_ROWS = 10_000
#: Snapshots that one row of the state holds.
PACKED = 1_000


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_changed(stream: DataFrame, id_col: str, ts: str, delay: str = "7 days", excludes: tuple[str, ...] = ()) -> DataFrame:
    """Rows that arrive again unchanged within the delay are dropped; changed ones pass. The watermark bounds the state."""
    out = stream.withColumn("fingerprint", content_fingerprint(stream, [ts, *excludes])).withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col, "fingerprint"])


def foreach_batch_upsert(table: HashedTable, order: str | None = "retrieved_at") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the newest row of each key in the batch replaces the stored one if that is older and differs. Only
    folders with changes are written; a batch that runs again changes nothing. For records that are merged, see
    `lexhoard.plans.jobs.foreach_batch_update`."""

    def upsert(batch: DataFrame, number: int) -> None:
        table.apply(batch, number, order=order)

    return upsert


def _packed(rows: list) -> list[tuple[str]]:
    return [(json.dumps(rows[i : i + PACKED]),) for i in range(0, len(rows), PACKED)]


class _Changes(StatefulProcessor):
    """Rows: key, time, time in microseconds, tracked fields. Of each key: snapshots that wait for the watermark, and the last one that was released with the version then."""

    def __init__(self, tracked: list[str]):
        self.tracked = tracked

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed string")
        self.last = handle.getValueState("last", "fields string, version int")

    def handleInputRows(self, key, rows, timerValues):
        came = [(at, json.dumps([None if x is None or x != x else str(x) for x in fields])) for frame in rows for at, *fields in zip(*[frame[c].tolist() for c in frame.columns[2:]], strict=True)]
        self.waiting.appendList(_packed(came))
        self.handle.registerTimer(-(-min(came)[0] // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(r for (packed,) in (self.waiting.get() if self.waiting.exists() else ()) for r in json.loads(packed))
        split = bisect.bisect_right(rows, until, key=lambda r: r[0])
        due, rest = rows[:split], rows[split:]
        if rest:
            self.waiting.put(_packed(rest))
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        if not due:
            return
        last, version = self.last.get() if self.last.exists() else (None, 1)
        was, out = json.loads(last) if last else None, []
        for at, fields in due:
            if fields != last:
                now = json.loads(fields)
                if was is not None and (differ := [f for f, a, b in zip(self.tracked, was, now, strict=True) if a != b]):
                    version += 1
                    out.append((key[0], at, version, differ))
                last, was = fields, now
        self.last.update((last, version))
        for i in range(0, len(out), OUT_ROWS):
            yield pd.DataFrame(out[i : i + OUT_ROWS], columns=["key", "at", "version", "changed_fields"])

    def close(self) -> None:
        pass


def stream_snapshot_changes(stream: DataFrame, key: str, ts: str, tracked: list[str], delay: str = "7 days") -> DataFrame:
    """(key, ts, version, changed_fields) of snapshots whose tracked fields differ from the key's one before, in the order of time,
    whatever batches they come in: a snapshot waits in the state until the watermark, the greatest time seen less `delay`, has passed
    it. What comes later than that is dropped, as are rows without a key or a time. Snapshots of equal time follow each other by their
    fields.

    The state of a key is its last snapshot and those within the delay, PACKED to a row of the state, which are sorted in memory when they are released. Needs a
    state store with timers: the session's spark.sql.streaming.stateStore.providerClass is set to the RocksDB provider.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(stream.dtypes)
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts).cast("timestamp").alias(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), *tracked).withWatermark(ts, delay)
    out = rows.groupBy(key).transformWithStateInPandas(_Changes(tracked), f"key {kinds[key]}, at long, version int, changed_fields array<string>", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), "version", "changed_fields")
