"""Snapshots that come late: the stream equals the batch form whatever batches they come in."""

import datetime as dt
import json
import random

import pytest

from lexhoard.operators import history
from lexhoard.streaming import feeds

SCHEMA = "k long, ts timestamp, a string, b double"


@pytest.mark.parametrize("n_files", [1, 4, 12])
def test_late_snapshots_equal_batch(spark, tmp_path, n_files):
    rng = random.Random(n_files)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(4), start + dt.timedelta(seconds=rng.randrange(200)), rng.choice(["x", "y", None]), rng.choice([1.0, 2.5, None])) for _ in range(120)] + [(None, start, "x", 1.0), (1, None, "x", 1.0)]
    rng.shuffle(rows)
    end = (9, start + dt.timedelta(days=400), None, None)
    for i in range(n_files + 1):
        part = rows[i::n_files] if i < n_files else [end]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.stream_snapshot_changes(feeds.read_stream(spark, str(tmp_path / "in"), SCHEMA, 1), "k", "ts", ["a", "b"], "1 day")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["k"], r["ts"], r["version"], tuple(r["changed_fields"])) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    # Equal times follow each other by their fields, nulls last as JSON has them.
    good = [r for r in rows if r[0] is not None and r[1] is not None]
    want = []
    for k in range(4):
        mine = sorted((r for r in good if r[0] == k), key=lambda r: (r[1], _said(r)))
        version = 1
        for before, now in zip(mine, mine[1:], strict=False):
            fields = tuple(f for f, x, y in zip("ab", before[2:], now[2:], strict=True) if x != y)
            if fields:
                version += 1
                want.append((k, now[1], version, fields))
    assert got == sorted(want)
    batch = history.snapshot_history(spark.createDataFrame(good, SCHEMA), "k", "ts", ["a", "b"])
    assert batch.where("size(changed_fields) > 0").count() > 0.5 * len(want)


def _said(r):
    return json.dumps([None if x is None else str(x) for x in r[2:]])


def test_waiting_snapshots_are_packed():
    rows = [(i, "[]") for i in range(2 * feeds.PACKED + 1)]
    packed = feeds._packed(rows)
    assert len(packed) == 3 and [tuple(r) for (text,) in packed for r in json.loads(text)] == rows
