"""Confirmed stops over a stream of late and shuffled micro-batches, against the batch operator."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessitura.operators import intervals
from tessitura.streaming import stops

SCHEMA = "song string, part int, at timestamp, silent boolean, fits boolean"


def _frames(seed):
    r = random.Random(seed)
    rows = []
    for song in "abcdef":
        for part in range(2):
            t, kind = r.randrange(0, 50), 0
            for _ in range(r.randrange(3, 160)):
                if r.random() < 0.08:
                    kind = r.randrange(3)
                rows.append((song, part, (t := t + 1) / 100, kind == 2, kind == 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_batch(spark, tmp_path, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stops.PROVIDER)
    rows, r = _frames(seed), random.Random(seed)
    table = spark.createDataFrame(rows, "song string, part int, t double, silent boolean, fits boolean").withColumn("at", F.timestamp_millis(F.rint(F.col("t") * 1000).cast("long")))
    want = {(x["song"], x["part"]): tuple(x)[2:] for x in intervals.confirmed_stop(table, ["song", "part"], "t", "silent", "fits", 0.01).collect()}
    # Frames come up to half a second late; within a batch in any order.
    dealt = sorted(rows, key=lambda x: x[2] + r.random() * 0.5)
    batches = [dealt[k : k + 150] for k in range(0, len(dealt), 150)] + [[("zz", 0, 900.0, False, True)], [("zz", 0, 901.0, False, True)]]
    for k, batch in enumerate(batches):
        r.shuffle(batch)
        part = spark.createDataFrame(batch, "song string, part int, t double, silent boolean, fits boolean")
        part.select("song", "part", F.timestamp_millis(F.rint(F.col("t") * 1000).cast("long")).alias("at"), "silent", "fits").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = stops.streamed_stops(stream, ["song", "part"], "at", "silent", "fits", 0.01, "1 second", 5.0)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(240)
    assert not query.isActive
    found = spark.read.parquet(str(tmp_path / "out")).where("song <> 'zz'").collect()
    got = {(x["song"], x["part"]): tuple(x)[2:] for x in found}
    assert len(found) == len(got) and sorted(got) == sorted(want)
    for k, (stop, last, cover, ok) in want.items():
        assert got[k][3] == ok and got[k][:3] == pytest.approx((stop, last, cover), abs=1e-6, nan_ok=True), k


def test_walk_against_rules():
    """The walk by itself: silence, failure, and nothing after the stop."""
    walk = stops.Walk()
    for k in range(60):
        walk.step(k / 100, 20 <= k, k < 20, 0.01, 0.120, 0.250)
    assert walk.result(0.01, 0.6, 0.08, 0.0) == (0.31, 0.19, 1.0, True)
    none = stops.Walk()
    none.step(0.0, False, False, 0.01, 0.12, 0.25)
    assert none.result(0.01, 0.6, 0.08, 0.0) == (None, None, None, False)


class _Handle:
    """State and timers of one group, and how often they are asked."""

    def __init__(self):
        self.state, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.state

    def update(self, value):
        self.calls, self.state = self.calls + 1, value

    def clear(self):
        self.state = None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_keys_share_calls_to_the_state():
    """A batch of a thousand keys asks the state as often as one of one key; each key is told once, when it is idle for long enough."""
    handle, walker = _Handle(), stops.Stops(1.0, 2.0, 4.0, 0.6, 0.0, 0.0, 10.0)
    walker.init(handle)
    keys = [str(k) for k in range(1000)]
    for t in (0.0, 1.0):
        batch = pd.DataFrame({"key": keys, "t": [t + k % 2 * 100 for k in range(1000)], "silent": False, "fits": True})
        assert not list(walker.handleInputRows((0,), iter([batch]), _At(0)))
    assert handle.calls <= 6 and len(handle.timers) == 1
    for ms, told in ((11_001, 500), (111_001, 500)):
        assert handle.timers and min(handle.timers) <= ms
        handle.timers.clear()
        rows = list(walker.handleExpiredTimer((0,), _At(ms), _At(ms)))
        assert sum(map(len, rows)) == told and set(rows[0]["coverage"]) == {1.0}
    assert handle.state is None and not handle.timers
