"""Confirmed stops over a stream: frames may come late and in any order, the result is that of the batch operator."""

from __future__ import annotations

import pickle
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

#: Where transformWithState keeps its state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt over: a call and an access to the state cost milliseconds, whatever they hold.
BUCKETS = 1024


@dataclass
class Walk:
    """How far the frames of a key have been walked: frames so far, those that fit, the runs that reach up to now, how many fitted up to the last good frame; and the newest frame."""

    frames: int = 0
    good: int = 0
    silent_run: int = 0
    unfit_run: int = 0
    good_until: int = 0
    last_good: float | None = None
    stop_at: float | None = None
    sent: bool = False
    latest: float = float("-inf")

    def step(self, t: float, silent: bool, fits: bool, seconds: float, silence: float, failure: float) -> None:
        """One frame further; nothing moves after the stop."""
        if self.stop_at is not None:
            return
        self.silent_run = self.silent_run + 1 if silent else 0
        self.unfit_run = 0 if fits else self.unfit_run + 1
        if silent and self.silent_run * seconds >= silence - 1e-9 or not fits and self.unfit_run * seconds >= failure - 1e-9:
            self.stop_at = t
            return
        self.frames += 1
        if fits:
            self.good, self.last_good, self.good_until = self.good + 1, t, self.frames

    def result(self, seconds: float, least_cover: float, least_gain: float, end: float) -> tuple:
        cover = self.good / self.good_until if self.good_until else None
        accepted = cover is not None and cover >= least_cover and self.last_good + seconds - end >= least_gain
        return self.stop_at, self.last_good, cover, accepted


class Stops(StatefulProcessor):
    """Of each key of a bucket the frames that the watermark has not passed, and the walk over those it has; a key that got no frames for ``idle`` seconds is ended by a timer, one of a bucket."""

    def __init__(self, step: float, silence: float, failure: float, least_cover: float, least_gain: float, end: float, idle: float):
        self.rule, self.verdict, self.idle = (step, silence, failure), (step, least_cover, least_gain, end), idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("keys", "timer long, held binary")

    def _held(self) -> tuple[int | None, dict[str, tuple[Walk, list[tuple]]]]:
        """When the timer expires, and (walk, waiting frames) of each key."""
        found = self.state.get()
        if found is None:
            return None, {}
        return found[0], {k: (Walk(*w), left) for k, w, left in pickle.loads(found[1])}

    def _keep(self, timer: int | None, held: dict) -> None:
        """Puts the state back, with a timer no later than the first key is due."""
        due = min((self._due(walk) for walk, _ in held.values()), default=None)
        if due is None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.state.clear()
            return
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.state.update((timer, pickle.dumps([(k, astuple(w), left) for k, (w, left) in held.items()])))

    def _rows(self, told: list[tuple[str, Walk]]):
        if told:
            yield pd.DataFrame([(key, *walk.result(*self.verdict)) for key, walk in told], columns=["key", "stop_at", "last_good", "coverage", "accepted"])

    def handleInputRows(self, key, rows, timerValues):
        timer, held = self._held()
        new: dict[str, list[tuple]] = {}
        for part in rows:
            for k, *frame in zip(*(part[c].tolist() for c in ("key", "t", "silent", "fits")), strict=True):
                new.setdefault(k, []).append(tuple(frame))
        until, told = timerValues.getCurrentWatermarkInMs() / 1000, []
        for k, came in new.items():
            walk, left = held.get(k) or (Walk(), [])
            frames = left + came
            walk.latest = max(walk.latest, *(r[0] for r in came), float("-inf"))
            for r in sorted(r for r in frames if r[0] <= until):
                walk.step(*r, *self.rule)
            if walk.stop_at is not None and not walk.sent:
                walk.sent = True
                told.append((k, walk))
            held[k] = walk, [r for r in frames if r[0] > until] if walk.stop_at is None else []
        self._keep(timer, held)
        yield from self._rows(told)

    def _due(self, walk: Walk) -> int:
        return int((walk.latest + self.idle) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, held = self._held()
        over = [k for k, (walk, _) in held.items() if self._due(walk) <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())]
        told = []
        for k in over:
            walk, left = held.pop(k)
            for r in sorted(left):
                walk.step(*r, *self.rule)
            if not walk.sent:
                told.append((k, walk))
        self._keep(None, held)
        yield from self._rows(told)

    def close(self) -> None:
        pass


def streamed_stops(
    frames: DataFrame, key: list[str], at: str, silent: str, fits: str, step: float, late: str, idle: float,
    silence: float = 0.120, failure: float = 0.250, least_cover: float = 0.60, least_gain: float = 0.080, end: float = 0.0, buckets: int = BUCKETS,
) -> DataFrame:
    """``intervals.confirmed_stop`` over a stream: (key, stop_at, last_good, coverage, accepted), times in seconds of ``at``.

    frames: key, ``at`` (timestamp), ``silent``, ``fits`` (boolean). Frames up to ``late`` behind the newest count wherever
    they come; older ones are dropped. A stop is told as soon as the watermark confirms it, once; a key without one is told
    when the watermark is ``idle`` seconds past its last frame, and then forgotten. The state of a key is its frames that
    the watermark has not passed, and one row; keys (of types that JSON holds) share calls and state in ``buckets``. The session needs the state store ``PROVIDER``."""
    own = F.struct(*key)
    named = frames.withWatermark(at, late).select(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket"), F.to_json(own).alias("key"), F.col(at).alias("at"), F.col(at).cast("double").alias("t"), F.col(silent).alias("silent"), F.col(fits).alias("fits"))
    schema = StructType([StructField("key", StringType())] + [StructField(n, DoubleType()) for n in ("stop_at", "last_good", "coverage")] + [StructField("accepted", BooleanType())])
    rows = named.groupBy("bucket").transformWithStateInPandas(Stops(step, silence, failure, least_cover, least_gain, end, idle), schema, "Append", "EventTime")
    names = F.from_json("key", StructType([frames.schema[k] for k in key]))
    return rows.select(names.alias("k"), "stop_at", "last_good", "coverage", "accepted").select("k.*", "stop_at", "last_good", "coverage", "accepted")
