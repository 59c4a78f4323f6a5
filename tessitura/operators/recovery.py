"""Recovery of lyric tokens in planned gaps: reused times, minus what is occupied, as islands of consecutive tokens of a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators import intervals
from tessitura.operators.alignment import reused_times

LEAST_SCORE, LEAST_ACTIVITY, AUDIBLE = 0.10, 0.20, 1e-4


def stretches(tokens: DataFrame) -> DataFrame:
    """(song_id, gap, first_token, last_token, start, end, score): runs of tokens (song_id, gap, pos, line, start, end, score) that follow each other in one line."""
    islands = intervals.contiguous(tokens, ["song_id", "gap", "line"], "pos")
    finite = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    return islands.groupBy("song_id", "gap", "line", "island").agg(
        F.min("pos").alias("first_token"), F.max("pos").alias("last_token"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.max(finite).alias("score")
    ).drop("line", "island")


def with_activity(found: DataFrame, sound: DataFrame | None) -> DataFrame:
    """``found`` (song_id, start, end, …) with the share of its frames (song_id, t, rms) that can be heard; null without any sound, 0 in a stretch without frames."""
    if sound is None:
        return found.withColumn("activity", F.lit(None).cast("double"))
    key = ["song_id", "start", "end"]
    inside = intervals.points_in_intervals(sound.select("song_id", "t", "rms"), found.select(*key).distinct(), ["song_id"], "t", "start", "end", 0.25)
    heard = inside.groupBy(*key).agg(F.avg((F.col("rms") > AUDIBLE).cast("double")).alias("activity"))
    has = sound.select("song_id").distinct().withColumn("_has", F.lit(True))
    return found.join(heard, key, "left").join(has, "song_id", "left").withColumn("activity", F.when(F.col("_has"), F.coalesce("activity", F.lit(0.0)))).drop("_has")


def recover_gaps(gaps: DataFrame, expected: DataFrame, found: DataFrame, occupied: DataFrame, sound: DataFrame | None = None) -> DataFrame:
    """(song_id, gap, state, first_token, last_token, start, end): captions recovered in each gap, or one row without times.

    gaps: song_id, gap, gap_start, gap_end; expected: song_id, gap, pos, line, text, key; found: song_id, gap, no, text, key,
    start, end, score; occupied: song_id, start, end. A stretch needs a score of ``LEAST_SCORE`` and, where there is
    sound (song_id, t, rms by 20 ms), ``LEAST_ACTIVITY``. state: none, partial or full."""
    key = ["song_id", "gap"]
    windows = gaps.select(*key, F.col("gap_start").alias("low"), F.col("gap_end").alias("high"))
    times = reused_times(expected, found, windows, key).join(expected.select(*key, "pos", "line"), [*key, "pos"])
    free = intervals.conflict_free(times, occupied, ["song_id"], "start", "end")
    kept = with_activity(stretches(free), sound).where((F.col("score") >= LEAST_SCORE) & (F.col("activity").isNull() | (F.col("activity") >= LEAST_ACTIVITY)))
    asked = expected.groupBy(*key).agg(F.count("*").alias("asked"))
    whole = gaps.select(*key).join(asked, key, "left").join(kept.drop("score", "activity"), key, "left")
    n = F.sum(F.coalesce(F.col("last_token") - F.col("first_token") + 1, F.lit(0))).over(W.partitionBy(*key))
    state = F.when(n == 0, "none").when(n == F.col("asked"), "full").otherwise("partial")
    return whole.withColumn("state", state).select(*key, "state", "first_token", "last_token", "start", "end")
