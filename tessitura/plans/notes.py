"""Units and frames to notes: the whole chain from sung frames to reviewed pitches and durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators import intervals, sequence, series, words

LEAST_FRAMES = 3


def notes(units: DataFrame, frames: DataFrame, width: float = 0.25) -> DataFrame:
    """One note for each unit.

    units: song_id, unit, word_id, block, start, end, core_start, core_end, warnings; frames: song_id, t, midi,
    voiced_prob, energy, chroma, harmonic_confidence. Frames are tried in the core, then in the whole unit, then in a
    wider window; a unit without any takes the note before it, else the song's centre."""
    wide = words.wider_window(units, ["song_id"], ["start", "unit"], "block")
    tiers = wide.select("song_id", "unit", F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(k).alias("rank"), F.col(a).alias("a"), F.col(b).alias("b")) for k, (n, a, b) in enumerate((("core", "core_start", "core_end"), ("whole", "start", "end"), ("wide", "window_start", "window_end")))])).alias("x")).select("song_id", "unit", "x.*")
    voiced = words.pitch_frames(frames)
    inside = intervals.points_in_intervals(voiced.select("song_id", "t", "midi", "voiced_prob", "energy"), tiers, ["song_id"], "t", "a", "b", width)
    n = inside.groupBy("song_id", "unit", "tier", "rank").agg(F.count("*").alias("n"))
    best = n.groupBy("song_id", "unit").agg(F.max_by(F.struct("tier", "n"), F.struct((F.col("n") >= LEAST_FRAMES).cast("int").alias("enough"), F.when(F.col("n") >= LEAST_FRAMES, 0).otherwise(F.col("n")).alias("most"), (-F.col("rank")).alias("first"))).alias("b")).select("song_id", "unit", "b.tier", F.col("b.n").alias("n_frames"))
    key = ["song_id", "unit"]
    own = series.pitch_weight(inside.join(best, [*key, "tier"]), key, "voiced_prob", "energy")
    centres = series.plateau_centre(own, key, "midi", "weight", ["t"])
    song = series.plateau_centre(voiced.withColumn("w", F.pow("voiced_prob", F.lit(2.0))), ["song_id"], "midi", "w", ["t"], into="song_centre")
    steady = series.stability(own.join(centres, key), key, "midi", "weight", "centre")
    sure = own.groupBy(*key).agg(series.weighted_mean(F.col("voiced_prob"), F.col("weight")).alias("voice"))
    known = units.join(centres, key, "left").join(steady, key, "left").join(sure, key, "left").join(best, key, "left").join(song, "song_id", "left")
    dealt = series.candidates(known.withColumn("centre", F.coalesce("centre", "song_centre", F.lit(60.0))), "centre")
    near = own.join(dealt.select(*key, "pitch"), key).groupBy(*key, "pitch").agg((F.sum(F.when(F.abs(F.col("midi") - F.col("pitch")) <= 0.65, F.col("weight")).otherwise(0.0)) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("occupancy"))
    heard = intervals.points_in_intervals(frames.select("song_id", "t", "chroma", "harmonic_confidence"), units.select("song_id", "unit", "start", "end"), ["song_id"], "t", "start", "end", width, closed=True)
    harmony = series.harmonic_support(heard.join(dealt.select(*key, "pitch"), key), [*key, "pitch"], "chroma", "harmonic_confidence", "pitch").withColumnRenamed("confidence", "harmonic")
    w = series.WEIGHTS
    scored = dealt.join(near, [*key, "pitch"], "left").join(harmony, [*key, "pitch"], "left").fillna(0.0, ["occupancy", "support", "harmonic"])
    base = w["proximity"] * F.col("proximity") + w["occupancy"] * F.col("occupancy") + w["harmony"] * F.col("support")
    cands = scored.withColumn("base", base).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pitch", F.col("base").alias("score")))).alias("cands"), F.max("harmonic").alias("harmonic"))
    chosen = sequence.note_continuity(units.select(*key, "start", "end").join(cands.select(*key, "cands"), key))
    out = known.join(chosen, key).join(cands.select(*key, "harmonic"), key)
    has = F.coalesce("n_frames", F.lit(0)) > 0
    sure_of = series.confidence(F.col("score"), F.col("runner_up"), F.coalesce("voice", F.lit(0.0)), F.coalesce("stability", F.lit(0.0)), F.col("harmonic"), has)
    reasons = series.reasons({"low_confidence": F.col("confidence") < 0.55, "no_voiced_frames": ~has, "large_correction": has & (F.abs(F.col("pitch") - F.col("centre")) * 100 >= 90), "weak_harmony": F.col("harmonic") < 0.10})
    noted = out.withColumn("confidence", sure_of).withColumn("reasons", F.array_distinct(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), reasons)))
    grouped = words.contiguous_groups(noted, ["song_id"], ["start", "unit"], "word_id", "block", "start", "end")
    return intervals.redistribute(grouped, ["song_id", "group_no"], ["start", "unit"], "start", "end").select("song_id", "unit", "word_id", "block", "pitch", "centre", "score", "confidence", "tier", "n_frames", "reasons", F.col("new_start").alias("start"), F.col("new_end").alias("end"))
