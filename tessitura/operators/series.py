"""Weighted statistics, frame evidence and ranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean, the plain mean if no weight is positive."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(value * weight) / total).otherwise(F.avg(value))


def weighted_median(rows: DataFrame, key: list[str], value: str, weight: str, ties: list[str], into: str = "centre") -> DataFrame:
    """(key, into): the first value whose cumulated weight reaches half; the plain median if no weight is positive."""
    w = W.partitionBy(*key).orderBy(value, *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumns({"_c": F.sum(weight).over(w), "_t": F.sum(weight).over(W.partitionBy(*key))})
    reached = F.min(F.when(F.col("_c") >= F.col("_t") / 2, F.col(value)))
    return summed.groupBy(*key).agg(F.when(F.max("_t") > 0, reached).otherwise(F.percentile(value, F.lit(0.5))).alias(into))


def plateau_centre(rows: DataFrame, key: list[str], value: str, weight: str, ties: list[str], bin_width: float = 0.10, half_width: float = 0.55, into: str = "centre") -> DataFrame:
    """(key, into): weighted median of the values within ``half_width`` of the heaviest bin's middle (ties: lowest bin)."""
    low = F.floor(F.min(value).over(W.partitionBy(*key)) / bin_width)
    binned = rows.withColumn("_low", low).withColumn("_bin", F.floor(F.col(value) / bin_width) - F.col("_low"))
    heavy = binned.groupBy(*key, "_bin").agg(F.sum(weight).alias("_w"), F.min("_low").alias("_low"))
    best = heavy.groupBy(*key).agg(F.min_by(F.struct("_bin", "_low"), F.struct((-F.col("_w")).alias("a"), F.col("_bin").alias("b"))).alias("_b"))
    middle = best.select(*key, ((F.col("_b._bin") + F.col("_b._low")) * bin_width + bin_width / 2).alias("_middle"))
    near = rows.join(middle, key).where(F.abs(F.col(value) - F.col("_middle")) <= half_width + 1e-9)
    return weighted_median(near, key, value, weight, ties, into)


def pitch_weight(rows: DataFrame, key: list[str], probability: str, energy: str, floor: float = 0.35, into: str = "weight") -> DataFrame:
    """``rows`` with the square of the probability times the energy relative to its 90th percentile, floored."""
    p90 = F.percentile(energy, F.lit(0.9)).over(W.partitionBy(*key))
    relative = F.when(p90 <= 1e-12, F.lit(1.0)).otherwise(F.col(energy) / p90)
    return rows.withColumn(into, F.pow(F.greatest(F.col(probability), F.lit(0.01)), 2) * F.least(F.greatest(relative, F.lit(floor)), F.lit(1.0)))


def harmonic_support(frames: DataFrame, key: list[str], chroma: str, confidence: str, pitch: str) -> DataFrame:
    """(key, support, confidence): the chroma of the pitch class averaged with weights of at least 0.05; (0, 0) without frames."""
    share = F.element_at(chroma, (F.pmod(F.col(pitch), F.lit(12)) + 1).cast("int"))
    weight = F.greatest(F.col(confidence), F.lit(0.05))
    return frames.groupBy(*key).agg(F.coalesce(F.sum(share * weight) / F.sum(weight), F.lit(0.0)).alias("support"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("confidence"))


def stability(rows: DataFrame, key: list[str], value: str, weight: str, centre: str, width: float = 0.55) -> DataFrame:
    """(key, stability): the share of weight within ``width`` of the centre."""
    near = F.abs(F.col(value) - F.col(centre)) <= width
    return rows.groupBy(*key).agg(F.coalesce(F.sum(F.when(near, F.col(weight)).otherwise(0.0)) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0)).alias("stability"))


def reference_vector(rows: DataFrame, key: list[str], vector: str, into: str = "reference") -> DataFrame:
    """(key, into): the element-wise median, scaled to length one."""
    parts = rows.select(*key, F.posexplode(vector).alias("_d", "_v")).groupBy(*key, "_d").agg(F.percentile(F.col("_v").cast("double"), F.lit(0.5)).alias("_m"))
    whole = parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda x: x["_m"]).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return whole.select(*key, F.when(norm > 0, F.transform("_v", lambda x: x / norm)).otherwise(F.col("_v")).alias(into))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def flux(rows: DataFrame, key: list[str], order: list[str], vector: str, into: str = "flux") -> DataFrame:
    """``rows`` with the distance to the vector before; the first has 0."""
    w = W.partitionBy(*key).orderBy(*order)
    double = F.col(vector).cast("array<double>")
    return rows.withColumn(into, F.coalesce(vector_distance(double, F.lag(double).over(w)), F.lit(0.0)))


def smooth(rows: DataFrame, key: list[str], order: list[str], value: str, window: int = 9, into: str = "smooth") -> DataFrame:
    """Centred running median of an odd window, edges padded with the first and last values."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half, w = window // 2, W.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    values = [F.coalesce(F.lag(value, -k).over(w), (F.first(value) if k < 0 else F.last(value)).over(whole)) for k in range(-half, half + 1)]
    return rows.withColumn(into, F.get(F.array_sort(F.array(*values)), F.lit(half)))


def resample(series: DataFrame, grid: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Linear interpolation of a series at the times of ``grid``; 0 outside the series."""
    s = series.select(*key, F.col(at).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_g"))
    g = grid.select(*key, F.col(at).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_g"))
    before = W.partitionBy(*key).orderBy("_t", "_g").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy(*key).orderBy(F.desc("_t"), "_g").rowsBetween(W.unboundedPreceding, W.currentRow)
    point = F.when(F.col("_g") == 0, F.struct("_t", "_v"))
    found = s.unionByName(g).withColumns({"_a": F.last(point, ignorenulls=True).over(before), "_b": F.last(point, ignorenulls=True).over(after)}).where("_g = 1")
    a, b = F.col("_a"), F.col("_b")
    line = F.when(b["_t"] == a["_t"], a["_v"]).otherwise(a["_v"] + (b["_v"] - a["_v"]) * (F.col("_t") - a["_t"]) / (b["_t"] - a["_t"]))
    return found.select(*key, F.col("_t").alias(at), F.coalesce(line, F.lit(0.0)).alias(value))


def envelope(rows: DataFrame, key: list[str], number: str, value: str, bins: int) -> DataFrame:
    """(key, bin, low, high): extremes of ``bins`` equal parts of each series."""
    n = F.count("*").over(W.partitionBy(*key))
    return rows.withColumn("bin", F.floor(F.col(number) * F.lit(bins) / n)).groupBy(*key, "bin").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def activity(samples: DataFrame, key: list[str], number: str, value: str, frame: int = 320, level: float = 1e-4) -> DataFrame:
    """(key, activity): the share of full frames whose root mean square is over ``level``; a shorter signal is one frame."""
    f = samples.withColumn("_f", F.floor(F.col(number) / frame)).groupBy(*key, "_f").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_r"), F.count("*").alias("_n"))
    full = F.avg(F.when(F.col("_n") == frame, (F.col("_r") > level).cast("double")))
    return f.groupBy(*key).agg(F.coalesce(full, F.max((F.col("_r") > level).cast("double")), F.lit(0.0)).alias("activity"))


def longest_inner_gap(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """(key, longest_gap) between neighbouring times."""
    d = rows.withColumn("_g", F.col(at) - F.lag(at).over(W.partitionBy(*key).orderBy(at)))
    return d.groupBy(*key).agg(F.coalesce(F.max("_g"), F.lit(0.0)).alias("longest_gap"))


def tier_choice(rows: DataFrame, key: list[str], tiers: list[str], least: int = 3) -> DataFrame:
    """(key, tier, frames): the first tier (a flag column) with ``least`` frames, else the fullest (ties: the earliest)."""
    counts = [F.count_if(F.col(t)).alias(t) for t in tiers]
    n = rows.groupBy(*key).agg(*counts)
    enough = F.coalesce(*[F.when(F.col(t) >= least, F.lit(t)) for t in tiers])
    top = F.greatest(*[F.col(t) for t in tiers])
    fullest = F.coalesce(*[F.when((F.col(t) == top) & (top > 0), F.lit(t)) for t in tiers])
    tier = F.coalesce(enough, fullest, F.lit("none"))
    frames = F.coalesce(*[F.when(tier == t, F.col(t)) for t in tiers], F.lit(0))
    return n.select(*key, tier.alias("tier"), frames.alias("frames"))


WEIGHTS = {"proximity": 0.42, "occupancy": 0.23, "harmony": 0.30, "continuity": 0.05}


def candidates(centres: DataFrame, centre: str, reach: int = 2, low: int = 36, high: int = 96) -> DataFrame:
    """``centres`` with a row for each pitch within ``reach`` semitones, clipped to the range, and its proximity."""
    base = F.floor(F.col(centre) + 0.5).cast("int")
    first, last = F.greatest(base - reach, F.lit(low)), F.least(base + reach, F.lit(high))
    # A centre beyond the range has the nearest pitch.
    dealt = centres.withColumn("pitch", F.explode(F.sequence(F.least(first, F.lit(high)), F.greatest(last, F.lit(low)))))
    return dealt.withColumn("proximity", F.exp(-0.5 * F.pow((F.col("pitch") - F.col(centre)) * 100 / 75, 2)))


def top_candidates(scored: DataFrame, key: list[str], score: str, pitch: str = "pitch", k: int = 2) -> DataFrame:
    """The ``k`` best rows of each key with their rank; ties go to the lowest pitch."""
    w = W.partitionBy(*key).orderBy(F.desc(score), pitch)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def confidence(top: Column, second: Column, voice: Column, steadiness: Column, harmony: Column, has_frames: Column) -> Column:
    """0 to 1 from voice, stability, harmony and the margin over the runner-up (0 without one)."""
    margin = F.greatest(F.lit(0.0), top - F.coalesce(second, F.lit(0.0)))
    raw = 0.35 * voice + 0.25 * steadiness + 0.20 * harmony + 0.20 * F.least(F.lit(1.0), margin / 0.2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(has_frames, raw).otherwise(raw * 0.45)))


def reasons(named: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


#: Difficulty bands of a song.
BASE_PITCH, TOP_PITCH, PITCH_KINDS = 60, 84, 12


def difficulty(notes: DataFrame, key: list[str], pitch: str, start: str, end: str) -> DataFrame:
    """(key, score, band): the highest pitch (85 %) and the number of different ones (15 %); invalid notes make the band null."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    invalid = F.coalesce((F.col(end) <= F.col(start)) | F.isnan(F.col(pitch).cast("double")) | (F.col(pitch) < 0) | (F.col(pitch) > 127) | (F.col(pitch) != F.floor(pitch)), F.lit(True))
    got = notes.groupBy(*key).agg(F.max(pitch).alias("peak"), F.count_distinct(pitch).alias("kinds"), F.count_if(invalid).alias("invalid"))
    score = 0.85 * clip((F.col("peak") - BASE_PITCH) / (TOP_PITCH - BASE_PITCH)) + 0.15 * clip((F.col("kinds") - 1) / (PITCH_KINDS - 1))
    band = F.when(score >= 0.65, F.lit("advanced")).when(score >= 0.35, F.lit("intermediate")).otherwise(F.lit("beginner"))
    return got.select(*key, F.when(F.col("invalid") == 0, score).alias("score"), F.when(F.col("invalid") == 0, band).alias("band"))


def harmonic_frames(frames: DataFrame, key: list[str], order: list[str], chroma: str = "chroma", energy: str = "rms", window: int = 9) -> DataFrame:
    """``frames`` with chroma smoothed in time and scaled to a peak of one, and harmonic_confidence.

    Confidence is how far the largest share exceeds an even one, times the energy between its 15th and 70th percentiles."""
    w = W.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    half = window // 2
    logged = frames.withColumn("_c", F.transform(F.col(chroma).cast("array<double>"), lambda x: F.log1p(10 * x)))
    around = F.array(*[F.coalesce(F.lag("_c", -k).over(w), (F.first("_c") if k < 0 else F.last("_c")).over(whole)) for k in range(-half, half + 1)])
    near = logged.withColumn("_near", around)
    smoothed = near.withColumn("_c", F.transform(F.col("_c"), lambda x, i: F.get(F.array_sort(F.transform(F.col("_near"), lambda v: F.get(v, i))), F.lit(half))))
    total, peak = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x), F.array_max("_c")
    share = F.when(total > 1e-12, peak / total).otherwise(0.0)
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    low, high = (F.percentile(energy, F.lit(q)).over(W.partitionBy(*key)) for q in (0.15, 0.70))
    loud = F.when(high - low <= 1e-12, (F.col(energy) > 0).cast("double")).otherwise(clip((F.col(energy) - low) / (high - low)))
    confident = clip((share - 1 / 12) / (0.30 - 1 / 12)) * loud
    scaled = F.transform("_c", lambda x: F.when(peak > 1e-12, x / peak).otherwise(0.0))
    return smoothed.withColumns({"harmonic_confidence": confident, "_scaled": scaled}).withColumn(chroma, F.col("_scaled")).drop("_c", "_near", "_scaled")
