"""Harmony of accompaniment from its sound: what rings is kept, its tuning is told, and each frame is summed up in twelve pitch classes.

Sound that rings is smooth in time, what is struck is smooth in frequency: two running medians of the spectrum tell them
apart. The tuning of a song is the most frequent deviation of its spectral peaks from whole semitones. A constant-Q
kernel at that tuning, kept as the few spectral bins that each of its filters has, gives the level of each pitch. Each
step works on chunks with a halo, so a task holds a chunk of a song.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators import series
from tessitura.operators.frames import chunks

#: Frame and hop of the separation, lengths of its medians, how much louder than what is struck the ringing must be.
SIZE, STEP, SPAN, MARGIN = 2048, 512, 31, 8.0
#: Peaks: range in hertz, share of the loudest of a frame, width of a bin of the tuning in semitones.
PEAK_LOW, PEAK_HIGH, PEAK_SHARE, TUNING_BIN = 150.0, 4000.0, 0.1, 0.01
#: Pitches: the lowest (C1), octaves, filters an octave, frames a second are rate / HOP.
LOWEST, OCTAVES, PER_OCTAVE, HOP = 32.703195662574764, 7, 36, 256
#: Weights of a filter's spectrum under this share of its largest are left out.
_SPARSE = 0.005


def _median(x: np.ndarray, axis: int) -> np.ndarray:
    """Running median over SPAN values; beyond the ends values come back in reverse."""
    half = SPAN // 2
    padded = np.pad(x, [(half, half) if k == axis else (0, 0) for k in range(2)], mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, SPAN, axis), axis=-1)


def ringing(x: np.ndarray, first: int, n: int, total: int, offset: int, margin: float = MARGIN) -> np.ndarray:
    """Samples ``first`` to first + n - 1 of the ringing part of a signal of ``total`` samples, of which ``x`` stands at ``offset``."""
    window = np.hanning(SIZE + 1)[:-1]
    last_frame = total // STEP
    reach = SIZE // 2 // STEP
    low, high = max(0, first // STEP - reach), min(last_frame, (first + n - 1) // STEP + 1 + reach)
    begin, end = max(0, low - SPAN // 2), min(last_frame, high + SPAN // 2)
    place = np.arange(begin, end + 1) * STEP - SIZE // 2
    padded = np.zeros(place[-1] + SIZE - place[0])
    a, b = max(offset, place[0]), min(offset + len(x), place[-1] + SIZE)
    if b > a:
        padded[a - place[0] : b - place[0]] = x[a - offset : b - offset]
    spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, SIZE)[::STEP] * window, axis=1)
    level = np.abs(spectrum)
    rings, struck = _median(level, 0), _median(level, 1) * margin
    top = np.maximum(rings, struck)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(top > np.finfo(float).tiny, (rings / top) ** 2 / ((rings / top) ** 2 + (struck / top) ** 2), 0.0)
    kept = np.fft.irfft(spectrum * share, SIZE, axis=1) * window
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for k in range(low - begin, high - begin + 1):
        out[k * STEP : k * STEP + SIZE] += kept[k]
        weight[k * STEP : k * STEP + SIZE] += window**2
    whole = np.divide(out, weight, out=np.zeros_like(out), where=weight > 1e-8)
    return whole[first - place[0] : first - place[0] + n]


def ringing_part(signals: DataFrame, key: str = "song_id", blocks: int = 256) -> DataFrame:
    """(key, samples, rate): the ringing part of each signal (key, samples, rate), made in chunks of ``blocks`` hops with a halo and put together again."""
    x, size = F.col("samples"), blocks * STEP
    total, halo = F.size(x), (SPAN // 2 + 3 * SIZE // STEP) * STEP

    def chunk(c):
        first = c * size
        low, high = F.greatest(first - halo, F.lit(0)), F.least(first + size + halo, total)
        return F.struct(c.alias("chunk"), first.alias("first"), F.least(F.lit(size), total - first).alias("n"), total.alias("total"), low.alias("low"), F.slice(x, low + 1, high - low).alias("part"))

    each = F.when(total > 0, F.transform(F.sequence(F.lit(0), F.floor((total - 1) / size).cast("int")), chunk))
    parts = signals.select(key, "rate", F.explode(each).alias("c")).select(key, "rate", "c.*")
    kind = dict(signals.dtypes)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                number, first, n, all_, low = (batch.column(c)[k].as_py() for c in range(2, 7))
                own = ringing(batch.column(7)[k].values.to_numpy(zero_copy_only=False).astype(float), first, n, all_, low)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([number]), pa.array([own], pa.list_(pa.float64()))], [key, "rate", "chunk", "samples"])

    made = parts.select(key, "rate", *[F.col(c).cast("long") for c in ("chunk", "first", "n", "total", "low")], F.col("part").cast("array<double>"))
    found = made.mapInArrow(run, f"`{key}` {kind[key]}, rate {kind['rate']}, chunk long, samples array<double>")
    whole = found.groupBy(key, "rate").agg(F.array_sort(F.collect_list(F.struct("chunk", "samples"))).alias("c"))
    return whole.select(key, F.flatten(F.transform("c", lambda c: c["samples"])).alias("samples"), "rate")


def peaks(frames: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(hertz, level) of the spectral peaks of frames of SIZE samples, placed by a parabola through three bins."""
    s = np.abs(np.fft.rfft(frames * np.hanning(SIZE + 1)[:-1], axis=1))
    hertz = np.arange(s.shape[1]) * rate / SIZE
    loud = np.where(s > PEAK_SHARE * s.max(1, keepdims=True), s, 0)
    at = np.zeros(s.shape, bool)
    at[:, 1:-1] = (loud[:, 1:-1] > loud[:, :-2]) & (loud[:, 1:-1] >= loud[:, 2:])
    at &= (hertz >= PEAK_LOW) & (hertz < PEAK_HIGH)
    row, k = np.nonzero(at)
    half, bend = (s[row, k + 1] - s[row, k - 1]) / 2, 2 * s[row, k] - s[row, k + 1] - s[row, k - 1]
    shift = np.where(np.abs(bend) > np.finfo(float).tiny, half / np.where(bend == 0, 1, bend), 0)
    return (k + shift) * rate / SIZE, s[row, k] + half * shift / 2


def tuning(signals: DataFrame, key: str = "song_id", n_frames: int = 512) -> DataFrame:
    """(key, tuning): the deviation of each signal from whole semitones, -0.5 to 0.5, by the most frequent one among its louder half of peaks.

    A signal without peaks has tuning 0; ties go to the lowest."""
    rate = signals.select(key, "rate")
    parts = chunks(signals, key, n_frames, SIZE / 22050, STEP / 22050)
    kind = dict(signals.dtypes)[key]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, rate_, chunk, n, left = (batch.column(c)[k].as_py() for c in range(5))
                step, size = max(1, round(rate_ * STEP / 22050)), max(8, round(rate_ * SIZE / 22050))
                x = np.zeros((n - 1) * step + max(size, SIZE))
                part = batch.column(5)[k].values.to_numpy(zero_copy_only=False)
                x[left : left + len(part)] = part
                frames = np.lib.stride_tricks.sliding_window_view(x, SIZE)[::step][1 if chunk else 0 : n]
                hertz, level = peaks(frames, rate_)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hertz), batch.column(0).type), pa.array(hertz), pa.array(level)], [key, "hertz", "level"])

    columns = parts.select(key, F.col("rate").cast("int"), F.col("chunk").cast("int"), F.col("n").cast("int"), F.col("left").cast("int"), F.col("part").cast("array<double>"))
    found = columns.mapInArrow(run, f"`{key}` {kind}, hertz double, level double").where("hertz > 0")
    loud = found.withColumn("_median", F.percentile("level", F.lit(0.5)).over(W.partitionBy(key))).where("level >= _median")
    away = F.pmod(12 * F.log2(F.col("hertz") / 440), F.lit(1.0))
    slot = F.floor((F.when(away >= 0.5, away - 1).otherwise(away) + 0.5) / TUNING_BIN)
    counted = loud.groupBy(key, slot.alias("slot")).agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.min_by("slot", F.struct(-F.col("n"), "slot")).alias("slot"))
    return rate.join(best, key, "left").select(key, F.coalesce(F.col("slot") * TUNING_BIN - 0.5, F.lit(0.0)).alias("tuning"))


@lru_cache(8)
def constant_q(rate: int, deviation: float, per_octave: int = PER_OCTAVE) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(size, bins, weights, starts): filters of equal ratio of pitch and width, as the spectral bins and weights that each has, one after the other."""
    quality = 1 / (2 ** (1 / per_octave) - 1)
    hertz = LOWEST * 2 ** (deviation / 12) * 2 ** (np.arange(OCTAVES * per_octave) / per_octave)
    hertz = hertz[hertz * (1 + 1 / quality) < rate / 2]
    size = 1 << int(np.ceil(np.log2(quality * rate / hertz[0])))
    bins, weights, starts = [], [], []
    for f in hertz:
        n = int(np.ceil(quality * rate / f))
        t = np.arange(n) - n // 2
        shape = np.hanning(n + 1)[:-1] / np.hanning(n + 1)[:-1].sum() * np.sqrt(n)
        filter_ = np.zeros(size, complex)
        filter_[size // 2 - n // 2 : size // 2 - n // 2 + n] = shape * np.exp(2j * np.pi * f * t / rate)
        spectrum = np.fft.fft(filter_)[: size // 2 + 1]
        some = np.flatnonzero(np.abs(spectrum) >= _SPARSE * np.abs(spectrum).max())
        starts.append(sum(map(len, bins)))
        bins.append(some)
        weights.append(np.conj(spectrum[some]) / size)
    return size, np.concatenate(bins), np.concatenate(weights), np.array(starts)


def classes(frames: np.ndarray, rate: int, deviation: float, per_octave: int = PER_OCTAVE) -> np.ndarray:
    """Levels of the twelve pitch classes, from C, of frames of the kernel's size."""
    size, bins, weights, starts = constant_q(rate, deviation, per_octave)
    spectrum = np.fft.rfft(frames, axis=1)
    level = np.abs(np.add.reduceat(spectrum[:, bins] * weights, starts, axis=1))
    each = per_octave // 12
    near = (np.arange(level.shape[1]) + each // 2) // each % 12  # a class takes the filters around it
    out = np.zeros((len(frames), 12))
    for k in range(12):
        out[:, k] = level[:, near == k].sum(1)
    return out


def chroma_frames(signals: DataFrame, tunings: DataFrame, key: str = "song_id", n_frames: int = 512, per_octave: int = PER_OCTAVE) -> DataFrame:
    """(key, i, t, chroma, rms): levels of pitch classes of each signal (key, samples, rate) at its tuning, every HOP samples."""
    tuned = signals.join(tunings, key)
    longest = (1 / (2 ** (1 / per_octave) - 1)) / LOWEST * 2 ** (0.5 / 12)
    # The frame must hold the longest filter at any tuning; its size is a power of two of the samples that this takes.
    kind = dict(signals.dtypes)[key]
    window = 2.0 * longest
    parts = chunks(tuned, key, n_frames, window, HOP / 22050).join(tunings, key)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, rate, chunk, first, n, left, deviation = (batch.column(c)[k].as_py() for c in range(7))
                step, reach = max(1, round(rate * HOP / 22050)), max(8, round(rate * window)) // 2
                size = constant_q(rate, deviation, per_octave)[0]
                part = batch.column(7)[k].values.to_numpy(zero_copy_only=False)
                # The chunk's frames begin ``reach`` before their centres; the kernel's begin half its size before.
                shift = size // 2 - reach
                x = np.zeros((n - 1) * step + size)
                at = left + shift
                a, b = max(0, at), min(len(x), at + len(part))
                x[a:b] = part[a - at : b - at]
                frames = np.lib.stride_tricks.sliding_window_view(x, size)[::step][1 if chunk else 0 : n]
                found = np.concatenate([classes(frames[j : j + 16], rate, deviation, per_octave) for j in range(0, len(frames), 16)]) if len(frames) else np.zeros((0, 12))
                middle = frames[:, size // 2 - SIZE // 2 : size // 2 + SIZE // 2]
                i = np.arange(first + (1 if chunk else 0), first + n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), batch.column(0).type), pa.array(i), pa.array(i * step / rate), pa.array(list(found), pa.list_(pa.float64())), pa.array(np.sqrt((middle**2).mean(1)))], [key, "i", "t", "chroma", "rms"])

    columns = parts.select(key, *[F.col(c).cast("int") for c in ("rate", "chunk", "first", "n", "left")], F.col("tuning"), F.col("part").cast("array<double>"))
    return columns.mapInArrow(run, f"`{key}` {kind}, i long, t double, chroma array<double>, rms double")


def harmony(signals: DataFrame, key: str = "song_id", per_octave: int = PER_OCTAVE) -> DataFrame:
    """(key, i, t, chroma, rms, harmonic_confidence): the harmony of each frame of accompaniment (key, samples, rate), smoothed and scaled to a peak of one."""
    rings = ringing_part(signals, key)
    frames = chroma_frames(rings, tuning(rings, key), key, per_octave=per_octave)
    own = chroma_frames_level(signals, key)
    return series.harmonic_frames(frames.drop("rms").join(own, [key, "i"]), [key], ["i"])


def chroma_frames_level(signals: DataFrame, key: str = "song_id", n_frames: int = 2048) -> DataFrame:
    """(key, i, rms): the level of the whole accompaniment at the frames of its harmony."""
    kind = dict(signals.dtypes)[key]
    parts = chunks(signals, key, n_frames, SIZE / 22050, HOP / 22050)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, rate, chunk, first, n, left = (batch.column(c)[k].as_py() for c in range(6))
                step, size = max(1, round(rate * HOP / 22050)), max(8, round(rate * SIZE / 22050))
                part = batch.column(6)[k].values.to_numpy(zero_copy_only=False)
                x = np.zeros((n - 1) * step + size)
                x[left : left + len(part)] = part
                frames = np.lib.stride_tricks.sliding_window_view(x, size)[::step][1 if chunk else 0 :]
                i = np.arange(first + (1 if chunk else 0), first + n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), batch.column(0).type), pa.array(i), pa.array(np.sqrt((frames**2).mean(1)))], [key, "i", "rms"])

    columns = parts.select(key, *[F.col(c).cast("int") for c in ("rate", "chunk", "first", "n", "left")], F.col("part").cast("array<double>"))
    return columns.mapInArrow(run, f"`{key}` {kind}, i long, rms double")
