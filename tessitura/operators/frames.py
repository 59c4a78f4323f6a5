"""Evidence in a signal by frame, computed over chunks that overlap, so that no task holds more than a chunk of a song."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, HOP, BANDS, LOWEST, HIGHEST = 0.040, 0.010, 16, 65.0, 1100.0
#: The scale of flux is at least this.
LEAST_SCALE = 0.05
_TINY = 1e-12


def chunks(signals: DataFrame, key: str = "song_id", n_frames: int = 1500, window: float = WINDOW, hop: float = HOP) -> DataFrame:
    """(key, rate, first, n, left, part): runs of frames of each signal with the samples that they reach.

    Frame i is centred at sample i * step and reaches half a window to both sides. A chunk that is not the first has
    one frame more, before its own, whose spectrum its first change needs. ``left`` zeros stand before the part where a
    window begins before the signal; past its end the reader adds zeros. Signals that are empty, not finite or without
    a positive rate make the plan fail."""
    x, rate = F.col("samples"), F.col("rate")
    bad = (F.size(x) == 0) | (rate <= 0) | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a signal of finite samples and a positive rate are needed")).cast("int")).otherwise(rate)
    step = F.greatest(F.lit(1), F.rint(rate * F.lit(hop)).cast("int"))
    size = F.greatest(F.lit(8), F.rint(rate * F.lit(window)).cast("int"))
    total = F.ceil(F.size(x) / step).cast("int")

    def chunk(c):
        first = F.greatest(c * n_frames - 1, F.lit(0))
        n = F.least(total, (c + 1) * n_frames) - first
        begin = first * step - F.floor(size / 2).cast("int")
        end = F.least(F.size(x), (first + n - 1) * step - F.floor(size / 2).cast("int") + size)
        low = F.greatest(begin, F.lit(0))
        return F.struct(c.alias("chunk"), first.alias("first"), n.alias("n"), (low - begin).alias("left"), F.slice(x, low + 1, F.greatest(end - low, F.lit(0))).alias("part"))

    each = F.transform(F.sequence(F.lit(0), F.ceil(total / n_frames).cast("int") - 1), chunk)
    return signals.withColumn("rate", sound).select(key, "rate", F.explode(each).alias("c")).select(key, "rate", "c.*")


def chunk_frames(part: np.ndarray, rate: int, n: int, left: int, window: float = WINDOW, hop: float = HOP, bands: int = BANDS) -> dict[str, np.ndarray]:
    """rms, per, change and timbre of the ``n`` frames of one chunk; change[0] is 0, the others the distance to the spectrum before."""
    step, size = max(1, round(rate * hop)), max(8, round(rate * window))
    lags = range(max(1, int(rate / HIGHEST)), min(size - 2, int(rate / LOWEST)) + 1)
    if len(lags) < 2:
        raise ValueError("the window holds no period of the range")
    x = np.zeros((n - 1) * step + size)
    x[left : left + len(part)] = part
    frames = np.lib.stride_tricks.as_strided(x, (n, size), (step * x.strides[0], x.strides[0]), writeable=False)
    centred = frames - frames.mean(1)[:, None]
    magnitude = np.abs(np.fft.rfft(centred * np.hanning(size), axis=1))
    spectrum = magnitude / (np.linalg.norm(magnitude, axis=1)[:, None] + _TINY)
    member = np.zeros((spectrum.shape[1], bands))
    for band, bins in enumerate(np.array_split(np.arange(spectrum.shape[1]), bands)):
        member[bins, band] = 1
    energy = np.sqrt(spectrum**2 @ member)
    change = np.zeros(n)
    change[1:] = np.linalg.norm(spectrum[1:] - spectrum[:-1], axis=1)
    periodic, so_far = np.zeros(n), (centred**2).cumsum(1)
    for lag in lags:
        product = np.einsum("ij,ij->i", centred[:, :-lag], centred[:, lag:])
        both = so_far[:, size - lag - 1] * (so_far[:, -1] - so_far[:, lag - 1])
        np.maximum(periodic, product / (np.sqrt(np.maximum(both, 0)) + _TINY), out=periodic)
    return {"rms": np.sqrt((frames**2).mean(1)), "per": np.minimum(periodic, 1), "change": change, "timbre": energy / (np.linalg.norm(energy, axis=1)[:, None] + _TINY)}


def frame_evidence(signals: DataFrame, key: str = "song_id", n_frames: int = 1500, window: float = WINDOW, hop: float = HOP, spread: bool = False) -> DataFrame:
    """(key, i, t, rms, per, flux, timbre): frames every ``hop`` seconds of each signal (key, samples, rate).

    rms is the level, per the best lagged product over the energies of both its parts (65 to 1100 Hz), timbre the
    normed energies of 16 equal parts of the spectrum, flux the change of the normed spectrum, over the 90th
    percentile that it has in the song. With ``spread`` the chunks of a song are dealt to several tasks."""
    parts = chunks(signals, key, n_frames, window, hop)
    if spread:
        parts = parts.repartition(key, "chunk")
    kind = dict(signals.dtypes)[key]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, rate, chunk, first, n, left = (batch.column(c)[k].as_py() for c in range(6))
                part = batch.column(6)[k].values.to_numpy(zero_copy_only=False).astype(float)
                got = chunk_frames(part, rate, n, left, window, hop)
                own = slice(1 if chunk else 0, n)
                i = np.arange(first, first + n)[own]
                step = max(1, round(rate * hop))
                arrays = [pa.array([name] * len(i), batch.column(0).type), pa.array(i), pa.array(i * step / rate), *[pa.array(got[c][own]) for c in ("rms", "per", "change")], pa.array(list(got["timbre"][own]), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, [key, "i", "t", "rms", "per", "change", "timbre"])

    columns = parts.select(key, F.col("rate").cast("int"), F.col("chunk").cast("int"), F.col("first").cast("int"), F.col("n").cast("int"), F.col("left").cast("int"), F.col("part").cast("array<double>"))
    found = columns.mapInArrow(run, f"`{key}` {kind}, i long, t double, rms double, per double, change double, timbre array<double>")
    scale = F.greatest(F.percentile("change", F.lit(0.9)).over(W.partitionBy(key)), F.lit(LEAST_SCALE))
    return found.select(key, "i", "t", "rms", "per", F.least(F.col("change") / scale, F.lit(1.0)).alias("flux"), "timbre")
