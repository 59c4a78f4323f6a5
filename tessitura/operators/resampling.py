"""Band-limited resampling of signals: a windowed sinc in polyphase form, over chunks that overlap."""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the sinc to each side, and the share of the lower band that passes.
CROSSINGS, ROLL_OFF = 24, 0.945
#: Shape of the Kaiser window: side lobes under -90 dB.
BETA = 9.0


def ratio(rate: int, to: int) -> tuple[int, int]:
    """Up and down without common factor."""
    if rate <= 0 or to <= 0:
        raise ValueError("rates are positive")
    return to // gcd(rate, to), rate // gcd(rate, to)


def half_width(rate: int, to: int) -> int:
    """Samples of the input that an output sample reaches to each side."""
    return int(np.ceil(CROSSINGS / (ROLL_OFF * min(1.0, to / rate)))) + 1


def phases(rate: int, to: int) -> np.ndarray:
    """The kernel, one row for each place that an output sample can have between two input samples; rows sum to 1."""
    up, _ = ratio(rate, to)
    cut, reach = ROLL_OFF * min(1.0, to / rate), half_width(rate, to)
    at = np.arange(-reach, reach + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.where(np.abs(at) * cut <= CROSSINGS, np.i0(BETA * np.sqrt(np.clip(1 - (at * cut / CROSSINGS) ** 2, 0, 1))) / np.i0(BETA), 0.0)
    kernel = cut * np.sinc(cut * at) * window
    return kernel / kernel.sum(1, keepdims=True)


def resample_part(part: np.ndarray, offset: int, first: int, n: int, rate: int, to: int) -> np.ndarray:
    """Output samples first to first + n - 1 of a signal of which ``part`` stands at ``offset``; what is beyond it counts as zero."""
    up, down = ratio(rate, to)
    reach, kernel = half_width(rate, to), phases(rate, to)
    place = np.arange(first, first + n, dtype=np.int64) * down
    base, phase = place // up - reach - offset, place % up
    low, high = min(0, int(base[0])), max(len(part), int(base[-1]) + 2 * reach + 1)
    x = np.zeros(high - low)
    x[-low : len(part) - low] = part
    windows = np.lib.stride_tricks.sliding_window_view(x, 2 * reach + 1)
    return np.concatenate([np.einsum("ij,ij->i", windows[base[k : k + 8192] - low], kernel[phase[k : k + 8192]]) for k in range(0, n, 8192)])


def resampled_chunks(signals: DataFrame, to: int, key: str = "song_id", seconds: float = 20.0) -> DataFrame:
    """(key, chunk, first, samples): each signal (key, samples, rate) at ``to`` samples a second, in chunks of ``seconds``.

    A signal of n samples becomes ceil(n * to / rate). A chunk is made from its own samples and a halo of half the
    kernel, so chunks can be made anywhere and joined give what the whole signal gives. Samples are doubles if those of
    the signals are, else floats; an empty signal has no chunks."""
    wide = dict(signals.dtypes)["samples"] == "array<double>"
    size = max(1, round(seconds * to))
    x, rate = F.col("samples"), F.col("rate").cast("long")
    total = F.ceil(F.size(x) * F.lit(to) / rate).cast("long")
    # Upper bound of the kernel's reach at this rate, as in half_width.
    reach = (F.ceil(F.lit(CROSSINGS) / (F.lit(ROLL_OFF) * F.least(F.lit(1.0), F.lit(to) / rate))) + 1).cast("long")

    def chunk(c):
        first = c * size
        n = F.least(F.lit(size), total - first)
        low = F.greatest(F.floor(first * rate / to) - reach - 1, F.lit(0).cast("long"))
        high = F.least(F.floor((first + n - 1) * rate / to) + reach + 2, F.size(x).cast("long"))
        return F.struct(c.alias("chunk"), first.alias("first"), n.alias("n"), low.alias("low"), F.slice(x, (low + 1).cast("int"), (high - low).cast("int")).alias("part"))

    count = F.ceil(total / size).cast("long")
    each = F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), chunk))
    parts = signals.select(key, "rate", F.explode(each).alias("c")).select(key, rate.alias("rate"), "c.*")
    kind = dict(signals.dtypes)[key]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rate_, number, first, n, low = (batch.column(c)[k].as_py() for c in range(1, 6))
                part = batch.column(6)[k].values.to_numpy(zero_copy_only=False).astype(float)
                out = part if rate_ == to else resample_part(part, low, first, n, rate_, to)
                own = out[first - low : first - low + n] if rate_ == to else out
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([number]), pa.array([first]), pa.array([own.astype(np.float64 if wide else np.float32)], pa.list_(pa.float64() if wide else pa.float32()))], [key, "chunk", "first", "samples"])

    return parts.select(key, "rate", "chunk", "first", "n", "low", F.col("part").cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, chunk long, first long, samples array<{'double' if wide else 'float'}>")


def resample(signals: DataFrame, to: int, key: str = "song_id", seconds: float = 20.0) -> DataFrame:
    """(key, samples, rate): whole signals at ``to`` samples a second; chunks of a signal are put together again."""
    parts = resampled_chunks(signals, to, key, seconds).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "samples"))).alias("c"))
    return parts.select(key, F.flatten(F.transform("c", lambda c: c["samples"])).alias("samples"), F.lit(to).alias("rate"))
