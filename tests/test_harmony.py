"""Harmony from sound: the separation by chunks, the tuning of known tones, and chords whose pitch classes are known."""

import numpy as np
import pytest

from tessitura.operators import harmony

RATE = 22050


def _tones(midis, seconds, level=0.2):
    t = np.arange(round(RATE * seconds)) / RATE
    return sum(level * np.sin(2 * np.pi * 440 * 2 ** ((m - 69) / 12) * t) for m in midis)


def _clicks(seconds, every=0.25):
    x = np.zeros(round(RATE * seconds))
    x[:: round(RATE * every)] = 1.0
    return x


def _signals(spark, **songs):
    return spark.createDataFrame([(k, np.asarray(x, float).tolist(), RATE) for k, x in songs.items()], "song_id string, samples array<double>, rate int")


def test_what_rings_and_what_is_struck():
    tone, clicks = _tones([60, 67], 2.0), _clicks(2.0)
    n = len(tone)
    got = harmony.ringing(tone + clicks, 0, n, n, 0)
    inner = slice(n // 5, -n // 5)
    assert np.corrcoef(got[inner], tone[inner])[0, 1] > 0.98
    assert np.abs(harmony.ringing(clicks, 0, n, n, 0)).max() < 0.2 and not harmony.ringing(np.zeros(n), 0, n, n, 0).any()


@pytest.mark.parametrize("blocks", [3, 17, 10_000])
def test_separation_by_chunks(spark, blocks):
    r = np.random.default_rng(1)
    songs = {"a": _tones([60], 1.5) + r.normal(size=round(1.5 * RATE)) * 0.1, "b": r.normal(size=700), "c": r.normal(size=5 * harmony.STEP)}
    got = {x["song_id"]: np.array(x["samples"]) for x in harmony.ringing_part(_signals(spark, **songs), blocks=blocks).collect()}
    for k, x in songs.items():
        assert len(got[k]) == len(x) and np.allclose(got[k], harmony.ringing(x, 0, len(x), len(x), 0), atol=1e-9)


def test_medians_by_plain_loops():
    x = np.random.default_rng(0).random((40, 50))
    for axis in (0, 1):
        got = harmony._median(x, axis)
        for i, j in ((0, 0), (3, 48), (39, 20), (20, 2)):
            line, at = (x[:, j], i) if axis == 0 else (x[i], j)
            n = len(line)
            near = [line[k] if 0 <= k < n else line[-k - 1] if k < 0 else line[2 * n - 1 - k] for k in range(at - 15, at + 16)]
            assert got[i, j] == sorted(near)[15]


def test_tuning_of_known_tones(spark):
    songs = {f"{d:+.2f}": _tones([57 + d, 64 + d, 69 + d], 1.0) for d in (-0.3, 0.0, 0.12, 0.4)}
    got = {x["song_id"]: x["tuning"] for x in harmony.tuning(_signals(spark, **songs, quiet=np.zeros(RATE))).collect()}
    for k in songs:
        assert abs(got[k] - float(k)) <= 0.03, (k, got[k])
    assert got["quiet"] == 0.0


def test_filters_by_their_definition():
    """The sparse kernel gives the inner product of a frame with each filter."""
    size, bins, weights, starts = harmony.constant_q(RATE, 0.2, 12)
    x = np.random.default_rng(2).normal(size=size)
    got = np.add.reduceat(np.fft.rfft(x)[bins] * weights, starts)
    quality = 1 / (2 ** (1 / 12) - 1)
    for k in (0, 20, 50, 83):
        f = harmony.LOWEST * 2 ** (0.2 / 12) * 2 ** (k / 12)
        n = int(np.ceil(quality * RATE / f))
        shape = np.hanning(n + 1)[:-1]
        shape = shape / shape.sum() * np.sqrt(n)
        own = x[size // 2 - n // 2 : size // 2 - n // 2 + n] @ (shape * np.exp(-2j * np.pi * f * (np.arange(n) - n // 2) / RATE))
        assert abs(got[k] - own) < 0.05 * np.sqrt(n) * np.linalg.norm(shape) / 4


def test_chords(spark):
    """The classes of a chord are the loudest, also off the usual tuning and under clicks; silence has no confidence."""
    chords = {"major": ([60, 64, 67], 0.0), "minor": ([57, 60, 64], 0.3), "low": ([41, 48, 57], -0.2)}
    songs = {k: np.concatenate([_tones([m + d for m in midis], 1.2) + 0.3 * _clicks(1.2), np.zeros(RATE // 2)]) for k, (midis, d) in chords.items()}
    rows = harmony.harmony(_signals(spark, **songs), per_octave=36).toPandas().sort_values(["song_id", "i"])
    for k, (midis, _) in chords.items():
        own = rows[(rows["song_id"] == k) & (rows["t"] > 0.3) & (rows["t"] < 0.9)]
        mean = np.stack(own["chroma"]).mean(0)
        assert set(np.argsort(-mean)[:3]) == {m % 12 for m in midis}, (k, mean)
        assert own["harmonic_confidence"].mean() > 0.2
        late = rows[(rows["song_id"] == k) & (rows["t"] > 1.6)]
        assert late["harmonic_confidence"].max() < 0.05
    assert len(rows[rows["song_id"] == "low"]) == -(-len(songs["low"]) // harmony.HOP)


@pytest.mark.parametrize("n_frames", [5, 40])
def test_chroma_by_chunks(spark, n_frames):
    df = _signals(spark, a=_tones([50, 55.2], 0.4), b=_tones([60], 0.1))
    tunings = spark.createDataFrame([("a", 0.1), ("b", 0.0)], "song_id string, tuning double")
    take = lambda n: harmony.chroma_frames(df, tunings, n_frames=n, per_octave=12).toPandas().sort_values(["song_id", "i"])
    a, b = take(n_frames), take(100_000)
    assert a["i"].tolist() == b["i"].tolist() and np.allclose(np.stack(a["chroma"]), np.stack(b["chroma"])) and np.allclose(a["rms"], b["rms"])
