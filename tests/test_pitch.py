"""Pitch by frame: the difference function, the candidates and the path against plain loops, and glides whose pitch is known."""

import itertools
import math

import numpy as np
import pytest

from tessitura.operators import pitch


def test_thresholds():
    """The weights are those of the beta distribution: integrated numerically."""
    a, b = pitch.BETA
    x = np.linspace(0, 1, 200_001)
    density = x ** (a - 1) * (1 - x) ** (b - 1)
    cdf = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    cdf /= cdf[-1]
    assert np.allclose(pitch.threshold_weights(), np.diff(cdf[:: 200_000 // pitch.N_THRESHOLDS]), atol=1e-8) and math.isclose(pitch.threshold_weights().sum(), 1)


def test_difference_by_plain_loops():
    r = np.random.default_rng(0)
    frames = np.stack([r.normal(size=64), np.sin(np.arange(64) / 2), np.zeros(64), np.ones(64)])
    got = pitch.normalised_difference(frames, 3, 25)
    for x, row in zip(frames, got, strict=True):
        d = [sum((x[j] - x[j + lag]) ** 2 for j in range(32)) for lag in range(26)]
        for lag in range(3, 26):
            mean = sum(d[1 : lag + 1]) / lag
            assert math.isclose(row[lag - 3], d[lag] / mean if mean else 0, rel_tol=1e-6, abs_tol=1e-9)


def test_candidates_by_plain_loops():
    d = np.abs(np.random.default_rng(3).normal(size=(30, 40))) * np.linspace(0.02, 1, 30)[:, None]
    d[5] = 2.0  # flat: no trough
    got: dict = {}
    for f, hertz, p in zip(*pitch.candidates(d, 10, 1000), strict=True):
        got.setdefault(int(f), []).append((hertz, p))
    weights = pitch.threshold_weights()
    for f, row in enumerate(d):
        lows = [k for k in range(39) if (k == 0 and row[0] < row[1]) or (0 < k and row[k] < row[k - 1] and row[k] <= row[k + 1])]
        probability = dict.fromkeys(lows, 0.0)
        for i, w in enumerate(weights):
            below = [k for k in lows if row[k] < (i + 1) / 100]
            for rank, k in enumerate(below):
                probability[k] += w * math.exp(-2.0 * rank) * (1 - math.exp(-2.0)) / (1 - math.exp(-2.0 * len(below)))
            if not below and lows:
                probability[min(lows, key=lambda k: row[k])] += 0.01 * w
        want = []
        for k, p in probability.items():
            shift = 0.0
            if 0 < k < 39:
                slope, bend = (row[k + 1] - row[k - 1]) / 2, row[k - 1] + row[k + 1] - 2 * row[k]
                shift = -slope / bend if abs(bend) > abs(slope) else 0.0
            if p > 0:
                want.append((1000 / (10 + k + shift), p))
        assert np.allclose(sorted(got.get(f, [])), sorted(want)), f


@pytest.mark.parametrize("seed", range(6))
def test_path_against_all_paths(seed):
    """Of all paths through four states in two forms none is better."""
    r = np.random.default_rng(seed)
    n, steps, reach = 4, 5, 1 + seed % 2
    bins = [np.sort(r.choice(n, r.integers(0, 3), replace=False)) for _ in range(steps)]
    probs = [r.random(len(b)) / 2 for b in bins]
    tiny, move = np.finfo(float).tiny, pitch.moves(n, reach)

    def emit(t, v, j):
        if v == 1:
            return math.log(max((1 - min(1.0, probs[t].sum())) / n, tiny))
        return math.log(max(dict(zip(bins[t].tolist(), probs[t], strict=True)).get(j, 0), tiny))

    def value(path):
        total = (-math.log(n) if path[0][0] else math.log(tiny)) + emit(0, *path[0])
        for t, ((v, j), (w, k)) in enumerate(zip(path, path[1:], strict=False), 1):
            if abs(k - j) > reach:
                return -math.inf
            total += move[j, k - j + reach] + math.log(0.99 if v == w else 0.01) + emit(t, w, k)
        return total

    states, voiced = pitch.voiced_path(bins, probs, n, reach)
    own = value([(0 if x else 1, int(j)) for x, j in zip(voiced, states, strict=True)])
    assert math.isclose(own, max(value(p) for p in itertools.product(itertools.product((0, 1), range(n)), repeat=steps)), rel_tol=1e-12)
    assert pitch.voiced_path([], [], n, reach)[0].tolist() == []


def _glide(rate, seconds, low, high, overtones=True):
    """A voice with overtones that glides in midi from low to high."""
    t = np.arange(round(rate * seconds)) / rate
    midi = low + (high - low) * t / seconds
    phase = 2 * np.pi * np.cumsum(440 * 2 ** ((midi - 69) / 12)) / rate
    return sum(np.sin(k * phase) / k for k in ((1, 2, 3, 4) if overtones else (1,))), midi


def test_glides_within_twenty_cents(spark):
    rate, r = pitch.RATE, np.random.default_rng(1)
    songs, truth = [], {}
    for name, low, high in (("a", 45, 52), ("b", 60, 64), ("c", 72, 69), ("d", 84, 86)):
        y, midi = _glide(rate, 2.0, low, high)
        quiet = np.zeros(rate // 2)
        whole = np.concatenate([quiet, y, quiet]) + r.normal(size=3 * rate) * 0.003
        songs.append((name, whole.tolist(), rate))
        truth[name] = np.concatenate([np.full(rate // 2, np.nan), midi, np.full(rate // 2, np.nan)])
    songs.append(("noise", (r.normal(size=rate) * 0.1).tolist(), rate))
    df = spark.createDataFrame(songs, "song_id string, samples array<double>, rate int")
    got = pitch.sung_pitch(df).toPandas().sort_values(["song_id", "i"])
    for name, want in truth.items():
        rows = got[got["song_id"] == name]
        at = np.minimum(np.rint(rows["t"].to_numpy() * rate).astype(int), len(want) - 1)
        inside = (rows["t"] > 0.6) & (rows["t"] < 2.4)
        assert rows["voiced"][inside].mean() > 0.98
        error = np.abs(rows["midi"][inside].to_numpy() - want[at][inside])
        assert np.nanmax(error) < 0.2, (name, np.nanmax(error))
        outside = (rows["t"] < 0.4) | (rows["t"] > 2.6)
        assert rows["voiced"][outside].mean() < 0.1
    assert got[got["song_id"] == "noise"]["voiced"].mean() < 0.3
    assert ((got["prob"] >= 0) & (got["prob"] <= 1)).all() and got["midi"].isna().equals(~got["voiced"])


@pytest.mark.parametrize("n_frames", [1, 13, 4096])
def test_chunks_are_the_whole(spark, n_frames):
    y, _ = _glide(8000, 0.7, 57, 60)
    df = spark.createDataFrame([("a", y.tolist(), 8000), ("b", y[:100].tolist(), 8000)], "song_id string, samples array<double>, rate int")
    found = pitch.pitch_candidates(df, n_frames=n_frames).toPandas().sort_values(["song_id", "i"]).reset_index(drop=True)
    whole = pitch.pitch_candidates(df, n_frames=100_000).toPandas().sort_values(["song_id", "i"]).reset_index(drop=True)
    assert found["i"].tolist() == whole["i"].tolist() and np.allclose(found["rms"], whole["rms"])
    for a, b, p, q in zip(found["bins"], whole["bins"], found["probs"], whole["probs"], strict=True):
        assert list(a) == list(b) and np.allclose(p, q)


def test_frames_that_hold_no_period(spark):
    df = spark.createDataFrame([("a", [0.0] * 100, 100)], "song_id string, samples array<double>, rate int")
    with pytest.raises(Exception, match="no period"):
        pitch.sung_pitch(df).collect()


def test_songs_together_are_as_songs_alone():
    """Songs of other lengths do not change a path, nor do the places where scores are kept."""
    r = np.random.default_rng(5)
    songs = []
    for length in (1, 40, 3, 300, 40):
        bins = [np.sort(r.choice(61, r.integers(0, 5), replace=False)) for _ in range(length)]
        songs.append((bins, [r.dirichlet(np.ones(len(b) + 1))[: len(b)] for b in bins]))
    together = pitch.voiced_paths(songs, 61, 4)
    for (states, voiced), song in zip(together, songs, strict=True):
        alone = pitch.voiced_path(*song, 61, 4)
        assert (states == alone[0]).all() and (voiced == alone[1]).all() and len(states) == len(song[0])


def test_tones_are_made_in_many_tasks(spark):
    """A small file of parts is one task; what each of them becomes is not."""
    from tessitura.functions.shared import spread
    from tessitura.plans import version_queries

    tones = version_queries.tones(spark, "/root/testdata/sf0.001")
    assert tones.rdd.getNumPartitions() == spread(spark) > 1


def test_a_tone_is_heard_once(spark, tmp_path):
    """parts of one height are one tone; all parts are told what was heard, and a key that stands twice has one row with the frames of both."""
    from tessitura.plans import version_queries

    prices = [900.0, 900.1, 903.6, 900.1, None, 2.5e9, -3.75, 901.7]
    rows = [(k, 900.0 + k % 40 / 10) for k in range(3000)] + [(5000 + k, p) for k, p in enumerate(prices) if p is not None] + [(7, 900.0)]
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    heights = {math.floor(p * 100) % 360 for _, p in rows}
    tones = version_queries.tones(spark, str(tmp_path)).select("true").collect()
    assert sorted(round(x["true"] * 10) - 450 for x in tones) == sorted(heights)
    got = version_queries.tone_pitch(spark, str(tmp_path)).collect()
    assert sorted(x["p_partkey"] for x in got) == sorted({k for k, _ in rows})
    assert all(tuple(x)[1:] == (32 if x["p_partkey"] == 7 else 16, True, True) for x in got)
