import numpy as np
import pytest

from tessitura.operators import resampling


def _signals(spark, rows):
    return spark.createDataFrame([(k, np.asarray(x, float).tolist(), rate) for k, x, rate in rows], "song_id string, samples array<double>, rate int")


def _plain(x, rate, to):
    """Every output sample as the sum over all input samples of the windowed sinc, in plain form."""
    n = -(-len(x) * to // rate)
    cut, out = resampling.ROLL_OFF * min(1.0, to / rate), []
    for m in range(n):
        at = np.arange(-3 * len(x) - 200, 4 * len(x) + 200) - m * rate / to
        near = np.abs(at * cut) <= resampling.CROSSINGS
        w = np.zeros(len(at))
        w[near] = np.i0(resampling.BETA * np.sqrt(np.clip(1 - (at[near] * cut / resampling.CROSSINGS) ** 2, 0, 1))) * np.sinc(cut * at[near])
        inside = slice(3 * len(x) + 200, 4 * len(x) + 200)
        out.append(w[inside] @ x / w.sum())
    return np.array(out)


@pytest.mark.parametrize(("rate", "to"), [(441, 160), (160, 441), (100, 50), (50, 100), (7, 7), (300, 299)])
def test_against_the_plain_sum(rate, to):
    x = np.random.default_rng(1).normal(size=173)
    n = -(-len(x) * to // rate)
    got = x if rate == to else resampling.resample_part(x, 0, 0, n, rate, to)
    assert np.allclose(got, x if rate == to else _plain(x, rate, to), atol=1e-9)


@pytest.mark.parametrize(("rate", "to"), [(44100, 16000), (22050, 16000), (16000, 22050), (48000, 22050), (16000, 44100)])
def test_sines_within_a_tenth_of_a_decibel(rate, to):
    """What both rates hold keeps its level and place; what the lower one cannot hold is gone by 80 dB."""
    t, n = np.arange(rate) / rate, to
    for hertz in (50, 440, 3000, 0.42 * min(rate, to)):
        got = resampling.resample_part(np.sin(2 * np.pi * hertz * t), 0, 0, n, rate, to)[to // 4 : 3 * to // 4]
        want = np.sin(2 * np.pi * hertz * np.arange(n) / to)[to // 4 : 3 * to // 4]
        assert abs(20 * np.log10(np.sqrt((got**2).mean() / (want**2).mean()))) < 0.1
        assert np.abs(got - want).max() < 0.012
    if to < rate:
        gone = resampling.resample_part(np.sin(2 * np.pi * 0.56 * to * t), 0, 0, n, rate, to)[to // 4 : 3 * to // 4]
        assert 20 * np.log10(np.sqrt((gone**2).mean() * 2)) < -80


def test_chunks_are_the_whole(spark):
    r = np.random.default_rng(0)
    rows = [("a", r.normal(size=5000), 441), ("b", r.normal(size=37), 441), ("c", [], 441), ("d", r.normal(size=900), 160), ("e", r.normal(size=2000), 8000)]
    whole = {k: np.asarray(x) if rate == 160 or not len(x) else resampling.resample_part(np.asarray(x), 0, 0, -(-len(x) * 160 // rate), rate, 160) for k, x, rate in rows}
    for seconds in (0.05, 1.0, 100.0):
        got = {s["song_id"]: s for s in resampling.resample(_signals(spark, rows), 160, seconds=seconds).collect()}
        assert sorted(got) == ["a", "b", "d", "e"] and {s["rate"] for s in got.values()} == {160}  # an empty signal has no chunks
        for k, s in got.items():
            assert np.allclose(s["samples"], whole[k], atol=1e-6)
    chunks = resampling.resampled_chunks(_signals(spark, rows), 160, seconds=0.5).where("song_id = 'a'").orderBy("chunk").collect()
    assert [c["first"] for c in chunks] == [80 * k for k in range(len(chunks))] and all(len(c["samples"]) == 80 for c in chunks[:-1])


def test_bad_rates():
    with pytest.raises(ValueError, match="positive"):
        resampling.ratio(0, 10)
