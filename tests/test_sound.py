import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import frames, intervals, placement, sound, syllables
from tessitura.plans import catalog, word_queries  # noqa: F401


def _plain_frames(y, rate):
    """The definition of frame evidence, in plain loops."""
    hop, size = max(1, round(rate * 0.010)), max(8, round(rate * 0.040))
    padded = np.concatenate([np.zeros(size // 2), y, np.zeros(size)])
    out, before = {"rms": [], "per": [], "flux": [], "timbre": []}, None
    for c in range(0, len(y), hop):
        x = padded[c : c + size]
        out["rms"].append(np.sqrt(sum(v * v for v in x) / size))
        x = x - x.mean()
        spectrum = np.abs(np.fft.rfft(x * np.hanning(size)))
        spectrum = spectrum / (np.linalg.norm(spectrum) + 1e-12)
        bands = np.array([np.linalg.norm(p) for p in np.array_split(spectrum, 16)])
        out["timbre"].append(bands / (np.linalg.norm(bands) + 1e-12))
        out["flux"].append(0.0 if before is None else np.linalg.norm(spectrum - before))
        before = spectrum
        best = 0.0
        for lag in range(max(1, int(rate / 1100)), min(size - 2, int(rate / 65)) + 1):
            a, b = x[:-lag], x[lag:]
            best = max(best, float(a @ b) / (np.sqrt(float(a @ a) * float(b @ b)) + 1e-12))
        out["per"].append(min(1.0, best))
    flux = np.array(out["flux"])
    out["flux"] = np.clip(flux / max(np.percentile(flux, 90), 0.05), 0, 1)
    return out


@pytest.mark.parametrize(("n_frames", "spread"), [(1, False), (7, True), (2048, False)])
def test_frame_evidence_against_plain_loops(spark, n_frames, spread):
    """Chunks of any size give what whole signals give, of several songs and rates."""
    r = np.random.default_rng(0)
    signals = {"a": (np.concatenate([np.sin(2 * np.pi * 220 * np.arange(1500) / 8000), r.normal(size=900) * 0.1, np.zeros(500)]), 8000), "b": (r.normal(size=777), 4000), "c": (np.zeros(3), 4000), "d": (np.ones(40), 4000)}
    df = spark.createDataFrame([(k, y.tolist(), rate) for k, (y, rate) in signals.items()], "song_id string, samples array<double>, rate int")
    found = frames.frame_evidence(df, n_frames=n_frames, spread=spread).toPandas().sort_values(["song_id", "i"])
    for song, (y, rate) in signals.items():
        got, want = found[found["song_id"] == song], _plain_frames(y, rate)
        assert got["i"].tolist() == list(range(len(want["rms"]))) and got["flux"].iloc[0] == 0
        assert np.allclose(got["t"], np.arange(len(got)) * round(rate * 0.01) / rate)
        for k in ("rms", "per", "flux"):
            assert np.allclose(got[k], want[k], atol=1e-7), (song, k)
        assert np.allclose(np.stack(got["timbre"]), np.array(want["timbre"]), atol=1e-7)


@pytest.mark.parametrize(("samples", "rate"), [([], 8000), ([float("nan")], 8000), ([1.0, None], 8000), (None, 8000), ([1.0], 0)])
def test_signals_that_are_none(spark, samples, rate):
    df = spark.createDataFrame([("a", samples, rate)], "song_id string, samples array<double>, rate int")
    with pytest.raises(Exception, match="finite samples"):
        frames.frame_evidence(df).collect()


def test_query_frames(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    got = catalog.QUERIES["embedding_frames"](spark, "/root/testdata/sf0.001").toPandas().sort_values(["vec_id", "i"])
    assert set(got["vec_id"]) == set(vectors)
    for k, rows in got.groupby("vec_id"):
        want = _plain_frames(np.array(vectors[k]), 2000)
        for c in ("rms", "per", "flux"):
            assert np.allclose(rows[c], want[c], atol=1e-6), (k, c)


def test_windows(spark):
    signal = np.ones(65 * 100)
    signal[18 * 100 : 19 * 100] = 0
    df = spark.createDataFrame([("s", signal.tolist(), 100), ("e", [], 100)], "song_id string, samples array<double>, rate int")
    found = [(r["start"], r["end"]) for r in sound.listening_windows(df).orderBy("no").collect()]
    assert found[0][0] == 0 and found[-1][1] == 65 and 18 <= found[0][1] <= 19
    assert all(a[1] == b[0] for a, b in zip(found, found[1:])) and all(b - a <= 20 for a, b in found)
    parts = sound.child_windows(spark.createDataFrame([("s", 0.0, 40.0)], "song_id string, start double, end double"), df).orderBy("start").collect()
    assert parts[0]["start"] == 0 and parts[0]["end"] == parts[1]["start"] and 16 <= parts[0]["end"] <= 24 and parts[1]["end"] == 40
    with pytest.raises(ValueError):
        sound.quiet_cuts(signal, 100, 20, 12)


def _frames(spark, rows, song="s"):
    return spark.createDataFrame([(song, i / 100, rms, per, [1.0, 0.0] if kind else [0.0, 1.0]) for i, (rms, per, kind) in enumerate(rows)], "song_id string, t double, rms double, per double, timbre array<double>")


def test_sustained_words(spark):
    w = spark.createDataFrame(
        [("s", str(k), k, 1, "la", float(k), k + 0.3, "model", [("l",), ("a",)], []) for k in range(3)] + [("s", "3", 3, 2, "sol", 3.0, 3.3, "model", [("s",), ("o",), ("l",)], None)],
        "song_id string, word_id string, ord int, block int, text string, start double, end double, source string, chars array<struct<char:string>>, warnings array<string>",
    )
    rows = [(0.0, 0.0, True)] * 400
    for i in range(0, 60):
        rows[i] = (0.5, 0.9, True)  # the first word sounds on to 0.6
    for i in range(100, 130):
        rows[i] = (0.5, 0.9, True)
    for i in range(130, 190):
        rows[i] = (0.5, 0.9, False)  # another sound follows the second
    got = {r["word_id"]: r for r in sound.sustained_words(w, _frames(spark, rows)).collect()}
    assert abs(got["0"]["end"] - 0.595) < 1e-9 and got["0"]["original_end"] == 0.3 and "sustained_end" in got["0"]["warnings"]
    assert got["1"]["end"] == 1.3 and got["1"]["original_end"] is None and abs(got["1"]["voice_left"] - 0.6) < 1e-6 and list(got["1"]["warnings"]) == ["voice_left"]
    assert got["2"]["end"] == 2.3 and got["3"]["end"] == 3.3
    assert [got[str(k)]["end_reason"] for k in range(4)] == ["silence", "continuity", None, None]
    assert abs(got["0"]["interrupted_at"] - 0.595) < 1e-9 and abs(got["0"]["confirmed_at"] - 0.71) < 1e-9 and abs(got["1"]["interrupted_at"] - 1.3) < 1e-9


def _walk(frames, step=0.01):
    """Why a walk over (t, silent, fits) ends, by looking at one frame after the other."""
    quiet = failed = 0
    good = None
    for k, (t, silent, fits) in enumerate(frames):
        quiet = quiet + 1 if silent else 0
        if quiet * step >= 0.120 - 1e-9:
            return "silence", frames[k - quiet + 1][0], t
        if fits:
            good, failed = k, 0
        else:
            failed += 1
            if failed * step >= 0.250 - 1e-9:
                return "continuity", frames[k - failed + 1][0], t
    return "next_word" if good == len(frames) - 1 else "tail_not_confirmed", None, None


def test_reasons_against_walks(spark):
    r = np.random.default_rng(4)
    walks = {}
    for k in range(60):
        kinds, state = [], 0
        for _ in range(int(r.integers(1, 90))):
            state = int(r.integers(0, 3)) if r.random() < (0.03, 0.1, 0.3)[k % 3] else state
            kinds.append(state)
        walks[f"w{k}"] = [(round(1 + 0.01 * i, 2), s == 2, s == 0) for i, s in enumerate(kinds)]
    df = spark.createDataFrame([("s", w, t, 1.0, a, b) for w, fs in walks.items() for t, a, b in fs], "song_id string, word_id string, t double, a double, silent boolean, fits boolean")
    key = ["song_id", "word_id"]
    stops = intervals.confirmed_stop(df, key, "t", "silent", "fits", 0.01)
    got = {x["word_id"]: x for x in sound.stop_reasons(df, stops, key, 0.01).collect()}
    seen = set()
    for w, fs in walks.items():
        reason, begun, sure = _walk(fs)
        seen.add(reason)
        if w in got:
            assert (got[w]["reason"], got[w]["confirmed_at"]) == (reason, sure), w
            assert begun is None or abs(got[w]["interrupted_at"] - max(1.0, begun - 0.005)) < 1e-9
        else:
            assert sure == fs[0][0]  # the walk stopped at its first frame
    assert seen == {"silence", "continuity", "next_word", "tail_not_confirmed"}


def test_gaps_that_are_not_walked(spark):
    w = spark.createDataFrame(
        [("s", str(k), k, 1, t, float(k), k + 0.3, "model", [(c,) for c in t], []) for k, t in enumerate(["la", "sol", "la", "la"])],
        "song_id string, word_id string, ord int, block int, text string, start double, end double, source string, chars array<struct<char:string>>, warnings array<string>",
    )
    rows = [(0.5, 0.9, True)] * 236 + [(0.0, 0.0, True)] * 64
    got = {r["word_id"]: r["end_reason"] for r in sound.sustained_words(w, _frames(spark, rows)).collect()}
    assert got == {"0": "next_word", "1": "weak_anchor", "2": "too_little:silence", "3": None}
    bare = {r["word_id"]: r["end_reason"] for r in sound.sustained_words(w, _frames(spark, rows[:40])).collect()}
    assert bare["1"] == bare["2"] == "no_frames"


def test_phrase_tails(spark):
    n = spark.createDataFrame([("s", 1, 1, 0.0, 0.3, False), ("s", 2, 2, 2.0, 2.3, False), ("s", 3, 3, 3.0, 3.3, True)], "song_id string, unit long, block int, start double, end double, manual boolean")
    rows = [(0.5, 0.9, True)] * 50 + [(0.0, 0.0, True)] * 150 + [(0.5, 0.9, True)] * 400
    got = {r["unit"]: (round(r["end"], 6), round(r["tail"], 6)) for r in sound.phrase_tails(n, _frames(spark, rows), spark.createDataFrame([("s", 6.0)], "song_id string, duration double")).collect()}
    assert got == {1: (0.495, 0.195), 2: (2.995, 0.695), 3: (3.3, 0.0)}


def _placed(spark, words, found, start, end, confirmed=None, failed=False):
    df = spark.createDataFrame(
        [("s", 1, start, end, words, [w.lower() for w in words], found, confirmed, failed)],
        "song_id string, block long, start double, end double, words array<string>, keys array<string>, found array<struct<key:string,start:double,end:double,score:double>>, confirmed map<int,struct<start:double,end:double>>, failed boolean",
    )
    return [(r["text"], round(r["start"], 6), round(r["end"], 6), r["source"], round(r["score"], 3), list(r["warnings"])) for r in placement.align_captions(df, 10.0).orderBy("no").collect()]


def test_placement(spark):
    got = _placed(spark, ["La", "sol", "mi"], [("la", 0.1, 0.5, 0.9), ("mi", 1.5, 1.9, 0.9)], 0.0, 2.0)
    assert [x[:4] for x in got] == [("La", 0.0, 0.5, "model"), ("sol", 0.5, 1.5, "proportional"), ("mi", 1.5, 2.0, "model")] and got[1][4] == 0.0
    assert [x[:4] for x in _placed(spark, ["la"], [("la", 0.1, 0.2, 0.1)], 0.0, 1.0)] == [("la", 0.0, 1.0, "proportional")]
    got = _placed(spark, ["a", "b", "c"], None, 0.0, 3.0, {1: (1.0, 1.5)})
    assert [x[1:4] for x in got] == [(0.0, 1.0, "proportional"), (1.0, 1.5, "confirmed"), (1.5, 3.0, "proportional")]
    assert _placed(spark, [], None, 0.0, 3.0) == [] and _placed(spark, ["a"], None, 11.0, 12.0) == []
    got = _placed(spark, ["aaa", "b"], [("aaa", 0.1, 0.5, 0.9)], 0.0, 4.0, failed=True)
    assert [x[1:4] for x in got] == [(0.0, 3.0, "proportional"), (3.0, 4.0, "proportional")] and got[0][5] == ["engine_failed"]
    # Repeated words are matched in order, and a time out of order is not used.
    got = _placed(spark, ["la", "la"], [("la", 1.0, 1.5, 0.9), ("la", 0.2, 0.6, 0.9)], 0.0, 2.0)
    assert [x[3] for x in got] == ["model", "proportional"] and got[1][1:3] == (1.5, 2.0)


def test_placement_in_rows(spark):
    """F8: words of captions are placed without a shuffle or a sort, also between confirmed words and sure times."""
    from tessitura.plans.catalog import QUERIES

    plan = QUERIES["proportional_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Python" not in plan
    words = ["a", "bb", "c", "dd", "e", "ff", "g"]
    got = _placed(spark, words, [("c", 2.1, 2.4, 0.9), ("e", 3.0, 3.5, 0.8), ("g", 9.0, 9.5, 0.9)], 0.0, 8.0, {1: (1.0, 2.0), 5: (6.0, 6.5)})
    assert [x[:4] for x in got] == [
        ("a", 0.0, 1.0, "proportional"), ("bb", 1.0, 2.0, "confirmed"), ("c", 2.0, 2.4, "model"), ("dd", 2.4, 3.0, "proportional"),
        ("e", 3.0, 6.0, "model"), ("ff", 6.0, 6.5, "confirmed"), ("g", 6.5, 8.0, "proportional"),
    ]
    # Neighbours that are confirmed leave no part between them, and free words on both sides of a time share by length.
    got = _placed(spark, words, None, 0.0, 7.0, {0: (0.0, 1.0), 1: (1.0, 2.0), 6: (6.0, 7.0)})
    assert [x[1:3] for x in got] == [(0.0, 1.0), (1.0, 2.0), (2.0, round(2 + 4 / 6, 6)), (round(2 + 4 / 6, 6), 4.0), (4.0, round(4 + 4 / 6, 6)), (round(4 + 4 / 6, 6), 6.0), (6.0, 7.0)]
    got = _placed(spark, words, [("dd", 4.0, 5.0, 0.9)], 0.0, 9.0)
    assert [x[1:3] for x in got] == [(0.0, 1.0), (1.0, 3.0), (3.0, 4.0), (4.0, 5.0), (5.0, 6.0), (6.0, 8.0), (8.0, 9.0)] and [x[4] for x in got] == [0.0, 0.0, 0.0, 0.9, 0.0, 0.0, 0.0]


def test_syllable_parts(spark):
    df = spark.createDataFrame([("Amor",), ("x",), (None,)], "w string")
    assert [r[0] for r in df.select(syllables.syllable_parts(F.col("w"), {"amor": ["a", "mor"]})).collect()] == [["A", "mor"], ["x"], None]
    with pytest.raises(ValueError):
        syllables.syllable_parts(F.col("w"), {"amor": ["a", "mo"]})


def _limits(spark, parts, start, end, onsets=None, frames=None, original=None):
    df = spark.createDataFrame([(start, end, original, parts, onsets, frames)], "start double, end double, original_end double, parts array<string>, onsets array<struct<start:double,end:double>>, frames array<struct<t:double,rms:double,flux:double>>")
    r = syllables.syllable_limits(df).head()
    return [round(x, 6) for x in r["limits"]], list(r["origins"])


def test_syllable_limits(spark):
    chars = [(0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9)]
    assert _limits(spark, ["a", "mor"], 0.0, 1.0, chars) == ([0.0, 0.3, 1.0], ["caption", "characters", "caption"])
    share = 1 / (1 + 1.24)
    assert _limits(spark, ["a", "mor"], 0.0, 1.0)[0] == [0.0, round(share, 6), 1.0]
    # A sure event near the target moves it, a far or weak one does not.
    frames = [(t / 100, 1.0 if t != 50 else 0.0, 1.0 if t == 50 else 0.0) for t in range(100)]
    assert _limits(spark, ["a", "mor"], 0.0, 1.0, None, frames) == ([0.0, 0.5, 1.0], ["caption", "proportional+refined", "caption"])
    assert _limits(spark, ["a", "mor"], 0.0, 1.0, None, [(t, 1.0, 0.0) for t, _, _ in frames])[1][1] == "proportional"
    assert _limits(spark, ["a", "mor"], 0.0, 1.0, None, [(t, 0.0, 1.0) for t, _, _ in frames])[1][1] == "proportional"
    # Added time goes to the last syllable only, and every syllable keeps its least time.
    assert _limits(spark, ["a", "mor"], 0.0, 2.0, None, None, 1.0)[0] == [0.0, round(share, 6), 2.0]
    tight = _limits(spark, ["a", "b", "c"], 0.0, 0.3, [(0.29, 0.3)] * 3)[0]
    assert all(b - a >= 0.045 - 1e-9 for a, b in zip(tight, tight[1:]))


def test_cores_and_syllables(spark):
    rows = [(1.0, 0.9 if 20 <= i < 60 and not 40 <= i < 43 else 0.1) for i in range(100)]
    frames = spark.createDataFrame([("s", i / 100, a, b, 0.0) for i, (a, b) in enumerate(rows)], "song_id string, t double, rms double, per double, flux double")
    syl = spark.createDataFrame([("s", 1, 0.0, 1.0, []), ("q", 2, 0.0, 1.0, [(0.1, 0.6)]), ("q", 3, 0.0, 1.0, [])], "song_id string, k int, start double, end double, vowels array<struct<start:double,end:double>>")
    got = {r["k"]: r for r in syllables.cores(syl, frames, ["song_id", "k"]).collect()}
    assert abs(got[1]["core_start"] - 0.195) < 1e-9 and abs(got[1]["core_end"] - 0.595) < 1e-9 and got[1]["core_source"] == "periodic" and abs(got[1]["coverage"] - 0.37) < 1e-9
    assert list(got[1]["core_warnings"]) == [] and got[2]["core_source"] == "characters" and (got[2]["core_start"], got[2]["core_end"]) == (0.1, 0.6)
    assert got[3]["core_source"] == "proportional" and got[3]["core_start"] == 0.2 and list(got[3]["core_warnings"]) == ["core_without_audio"]
    w = spark.createDataFrame(
        [("s", "w1", 1, "amor", 0.0, 1.0, None, 0.9, [("a", 0.0, 0.3, 0.9), ("m", 0.3, 0.5, 0.9), ("o", 0.5, 0.7, 0.9), ("r", 0.7, 0.9, 0.9)], []), ("s", "w2", 2, "sol", 1.0, 2.0, None, 0.9, [], ["old"])],
        "song_id string, word_id string, ord int, text string, start double, end double, original_end double, score double, chars array<struct<char:string,start:double,end:double,score:double>>, warnings array<string>",
    )
    out = syllables.syllables(w, frames, syllables.syllable_parts(F.col("text"), {"amor": ["a", "mor"]})).orderBy("ord").collect()
    assert [(r["text"], r["no"], r["ord"], round(r["start"], 6), round(r["end"], 6), r["origin"]) for r in out] == [("a", 1, 1, 0.0, 0.3, "characters"), ("mor", 2, 2, 0.3, 1.0, "characters"), ("sol", 1, 3, 1.0, 2.0, "whole_word")]
    assert out[2]["score"] == 0.25 and list(out[2]["warnings"]) == ["core_without_audio", "old"] and out[0]["core_source"] == "periodic" and out[0]["score"] == 0.9
