"""Engines as table functions, and the loop of two levels against a plain one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import engine, sound


def _counted(segments, likely, folder):
    """An engine that notes every question in a folder; a class of its own, so that workers need not import this module."""
    import os

    class Counted(engine.Recorded):
        def hear(self, song_id, start, end, language):
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
                f.write(f"hear {song_id} {start} {end} {language}\n")
            return super().hear(song_id, start, end, language)

        def languages(self, song_id, start, end):
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
                f.write(f"languages {song_id} {start} {end}\n")
            return super().languages(song_id, start, end)

    return Counted(segments, likely)


def test_functions_in_sql(spark):
    e = engine.Recorded({("a", 0, 1000, "pt"): [(0.0, 0.5, "olá", -0.1, 0.1, 1.0, 2), (0.5, 1.0, "amor", -0.2, 0.1, 1.0, 1)]}, {("a", 0, 1000): {"pt": 0.9}})
    engine.register(spark, e)
    spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0)], "song_id string, start double, end double").createOrReplaceTempView("asked")
    got = spark.sql("SELECT w.song_id, h.text FROM asked w, LATERAL hear(w.song_id, w.start, w.end, 'pt') h ORDER BY h.seg_start").collect()
    assert [tuple(r) for r in got] == [("a", "olá"), ("a", "amor")]
    assert [tuple(r) for r in spark.sql("SELECT w.song_id, l.likely['pt'] FROM asked w, LATERAL likely(w.song_id, w.start, w.end) l ORDER BY 1").collect()] == [("a", 0.9), ("b", None)]


def _world(seed=2):
    """Signals, first windows, voice, and a deterministic engine over any window."""
    r = random.Random(seed)
    signals = {f"s{k}": (np.abs(np.random.default_rng(k).normal(size=100 * r.randrange(30, 90))), 100) for k in range(4)}
    windows = [(s, a / rate, b / rate) for s, (x, rate) in signals.items() for a, b in sound.quiet_cuts(x, rate)]
    voice = [(s, 3.0 * k, 3.0 * k + r.random() * 2) for s, (x, rate) in signals.items() for k in range(len(x) // rate // 3) if r.random() < 0.7]
    return signals, windows, voice


def _answers(song, start, end, language):
    """What the engine hears: drawn from a hash of the window."""
    r = random.Random(f"{song} {round(start * 1000)} {round(end * 1000)} {language}")
    vocabulary = {"pt": ["não", "você", "para", "coração", "la"], "en": ["the", "you", "and", "heart", "la"]}
    out, at = [], 0.0
    for _ in range(r.randrange(0, 4)):
        a = at + r.random()
        at = a + r.random() * 3 if r.random() < 0.9 else a - 1
        mixed = vocabulary[r.choice(["pt", "en"])] if r.random() < 0.3 else vocabulary[language]
        out.append((round(a, 3), round(at, 3), " ".join(r.choice(mixed) for _ in range(r.randrange(0, 6))), -r.random() * 1.5, r.random(), 1 + 2 * r.random(), r.randrange(1, 9)))
    return out


def _likely(song, start, end):
    r = random.Random(f"{song} {round(start * 1000)} {round(end * 1000)}")
    pt = r.random()
    return {"pt": pt, "en": round((1 - pt) * r.random(), 3), "fr": 0.05}


def test_two_levels_against_a_plain_loop(spark, tmp_path):
    signals, windows, voice = _world()
    every, likely, children = {}, {}, {}
    for s, a, b in windows:
        x, rate = signals[s]
        part = x[round(a * rate) : round(b * rate)]
        at = a + sound.quiet_cuts(part, rate, len(part) / rate * 0.4, len(part) / rate * 0.6)[0][1] / rate
        children[s, a, b] = [(s, a, at), (s, at, b)]
    for s, a, b in [*windows, *(c for cs in children.values() for c in cs)]:
        likely[engine.Recorded.key(s, a, b)] = _likely(s, a, b)
        for language in ("pt", "en"):
            every[engine.Recorded.key(s, a, b, language)] = _answers(s, a, b, language)
    e = _counted(every, likely, str(tmp_path))

    windows_df = spark.createDataFrame(windows, "song_id string, start double, end double")
    signals_df = spark.createDataFrame([(s, x.tolist(), rate) for s, (x, rate) in signals.items()], "song_id string, samples array<double>, rate int")
    voice_df = spark.createDataFrame(voice, "song_id string, start double, end double")
    segments, audit = engine.recognise(windows_df, signals_df, voice_df, e)
    audited = {(r["song_id"], round(r["start"], 6), round(r["end"], 6)): r for r in audit.collect()}
    got = sorted((r["song_id"], round(r["start"], 3), round(r["end"], 3), r["text"], r["language"]) for r in segments.collect())

    plain, asked, split = [], [], 0
    for w in windows:
        todo = [(w, 0)]
        while todo:
            (s, a, b), level = todo.pop()
            asked.append((s, a, b))
            winner, mixed, text = _plain_choice(every, likely, voice, s, a, b)
            row = audited[s, round(a, 6), round(b, 6)]
            assert (row["winner"], row["level"]) == (winner, level)
            again = winner is not None and mixed and level == 0 and b - a > 12
            assert row["used"] == (not again)
            if again:
                todo += [(c, 1) for c in children[s, a, b]]
                split += 1
            elif winner is not None:
                plain += _plain_segments(every[engine.Recorded.key(s, a, b, winner)], s, a, b, text, winner)
    assert got == sorted(plain) and 0 < split < len(windows) and len(audited) == len(asked)
    questions = [x for f in tmp_path.iterdir() for x in f.read_text().splitlines()]
    assert len(questions) == len(set(questions)) == 3 * len(asked)


def _plain_choice(every, likely, voice, s, a, b):
    probs = likely[engine.Recorded.key(s, a, b)]
    best = "en" if probs["en"] > probs["pt"] else "pt"
    strong = probs[best] >= 0.65 and abs(probs["pt"] - probs["en"]) >= 0.2 and probs[best] == max(probs.values())
    hypotheses = []
    for language in ("pt", "en"):
        segs = every[engine.Recorded.key(s, a, b, language)]
        n = sum(x[6] for x in segs)
        mean = lambda k, empty, segs=segs, n=n: sum(x[k] * x[6] for x in segs) / n if n else empty
        text = " ".join(x[2] for x in sorted(segs, key=lambda x: x[:3])).strip()
        cr = max((x[5] for x in segs), default=0.0)
        if text:
            hypotheses.append({"language": language, "text": text, "lp": mean(3, -10.0), "ns": mean(4, 1.0), "cr": cr, "score": mean(3, -10.0) - min(1.0, max(0.0, cr - 2.4) * 0.25)})
    if not hypotheses:
        return None, False, None
    if not any(v[0] == s and v[1] < b and v[2] > a for v in voice) and all(h["ns"] > 0.6 for h in hypotheses):
        return None, False, None
    ordered = sorted(hypotheses, key=lambda h: -h["score"])
    won, margin = ordered[0], ordered[0]["score"] - ordered[1]["score"] if len(ordered) > 1 else None
    fits = next((h for h in hypotheses if h["language"] == best), None)
    if strong and fits and (fits["lp"] >= -1 and fits["cr"] <= 2.4 or margin is not None and margin < 0.15):
        won = fits
    words = won["text"].lower().split()
    from tessitura.functions import language as L

    pt = sum(w in L.ONLY_PT or any(c in w for c in "ãõç") for w in words)
    en = sum(w in L.ONLY_EN for w in words)
    mixed = min(probs["pt"], probs["en"]) >= 0.15 or (min(pt, en) >= 2 and min(pt, en) / max(1, pt + en) >= 0.2) or (strong and won["language"] != best)
    return won["language"], mixed, won["text"]


def _plain_segments(segs, s, a, b, text, language):
    kept = [(x, min(y, b - a), t) for x, y, t, *_ in sorted(segs, key=lambda x: x[:3]) if t]
    before = 0.0
    for x, y, _ in kept:
        if not 0 <= round(x * 1000) < round(y * 1000) or round(x * 1000) < round(before * 1000):
            return [(s, round(a, 3), round(b, 3), text, language)]
        before = y
    return [(s, round(a + x, 3), round(a + y, 3), t, language) for x, y, t in kept]


def test_no_windows(spark):
    none = spark.createDataFrame([], "song_id string, start double, end double")
    signals = spark.createDataFrame([], "song_id string, samples array<double>, rate int")
    segments, audit = engine.recognise(none, signals, none, engine.Recorded())
    assert segments.count() == 0 and audit.count() == 0
    one = spark.createDataFrame([("a", 0.0, 20.0)], "song_id string, start double, end double")
    segments, audit = engine.recognise(one, signals, none, engine.Recorded())
    assert segments.count() == 0 and [(r["winner"], r["used"]) for r in audit.collect()] == [(None, True)]
    assert audit.select(F.col("reason")).head()[0] == "no_text"


def test_languages_with_context(spark):
    """Short, weak or contradicted segments are heard again with what is around them, others are not."""
    key = engine.Recorded.key
    likely = {
        key("s", 0.0, 5.0): {"pt": 0.9, "en": 0.05}, key("s", 10.0, 11.0): {"pt": 0.4, "en": 0.5}, key("s", 7.5, 13.5): {"pt": 0.8, "en": 0.1},
        key("s", 20.0, 25.0): {"pt": 0.9, "en": 0.05}, key("s", 19.5, 25.5): {"pt": 0.85, "en": 0.1}, key("s", 29.0, 30.0): {"pt": 0.5, "en": 0.4}, key("s", 26.5, 30.0): {"en": 0.5, "pt": 0.4},
    }
    rows = [("s", 0.0, 5.0, "la la"), ("s", 10.0, 11.0, "la"), ("s", 20.0, 25.0, "the sun and the moon with you"), ("s", 29.0, 30.0, None)]
    df = spark.createDataFrame(rows, "song_id string, start double, end double, text string")
    durations = spark.createDataFrame([("s", 30.0)], "song_id string, duration double")
    got = {r["start"]: r for r in engine.languages_of(df, durations, engine.Recorded({}, likely)).collect()}
    assert (got[0.0]["choice"]["language"], got[0.0]["choice"]["source"], got[0.0]["wide_start"]) == ("pt", "local_audio", None)
    assert (got[10.0]["choice"]["language"], got[10.0]["choice"]["source"], got[10.0]["wide_start"], got[10.0]["wide_end"]) == ("pt", "wide_audio", 7.5, 13.5) and got[10.0]["confidence"] == 0.4
    assert (got[20.0]["choice"]["language"], got[20.0]["choice"]["source"], got[20.0]["choice"]["text_differs"], got[20.0]["wide_end"]) == ("en", "recognised_text", True, 25.5)
    assert (got[29.0]["choice"]["language"], got[29.0]["wide_start"], got[29.0]["choice"]["review"]) == ("pt", 26.5, True)
    bad = spark.createDataFrame([("s", 29.0, 31.0, "x")], "song_id string, start double, end double, text string")
    with pytest.raises(Exception, match="no valid times"):
        engine.languages_of(bad, durations, engine.Recorded()).collect()
