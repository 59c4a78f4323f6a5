from pyspark.sql import functions as F

from tessitura.functions.text import comparison_key, tokens
from tessitura.operators import series
from tessitura.plans import consolidation, notes


def test_notes(spark):
    frames = [("s", i / 100, 60.0 if i < 100 else 64.0, 0.99, 1.0, [1.0 if k == (0 if i < 100 else 4) else 0.0 for k in range(12)], 1.0) for i in range(200)]
    frames += [("q", i / 100, None, 0.0, 1.0, [0.0] * 12, 0.0) for i in range(50)]
    f = spark.createDataFrame(frames, "song_id string, t double, midi double, voiced_prob double, energy double, chroma array<double>, harmonic_confidence double")
    units = [("s", 1, "a", 1, 0.0, 1.0, 0.2, 0.9, []), ("s", 2, "b", 1, 1.0, 2.0, 1.2, 1.9, ["old"]), ("q", 1, "c", 1, 0.0, 0.4, 0.1, 0.3, [])]
    u = spark.createDataFrame(units, "song_id string, unit long, word_id string, block int, start double, end double, core_start double, core_end double, warnings array<string>")
    got = {(r["song_id"], r["unit"]): r for r in notes.notes(u, f).collect()}
    assert len(got) == 3
    assert (got["s", 1]["pitch"], got["s", 1]["tier"], list(got["s", 1]["reasons"])) == (60, "core", [])
    assert (got["s", 2]["pitch"], list(got["s", 2]["reasons"])) == (64, ["old"])
    assert "no_voiced_frames" in got["q", 1]["reasons"] and got["q", 1]["tier"] is None


def test_harmonic_frames(spark):
    rows = [(1, i, [1.0] + [0.0] * 11 if i % 2 else [0.5] * 12, float(i)) for i in range(20)]
    out = series.harmonic_frames(spark.createDataFrame(rows, "k int, i int, chroma array<double>, rms double"), ["k"], ["i"]).collect()
    assert all(abs(max(r["chroma"]) - 1) < 1e-9 and 0 <= r["harmonic_confidence"] <= 1 for r in out)


def test_consolidation(spark):
    lines = ["me diz mais uma vez", "que já estamos aqui", "livre para voar alto", "distantes de tudo"]
    words = [("s", n, w) for n, line in enumerate(lines) for w in line.split()]
    lyric = spark.createDataFrame([("s", p, n, w) for p, (_, n, w) in enumerate(words)], "song_id string, pos long, line int, text string").withColumn("key", comparison_key(F.col("text")))
    caps = [("s", 1, 10.0, 14.0, "Me diz mais uma vez"), ("s", 2, 14.0, 18.0, "que já estamos aqui"), ("s", 3, 30.0, 33.0, "diz antes de tudo")]
    captions = spark.createDataFrame(caps, "song_id string, idx long, start double, end double, text string").withColumn("keys", F.transform(tokens(F.col("text")), comparison_key))
    found = spark.createDataFrame([("s", p, 20.0 + p, 20.5 + p, 0.9) for p in range(9, 13)], "song_id string, pos long, start double, end double, score double")
    found = found.withColumns({"start": F.col("start") - 9, "end": F.col("end") - 9}).join(lyric.select("song_id", "pos", "key"), ["song_id", "pos"])
    songs = spark.createDataFrame([("s", 40.0)], "song_id string, duration double")
    out = consolidation.consolidate(captions, lyric, found, songs)
    got = [(r["text"], r["origin"], r["problem"]) for r in out["published"].orderBy("start").collect()]
    assert got == [("me diz mais uma vez", "corrected", None), ("que já estamos aqui", "kept", None), ("livre para voar alto", "inserted", None), ("distantes de tudo", "corrected", None)]
    assert [r["state"] for r in out["filled"].collect()] == ["full"]
