import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import words as X
from tessitura.sources import audio
from tessitura.streaming import sessions


def test_char_functions(spark):
    df = spark.createDataFrame([(1, i, c, i / 10, (i + 1) / 10, 0.9) for i, c in enumerate("oi tu")], "k int, pos int, char string, start double, end double, score double")
    assert [(r["word_no"], r["text"]) for r in X.chars_to_words(df, ["k"]).orderBy("word_no").collect()] == [(1, "oi"), (2, "tu")]
    one = df.groupBy("k").agg(F.collect_list(F.struct("char", "start", "end", "score")).alias("c"))
    r = one.select(F.size(X.usable_chars(F.col("c"), F.lit(0.0), F.lit(0.3))).alias("n"), X.mean_score(F.col("c"), F.lit(None).cast("double")).alias("m"), F.size(X.spelling_chars(F.col("c"), F.lit("Oi tu"))).alias("s"), F.size(X.spelling_chars(F.col("c"), F.lit("no"))).alias("z")).head()
    assert (r["n"], round(r["m"], 6), r["s"], r["z"]) == (3, 0.9, 4, 0)


def test_windows_of_words(spark):
    df = spark.createDataFrame([("s", 1, 1, 0.0, 1.0, 0.9), ("s", 1, 2, 1.05, 2.0, 0.1), ("s", 2, 3, 2.0, 3.0, 0.9)], "song_id string, block int, i int, start double, end double, score double")
    a = X.nearest_anchors(df, ["song_id"], ["i"]).where("i = 2").head()
    assert (a["anchor_before"], a["anchor_after"]) == (1.0, 2.0)
    w = X.wider_window(df, ["song_id"], ["i"], "block").where("i = 2").head()
    assert (w["window_start"], round(w["window_end"], 6)) == (1.0, 2.12)
    assert [r["group_no"] for r in X.contiguous_groups(df, ["song_id"], ["i"], "block", "block", "start", "end").orderBy("i").collect()] == [1, 2, 3]


def test_alignment_problem(spark):
    rows = [("a", 1, "x", "x", 0.0, 1.0, 0.9), ("b", 1, "x", "y", 0.0, 1.0, 0.9), ("c", 1, "x", "x", 0.0, 1.0, 0.1), ("d", 1, "x", "x", None, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "k string, i int, expected string, found string, start double, end double, score double")
    got = {r["k"]: r["problem"] for r in X.alignment_problem(df, ["k"], ["i"], F.lit(0.0), F.lit(5.0), F.lit(0.3)).collect()}
    assert got == {"a": None, "b": "words_differ", "c": "score_too_low", "d": "no_time_or_score"}


def test_consolidate(spark):
    kept = spark.createDataFrame([("s", 15, 129.35, 133.21, "Me diz"), ("s", 16, 133.21, 138.39, "Diz antes de tudo")], "song_id string, idx int, start double, end double, text string")
    fixed = spark.createDataFrame([("s", 16, "Distantes de tudo")], "song_id string, idx int, text string")
    new = spark.createDataFrame([("s", None, 139.0, 141.0, "la la")], "song_id string, idx int, start double, end double, text string")
    out = X.consolidate(kept, fixed, new, ["song_id"])
    assert [(r["text"], r["origin"], r["problem"]) for r in out.orderBy("start").collect()] == [("Me diz", "kept", None), ("Distantes de tudo", "corrected", None), ("la la", "inserted", None)]
    m = X.run_metrics(out, ["song_id"]).head()
    assert (m["published"], m["kept"], m["corrected"], m["inserted"], m["overlaps"]) == (3, 1, 1, 1, 0)


def test_wave_frames(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        tone = (np.sin(2 * np.pi * 220 * np.arange(8000) / 16000) * 20000).astype("<i2")
        w.writeframes(np.repeat(tone, 2).tobytes())
    got = audio.wave_frames(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.avg("per").alias("p")).head()
    assert got["n"] == 50 and got["p"] > 0.8


def test_streaming(spark, tmp_path):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    rows = [(1, base + timedelta(minutes=m), m < 5) for m in (0, 1, 2, 30, 31)] + [(2, base, True)]
    spark.createDataFrame(rows, "k int, at timestamp, f boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, at timestamp, f boolean").parquet(str(tmp_path / "in"))
    for name, df, mode in (("sess", sessions.pause_sessions(source, "k", "at", "10 minutes", "1 hour"), "complete"), ("runs", sessions.running_runs(source, "k", "at", "f"), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("sess").collect()) == [(1, 2), (1, 3), (2, 1)]
    assert sorted((r["k"], r["flag"], r["run_length"]) for r in spark.table("runs").collect()) == [(1, "False", 2), (2, "True", 1)]
