"""Subtitle and note files as data sources: round trips, and publications that are whole or not there."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessitura.sources import captions, files, publication

SCHEMA = "song_id string, ord long, start_ms long, end_ms long, text string"


def _captions(n_songs=12, seed=0):
    r = random.Random(seed)
    rows = []
    for s in range(n_songs):
        at = 0
        for k in range(r.randrange(1, 30)):
            start = at + r.randrange(0, 900)
            at = start + r.randrange(1, 5_000_000 if k == 3 else 4000)
            rows.append((f"song {s}/é:{s}%", k, start, at, r.choice(["la la", "é isso\nmesmo", "<b> & ♪", "x" * 200])))
    return rows


def test_subtitles_round_trip(spark, tmp_path):
    rows = _captions()
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(5)
    files.write_files(df, "subtitles", str(tmp_path), ["ord"])
    back = files.read_files(spark, "subtitles", f"file://{tmp_path}").orderBy("song_id", "ord").collect()
    want = sorted((s, k + 1, a, b, t.replace("\n", " ")) for s, k, a, b, t in rows)
    assert [(r["song_id"], r["ord"], r["start_ms"], r["end_ms"], r["raw"]) for r in back] == want
    assert {r["problem"] for r in back} == {None} and {r["text"] for r in back if r["raw"] == "<b> & ♪"} <= {"&"}
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW published USING subtitles OPTIONS (path '{tmp_path}', mode 'strict')")
    assert spark.sql("SELECT count(*) FROM published WHERE problem IS NULL").head()[0] == len(rows)


def test_the_source_reads_as_the_expressions_do(spark, tmp_path):
    """Odd files, by the data source and by the column expressions, in both modes."""
    r = random.Random(7)
    parts = ["1", "2", "7", "x", "00:00:01,000 --> 00:00:02,500", "00:00:02.000 --> 00:00:03.000 align:start", "0:00:04,000 --> 0:00:03,000", "00:61:00,000 --> 00:62:00,000", "", " ", "<i>Bom</i> dia &amp; caf&eacute;", "[x] ♪ la", "á {\\an8}b", "00:00:09,000 --> 00:00:10,000"]
    texts = ["﻿" + "\r\n".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(60)] + [""]
    for k, t in enumerate(texts):
        (tmp_path / f"{k:02d}.srt").write_bytes(t.encode())
    table = spark.createDataFrame([(f"{k:02d}", t) for k, t in enumerate(texts)], "path string, content string")
    for mode in ("lenient", "strict"):
        want = sorted(map(tuple, captions.captions(table, mode).where("path <> '60'").select("path", "ord", "idx", "start_ms", "end_ms", "raw", "text", "problem").collect()), key=repr)
        got = sorted(map(tuple, files.read_files(spark, "subtitles", str(tmp_path), mode=mode).select("song_id", "ord", "idx", "start_ms", "end_ms", "raw", "text", "problem").collect()), key=repr)
        assert got == want


def test_notes_round_trip(spark, tmp_path):
    rows = [(f"s{s}", 100 * k, 100 * k + 60, 40 + k, f"sí{k}") for s in range(4) for k in range(20)]
    df = spark.createDataFrame(rows, "song_id string, tick_on long, tick_off long, pitch int, text string")
    files.write_files(df.orderBy(F.rand(3)), "notefiles", str(tmp_path), ["tick_on"])
    got = files.read_files(spark, "notefiles", str(tmp_path)).orderBy("song_id", "no").collect()
    assert [(r["song_id"], r["tick_on"], r["tick_off"], r["pitch"]) for r in got] == sorted(r[:4] for r in rows)
    assert [r["no"] for r in got] == [*range(1, 21)] * 4
    content = next(tmp_path.rglob("s2.mid")).read_bytes()
    assert len(publication._events(content)) == 20


def _songs(spark, path):
    return sorted({r["song_id"] for r in files.read_files(spark, "subtitles", str(path)).collect()})


def test_all_or_nothing(spark, tmp_path):
    """A task that fails leaves nothing published, whatever the other tasks wrote; what was there stays."""
    rows = _captions(8)
    good = spark.createDataFrame(rows, SCHEMA)
    bad = good.unionByName(spark.createDataFrame([("zz", 0, 50, 20, "ends before it starts")], SCHEMA))
    with pytest.raises(Exception, match="no valid times"):
        files.write_files(bad, "subtitles", str(tmp_path), ["ord"])
    assert not list(tmp_path.rglob("*.srt")) and not (tmp_path / "_current").exists()
    files.write_files(good, "subtitles", str(tmp_path), ["ord"])
    songs = _songs(spark, tmp_path)
    with pytest.raises(Exception, match="no valid times"):
        files.write_files(bad, "subtitles", str(tmp_path), ["ord"], overwrite=True)
    assert _songs(spark, tmp_path) == songs and len(list(tmp_path.rglob("*.srt"))) == len(songs)


def test_append_overwrite_restore(spark, tmp_path):
    one, two = (spark.createDataFrame([(s, 0, 0, 10, s)], SCHEMA) for s in ("a", "b"))
    files.write_files(one, "subtitles", str(tmp_path), ["ord"])
    files.write_files(two, "subtitles", str(tmp_path), ["ord"])
    assert _songs(spark, tmp_path) == ["a", "b"]
    with pytest.raises(Exception, match="are there already"):
        files.write_files(one, "subtitles", str(tmp_path), ["ord"])
    assert _songs(spark, tmp_path) == ["a", "b"]
    files.write_files(two, "subtitles", str(tmp_path), ["ord"], overwrite=True)
    assert _songs(spark, tmp_path) == ["b"]
    files.restore(str(tmp_path))
    assert _songs(spark, tmp_path) == ["a", "b"]
    files.restore(str(tmp_path))
    assert _songs(spark, tmp_path) == ["a"]
    with pytest.raises(ValueError, match="no earlier"):
        files.restore(str(tmp_path))


def test_published_files_that_are_gone(spark, tmp_path):
    files.write_files(spark.createDataFrame([("a", 0, 0, 10, "x")], SCHEMA), "subtitles", str(tmp_path), ["ord"])
    os.remove(next(tmp_path.rglob("a.srt")))
    with pytest.raises(Exception, match="are gone"):
        _songs(spark, tmp_path)


def test_rows_of_a_song_apart(spark, tmp_path):
    files.register(spark)
    df = spark.createDataFrame([("a", 0, 0, 10, "x"), ("b", 0, 0, 10, "x"), ("a", 1, 20, 30, "x")], SCHEMA)
    with pytest.raises(Exception, match="stand together"):
        df.coalesce(1).write.format("subtitles").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="two tasks"):
        df.repartition(3, "ord", "song_id").write.format("subtitles").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="no song_id"):
        files.write_files(spark.createDataFrame([(None, 0, 0, 10, "x")], SCHEMA), "subtitles", str(tmp_path), ["ord"])
    with pytest.raises(Exception, match="needed"):
        df.drop("text").write.format("subtitles").mode("append").save(str(tmp_path))
    assert not list(tmp_path.rglob("*.srt"))


def test_plain_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.SRT").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    (tmp_path / "_hidden.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    (tmp_path / "other.txt").write_text("x")
    assert files.read_files(spark, "subtitles", str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="lenient"):
        files.read_files(spark, "subtitles", str(tmp_path), mode="loose").count()


@pytest.mark.parametrize("song", ["a", "", ".", "..", "a/b", "100%", "é ü", "x.", "tab\t", "%41", "con:*?"])
def test_names(song):
    name = files.file_name(song, ".srt")
    assert files.song_of(f"/x/{name}", ".srt") == song and not set(name) & set('<>:"/\\|?*\t') and name not in ("", ".", "..")


def test_many_files_are_dealt_by_size(monkeypatch, tmp_path):
    for k in range(10):
        (tmp_path / f"{k}.srt").write_bytes(b"x" * 100)
    monkeypatch.setattr(files, "TASK_BYTES", 250)
    parts = files._Reader(str(tmp_path), ".srt", None).partitions()
    assert [len(p.paths) for p in parts] == [2] * 5


def test_packed_notes(spark, tmp_path, monkeypatch):
    """Many songs take a few archives, whatever their number, and are read back as from files; no song is taken twice, nothing is appended."""
    monkeypatch.setattr(files, "PACK_SONGS", 7)
    rows = [(f"s/{s}", 100 * k, 100 * k + 60, 40 + k, f"sí{k}") for s in range(60) for k in range(5)]
    df = spark.createDataFrame(rows, "song_id string, tick_on long, tick_off long, pitch int, text string")
    files.write_files(df, "notefiles", str(tmp_path), ["tick_on"], packed=True)
    assert len(list(tmp_path.rglob("*.zip"))) < 60 and not list(tmp_path.rglob("*.mid"))
    got = files.read_files(spark, "notefiles", str(tmp_path))
    assert sorted((r["song_id"], r["tick_on"], r["tick_off"], r["pitch"]) for r in got.collect()) == sorted(r[:4] for r in rows)
    for packed in (True, False):
        with pytest.raises(Exception, match="not appended to"):
            files.write_files(df, "notefiles", str(tmp_path), ["tick_on"], packed=packed)
    files.write_files(df.where("song_id < 's/3'"), "notefiles", str(tmp_path), ["tick_on"], overwrite=True)
    assert files.read_files(spark, "notefiles", str(tmp_path)).select("song_id").distinct().count() == 23
    files.restore(str(tmp_path))
    assert files.read_files(spark, "notefiles", str(tmp_path)).count() == len(rows)


def test_note_files_of_orders_are_packed(spark, monkeypatch):
    """The disk that the query takes does not grow by a block for each order."""
    from tessitura.plans import file_queries

    seen = []
    write = files.write_files
    monkeypatch.setattr(file_queries.files, "write_files", lambda df, kind, path, *a, **k: (seen.append(path), write(df, kind, path, *a, **k)))
    n = file_queries.note_files(spark, "/root/testdata/sf0.001").select("song_id").distinct().count()
    found = [f for _, _, names in os.walk(seen[0].removeprefix("file://").removeprefix("file:")) for f in names]
    assert 0 < len(found) < n


def test_long_tracks_are_written_in_proportion():
    """A file of many notes is put together once, not copied for each event."""
    from time import perf_counter

    notes = [{"tick_on": 100 * k, "tick_off": 100 * k + 60, "pitch": 40 + k % 30, "text": "la"} for k in range(150_000)]
    begin = perf_counter()
    content = publication._track(notes)
    assert perf_counter() - begin < 10
    assert publication._events(content) == [{c: n[c] for c in ("tick_on", "tick_off", "pitch")} for n in notes]
