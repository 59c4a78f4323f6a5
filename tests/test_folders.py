"""Folders of songs, manifests, the cache by content, locks, and review helpers."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tessitura.operators import review
from tessitura.sources import folders, publication, writers

FILES = "song_id string, path string, length long"


def _files(spark, **songs):
    return spark.createDataFrame([(s, p, n) for s, fs in songs.items() for p, n in fs.items()], FILES)


FULL = {"/m/Voz.WAV": 9, "/m/instrumental.mp3": 9, "/m/LETRA.srt": 9, "/m/letra.TXT": 9}


def test_roles(spark):
    found = sorted((r["role"], r["path"]) for r in folders.roles(_files(spark, a=FULL | {"/m/voz.txt": 1, "/m/letra.md": 1, "/m/voz": 1, "/m/x/voz.flac": 2})).collect())
    assert found == [("captions", "/m/LETRA.srt"), ("instrumental", "/m/instrumental.mp3"), ("lyrics", "/m/letra.TXT"), ("voice", "/m/Voz.WAV"), ("voice", "/m/x/voz.flac")]


def test_states(spark):
    without = lambda name: {k: v for k, v in FULL.items() if name not in k.lower()}
    f = _files(spark, full=FULL, mute=without("voz"), twice=FULL | {"/m/voz.mp3": 9}, hollow=FULL | {"/m/letra.TXT": 0}, fresh={"/m/voz.ogg": 1}, crossed=FULL, unread=FULL)
    songs = spark.createDataFrame([(s,) for s in ("full", "mute", "twice", "hollow", "fresh", "crossed", "unread", "nothing")], "song_id string")
    c = spark.createDataFrame([(s, k, a, z) for s in ("full", "mute", "twice", "hollow") for k, a, z in ((1, 0, 10), (2, 10, 20))] + [("crossed", 1, 0, 11), ("crossed", 2, 10, 20)], "song_id string, idx int, start_ms long, end_ms long")
    got = {(r["song_id"], r["operation"]): r["problem"] for r in folders.folder_state(songs, f, c).collect()}
    notes = {s: p for (s, op), p in got.items() if op == "notes"}
    assert notes == {"full": None, "mute": "missing_voice", "twice": "several_voice", "hollow": "empty_lyrics", "fresh": "missing_instrumental", "crossed": "captions_overlap", "unread": "no_captions", "nothing": "missing_voice"}
    first = {s: p for (s, op), p in got.items() if op == "captions"}
    assert first == {"full": "reserved_file", "mute": "missing_voice", "twice": "several_voice", "hollow": "reserved_file", "fresh": None, "crossed": "reserved_file", "unread": "reserved_file", "nothing": "missing_voice"}
    assert folders.caption_suffix("words") == "palavras"
    with pytest.raises(ValueError, match="mode"):
        folders.caption_suffix("lines")


def test_manifests(spark):
    block = [(1, 1, "la", 0.0, 1.0, True), (1, 2, "sol", None, None, False), (2, 1, "x", None, None, None)]
    schema = "song_id string, version int, sha256 string, sources map<string,string>, blocks array<struct<block:int,no:int,text:string,start:double,end:double,confirmed:boolean>>"
    m = spark.createDataFrame([(s, v, c, {"voice": w}, block) for s, v, c, w in (("ok", 1, "c", "v"), ("old", 0, "c", "v"), ("text", 1, "d", "v"), ("voice", 1, "c", "w"), ("gone", 1, "c", "v"), ("none", None, "c", "v"))], schema)
    captions = spark.createDataFrame([(s, "c") for s in ("ok", "old", "text", "voice", "none")], "song_id string, sha256 string")
    voices = spark.createDataFrame([(s, "v") for s in ("ok", "old", "text", "voice", "gone", "none")], "song_id string, sha256 string")
    got = {r["song_id"]: r["problem"] for r in folders.manifest_problems(m, captions, voices).collect()}
    assert got == {"ok": None, "old": "unknown_version", "text": "captions_changed", "voice": "voice_changed", "gone": "captions_changed", "none": "unknown_version"}
    rows = folders.confirmed_times(m, captions, voices).collect()
    assert [(r["song_id"], r["block"], len(r["words"])) for r in rows] == [("ok", 1, 2)]


def test_captions_and_their_report(spark):
    b = spark.createDataFrame([(s, k, 1000 * k, 1000 * k + 900, "la") for s in ("a", "b", "c") for k in (1, 2)], "song_id string, idx int, start_ms long, end_ms long, text string")
    right = writers.subtitle_text(b, ["song_id"], ["start_ms"])
    wrong = right.where("song_id <> 'c'").withColumn("content", F.when(F.col("song_id") == "b", F.replace("content", F.lit("la"), F.lit("lá"))).otherwise(F.col("content"))).unionByName(spark.createDataFrame([("d", "x")], "song_id string, content string"))
    assert folders.differing_captions(b, right).count() == 0
    assert sorted(map(tuple, folders.differing_captions(b, wrong).collect())) == [("b", "differs"), ("c", "no_file"), ("d", "no_blocks")]


def test_cache(spark, tmp_path):
    root, asked = str(tmp_path / "cache"), []

    def compute(absent):
        asked.append(sorted(r["identity"] for r in absent.collect()))
        return absent.select("identity", (F.col("x") * 2).alias("y"))

    def ask(*rows):
        table = spark.createDataFrame(list(rows), "identity string, x int")
        return sorted((r["identity"], r["x"], r["y"]) for r in folders.cached(table, root, compute).collect())

    assert ask(("aa1", 1), ("bb2", 2), ("aa1", 1)) == [("aa1", 1, 2), ("aa1", 1, 2), ("bb2", 2, 4)]
    assert ask(("aa1", 1), ("cc3", 3)) == [("aa1", 1, 2), ("cc3", 3, 6)]
    assert ask(("aa1", 1), ("bb2", 2)) == [("aa1", 1, 2), ("bb2", 2, 4)]
    assert asked == [["aa1", "bb2"], ["cc3"], []] and sorted(os.listdir(root))[-3:] == ["shard=aa", "shard=bb", "shard=cc"]
    spark.read.parquet(root).where("identity = 'aa1'").write.mode("append").partitionBy("shard").parquet(str(tmp_path / "twice"))
    spark.read.parquet(str(tmp_path / "twice")).write.mode("append").partitionBy("shard").parquet(root)  # a second writer made it too
    assert ask(("aa1", 1)) == [("aa1", 1, 2)]
    with pytest.raises(ValueError, match="identity"):
        folders.cached(spark.createDataFrame([("q", 1)], "identity string, x int"), root, lambda d: d.select("x"))


def test_locks(spark, tmp_path):
    """A lock in use keeps others out, one of a lost driver does not for ever, and a failed write publishes nothing."""
    root, df = str(tmp_path / "t"), spark.range(3)
    assert publication.publish_version(df, root) == 1
    lock = tmp_path / "t" / "_lock"
    lock.write_text("another")
    for act in (lambda: publication.publish_version(df, root), lambda: publication.roll_back(spark, root)):
        with pytest.raises(FileExistsError):
            act()
    os.utime(lock, (time.time() - 100, time.time() - 100))
    (tmp_path / "t" / "v=2").mkdir()  # left by the lost driver
    assert publication.publish_version(df, root, lease=60_000) == 2 and not lock.exists()
    bad = df.select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        publication.publish_version(bad, root)
    assert publication.versions(spark, root) == [1, 2] and publication.current(spark, root).count() == 3
    assert not lock.exists() and not list((tmp_path / "t").glob("_writing*"))

    taken = df.mapInPandas(lambda batches: _steal(batches, str(lock)), "id long")
    with pytest.raises(FileExistsError, match="meanwhile"):
        publication.publish_version(taken, root)
    assert publication.versions(spark, root) == [1, 2] and lock.read_text() == "thief"


def _steal(batches, path):
    with open(path, "w") as f:
        f.write("thief")
    crc = os.path.join(os.path.dirname(path), "._lock.crc")
    if os.path.exists(crc):
        os.remove(crc)
    yield from batches


_steal.__module__ = "__main__"  # goes to the workers by value


def test_marked_groups(spark):
    words = spark.createDataFrame([(s, k, t, 0.0, 9.0, True, "x") for s in ("a", "b") for k, t in enumerate(["la", "", "sol!", "mi"])], "song string, no int, text string, start double, end double, confirmed boolean, origin string")
    marked = spark.createDataFrame([("a", k, 1.0, 2.0) for k in (0, 1, 2)] + [("b", k, 1.0, 2.0) for k in (0, 2)], "song string, no int, low double, high double")
    got = {(r["song"], r["no"]): (r["start"], r["end"], r["confirmed"], r["origin"], r["problem"]) for r in review.marked_group(words, marked, ["song"]).collect()}
    assert got["a", 0] == (1.0, 1.286, False, "manual_approximation", None) and got["a", 1] == (1.286, 1.429, False, "manual_approximation", None)
    assert got["a", 2] == (1.429, 2.0, False, "manual_approximation", None) and got["a", 3] == (0.0, 9.0, True, "x", None)
    assert got["b", 0] == got["b", 2] == (0.0, 9.0, True, "x", "not_consecutive") and got["b", 1][4] is None


def test_summary(spark):
    songs = spark.createDataFrame([("a",), ("b",)], "song_id string")
    pending = spark.createDataFrame([("a", 1), ("a", 2)], "song_id string, item int")
    blocks = spark.createDataFrame([("a", 1, [(True,), (False,), (None,)]), ("a", 2, None)], "song_id string, block int, words array<struct<confirmed:boolean>>")
    assert sorted(map(tuple, review.review_summary(songs, pending, blocks).collect())) == [("a", 2, 2, 1), ("b", 0, 0, 0)]
