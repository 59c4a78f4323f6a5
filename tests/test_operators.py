import random

import numpy as np
from pyspark.sql import functions as F

from tessitura.operators import audit, intervals, review, sequence, series


def test_points_in_intervals(spark):
    r = random.Random(3)
    points = [(k, float(r.randrange(200)) / 2) for k in range(3) for _ in range(60)]
    spans = [(k, i, float(a := r.randrange(90)), float(a + r.randrange(1, 25))) for k in range(3) for i in range(12)]
    p, s = spark.createDataFrame(points, "k int, t double"), spark.createDataFrame(spans, "k int, i int, a double, b double")
    for closed in (False, True):
        got = sorted(tuple(x) for x in intervals.points_in_intervals(p, s, ["k"], "t", "a", "b", 7.0, closed).select("k", "t", "i").collect())
        want = sorted((k, t, i) for k, t in points for k2, i, a, b in spans if k == k2 and (a <= t <= b if closed else a <= t < b))
        assert got == want


def test_weighted_median_and_plateau(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, 0), (1, 2.0, 1.0, 1), (1, 9.0, 2.0, 2), (2, 5.0, 0.0, 3), (2, 7.0, 0.0, 4)], "k int, v double, w double, i int")
    got = {r["k"]: r["centre"] for r in series.weighted_median(rows, ["k"], "v", "w", ["i"]).collect()}
    assert got == {1: 2.0, 2: 6.0}
    units = spark.createDataFrame([(u, p + d, 1.0, i) for u, p in ((0, 60.0), (1, 64.0)) for i, d in enumerate([0.0, 0.01, 0.02, 3.0])], "k int, v double, w double, i int")
    got = {r["k"]: r["centre"] for r in series.plateau_centre(units, ["k"], "v", "w", ["i"]).collect()}
    assert got == {0: 60.01, 1: 64.01}


def test_difficulty(spark):
    def of(notes):
        return series.difficulty(spark.createDataFrame([(1, float(p), s, e) for p, s, e in notes], "k int, p double, s double, e double"), ["k"], "p", "s", "e").head()

    for pitch, score, band in ((60, 0.0, "beginner"), (72, 0.425, "intermediate"), (84, 0.85, "advanced")):
        r = of([(pitch, 0.0, 1.0)])
        assert abs(r["score"] - score) < 1e-9 and r["band"] == band
    assert of([(60, i * 1.0, i + 0.5) for i in range(50)] + [(84, 99.0, 99.05)])["band"] == "advanced"
    assert abs(of([(p, 0.0, 1.0) for p in range(61, 73)])["score"] - of([(72, 0.0, 1.0)])["score"] - 0.15) < 1e-9
    assert of([(128, 0.0, 1.0)])["band"] is None and of([(60, 1.0, 1.0)])["band"] is None


def test_redistribute_conserves_time(spark):
    rows = [(1, i, 0.0 if i == 0 else [0.0, 0.02, 0.32][i], [0.02, 0.32, 0.40][i]) for i in range(3)]
    got = intervals.redistribute(spark.createDataFrame(rows, "k int, i int, s double, e double"), ["k"], ["i"], "s", "e").orderBy("i").collect()
    ends = [r["new_end"] for r in got]
    assert np.allclose(ends, [0.10, 0.30, 0.40]) and np.allclose([r["new_start"] for r in got], [0.0, 0.10, 0.30])


def test_confirmed_stop(spark):
    frames = [(1, i / 100, 30 <= i < 45, i < 30) for i in range(60)]
    r = intervals.confirmed_stop(spark.createDataFrame(frames, "k int, t double, silent boolean, fits boolean"), ["k"], "t", "silent", "fits", 0.01).head()
    assert abs(r["stop_at"] - 0.41) < 1e-9 and abs(r["last_good"] - 0.29) < 1e-9 and r["coverage"] == 1.0 and r["accepted"]


def test_bridge_and_smooth(spark):
    rows = spark.createDataFrame([(1, i, i not in (0, 4, 5, 9), True) for i in range(10)], "k int, i int, f boolean, e boolean")
    got = [r["b"] for r in intervals.bridge(rows, ["k"], ["i"], "f", "e", 3, "b").orderBy("i").collect()]
    assert got == [False] + [True] * 8 + [False]
    values = [5.0, 1.0, 9.0, 2.0, 2.0, 8.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    got = [r["smooth"] for r in series.smooth(df, ["k"], ["i"], "v", 3).orderBy("i").collect()]
    padded = [values[0], *values, values[-1]]
    assert got == [float(np.median(padded[i : i + 3])) for i in range(6)]


def test_resample(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 3.0, 30.0)], "k int, t double, v double")
    g = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 0.5, 2.0, 3.0, 4.0)], "k int, t double")
    assert [r["v"] for r in series.resample(s, g, ["k"], "t", "v").orderBy("t").collect()] == [0.0, 0.0, 5.0, 20.0, 30.0, 0.0]


def test_gap_plan(spark):
    rows = [(1, 1, 0.0, 2.0, 2, 6, 0.9, 4), (1, 2, 5.0, 5.5, None, None, None, 1), (1, 3, 9.0, 11.0, 10, 12, 0.9, 2)]
    df = spark.createDataFrame(rows, "k int, ord int, start double, end double, token_start int, token_end int, score double, n_words int")
    got = [(r["token_from"], r["token_to"], r["gap_start"], r["gap_end"], r["reason"]) for r in intervals.plan_gaps(df, ["k"], F.lit(15), F.lit(20.0)).orderBy("token_from").collect()]
    assert got == [(0, 2, 0.0, 0.0, "no_time_between_captions"), (6, 10, 2.0, 9.0, None), (12, 15, 11.0, 20.0, None)]


def test_note_continuity(spark):
    from pyspark.sql import Row

    cands = lambda *x: [Row(pitch=p, score=s) for p, s in x]
    units = [("s", 1, 0.0, 1.0, cands((60, 0.5))), ("s", 2, 1.0, 2.0, cands((60, 0.50), (72, 0.51))), ("s", 3, 9.0, 10.0, cands((60, 0.5), (61, 0.5)))]
    df = spark.createDataFrame(units, "song_id string, unit long, start double, end double, cands array<struct<pitch:int,score:double>>")
    assert [r["pitch"] for r in sequence.note_continuity(df).orderBy("unit").collect()] == [60, 60, 60]


def test_review_undo():
    blocks = {1: {"start_ms": 0, "end_ms": 900, "text": "a"}, 2: {"start_ms": 1000, "end_ms": 1900, "text": "b"}}
    log = [{"action": "associate", "item": 7, "block": 1}, {"action": "remove", "item": 8, "block": 1}, {"action": "undo"}, {"action": "insert", "item": 9, "block": 3, "start_ms": 500, "end_ms": 1500, "text": "x"}]
    after, decided, problems = review.apply_events(blocks, {}, log)
    assert after == blocks and decided == {7: {"action": "associate", "block": 1}} and problems == [(3, "overlap")]
    after, decided, problems = review.apply_events(blocks, {}, log[:2])
    assert 1 not in after and decided[7]["action"] == "later" and not problems
    odd = [{"action": "undo"}, {"action": "sing"}, {"action": "remove", "block": 9}, {"action": "replace", "block": 1, "start_ms": 5, "end_ms": 5, "text": ""}]
    assert [x for _, x in review.apply_events(blocks, {}, odd)[2]] == ["nothing_to_undo", "unknown_action", "unknown_block", "end_not_after_start"]


def test_split_and_proposals(spark):
    blocks = spark.createDataFrame([("s", 1, 0, 2000, "a b c")], "song_id string, block long, start_ms long, end_ms long, text string")
    splits = spark.createDataFrame([("s", 1, 5, 1, 2, 900, 1), ("s", 2, 5, 1, 3, 900, 0)], "song_id string, seq long, item long, block long, new_block long, at_ms long, word int")
    events = review.split_events(blocks, splits)
    state = {r["id"]: r["body"] for r in review.fold(blocks, events).where("kind = 'block'").collect()}
    assert '"end_ms": 900, "text": "a"' in state[1] and '"start_ms": 900, "end_ms": 2000, "text": "b c"' in state[2] and events.count() == 2
    texts = spark.createDataFrame([("s", "Bom dia amor")], "song_id string, text string")
    found = spark.createDataFrame([("s", 0, "bom", "bom", 0.1, 0.4004, 0.9), ("s", 1, "amor", "amor", 1.0, 2.0, None)], "song_id string, no long, text string, key string, start double, end double, score double")
    windows = spark.createDataFrame([("s", 0.0, 3.0)], "song_id string, low double, high double")
    got = [(r["text"], r["start"], r["end"], r["origin"], r["confirmed"]) for r in review.proposed_times(texts, found, windows, ["song_id"]).orderBy("no").collect()]
    assert got == [("Bom", 0.1, 0.4, "aligner", False), ("dia", None, None, None, False), ("amor", 1.0, 2.0, "aligner", False)]
    p = spark.createDataFrame([("s", 9, 16)], "song_id string, item int, original int")
    done = spark.createDataFrame([("s", 15, 1.0, "x"), ("s", 16, 2.0, "y")], "song_id string, original int, start double, text string")
    assert [(r["place"], r["published_text"]) for r in review.pending_published(p, done).collect()] == [(1, "y")]


def test_export_and_versions(spark, tmp_path):
    from tessitura.sources import publication as P

    units = [("s", k, k, f"w{k}", 1, t) for k, t in enumerate(["a", "mor", "é"], 1)]
    times = [(0.0, 0.5, 60), (0.5, 1.25, 64), (2.0, 200.0, 84)]
    u = spark.createDataFrame(units, "song_id string, unit int, ord int, word_id string, block int, text string")
    n = spark.createDataFrame([(*a, *b) for a, b in zip(units, times)], "song_id string, unit int, ord int, word_id string, block int, text string, start double, end double, pitch int")
    out = P.export(u, n)
    assert out["problems"].count() == 0
    data = bytes(out["files"].head()["content"])
    assert data[:14] == b"MThd\0\0\0\6\0\0\0\1\x07\x80" and data.endswith(b"\xff\x2f\0") and "é".encode() in data
    got = [(r["tick_on"] / 3840, r["tick_off"] / 3840, r["pitch"]) for r in P.read_notes(out["files"]).orderBy("no").collect()]
    assert got == times
    assert out["captions"].head()["content"].startswith("1\n00:00:00,000 --> 00:00:00,500\na\n\n2\n")
    assert '"difficulty":"advanced"' in out["metadata"].head()["content"] and '"lyricsOffset":0' in out["metadata"].head()["content"]
    moved = n.withColumn("pitch", F.when(F.col("unit") == 2, 65).otherwise(F.col("pitch")))
    assert [(r["no"], r["rule"]) for r in P.reread_problems(moved, out["files"]).collect()] == [(2, "differs")]
    assert sorted((r["part"], r["rule"]) for r in P.export(u, n.where("unit < 3"))["problems"].collect()) == [("3", "missing")]
    root = f"file://{tmp_path}/t"
    assert P.publish_version(u, root) == 1 and P.publish_version(u.where("unit = 1"), root) == 2 and P.versions(spark, root) == [1, 2]
    assert P.current(spark, root).count() == 1 and P.roll_back(spark, root) == 1 and P.current(spark, root).count() == 3
    (tmp_path / "t" / "_lock").touch()
    try:
        P.publish_version(u, root)
        raise AssertionError("a locked table was published")
    except FileExistsError:
        pass
    m = P.manifest(out["captions"], n.select("song_id", "block", F.col("unit").alias("no"), "text", "start", "end", F.lit(True).alias("confirmed")), spark.createDataFrame([("s", "srt", "x")], "song_id string, name string, sha256 string"), u.limit(0)).head()
    assert m["pending"] == 0 and m["sources"] == {"srt": "x"} and len(m["blocks"]) == 3


def test_audit(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    a = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    assert sorted(tuple(r) for r in audit.coverage(e, a, ["k"], ["v"]).collect()) == [(1, "missing"), (2, "differs"), (4, "extra")]
    parts = spark.createDataFrame([(1, 2, "mor"), (1, 1, "a"), (2, 1, "x")], "k int, n int, p string")
    words = spark.createDataFrame([(1, "amor"), (2, "y")], "k int, t string")
    assert [r["k"] for r in audit.recomposed(words, parts, ["k"], "t", "p", "n").collect()] == [2]


def test_conflict_free_and_overlapping(spark):
    r = random.Random(6)
    rows = [(k, i, a := r.randrange(60), a + r.randrange(1, 6)) for k in range(3) for i in range(30)]
    busy = [(k, a := r.randrange(60), a + r.randrange(1, 9)) for k in range(2) for _ in range(6)]
    d, o = spark.createDataFrame(rows, "k int, i int, a int, b int"), spark.createDataFrame(busy, "k int, a int, b int")
    free = sorted((k, i) for k, i, a, b in rows if not any(k == q and a < y and b > x for q, x, y in busy))
    assert sorted((x["k"], x["i"]) for x in intervals.conflict_free(d, o, ["k"], "a", "b").collect()) == free
    got = {(x["k"], x["i"]): x["overlaps"] for x in intervals.overlapping(d, o, ["k"], "a", "b").collect()}
    assert {x for x, hit in got.items() if not hit} == set(free) and len(got) == len(rows)
    assert intervals.conflict_free(d, o.limit(0), ["k"], "a", "b").count() == len(rows)


def test_a_long_interval_touches_few_buckets(spark):
    p = spark.createDataFrame([(1, float(t)) for t in range(0, 1000, 7)], "k int, t double")
    s = spark.createDataFrame([(1, 1, 3.0, 900_000_000.0), (1, 2, 5.0, 5.5), (1, 3, 14.0, 14.25)], "k int, i int, a double, b double")
    got = intervals.points_in_intervals(p, s, ["k"], "t", "a", "b", 0.25)
    assert sorted((x["i"], x["t"]) for x in got.collect()) == sorted([(1, float(t)) for t in range(7, 1000, 7)] + [(3, 14.0)])
