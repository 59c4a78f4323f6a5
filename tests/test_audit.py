"""Checks of reviewed blocks and of syllables, and the last check of captions, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import audit, captioning, intervals

BLOCKS = "song_id string, block long, start double, end double, text string, words array<struct<text:string,start:double,end:double,confirmed:boolean>>"


def _blocks(seed):
    r = random.Random(seed)
    rows, at = [], 0.0
    for k in range(30):
        start = at + r.choice([0.0, 0.5, -0.2, 0.0000001])
        end = start + r.choice([1.0, 2.0, 0.0, -1.0]) if r.random() < 0.9 else r.choice([None, math.inf, math.nan])
        text = r.choice(["bom dia", "Bom Dia meu amor", "", "...", "é"])
        spelled = text.replace(".", "").split()
        words = None
        if r.random() < 0.8:
            words, t = [], start
            for w in spelled if r.random() < 0.9 else ["x"]:
                a = t + r.choice([0.0, 0.1, -0.1])
                t = a + r.choice([0.3, 0.5, 1.0, 0.0])
                ok = r.choice([True, True, False, None])
                words.append((w.upper() if r.random() < 0.3 else w, a if r.random() < 0.95 else r.choice([None, math.nan]), t, ok))
        rows.append(("s", k if r.random() < 0.9 else max(0, k - 1), start, end, text, words))
        at = end if end is not None and math.isfinite(end) else start + 1
    return rows


def _judge(rows, duration):
    out = set()
    key = lambda t: "".join(c for c in t.lower().replace("é", "e") if c.isalnum())
    real = lambda *xs: all(x is not None and math.isfinite(x) for x in xs)
    order = sorted(rows, key=lambda b: (b[2], b[3] is not None, math.inf if b[3] is not None and math.isnan(b[3]) else 0, b[3] or 0, b[1]))
    for k, (_, block, a, z, text, words) in enumerate(order):
        rules = []
        if sum(x[1] == block for x in rows) > 1:
            rules.append("repeated")
        if not real(a, z) or not 0 <= a < z <= duration + 0.001:
            rules.append("invalid_times")
        own = [w for w in text.replace(".", "").split()]
        if not own:
            rules.append("no_words")
        if k and order[k - 1][3] is not None and a < order[k - 1][3] - 1e-5:
            rules.append("overlap")
        if words and [key(w[0]) for w in words] != [key(w) for w in own]:
            rules.append("other_words")
        if real(z):
            ended, last, bad, tight = a, -1, False, False
            for i, (_, x, y, ok) in enumerate(words or []):
                if not ok:
                    continue
                bad |= not real(x, y) or not a <= x < y <= z
                if real(x, y, ended):
                    tight |= x < ended or (i > last + 1 and x <= ended)
                ended, last = y, i
            if last >= 0 and last < len(words) - 1 and real(ended) and ended >= z:
                tight = True
            if bad:
                rules.append("confirmed_times")
            elif tight:
                rules.append("no_room")
        out |= {(block, x) for x in rules}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_blocks(spark, seed):
    rows = _blocks(seed)
    got = {(r["block"], r["rule"]) for r in audit.block_violations(spark.createDataFrame(rows, BLOCKS), F.lit(20.0)).collect()}
    want = _judge(rows, 20.0)
    endless = {b[1] for b in rows if b[3] is None or not math.isfinite(b[3])}  # whose words cannot be judged
    drop = lambda found: {(b, x) for b, x in found if b not in endless or x not in ("confirmed_times", "no_room")}
    assert drop(got) == drop(want) and {x for _, x in want} >= {"invalid_times", "no_words", "overlap", "other_words"}


def test_sound_blocks(spark):
    rows = [("s", 1, 0.0, 2.0, "Bom dia", [("bom", 0.0, 1.0, True), ("DIA", 1.0, 2.0, True)]), ("s", 2, 2.0, 3.0, "é", None), ("t", 1, 0.0, 1.0, "a b c", [("a", 0.0, 0.4, True), ("b", None, None, False), ("c", 0.5, 1.0, True)])]
    assert audit.block_violations(spark.createDataFrame(rows, BLOCKS), F.lit(3.0)).count() == 0
    no_room = [("s", 1, 0.0, 1.0, "a b c", [("a", 0.0, 0.5, True), ("b", None, None, False), ("c", 0.5, 0.9, True)]), ("s", 2, 1.0, 2.0, "a b", [("a", 1.0, 2.0, True), ("b", None, None, None)])]
    assert [r["rule"] for r in audit.block_violations(spark.createDataFrame(no_room, BLOCKS), F.lit(3.0)).collect()] == ["no_room"] * 2


def test_units(spark):
    nan = math.nan
    rows = [("s", "a", 1, 0.0, 1.0, 0.2, 0.8), ("s", "b", 2, 1.0, 2.0, 1.0, 2.0), ("s", "c", 3, 1.9, 3.0, 2.0, 2.5), ("s", "d", 4, 3.0, 3.0, 3.0, 3.0), ("s", "e", 5, 3.0, None, 3.0, 3.1), ("s", "f", 6, 4.0, 5.0, nan, 4.5), ("s", "g", 7, 5.0, 6.0, 4.9, 5.5), ("s", "g", 8, 6.0, 9.5, 6.0, 9.0)]
    df = spark.createDataFrame(rows, "song_id string, id string, ord int, start double, end double, core_start double, core_end double")
    got = sorted((r["id"], r["rule"]) for r in audit.unit_violations(df, F.lit(9.0)).collect())
    assert got == [("c", "overlap"), ("d", "invalid_times"), ("e", "absent_times"), ("f", "absent_times"), ("g", "invalid_times"), ("g", "outside"), ("g", "repeated"), ("g", "repeated")]
    assert ("g", "outside") not in {(r["id"], r["rule"]) for r in audit.unit_violations(df).collect()}


def _captions(spark, segments, duration=10.0, slack=0.1):
    rows = [("s", k, 0, w, a, b, 0.9, a, b, w) for k, (w, a, b) in enumerate(segments)]
    df = spark.createDataFrame(rows, "song_id string, seg int, no int, word string, start double, end double, score double, seg_start double, seg_end double, seg_text string")
    return captioning.capped_groups(df, duration, slack=slack)


def test_captions_that_overlap_too_much(spark):
    """A short overlap between sure words stays and is told; so is a long one, and times outside the song."""
    found = [(r["text"], r["refused"]) for r in _captions(spark, [("a", 0.0, 1.3), ("b", 1.0, 2.0), ("c", 1.95, 3.0), ("d", 3.0, 4.0)]).orderBy("seg").collect()]
    assert found == [("a", None), ("b", "overlap"), ("c", "overlap"), ("d", None)]
    late = _captions(spark, [("a", 0.0, 1.0), ("b", 9.0, 11.0)])
    assert [r["refused"] for r in late.orderBy("seg").collect()] == [None, "invalid_times"]
    with pytest.raises(Exception, match="invalid_times in segment 1"):
        captioning.valid_captions(late).collect()
    assert captioning.valid_captions(_captions(spark, [("a", 0.0, 1.0), ("b", 1.0, 2.0)])).count() == 2


def test_weak_words(spark):
    df = spark.createDataFrame([("s", 0, 0, "a", 0.1), ("s", 0, 1, "b", 0.3), ("s", 0, 2, "c", None)], "song_id string, seg int, no int, word string, score double")
    assert [r["word"] for r in captioning.weak_words(df).collect()] == ["a"]


@pytest.mark.parametrize("closed", [False, True])
def test_points_in_any_interval(spark, closed):
    """Infinite, huge, empty and unknown bounds, and points anywhere."""
    inf, nan = math.inf, math.nan
    bounds = [(0.0, 1.0), (0.5, inf), (-inf, 0.5), (-inf, inf), (0.0, 1e300), (-1e18, 1e18), (3.0, 3.0), (5.0, 4.0), (nan, 1.0), (0.0, nan), (None, 1.0), (0.0, None), (1e15, 1e15 + 8)]
    places = [-1e300, -1e18, -1.0, 0.0, 0.5, 1.0, 3.0, 4.5, 1e15, 1e15 + 4, 1e300, inf, -inf, nan, None]
    p = spark.createDataFrame([("k", i, t) for i, t in enumerate(places)], "key string, i int, t double")
    v = spark.createDataFrame([("k", j, a, b) for j, (a, b) in enumerate(bounds)], "key string, j int, a double, b double")
    got = sorted((r["i"], r["j"]) for r in intervals.points_in_intervals(p, v, ["key"], "t", "a", "b", 0.25, closed).collect())
    real = lambda x: x is not None and not math.isnan(x)
    want = [(i, j) for i, t in enumerate(places) for j, (a, b) in enumerate(bounds) if real(t) and real(a) and real(b) and a <= t and (t <= b if closed else t < b)]
    assert got == sorted(want)
    assert intervals.points_in_intervals(p, v.limit(0), ["key"], "t", "a", "b", 0.25).count() == 0


def test_conflicts_by_their_definition(spark):
    r = random.Random(3)
    rows = [(i, float(a := r.randrange(20)), float(a + r.choice([0, 0, 1, 3, -1]))) for i in range(80)]
    taken = [(float(a := r.randrange(20)), float(a + r.choice([1, 2, 4]))) for _ in range(6)]
    df = spark.createDataFrame([("k", *x) for x in rows], "key string, i int, start double, end double")
    o = spark.createDataFrame([("k", *x) for x in taken], "key string, start double, end double")
    got = {x["i"] for x in intervals.conflict_free(df, o, ["key"], "start", "end").collect()}
    assert got == {i for i, a, b in rows if not any(a < z and b > s for s, z in taken)}
