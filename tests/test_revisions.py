"""Versions of review logs against copies of every state; slices of long keys against whole keys."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import intervals, review, revisions, slices

BLOCKS = "song_id string, block long, start_ms long, end_ms long, text string"
EVENTS = "song_id string, seq long, action string, item long, block long, start_ms long, end_ms long, text string"


def _plain(blocks, events):
    """(states before each event and after the last, problems): the whole state is copied for every event."""
    state, past, states, problems = (dict(blocks), {}), [], [], []
    for e in events:
        states.append(state)
        old, decided = state
        a, k = e["action"], e["block"]
        if a == "undo":
            if past:
                state = past.pop()
            else:
                problems.append((e["seq"], "nothing_to_undo"))
            continue
        rule = None
        if a not in revisions.ACTIONS:
            rule = "unknown_action"
        elif a in ("correct", "remove", "replace", "associate") and k not in old:
            rule = "unknown_block"
        new, taken = dict(old), dict(decided)
        if rule is None:
            if a == "correct":
                new[k] = {**old[k], "text": e["text"]}
            elif a in ("insert", "replace"):
                new[k] = {"start_ms": e["start_ms"], "end_ms": e["end_ms"], "text": e["text"]}
            elif a == "remove":
                del new[k]
            taken = {i: d if d["action"] != "associate" or d["block"] in new else {"action": "later", "block": None} for i, d in taken.items()}
            if e["item"] is not None:
                taken[e["item"]] = {"action": a, "block": k}
            spans = sorted((b["start_ms"], b["end_ms"]) for b in new.values())
            if any(x >= y for x, y in spans):
                rule = "end_not_after_start"
            elif any(p[1] > q[0] for p, q in zip(spans, spans[1:], strict=False)):
                rule = "overlap"
        if rule:
            problems.append((e["seq"], rule))
            continue
        past.append(state)
        state = new, taken
    return [*states, state], problems


def _log(seed, n):
    r = random.Random(seed)
    blocks = {k: {"start_ms": 1000 * k, "end_ms": 1000 * k + 900, "text": f"t{k}"} for k in range(1, 9)}
    if seed == 3:
        blocks[4]["end_ms"] = 5500  # wrong from the start: nothing can be applied until it is mended
    events = []
    for seq in range(1, n + 1):
        a = r.choice([*revisions.ACTIONS, "undo", "undo", "fly"])
        k = r.randrange(1, 12)
        start = 1000 * k + r.choice([0, 0, 50, -200])
        events.append({"seq": seq * 10, "action": a, "item": r.choice([None, *range(6)]), "block": k if a not in ("discard", "later") else None, "start_ms": start, "end_ms": start + r.choice([900, 800, 0, 1200]), "text": f"é{seq}"})
    return blocks, events


def test_versions_against_copies(spark):
    logs = {f"s{seed}": _log(seed, 120) for seed in range(5)} | {"empty": (_log(0, 1)[0], []), "bare": ({}, _log(1, 20)[1])}
    b = spark.createDataFrame([(s, k, v["start_ms"], v["end_ms"], v["text"]) for s, (blocks, _) in logs.items() for k, v in blocks.items()], BLOCKS)
    e = spark.createDataFrame([(s, x["seq"], x["action"], x["item"], x["block"], x["start_ms"], x["end_ms"], x["text"]) for s, (_, events) in logs.items() for x in events], EVENTS).orderBy(F.rand(1))
    changed = revisions.changes(b, e).cache()
    assert changed.count() < 3 * 700 + 60  # a few entries an event, no copies of states
    points = [(s, at) for s, (_, events) in logs.items() for at in [0, *(x["seq"] for x in events), 10**6]]
    got: dict = {}
    for r in revisions.state_before(changed, spark.createDataFrame(points, "song_id string, at long")).collect():
        got.setdefault((r["song_id"], r["at"]), {})[r["kind"], r["id"]] = json.loads(r["body"])
    told: dict = {}
    for r in review.fold(b, e).collect():
        told.setdefault(r["song_id"], {})[r["kind"], r["id"]] = json.loads(r["body"])
    rules = set()
    for s, (blocks, events) in logs.items():
        states, problems = _plain(blocks, events)
        flat = lambda state: {("block", k): v for k, v in state[0].items()} | {("decision", k): v for k, v in state[1].items()}
        for x, state in zip([*events, {"seq": 10**6}], states, strict=True):
            assert got.get((s, x["seq"]), {}) == flat(state), (s, x)
        assert got.get((s, 0), {}) == flat((blocks, {}))
        assert {k: v for k, v in told.get(s, {}).items() if k[0] != "problem"} == flat(states[-1])
        assert {(k[1], v["rule"]) for k, v in told.get(s, {}).items() if k[0] == "problem"} == set(problems)
        rules |= {x for _, x in problems}
    assert rules == {"nothing_to_undo", "unknown_action", "unknown_block", "end_not_after_start", "overlap"}


def test_songs_are_dealt_and_folded_in_passing(spark):
    """a task goes through the rows of its songs without a call for each; songs are dealt by number, and the fold shuffles no changes."""
    from tessitura.functions.shared import spread
    from tessitura.plans.catalog import QUERIES

    for name in ("review_fold", "versioned_review"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and f"{spread(spark)}), REPARTITION_BY_NUM" in plan
        if name == "review_fold":
            above = plan[: plan.index("MapInArrow")]
            assert "Exchange" not in above and "Aggregate" not in above


def test_songs_of_many_batches_and_without_a_side(spark):
    """Songs with blocks only, with a log only, without a name, and one longer than a batch."""
    b = spark.createDataFrame([("b", 1, 0, 9, "x"), (None, 1, 0, 9, None), ("long", 1, 0, 9, "x")], BLOCKS)
    events = [("e", 1, "insert", 5, 2, 0, 9, "é"), ("e", 2, "undo", None, None, None, None, None), ("e", 3, "undo", None, None, None, None, None), (None, 4, "remove", 7, 1, None, None, None)]
    events += [("long", k, "correct", k % 3, 1, None, None, f"t{k}") for k in range(25_000)]
    e = spark.createDataFrame(events, EVENTS)
    want = {(r["song_id"], r["kind"], r["id"], r["body"]) for r in revisions.latest(revisions.changes(b, e)).collect()}
    got = [tuple(r) for r in review.fold(b, e).collect()]
    assert set(got) == want and len(got) == len(want)
    assert ("long", "block", 1, '{"start_ms": 0, "end_ms": 9, "text": "t24999"}') in want and ("e", "problem", 3, '{"rule": "nothing_to_undo"}') in want
    assert (None, "decision", 7, '{"action": "remove", "block": 1}') in want and len([k for k in want if k[0] == "b"]) == 1


def test_a_log_is_held_in_proportion():
    """Ten thousand events on a thousand blocks, all undone: as fast as the log is long, and back where it began."""
    blocks = {k: {"start_ms": 10 * k, "end_ms": 10 * k + 9, "text": "x"} for k in range(1000)}
    session = revisions.Session(blocks)
    for n in range(10_000):
        assert session.apply({"action": "correct", "block": n * 7 % 1000, "item": n, "text": str(n)}) == ([("block", n * 7 % 1000), ("decision", n)], None)
    assert sum(map(len, session.history)) == 20_000
    for _ in range(10_000):
        session.apply({"action": "undo"})
    assert session.entries == {"block": blocks, "decision": {}} and not session.history


def test_archive(spark):
    """Only the newest epoch on the current sources is live; sources that come back do not bring decisions back."""
    events = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 2), ("b", 1, "x", 1), ("b", 2, "y", 2), ("c", 1, "x", 1)], "song_id string, epoch long, sources string, seq long")
    current = spark.createDataFrame([("a", "y"), ("b", "x"), ("d", "z")], "song_id string, sources string")
    live, gone = revisions.archive(events, current)
    assert [(r["song_id"], r["epoch"]) for r in live.collect()] == [("a", 2)]
    assert sorted((r["song_id"], r["epoch"]) for r in gone.collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 1)]
    assert live.columns == events.columns == gone.columns
    got = {r["song_id"]: (r["epoch"], r["sources"], r["archived"]) for r in revisions.next_epochs(events, current).collect()}
    assert got == {"a": (2, "y", 1), "b": (3, "x", 2), "d": (1, "z", 0)}


@pytest.mark.parametrize(("width", "seed"), [(0.05, 1), (0.2, 2), (1.0, 3), (100.0, 4), (0.01, 5)])
def test_slices_are_the_whole(spark, width, seed):
    r = random.Random(seed)
    rows = []
    for song in "abcd":
        for part in range(3):
            t, kind = r.randrange(0, 30), 0
            for _ in range(r.randrange(1, 150)):
                if r.random() < 0.07:
                    kind = r.randrange(3)
                rows.append((song, part, (t := t + r.choice([1, 1, 1, 40])) / 100, kind == 2, kind == 0, r.choice(["x", "y", None]) if seed == 3 else ["x", "y", None][kind]))
    df = spark.createDataFrame(rows, "song string, part int, t double, silent boolean, fits boolean, flag string").repartition(3)
    key = ["song", "part"]
    want = {(x["song"], x["part"], x["t"]): x["run"] for x in intervals.runs(df, key, ["t"], F.col("flag"), "run").collect()}
    got = slices.sliced_runs(df, key, "t", ["t"], F.col("flag"), width)
    assert got.columns == [*df.columns, "run"] and {(x["song"], x["part"], x["t"]): x["run"] for x in got.collect()} == want
    stops = lambda found: {(x["song"], x["part"]): (x["stop_at"], x["last_good"], x["coverage"], x["accepted"]) for x in found.collect()}
    a, b = stops(intervals.confirmed_stop(df, key, "t", "silent", "fits", 0.01)), stops(slices.sliced_stop(df, key, "t", "silent", "fits", 0.01, width))
    assert set(a) == set(b)
    for k in a:
        assert b[k][3] == a[k][3] and all(x == y or math.isclose(x, y) for x, y in zip(a[k][:3], b[k][:3], strict=True)), (k, a[k], b[k])


def test_one_key_is_in_many_tasks(spark):
    """Window partitions of the plan are slices, not keys."""
    df = spark.range(1000).select(F.lit("k").alias("key"), (F.col("id") / 10).alias("t"), (F.col("id") % 7 < 3).alias("flag"))
    got = slices.sliced_runs(df, ["key"], "t", ["t"], F.col("flag"), 5.0)
    whole = intervals.runs(df, ["key"], ["t"], F.col("flag"), "run")
    assert got.select("t", "run").exceptAll(whole.select("t", "run")).count() == 0 and got.count() == 1000
    spread = slices._local_runs(slices._sliced(df, ["key"], "t", 5.0), ["key"], ["t"], F.col("flag"), "_r")
    assert spread.select("_slice").distinct().count() == 20 and spread.groupBy("_slice").count().agg(F.max("count")).head()[0] == 50
