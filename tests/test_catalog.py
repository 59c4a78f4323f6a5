"""Every registered query is held against DuckDB, or against brute force where SQL cannot express it, on the smallest tables."""

import glob
import json
import os
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex

from tessitura.functions.text import indel
from tessitura.operators import review
from tessitura.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations embeddings events lineitem orders part customer supplier nation region".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _normal(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind in "fiu" or str(df[k].dtype).startswith(("Int", "Float")):
            df[k] = pd.to_numeric(df[k]).astype("float64").round(6) + 0.0
        df[k] = df[k].astype(str).replace({"<NA>": "nan", "None": "nan", "NaN": "nan"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, duck, name):
    own = _normal(catalog.QUERIES[name](spark, SF).toPandas())
    other = _normal(duck.execute(catalog.ORACLE_SQL[name]).fetch_df())
    pd.testing.assert_frame_equal(own, other)


# --- queries beyond SQL, against brute force on their own columns


def _texts(table, key):
    t = pd.read_parquet(f"{SF}/{table}.parquet")
    word = regex.compile(r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*")
    return {k: word.findall(x) for k, x in zip(t[key], t["text"], strict=True)}


def _key(w):
    flat = "".join(c for c in unicodedata.normalize("NFD", w.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    return "".join(c for c in flat if c.isalnum())


def test_global_alignment(spark):
    got: dict = {}
    for r in catalog.QUERIES["global_alignment"](spark, SF).collect():
        got.setdefault(r["song_id"], []).append(r)
    for item, words in _texts("benchmark", "item_id").items():
        steps = sorted(got[str(item)], key=lambda r: r["step"])
        source = [(p, w) for p, w in enumerate(words) if p % 7 != 3]
        assert [r["source_pos"] for r in steps if r["source_pos"] is not None] == [p for p, _ in source]
        assert [r["target_pos"] for r in steps if r["target_pos"] is not None] == list(range(len(words)))
        a, b = [_key(w) for _, w in source], [_key(w) for w in words]
        cost = np.add.outer(np.arange(len(a) + 1.0), np.arange(len(b) + 1.0))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                sub = 0 if a[i - 1] == b[j - 1] else 1.5 - indel(a[i - 1], b[j - 1]) / 2
                cost[i, j] = min(cost[i - 1, j - 1] + sub, cost[i - 1, j] + 1, cost[i, j - 1] + 1)
        own = sum(1 if r["source_pos"] is None or r["target_pos"] is None else 0 if _key(words[r["source_pos"]]) == b[r["target_pos"]] else 1.5 - indel(_key(words[r["source_pos"]]), b[r["target_pos"]]) / 2 for r in steps)
        assert abs(own - cost[-1, -1]) < 1e-6
        for r in steps:
            if r["source_pos"] is not None and r["target_pos"] is not None:
                x, y = words[r["source_pos"]], words[r["target_pos"]]
                assert r["kind"] == ("equal" if x == y else "spelling" if _key(x) == _key(y) else "replaced")


def test_structure_plan(spark):
    items = {str(k): [_key(w) for w in ws] for k, ws in _texts("benchmark", "item_id").items()}
    rows = catalog.QUERIES["structure_plan"](spark, SF).collect()
    found = [r for r in rows if r["token_start"] is not None]
    assert len({(r["song_id"], r["idx"]) for r in rows}) == len(rows) and len(found) > 0.5 * len(rows)
    t = pd.read_parquet(f"{SF}/benchmark.parquet")
    word = regex.compile(r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*")
    for item, text in zip(t["item_id"].astype(str), t["text"], strict=True):
        lines = [[_key(w) for w in word.findall(x)] for x in regex.split("[.\n]", text)]
        for r in (r for r in rows if r["song_id"] == item):
            own = lines[r["idx"]]
            if r["token_start"] is None:
                assert r["warning"] == "not_in_lyric" if not own else r["warning"] in ("ambiguous", "not_in_lyric")
                continue
            span = items[item][r["token_start"] : r["token_end"]]
            assert abs(indel(" ".join(own), " ".join(span)) - r["score"]) < 1e-9
            # Every line stands in its item as it is, so nothing but an equal span can be best.
            assert span == own and r["warning"] is None


def test_time_choice_beam(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    ms = (e["ts"] - pd.Timestamp("2024-01-01")) // pd.Timedelta(milliseconds=1)
    e = e.assign(ms=ms, end=(ms + 1 + np.floor(e["value"].abs() * 1000)).astype("int64") + 40_000_000, score=np.floor(e["value"] * 10) / 1024).sort_values(["user_id", "ms", "event_id"])
    got: dict = {}
    for r in catalog.QUERIES["time_choice_beam"](spark, SF).collect():
        got.setdefault(int(r["song_id"]), {})[r["word"]] = (r["start"], r["end"])
    for user, g in e.groupby("user_id"):
        words: dict = {}
        for n, (a, b, s) in enumerate(zip(g["ms"], g["end"], g["score"], strict=True), 1):
            words.setdefault(n // 3, []).append((a, b, s))
        states = {0: (0, 0.0)}  # every end that can be reached, without a beam
        for k in sorted(words):
            new = dict(states)
            for at, (n, s) in states.items():
                for a, b, x in words[k]:
                    if a >= at:
                        new[b] = max(new.get(b, (-1, 0.0)), (n + 1, s + x))
            states = new
        assert set(got[user]) == set(words)
        score, last, n = 0.0, 0, 0
        for k in sorted(words):
            a, b = got[user][k]
            if a is not None:
                a, b = round(a * 1000), round(b * 1000)
                assert a >= last
                last, n = b, n + 1
                score += max(x for p, q, x in words[k] if (p, q) == (a, b))
        best = max(states.values())
        assert n == best[0] and abs(score - best[1]) < 1e-9


def test_ngram_candidates(spark):
    c = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    got: dict = {}
    for r in catalog.QUERIES["ngram_candidates"](spark, SF).collect():
        got.setdefault((r["conv_id"], r["item"]), {})[r["rank"]] = (r["ord"], r["n"], r["score"])
    for conv, g in c.groupby("conv_id"):
        turns, texts = g["turn"].tolist(), g["text"].str.lower().tolist()
        for item, text in zip(turns, texts, strict=True):
            scored = sorted((-indel(text, " ".join(texts[i : i + n])), turns[i], n) for i in range(len(turns)) for n in (1, 2, 3) if i + n <= len(turns))[:12]
            own = [x for _, x in sorted(got[conv, item].items())]
            assert [x[:2] for x in own] == [(o, n) for _, o, n in scored] and all(abs(x[2] + s) < 2e-6 for x, (s, _, _) in zip(own, scored, strict=True))


def test_review_fold(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    e = e.assign(ms=(e["ts"] - pd.Timestamp("2024-01-01")) // pd.Timedelta(milliseconds=1)).sort_values(["user_id", "ms", "event_id"])
    got: dict = {}
    for r in catalog.QUERIES["review_fold"](spark, SF).collect():
        got.setdefault(r["song_id"], {})[r["kind"], r["id"]] = json.loads(r["body"])
    for user, g in e.groupby("user_id"):
        rows = list(zip(g["event_id"], g["event_type"], strict=True))
        state, past = ({k: (k * 1000, k * 1000 + 900, t) for k, (_, t) in enumerate(rows[:20], 1)}, {}), []
        wrong = set()
        for n, (k, t) in enumerate(rows[20:], 21):
            blocks, decided = state
            block = k % 20 + 1
            if t == "error":
                if past:
                    state = past.pop()
                else:
                    wrong.add(n)
                continue
            if block not in blocks:
                wrong.add(n)
                continue
            past.append(state)
            action = {"purchase": "remove", "click": "replace"}.get(t, "correct")
            new = {b: v for b, v in blocks.items() if b != block or action != "remove"}
            if action != "remove":
                new[block] = (block * 1000, block * 1000 + 800, "new") if action == "replace" else (*blocks[block][:2], "new")
            state = new, decided | {n: action}
        own = got[str(user)]
        assert {b: (v["start_ms"], v["end_ms"], v["text"]) for (kind, b), v in own.items() if kind == "block"} == state[0]
        assert {b: v["action"] for (kind, b), v in own.items() if kind == "decision"} == state[1]
        assert {b for kind, b in own if kind == "problem"} == wrong


def test_versioned_review(spark):
    """The state before every tenth event is what the log up to it gives."""
    blocks, log = (df.collect() for df in catalog.review_log(spark, SF))
    got: dict = {}
    for r in catalog.QUERIES["versioned_review"](spark, SF).collect():
        got.setdefault((r["song_id"], r["at"]), {})[r["kind"], r["id"]] = json.loads(r["body"])
    asked = 0
    for song in sorted({r["song_id"] for r in log}):
        first = {r["block"]: {"start_ms": r["start_ms"], "end_ms": r["end_ms"], "text": r["text"]} for r in blocks if r["song_id"] == song}
        events = sorted((r.asDict() for r in log if r["song_id"] == song), key=lambda e: e["seq"])
        for k, e in enumerate(events):
            if e["seq"] % 10 == 0:
                after, decided, _ = review.apply_events(dict(first), {}, events[:k])
                assert got.get((song, e["seq"]), {}) == {("block", b): v for b, v in after.items()} | {("decision", i): v for i, v in decided.items()}
                asked += 1
    assert asked > 20


def test_every_query_has_sql_or_a_test():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"global_alignment", "structure_plan", "time_choice_beam", "ngram_candidates", "review_fold", "embedding_frames", "versioned_review"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_read_alignments_writes_little(spark):
    """the names of fields that JSON repeats for each unit are compressed; every unit is written and read."""
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(glob.glob(f"{root}/alignments-*"))
    n = catalog.QUERIES["read_alignments"](spark, SF).count()
    (folder,) = set(glob.glob(f"{root}/alignments-*")) - before
    assert n == len(pd.read_parquet(f"{SF}/lineitem.parquet")) > 0
    assert sum(os.path.getsize(f) for f in glob.glob(f"{folder}/part-*")) < 60 * n
