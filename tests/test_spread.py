"""Narrow rows and dear rows are dealt over a given number of tasks: sizes by bytes would put them into a few."""

import random

import pytest

from tessitura.functions.shared import spread
from tessitura.functions.text import indel, indel_runs
from tessitura.operators import review
from tessitura.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["weighted_stability", "folder_states", "orphan_rows"])
def test_dealt_by_number(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f"{spread(spark)}), REPARTITION_BY_NUM" in plan


def test_texts_of_turns_are_joined_once(spark):
    """capped_groups: no window sorts and joins the words of a turn for each of them."""
    plan = QUERIES["capped_groups"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in "".join(line for line in plan.splitlines() if "Window" in line)


def test_candidates_are_dealt_and_packed(spark):
    """turns are dealt by number, and the ratios of all runs of three and all items of a pack are told by one call."""
    plan = QUERIES["ngram_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f"{spread(spark)}), REPARTITION_BY_NUM" in plan
    rng = random.Random(5)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice("abcdé 😀") for _ in range(rng.choice([0, 1, 5, 70, 130])))
    for _ in range(100):
        items, parts = tuple(text() for _ in range(rng.randrange(1, 20))), [text() for _ in range(3)]
        joined = [" ".join(p for p in parts[: k + 1] if p is not None) for k in range(3)]
        assert indel_runs(items, parts) == [None if t is None else indel(t, g) for t in items for g in joined]


def test_candidates_keep_columns_and_missing_texts(spark):
    """A caption without text begins runs of those after it; an item without text has candidates without score; other columns stay."""
    texts = ["Ab c", None, "ab", "", "xb"] * 4
    rows = [("k", k, float(k), t) for k, t in enumerate(texts)]
    caps = spark.createDataFrame(rows, "song string, ord long, start double, text string")
    items = spark.createDataFrame([(song, k, t, f"more{k}") for song, k, _, t in rows], "song string, item long, text string, more string")
    got = review.caption_candidates(items, caps, ["song"], most=5)
    assert got.columns == ["song", "item", "text", "more", "ord", "start", "n", "gram", "score", "rank"]
    found: dict = {}
    for r in got.collect():
        assert r["text"] == texts[r["item"]] and r["more"] == f"more{r['item']}"
        found.setdefault(r["item"], {})[r["rank"]] = (r["ord"], r["n"], r["gram"], r["score"])
    for item, text in enumerate(texts):
        runs = [(k, n, " ".join(t for t in texts[k : k + n] if t is not None)) for k in range(len(texts)) for n in (1, 2, 3) if k + n <= len(texts) and texts[k + n - 1] is not None]
        scored = [(*x, None if text is None else indel(text.lower(), x[2].lower())) for x in runs]
        best = sorted(scored, key=lambda x: (-(x[3] or 0.0), x[0], x[1]))[:5]
        assert [found[item][k] for k in range(1, 6)] == best
