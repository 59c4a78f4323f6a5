"""Global alignment of two token lists, as whole-array steps over anti-diagonals, and what is read off it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import indel_pairs
from tessitura.operators import intervals

MOST_CELLS = 4_000_000
_NEAR = 1e-8


def substitution_costs(source: list[str], target: list[str]) -> np.ndarray:
    """0 for equal keys, else 1 to 1.5 by Indel similarity; each pair of distinct keys is compared once."""
    a, at_a = np.unique(np.array(source, object), return_inverse=True)
    b, at_b = np.unique(np.array(target, object), return_inverse=True)
    left, right = np.repeat(a, len(b)), np.tile(b, len(a))
    cost = np.where(left == right, 0.0, 1.5 - indel_pairs(left.tolist(), right.tolist()) / 2).reshape(len(a), len(b))
    return cost[np.ix_(at_a, at_b)]


def _forward(sub: np.ndarray) -> np.ndarray:
    """The least cost from the beginning to each cell; a whole anti-diagonal a step."""
    n, m = sub.shape
    cost = np.add.outer(np.arange(n + 1.0), np.arange(m + 1.0))
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        cost[i, j] = np.minimum(cost[i - 1, j - 1] + sub[i - 1, j - 1], np.minimum(cost[i - 1, j], cost[i, j - 1]) + 1)
    return cost


def best_steps(sub: np.ndarray):
    """(source places, target places, ambiguous targets, cost) of the preferred best alignment; -1 where a side has no part.

    A move lies on a best path if the cost before it, its own and the cost after it add up to the whole. A target
    is ambiguous if best paths give it different partners. From the end, pairs come before source only before target only."""
    n, m = sub.shape
    if (n + 1) * (m + 1) > MOST_CELLS:
        raise ValueError("the texts are too long to be aligned")
    ahead = _forward(sub)
    behind = _forward(sub[::-1, ::-1])[::-1, ::-1]
    whole = ahead[n, m] + _NEAR
    pair = ahead[:-1, :-1] + sub + behind[1:, 1:] <= whole
    source_only = ahead[:-1, :] + 1 + behind[1:, :] <= whole
    target_only = ahead[:, :-1] + 1 + behind[:, 1:] <= whole
    ambiguous = pair.sum(0) + target_only.any(0) > 1
    rows, columns, i, j = [], [], n, m
    while i or j:
        if i and j and pair[i - 1, j - 1]:
            i, j = i - 1, j - 1
            rows.append(i)
            columns.append(j)
        elif i and source_only[i - 1, j]:
            i -= 1
            rows.append(i)
            columns.append(-1)
        else:
            j -= 1
            rows.append(-1)
            columns.append(j)
    return np.array(rows[::-1], np.int64), np.array(columns[::-1], np.int64), ambiguous, float(ahead[n, m])


def global_alignment(tokens: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Steps of aligning the two sides of each key: equal, spelling, replaced, source_only, target_only.

    tokens: key (song_id), side ('source' or 'target'), pos, text, key_text or key. One group is one song (or gap); a
    group of over ``MOST_CELLS`` cells is refused. A side without tokens is aligned with nothing."""
    by = key or ["song_id"]
    kinds = dict(tokens.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", step long, source_pos long, target_pos long, kind string, ambiguous boolean"

    def run(names, group):
        ordered = group.sort_values("pos", kind="stable")
        a, b = (ordered[ordered["side"] == s] for s in ("source", "target"))
        rows, columns, ambiguous, _ = best_steps(substitution_costs(a["key"].tolist(), b["key"].tolist()) if len(a) and len(b) else np.zeros((len(a), len(b))))

        def at(side, name, place):
            return np.append(side[name].to_numpy(object), None)[place]

        kind = np.where(at(a, "text", rows) == at(b, "text", columns), "equal", np.where(at(a, "key", rows) == at(b, "key", columns), "spelling", "replaced")).astype(object)
        kind[columns < 0], kind[rows < 0] = "source_only", "target_only"
        out = pd.DataFrame({k: [v] * len(rows) for k, v in zip(by, names, strict=True)})
        return out.assign(
            step=np.arange(len(rows)), source_pos=pd.array(at(a, "pos", rows), "Int64"), target_pos=pd.array(at(b, "pos", columns), "Int64"), kind=kind, ambiguous=np.append(ambiguous, False)[columns] & (columns >= 0)
        )

    return tokens.groupBy(*by).applyInPandas(run, schema)


def divergences(steps: DataFrame, tokens: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, grp, kind, source_text, target_text, n_source, n_target): runs of steps that differ by more than spelling.

    kind is replaced if both sides have words, else source_only or target_only."""
    by = key or ["song_id"]
    same = F.col("kind").isin("equal", "spelling")
    runs = intervals.runs(steps, by, ["step"], same, "grp").where(~same)
    for side in ("source", "target"):
        words = tokens.where(F.col("side") == side).select(*by, F.col("pos").alias(f"{side}_pos"), F.col("text").alias(f"{side}_word"))
        runs = runs.join(words, [*by, f"{side}_pos"], "left")
    spelled = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"{side}_pos").isNotNull(), F.struct("step", f"{side}_word")))), lambda x: x[f"{side}_word"]), " ")
    found = runs.groupBy(*by, "grp").agg(spelled("source").alias("source_text"), spelled("target").alias("target_text"), F.count("source_pos").alias("n_source"), F.count("target_pos").alias("n_target"))
    kind = F.when((F.col("n_source") > 0) & (F.col("n_target") > 0), "replaced").when(F.col("n_target") > 0, "target_only").otherwise("source_only")
    return found.withColumn("kind", kind)


def reused_times(expected: DataFrame, found: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos, start, end, score): times of found words for the expected ones whose key they have, unambiguous, valid and in order.

    expected: key, pos, text, key; found: key, no, text, key, start, end, score; windows: key, low, high (seconds)."""
    tokens = expected.select(*key, F.lit("target").alias("side"), F.col("pos").cast("long").alias("pos"), "text", "key").unionByName(found.select(*key, F.lit("source").alias("side"), F.col("no").cast("long").alias("pos"), "text", "key"))
    steps = global_alignment(tokens, key).where(F.col("kind").isin("equal", "spelling") & ~F.col("ambiguous"))
    timed = steps.join(found.select(*key, F.col("no").cast("long").alias("source_pos"), "start", "end", "score"), [*key, "source_pos"]).join(windows.select(*key, "low", "high"), key)
    ms = lambda c: F.rint(F.col(c) * 1000)
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    valid = timed.where(number("start") & number("end") & (F.col("start") >= F.col("low")) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("high")) & (ms("end") > ms("start")))
    one = F.struct(F.col("target_pos").alias("pos"), "start", "end", "score")
    grouped = valid.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("w"), F.min("low").alias("low"))
    kind = "struct<last:double,kept:array<struct<pos:bigint,start:double,end:double,score:double>>>"
    first = F.struct(F.col("low").cast("double").alias("last"), F.array().alias("kept")).cast(kind)
    in_order = F.aggregate("w", first, lambda acc, x: F.when(x["start"] >= acc["last"], F.struct(x["end"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc).cast(kind))
    return grouped.select(*key, F.inline(in_order["kept"]))
