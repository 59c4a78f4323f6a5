"""Referential checks: each gives a table of violations; ``refuse`` turns a filled one into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import text as T
from tessitura.functions.shared import spread


def _null_safe(a: str, b: str, names) -> object:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Children without a parent. The number of tasks is given, and holds for both sides: put together by bytes, narrow rows are many to a sort."""
    dealt = parents.select(*on).repartition(spread(children.sparkSession), *on)
    return children.join(dealt.distinct(), on, "left_anti")


def not_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): keys that are null or occur more than once."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | missing)


def broken_ordinals(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """(key, n, lowest, highest, kinds): keys whose numbers are not exactly 1 to n."""
    got = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(number).alias("lowest"), F.max(number).alias("highest"), F.count_distinct(number).alias("kinds"))
    return got.where("lowest <> 1 or highest <> n or kinds <> n")


def coverage(expected: DataFrame, actual: DataFrame, on: list[str], compare: list[str]) -> DataFrame:
    """(on, rule): expected rows that are missing, actual ones that are extra, and differing attributes."""
    e, a = expected.select(*on, *compare, F.lit(1).alias("_e")).alias("e"), actual.select(*on, *compare, F.lit(1).alias("_a")).alias("a")
    both = e.join(a, reduce(lambda x, y: x & y, [F.col(f"e.{k}") == F.col(f"a.{k}") for k in on]), "full")
    rule = F.when(F.col("_a").isNull(), F.lit("missing")).when(F.col("_e").isNull(), F.lit("extra")).when(~_null_safe("e", "a", compare) if compare else F.lit(False), F.lit("differs"))
    return both.select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"a.{k}")).alias(k) for k in on], rule.alias("rule")).where("rule is not null")


def recomposed(parents: DataFrame, parts: DataFrame, key: list[str], text: str, part: str, number: str, separator: str = "") -> DataFrame:
    """Keys whose parts, in order, do not spell the parent's text."""
    spelled = parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, part))), lambda x: x[part]), separator).alias("_spelled"))
    return parents.join(spelled, key, "left").where(~F.col(text).eqNullSafe(F.col("_spelled"))).select(*key, F.col(text), F.col("_spelled").alias("spelled"))


def changed_sources(recorded: DataFrame, current: DataFrame, key: list[str], digest: str = "sha256") -> DataFrame:
    """Keys whose content hash is no longer the recorded one, or that are gone."""
    now = current.select(*key, F.col(digest).alias("_now"))
    return recorded.join(now, key, "left").where(~F.col(digest).eqNullSafe(F.col("_now"))).drop("_now")


def refuse(violations: DataFrame) -> None:
    """Raises if there is any violation; looks at one row only."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"violation: {first[0].asDict()}")


def _told(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """(key, rule): one row for each check that a row breaks; an unknown outcome breaks none."""
    rules = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return rows.select(*key, F.explode(rules).alias("rule"))


def _unreal(*columns: Column) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return found


def block_violations(blocks: DataFrame, duration: Column, apart: float = 1e-5, beyond: float = 0.001) -> DataFrame:
    """(song_id, block, rule) of reviewed blocks: what keeps them from being published.

    blocks: song_id, block, start, end, text, words array<struct<text,start,end,confirmed>> (null or empty: none). Rules:
    repeated (an id that stands twice), invalid_times (not finite, no length, outside the song), no_words, overlap (with
    the block before, by more than ``apart``), other_words (the words do not spell the text), confirmed_times (a confirmed
    word has no valid times within the block), no_room (confirmed words overlap, or leave no time for those between or
    after them)."""
    by_time = W.partitionBy("song_id").orderBy("start", "end", "block")
    a, z, w = F.col("start"), F.col("end"), F.coalesce("words", F.array().cast(blocks.schema["words"].dataType))
    own = T.tokens(F.col("text"))
    keys = lambda c: F.transform(c, T.comparison_key)
    sure = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x["start"].alias("x"), x["end"].alias("y"), F.coalesce(x["confirmed"], F.lit(False)).alias("ok"))), lambda x: x["ok"])
    bad = F.exists(sure, lambda c: _unreal(c["x"], c["y"]) | ~((c["x"] >= a) & (c["x"] < c["y"]) & (c["y"] <= z)))

    def tight(c: Column, k: Column) -> Column:
        before = F.get(sure, k - 1)
        ended, at = F.when(k == 0, a).otherwise(before["y"]), F.when(k == 0, F.lit(-1)).otherwise(before["i"])
        return (c["x"] < ended) | ((c["i"] > at + 1) & (c["x"] <= ended))

    last = F.get(sure, F.size(sure) - 1)
    crowded = F.exists(F.transform(sure, tight), lambda t: t) | (last.isNotNull() & (last["i"] < F.size(w) - 1) & (last["y"] >= z))
    seen = blocks.withColumn("_n", F.count("*").over(W.partitionBy("song_id", "block"))).withColumn("_before", F.lag("end").over(by_time))
    return _told(seen, ["song_id", "block"], {
        "repeated": F.col("_n") > 1,
        "invalid_times": _unreal(a, z) | ~((a >= 0) & (a < z) & (z <= duration + beyond)),
        "no_words": F.coalesce(F.size(own), F.lit(0)) < 1,
        "overlap": ~F.isnan("_before") & (a < F.col("_before") - apart),
        "other_words": (F.size(w) > 0) & (keys(F.transform(w, lambda x: x["text"])) != keys(own)),
        "confirmed_times": bad,
        "no_room": ~bad & crowded,
    })


def unit_violations(units: DataFrame, duration: Column | None = None, apart: float = 1e-9, beyond: float = 0.002) -> DataFrame:
    """(song_id, id, rule) of syllables (song_id, id, ord, start, end, core_start, core_end), judged in the order of ord.

    Rules: absent_times (a time is null or not finite), invalid_times (not 0 <= start <= core_start < core_end <= end),
    overlap (with the unit before, by more than ``apart``), repeated (an id that stands twice), outside (past ``duration``)."""
    a, b, x, y = (F.col(c).cast("double") for c in ("start", "end", "core_start", "core_end"))
    absent = _unreal(a, b, x, y)
    seen = units.withColumn("_n", F.count("*").over(W.partitionBy("song_id", "id"))).withColumn("_before", F.lag("end").over(W.partitionBy("song_id").orderBy("ord")))
    checks = {
        "absent_times": absent,
        "invalid_times": ~absent & ~((a >= 0) & (a <= x) & (x < y) & (y <= b) & (a < b)),
        "overlap": ~F.isnan("_before") & (a < F.col("_before") - apart),
        "repeated": F.col("_n") > 1,
    }
    if duration is not None:
        checks["outside"] = b > duration + beyond
    return _told(seen, ["song_id", "id"], checks)
