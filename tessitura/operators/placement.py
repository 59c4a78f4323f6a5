"""Times of the words of a caption: model times where they are sure, the free time between them by length."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_SCORE, WORD_FLOOR, FLOOR_SHARE, UNSURE = 0.30, 0.005, 0.45, 0.25


def order_match(expected: Column, found: Column) -> Column:
    """For each expected text the place (from 0) of the found text that it is matched with, in order; null if none."""

    @F.arrow_udf("array<int>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            places: list[int | None] = [None] * len(a or ())
            for block in SequenceMatcher(None, a or [], b or [], autojunk=False).get_matching_blocks():
                places[block.a : block.a + block.size] = range(block.b, block.b + block.size)
            out.append(places)
        return pa.array(out, pa.list_(pa.int32()))

    return run(expected, found)


def engine_windows(captions: DataFrame, duration: float, pad: float = 0.200) -> DataFrame:
    """(song_id, block, low, high): the stretch of audio that an engine should hear for each caption with words."""
    return captions.where(F.size("words") > 0).select("song_id", "block", F.greatest(F.lit(0.0), F.col("start") - pad).alias("low"), F.least(F.lit(duration), F.col("end") + pad).alias("high"))


_TIMES = "struct<last:double,place:int,times:array<struct<start:double,end:double>>>"


def place_words(segments: DataFrame, key: list[str], snap: bool = True) -> DataFrame:
    """(key, no, text, start, end, score, source): each word of each segment with a time.

    segments: key, seg_start, seg_end (seg_end after seg_start), words array<struct<no,text,key>>, found
    array<struct<key,start,end,score>>. Model times are matched by text, never by position, and taken where they are sure,
    in order and leave every other word its least time. Words without one share the free time up to their neighbours by
    length. source is model or proportional; the ends are snapped to the segment."""
    n, length = F.size("words"), F.col("seg_end") - F.col("seg_start")
    found = F.coalesce("found", F.array().cast("array<struct<key:string,start:double,end:double,score:double>>"))
    has = F.size("found") > 0
    matched = segments.where(n > 0).withColumn("found", found).withColumn("partner", order_match(F.when(has, F.transform("words", lambda w: w["key"])), F.when(has, F.transform("found", lambda f: f["key"]))))
    heard = F.when(has, F.transform("partner", lambda p: F.when(p.isNotNull(), F.get("found", p))))
    told = matched.withColumn("floor", F.least(F.lit(WORD_FLOOR), length / n * FLOOR_SHARE)).withColumn("heard", heard)

    def step(acc, i):
        h = F.get("heard", i)
        sure = (h["start"] >= F.col("seg_start")) & (h["start"] < h["end"]) & (h["end"] <= F.col("seg_end")) & (h["end"] - h["start"] >= F.col("floor")) & (h["score"] >= WORD_SCORE)
        room = (h["start"] - acc["last"] >= (i - acc["place"] - 1) * F.col("floor")) & (h["start"] >= F.col("seg_start") + i * F.col("floor")) & (h["end"] <= F.col("seg_end") - (n - i - 1) * F.col("floor"))
        taken = F.coalesce(sure & ~F.isnan(h["start"]) & ~F.isnan(h["end"]) & ~F.isnan(h["score"]) & (h["start"] >= acc["last"]) & room, F.lit(False))
        one = F.struct(h["start"].alias("start"), h["end"].alias("end"))
        return F.struct(F.when(taken, h["end"]).otherwise(acc["last"]).alias("last"), F.when(taken, i).otherwise(acc["place"]).alias("place"), F.concat(acc["times"], F.array(F.when(taken, one))).alias("times")).cast(_TIMES)

    first = F.struct(F.col("seg_start").alias("last"), F.lit(-1).alias("place"), F.array().alias("times")).cast(_TIMES)
    taken = told.withColumn("times", F.when(has, F.aggregate(F.sequence(F.lit(0), n - 1), first, step)["times"]))
    # A segment is one row, and so is what its words take over from each other: lengths up to each word, and, where any time is
    # taken, the last such place at or before a word and the first at or after it. Nothing is shuffled or sorted.
    timed_any, put = F.col("times").isNotNull() & F.exists("times", lambda t: t.isNotNull()), lambda acc, x: F.concat(acc, F.array(x))
    upto = F.aggregate("words", F.array(F.lit(0)), lambda acc, w: put(acc, F.get(acc, F.size(acc) - 1) + F.greatest(F.lit(1), F.char_length(w["key"]))))
    near = lambda times, none, here: F.when(timed_any, F.aggregate(times, F.array(none), lambda acc, t: put(acc, F.when(t.isNotNull(), here(acc)).otherwise(F.get(acc, F.size(acc) - 1)))))
    before, after = near(F.col("times"), F.lit(-1), lambda acc: F.size(acc) - 1), near(F.reverse("times"), n, lambda acc: n - F.size(acc))
    score = lambda h: F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(~F.isnan(h["score"]), h["score"]))), F.lit(0.0))
    rows = taken.select(*key, "seg_start", "seg_end", n.alias("n"), "heard", "times", upto.alias("upto"), before.alias("before"), after.alias("after"), "words")
    rows = rows.select(*rows.columns[:-1], F.posexplode("words").alias("i", "w"))
    i = F.col("i")
    last, ahead = F.coalesce(F.get("before", i + 1), F.lit(-1)), F.coalesce(F.get("after", F.col("n") - i), F.col("n"))
    share, total = F.get("upto", i + 1) - F.get("upto", last + 1), F.get("upto", ahead) - F.get("upto", last + 1)
    filled = rows.select(*key, "seg_start", "seg_end", "n", "i", "w.no", "w.text", F.get("times", i).alias("time"), score(F.get("heard", i)).alias("score"), share.alias("share"), total.alias("total"), (F.get("upto", i + 1) - F.get("upto", i)).alias("weight"),
        F.coalesce(F.get("times", last)["end"], "seg_start").alias("low"), F.coalesce(F.get("times", ahead)["start"], "seg_end").alias("high"))
    fixed = F.col("time").isNotNull()
    spread = lambda c: F.col("low") + (F.col("high") - F.col("low")) * c / F.col("total")
    timed = filled.withColumns({"start": F.coalesce("time.start", spread(F.col("share") - F.col("weight"))), "end": F.coalesce("time.end", F.when(F.col("share") == F.col("total"), F.col("high")).otherwise(spread(F.col("share"))))})
    if snap:
        timed = timed.withColumns({"start": F.when(F.col("i") == 0, F.col("seg_start")).otherwise(F.col("start")), "end": F.when(F.col("i") == F.col("n") - 1, F.col("seg_end")).otherwise(F.col("end"))})
    sure = fixed | (F.col("n") == 1)
    return timed.select(*key, "no", "text", "start", "end", F.when(sure, F.col("score")).otherwise(F.least("score", F.lit(UNSURE))).alias("score"), F.when(fixed, "model").otherwise("proportional").alias("source"))


def align_captions(captions: DataFrame, duration: float) -> DataFrame:
    """(song_id, block, no, text, start, end, score, source, warnings): words of each caption with times.

    captions: song_id, block, start, end, words, keys, found array<struct<key,start,end,score>>, confirmed
    map<int,struct<start,end>> (by place from 0), failed (optional: the engine gave up). Times are clipped to the audio;
    captions without words or time have no rows. Confirmed words stay as they are and part the caption; model times
    are used within one part only. Without a result the times are proportional, with a warning."""
    failed = F.coalesce("failed", F.lit(False)) if "failed" in captions.columns else F.lit(False)
    clipped = captions.select("song_id", "block", F.greatest(F.lit(0.0), "start").alias("start"), F.least(F.lit(duration), "end").alias("end"), "words", "keys", F.when(~failed, F.col("found")).alias("found"), "confirmed", failed.alias("failed"))
    clipped = clipped.where((F.size("words") > 0) & (F.col("end") > F.col("start")))
    # Confirmed words cut a caption into parts, which are told within its row.
    one = F.transform(F.arrays_zip("words", "keys"), lambda w, i: F.struct(i.alias("no"), w["words"].alias("text"), w["keys"].alias("key")))
    at = lambda i: F.element_at("confirmed", i)
    places = F.coalesce(F.when(F.size("confirmed") > 0, F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: at(i).isNotNull())), F.array().cast("array<int>"))
    warnings = F.when(F.col("failed"), F.array(F.lit("engine_failed"))).otherwise(F.array().cast("array<string>"))
    cut = clipped.where(F.col("keys").isNotNull()).withColumn("all", one).withColumn("cuts", places).withColumn("warnings", warnings)

    def part(k):
        low, high = F.coalesce(F.get("cuts", k - 1) + 1, F.lit(0)), F.coalesce(F.get("cuts", k), F.size("all"))
        ends, starts = (F.filter(F.transform(some, lambda c: at(c)[side]), lambda x: x.isNotNull()) for some, side in ((F.slice("cuts", F.lit(1), k), "end"), (F.slice("cuts", k + 1, F.size("cuts")), "start")))
        return F.struct(k.alias("part"), F.slice("all", low + 1, high - low).alias("words"), F.coalesce(F.get(ends, F.size(ends) - 1), "start").alias("seg_start"), F.coalesce(F.get(starts, F.lit(0)), "end").alias("seg_end"))

    parts = F.when(F.size("cuts") > 0, F.transform(F.sequence(F.lit(0), F.size("cuts")), part)).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("all").alias("words"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))))
    key = ["song_id", "block", "part", "warnings"]
    segments = cut.select("song_id", "block", "warnings", "found", F.inline(parts)).where("seg_end > seg_start")
    inside = F.when(F.col("found").isNotNull(), F.filter("found", lambda f: (f["start"] >= F.col("seg_start")) & (f["start"] < f["end"]) & (f["end"] <= F.col("seg_end"))))
    placed = place_words(segments.withColumn("found", F.coalesce(inside, F.col("found"))), key).drop("part")
    sure = cut.where(F.size("cuts") > 0).select("song_id", "block", "warnings", "all", "confirmed", F.explode("cuts").alias("no")).withColumn("fixed", F.element_at("confirmed", F.col("no")))
    fixed = sure.select("song_id", "block", "warnings", "no", F.get("all", F.col("no"))["text"].alias("text"), "fixed.start", "fixed.end", F.lit(0.0).alias("score"), F.lit("confirmed").alias("source"))
    rows = placed.unionByName(fixed)
    return rows.select("song_id", "block", (F.col("no") + 1).cast("long").alias("no"), "text", "start", "end", "score", "source", "warnings")
