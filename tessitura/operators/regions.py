"""Repair of a lyric's times by regions: anchors that hold, regions between them, their division, and one set of blocks from all attempts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators import sequence

#: Seconds that a part of a region spans at most, where it can be cut.
PART = 18.0


def anchors(steps: DataFrame, tokens: DataFrame) -> DataFrame:
    """(song_id, block, a, b): captions all whose words stand in the lyric, side by side and beyond doubt; a to b - 1 are their places there.

    steps: as ``alignment.global_alignment`` gives them; tokens: song_id, pos, block (the words of captions)."""
    met = steps.where(F.col("kind").isin("equal", "spelling") & ~F.col("ambiguous")).select("song_id", F.col("source_pos").alias("pos"), "target_pos")
    found = tokens.join(met, ["song_id", "pos"], "left").groupBy("song_id", "block").agg(F.count("*").alias("n"), F.count("target_pos").alias("m"), F.min("target_pos").alias("a"), F.max("target_pos").alias("z"))
    return found.where("m = n AND z - a + 1 = n").select("song_id", "block", "a", (F.col("z") + 1).alias("b"))


def search_spans(steps: DataFrame, tokens: DataFrame) -> DataFrame:
    """(song_id, block, a, b): the stretch of the lyric that the words of a caption were laid against, alike or not; it bounds a search and proves nothing."""
    met = steps.where("source_pos IS NOT NULL AND target_pos IS NOT NULL").select("song_id", F.col("source_pos").alias("pos"), "target_pos")
    return tokens.join(met, ["song_id", "pos"]).groupBy("song_id", "block").agg(F.min("target_pos").alias("a"), (F.max("target_pos") + 1).alias("b"))


def repair_regions(held: DataFrame, totals: DataFrame) -> DataFrame:
    """(song_id, a, b): stretches of the lyric without an anchor, each with the anchors to its sides as context; those that share one are joined.

    held: as ``anchors`` gives them; totals: song_id, total (words of the lyric). A song without anchors is one region."""
    edge = F.lit(None).cast("long")
    places = held.select("song_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).unionByName(totals.select("song_id", edge.alias("a"), F.lit(0).cast("long").alias("b")))
    w = W.partitionBy("song_id").orderBy(F.col("a").asc_nulls_first())
    gaps = places.withColumns({"_a": F.lead("a").over(w), "_b": F.lead("b").over(w)}).join(totals, "song_id")
    open_ = gaps.where(F.col("b") < F.coalesce("_a", "total")).select("song_id", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("_b", "total").cast("long").alias("b"))
    by_a = W.partitionBy("song_id").orderBy("a", "b")
    reached = F.max("b").over(by_a.rowsBetween(W.unboundedPreceding, -1))
    joined = open_.withColumn("_new", F.coalesce(F.col("a") >= reached, F.lit(True)).cast("long")).withColumn("_group", F.sum("_new").over(by_a.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return joined.groupBy("song_id", "_group").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_group")


def cut_region(a: int, b: int, spans: list[dict], most: float) -> list[tuple[int, int, int, int]]:
    """(a, b, own_a, own_b) of the parts of a region: each ends with a span that the next begins with. spans: a, start, end, b, in order."""
    out, begin = [], a
    while True:
        rest = [s for s in spans if s["a"] >= begin]
        if len(rest) < 2 or rest[-1]["end"] - rest[0]["start"] <= most:
            return [*out, (begin, b, begin, b)]
        fitting = [s for s in rest[1:-1] if s["end"] - rest[0]["start"] <= most]
        cut = fitting[-1] if fitting else rest[1]
        out.append((begin, cut["b"], begin, cut["a"]))
        begin = cut["a"]


def split_regions(regions: DataFrame, spans: DataFrame, blocks: DataFrame, most: float = PART) -> DataFrame:
    """(song_id, region_a, a, b, own_a, own_b): regions in parts of ``most`` seconds, where the spans in them allow it.

    a to b are the words that a part is searched with, own_a to own_b those that are its own; neighbours share the span
    at their border. regions: song_id, a, b; spans: song_id, block, a, b; blocks: song_id, block, start, end."""
    timed = spans.join(blocks, ["song_id", "block"]).select("song_id", F.col("a").alias("_a"), F.col("b").alias("_b"), "start", "end")
    inside = regions.join(timed, "song_id", "left").withColumn("_in", (F.col("_a") >= F.col("a")) & (F.col("_b") <= F.col("b")))
    one = F.struct(F.col("_a").alias("a"), "start", "end", F.col("_b").alias("b"))
    listed = inside.groupBy("song_id", "a", "b").agg(F.array_sort(F.collect_list(F.when(F.col("_in"), one))).alias("spans"))

    @F.arrow_udf("array<struct<a:bigint,b:bigint,own_a:bigint,own_b:bigint>>")
    def parts(first: pa.Array, after: pa.Array, within: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("a", "b", "own_a", "own_b")]))
        rows = [cut_region(first[k].as_py(), after[k].as_py(), within[k].as_py(), most) for k in range(len(first))]
        return pa.array([[dict(zip(("a", "b", "own_a", "own_b"), r, strict=True)) for r in row] for row in rows], kind)

    return listed.select("song_id", F.col("a").alias("region_a"), F.inline(parts("a", "b", "spans")))


def exportable(times: list[tuple[int, int]]) -> list[str | None]:
    """For blocks (start, end in milliseconds) in their order why each is left out: no_length, overlap with the last that was kept, or null."""
    out, last = [], None
    for start, end in times:
        why = "no_length" if end <= start else "overlap" if last is not None and last > start else None
        out.append(why)
        last = end if why is None else last
    return out


def reconcile(lyric: DataFrame, preserved: DataFrame, estimates: DataFrame, songs: DataFrame, beam: int = sequence.BEAM) -> DataFrame:
    """(song_id, a, b, start, end, origin, score, problem): blocks of a lyric from captions that are kept and from all times that attempts found.

    lyric: song_id, pos, line; preserved: song_id, a, b, start, end; estimates: song_id, pos, start, end, score (any number
    for a word, of any attempts); songs: song_id, duration. Words between kept captions take at most one of their times
    each, without overlap and within the room between those captions: most words, then the highest score. Neighbouring
    timed words of a line are a block; score is the least of its words. problem tells which blocks are not published."""
    kept = preserved.dropDuplicates(["song_id", "a", "b"]).select("song_id", "a", "b", "start", "end")
    taken = kept.select("song_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("pos")).distinct()
    free = lyric.join(taken, ["song_id", "pos"], "left_anti")
    by_pos = W.partitionBy("song_id").orderBy("pos")
    free = free.withColumn("_run", F.col("pos") - F.row_number().over(by_pos))
    runs = free.groupBy("song_id", "_run").agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("b"))
    both = runs.select("song_id", "_run", F.col("a").cast("long").alias("a"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end")).unionByName(
        kept.select("song_id", F.lit(None).cast("long").alias("_run"), F.col("a").cast("long").alias("a"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))
    at = W.partitionBy("song_id").orderBy("a")
    room = both.withColumns({"_low": F.max("end").over(at.rowsBetween(W.unboundedPreceding, -1)), "_high": F.min("start").over(at.rowsBetween(1, W.unboundedFollowing))})
    room = room.where("_run IS NOT NULL").join(songs, "song_id").select("song_id", "_run", F.coalesce("_low", F.lit(0.0)).alias("window_start"), F.coalesce("_high", F.col("duration").cast("double")).alias("window_end"))
    options = free.join(room, ["song_id", "_run"]).join(estimates, ["song_id", "pos"], "left")
    chosen = sequence.time_choice(options.select(F.struct("song_id", "_run").alias("song_id"), F.col("pos").alias("word"), "start", "end", "score", "window_start", "window_end"), beam)
    timed = chosen.where("start IS NOT NULL").select("song_id.song_id", "song_id._run", F.col("word").alias("pos"), "start", "end").join(lyric.select("song_id", "pos", "line"), ["song_id", "pos"])
    own = estimates.groupBy("song_id", "pos", "start", "end").agg(F.max("score").alias("score"))
    scored = timed.join(own, ["song_id", "pos", "start", "end"], "left").withColumn("_i", F.col("pos") - F.row_number().over(W.partitionBy("song_id", "_run", "line").orderBy("pos")))
    aligned = scored.groupBy("song_id", "_run", "line", "_i").agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("b"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.min("score").alias("score"))
    shape = lambda df, origin, score: df.select("song_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(origin).alias("origin"), score.cast("double").alias("score"))
    blocks = shape(kept, "kept", F.lit(None)).unionByName(shape(aligned, "aligned", F.col("score")))

    @F.arrow_udf("array<string>")
    def reasons(lists: pa.Array) -> pa.Array:
        return pa.array([exportable([(round(x["start"] * 1000), round(x["end"] * 1000)) for x in xs]) for xs in lists.to_pylist()], pa.list_(pa.string()))

    songs_ = blocks.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "start", "end", "origin", "score"))).alias("x"))
    told = songs_.withColumn("why", reasons("x")).select("song_id", F.explode(F.arrays_zip("x", "why")).alias("r"))
    return told.select("song_id", "r.x.*", F.col("r.why").alias("problem"))
