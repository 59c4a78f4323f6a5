"""Intervals on a time line: runs, gaps, overlaps, point-in-interval joins and their checks.

Every operator takes its key columns; windows are partitioned by them, so one
key is one song, user or track. Ordered windows need a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _window(key, order):
    return W.partitionBy(*key).orderBy(*order)


def overlaps(rows: DataFrame, key: list[str], order: list[str], start: str, end: str, tolerance: float = 0) -> DataFrame:
    """Rows that begin before the row before them ends, by more than ``tolerance``; previous_end is added."""
    return rows.withColumn("previous_end", F.lag(end).over(_window(key, order))).where(F.col(start) < F.col("previous_end") - F.lit(tolerance))


def interval_violations(rows: DataFrame, key: list[str], order: list[str], start: str, end: str, duration: Column, tolerance: float = 0) -> DataFrame:
    """(key, order, rule): not finite, not positive, outside 0 to duration, or overlapping."""
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    checks = {
        "not_finite": s.isNull() | e.isNull() | F.isnan(s) | F.isnan(e),
        "not_positive": e <= s,
        "outside": (s < 0) | (e > duration + tolerance),
        "overlap": s < F.lag(e).over(_window(key, order)) - tolerance,
    }
    rules = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return rows.withColumn("rule", rules).select(*key, *order, F.explode("rule").alias("rule"))


def runs(rows: DataFrame, key: list[str], order: list[str], flag: Column, name: str = "run") -> DataFrame:
    """``rows`` with the number (from 1) of the run of equal flags they are in."""
    w = _window(key, order)
    change = (~flag.eqNullSafe(F.lag(flag).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return rows.withColumn(name, F.sum(change).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def sessions(rows: DataFrame, key: list[str], order: list[str], start: str, end: str, pause, name: str = "session") -> DataFrame:
    """``rows`` with the number of their session; a gap of ``pause`` or more begins a new one."""
    w = _window(key, order)
    new = F.coalesce(F.col(start) - F.lag(end).over(w) >= pause, F.lit(True)).cast("long")
    return rows.withColumn(name, F.sum(new).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def contiguous(rows: DataFrame, key: list[str], number: str, name: str = "island") -> DataFrame:
    """``rows`` with an id shared by consecutive whole numbers."""
    return rows.withColumn(name, F.col(number) - F.row_number().over(_window(key, [number])))


def bridge(rows: DataFrame, key: list[str], order: list[str], flag: str, energy: str, most: int, into: str) -> DataFrame:
    """``into``: flag, with false runs of at most ``most`` rows filled where they are interior and energy holds throughout."""
    found = runs(rows, key, order, F.col(flag), "_run")
    own, whole = W.partitionBy(*key, "_run"), W.partitionBy(*key)
    inner = (F.col("_run") > F.min("_run").over(whole)) & (F.col("_run") < F.max("_run").over(whole))
    fill = ~F.col(flag) & inner & (F.count("*").over(own) <= most) & F.bool_and(energy).over(own)
    return found.withColumn(into, F.col(flag) | fill).drop("_run")


def gaps(rows: DataFrame, key: list[str], order: list[str], start: str, end: str, duration: Column) -> DataFrame:
    """Free time before the first, between neighbouring and after the last rows of each key: (key, after_start, gap_start, gap_end)."""
    w = _window(key, order)
    inner = rows.select(*key, F.col(start).alias("after_start"), F.col(end).alias("gap_start"), F.coalesce(F.lead(start).over(w), duration).alias("gap_end"))
    first = rows.groupBy(*key).agg(F.min(start).alias("gap_end"), F.max(duration).alias("_d")).select(*key, F.lit(None).cast(dict(rows.dtypes)[start]).alias("after_start"), F.lit(0).cast(dict(rows.dtypes)[end]).alias("gap_start"), "gap_end")
    return inner.unionByName(first).where("gap_end > gap_start")


def plan_gaps(located: DataFrame, key: list[str], total_tokens: Column, duration: Column, longest: float = 180.0) -> DataFrame:
    """Token gaps between located captions, with the time there is for them and why a gap is not searched.

    located: key, ord, start, end (seconds), token_start, token_end (null: not located), score, n_words.
    Short captions (two words, one second) that are not located are no anchors."""
    short = F.col("token_start").isNull() & (F.col("n_words") <= 2) & (F.col("end") - F.col("start") <= 1.0)
    anchors = located.where(~short).withColumns({"_total": total_tokens, "_duration": duration})
    w = _window(key, ["ord"])
    after = lambda c: F.lead(c).over(w)
    pairs = anchors.select(
        *key, F.col("ord").alias("before_ord"), after("ord").alias("after_ord"), F.col("token_end").alias("token_from"),
        F.when(after("ord").isNull(), F.col("_total")).otherwise(after("token_start")).alias("token_to"),
        F.col("end").alias("gap_start"), F.coalesce(after("start"), F.col("_duration")).alias("gap_end"), F.least("score", after("score")).alias("score"),
    )
    first = anchors.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(
        *key, F.lit(None).cast(dict(located.dtypes)["ord"]).alias("before_ord"), F.col("ord").alias("after_ord"), F.lit(0).cast(dict(located.dtypes)["token_end"]).alias("token_from"),
        F.col("token_start").alias("token_to"), F.lit(0.0).alias("gap_start"), F.col("start").alias("gap_end"), "score",
    )
    limit = F.least(F.lit(longest), F.greatest(F.lit(30.0), 3.0 * (F.col("token_to") - F.col("token_from"))))
    length = F.col("gap_end") - F.col("gap_start")
    reason = F.when(length <= 0.01, F.lit("no_time_between_captions")).when(length > limit, F.lit("gap_too_long_to_search")).when(F.col("score") < 0.75, F.lit("weak_text_anchors"))
    return pairs.unionByName(first).where("token_from < token_to").withColumns({"search_limit": limit, "reason": reason})


def conflict_free(rows: DataFrame, occupied: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """``rows`` that overlap no occupied interval of the same key.

    Both sides stand in one order by start. A row overlaps one that begins before it if the latest end so far is after
    its start, and one that begins within it if the next occupied start is before its end: two window passes, no pairs.
    A row without length overlaps what begins before it and ends after it."""
    o = occupied.select(*key, F.col(start).alias(start), F.col(end).alias(end)).where(F.col(end) > F.col(start)).withColumn("_o", F.lit(1))
    marked = _conflicts(rows, o, key, start, end)
    return marked.where("not _hit").drop("_hit")


def overlapping(rows: DataFrame, others: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """``rows`` with ``overlaps``: whether they share time with any of the ``others`` of their key."""
    o = others.select(*key, F.col(start).alias(start), F.col(end).alias(end)).where(F.col(end) > F.col(start)).withColumn("_o", F.lit(1))
    return _conflicts(rows, o, key, start, end).withColumnRenamed("_hit", "overlaps")


def _conflicts(rows: DataFrame, o: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    both = rows.withColumn("_o", F.lit(0)).unionByName(o, allowMissingColumns=True)
    # A row without length stands before what begins where it does, and one that ends before it begins where it ends.
    place = F.when((F.col("_o") == 0) & (F.col(end) <= F.col(start)), 0).otherwise(2 - F.col("_o"))
    before = _window(key, [F.least(start, end), place]).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = _window(key, [F.desc(start), "_o"]).rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = F.max(F.when(F.col("_o") == 1, F.col(end))).over(before)
    following = F.min(F.when(F.col("_o") == 1, F.col(start))).over(after)
    marked = both.withColumns({"_latest": latest, "_next": following}).where("_o = 0")
    hit = F.coalesce((F.col("_latest") > F.col(start)) | (F.col("_next") < F.col(end)), F.lit(False))
    return marked.withColumn("_hit", hit).drop("_o", "_latest", "_next")


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, width: float, closed: bool = False) -> DataFrame:
    """Points joined with the intervals they lie in: [start, end), or [start, end] if ``closed``.

    Intervals are dealt by length to levels of buckets, each level twice as wide as the one before, so an interval
    touches three buckets at most however long it is; the last level has one bucket, for what is longer, infinite ends
    too. A point has one bucket on each level that occurs (a subquery: a bit for each level); level, bucket and key are
    joined on equality and the bounds stay as a residual. No pair is found twice. ``width`` is the bucket of the first
    level. Intervals with a bound that is null or not a number hold no point."""
    a, b = F.col(start).cast("double"), F.col(end).cast("double")
    size = F.greatest(b - a, F.lit(float(width)))
    top = 62
    level = F.when(size >= float(width) * 2.0 ** (top - 1), F.lit(top)).otherwise(F.ceil(F.log2(size / F.lit(float(width))) - 1e-9)).cast("int")
    bucket = lambda c, lv: F.when(lv == top, F.lit(0).cast("long")).otherwise(F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), lv))))
    levelled = intervals.where((b >= a) & ~F.isnan(a) & ~F.isnan(b)).withColumn("_level", level)
    dealt = levelled.withColumn("_bucket", F.explode(F.sequence(bucket(start, F.col("_level")), bucket(end, F.col("_level")))))
    bits = levelled.agg(F.expr("bit_or(shiftleft(1L, _level))").alias("bits")).scalar()
    levels = F.filter(F.sequence(F.lit(0), F.lit(top)), lambda k: F.getbit(F.col("_bits"), k) == 1)
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    known = points.withColumn("_bits", F.coalesce(bits, F.lit(0).cast("long")))
    placed = known.withColumn("_level", F.explode(levels)).withColumn("_bucket", bucket(at, F.col("_level"))).drop("_bits")
    return placed.join(dealt, [*key, "_level", "_bucket"]).where(inside).drop("_bucket", "_level")


def confirmed_stop(frames: DataFrame, key: list[str], t: str, silent: str, fits: str, step: float, silence: float = 0.120, failure: float = 0.250, least_cover: float = 0.60, least_gain: float = 0.080, end: float | Column = 0.0) -> DataFrame:
    """How far each key's sound goes on: (key, stop_at, last_good, coverage, accepted).

    Frames are walked in time; ``silence`` seconds of silence or ``failure``
    seconds of frames that do not fit confirm the stop. What fits up to the last
    good frame must cover enough and gain enough over ``end``."""
    w = _window(key, [t])
    f = runs(runs(frames, key, [t], F.col(silent), "_s"), key, [t], F.col(fits), "_f")
    so_far = lambda r: F.row_number().over(W.partitionBy(*key, r).orderBy(t)) * F.lit(step)
    stop = (F.col(silent) & (so_far("_s") >= silence - 1e-9)) | (~F.col(fits) & (so_far("_f") >= failure - 1e-9))
    before = f.withColumn("_stop", stop).withColumn("stop_at", F.min(F.when(F.col("_stop"), F.col(t))).over(W.partitionBy(*key))).withColumn("_i", F.row_number().over(w))
    walked = before.where(F.col("stop_at").isNull() | (F.col(t) < F.col("stop_at")))
    last = walked.withColumn("_good", F.max(F.when(F.col(fits), F.col("_i"))).over(W.partitionBy(*key)))
    found = last.groupBy(*key).agg(
        F.min("stop_at").alias("stop_at"), F.max(F.when(F.col(fits), F.col(t))).alias("last_good"),
        (F.count_if(F.col(fits) & (F.col("_i") <= F.col("_good"))) / F.max("_good")).alias("coverage"),
    )
    base = end if isinstance(end, Column) else F.lit(end)
    return found.withColumn("accepted", F.coalesce((F.col("coverage") >= least_cover) & (F.col("last_good") + step - base >= least_gain), F.lit(False)))


def proportional_split(parts: DataFrame, key: list[str], order: list[str], weight: Column, start: Column, end: Column) -> DataFrame:
    """Each key's [start, end] split by weight: part_start and part_end; the last part ends at ``end`` exactly."""
    w = _window(key, order)
    up = F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum(weight).over(W.partitionBy(*key))
    place = lambda c: start + (end - start) * (c / total)
    last = F.lead(F.lit(1)).over(w).isNull()
    return parts.withColumns({"part_start": place(up - weight), "part_end": F.when(last, end).otherwise(place(up))})


def redistribute(notes: DataFrame, key: list[str], order: list[str], start: str, end: str, target: float = 0.100, most: float = 0.120) -> DataFrame:
    """Lengthens notes under ``target`` at the cost of longer ones of the same contiguous group; no border moves over ``most``.

    Adds new_start and new_end. A group without excess or deficit stays."""
    w, whole = _window(key, order), W.partitionBy(*key)
    length = F.col(end) - F.col(start)
    deficit, excess = F.greatest(F.lit(target) - length, F.lit(0.0)), F.greatest(length - F.lit(target), F.lit(0.0))
    d = notes.withColumns({"_l": length, "_d": deficit, "_x": excess}).withColumns({"_all_d": F.sum("_d").over(whole), "_all_x": F.sum("_x").over(whole), "_a": F.min(start).over(whole)})
    gain = F.least("_all_d", "_all_x")
    new = F.when((F.col("_all_d") > 0) & (F.col("_all_x") > 0), F.col("_l") + F.col("_d") / F.col("_all_d") * gain - F.col("_x") / F.col("_all_x") * gain).otherwise(F.col("_l"))
    up = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("_n", new).withColumns({"_e": F.col("_a") + F.sum("_l").over(up), "_p": F.col("_a") + F.sum("_n").over(up)})
    shift = F.max(F.abs(F.col("_p") - F.col("_e"))).over(whole)
    factor = F.when(shift > 0, F.least(F.lit(1.0), F.lit(most) / shift)).otherwise(F.lit(1.0))
    d = d.withColumn("new_end", F.col("_e") + factor * (F.col("_p") - F.col("_e")))
    return d.withColumn("new_start", F.coalesce(F.lag("new_end").over(w), F.col("_a"))).drop("_l", "_d", "_x", "_all_d", "_all_x", "_a", "_n", "_e", "_p")
