"""Syllables of timed words: their limits, and the part of each that is sung on a pitch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.binding import bind
from tessitura.operators import intervals

#: Vowels of the languages that are sung.
VOWELS = "aeiouyáàâãäéèêëíìîïóòôõöúùûüAEIOUYÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜ"
SYLLABLE_FLOOR, FLOOR_SHARE, CONSONANT, CHAR_SCORE = 0.060, 0.45, 0.12, 0.30
REACH, EVENT, ONSET_SLACK = 0.100, 0.45, 0.020
QUIET, RELATIVE_QUIET, PERIODIC, BRIDGE, PAUSE, CORE_FLOOR, THIN = 1e-4, 0.04, 0.55, 0.040, 0.150, 0.030, 0.30


def syllable_parts(word: Column, exceptions: dict[str, list[str]] | None = None, language: str = "pt_BR") -> Column:
    """The parts of a word, its case kept: an exception, else hyphenation where that library is installed, else the whole word."""
    known = {k.lower(): v for k, v in (exceptions or {}).items()}
    for k, v in known.items():
        if "".join(v).lower() != k:
            raise ValueError(f"the parts of {k!r} do not spell it")

    @F.arrow_udf("array<string>")
    def run(words: pa.Array) -> pa.Array:
        try:
            import pyphen

            cut = pyphen.Pyphen(lang=language)
        except ImportError:
            cut = None
        done: dict[str, list[str]] = {}
        for w in words.to_pylist():
            if w is None or w in done:
                continue
            parts = known.get(w.lower()) or (cut.inserted(w.lower(), "\0").split("\0") if cut else [w])
            ends = [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
            done[w] = [w[a:b] for a, b in zip([0, *ends], ends, strict=False)] if ends[-1] == len(w) else [w]
        return pa.array([None if w is None else done[w] for w in words.to_pylist()], pa.list_(pa.string()))

    return run(word)


def refined(target: Column, low: Column, high: Column, frames: Column) -> Column:
    """(at, refined): the frame within ``REACH`` of the target and within [low, high] where flux is high and energy low, less for
    distance, if it is event enough; else the target. frames: array<struct<t,rms,flux>> in order of t, or null."""
    near = F.filter(frames, lambda f: (f["t"] >= F.greatest(low, target - REACH)) & (f["t"] <= F.least(high, target + REACH)))

    def best(n: Column) -> Column:
        loudest = F.array_max(F.transform(n, lambda f: f["rms"]))

        def scored(level: Column) -> Column:
            event = lambda f: 0.6 * f["flux"] + 0.4 * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), f["rms"] / level)))
            return F.when(level.isNotNull(), F.array_max(F.transform(n, lambda f: F.struct((event(f) - 0.3 * F.abs(f["t"] - target) / REACH).alias("v"), (-f["t"]).alias("t"), event(f).alias("event")))))

        return bind(F.when(loudest > QUIET, loudest), scored)

    return bind(bind(near, best), lambda b: F.struct(F.when(b["event"] >= EVENT, -b["t"]).otherwise(target).alias("at"), F.coalesce(b["event"] >= EVENT, F.lit(False)).alias("refined")))


_LIMITS = "struct<last:double,limits:array<double>,origins:array<string>>"


def syllable_limits(words: DataFrame) -> DataFrame:
    """``words`` with limits (one more than parts) and origins (of each limit): caption, characters or proportional, and +refined.

    words: start, end, original_end (null if nothing was added at the end), parts, onsets array<struct<start,end>> (times of
    usable letters, null where none; null if the letters do not spell the word), frames (see ``refined``).
    Each limit leaves the syllables on both sides their least time. The onset of the next syllable is preferred; else
    the time is shared by vowels and, less, consonants. What was added to the end of a word lengthens its last syllable only."""
    until = F.coalesce(F.when(F.col("end") > F.col("original_end") + 1e-9, F.col("original_end")), F.col("end"))
    weights = F.transform("parts", lambda p: 1 + CONSONANT * F.char_length(F.translate(p, VOWELS, "")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    letters = F.transform("parts", lambda p: F.char_length(p))
    base = words.withColumns({"_until": until, "_n": F.size("parts"), "_weights": weights, "_letters": letters})
    base = base.withColumn("_floor", F.least(F.lit(SYLLABLE_FLOOR), (F.col("_until") - F.col("start")) / F.col("_n") * FLOOR_SHARE))

    def step(acc, i):
        low, high = acc["last"] + F.col("_floor"), F.col("_until") - (F.col("_n") - i) * F.col("_floor")
        at = F.aggregate(F.slice("_letters", 1, i), F.lit(0), lambda s, x: s + x)
        before, after = F.get("onsets", at - 1), F.get("onsets", at)
        usable = F.coalesce((before["end"] <= after["start"] + ONSET_SLACK) & (after["start"] >= low) & (after["start"] <= high), F.lit(False))
        shared = F.col("start") + (F.col("_until") - F.col("start")) * total(F.slice("_weights", 1, i)) / total(F.col("_weights"))
        target = F.least(F.greatest(F.when(usable, after["start"]).otherwise(shared), low), high)
        origin = F.when(usable, "characters").otherwise("proportional")

        def put(r):
            return F.struct(r["at"].alias("last"), F.concat(acc["limits"], F.array(r["at"])).alias("limits"), F.concat(acc["origins"], F.array(F.when(r["refined"], F.concat(origin, F.lit("+refined"))).otherwise(origin))).alias("origins")).cast(_LIMITS)

        return bind(bind(target, lambda t: refined(t, low, high, F.col("frames"))), put)

    first = F.struct(F.col("start").cast("double").alias("last"), F.array(F.col("start")).alias("limits"), F.array(F.lit("caption")).alias("origins")).cast(_LIMITS)
    places = F.when(F.col("_n") > 1, F.sequence(F.lit(1), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    walked = base.where("_n > 0 and end > start").withColumn("_w", F.aggregate(places, first, step))
    done = walked.withColumns({"limits": F.concat("_w.limits", F.array(F.col("end").cast("double"))), "origins": F.concat("_w.origins", F.array(F.lit("caption")))})
    return done.drop("_until", "_n", "_weights", "_letters", "_floor", "_w")


def cores(syllables: DataFrame, frames: DataFrame, key: list[str], step: float = 0.010, width: float = 0.25) -> DataFrame:
    """(key, core_start, core_end, core_source, coverage, core_warnings): the part of each syllable that is sung on a pitch.

    syllables: song_id, rest of key, start, end, vowels array<struct<start,end>>; frames: song_id, t, rms, per.
    Of the runs of audible periodic frames (short periodic gaps with sound are bridged) the one that is longest counts, where
    it overlaps vowels twice. Without frames the vowels' letters count, else the middle of the syllable."""
    own = syllables.select(*key, "start", "end", "vowels")
    inside = intervals.points_in_intervals(frames.select("song_id", "t", "rms", "per"), own, ["song_id"], "t", "start", "end", width)
    whole = W.partitionBy(*key)
    active = F.col("rms") >= F.greatest(F.lit(QUIET), F.percentile("rms", F.lit(0.9)).over(whole) * RELATIVE_QUIET)
    heard = inside.withColumn("active", active).withColumn("periodic", F.col("active") & (F.col("per") >= PERIODIC))
    bridged = intervals.bridge(heard, key, ["t"], "periodic", "active", int(BRIDGE / step + 1e-9), "sung")
    runs = intervals.runs(intervals.runs(bridged, key, ["t"], F.col("sung"), "_r"), key, ["t"], F.col("active"), "_a")
    regions = runs.where("sung").groupBy(*key, "_r").agg(
        F.greatest(F.first("start"), F.min("t") - step / 2).alias("x"), F.least(F.first("end"), F.max("t") + step / 2).alias("y"), F.first("start").alias("s"), F.first("end").alias("e"), F.first("vowels").alias("v")
    ).where(F.col("y") - F.col("x") >= F.least(F.lit(CORE_FLOOR), (F.col("e") - F.col("s")) * 0.4))
    covered = F.aggregate(F.coalesce("v", F.array().cast("array<struct<start:double,end:double>>")), F.lit(0.0), lambda a, u: a + F.greatest(F.lit(0.0), F.least(F.col("y"), u["end"]) - F.greatest(F.col("x"), u["start"])))
    best = regions.withColumn("_b", F.struct((F.col("y") - F.col("x") + covered).alias("worth"), "x", "y")).groupBy(*key).agg(F.max("_b").alias("b"), F.count("*").alias("regions"))
    silent = runs.where(~F.col("active")).groupBy(*key, "_a").agg(F.count("*").alias("n")).groupBy(*key).agg((F.max("n") * step >= PAUSE - 1e-9).alias("paused"))
    seen = heard.groupBy(*key).agg(F.avg(F.col("periodic").cast("double")).alias("coverage"))
    joined = own.join(seen, key, "left").join(best, key, "left").join(silent, key, "left")
    length = F.col("end") - F.col("start")
    low, high = F.array_min(F.transform("vowels", lambda v: v["start"])), F.array_max(F.transform("vowels", lambda v: v["end"]))
    spelled = F.coalesce(F.col("coverage").isNull() & (high - low >= F.least(F.lit(CORE_FLOOR), length * 0.4)), F.lit(False))
    sung = F.col("b").isNotNull()
    warnings = F.array_compact(F.array(
        F.when(F.coalesce("paused", F.lit(False)), "long_low_energy"), F.when(F.col("regions") > 1, "several_periodic_regions"),
        F.when(F.col("coverage").isNotNull() & ~sung, "no_periodic_core"), F.when(F.col("coverage").isNull(), "core_without_audio"),
    ))
    return joined.select(
        *key, F.when(sung, F.col("b.x")).when(spelled, low).otherwise(F.col("start") + 0.2 * length).alias("core_start"), F.when(sung, F.col("b.y")).when(spelled, high).otherwise(F.col("end") - 0.1 * length).alias("core_end"),
        F.when(sung, "periodic").when(spelled, "characters").otherwise("proportional").alias("core_source"), "coverage", warnings.alias("core_warnings"),
    )


def syllables(words: DataFrame, frames: DataFrame, parts: Column, step: float = 0.010) -> DataFrame:
    """One row for each syllable: song_id, word_id, no, ord, text, start, end, core_start, core_end, score, origin, core_source, coverage, warnings.

    words: song_id, word_id, ord, text, start, end, original_end, score, chars array<struct<char,start,end,score>> that spell
    the word (empty if they do not), warnings; frames: song_id, t, rms, per, flux; ``parts``: an expression such as
    ``syllable_parts``. Estimated limits and cores cap the score at 0.25."""
    key = ["song_id", "word_id"]
    near = intervals.points_in_intervals(frames.select("song_id", "t", "rms", "flux"), words.select(*key, "start", (F.col("end") + 1e-6).alias("end")), ["song_id"], "t", "start", "end", 0.25)
    framed = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "rms", "flux"))).alias("frames"))
    usable = lambda c: F.when((c["score"] >= CHAR_SCORE) & (c["start"] < c["end"]) & (c["start"] >= F.col("start") - 1e-6) & (c["end"] <= F.col("end") + 1e-6), F.struct(c["start"].alias("start"), c["end"].alias("end")))
    limited = syllable_limits(words.withColumn("parts", parts).join(framed, key, "left").withColumn("onsets", F.transform("chars", usable)))
    n = F.size("parts")
    upto = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda s, p: s + F.char_length(p))
    rows = F.transform("parts", lambda p, i: F.struct(
        (i + 1).alias("no"), p.alias("text"), F.get("limits", i).alias("start"), F.get("limits", i + 1).alias("end"), F.slice("chars", upto(i) + 1, F.char_length(p)).alias("own"),
        F.array_sort(F.array_distinct(F.filter(F.array(F.when(i > 0, F.get("origins", i)), F.when(i + 1 < n, F.get("origins", i + 1))), lambda o: o.isNotNull()))).alias("from"),
    ))
    one = limited.select(*key, F.col("ord").alias("_o"), F.col("end").alias("_e"), F.col("start").alias("_s"), F.col("original_end").alias("_added"), n.alias("_n"), F.col("score").alias("_score"), F.col("warnings").alias("_w"), F.explode(rows).alias("x")).select(*key, "_o", "_e", "_s", "_added", "_n", "_score", "_w", "x.*")
    vowel = lambda c: c["char"].isin(*VOWELS) & (c["score"] >= CHAR_SCORE) & (c["start"] < c["end"]) & (c["start"] >= F.col("start") - 1e-6) & (c["end"] <= F.col("end") + 1e-6)
    one = one.withColumn("vowels", F.transform(F.filter("own", vowel), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    whole = one.join(cores(one, frames, [*key, "no"], step), [*key, "no"])
    valid = F.transform(F.filter("own", lambda c: c["score"].isNotNull() & ~F.isnan(c["score"])), lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c["score"])))
    mean = F.coalesce(F.aggregate(valid, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(valid), F.lit(0)), F.col("_score"), F.lit(0.0))
    origin = F.when(F.size("from") == 0, F.lit("whole_word")).otherwise(F.array_join("from", "|"))
    estimated = F.array_join("from", "|").contains("proportional")
    length = F.col("end") - F.col("start")
    named = [
        (F.lit(True), "core_warnings"), (F.lit(True), "_w"), ((F.col("no") == F.col("_n")) & (F.col("_added") < F.col("_e") - 1e-9), "sustained_end"), (estimated, "estimated_limit"), (length < SYLLABLE_FLOOR - 1e-9, "short_syllable"),
        (mean < CHAR_SCORE, "low_score"), (F.col("coverage") < THIN, "thin_coverage"), ((F.col("_n") > 1) & (length / (F.col("_e") - F.col("_s")) > 0.9), "very_uneven"),
    ]
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(t), none) if t in ("core_warnings", "_w") else F.when(c, F.array(F.lit(t))).otherwise(none) for c, t in named]
    lists = [F.coalesce(x, none) for x in lists]
    capped = F.when(estimated | (F.col("core_source") == "proportional"), F.least(mean, F.lit(0.25))).otherwise(mean)
    ordinal = F.row_number().over(W.partitionBy("song_id").orderBy("_o", "no"))
    return whole.select(*key, "no", ordinal.alias("ord"), "text", "start", "end", "core_start", "core_end", capped.alias("score"), origin.alias("origin"), "core_source", "coverage", F.array_distinct(F.concat(*lists)).alias("warnings"))
