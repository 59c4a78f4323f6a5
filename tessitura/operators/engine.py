"""Recognition engines as table functions: windows go in by a lateral join, what an engine hears in them comes out as rows.

An engine is any picklable object with ``name``, ``hear(song_id, start, end,
language)`` and ``languages(song_id, start, end)``; it runs in Python workers,
one window at a time. The library has no model of its own: ``Recorded`` answers
from a table of what a model once said.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions import language as L
from tessitura.functions.shared import written
from tessitura.operators import intervals, sound, words

HEARD = "seg_start double, seg_end double, text string, avg_logprob double, no_speech double, compression double, tokens int"
LANGUAGES = ("pt", "en")


class Engine(Protocol):
    """What the table functions ask; times are seconds within the song, segments are told from the begin of the window."""

    name: str

    def hear(self, song_id: str, start: float, end: float, language: str):
        """(seg_start, seg_end, text, avg_logprob, no_speech, compression, tokens) of each segment heard."""

    def languages(self, song_id: str, start: float, end: float) -> dict[str, float]:
        """The probability of each language."""


@dataclass
class Recorded:
    """An engine that repeats answers: of (song_id, start ms, end ms, language) to segments, of (song_id, start ms, end ms) to probabilities.

    A window without an answer has no segments, and no language is likely. The answers go to every worker; a record that
    is too large for that is a table, and a join with it."""

    segments: dict[tuple, list[tuple]] = field(default_factory=dict)
    likely: dict[tuple, dict[str, float]] = field(default_factory=dict)
    name: str = "recorded"

    @staticmethod
    def key(song_id, start: float, end: float, *rest) -> tuple:
        return (song_id, round(start * 1000), round(end * 1000), *rest)

    def hear(self, song_id, start, end, language):
        return self.segments.get(self.key(song_id, start, end, language), [])

    def languages(self, song_id, start, end):
        return self.likely.get(self.key(song_id, start, end), {})


def hearing(engine: Engine):
    """``engine.hear`` as a table function (song_id, start, end, language) to rows of HEARD."""

    @F.udtf(returnType=HEARD)
    class Hear:
        def eval(self, song_id: str, start: float, end: float, language: str):
            for segment in engine.hear(song_id, start, end, language):
                yield tuple(segment)

    return Hear


def guessing(engine: Engine):
    """``engine.languages`` as a table function (song_id, start, end) to one row: a map of probabilities."""

    @F.udtf(returnType="likely map<string,double>")
    class Guess:
        def eval(self, song_id: str, start: float, end: float):
            yield (dict(engine.languages(song_id, start, end)),)

    return Guess


def register(spark, engine: Engine) -> None:
    """Both functions for SQL: ``SELECT ... FROM windows w, LATERAL hear(w.song_id, w.start, w.end, 'pt')``, and ``likely``."""
    spark.udtf.register("hear", hearing(engine))
    spark.udtf.register("likely", guessing(engine))


def ask(windows: DataFrame, engine: Engine, languages=LANGUAGES) -> tuple[DataFrame, DataFrame]:
    """(segments, guesses) of ``windows`` (song_id, start, end): each is asked once in each language and once for its languages.

    A window in which nothing is heard has no segments. Both are written to the shared folder, so that what is read from them later never asks again."""
    own = [F.col(c).outer() for c in ("song_id", "start", "end")]
    asked = windows.withColumn("language", F.explode(F.array(*map(F.lit, languages))))
    heard = asked.lateralJoin(hearing(engine)(*own, F.col("language").outer()))
    guessed = windows.lateralJoin(guessing(engine)(*own))
    return written(heard, "heard"), written(guessed, "guessed")


def judged(windows: DataFrame, segments: DataFrame, guesses: DataFrame, voice: DataFrame, languages=LANGUAGES) -> DataFrame:
    """``windows`` (song_id, level, start, end) with what decides on them: the winning hypothesis, why, its votes, and the probabilities."""
    key = ["song_id", "start", "end"]
    per = [*key, "language"]
    asked = windows.select(*key, F.explode(F.array(*map(F.lit, languages))).alias("language"))
    rolled = L.roll_up_hypothesis(segments, per)
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seg_start", "seg_end", "text")))), lambda x: x["text"])
    texts = segments.groupBy(*per).agg(F.trim(F.array_join(pieces, " ")).alias("text"))
    evidence = guesses.select(*key, "likely", L.acoustic_evidence(F.col("likely")).alias("heard"))
    voiced = intervals.overlapping(windows, voice, ["song_id"], "start", "end").select(*key, F.col("overlaps").alias("has_voice"))
    known = asked.join(texts, per, "left").join(rolled, per, "left").fillna({"text": "", "avg_logprob": -10.0, "no_speech": 1.0, "compression": 0.0})
    hypotheses = known.join(evidence, key).join(voiced, key)
    won = L.choose_hypothesis(hypotheses, key)
    said = won.join(texts.select(*key, F.col("language").alias("winner"), "text"), [*key, "winner"], "left")
    voted = said.withColumn("votes", L.votes(F.coalesce("text", F.lit(""))))
    told = voted.join(evidence, key).select(
        *key, "winner", "reason", "review", "text", F.col("votes.pt").alias("pt_votes"), F.col("votes.en").alias("en_votes"),
        *[F.coalesce(F.element_at("likely", x), F.lit(0.0)).alias(f"{x}_prob") for x in LANGUAGES],
        F.coalesce(F.col("heard.strong"), F.lit(False)).alias("strong"), F.col("heard.language").alias("heard"),
    )
    return windows.join(told, key)


def recognise(windows: DataFrame, signals: DataFrame, voice: DataFrame, engine: Engine, least: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """(segments, audit): ``windows`` (song_id, start, end) heard in both languages, unsure ones again in two parts.

    Windows over ``least`` seconds whose language is unsure are cut where ``signals`` (song_id, samples, rate) are
    quietest, and their parts are asked in turn; the parent is dropped by an anti-join, so no stretch is heard twice in
    the result. The loop has two levels, and every window is asked once. segments: song_id, start, end (in the song),
    text, language, window_start; a window whose segments have no valid times in order is one segment with its whole
    text. audit: all windows, ``used`` or not, with their decision."""
    level, parts = windows.select("song_id", F.lit(0).alias("level"), "start", "end"), []
    for last in (False, True):
        level = written(level, "windows")
        heard, guessed = ask(level.select("song_id", "start", "end"), engine)
        audit = written(judged(level, heard, guessed, voice), "judged")
        split = audit.limit(0) if last else words.split_windows(audit, least)
        used = audit.join(split.select("song_id", "start", "end"), ["song_id", "start", "end"], "left_anti")
        parts.append((heard, audit, used))
        level = sound.child_windows(split, signals).select("song_id", F.col("level").cast("int"), "start", "end")
    key = ["song_id", "start", "end"]
    audits = [a.join(u.select(*key, F.lit(True).alias("used")), key, "left").withColumn("used", F.coalesce("used", F.lit(False))) for _, a, u in parts]
    out = [placed_segments(h, u) for h, _, u in parts]
    return out[0].unionByName(out[1]), audits[0].unionByName(audits[1])


def placed_segments(heard: DataFrame, used: DataFrame) -> DataFrame:
    """Segments of the winning language of each used window, at their place in the song.

    A segment without text is left out; if one has no valid times after the one before, the window's whole text stands for all."""
    key = ["song_id", "start", "end"]
    won = heard.join(used.select(*key, F.col("winner").alias("language"), F.col("text").alias("whole")), [*key, "language"]).where(F.length("text") > 0)
    length = F.col("end") - F.col("start")
    seg = F.struct("seg_start", F.least(F.col("seg_end"), length).alias("seg_end"), "text")
    lists = won.groupBy(*key, "language", "whole").agg(F.array_sort(F.collect_list(seg)).alias("s"))
    ms = lambda c: F.rint(c * 1000)
    valid = F.forall(
        F.transform("s", lambda x, i: F.coalesce(~F.isnan(x["seg_start"]) & ~F.isnan(x["seg_end"]) & (ms(x["seg_start"]) >= 0) & (ms(x["seg_start"]) < ms(x["seg_end"])) & ((i == 0) | (ms(x["seg_start"]) >= ms(F.get("s", i - 1)["seg_end"]))), F.lit(False))),
        lambda ok: ok,
    )
    one = F.array(F.struct(F.lit(0.0).alias("seg_start"), length.alias("seg_end"), F.col("whole").alias("text")))
    each = lists.withColumn("approximate", ~valid).select(*key, "language", "approximate", F.explode(F.when(valid, F.col("s")).otherwise(one)).alias("x"))
    return each.select("song_id", (F.col("start") + F.col("x.seg_start")).alias("start"), (F.col("start") + F.col("x.seg_end")).alias("end"), F.col("x.text").alias("text"), "language", "approximate", F.col("start").alias("window_start"))


def languages_of(segments: DataFrame, durations: DataFrame, engine: Engine, short: float = 2.5, reach: float = 3.0) -> DataFrame:
    """``segments`` (song_id, start, end, text) with what language each is, from its text, its sound and, where those are weak, the sound around it.

    Short segments, weak sound and text that differs from it are heard again with ``reach`` seconds to each side of their
    middle, within the song (durations: song_id, duration). Adds choice (language, source, text_differs, review),
    confidence (of that language in the segment's own sound) and wide_start, wide_end (null: not heard again). Running the
    plan fails for a segment outside its song."""
    a, b = F.col("start"), F.col("end")
    own = segments.join(durations, "song_id")
    wrong = F.coalesce(~((a >= 0) & (a < b) & (b <= F.col("duration") + 0.005)), F.lit(True))
    own = own.withColumn("start", F.when(wrong, F.raise_error(F.lit("a segment has no valid times")).cast("double")).otherwise(a))
    guess = lambda df, start, end, into: df.lateralJoin(guessing(engine)(F.col("song_id").outer(), F.col(start).outer(), F.col(end).outer())).withColumnRenamed("likely", into)
    near = written(guess(own, "start", "end", "near"), "near").withColumn("local", L.acoustic_evidence(F.col("near")))
    voted = near.withColumn("votes", L.votes(F.coalesce("text", F.lit("")))).withColumn("said", L.textual_evidence(F.col("votes.pt"), F.col("votes.en")))
    differs = F.col("said.language").isNotNull() & (F.col("said.language") != F.col("local.language"))
    middle = (a + b) / 2
    low, high = F.greatest(F.lit(0.0), F.least(a, middle - reach)), F.least(F.col("duration"), F.greatest(b, middle + reach))
    again = ((b - a < short) | ~F.col("local.strong") | differs) & (high - low > b - a + 0.01)
    placed = voted.withColumns({"wide_start": F.when(again, low), "wide_end": F.when(again, high)})
    key = ["song_id", "wide_start", "wide_end"]
    wide = guess(placed.where("wide_start IS NOT NULL").select(*key).distinct(), "wide_start", "wide_end", "far")
    heard = placed.join(written(wide, "wide"), key, "left").withColumn("wide", L.acoustic_evidence(F.col("far")))
    chosen = heard.withColumn("choice", L.select_language(F.col("said"), F.col("local"), F.col("wide")))
    confidence = F.coalesce(F.element_at("near", F.col("choice.language")), F.lit(0.0))
    return chosen.select(*segments.columns, "choice", confidence.alias("confidence"), "wide_start", "wide_end")
