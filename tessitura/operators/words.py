"""Words and characters: what of a model's times can be used, neighbours of words, and the results of a run."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD_SCORE = CHAR_SCORE = 0.30
WORD_FLOOR, PERIODIC = 0.005, 0.55


# --- predicates and projections


def pitch_frames(frames: DataFrame, probability: float = 0.20) -> DataFrame:
    """Frames with a finite pitch that is probably voiced."""
    return frames.where((F.col("voiced_prob") >= probability) & F.col("midi").isNotNull() & ~F.isnan("midi") & (F.abs("midi") < float("inf")))


def accepted(start: Column, end: Column, score: Column, low: Column, high: Column, floor: float = WORD_FLOOR) -> Column:
    """Whether a model's word time can be used inside [low, high]."""
    return F.coalesce((start >= low) & (start < end) & (end <= high) & (end - start >= floor) & (score >= WORD_SCORE), F.lit(False))


def usable_chars(chars: Column, start: Column, end: Column) -> Column:
    """Character times with a sufficient score that lie inside the word; none is clipped."""
    return F.filter(chars, lambda c: (c["score"] >= CHAR_SCORE) & (c["start"] < c["end"]) & (c["start"] >= start - 1e-6) & (c["end"] <= end + 1e-6))


def lexical_chars(chars: Column) -> Column:
    return F.filter(chars, lambda c: c["char"].rlike(r"^[\p{L}\p{N}]$"))


def spelling_chars(chars: Column, word: Column) -> Column:
    """The lexical characters if they spell the word (case aside), else none."""
    own = lexical_chars(chars)
    same = F.lower(F.array_join(F.transform(own, lambda c: c["char"]), "")) == F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))
    return F.when(same, own).otherwise(F.filter(own, lambda c: F.lit(False)))


def mean_score(chars: Column, fallback: Column) -> Column:
    """Mean of the clipped scores, else the fallback, else 0."""
    scores = F.transform(F.filter(chars, lambda c: c["score"].isNotNull() & ~F.isnan(c["score"])), lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c["score"])))
    return F.coalesce(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0)), fallback, F.lit(0.0))


def silent(rms: Column, floor: Column, limit: Column, periodicity: Column, periodic: float = 0.30) -> Column:
    return (rms <= floor) | ((rms <= limit) & (periodicity < periodic))


def fitting(is_silent: Column, periodicity: Column, timbre_distance: Column, periodic: float = PERIODIC, most: float = 0.35) -> Column:
    return ~is_silent & (periodicity >= periodic) & (timbre_distance <= most)


def flatten_chars(segments: Column) -> Column:
    """The characters of all segments, with a space where one segment meets the next."""
    space = lambda s: F.struct(F.lit(" ").alias("char"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("double").alias("score"))
    joined = F.flatten(F.transform(F.filter(segments, lambda s: F.size(s["chars"]) > 0), lambda s, i: F.when(i > 0, F.concat(F.array(space(s)), s["chars"])).otherwise(s["chars"])))
    return F.coalesce(joined, F.filter(joined, lambda c: F.lit(False)))


def flatten_words(segments: Column, word_segments: Column) -> Column:
    """The model's word list if there is one, else the words of all segments."""
    return F.coalesce(word_segments, F.flatten(F.transform(segments, lambda s: s["words"])))


def chars_to_words(chars: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """(key, word_no, text, start, end): a stream of characters split at white space."""
    spaces = F.sum(F.col("char").rlike(r"^\s").cast("int")).over(W.partitionBy(*key).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow))
    own = chars.withColumn("_n", spaces).where(~F.col("char").rlike(r"^\s"))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "char"))), lambda c: c["char"]), "")
    words = own.groupBy(*key, "_n").agg(spelled.alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))
    return words.withColumn("word_no", F.row_number().over(W.partitionBy(*key).orderBy("_n"))).drop("_n")


def warn(warnings: Column, text: str, when: Column) -> Column:
    """Adds a warning once."""
    return F.when(when, F.array_union(F.coalesce(warnings, F.array().cast("array<string>")), F.array(F.lit(text)))).otherwise(warnings)


def text_slice(text: Column, offsets: Column, first: Column, after: Column) -> Column:
    """The text from the start of token ``first`` to the start of token ``after``, spaces collapsed; offsets: start of each token (from 0)."""
    begin = F.get(offsets, first)
    end = F.coalesce(F.get(offsets, after), F.char_length(text))
    return F.trim(F.regexp_replace(F.substring(text, begin + 1, end - begin), r"\s+", " "))


def nearest_anchors(words: DataFrame, key: list[str], order: list[str], least: float = WORD_SCORE) -> DataFrame:
    """``words`` with the end of the sure word before and the start of the sure word after each."""
    w = W.partitionBy(*key).orderBy(*order)
    sure = F.col("score") >= least
    before = F.last(F.when(sure, F.col("end")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(F.when(sure, F.col("start")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return words.withColumns({"anchor_before": before, "anchor_after": after})


def wider_window(units: DataFrame, key: list[str], order: list[str], block: str, margin: float = 0.120) -> DataFrame:
    """``units`` with a window around each, no wider than the neighbours of the same block allow."""
    w = W.partitionBy(*key).orderBy(*order)
    left = F.when(F.lag(block).over(w) == F.col(block), F.lag("end").over(w))
    right = F.when(F.lead(block).over(w) == F.col(block), F.lead("start").over(w))
    return units.withColumns({"window_start": F.greatest(F.lit(0.0), F.col("start") - margin, F.coalesce(left, F.lit(0.0))), "window_end": F.least(F.col("end") + margin, F.coalesce(right, F.col("end") + margin))})


def short_orphans(captions: DataFrame) -> DataFrame:
    """Captions of at most two words and one second that stand nowhere in the lyric."""
    return captions.where("token_start is null and n_words <= 2 and end - start <= 1.0")


def alignment_problem(words: DataFrame, key: list[str], order: list[str], low: Column, high: Column, least: Column) -> DataFrame:
    """(key, problem): the first rule that a song's returned words break. words: expected, found, start, end, score."""
    w = W.partitionBy(*key).orderBy(*order)
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    broken = lambda rank, rule: F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"))
    bad = (
        F.when(~F.col("expected").eqNullSafe(F.col("found")), broken(0, "words_differ"))
        .when(~(number("start") & number("end") & number("score")), broken(1, "no_time_or_score"))
        .when((F.col("start") < low) | (F.col("start") >= F.col("end")) | (F.col("end") > high) | (F.col("start") < F.lag("end").over(w) - 1e-6), broken(1, "invalid_or_overlapping_times"))
        .when((F.col("score") < least) | (F.col("score") > 1), broken(1, "score_too_low"))
        .when(F.rint(F.col("end") * 1000) <= F.rint(F.col("start") * 1000), broken(1, "shorter_than_a_millisecond"))
    )
    place = F.row_number().over(w)
    found = words.withColumn("_b", bad).withColumn("_r", F.struct(F.col("_b.rank"), place))
    return found.groupBy(*key).agg(F.min_by("_b.rule", F.when(F.col("_b").isNotNull(), F.col("_r"))).alias("problem"))


# --- groups and results


def contiguous_groups(notes: DataFrame, key: list[str], order: list[str], word: str, block: str, start: str, end: str, name: str = "group_no") -> DataFrame:
    """``notes`` with a number shared by neighbours of one word and block without a gap."""
    w = W.partitionBy(*key).orderBy(*order)
    new = F.coalesce((F.lag(word).over(w) != F.col(word)) | (F.lag(block).over(w) != F.col(block)) | (F.abs(F.col(start) - F.lag(end).over(w)) > 1e-9), F.lit(True))
    return notes.withColumn(name, F.sum(new.cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def consolidate(kept: DataFrame, corrected: DataFrame, inserted: DataFrame, key: list[str]) -> DataFrame:
    """Published captions: kept ones, those with corrected text, and insertions, with their origin; ``problem`` marks overlap in milliseconds."""
    fixed = corrected.select(*key, "idx", F.col("text").alias("_text"))
    base = kept.join(fixed, [*key, "idx"], "left").withColumn("origin", F.when(F.col("_text").isNotNull(), "corrected").otherwise("kept")).withColumn("text", F.coalesce("_text", "text")).drop("_text")
    whole = base.unionByName(inserted.withColumn("origin", F.lit("inserted")), allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy("start", "end", "origin")
    return whole.withColumn("problem", F.when(F.rint(F.col("start") * 1000) < F.rint(F.lag("end").over(w) * 1000), "overlap"))


def run_metrics(published: DataFrame, key: list[str], gaps: DataFrame | None = None) -> DataFrame:
    """Counters of a run: published captions by origin and overlaps; with gaps (key, reason, state, asked, recovered, weak) also unsearched and recovered tokens."""
    out = published.groupBy(*key).agg(F.count("*").alias("published"), *[F.count_if(F.col("origin") == o).alias(o) for o in ("kept", "corrected", "inserted")], F.count_if(F.col("problem").isNotNull()).alias("overlaps"))
    if gaps is None:
        return out
    sums = gaps.groupBy(*key).agg(F.sum(F.when(F.col("reason").isNotNull(), F.col("asked")).otherwise(0)).alias("unsearched"), F.sum("recovered").alias("recovered"), F.sum(F.col("asked") - F.col("recovered")).alias("untimed"), F.sum("weak").alias("low_confidence"), *[F.count_if(F.col("state") == x).alias(f"gaps_{x}") for x in ("none", "partial", "full")])
    return out.join(sums, key, "left")


def split_windows(audited: DataFrame, least: float = 12.0) -> DataFrame:
    """Windows to listen to again in two parts: both languages likely, mixed text, or text against strong audio. Only first-level windows over ``least`` seconds."""
    share = F.least("pt_votes", "en_votes") / F.greatest(F.lit(1), F.col("pt_votes") + F.col("en_votes"))
    unsure = (F.least("pt_prob", "en_prob") >= 0.15) | ((F.least("pt_votes", "en_votes") >= 2) & (share >= 0.2)) | (F.col("strong") & (F.col("winner") != F.col("heard")))
    return audited.where((F.col("level") == 0) & F.col("winner").isNotNull() & unsure & (F.col("end") - F.col("start") > least))


def named_words(notes: DataFrame, words: DataFrame, key: list[str], word_id: str = "word_id", text: str = "text", into: str = "word") -> DataFrame:
    """``notes`` with the text of their word, or its id where the word is not known."""
    known = words.select(*key, F.col(word_id), F.col(text).alias("_text")).dropDuplicates([*key, word_id])
    return notes.join(known, [*key, word_id], "left").withColumn(into, F.coalesce("_text", word_id)).drop("_text")


def model_of_line(tokens: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos, start, end, score): for each token (key, pos, language) the time that the model of its line's language found (key, pos, language, start, end, score)."""
    return tokens.join(results, [*key, "pos", "language"], "left").select(*tokens.columns, "start", "end", "score")


def refinement_windows(chosen: DataFrame, key: list[str], low: Column, high: Column) -> DataFrame:
    """(key, language, first, last, low, high): runs of tokens of one language with the sure neighbours that bound them; for songs with several languages.

    chosen: key, pos, language, start, end, score."""
    from tessitura.operators import intervals

    w = W.partitionBy(*key).orderBy("pos")
    sure = F.col("score") >= WORD_SCORE
    marked = intervals.runs(chosen, key, ["pos"], F.col("language"), "_run").withColumns({
        "_before": F.last(F.when(sure, F.col("end")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
        "_after": F.first(F.when(sure, F.col("start")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)),
        "_kinds": F.size(F.collect_set("language").over(W.partitionBy(*key))),
    })
    got = marked.where("_kinds > 1").groupBy(*key, "_run", "language").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.coalesce(F.min_by("_before", "pos"), F.first(low)).alias("low"), F.coalesce(F.max_by("_after", "pos"), F.first(high)).alias("high")
    )
    return got.where("low < high").drop("_run")


def similarity(reference: Column, heard: Column) -> Column:
    """A struct of ratio (twice the matched words over all words) and differences (kind, reference, heard) of two texts, word by word, case aside."""
    @F.arrow_udf("struct<ratio:double,differences:array<struct<kind:string,reference:string,heard:string>>>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        import re
        from difflib import SequenceMatcher

        rows = []
        for one, other in zip(left.to_pylist(), right.to_pylist(), strict=True):
            a, b = (re.findall(r"\w+", (x or "").casefold()) for x in (one, other))
            match = SequenceMatcher(None, a, b, autojunk=False)
            rows.append({"ratio": match.ratio(), "differences": [{"kind": kind, "reference": " ".join(a[i:j]), "heard": " ".join(b[k:n])} for kind, i, j, k, n in match.get_opcodes() if kind != "equal"]})
        part = pa.struct([("kind", pa.string()), ("reference", pa.string()), ("heard", pa.string())])
        return pa.array(rows, pa.struct([("ratio", pa.float64()), ("differences", pa.list_(part))]))

    return run(reference, heard)
