"""Hyphenation by weighted letter patterns that the user gives as a table: the patterns are joined, not a library asked.

A pattern such as ``hy3ph`` stands for its letters and a weight between them; a
dot is the edge of a word. Where a word holds the letters of a pattern, each of
its weights counts at its place; of all weights at a place the largest counts,
and an odd one allows a break. Words are looked at once however often they stand
in the text, and only substrings of lengths that patterns have are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Patterns up to which their table is broadcast.
_BROADCAST_PATTERNS = 200_000


def parsed_patterns(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(letters, weights): letters with dots for edges, one weight before each letter and one after the last. Repeated letters: the largest weights.

    A pattern of digits alone, or an empty one, is left out."""
    low = F.lower(F.trim(F.col(pattern)))
    letters = F.regexp_replace(low, "[0-9]", "")
    weights = F.transform(F.regexp_extract_all(F.concat(low, F.lit("\n")), F.lit(r"([0-9]*)[^0-9]"), F.lit(1)), lambda d: F.coalesce(F.nullif(d, F.lit("")).cast("int"), F.lit(0)))
    rows = patterns.select(letters.alias("letters"), weights.alias("weights")).where(F.length("letters") > 0)
    at = rows.select("letters", F.posexplode("weights").alias("k", "w")).groupBy("letters", "k").agg(F.max("w").alias("w"))
    return at.groupBy("letters").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("weights"))


def break_places(words: DataFrame, patterns: DataFrame, word: str = "word", left: int = 1, right: int = 1, broadcast: bool | None = None) -> DataFrame:
    """(word, places): the distinct words of ``words`` and where they may break, as numbers of characters before the break, ascending.

    ``left`` and ``right`` characters at least stay together at the edges. ``broadcast``: whether the patterns go to
    every task; if not given, they do if they are few, which is counted."""
    known = parsed_patterns(patterns)
    distinct = words.select(F.col(word).alias("word")).where(F.length(word) > 0).distinct()
    sizes = known.select(F.collect_set(F.char_length("letters")).alias("sizes")).scalar()  # the lengths that patterns have
    if broadcast is None:
        broadcast = patterns.limit(_BROADCAST_PATTERNS + 1).count() <= _BROADCAST_PATTERNS
    edged = F.concat(F.lit("."), F.lower("word"), F.lit("."))

    def starts(size: Column) -> Column:
        n = F.char_length(edged) - size
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda s: F.struct(s.alias("start"), F.substring(edged, s + 1, size).alias("letters")))).otherwise(F.array().cast("array<struct<start:int,letters:string>>"))

    sized = distinct.withColumn("sizes", F.coalesce(sizes, F.array().cast("array<int>")))
    pieces = sized.select("word", F.explode(F.flatten(F.transform("sizes", starts))).alias("p")).select("word", "p.*")
    met = pieces.join(F.broadcast(known) if broadcast else known, "letters")
    # Weight k of a pattern at s stands before character s + k of the edged word, so s + k - 1 characters of the word are before it.
    weights = met.select("word", "start", F.posexplode("weights").alias("k", "w")).where("w > 0")
    best = weights.groupBy("word", (F.col("start") + F.col("k") - 1).alias("place")).agg(F.max("w").alias("w"))
    odd = best.where((F.col("w") % 2 == 1) & (F.col("place") >= left) & (F.col("place") <= F.char_length("word") - right) & (F.col("place") > 0) & (F.col("place") < F.char_length("word")))
    found = odd.groupBy("word").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return distinct.join(found, "word", "left").select("word", F.coalesce("places", F.array().cast("array<int>")).alias("places"))


def cut_at(word: Column, places: Column) -> Column:
    """The parts of a word, its case kept; joined they spell the word."""
    ends = F.concat(places, F.array(F.char_length(word)))
    return F.transform(ends, lambda e, k: F.substring(word, F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1)) + 1, e - F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1))))


def hyphenate(words: DataFrame, patterns: DataFrame, exceptions: DataFrame | None = None, word: str = "word", into: str = "parts", left: int = 1, right: int = 1) -> DataFrame:
    """``words`` with the parts of each word: an exception (parts array<string>), else by patterns (pattern).

    Null and empty words have no parts. Exceptions are found whatever the case of a word; one whose parts spell no word
    of the text is never met. If the parts of an exception have empty ones, or two exceptions spell the same word
    differently, running the plan fails."""
    if into in words.columns:
        raise ValueError(f"the table already has a column {into!r}")
    places = break_places(words, patterns, word, left, right)
    if exceptions is not None:
        spelled = exceptions.select(F.lower(F.array_join("parts", "")).alias("_low"), F.transform("parts", lambda p: F.char_length(p)).alias("sizes"))
        wrong = F.exists("sizes", lambda n: F.coalesce(n < 1, F.lit(True))) | (F.size(F.collect_set("sizes").over(W.partitionBy("_low"))) > 1)
        checked = spelled.withColumn("sizes", F.when(wrong, F.raise_error(F.concat(F.lit("an exception has no valid parts: "), "_low")).cast("array<int>")).otherwise(F.col("sizes"))).distinct()
        ends = F.transform("sizes", lambda n, k: F.aggregate(F.slice("sizes", 1, k + 1), F.lit(0), lambda a, x: a + x))
        listed = checked.select("_low", F.slice(ends, 1, F.size("sizes") - 1).alias("_listed"))
        places = places.withColumn("_low", F.lower("word")).join(listed, "_low", "left").select("word", F.coalesce("_listed", "places").alias("places"))
    named = places.select(F.col("word").alias("_word"), cut_at(F.col("word"), F.col("places")).alias(into))
    return words.join(named, F.col(word) == F.col("_word"), "left").drop("_word")
