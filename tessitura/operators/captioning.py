"""Captions from recognised segments: words grouped greedily, segments kept where words are not sure, short overlaps mended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SURE = 0.30
_GROUPS = "struct<done:array<struct<start:double,end:double,text:string,first:double,last:double,first_end:double,last_start:double>>,open:array<struct<word:string,start:double,end:double,score:double>>,chars:int>"


def capped_groups(words: DataFrame, duration: float = float("inf"), pause: float = 0.65, longest: float = 6.0, most_chars: int = 72, slack: float = 0.100) -> DataFrame:
    """(song_id, seg, grp, start, end, text, problem, adjusted, refused): captions of each song's segments, in order.

    words: song_id, seg, no, word, start, end, score, seg_start, seg_end, seg_text. A pause, the span or the length of the
    text begins a new caption. A segment stays one caption (problem segment_times) if its words do not spell its text or have
    no valid times in order within ``duration``. Where two captions of neighbouring segments overlap by up to ``slack``
    seconds, the border that is only approximate, else that of an unsure word, gives way to a sure one (adjusted). What is
    then still wrong is told by refused: invalid_times (not within the song, or without length) or overlap (the caption
    before it ends later); it is also the problem of a caption whose words were sure. ``valid_captions`` fails on it."""
    clean = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")
    ms = lambda c: F.rint(c * 1000)
    one = F.struct("no", F.struct(F.col("word").cast("string").alias("word"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("score").cast("double").alias("score")).alias("w"))
    segs = words.groupBy("song_id", "seg").agg(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), one))).alias("ws"), F.first("seg_start").cast("double").alias("seg_start"), F.first("seg_end").cast("double").alias("seg_end"), F.trim(F.regexp_replace(F.first("seg_text"), r"\s+", " ")).alias("seg_text")).where("seg_text <> ''")
    segs = segs.withColumn("ws", F.transform("ws", lambda x: x["w"]))
    limit = F.lit(duration)
    valid = F.forall(F.transform("ws", lambda w, i: F.coalesce(
        ~F.isnan(w["start"]) & ~F.isnan(w["end"]) & (ms(w["start"]) >= 0) & (ms(w["start"]) < ms(w["end"])) & (ms(w["end"]) <= ms(limit)) & ((i == 0) | (ms(w["start"]) >= ms(F.get("ws", i - 1)["end"]))), F.lit(False))), lambda ok: ok)
    good = (F.size("ws") > 0) & (clean(F.array_join(F.transform("ws", lambda w: w["word"]), " ")) == clean(F.col("seg_text"))) & valid

    def closed(open_):
        text = F.array_join(F.transform(open_, lambda w: F.trim(w["word"])), " ")
        a, z = F.get(open_, F.lit(0)), F.get(open_, F.size(open_) - 1)
        return F.struct(a["start"].alias("start"), z["end"].alias("end"), text.alias("text"), a["score"].alias("first"), z["score"].alias("last"), a["end"].alias("first_end"), z["start"].alias("last_start"))

    def step(acc, w):
        n = F.size(acc["open"])
        a, z = F.get(acc["open"], F.lit(0)), F.get(acc["open"], n - 1)
        own = F.char_length(w["word"])
        joined = F.when(n > 0, acc["chars"] + 1 + own).otherwise(own)  # words joined by spaces, counted as they come
        new = (n > 0) & ((w["start"] - z["end"] >= pause) | (w["end"] - a["start"] > longest) | (joined > most_chars))
        return F.when(new, F.struct(F.concat(acc["done"], F.array(closed(acc["open"]))).alias("done"), F.array(w).alias("open"), own.alias("chars")).cast(_GROUPS)).otherwise(F.struct(acc["done"], F.concat(acc["open"], F.array(w)).alias("open"), joined.alias("chars")).cast(_GROUPS))

    empty = F.struct(F.array().alias("done"), F.array().alias("open"), F.lit(0).alias("chars")).cast(_GROUPS)
    grouped = F.aggregate("ws", empty, step, lambda acc: F.concat(acc["done"], F.array(closed(acc["open"]))))
    none = F.lit(None).cast("double")
    kept = F.array(F.struct(F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), F.col("seg_text").alias("text"), none.alias("first"), none.alias("last"), none.alias("first_end"), none.alias("last_start")))
    rows = segs.withColumn("good", good).select("song_id", "seg", "good", F.posexplode(F.when(F.col("good"), grouped).otherwise(kept)).alias("grp", "g")).select("song_id", "seg", "good", F.col("grp").cast("long").alias("grp"), "g.*")
    rows = rows.withColumns({c: F.round(c, 3) for c in ("start", "end", "first_end", "last_start")})
    w = W.partitionBy("song_id").orderBy("seg", "grp")
    about = lambda f, by: f(F.struct("start", "end", "good", "first", "last", "first_end", "last_start", "seg")).over(by)
    sided = rows.withColumns({"p": about(F.lag, w), "n": about(F.lead, w)})
    sure = lambda c: F.coalesce((c >= SURE) & ~F.isnan(c), F.lit(False))
    me = F.struct("start", "end", "good", "first", "last", "first_end", "last_start", "seg")

    def gives_way(a, b):
        """Which border moves where a (before) and b overlap a little: 'before', 'after' or null."""
        over = F.rint((a["end"] - b["start"]) * 1000)
        short = (over > 0) & (over <= round(slack * 1000)) & (a["seg"] != b["seg"])
        return F.when(short & ~a["good"] & (a["start"] < b["start"]), "before").when(short & a["good"] & ~b["good"] & (a["end"] < b["end"]), "after").when(
            short & a["good"] & b["good"], F.when(~sure(a["last"]) & sure(b["first"]) & (a["last_start"] < b["start"]), "before").when(~sure(b["first"]) & sure(a["last"]) & (a["end"] < b["first_end"]), "after"))

    before, after = gives_way(F.col("p"), me), gives_way(me, F.col("n"))
    start = F.when(before == "after", F.col("p.end")).otherwise(F.col("start"))
    end = F.when(after == "before", F.col("n.start")).otherwise(F.col("end"))
    moved = F.coalesce(before == "after", F.lit(False)) | F.coalesce(after == "before", F.lit(False))
    placed = sided.select("song_id", "seg", "grp", start.alias("start"), end.alias("end"), "text", "good", moved.alias("adjusted"))
    inside = F.coalesce(~F.isnan("start") & ~F.isnan("end") & (ms(F.col("start")) >= 0) & (ms(F.col("start")) < ms(F.col("end"))) & (ms(F.col("end")) <= ms(limit)), F.lit(False))
    over = ms(F.col("start")) < ms(F.lag("end").over(w))
    refused = F.when(~inside, "invalid_times").when(over, "overlap")
    problem = F.when(~F.col("good"), "segment_times").otherwise(refused)
    return placed.select("song_id", "seg", "grp", "start", "end", "text", problem.alias("problem"), "adjusted", refused.alias("refused"))


def valid_captions(captions: DataFrame) -> DataFrame:
    """``captions`` without the column refused; running the plan fails where one is refused."""
    told = F.concat(F.lit("invalid captions: "), F.col("refused"), F.lit(" in segment "), F.col("seg").cast("string"))
    checked = captions.withColumn("refused", F.when(F.col("refused").isNotNull(), F.raise_error(told).cast("string")))
    return checked.where(F.col("refused").isNull()).drop("refused")


def weak_words(words: DataFrame, least: float = SURE) -> DataFrame:
    """(song_id, seg, no, word, score): words whose alignment is weak, to be looked at; a word without a score is not."""
    return words.where(F.col("score") < least).select("song_id", "seg", "no", "word", "score")
