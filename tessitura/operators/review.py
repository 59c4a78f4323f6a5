"""Review of captions: pending items, candidates for them, and an event log that is folded in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.shared import spread
from tessitura.functions.text import run_ratios
from tessitura.operators import revisions


def pending(items: DataFrame, decisions: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Items whose latest decision is none or ``later``."""
    latest = decisions.groupBy(*key).agg(F.max_by("action", seq).alias("_action"))
    return items.join(latest, key, "left").where(F.col("_action").isNull() | (F.col("_action") == "later")).drop("_action")


def pending_groups(tokens: DataFrame, key: list[str], pos: str, line: str, text: str) -> DataFrame:
    """(key, line, first_pos, last_pos, text): neighbouring pending tokens of one line."""
    w = W.partitionBy(*key, line).orderBy(pos)
    found = tokens.withColumn("_i", F.col(pos) - F.row_number().over(w))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), " ")
    return found.groupBy(*key, line, "_i").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), spelled.alias("text")).drop("_i")


def caption_candidates(items: DataFrame, captions: DataFrame, key: list[str], most: int = 12) -> DataFrame:
    """For each item its ``most`` best runs of one to three captions, by Indel similarity, then start.

    items: key, item, text; captions: key, ord, start, text. Both sides meet on the key."""
    # A few bytes of text cost thousands of steps, so keys are dealt over a given number of tasks. Items of a key are packed, so one
    # pass over three captions in a row tells how near each of the three runs is to every item of the pack.
    tasks, own = spread(items.sparkSession), [c for c in items.columns if c not in key]
    w = W.partitionBy(*key).orderBy("start", "ord")
    runs = captions.repartition(tasks, *key).select(*key, "ord", "start", F.array("text", *(F.lead("text", k).over(w) for k in (1, 2))).alias("_parts"))
    pack = F.floor((F.row_number().over(W.partitionBy(*key).orderBy("item")) - 1) / 16)
    packs = items.repartition(tasks, *key).withColumn("_pack", pack).groupBy(*key, "_pack").agg(F.collect_list(F.struct(*own)).alias("_items"))
    low = lambda texts: F.transform(texts, F.lower)
    ratios = run_ratios(low(F.col("_items.text")), low(F.col("_parts")))
    met = packs.join(runs, key).withColumn("_ratios", ratios).select(*key, "_items", "ord", "start", "_parts", F.posexplode("_ratios").alias("_at", "score"))
    n = F.col("_at") % 3 + 1
    found = met.where(F.get("_parts", n - 1).isNotNull()).withColumn("_item", F.get("_items", F.floor(F.col("_at") / 3).cast("int")))
    scored = found.select(*key, *(F.col(f"_item.{c}") for c in own), "ord", "start", n.alias("n"), F.concat_ws(" ", F.slice("_parts", F.lit(1), n)).alias("gram"), "score")
    best = W.partitionBy(*key, "item").orderBy(F.desc("score"), "start", "ord", "n")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def apply_events(blocks: dict, decisions: dict, events: list[dict]):
    """State after a log of events: (blocks, decisions, problems), problems as (place of the event, the rule it breaks)."""
    session = revisions.Session(blocks)
    for k, v in decisions.items():
        session._set("decision", k, v)
    rules = [(place, session.apply(e)[1]) for place, e in enumerate(events)]
    return session.entries["block"], session.entries["decision"], [x for x in rules if x[1] is not None]


def fold(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """Blocks and decisions of each song after its log, and a problem row for each event that breaks a rule (id: its seq).

    blocks: song_id, block, start_ms, end_ms, text; events: song_id, seq, action, item, block, start_ms, end_ms, text.
    ``undo`` restores what stood before the last event that was not undone. An event that breaks a rule (unknown action or
    block, overlap, end not after start, nothing to undo) changes nothing. An association whose block goes is put off
    (``later``)."""
    return revisions.final_state(blocks, events)


def split_events(blocks: DataFrame, splits: DataFrame) -> DataFrame:
    """Two events for each block that is split: the first part replaces it, the second is inserted.

    blocks: song_id, block, start_ms, end_ms, text; splits: song_id, seq, item, block, new_block, at_ms, word (the
    first word, from 0, of the second part). A cut that leaves no time or no word on a side gives no events."""
    whole = splits.join(blocks, ["song_id", "block"]).withColumn("_w", F.split(F.trim("text"), r"\s+"))
    whole = whole.where("word > 0 and word < size(_w) and at_ms > start_ms and at_ms < end_ms")
    first = F.struct(F.lit("replace").alias("action"), F.col("block"), F.col("start_ms"), F.col("at_ms").alias("end_ms"), F.array_join(F.slice("_w", F.lit(1), F.col("word")), " ").alias("text"), F.lit(0).alias("n"))
    second = F.struct(F.lit("insert").alias("action"), F.col("new_block").alias("block"), F.col("at_ms").alias("start_ms"), F.col("end_ms"), F.array_join(F.slice("_w", F.col("word") + 1, F.size("_w")), " ").alias("text"), F.lit(1).alias("n"))
    dealt = whole.select("song_id", "seq", "item", F.explode(F.array(first, second)).alias("e"))
    return dealt.select("song_id", (F.col("seq") * 2 + F.col("e.n")).alias("seq"), "e.action", "item", "e.block", "e.start_ms", "e.end_ms", "e.text")


def editor_words(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, no, text, start, end, score, confirmed): the words of a text for an editor, none of them confirmed."""
    from tessitura.functions.text import tokens

    none = F.lit(None).cast("double")
    return texts.select(*key, F.posexplode(tokens(F.col(text))).alias("no", "text")).select(*key, F.col("no").cast("long").alias("no"), "text", none.alias("start"), none.alias("end"), none.alias("score"), F.lit(False).alias("confirmed"))


def proposed_times(texts: DataFrame, found: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """editor_words with the times that an aligner proposes (rounded to milliseconds, origin aligner); a proposal confirms nothing.

    found: key, no, text, key_text, start, end, score; windows: key, low, high."""
    from tessitura.functions.text import comparison_key
    from tessitura.operators.alignment import reused_times

    own = editor_words(texts, key)
    expected = own.select(*key, F.col("no").alias("pos"), "text", comparison_key(F.col("text")).alias("key"))
    times = reused_times(expected, found, windows, key).select(*key, F.col("pos").alias("no"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "score")
    return own.drop("start", "end", "score").join(times, [*key, "no"], "left").withColumn("origin", F.when(F.col("start").isNotNull(), "aligner"))


def pending_published(pending_: DataFrame, published: DataFrame) -> DataFrame:
    """Pending items with the place (from 0) and text of the published block they stem from. pending_: song_id, item, original; published: song_id, original, start, text."""
    place = F.row_number().over(W.partitionBy("song_id").orderBy("start")) - 1
    return pending_.join(published.select("song_id", "original", place.alias("place"), F.col("text").alias("published_text")), ["song_id", "original"])


def marked_group(words: DataFrame, marked: DataFrame, key: list[str]) -> DataFrame:
    """``words`` with the times of marked ones spread over an interval by the lengths of their texts: a suggestion, so none of them is confirmed.

    words: key, no, text, start, end, confirmed, origin; marked: key, no, low, high (the interval, the same for all of a
    key). Times are rounded to milliseconds. Adds problem: not_consecutive where the marked words of a key do not stand
    together (their times stay as they are)."""
    of_key = W.partitionBy(*key)
    chosen = words.join(marked.select(*key, "no", "low", "high"), [*key, "no"]).withColumn("_w", F.greatest(F.lit(1), F.char_length("text")))
    apart = F.max("no").over(of_key) - F.min("no").over(of_key) + 1 != F.count("*").over(of_key)
    up = F.sum("_w").over(of_key.orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow))
    place = lambda c: F.rint((F.col("low") + (F.col("high") - F.col("low")) * c / F.sum("_w").over(of_key)) * 1000) / 1000
    timed = chosen.select(*key, "no", place(up - F.col("_w")).alias("_start"), place(up).alias("_end"), apart.alias("_apart"))
    out = words.join(timed, [*key, "no"], "left")
    fits = F.coalesce(~F.col("_apart"), F.lit(False))
    new = {"start": F.when(fits, F.col("_start")).otherwise(F.col("start")), "end": F.when(fits, F.col("_end")).otherwise(F.col("end")), "confirmed": F.when(fits, F.lit(False)).otherwise(F.col("confirmed")), "origin": F.when(fits, "manual_approximation").otherwise(F.col("origin"))}
    return out.withColumns(new | {"problem": F.when(F.col("_apart"), "not_consecutive")}).drop("_start", "_end", "_apart")


def review_summary(songs: DataFrame, pending_: DataFrame, blocks: DataFrame) -> DataFrame:
    """(song_id, pending, blocks, confirmed): how far the review of each song is.

    songs: song_id; pending_: song_id, item; blocks: song_id, block, words array<struct<confirmed>>."""
    left = pending_.groupBy("song_id").agg(F.count("*").alias("pending"))
    sure = F.size(F.filter(F.coalesce("words", F.array().cast(blocks.schema["words"].dataType)), lambda w: F.coalesce(w["confirmed"], F.lit(False))))
    done = blocks.groupBy("song_id").agg(F.count("*").alias("blocks"), F.sum(sure).alias("confirmed"))
    return songs.select("song_id").join(left, "song_id", "left").join(done, "song_id", "left").fillna(0, ["pending", "blocks", "confirmed"])
