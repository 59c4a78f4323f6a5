"""Captions and lyric to published captions: keep or correct what is located, plan the gaps, fill them, check the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators import intervals, recovery, structure, words


def consolidate(captions: DataFrame, lyric: DataFrame, found: DataFrame, songs: DataFrame, sound: DataFrame | None = None) -> dict[str, DataFrame]:
    """plan, gaps, filled, published and metrics tables.

    captions: song_id, idx, start, end, text, keys; lyric: song_id, pos, line, text, key; found (times of lyric words
    in gaps): song_id, pos, key, start, end, score; songs: song_id, duration; sound: song_id, t, rms by 20 ms."""
    plan = structure.structure_plan(captions.select("song_id", "idx", "start", "end", "keys"), lyric.select("song_id", "pos", "key"))
    total = lyric.groupBy("song_id").agg(F.count("*").alias("total"))
    located = captions.join(plan, ["song_id", "idx"]).join(songs, "song_id").join(total, "song_id").withColumns({"ord": F.col("idx"), "n_words": F.size("keys")})
    gaps = intervals.plan_gaps(located.select("song_id", "ord", "start", "end", "token_start", "token_end", "score", "n_words", "total", "duration"), ["song_id"], F.col("total"), F.col("duration"))
    gaps = gaps.withColumn("gap", F.col("token_from").cast("long"))
    expected = gaps.select("song_id", "gap", "reason", "token_from", "token_to").join(lyric, "song_id").where("pos >= token_from and pos < token_to")
    searched = expected.where("reason is null").select("song_id", "gap", "pos", "line", "text", "key")
    heard = found.join(searched.select("song_id", "gap", "pos", "text"), ["song_id", "pos"]).select("song_id", "gap", F.col("pos").alias("no"), "text", "key", "start", "end", "score")
    filled = recovery.recover_gaps(gaps.where("reason is null"), searched, heard, words.short_orphans(located).select("song_id", "start", "end"), sound)
    spelled = lambda rows, a, b: rows.join(lyric.select("song_id", "pos", F.col("text").alias("_w")), "song_id").where((F.col("pos") >= F.col(a)) & (F.col("pos") < F.col(b)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_w"))), lambda x: x["_w"]), " ").alias("text")
    fixed = spelled(plan.where("token_start is not null"), "token_start", "token_end").groupBy("song_id", "idx").agg(joined)
    changed = fixed.join(captions.select("song_id", "idx", F.col("text").alias("_old")), ["song_id", "idx"]).where("text <> _old").drop("_old")
    after = filled.where("start is not null").withColumn("after", F.col("last_token") + 1)
    inserted = spelled(after, "first_token", "after").groupBy("song_id", "start", "end").agg(joined)
    published = words.consolidate(captions.select("song_id", "idx", "start", "end", "text"), changed, inserted.withColumn("idx", F.lit(None).cast(dict(captions.dtypes)["idx"])), ["song_id"])
    asked = expected.groupBy("song_id", "gap", "reason").agg(F.count("*").alias("asked"))
    n = F.coalesce(F.col("last_token") - F.col("first_token") + 1, F.lit(0))
    got = filled.groupBy("song_id", "gap").agg(F.sum(n).alias("recovered"), F.first("state").alias("state"))
    weak = found.where("score < 0.3").join(filled.select("song_id", "first_token", "last_token"), "song_id").where("pos between first_token and last_token").groupBy("song_id", F.col("first_token").alias("_f")).agg(F.count("*").alias("weak")).groupBy("song_id").agg(F.sum("weak").alias("weak"))
    counted = asked.join(got, ["song_id", "gap"], "left").fillna(0, ["recovered"]).withColumn("weak", F.lit(0))
    metrics = words.run_metrics(published, ["song_id"], counted).drop("low_confidence").join(weak.withColumnRenamed("weak", "low_confidence"), "song_id", "left").fillna(0, ["low_confidence"])
    return {"plan": plan, "gaps": gaps, "filled": filled, "published": published, "metrics": metrics}
