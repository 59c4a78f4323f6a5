"""Registered queries of candidates with all their terms, model results, alignments, editing and repair regions, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.shared import shared_folder
from tessitura.operators import regions, review, series, words
from tessitura.plans import consolidation
from tessitura.plans.catalog import _EV, _events, _read, query
from tessitura.sources import captions

_LN = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax"


@query("""SELECT event_id, value FROM events WHERE value / 100 >= 0.2 AND event_id % 5 NOT IN (0, 1, 2)""")
def voiced_frames(spark, sf_dir):
    """Events as pitch frames, of which some have no pitch, some none that is finite."""
    k = F.col("event_id") % 5
    midi = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    return words.pitch_frames(_read(spark, sf_dir, "events").withColumns({"voiced_prob": F.col("value") / 100, "midi": midi})).select("event_id", "value")


@query("""WITH c AS (SELECT p_partkey, 36 + p_retailprice % 60 AS centre, p_size / 50.0::DOUBLE AS voice, 36 + p_size % 60 AS before, p_partkey % 7 > 0 AS framed FROM part),
d AS (SELECT *, unnest(range(greatest(floor(centre + 0.5)::BIGINT - 2, 36), least(floor(centre + 0.5)::BIGINT + 2, 96) + 1)) AS pitch FROM c),
s AS (SELECT *, (pitch * 7 % 12) / 11.0::DOUBLE AS harmony, greatest(0.0, 1 - abs(pitch - centre) / 2) AS occupancy FROM d),
t AS (SELECT *, 0.42 * exp(-0.5 * pow((pitch - centre) * 100 / 75, 2)) + 0.23 * occupancy + 0.30 * harmony + 0.05 * exp(-abs(pitch - before) / 4.0::DOUBLE) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, pitch) AS rank, lead(score) OVER (PARTITION BY p_partkey ORDER BY score DESC, pitch) AS second FROM t)
SELECT p_partkey, pitch::INTEGER AS pitch, round(score, 6) AS score, round(least(1.0, greatest(0.0, (0.35 * voice + 0.25 * occupancy + 0.20 * harmony + 0.20 * least(1.0, greatest(0.0, score - coalesce(second, 0)) / 0.2)) * CASE WHEN framed THEN 1 ELSE 0.45 END)), 6) AS confidence FROM r WHERE rank = 1""")
def candidate_confidence(spark, sf_dir):
    """Parts as units: candidates by proximity, occupancy, harmony and continuity, the best one, and how sure it is."""
    p = _read(spark, sf_dir, "part").select("p_partkey", (36 + F.col("p_retailprice") % 60).alias("centre"), (F.col("p_size") / 50.0).alias("voice"), (36 + F.col("p_size") % 60).alias("before"), (F.col("p_partkey") % 7 > 0).alias("framed"))
    c = series.candidates(p, "centre").withColumns({"harmony": F.col("pitch") * 7 % 12 / 11, "occupancy": F.greatest(F.lit(0.0), 1 - F.abs(F.col("pitch") - F.col("centre")) / 2), "continuity": F.exp(-F.abs(F.col("pitch") - F.col("before")) / 4)})
    scored = c.withColumn("score", sum((F.col(term) * weight for term, weight in series.WEIGHTS.items()), F.lit(0.0)))
    top = series.top_candidates(scored, ["p_partkey"], "score")
    both = top.withColumn("second", F.lead("score").over(W.partitionBy("p_partkey").orderBy("rank"))).where("rank = 1")
    sure = series.confidence(F.col("score"), F.col("second"), F.col("voice"), F.col("occupancy"), F.col("harmony"), F.col("framed"))
    return both.select("p_partkey", "pitch", F.round("score", 6).alias("score"), F.round(sure, 6).alias("confidence"))


@query(f"""WITH {_EV} SELECT event_id FROM ev WHERE event_id % 3 > 0 AND 1 + event_id % 5 <= 2 AND end_ms - start_ms <= 1000""")
def short_orphans(spark, sf_dir):
    e = _events(spark, sf_dir)
    c = e.select("event_id", (F.col("start_ms") / 1000).alias("start"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("length"), (1 + F.col("event_id") % 5).alias("n_words"), F.when(F.col("event_id") % 3 == 0, 7).alias("token_start"))
    return words.short_orphans(c.withColumns({"start": F.lit(0.0), "end": F.col("length")})).select("event_id")


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LN}) AS k FROM lineitem),
s AS (SELECT l_orderkey, list('w' || l_partkey ORDER BY k) AS ws, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY k) AS chars FROM n GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN 'own' ELSE array_to_string(ws, ',') END AS words, chars, CASE WHEN l_orderkey % 3 = 0 THEN length(replace(chars, ' ', '')) ELSE 0 END::INTEGER AS spelled,
  CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_orderkey % 5 = 0 THEN 'weak' ELSE 'old,weak' END ELSE CASE WHEN l_orderkey % 5 = 0 THEN 'weak' ELSE 'old' END END AS warnings FROM s""")
def model_results(spark, sf_dir):
    """Line items as segments of a model's result of an order: its words and characters as one list, those that spell a text, and warnings."""
    n = _read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LN.split(", "))))
    none = F.lit(None).cast("double")
    char = lambda c: F.struct(F.col(c).alias("char"), none.alias("start"), none.alias("end"), none.alias("score"))
    seg = F.struct("k", F.array(F.concat(F.lit("w"), F.col("l_partkey").cast("string"))).alias("words"), F.array(char("l_returnflag"), char("l_linestatus")).alias("chars"))
    s = n.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(seg)).alias("segs"))
    listed = F.when(F.col("l_orderkey") % 4 == 0, F.array(F.lit("own")))
    chars = words.flatten_chars(F.col("segs"))
    s = s.withColumns({"words": F.array_join(words.flatten_words(F.col("segs"), listed), ","), "cs": chars})
    spelled = F.array_join(F.transform("cs", lambda c: c["char"]), "")
    text = F.when(F.col("l_orderkey") % 3 == 0, F.lower(spelled)).otherwise(F.lit("other"))
    before = F.when(F.col("l_orderkey") % 5 == 0, F.array(F.lit("weak"))).otherwise(F.array(F.lit("old")))
    told = words.warn(before, "weak", F.col("l_orderkey") % 2 == 0)
    return s.select("l_orderkey", "words", spelled.alias("chars"), F.size(words.spelling_chars(F.col("cs"), text)).alias("spelled"), F.array_join(told, ",").alias("warnings"))


@query("""SELECT item_id, (i - 1)::BIGINT AS no, w[i] AS text, false AS confirmed FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’\\-][\\p{L}\\p{N}]+)*') AS w FROM benchmark))""")
def editor_rows(spark, sf_dir):
    return review.editor_words(_read(spark, sf_dir, "benchmark"), ["item_id"]).select("item_id", "no", "text", "confirmed")


@query(f"""WITH {_EV}, p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - 1 AS place, event_type FROM ev WHERE event_type <> 'error')
SELECT e.event_id AS item, p.place::BIGINT AS place, p.event_type AS published_text FROM ev e JOIN p ON p.user_id = e.user_id AND p.event_id = e.event_id - e.event_id % 3 WHERE e.event_type = 'view'""")
def pending_blocks(spark, sf_dir):
    """Events as pending items that stem from the block of an event of the same user, and its place among those published."""
    e = _events(spark, sf_dir).withColumn("song_id", F.col("user_id"))
    items = e.where("event_type = 'view'").select("song_id", F.col("event_id").alias("item"), (F.col("event_id") - F.col("event_id") % 3).alias("original"))
    shown = e.where("event_type <> 'error'").select("song_id", F.col("event_id").alias("original"), F.struct("start_ms", "event_id").alias("start"), F.col("event_type").alias("text"))
    got = review.pending_published(items, shown)
    return got.select("item", F.col("place").cast("long").alias("place"), "published_text")


@query(f"""WITH n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LN}) AS pos, CASE WHEN l_suppkey % 2 = 0 THEN 'pt' ELSE 'en' END AS language, l_partkey % 100 AS a, l_quantity / 50 AS s FROM lineitem)
SELECT l_orderkey, pos, CASE WHEN language = 'pt' THEN a * 1.0::DOUBLE WHEN a % 4 > 0 THEN a + 0.5::DOUBLE END AS start, CASE WHEN language = 'pt' THEN s WHEN a % 4 > 0 THEN s / 2 END AS score FROM n""")
def line_models(spark, sf_dir):
    """Line items as words of lines in two languages, each with the time that the model of its language found, if any."""
    n = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LN.split(", "))).cast("long").alias("pos"), F.when(F.col("l_suppkey") % 2 == 0, "pt").otherwise("en").alias("language"), (F.col("l_partkey") % 100).alias("a"), (F.col("l_quantity") / 50).alias("s"))
    of = lambda language, start, score: n.select("l_orderkey", "pos", F.lit(language).alias("language"), start.cast("double").alias("start"), (start + 1).cast("double").alias("end"), score.alias("score"))
    found = of("pt", F.col("a"), F.col("s")).unionByName(of("en", F.col("a") + 0.5, F.col("s") / 2).where("start % 4 >= 1"))
    return words.model_of_line(n.select("l_orderkey", "pos", "language"), found, ["l_orderkey"]).select("l_orderkey", "pos", "start", "score")


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LN}) AS k FROM lineitem)
SELECT l_orderkey::VARCHAR AS song_id, 'u' || k AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, k)::INTEGER AS ord, l_quantity AS start, l_quantity + 1 AS "end", l_discount AS score FROM n""")
def read_alignments(spark, sf_dir):
    """Orders as JSON alignments whose units are line items: written as files, and read in the order of their times."""
    n = _read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LN.split(", "))))
    unit = F.struct(F.concat(F.lit("u"), F.col("k").cast("string")).alias("id"), F.lit("w").alias("word_id"), F.lit(1).alias("block"), F.col("k").alias("no"), F.lit("la").alias("text"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + 1).alias("end"), F.col("l_quantity").alias("core_start"), (F.col("l_quantity") + 1).alias("core_end"), F.col("l_discount").alias("score"), F.lit("model").alias("origin"), F.array(F.lit("old")).alias("warnings"))
    folder = shared_folder(spark, "alignments")
    # Units are collected where their places were told, and the names of their fields, which make up most of the text, are compressed.
    songs = n.groupBy("l_orderkey").agg(F.collect_list(unit).alias("units")).select(F.col("l_orderkey").cast("string").alias("song_id"), "units")
    songs.select(F.to_json(F.struct("song_id", "units")).alias("value")).write.text(folder, compression="lz4")
    # One object a line here; a file with one object over several lines is read by ``captions.read_alignment``.
    found = spark.read.schema(captions.UNITS_SCHEMA).json(folder).select("song_id", F.inline("units"))
    return captions.in_order(found).select("song_id", "id", "ord", "start", "end", "score")


@query(f"""WITH {_EV}, b AS (SELECT user_id, event_id, start_ms, end_ms, start_ms + (end_ms - start_ms) // 2 AS at_ms, event_id % 4 AS word FROM ev WHERE event_id % 2 = 0)
SELECT user_id AS song_id, 2 * event_id AS seq, 'replace' AS action, event_id AS block, start_ms, at_ms AS end_ms, array_to_string(['bom', 'dia', 'amor'][1:word], ' ') AS text FROM b WHERE word BETWEEN 1 AND 2 AND at_ms > start_ms
UNION ALL SELECT user_id, 2 * event_id + 1, 'insert', event_id + 1000000, at_ms, end_ms, array_to_string(['bom', 'dia', 'amor'][word + 1:], ' ') FROM b WHERE word BETWEEN 1 AND 2 AND at_ms > start_ms""")
def split_blocks(spark, sf_dir):
    """Events as blocks of three words that are split at a word and a time."""
    e = _events(spark, sf_dir).withColumn("song_id", F.col("user_id"))
    blocks = e.select("song_id", F.col("event_id").alias("block"), "start_ms", "end_ms", F.lit("bom dia amor").alias("text"))
    at = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2)
    splits = e.where("event_id % 2 = 0").select("song_id", F.col("event_id").alias("seq"), F.lit(1).alias("item"), F.col("event_id").alias("block"), (F.col("event_id") + 1_000_000).alias("new_block"), at.alias("at_ms"), (F.col("event_id") % 4).cast("int").alias("word"))
    return review.split_events(blocks, splits).select("song_id", "seq", "action", "block", "start_ms", "end_ms", "text")


@query("""WITH d AS (SELECT doc_id, (n_chars // 20 + 1)::BIGINT AS total FROM documents), s AS (SELECT doc_id, total, unnest(range(0, (total + 4) // 5)) AS k FROM d),
h AS (SELECT doc_id, k * 5 AS a, least(k * 5 + 5, total) AS b FROM s WHERE (doc_id * 31 + k * 17) % 7 < 5),
p AS (SELECT doc_id, a, b FROM h UNION ALL SELECT doc_id, NULL, 0 FROM d), n AS (SELECT p.*, total, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM p JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a NULLS FIRST)),
g AS (SELECT doc_id, coalesce(a, 0) AS a, coalesce(nb, total) AS b FROM n WHERE b < coalesce(na, total)),
r AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT doc_id AS song_id, min(a) AS a, max(b) AS b FROM m GROUP BY doc_id, grp""")
def repair_regions(spark, sf_dir):
    """Documents as lyrics of which stretches of five words hold or do not: what is between them, with its context."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"), (F.floor(F.col("n_chars") / 20) + 1).alias("total"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") + 4) / 5) - 1))
    s = d.select("song_id", "total", k.alias("k")).where("(song_id * 31 + k * 17) % 7 < 5")
    held = s.select("song_id", F.col("k").alias("block"), (F.col("k") * 5).alias("a"), F.least(F.col("k") * 5 + 5, "total").alias("b"))
    return regions.repair_regions(held, d)


@query("""WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
t AS (SELECT conv_id, k, array_to_string(list_transform([0, 1, 2, 3], lambda j: md5(conv_id || '/' || k || '/' || j)[1:8]), ' ') AS text FROM n)
SELECT conv_id::VARCHAR AS song_id, k * 10.0::DOUBLE AS start, round(k * 10 + CASE WHEN k % 3 = 0 THEN 4.6 ELSE 5.0 END, 6)::DOUBLE AS "end", text, CASE k % 3 WHEN 0 THEN 'inserted' WHEN 1 THEN 'corrected' ELSE 'kept' END AS origin, NULL::VARCHAR AS problem FROM t""")
def consolidated_songs(spark, sf_dir):
    """The whole chain: conversations as songs, turns as lines of four words; of every three lines one has a caption in capitals, one as it is, and one has none but times that an engine found."""
    n = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("song_id"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long").alias("k"))
    word = lambda j: F.substring(F.md5(F.concat_ws("/", "song_id", F.col("k").cast("string"), j.cast("string"))), 1, 8)
    lines = n.withColumn("ws", F.transform(F.sequence(F.lit(0), F.lit(3)), word))
    lyric = lines.select("song_id", F.posexplode("ws").alias("j", "text"), "k").select("song_id", ((F.col("k") - 1) * 4 + F.col("j")).alias("pos"), F.col("k").cast("int").alias("line"), "text", F.col("text").alias("key"), "j", "k")
    spelled = F.array_join("ws", " ")
    caps = lines.where("k % 3 > 0").select("song_id", F.col("k").alias("idx"), (F.col("k") * 10.0).alias("start"), (F.col("k") * 10.0 + 5).alias("end"), F.when(F.col("k") % 3 == 1, F.upper(spelled)).otherwise(spelled).alias("text"), F.col("ws").alias("keys"))
    at = F.col("k") * 10 + F.col("j") * 1.2
    found = lyric.where("k % 3 = 0").select("song_id", "pos", "key", at.alias("start"), (at + 1).alias("end"), F.lit(0.9).alias("score"))
    songs = lines.groupBy("song_id").agg(((F.max("k") + 1) * 10.0).alias("duration"))
    out = consolidation.consolidate(caps, lyric.drop("j", "k"), found, songs)
    return out["published"].select("song_id", "start", F.round("end", 6).alias("end"), "text", "origin", "problem")
