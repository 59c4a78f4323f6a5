"""More registered queries: words, characters, checks, sources and writers over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import language as L
from tessitura.functions import text as T
from tessitura.functions.shared import spread
from tessitura.operators import audit, frames, intervals, placement, review, series, sound, syllables, words
from tessitura.plans.catalog import _EV, _FRAMES, _events, _frames, _lines, _LINES, _NOTES, _notes, _read, query, srt_render
from tessitura.sources import captions, publication, writers

_OVER = "(PARTITION BY user_id ORDER BY start_ms, event_id)"
_TOKEN = "[\\\\p{L}\\\\p{N}]+(?:[''’\\\\-][\\\\p{L}\\\\p{N}]+)*".replace("\\\\", "\\")


@query(f"""WITH {_EV} SELECT event_id, CASE WHEN start_ms // 60000 < 6000 THEN round(start_ms / 1000.0::DOUBLE, 3) END AS seconds, CASE WHEN start_ms >= 3600000 THEN printf('%02d:%02d:%02d,%03d', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60, start_ms % 1000)
  ELSE printf('%02d:%02d,%03d', start_ms // 60000, (start_ms // 1000) % 60, start_ms % 1000) END AS text FROM ev""")
def human_times(spark, sf_dir):
    e = _events(spark, sf_dir)
    ms = F.col("start_ms")
    written = F.format_string("%02d:%02d,%03d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60, ms % 1000)
    return e.select("event_id", F.when(F.floor(ms / 60_000) < 6000, T.human_time(written)).alias("seconds"), T.short_time_text(ms).alias("text"))


@query("""SELECT page_id, regexp_matches(name, '^[^<>:"/\\\\|?*\\x00-\\x1F]*[^<>:"/\\\\|?*\\x00-\\x1F. ]$') AS valid, CASE WHEN lower(name) LIKE '%.mid' THEN name ELSE name || '.mid' END AS midi, page_id % 3 <> 1 AS audio
FROM (SELECT page_id, 'song ' || page_id || CASE page_id % 4 WHEN 0 THEN '?' WHEN 1 THEN '.Mid' WHEN 2 THEN '.' ELSE '' END AS name FROM pages)""")
def file_names(spark, sf_dir):
    name = F.concat(F.lit("song "), F.col("page_id"), F.when(F.col("page_id") % 4 == 0, "?").when(F.col("page_id") % 4 == 1, ".Mid").when(F.col("page_id") % 4 == 2, ".").otherwise(""))
    path = F.concat(F.lit("/a.b/x"), F.get(F.array(F.lit(".WAV"), F.lit(".txt"), F.lit(".m4a")), (F.col("page_id") % 3).cast("int")))
    return _read(spark, sf_dir, "pages").select("page_id", T.valid_file_name(name).alias("valid"), T.midi_file_name(name).alias("midi"), T.is_audio(path).alias("audio"))


@query("""SELECT o_orderkey, sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS identity FROM orders""")
def identity_address(spark, sf_dir):
    parts = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.identity(parts).alias("identity"))


@query("""SELECT p_partkey, round(69 + 12 * log2(hz / 440.0::DOUBLE), 6) AS midi, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][(p % 12 + 1)::BIGINT] || (p // 12 - 1) AS name
FROM (SELECT p_partkey, p_retailprice AS hz, round(69 + 12 * log2(p_retailprice / 440.0::DOUBLE))::BIGINT AS p FROM part)""")
def pitch_of_frequency(spark, sf_dir):
    midi = T.midi_of(F.col("p_retailprice"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(midi, 6).alias("midi"), T.midi_name(F.round(midi).cast("long")).alias("name"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS finite, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN value / 100 END AS score FROM events""")
def finite_numbers(spark, sf_dir):
    odd = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    return _read(spark, sf_dir, "events").select("event_id", T.finite(odd).alias("finite"), T.score_of(F.col("value") / 100).alias("score"))


@query(f"""WITH {_EV}, s AS (SELECT user_id, start_ms::DOUBLE AS t, avg(value) AS v FROM ev GROUP BY ALL), g AS (SELECT DISTINCT user_id, unnest(range(0, 26)) * 100000000.0::DOUBLE AS t FROM ev),
a AS (SELECT g.user_id, g.t, s.t AS ta, s.v AS va FROM g ASOF LEFT JOIN s ON s.user_id = g.user_id AND s.t <= g.t), b AS (SELECT a.*, s.t AS tb, s.v AS vb FROM a ASOF LEFT JOIN s ON s.user_id = a.user_id AND s.t >= a.t)
SELECT user_id, t, round(coalesce(CASE WHEN ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 0), 5) AS v FROM b""")
def resampled(spark, sf_dir):
    s = _events(spark, sf_dir).groupBy("user_id", F.col("start_ms").cast("double").alias("t")).agg(F.avg("value").alias("v"))
    g = s.select("user_id").distinct().select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: i * 100_000_000.0)).alias("t"))
    return series.resample(s, g, ["user_id"], "t", "v").select("user_id", "t", F.round("v", 5).alias("v"))


@query(f"""WITH {_EV} SELECT event_id, coalesce(end_ms - start_ms >= 5 AND start_ms >= 3600000 AND end_ms <= 2000000000 AND value / 100 >= 0.3, false) AS accepted, value <= 10 OR (value <= 20 AND event_id % 7 < 3) AS silent, NOT (value <= 10 OR (value <= 20 AND event_id % 7 < 3)) AND event_id % 7 >= 4 AND event_id % 5 <= 2 AS fits FROM ev""")
def word_acceptance(spark, sf_dir):
    e = _events(spark, sf_dir)
    s, v = F.col("start_ms") / 1000, F.col("value")
    quiet = words.silent(v, F.lit(10), F.lit(20), F.col("event_id") % 7, 3)
    return e.select("event_id", words.accepted(s, F.col("end_ms") / 1000, v / 100, F.lit(3600.0), F.lit(2000000.0)).alias("accepted"), quiet.alias("silent"), words.fitting(quiet, F.col("event_id") % 7, F.col("event_id") % 5, 4, 2).alias("fits"))


@query(f"""WITH {_EV}, o AS (SELECT *, value / 100 AS score FROM ev)
SELECT event_id, last_value(CASE WHEN score >= 0.3 THEN end_ms END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor_before,
  first_value(CASE WHEN score >= 0.3 THEN start_ms END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS anchor_after FROM o""")
def nearest_anchors(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "start_ms", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), (F.col("value") / 100).alias("score"))
    return words.nearest_anchors(e, ["user_id"], ["start_ms", "event_id"]).select("event_id", "anchor_before", "anchor_after")


@query(f"""WITH {_EV}, o AS (SELECT *, start_ms // 86400000 AS block FROM ev), n AS (SELECT *, lag(block) OVER w AS pb, lead(block) OVER w AS nb, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM o WINDOW w AS {_OVER})
SELECT event_id, round(greatest(0.0, start_ms / 1000.0::DOUBLE - 0.12, CASE WHEN pb = block THEN pe / 1000.0::DOUBLE ELSE 0.0 END), 6) AS window_start, round(least(end_ms / 1000.0::DOUBLE + 0.12, CASE WHEN nb = block THEN ns / 1000.0::DOUBLE ELSE end_ms / 1000.0::DOUBLE + 0.12 END), 6) AS window_end FROM n""")
def wider_windows(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "start_ms", F.floor(F.col("start_ms") / 86_400_000).alias("block"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    w = words.wider_window(e, ["user_id"], ["start_ms", "event_id"], "block")
    return w.select("event_id", F.round("window_start", 6).alias("window_start"), F.round("window_end", 6).alias("window_end"))


@query("""WITH n AS (SELECT l_orderkey, l_partkey % 3 AS word, l_suppkey % 2 AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS k, l_quantity FROM lineitem),
f AS (SELECT *, CASE WHEN lag(word) OVER w = word AND lag(block) OVER w = block AND lag(l_quantity) OVER w < 45 THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY k))
SELECT l_orderkey, k, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM f""")
def contiguous_groups(spark, sf_dir):
    order = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_shipdate l_discount l_tax".split()
    n = _read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).alias("word"), (F.col("l_suppkey") % 2).alias("block"), "l_quantity", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("k"))
    n = n.withColumns({"s": F.col("k").cast("double"), "e": F.col("k") + F.when(F.col("l_quantity") < 45, 1.0).otherwise(0.5)})
    return words.contiguous_groups(n, ["l_orderkey"], ["k"], "word", "block", "s", "e").select("l_orderkey", "k", "group_no")


@query(f"""WITH {_FRAMES}, c AS (SELECT *, CASE WHEN fits IS DISTINCT FROM lag(fits) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS ch FROM fr), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c),
q AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, bool_and(NOT silent) OVER (PARTITION BY user_id, run) AS loud, min(run) OVER (PARTITION BY user_id) AS a, max(run) OVER (PARTITION BY user_id) AS z FROM r)
SELECT user_id, i, fits OR (run > a AND run < z AND n <= 2 AND loud) AS bridged FROM q""")
def bridged_runs(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("loud", ~F.col("silent"))
    return intervals.bridge(f, ["user_id"], ["i"], "fits", "loud", 2, "bridged").select("user_id", "i", "bridged")


@query("""WITH t AS (SELECT item_id, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
p AS (SELECT item_id, pos, token, pos // 12 AS line FROM t WHERE pos % 5 <> 2), g AS (SELECT *, pos - row_number() OVER (PARTITION BY item_id, line ORDER BY pos) AS i FROM p)
SELECT item_id, line, min(pos) AS first_pos, max(pos) AS last_pos, string_agg(token, ' ' ORDER BY pos) AS text FROM g GROUP BY item_id, line, i""")
def pending_islands(spark, sf_dir):
    t = _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "token")).select("item_id", F.col("p").cast("long").alias("pos"), "token")
    t = t.where("pos % 5 <> 2").withColumn("line", F.floor(F.col("pos") / 12))
    return review.pending_groups(t, ["item_id"], "pos", "line", "token").select("item_id", "line", "first_pos", "last_pos", "text")


@query("""SELECT l_suppkey, round(sum(-l_discount * l_quantity) / sum(l_quantity), 6) AS avg_logprob, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS no_speech, max(l_discount * 30) AS compression FROM lineitem GROUP BY 1""")
def hypothesis_rollup(spark, sf_dir):
    s = _read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("tokens"), (-F.col("l_discount")).alias("avg_logprob"), F.col("l_tax").alias("no_speech"), (F.col("l_discount") * 30).alias("compression"))
    r = L.roll_up_hypothesis(s, ["l_suppkey"])
    return r.select("l_suppkey", F.round("avg_logprob", 6).alias("avg_logprob"), F.round("no_speech", 6).alias("no_speech"), "compression")


@query("""WITH h AS (SELECT doc_id, u.k AS language, -((doc_id * (3 + 4 * u.r)) % 89) / 64.0::DOUBLE AS lp, ((doc_id * (5 + 2 * u.r)) % 64) / 64.0::DOUBLE AS ns, 2.0 + ((doc_id * (2 + u.r)) % 16) / 8.0::DOUBLE AS cr, u.r AS r, (doc_id * 7 % 65) / 64.0::DOUBLE AS pt, (doc_id * 13 % 65) / 64.0::DOUBLE AS en, doc_id % 3 <> 0 AS voice
  FROM labels, (SELECT unnest(['pt', 'en']) AS k, unnest([0, 1]) AS r) u),
s AS (SELECT *, lp - least(1.0, greatest(0.0, (cr - 2.4::DOUBLE) * 0.25::DOUBLE)) AS score, CASE WHEN en > pt THEN 'en' ELSE 'pt' END AS heard, greatest(pt, en) >= 0.65 AND greatest(pt, en) - least(pt, en) >= 0.20 AS strong FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, r) AS rn FROM s),
a AS (SELECT f.doc_id, f.language AS l1, f.score AS s1, f.lp AS lp1, f.cr AS cr1, g.score AS s2, f.heard, f.strong, f.voice, least(f.ns, g.ns) > 0.6 AS quiet, m.lp AS mlp, m.cr AS mcr
  FROM o f JOIN o g ON g.doc_id = f.doc_id AND f.rn = 1 AND g.rn = 2 JOIN o m ON m.doc_id = f.doc_id AND m.language = f.heard),
d AS (SELECT *, strong AND mlp >= -1 AND mcr <= 2.4::DOUBLE AS sound, strong AND s1 - s2 < 0.15::DOUBLE AS close FROM a), w AS (SELECT *, CASE WHEN sound OR close THEN heard ELSE l1 END AS won FROM d)
SELECT doc_id, CASE WHEN NOT voice AND quiet THEN NULL ELSE won END AS winner, CASE WHEN NOT voice AND quiet THEN 'confirmed_silence' WHEN sound THEN 'strong_acoustic_language' WHEN close THEN 'acoustic_tie_break' ELSE 'recognition_probability' END AS reason FROM w""")
def hypothesis_choice(spark, sf_dir):
    d = F.col("doc_id")
    labels = _read(spark, sf_dir, "labels").withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    heard = L.acoustic_evidence(F.create_map(F.lit("pt"), d * 7 % 65 / 64, F.lit("en"), d * 13 % 65 / 64))
    h = labels.select("doc_id", F.when(F.col("r") == 0, "pt").otherwise("en").alias("language"), F.lit("x").alias("text"), (-(d * (3 + 4 * F.col("r")) % 89) / 64).alias("avg_logprob"), (d * (5 + 2 * F.col("r")) % 64 / 64).alias("no_speech"), (2.0 + d * (2 + F.col("r")) % 16 / 8).alias("compression"), heard.alias("heard"), (d % 3 != 0).alias("has_voice"))
    return L.choose_hypothesis(h, ["doc_id"]).select("doc_id", "winner", "reason")


@query("""WITH c AS (SELECT l_suppkey, round(avg(l_extendedprice), 2) AS centre FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(sum(l_extendedprice * l_tax) / sum(l_tax), 4) AS mean, round(sum(CASE WHEN abs(l_extendedprice - centre) <= 5000 THEN l_tax ELSE 0 END) / sum(l_tax), 6) AS stability FROM lineitem JOIN c USING (l_suppkey) GROUP BY 1""")
def weighted_stability(spark, sf_dir):
    # One shuffle serves all; its number of tasks is given, since narrow rows that are put together by bytes are many to a sort.
    rows = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_tax").where("l_suppkey IS NOT NULL").repartition(spread(spark), "l_suppkey")
    mean = F.round(series.weighted_mean(F.col("l_extendedprice"), F.col("l_tax")), 4)
    told = rows.groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 2).alias("centre"), mean.alias("mean"))
    steady = series.stability(rows.join(told.select("l_suppkey", "centre"), "l_suppkey"), ["l_suppkey"], "l_extendedprice", "l_tax", "centre", 5000)
    return told.join(steady, "l_suppkey").select("l_suppkey", "mean", F.round("stability", 6).alias("stability"))


@query("""WITH f AS (SELECT l_orderkey, (l_partkey % 12) AS pitch, l_discount AS conf, list_transform(range(0, 12), lambda k: ((l_suppkey + k * 7) % 13) / 13.0::DOUBLE) AS chroma FROM lineitem)
SELECT l_orderkey, pitch, round(sum(chroma[(pitch + 1)::BIGINT] * greatest(conf, 0.05)) / sum(greatest(conf, 0.05)), 6) AS support, round(avg(conf), 6) AS confidence FROM f GROUP BY 1, 2""")
def harmonic_support(spark, sf_dir):
    f = _read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 12).alias("pitch"), F.col("l_discount").alias("conf"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: (F.col("l_suppkey") + k * 7) % 13 / 13.0).alias("chroma"))
    h = series.harmonic_support(f, ["l_orderkey", "pitch"], "chroma", "conf", "pitch")
    return h.select("l_orderkey", "pitch", F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_FRAMES}, w AS (SELECT user_id, i // 8 AS f, sqrt(avg(value * value)) > 60 AS loud, count(*) AS n FROM fr GROUP BY ALL)
SELECT user_id, round(coalesce(avg(CASE WHEN n = 8 THEN loud::INT END), max(loud::INT)), 6)::DOUBLE AS activity FROM w GROUP BY user_id""")
def signal_activity(spark, sf_dir):
    return series.activity(_frames(spark, sf_dir), ["user_id"], "i", "value", 8, 60).withColumn("activity", F.round("activity", 6))


@query("""WITH w AS (SELECT item_id, unnest(range(1, len(ws) + 1)) AS word_no, unnest(ws) AS text FROM (SELECT item_id, regexp_extract_all(text, '[^\\s]+') AS ws FROM benchmark)) SELECT item_id, word_no::INTEGER AS word_no, text FROM w""")
def character_words(spark, sf_dir):
    c = _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("pos", "char")).where("char <> ''")
    return words.chars_to_words(c.withColumns({"start": F.col("pos") / 10, "end": F.col("pos") / 10 + 0.1}), ["item_id"]).select("item_id", "word_no", "text")


@query(f"""WITH {_EV}, x AS (SELECT *, lag(end_ms) OVER {_OVER} AS pe, row_number() OVER {_OVER} AS n FROM ev),
p AS (SELECT user_id, n, CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'words_differ' WHEN event_id % 41 = 0 THEN 'no_time_or_score' WHEN start_ms < 3600000 OR end_ms > 2500000000 OR start_ms < pe THEN 'invalid_or_overlapping_times' WHEN value / 100 < 0.02 OR value / 100 > 1 THEN 'score_too_low' END AS problem FROM x)
SELECT user_id, arg_min(problem, CASE problem WHEN 'words_differ' THEN n ELSE 1000000 + n END) FILTER (WHERE problem IS NOT NULL) AS problem FROM p GROUP BY user_id""")
def alignment_problems(spark, sf_dir):
    e = _events(spark, sf_dir)
    differ = (F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)
    rows = e.select("user_id", "start_ms", "event_id", F.lit("a").alias("expected"), F.when(differ, "b").otherwise("a").alias("found"), F.when(F.col("event_id") % 41 != 0, F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), (F.col("value") / 100).alias("score"))
    # Without a start the order is still that of the events.
    return words.alignment_problem(rows, ["user_id"], ["start_ms", "event_id"], F.lit(3600.0), F.lit(2500000.0), F.lit(0.02))


@query(f"""WITH {_EV}, x AS (SELECT *, lag(end_ms) OVER {_OVER} AS pe FROM ev), r AS (
  SELECT user_id, start_ms, event_id, 'not_positive' AS rule FROM x WHERE event_id % 97 = 0 UNION ALL SELECT user_id, start_ms, event_id, 'outside' FROM x WHERE CASE WHEN event_id % 97 = 0 THEN start_ms ELSE end_ms END > 2400000000 UNION ALL
  SELECT user_id, start_ms, event_id, 'overlap' FROM (SELECT *, lag(CASE WHEN event_id % 97 = 0 THEN start_ms ELSE end_ms END) OVER {_OVER} AS q FROM ev) WHERE start_ms < q) SELECT * FROM r""")
def interval_rules(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("e", F.when(F.col("event_id") % 97 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    return intervals.interval_violations(e, ["user_id"], ["start_ms", "event_id"], "start_ms", "e", F.lit(2_400_000_000)).select("user_id", "start_ms", "event_id", "rule")


@query("""SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 17 IN (3, 5)""")
def changed_sources(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    now = d.where("doc_id % 17 <> 3").withColumn("sha256", F.when(F.col("doc_id") % 17 == 5, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return audit.changed_sources(d, now, ["doc_id"])


@query("""SELECT l_orderkey, printf('%.2f', l_extendedprice) AS price, printf('%.6f', l_discount) AS discount, CASE WHEN l_returnflag = 'R' THEN 'SIM' ELSE 'NÃO' END AS returned, l_linestatus || ' | ' || l_returnflag AS marks, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def separated_values(spark, sf_dir):
    l = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (F.col("l_returnflag") == "R").alias("returned"), F.array("l_linestatus", "l_returnflag").alias("marks"))
    return writers.separated(l, {"price": 2}).groupBy(F.col("l_orderkey").cast("long").alias("l_orderkey"), "price", "discount", "returned", "marks").agg(F.count("*").alias("n"))


@query(f"""WITH {_EV}, t AS (SELECT event_id, floor(start_ms / 1000.0::DOUBLE * 3840 + 0.5)::BIGINT AS tick_on, floor((start_ms + (end_ms - start_ms) % 3 / 16.0::DOUBLE) / 1000.0::DOUBLE * 3840 + 0.5)::BIGINT AS tick_off FROM ev)
SELECT event_id, tick_on, tick_off, CASE WHEN tick_off <= tick_on THEN 'no_length' END AS problem FROM t""")
def note_ticks(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", (F.col("start_ms") / 1000).alias("start"), ((F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) % 3 / 16) / 1000).alias("end"))
    return writers.note_ticks(e).select("event_id", "tick_on", "tick_off", "problem")


@query("""SELECT o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS word FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0""")
def named_words(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("song"), F.col("o_custkey").cast("string").alias("word_id"))
    c = _read(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.lit(1).alias("song"), F.col("c_custkey").cast("string").alias("word_id"), F.col("c_name").alias("text"))
    return words.named_words(o, c, ["song"]).select("o_orderkey", "word")


@query(f"""WITH {_EV} SELECT event_id, EXISTS (SELECT 1 FROM ev o WHERE o.event_type = 'purchase' AND o.user_id = e.user_id AND o.start_ms < e.end_ms + 600000 AND o.end_ms > e.start_ms) AS has_voice FROM ev e WHERE event_type = 'view'""")
def voice_in_windows(spark, sf_dir):
    e = _events(spark, sf_dir)
    windows = e.where("event_type = 'view'").withColumn("end_ms", F.col("end_ms") + 600_000)
    return intervals.overlapping(windows, e.where("event_type = 'purchase'"), ["user_id"], "start_ms", "end_ms").select("event_id", F.col("overlaps").alias("has_voice"))


@query("""SELECT doc_id, line_no::INTEGER AS no, CASE WHEN regexp_matches(line, '^\\s*\\[.*\\]\\s*$') THEN 'label' WHEN regexp_matches(line, '(?i)(^|[^\\p{L}\\p{N}_])\\d+\\s*[x×]\\s*$') THEN 'repetition' WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'no_words' END AS problem
FROM (SELECT doc_id, text, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, text, string_split(t, chr(10)) AS parts FROM (SELECT doc_id, text, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM documents)))""")
def lyric_lines(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return captions.lyrics(d, "doc_id").select("doc_id", "no", "problem")


@query(f"""WITH {_EV}, p AS (SELECT *, row_number() OVER {_OVER} AS n, lag(end_ms) OVER {_OVER} AS pe FROM ev) SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE start_ms < pe)::BIGINT AS overlaps FROM p GROUP BY user_id""")
def strict_captions(spark, sf_dir):
    rows = captions.captions(srt_render(spark, sf_dir), mode="strict", key="user_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("problem") == "overlap").alias("overlaps"))


@query("""SELECT o_custkey::VARCHAR AS song_id, o_orderstatus AS role, count(*)::BIGINT AS n, CASE WHEN count(*) <> 1 THEN 'not_one_file' WHEN min(o_totalprice) < 50000 THEN 'empty_file' END AS problem FROM orders GROUP BY 1, 2""")
def files_by_role(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("song_id"), F.col("o_orderstatus").alias("role"), F.when(F.col("o_totalprice") < 50000, 0).otherwise(1).alias("length"))
    return captions.one_file_per_role(o)


@query("""SELECT DISTINCT o_orderpriority || o_orderkey % 5000 AS identity FROM orders WHERE o_orderpriority || o_orderkey % 5000 NOT IN (SELECT o_orderpriority || o_orderkey % 5000 FROM orders WHERE o_orderkey % 3 = 0)""")
def missing_identities(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.col("o_orderkey") % 5000).alias("identity"))
    return captions.missing(o.select("identity").distinct(), o.where("o_orderkey % 3 = 0"))


@query("""SELECT doc_id FROM (SELECT doc_id, doc_id % 23 AS pt_votes, doc_id % 7 AS en_votes, (doc_id * 3 % 65) / 64.0::DOUBLE AS pp, (doc_id * 11 % 65) / 64.0::DOUBLE AS pe, doc_id % 2 = 0 AS strong, CASE WHEN doc_id % 3 = 0 THEN 'pt' ELSE 'en' END AS winner, CASE WHEN doc_id % 5 = 0 THEN 'pt' ELSE 'en' END AS heard, 9.0 + doc_id % 8 AS span FROM labels)
WHERE span > 12 AND (least(pp, pe) >= 0.15 OR (least(pt_votes, en_votes) >= 2 AND least(pt_votes, en_votes) / greatest(1, pt_votes + en_votes)::DOUBLE >= 0.2) OR (strong AND winner <> heard))""")
def windows_to_split(spark, sf_dir):
    d = F.col("doc_id")
    a = _read(spark, sf_dir, "labels").select("doc_id", (d % 23).alias("pt_votes"), (d % 7).alias("en_votes"), (d * 3 % 65 / 64).alias("pt_prob"), (d * 11 % 65 / 64).alias("en_prob"), (d % 2 == 0).alias("strong"), F.when(d % 3 == 0, "pt").otherwise("en").alias("winner"), F.when(d % 5 == 0, "pt").otherwise("en").alias("heard"), F.lit(0).alias("level"), F.lit(0.0).alias("start"), (9.0 + d % 8).alias("end"))
    return words.split_windows(a).select("doc_id")


@query(f"""WITH {_EV}, b AS (SELECT user_id, event_id, start_ms, end_ms, CASE WHEN event_type = 'click' THEN 'corrected' WHEN event_type = 'error' THEN 'inserted' ELSE 'kept' END AS origin FROM ev),
p AS (SELECT *, start_ms < lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms, origin) AS over FROM b)
SELECT user_id, count(*)::BIGINT AS published, count(*) FILTER (WHERE origin = 'kept')::BIGINT AS kept, count(*) FILTER (WHERE origin = 'corrected')::BIGINT AS corrected, count(*) FILTER (WHERE origin = 'inserted')::BIGINT AS inserted, count(*) FILTER (WHERE over)::BIGINT AS overlaps FROM p GROUP BY user_id""")
def published_captions(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", F.col("event_id").alias("idx"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("event_type").alias("text"))
    kept, new = e.where("event_type <> 'error'").drop("event_type"), e.where("event_type = 'error'").drop("event_type")
    fixed = kept.where("text = 'click'").select("user_id", "idx", F.lit("CLICK").alias("text"))
    return words.run_metrics(words.consolidate(kept, fixed, new, ["user_id"]), ["user_id"])


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, line_no, unnest(range(0, len(ws))) AS i, unnest(ws) AS t FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{_TOKEN}') AS ws FROM lines WHERE line_no < 3)),
c AS (SELECT *, greatest(1, length(t)) AS k FROM w), s AS (SELECT *, sum(k) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS UNBOUNDED PRECEDING)::DOUBLE AS up, sum(k) OVER (PARTITION BY doc_id, line_no)::DOUBLE AS total FROM c)
SELECT doc_id, line_no::BIGINT AS block, i + 1 AS no, t AS text, round(line_no * 5.0 + 4.0 * ((up - k) / total), 6) AS start, round(line_no * 5.0 + 4.0 * (up / total), 6) AS "end" FROM s""")
def proportional_words(spark, sf_dir):
    """The words of the first lines of documents as captions for which an engine has no result."""
    lines = _lines(spark, sf_dir).where("line_no < 3").select(F.col("doc_id").alias("song_id"), F.col("line_no").cast("long").alias("block"), (F.col("line_no") * 5.0).alias("start"), (F.col("line_no") * 5.0 + 4).alias("end"), T.tokens(F.col("line")).alias("words"))
    none = F.lit(None)
    caps = lines.withColumns({"keys": F.col("words"), "found": none.cast("array<struct<key:string,start:double,end:double,score:double>>"), "confirmed": none.cast("map<int,struct<start:double,end:double>>")})
    return placement.align_captions(caps, 1e6).select(F.col("song_id").alias("doc_id"), "block", "no", "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"""WITH {_FRAMES}, w AS (SELECT user_id, min(i) AS a, max(i) + 1 AS z FROM fr GROUP BY user_id), p AS (SELECT *, quantile_cont(abs(value), 0.9) OVER (PARTITION BY user_id) AS p90 FROM fr), c AS (SELECT user_id, i, abs(value) >= greatest(1e-4, p90 * 0.04) AS active, event_type_ok FROM (SELECT p.*, fits AS event_type_ok FROM p)),
s AS (SELECT user_id, avg((active AND event_type_ok)::INT) AS coverage FROM c GROUP BY user_id) SELECT user_id, round(coverage, 6) AS coverage FROM s""")
def core_coverage(spark, sf_dir):
    """Users as syllables whose frames are events: the share that is sung on a pitch."""
    f = _frames(spark, sf_dir).select(F.col("user_id").cast("string").alias("song_id"), F.col("i").cast("double").alias("t"), F.abs("value").alias("rms"), F.when(F.col("fits"), 0.9).otherwise(0.1).alias("per"))
    units = f.groupBy("song_id").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).withColumn("vowels", F.array().cast("array<struct<start:double,end:double>>"))
    return syllables.cores(units, f, ["song_id"], 1.0, 64.0).select(F.col("song_id").cast("long").alias("user_id"), F.round("coverage", 6).alias("coverage"))


@query()
def embedding_frames(spark, sf_dir):
    """Embeddings as short signals: level, periodicity, flux and timbre by frame, chunks of three frames."""
    signals = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.lit(2000).alias("rate"))
    return frames.frame_evidence(signals, "vec_id", n_frames=3).drop("timbre")


@query("""SELECT item_id, regexp_replace(array_to_string(w[3:6], ' '), '\\s+', ' ', 'g') AS slice, regexp_replace(array_to_string(w[8:], ' '), '\\s+', ' ', 'g') AS rest FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)""")
def text_slices(spark, sf_dir):
    """Tokens 2 to 5, and from 7 on, by the places where tokens begin."""
    b = _read(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " "))
    offsets = F.transform("w", lambda x, i: F.aggregate(F.slice("w", 1, i), F.lit(0), lambda s, y: s + F.char_length(y) + 1))
    b = b.withColumn("o", offsets)
    return b.select("item_id", words.text_slice(F.col("text"), F.col("o"), F.lit(2), F.lit(6)).alias("slice"), words.text_slice(F.col("text"), F.col("o"), F.lit(7), F.size("o")).alias("rest"))


@query(f"""WITH {_NOTES}, p AS (SELECT l_orderkey, k, e - l AS s, e FROM t) SELECT l_orderkey::VARCHAR AS song_id, k::INTEGER AS no, floor(s * 3840 + 0.5 + 1e-6)::BIGINT AS tick_on, floor(e * 3840 + 0.5 + 1e-6)::BIGINT AS tick_off, (40 + k % 30)::INTEGER AS pitch FROM p""")
def note_file_round_trip(spark, sf_dir):
    """Line items as notes of orders, written to note files and read back."""
    n = _notes(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("song_id"), F.col("k").alias("ord"), F.col("s").alias("start"), F.col("e").alias("end"), (40 + F.col("k") % 30).cast("int").alias("pitch"), F.concat(F.lit("s"), "k").alias("text"))
    return publication.read_notes(publication.note_files(n)).select("song_id", "no", "tick_on", "tick_off", "pitch")


@query("""WITH n AS (SELECT l_orderkey, max(36 + l_partkey % 60) AS peak, count(DISTINCT l_partkey % 60) AS kinds FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, 0.85 * least(1.0, greatest(0.0, (peak - 60) / 24.0::DOUBLE)) + 0.15 * least(1.0, greatest(0.0, (kinds - 1) / 11.0::DOUBLE)) AS score FROM n)
SELECT l_orderkey AS song_id, '{"title":"","artist":"","difficulty":"' || CASE WHEN score >= 0.65 THEN 'advanced' WHEN score >= 0.35 THEN 'intermediate' ELSE 'beginner' END || '","language":"pt-BR","offset":0,"lyricsOffset":0}' AS content FROM s""")
def song_metadata(spark, sf_dir):
    n = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("song_id"), (36 + F.col("l_partkey") % 60).alias("pitch"), F.lit(0.0).alias("start"), F.col("l_quantity").alias("end"))
    return publication.metadata(n)


@query(f"""WITH {_EV} SELECT event_id AS id, event_id AS word_id, start_ms AS core_start, end_ms AS core_end, array_to_string(list_filter(['old', CASE WHEN event_type = 'error' THEN 'approximate_times' END], lambda x: x IS NOT NULL), ',') AS warnings FROM ev""")
def word_units(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.when(F.col("event_type") == "error", "fallback_share").otherwise("model").alias("origin"), F.array(F.lit("old")).alias("warnings"))
    return captions.words_as_units(e).select("id", "word_id", "core_start", "core_end", F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT o_custkey AS song_id, o_orderkey AS block FROM orders WHERE o_custkey % 4 <> 1 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)""")
def confirmed_blocks(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    flags = F.array(*[F.struct((F.col("o_orderkey") % k == 0).alias("confirmed")) for k in (3, 5)])
    m = o.select(F.col("o_custkey").alias("song_id"), F.lit("a").alias("sha256"), F.col("o_orderkey").alias("block"), flags.alias("words"))
    now = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("song_id"), F.when(F.col("c_custkey") % 4 == 1, "b").otherwise("a").alias("sha256"))
    return captions.confirmed_blocks(m, now).select("song_id", "block")


@query("""WITH c AS (SELECT o_orderkey, list_transform(range(1, length(o_orderpriority) + 1), lambda i: {'c': substr(o_orderpriority, i, 1), 's': ((o_orderkey + i) % 10) / 10.0::DOUBLE, 'i': i}) AS cs FROM orders)
SELECT o_orderkey, len(list_filter(cs, lambda x: regexp_matches(x.c, '^[\\p{L}\\p{N}]$')))::INTEGER AS lexical, len(list_filter(cs, lambda x: x.s >= 0.3::DOUBLE AND x.i <= 6))::INTEGER AS usable, round(list_sum(list_transform(cs, lambda x: x.s)) / len(cs), 6) AS score FROM c""")
def character_scores(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.split("o_orderpriority", "").alias("letters"))
    chars = F.transform("letters", lambda c, i: F.struct(c.alias("char"), i.cast("double").alias("start"), (i + 1).cast("double").alias("end"), ((F.col("o_orderkey") + i + 1) % 10 / 10).alias("score")))
    o = o.withColumn("cs", chars)
    return o.select("o_orderkey", F.size(words.lexical_chars(F.col("cs"))).alias("lexical"), F.size(words.usable_chars(F.col("cs"), F.lit(0.0), F.lit(6.0))).alias("usable"), F.round(words.mean_score(F.col("cs"), F.lit(None).cast("double")), 6).alias("score"))


@query(f"""WITH {_EV} SELECT event_id, '{{"event_id":' || event_id || ',"start_ms":' || start_ms || ',"event_type":"' || event_type || '"}}' AS body FROM ev""")
def finite_rows(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", writers.finite_json(F.struct("event_id", "start_ms", "event_type")).alias("body"))
