"""Registered queries over the driver tables and their SQL.

The tables are not songs: events, orders and embeddings stand in for captions,
frames and notes, and show that the operators compute what they say."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import language as L
from tessitura.functions import text as T
from tessitura.operators import alignment, audit, captioning, intervals, review, sequence, series, structure
from tessitura.sources import captions, writers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    """Events as intervals in milliseconds since 2024 of each user."""
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", start.alias("start_ms"))
    return e.withColumn("end_ms", F.col("start_ms") + 1 + F.floor(F.abs("value") * 1000).cast("long"))


_EV = """ev AS (
  SELECT event_id, user_id, event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS start_ms,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 + 1 + floor(abs(value) * 1000)::BIGINT AS end_ms
  FROM events)"""


def _lines(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = """lines AS (
  SELECT doc_id, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_VOTES = f"""votes AS (
  SELECT doc_id, line_no, line, w,
         len(list_filter(w, lambda x: x IN ({_listed(L.ONLY_PT)}) OR regexp_matches(x, '[ãõç]'))) AS pt,
         len(list_filter(w, lambda x: x IN ({_listed(L.ONLY_EN)}))) AS en
  FROM (SELECT *, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') AS w FROM lines))"""


@query(
    f"""WITH {_LINES}, {_VOTES}, own AS (
  SELECT *, CASE WHEN en > pt THEN 'en' WHEN pt > en THEN 'pt' END AS own,
         CASE WHEN sum(en) OVER (PARTITION BY doc_id) > sum(pt) OVER (PARTITION BY doc_id) THEN 'en' ELSE 'pt' END AS overall,
         len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+(?:[''’\\-][\\p{{L}}\\p{{N}}]+)*')) AS toks
  FROM votes), l AS (
  SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), overall) AS language FROM own)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(toks)::BIGINT AS n_tokens, count(*) FILTER (WHERE own IS NULL)::BIGINT AS n_inherited,
       CASE WHEN count(*) FILTER (WHERE language = 'en') > count(*) FILTER (WHERE language = 'pt') THEN 'en' ELSE 'pt' END AS dominant
FROM l GROUP BY doc_id"""
)
def line_language(spark, sf_dir):
    lines = L.line_languages(_lines(spark, sf_dir), ["doc_id"], ["line_no"])
    en, pt = F.count_if(F.col("language") == "en"), F.count_if(F.col("language") == "pt")
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.size(T.tokens(F.col("line")))).cast("long").alias("n_tokens"), F.count_if("inherited").alias("n_inherited"), F.when(en > pt, "en").otherwise("pt").alias("dominant")
    )


@query(
    """SELECT conv_id, turn, regexp_extract(low, '^[^\\p{L}]*') || upper(substr(low, length(regexp_extract(low, '^[^\\p{L}]*')) + 1, 1)) || substr(low, length(regexp_extract(low, '^[^\\p{L}]*')) + 2) AS text
FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations)"""
)
def sentence_case(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentence_case(F.col("text")).alias("text"))


@query(
    """SELECT item_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS token
FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’\\-][\\p{L}\\p{N}]+)*') AS w FROM benchmark)"""
)
def token_index(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    return b.select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), "token")


@query(
    f"""SELECT key, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM (
  SELECT doc_id, regexp_replace(translate(replace(lower(w), 'ß', 'ss'), '{T.ACCENTED}', '{T.BASE}'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[''’\\-][\\p{{L}}\\p{{N}}]+)*')) AS w FROM documents)) GROUP BY key"""
)
def comparison_key(spark, sf_dir):
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    keys = T.comparison_keys(T.tokens(F.col("text")))
    ids = documents.where("doc_id is not null").groupBy("doc_id").count()
    if ids.where("count > 1").isEmpty():
        # Each document is one row: its distinct keys come after its words, so only counts of keys are shuffled.
        words = documents.withColumn("keys", keys).select(F.size("keys").alias("m"), "doc_id", F.posexplode(F.concat("keys", F.array_distinct("keys"))).alias("i", "key"))
        return words.groupBy("key").agg(F.count_if(F.col("i") < F.col("m")).alias("n"), F.count_if((F.col("i") >= F.col("m")) & F.col("doc_id").isNotNull()).alias("docs"))
    counted = documents.select("doc_id", F.explode(keys).alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("c"))
    return counted.groupBy("key").agg(F.sum("c").alias("n"), F.count("doc_id").alias("docs"))


@query("SELECT sha256(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_identity(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


#: Names of character references, from the standard library; the longest one that a reference begins with counts.
_NAMES = "map {" + ", ".join(f"'&{k}': " + " || ".join(f"chr({ord(c)})" for c in v) for k, v in html5.items()) + "}"


@query(
    f"""WITH names AS MATERIALIZED (SELECT {_NAMES} AS m), p AS (SELECT page_id, html, regexp_extract_all(html, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]{{0,31}};?|[^&]+|&') AS parts FROM pages),
e AS (SELECT DISTINCT unnest(parts) AS part FROM p), known AS (SELECT part, CASE
  WHEN part[1] <> '&' OR part = '&' THEN part
  WHEN regexp_matches(part, '^&#[0-9]') THEN chr(regexp_extract(part, '[0-9]+')::INTEGER)
  WHEN regexp_matches(part, '^&#') THEN chr(('0x' || regexp_extract(part, '[xX]([0-9a-fA-F]+)', 1))::INTEGER)
  ELSE coalesce(list_filter(list_transform(range(length(part), 1, -1), lambda k: m[part[1:k]] || part[k + 1:]), lambda x: x IS NOT NULL)[1], part) END AS sign FROM e, names),
r AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM p),
t AS (SELECT page_id, nfc_normalize(string_agg(sign, '' ORDER BY k)) AS html FROM r JOIN known USING (part) GROUP BY page_id)
SELECT page_id, trim(regexp_replace(translate(regexp_replace(regexp_replace(coalesce(t.html, p.html),
  '<[^>]*>', '', 'g'), '\\{{\\\\[^}}]*\\}}', '', 'g'), '♪♫' || chr(65279), '  '), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS text FROM p LEFT JOIN t USING (page_id)"""
)
def markup_clean(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text"))


_STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"


@query(
    f"""WITH {_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS n FROM ev)
SELECT user_id, string_agg(n || chr(10) || {_STAMP.format("start_ms")} || ' --> ' || {_STAMP.format("end_ms")} || chr(10) || event_type || chr(10), chr(10) ORDER BY n) AS content FROM n GROUP BY user_id"""
)
def srt_render(spark, sf_dir):
    return writers.subtitle_text(_events(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], text="event_type")


@query(f"""WITH {_EV} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id)::INTEGER AS idx, start_ms, end_ms, event_type AS text FROM ev""")
def srt_round_trip(spark, sf_dir):
    back = captions.captions(srt_render(spark, sf_dir), mode="lenient", key="user_id")
    return captions.must_hold(back).select("user_id", "idx", "start_ms", "end_ms", "text")


@query(
    f"""WITH {_EV}, p AS (SELECT *, lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS previous_end FROM ev)
SELECT event_id, user_id, start_ms, previous_end FROM p WHERE start_ms < previous_end"""
)
def overlap_violations(spark, sf_dir):
    found = intervals.overlaps(_events(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], "start_ms", "end_ms")
    return found.select("event_id", "user_id", "start_ms", "previous_end")


@query(
    f"""WITH {_EV}, d AS (SELECT max(end_ms) + 1000 AS d FROM ev), inner_gaps AS (
  SELECT user_id, end_ms AS gap_start, coalesce(lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id), d) AS gap_end FROM ev, d
), firsts AS (SELECT user_id, 0::BIGINT AS gap_start, min(start_ms) AS gap_end FROM ev GROUP BY user_id)
SELECT user_id, gap_start, gap_end FROM (SELECT * FROM inner_gaps UNION ALL SELECT * FROM firsts) WHERE gap_end > gap_start"""
)
def free_gaps(spark, sf_dir):
    e = _events(spark, sf_dir)
    end = e.agg((F.max("end_ms") + 1000).alias("d"))
    e = e.crossJoin(F.broadcast(end))  # one row
    return intervals.gaps(e, ["user_id"], ["start_ms", "event_id"], "start_ms", "end_ms", F.col("d")).select("user_id", "gap_start", "gap_end")


_LOCATED = f"""{_EV}, o AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS ord, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e,
         event_type, 1.0::DOUBLE - (event_id % 40) / 100.0::DOUBLE AS score, (event_id % 4) AS n_words FROM ev
), located AS (
  SELECT user_id, ord, s, e, n_words, CASE WHEN event_type <> 'error' THEN score END AS score,
         CASE WHEN event_type <> 'error' THEN 10 * ord END AS token_start, CASE WHEN event_type <> 'error' THEN 10 * ord + 7 END AS token_end FROM o)"""


@query(
    f"""WITH {_LOCATED}, a AS (SELECT * FROM located WHERE NOT (token_start IS NULL AND n_words <= 2 AND e - s <= 1.0)),
w AS (SELECT *, lead(ord) OVER q AS after_ord, lead(token_start) OVER q AS next_start, lead(s) OVER q AS next_s, lead(score) OVER q AS next_score, row_number() OVER q AS rn
  FROM a WINDOW q AS (PARTITION BY user_id ORDER BY ord)),
p AS (
  SELECT user_id, ord AS before_ord, after_ord, token_end AS token_from, CASE WHEN after_ord IS NULL THEN 5000 ELSE next_start END AS token_to, e AS gap_start, coalesce(next_s, 3000000.0) AS gap_end, least(score, next_score) AS score FROM w
  UNION ALL SELECT user_id, NULL, ord, 0, token_start, 0.0, s, score FROM w WHERE rn = 1)
SELECT user_id, before_ord, after_ord, token_from, token_to, round(gap_end - gap_start, 3) AS seconds,
  CASE WHEN gap_end - gap_start <= 0.01 THEN 'no_time_between_captions' WHEN gap_end - gap_start > least(180000.0, greatest(30.0, 3.0 * (token_to - token_from))) THEN 'gap_too_long_to_search'
       WHEN score < 0.75 THEN 'weak_text_anchors' END AS reason
FROM p WHERE token_from < token_to"""
)
def gap_plan(spark, sf_dir):
    o = _events(spark, sf_dir).withColumn("ord", F.row_number().over(W.partitionBy("user_id").orderBy("start_ms", "event_id")).cast("long"))
    known = F.col("event_type") != "error"
    located = o.select(
        "user_id", "ord", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), (F.col("event_id") % 4).alias("n_words"),
        F.when(known, 1.0 - (F.col("event_id") % 40) / 100).alias("score"), F.when(known, F.col("ord") * 10).alias("token_start"), F.when(known, F.col("ord") * 10 + 7).alias("token_end"),
    )
    plan = intervals.plan_gaps(located, ["user_id"], F.lit(5000).cast("long"), F.lit(3000000.0), longest=180000.0)
    return plan.select("user_id", "before_ord", "after_ord", "token_from", "token_to", F.round(F.col("gap_end") - F.col("gap_start"), 3).alias("seconds"), "reason")


@query(
    f"""WITH {_EV}, s AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) < 7200000 THEN 0 ELSE 1 END AS fresh FROM ev),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM n GROUP BY user_id, session"""
)
def pause_sessions(spark, sf_dir):
    s = intervals.sessions(_events(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], "start_ms", "end_ms", 7_200_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(
    f"""WITH {_EV}, r AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT user_id, run::BIGINT AS run, event_type, count(*)::BIGINT AS n, min(start_ms) AS start_ms FROM n GROUP BY user_id, run, event_type"""
)
def contiguous_runs(spark, sf_dir):
    r = intervals.runs(_events(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], F.col("event_type"))
    return r.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"))


_FRAMES = f"""{_EV}, fr AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - 1 AS i, event_type = 'error' AS silent, event_type IN ('view', 'click', 'purchase') AS fits, value FROM ev)"""


def _frames(spark, sf_dir) -> DataFrame:
    i = F.row_number().over(W.partitionBy("user_id").orderBy("start_ms", "event_id")).cast("long") - 1
    return _events(spark, sf_dir).select("user_id", i.alias("i"), (F.col("event_type") == "error").alias("silent"), F.col("event_type").isin("view", "click", "purchase").alias("fits"), "value")


@query(
    f"""WITH {_FRAMES}, c AS (
  SELECT *, CASE WHEN silent IS DISTINCT FROM lag(silent) OVER w THEN 1 ELSE 0 END AS cs, CASE WHEN fits IS DISTINCT FROM lag(fits) OVER w THEN 1 ELSE 0 END AS cf FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY i)
), r AS (SELECT *, sum(cs) OVER w AS rs, sum(cf) OVER w AS rf FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, rs ORDER BY i) AS ls, row_number() OVER (PARTITION BY user_id, rf ORDER BY i) AS lf FROM r
), s AS (SELECT *, min(CASE WHEN silent AND ls >= 2 OR NOT fits AND lf >= 4 THEN i END) OVER (PARTITION BY user_id) AS stop_at FROM l
), b AS (SELECT *, max(CASE WHEN fits THEN i END) OVER (PARTITION BY user_id) AS good FROM s WHERE stop_at IS NULL OR i < stop_at)
SELECT user_id, min(stop_at) AS stop_at, max(good) AS last_good, round(count(*) FILTER (WHERE fits AND i <= good) / (max(good) + 1)::DOUBLE, 6) AS coverage FROM b GROUP BY user_id"""
)
def run_confirmed_stop(spark, sf_dir):
    f = intervals.confirmed_stop(_frames(spark, sf_dir), ["user_id"], "i", "silent", "fits", 1.0, silence=2.0, failure=4.0)
    return f.select("user_id", "stop_at", "last_good", F.round("coverage", 6).alias("coverage"))


@query(
    f"""WITH {_EV}, w AS (SELECT user_id, event_id AS window_id, start_ms AS a, start_ms + 21600000 AS b FROM ev WHERE event_type = 'purchase')
SELECT w.user_id, window_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM w JOIN ev ON ev.user_id = w.user_id AND ev.start_ms >= a AND ev.start_ms < b GROUP BY w.user_id, window_id"""
)
def frames_in_window(spark, sf_dir):
    e = _events(spark, sf_dir)
    w = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("window_id"), F.col("start_ms").alias("a"), (F.col("start_ms") + 21_600_000).alias("b"))
    found = intervals.points_in_intervals(e, w, ["user_id"], "start_ms", "a", "b", 21_600_000)
    return found.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    f"""WITH {_EV} SELECT event_id, user_id FROM ev e WHERE event_type <> 'error' AND NOT EXISTS (
  SELECT 1 FROM ev o WHERE o.event_type = 'error' AND o.user_id = e.user_id AND e.start_ms < o.end_ms AND e.end_ms > o.start_ms)"""
)
def occupied_conflicts(spark, sf_dir):
    e = _events(spark, sf_dir)
    return intervals.conflict_free(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), ["user_id"], "start_ms", "end_ms").select("event_id", "user_id")


_TIES = "l_extendedprice, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_discount, l_tax"


@query(
    f"""WITH c AS (SELECT l_partkey, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY {_TIES} ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER (PARTITION BY l_partkey) AS t FROM lineitem)
SELECT l_partkey, min(l_extendedprice) AS centre FROM c WHERE c >= t / 2 GROUP BY l_partkey"""
)
def weighted_median(spark, sf_dir):
    return series.weighted_median(_read(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", "l_quantity", _TIES.split(", ")[1:])


@query(
    f"""WITH v AS (SELECT *, floor(l_extendedprice / 1000)::BIGINT AS k, floor(min(l_extendedprice) OVER (PARTITION BY l_suppkey) / 1000)::BIGINT AS low FROM lineitem
), h AS (SELECT l_suppkey, k, sum(l_quantity) AS w FROM v GROUP BY ALL
), b AS (SELECT l_suppkey, k * 1000 + 500.0 AS middle FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, k) AS r FROM h) WHERE r = 1
), n AS (SELECT v.* FROM v JOIN b USING (l_suppkey) WHERE abs(l_extendedprice - middle) <= 5500 + 1e-9
), c AS (SELECT l_suppkey, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY {_TIES} ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS t FROM n)
SELECT l_suppkey, min(l_extendedprice) AS centre FROM c WHERE c >= t / 2 GROUP BY l_suppkey"""
)
def plateau_centre(spark, sf_dir):
    return series.plateau_centre(_read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", [*_TIES.split(", ")[1:]], bin_width=1000.0, half_width=5500.0)


@query(
    """WITH p AS (SELECT *, quantile_cont(l_extendedprice, 0.9) OVER (PARTITION BY l_suppkey) AS p90 FROM lineitem),
w AS (SELECT l_suppkey, pow(greatest(1 - l_discount, 0.01), 2) * least(greatest(CASE WHEN p90 <= 1e-12 THEN 1.0 ELSE l_extendedprice / p90 END, 0.35), 1.0) AS w FROM p)
SELECT l_suppkey, count(*)::BIGINT AS n, round(sum(w), 4) AS total, round(min(w), 6) AS least, round(max(w), 6) AS most FROM w GROUP BY l_suppkey"""
)
def energy_weights(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").withColumn("p", 1 - F.col("l_discount"))
    w = series.pitch_weight(rows, ["l_suppkey"], "p", "l_extendedprice")
    return w.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.min("weight"), 6).alias("least"), F.round(F.max("weight"), 6).alias("most"))


@query(
    """WITH c AS (SELECT p_partkey, 36 + p_retailprice % 60 AS centre, p_size / 50.0::DOUBLE AS occupancy FROM part),
d AS (SELECT *, unnest(range(greatest(floor(centre + 0.5)::BIGINT - 2, 36), least(floor(centre + 0.5)::BIGINT + 2, 96) + 1)) AS pitch FROM c),
s AS (SELECT *, 0.42 * exp(-0.5 * pow((pitch - centre) * 100 / 75, 2)) + 0.23 * occupancy * (1.0 / (1 + abs(pitch - 60))) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, pitch) AS rank FROM s)
SELECT p_partkey, pitch::INTEGER AS pitch, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 2"""
)
def candidate_rank(spark, sf_dir):
    c = _read(spark, sf_dir, "part").select("p_partkey", (36 + F.col("p_retailprice") % 60).alias("centre"), (F.col("p_size") / 50.0).alias("occupancy"))
    scored = series.candidates(c, "centre").withColumn("score", 0.42 * F.col("proximity") + 0.23 * F.col("occupancy") * (1.0 / (1 + F.abs(F.col("pitch") - 60))))
    return series.top_candidates(scored, ["p_partkey"], "score").select("p_partkey", "pitch", "rank", F.round("score", 6).alias("score"))


@query(
    """WITH n AS (SELECT l_orderkey, max(36 + l_partkey % 60) AS peak, count(DISTINCT l_partkey % 60) AS kinds FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, 0.85 * least(1.0, greatest(0.0, (peak - 60) / 24.0::DOUBLE)) + 0.15 * least(1.0, greatest(0.0, (kinds - 1) / 11.0::DOUBLE)) AS score FROM n)
SELECT l_orderkey, round(score, 6) AS score, CASE WHEN score >= 0.65 THEN 'advanced' WHEN score >= 0.35 THEN 'intermediate' ELSE 'beginner' END AS band FROM s"""
)
def difficulty_band(spark, sf_dir):
    notes = _read(spark, sf_dir, "lineitem").select("l_orderkey", (36 + F.col("l_partkey") % 60).alias("pitch"), F.lit(0.0).alias("s"), F.col("l_quantity").alias("e"))
    return series.difficulty(notes, ["l_orderkey"], "pitch", "s", "e").withColumn("score", F.round("score", 6))


@query(
    """WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value > 60) AS core, count(*) FILTER (WHERE event_type = 'purchase') AS whole, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS wide FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN core >= 15 THEN 'core' WHEN whole >= 15 THEN 'whole' WHEN wide >= 15 THEN 'wide' WHEN greatest(core, whole, wide) = 0 THEN 'none'
  WHEN core = greatest(core, whole, wide) THEN 'core' WHEN whole = greatest(core, whole, wide) THEN 'whole' ELSE 'wide' END AS tier,
  CASE WHEN core >= 15 THEN core WHEN whole >= 15 THEN whole WHEN wide >= 15 THEN wide ELSE greatest(core, whole, wide) END::BIGINT AS frames FROM n"""
)
def tier_fallback(spark, sf_dir):
    bought = F.col("event_type") == "purchase"
    e = _read(spark, sf_dir, "events").withColumns({"core": bought & (F.col("value") > 60), "whole": bought, "wide": F.col("event_type").isin("purchase", "click")})
    return series.tier_choice(e, ["user_id"], ["core", "whole", "wide"], 15).withColumn("frames", F.col("frames").cast("long"))


@query(
    """WITH p AS (SELECT doc_id, (doc_id * 7 % 101) / 100.0::DOUBLE AS pt, (doc_id * 13 % 101) / 100.0::DOUBLE AS en, (doc_id * 3 % 101) / 100.0::DOUBLE AS es FROM labels)
SELECT doc_id, CASE WHEN en > pt THEN 'en' ELSE 'pt' END AS language, greatest(pt, en) AS probability,
  greatest(pt, en) >= 0.65 AND greatest(pt, en) - least(pt, en) >= 0.20 AND greatest(pt, en) = greatest(pt, en, es) AS strong FROM p WHERE pt <= 1 OR en <= 1"""
)
def acoustic_strength(spark, sf_dir):
    d = F.col("doc_id")
    probs = F.create_map(F.lit("pt"), d * 7 % 101 / 100, F.lit("en"), d * 13 % 101 / 100, F.lit("es"), d * 3 % 101 / 100)
    return _read(spark, sf_dir, "labels").select("doc_id", L.acoustic_evidence(probs).alias("a")).select("doc_id", "a.language", "a.probability", "a.strong")


@query(
    """WITH p AS (SELECT doc_id, doc_id % 4 AS tp, doc_id % 5 AS te, (doc_id * 7 % 101) / 100.0::DOUBLE AS pt, (doc_id * 13 % 101) / 100.0::DOUBLE AS en, (doc_id * 11 % 101) / 100.0::DOUBLE AS wp, (doc_id * 17 % 101) / 100.0::DOUBLE AS we FROM labels),
e AS (SELECT *, CASE WHEN greatest(tp, te) >= 2 AND abs(tp - te) >= 2 THEN CASE WHEN te > tp THEN 'en' ELSE 'pt' END END AS text, least(tp, te) >= 2 AS mixed,
  CASE WHEN en > pt THEN 'en' ELSE 'pt' END AS local, greatest(pt, en) >= 0.65 AND greatest(pt, en) - least(pt, en) >= 0.20 AS ls, CASE WHEN we > wp THEN 'en' ELSE 'pt' END AS wide, greatest(wp, we) >= 0.65 AND greatest(wp, we) - least(wp, we) >= 0.20 AS ws FROM p)
SELECT doc_id, coalesce(text, CASE WHEN ws AND NOT ls THEN wide ELSE local END) AS language,
  CASE WHEN text IS NOT NULL THEN 'recognised_text' WHEN ws AND NOT ls THEN 'wide_audio' ELSE 'local_audio' END AS source, coalesce(text <> local, false) AS text_differs,
  coalesce(text <> local, false) OR NOT (CASE WHEN ws AND NOT ls THEN ws ELSE ls END) OR mixed OR wide <> local AS review FROM e"""
)
def language_selection(spark, sf_dir):
    d = F.col("doc_id")
    share = lambda k: d * k % 101 / 100
    local, wide = (L.acoustic_evidence(F.create_map(F.lit("pt"), share(a), F.lit("en"), share(b))) for a, b in ((7, 13), (11, 17)))
    rows = _read(spark, sf_dir, "labels").select("doc_id", L.textual_evidence(d % 4, d % 5).alias("t"), local.alias("l"), wide.alias("w"))
    return rows.select("doc_id", L.select_language(F.col("t"), F.col("l"), F.col("w")).alias("x")).select("doc_id", "x.language", "x.source", "x.text_differs", "x.review")


@query(
    """WITH m AS (SELECT label, i, median(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label)
SELECT m.label, i::INTEGER AS i, round(m / norm, 6) AS x FROM m JOIN n USING (label)"""
)
def timbre_reference(spark, sf_dir):
    r = series.reference_vector(_read(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return r.select("label", F.posexplode("reference").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, label, coalesce(round(list_distance(e, p), 5), 0.0) AS flux FROM v"""
)
def adjacent_flux(spark, sf_dir):
    return series.flux(_read(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], "embedding").select("vec_id", "label", F.round("flux", 5).alias("flux"))


@query(
    f"""WITH {_LINES}, c AS (SELECT doc_id, line_no, greatest(1, length(line)) AS w FROM lines), s AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::DOUBLE AS c, sum(w) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM c)
SELECT doc_id, line_no::INTEGER AS line_no, round(10.0 + 20.0 * ((c - w) / t), 6) AS part_start, round(CASE WHEN c = t THEN 30.0 ELSE 10.0 + 20.0 * (c / t) END, 6) AS part_end FROM s"""
)
def proportional_split(spark, sf_dir):
    parts = _lines(spark, sf_dir)
    s = intervals.proportional_split(parts, ["doc_id"], ["line_no"], F.greatest(F.lit(1), F.char_length("line")), F.lit(10.0), F.lit(30.0))
    return s.select("doc_id", "line_no", F.round("part_start", 6).alias("part_start"), F.round("part_end", 6).alias("part_end"))


_NOTES = """n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS k, l_quantity / 200.0::DOUBLE AS l FROM lineitem),
t AS (SELECT *, sum(l) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM n)"""


def _notes(spark, sf_dir) -> DataFrame:
    order = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_shipdate l_discount l_tax".split()
    n = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("k"), (F.col("l_quantity") / 200.0).alias("l"), F.col("l_partkey").alias("part"))
    up = W.partitionBy("l_orderkey").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return n.withColumn("e", F.sum("l").over(up)).withColumn("s", F.col("e") - F.col("l"))


@query(
    f"""WITH {_NOTES}, d AS (SELECT *, greatest(0.1 - l, 0.0) AS d, greatest(l - 0.1, 0.0) AS x FROM t), g AS (
  SELECT *, sum(d) OVER o AS dd, sum(x) OVER o AS xx FROM d WINDOW o AS (PARTITION BY l_orderkey)), p AS (
  SELECT *, CASE WHEN dd > 0 AND xx > 0 THEN l + d / dd * least(dd, xx) - x / xx * least(dd, xx) ELSE l END AS nl FROM g), q AS (
  SELECT *, sum(nl) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS pe FROM p), f AS (
  SELECT *, max(abs(pe - e)) OVER (PARTITION BY l_orderkey) AS shift FROM q)
SELECT l_orderkey, k, round(e + CASE WHEN shift > 0 THEN least(1.0, 0.12 / shift) ELSE 1.0 END * (pe - e) + 1e-9, 5) AS new_end FROM f"""
)
def redistribute(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return intervals.redistribute(notes, ["l_orderkey"], ["k"], "s", "e").select("l_orderkey", "k", F.round(F.col("new_end") + 1e-9, 5).alias("new_end"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2")
def orphan_rows(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return audit.orphans(_read(spark, sf_dir, "lineitem"), o, ["l_orderkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, count(*)::BIGINT AS n, min(l_linenumber) AS lowest, max(l_linenumber) AS highest, count(DISTINCT l_linenumber)::BIGINT AS kinds FROM lineitem GROUP BY 1
HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)"""
)
def contiguous_ordinals(spark, sf_dir):
    return audit.broken_ordinals(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    """WITH e AS (SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders GROUP BY 1), a AS (SELECT c_custkey AS k, (c_custkey % 9)::BIGINT AS n FROM customer)
SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' ELSE 'differs' END AS rule
FROM e FULL JOIN a ON e.k = a.k WHERE a.k IS NULL OR e.k IS NULL OR e.n <> a.n"""
)
def coverage_audit(spark, sf_dir):
    e = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    a = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 9).alias("n"))
    return audit.coverage(e, a, ["k"], ["n"])


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return audit.not_unique(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'other_language' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM labels JOIN documents USING (doc_id)"""
)
def review_reasons(spark, sf_dir):
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    named = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "short": F.col("n_chars") < 200, "other_language": F.col("lang") != "en"}
    return rows.select("doc_id", F.array_join(series.reasons(named), ",").alias("reasons"))


@query(
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS action FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT DISTINCT e.user_id FROM events e LEFT JOIN l ON l.user_id = e.user_id WHERE l.action IS NULL OR l.action = 'click'"""
)
def pending_items(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    decided = e.where("event_type <> 'view'").select("user_id", "event_id", F.when(F.col("event_type") == "click", "later").otherwise(F.col("event_type")).alias("action"))
    return review.pending(e.select("user_id").distinct(), decided, ["user_id"], "event_id")


@query(
    f"""WITH {_FRAMES}, q AS (SELECT user_id, i, first_value(value) OVER w AS f, last_value(value) OVER w AS l, {", ".join(f"lag(value, {-k}) OVER o AS v{k + 4}" if k <= 0 else f"lead(value, {k}) OVER o AS v{k + 4}" for k in range(-4, 5))}
  FROM fr WINDOW o AS (PARTITION BY user_id ORDER BY i), w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id, i, list_sort([{", ".join(f"coalesce(v{k}, {'f' if k < 4 else 'l'})" for k in range(9))}])[5] AS smooth FROM q"""
)
def running_median(spark, sf_dir):
    return series.smooth(_frames(spark, sf_dir), ["user_id"], ["i"], "value").select("user_id", "i", "smooth")


@query(
    f"""WITH {_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM fr)
SELECT user_id, (i * 8 // n) AS bin, min(value) AS low, max(value) AS high FROM n GROUP BY user_id, bin"""
)
def value_envelope(spark, sf_dir):
    return series.envelope(_frames(spark, sf_dir), ["user_id"], "i", "value", 8)


@query(
    f"""WITH {_EV}, d AS (SELECT user_id, start_ms - lag(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms) AS g FROM ev)
SELECT user_id, coalesce(max(g), 0)::DOUBLE AS longest_gap FROM d GROUP BY user_id"""
)
def longest_pause(spark, sf_dir):
    return series.longest_inner_gap(_events(spark, sf_dir), ["user_id"], "start_ms").withColumn("longest_gap", F.col("longest_gap").cast("double"))


def _words(spark, sf_dir, table: str, key: str, side: str | None = None) -> DataFrame:
    t = _read(spark, sf_dir, table).select(F.col(key).cast("string").alias("song_id"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "text"))
    t = t.select("song_id", F.col("pos").cast("long").alias("pos"), "text", T.comparison_key(F.col("text")).alias("key"))
    return t.withColumn("side", F.lit(side)) if side else t


@query()
def global_alignment(spark, sf_dir):
    """Benchmark items against themselves without every seventh word."""
    target = _words(spark, sf_dir, "benchmark", "item_id", "target")
    source = target.where("pos % 7 <> 3").withColumn("side", F.lit("source"))
    return alignment.global_alignment(source.unionByName(target))


@query()
def structure_plan(spark, sf_dir):
    """Lines of benchmark items as captions of the whole item."""
    b = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("song_id"), F.posexplode(F.split("text", "[.\n]")).alias("idx", "line"))
    caps = b.select("song_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") * 5.0).alias("start"), (F.col("idx") * 5.0 + 4).alias("end"), F.transform(T.tokens(F.col("line")), T.comparison_key).alias("keys"))
    return structure.structure_plan(caps, _words(spark, sf_dir, "benchmark", "item_id").select("song_id", "pos", "key"))


@query()
def time_choice_beam(spark, sf_dir):
    """Events of each user as timings of words in turn."""
    e = _events(spark, sf_dir)
    word = F.floor(F.row_number().over(W.partitionBy("user_id").orderBy("start_ms", "event_id")) / 3)
    options = e.select(F.col("user_id").cast("string").alias("song_id"), word.alias("word"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000 + 40000).alias("end"), (F.floor(F.col("value") * 10) / 1024).alias("score"))
    return sequence.time_choice(options.withColumns({"window_start": F.lit(0.0), "window_end": F.lit(1e7)}))


@query(
    """WITH RECURSIVE n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS k, l_quantity::BIGINT % 24 + 48 AS centre, l_partkey % 5 AS lift FROM lineitem),
c AS (SELECT l_orderkey, k, p::INTEGER AS pitch, 0.42 * exp(-0.5 * pow((p - centre) * 100 / 75.0::DOUBLE, 2)) + 0.03 * lift * (p % 3) AS base FROM (SELECT *, unnest(range(centre - 2, centre + 3)) AS p FROM n)),
r AS (SELECT l_orderkey, k, pitch, score, runner_up FROM (
    SELECT l_orderkey, k, pitch, base AS score, lead(base) OVER w AS runner_up, row_number() OVER w AS rn FROM c WHERE k = 1 WINDOW w AS (PARTITION BY l_orderkey ORDER BY base DESC, pitch)) WHERE rn = 1
  UNION ALL
  SELECT l_orderkey, k, pitch, score, runner_up FROM (
    SELECT l_orderkey, k, pitch, score, lead(score) OVER w AS runner_up, row_number() OVER w AS rn
    FROM (SELECT c.l_orderkey, c.k, c.pitch, c.base + 0.05 * exp(-abs(c.pitch - r.pitch) / 4.0::DOUBLE) AS score FROM r JOIN c ON c.l_orderkey = r.l_orderkey AND c.k = r.k + 1)
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, pitch)) WHERE rn = 1)
SELECT l_orderkey::VARCHAR AS song_id, k AS unit, pitch, round(score, 6) AS score, round(runner_up, 6) AS runner_up FROM r"""
)
def note_continuity(spark, sf_dir):
    """Orders as songs, line items as units with five candidates, built without a shuffle."""
    n = _notes(spark, sf_dir).withColumns({"centre": (48 + F.round(F.col("l") * 200) % 24).cast("int"), "lift": F.col("part") % 5})
    score = lambda p: 0.42 * F.exp(-0.5 * F.pow((p - F.col("centre")) * 100 / 75.0, F.lit(2))) + 0.03 * F.col("lift") * (p % 3)
    cands = F.transform(F.sequence(F.col("centre") - 2, F.col("centre") + 2), lambda p: F.struct(p.alias("pitch"), score(p).alias("score")))
    got = sequence.note_continuity(n.select(F.col("l_orderkey").cast("string").alias("song_id"), F.col("k").alias("unit"), F.col("s").alias("start"), F.col("e").alias("end"), cands.alias("cands")))
    return got.select("song_id", "unit", "pitch", F.round("score", 6).alias("score"), F.round("runner_up", 6).alias("runner_up"))


@query(
    """WITH RECURSIVE w AS (
  SELECT conv_id, turn, i::BIGINT AS no, word, i * 400 + (i // 9) * 1000 AS a, i * 400 + (i // 9) * 1000 + 300 AS z
  FROM (SELECT conv_id, turn, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’\\-][\\p{L}\\p{N}]+)*') AS ws FROM conversations))),
g AS (SELECT conv_id, turn, no, word, a, z, a AS first, length(word) AS chars, 0::BIGINT AS grp FROM w WHERE no = 0
  UNION ALL
  SELECT w.conv_id, w.turn, w.no, w.word, w.a, w.z, CASE WHEN fresh THEN w.a ELSE first END, CASE WHEN fresh THEN length(w.word) ELSE chars + 1 + length(w.word) END, CASE WHEN fresh THEN grp + 1 ELSE grp END
  FROM (SELECT w.*, g.first, g.chars, g.grp, w.a - g.z >= 650 OR w.z - g.first > 6000 OR g.chars + 1 + length(w.word) > 72 AS fresh FROM g JOIN w ON w.conv_id = g.conv_id AND w.turn = g.turn AND w.no = g.no + 1) w)
SELECT conv_id::VARCHAR AS song_id, turn AS seg, grp, min(a) / 1000.0::DOUBLE AS start, max(z) / 1000.0::DOUBLE AS "end", string_agg(word, ' ' ORDER BY no) AS text FROM g GROUP BY conv_id, turn, grp"""
)
def capped_groups(spark, sf_dir):
    """Turns of conversations as words with a new caption at pauses, long spans and long texts."""
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("song_id"), F.col("turn").alias("seg"), T.tokens(F.col("text")).alias("ws"))
    # The text of a turn is joined once, not for each of its words.
    w = turns.withColumn("whole", F.array_join("ws", " ")).select("song_id", "seg", "whole", F.posexplode("ws").alias("no", "word"))
    at = (F.col("no") * 400 + F.floor(F.col("no") / 9) * 1000) / 1000
    words = w.select("song_id", "seg", "no", "word", at.alias("start"), ((at * 1000 + 300) / 1000).alias("end"), F.lit(0.9).alias("score"), F.lit(0.0).alias("seg_start"), F.lit(1e6).alias("seg_end"), F.col("whole").alias("seg_text"))
    return captioning.capped_groups(words, slack=0.0).select("song_id", "seg", "grp", "start", "end", "text")


@query()
def ngram_candidates(spark, sf_dir):
    """For each turn of a conversation, the nearest runs of its turns."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("turn").cast("double").alias("start"), "text")
    items = c.select("conv_id", F.col("ord").alias("item"), F.col("text"))
    return review.caption_candidates(items, c, ["conv_id"]).select("conv_id", "item", "ord", "n", "rank", F.round("score", 6).alias("score"))


def review_log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Users as songs: their first events as blocks, the others as a log that corrects, removes and undoes."""
    e = _events(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("start_ms", "event_id")).cast("long"))
    song = F.col("user_id").cast("string").alias("song_id")
    blocks = e.where("n <= 20").select(song, F.col("n").alias("block"), (F.col("n") * 1000).alias("start_ms"), (F.col("n") * 1000 + 900).alias("end_ms"), F.col("event_type").alias("text"))
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "click", "replace").otherwise("correct")
    log = e.where("n > 20").select(song, F.col("n").alias("seq"), action.alias("action"), F.col("n").alias("item"), (F.col("event_id") % 20 + 1).alias("block"), ((F.col("event_id") % 20 + 1) * 1000).alias("start_ms"), ((F.col("event_id") % 20 + 1) * 1000 + 800).alias("end_ms"), F.lit("new").alias("text"))
    return blocks, log


@query()
def review_fold(spark, sf_dir):
    """Users as songs, events as a log that corrects, removes and undoes."""
    return review.fold(*review_log(spark, sf_dir))


from tessitura.plans import file_queries, unit_queries, version_queries, word_queries  # noqa: E402, F401  their queries are registered here
