"""What each filter of a chain takes, in every order of the filters, from one pass over the documents.

A filter order is a path through the lattice of filter subsets. What a step of
it removes depends only on its edge: the set of filters applied before, and the
filter that is next. Five filters have 2**4 * 5 = 80 edges, and 120 orders have
600 steps. So a document is judged once, by all filters; equal judgements are
counted per part; the counts become the 80 edges; and every order reads its
five edges. No document is looked at again for an order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, stored
from .quality import _bind, words_of

#: Names of the filters, in the order of their bits; the last is the one on copies.
NAMES = "ABCDE"
#: A: fewer words than this.
MIN_WORDS = 50
#: B: fewer distinct words than this many of a hundred.
MIN_DISTINCT_PERCENT = 65
#: C: more capitals A to Z than this many of a hundred characters.
MAX_CAPITALS_PERCENT = 5
#: D: any of these characters.
SYMBOLS = "#$%&*|"
COPY_BIT = 1 << (len(NAMES) - 1)


def text_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits of an int; a null text is an empty one."""
    clean = F.coalesce(text, F.lit(""))

    def judged(words: Column) -> Column:
        n = F.size(words)
        conditions = (
            n < MIN_WORDS,
            F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PERCENT,
            F.regexp_count(clean, F.lit("[A-Z]")) * 100 > F.char_length(clean) * MAX_CAPITALS_PERCENT,
            clean.rlike(f"[{SYMBOLS}]"),
        )
        bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions)]
        return bits[0] + bits[1] + bits[2] + bits[3]

    return _bind(words_of(text), judged)


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts of documents by ``part`` and ``mask`` (bits of the filters that they fail): n, good, toxic.

    Texts are compared by their SHA-256. Rows are small from here on (an id, a
    digest, a part): they meet their labels by id, the first id of each digest
    by partial aggregation, and that first row again by digest and id together,
    so a text that very many documents share is no hot key. A null id has no
    labels, is no copy and makes no copies; rows that share the smallest id of
    a text are all first. Of several labels of a document any 1 counts.
    The small rows are written to the shared folder, so that texts are read and judged once."""
    own = {c: f"`{c}`" for c in (part, text, doc_id)}
    judged_texts = docs.select(
        F.col(own[doc_id]).alias("doc_id"),
        F.coalesce(F.col(own[part]).cast("string"), F.lit("")).alias("part"),
        text_failures(F.col(own[text])).alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(own[text]), F.lit("")), 256)).alias("digest"),
    )
    rows = stored(judged_texts, "judged")
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")
    )
    zero = F.lit(0).cast("long")
    counted = rows.join(flags, "doc_id", "left").groupBy("doc_id", "digest", "part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", zero)).alias("good"), F.sum(F.coalesce("toxic", zero)).alias("toxic")
    )
    first = counted.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    judged = counted.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, F.lit(COPY_BIT)).otherwise(F.lit(0)))
    return judged.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def edges(counts: DataFrame, n_filters: int = len(NAMES)) -> DataFrame:
    """``counts`` (part, mask, n, good, toxic) as edges of the lattice: one row per part, ``applied`` (bits) and ``next`` (a bit).

    ``removed`` pass all that is applied and fail the next; ``redundant`` fail
    both; ``unique_fails`` fail the next filter alone; ``kept`` pass both.
    ``shapley`` sums ``removed`` over all orders: an edge lies on as many as its
    two sides have arrangements."""
    lattice = [(s, 1 << f) for f in range(n_filters) for s in range(1 << n_filters) if not s >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in lattice]))
    mask, applied, following = F.col("mask"), F.col("edge.applied"), F.col("edge.next")
    before = mask.bitwiseAND(applied) == 0
    fails = mask.bitwiseAND(following) != 0

    def total(condition: Column, what: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(F.lit(0))).cast("long")

    found = counts.withColumn("edge", each).groupBy("part", applied.alias("applied"), following.alias("next")).agg(
        total(before & ~fails).alias("kept"),
        total(before & fails).alias("removed"),
        total(~before & fails).alias("redundant"),
        total(mask == following).alias("unique_fails"),
        total(before & fails, "good").alias("good_lost"),
        total(before & fails, "toxic").alias("toxic_lost"),
    )
    arrangements = F.array(*[F.lit(factorial(k) * factorial(n_filters - 1 - k)).cast("long") for k in range(n_filters)])
    weighted = F.col("removed") * F.get(arrangements, F.bit_count("applied"))
    return found.withColumn("shapley", F.sum(weighted).over(W.partitionBy("part", "next")))  # 16 edges a filter


def steps(spark, names: str = NAMES) -> DataFrame:
    """Every step of every order of the filters: filter_order, step, applied, next. Its size depends on the number of filters alone."""
    bit = {x: 1 << k for k, x in enumerate(names)}
    rows = [("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[x]) for order in permutations(names) for k, x in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, zeros included.

    ``docs`` has doc_id, text and the column ``part`` (null: the empty string);
    ``labels`` has doc_id, quality and toxic; other columns are ignored.
    Documents without labels are neither good nor toxic; an empty table has no
    parts and so no rows; repeated rows count as often as they stand there."""
    if free_name(docs.columns, part) == part:
        raise ValueError(f"the table has no column {part!r}")
    paths = edges(failures(docs, labels, part)).join(F.broadcast(steps(docs.sparkSession)), ["applied", "next"])  # 600 rows, whatever the input
    return paths.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
), flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), j AS (
  SELECT d.part, coalesce(flags.good, 0) AS good, coalesce(flags.toxic, 0) AS toxic,
         len(words) < {MIN_WORDS} AS fa,
         100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) AS fb,
         100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(d.t) AS fc,
         regexp_matches(d.t, '[{SYMBOLS}]') AS fd,
         coalesce(d.doc_id > firsts.first_id, false) AS fe
  FROM d JOIN firsts ON firsts.t = d.t LEFT JOIN flags ON flags.doc_id = d.doc_id
), m AS (
  SELECT part, map {{'A': fa, 'B': fb, 'C': fc, 'D': fd, 'E': fe}} AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM j GROUP BY part, fa, fb, fc, fd, fe
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS x,
         string_split(substr(filter_order, 1, step::INTEGER - 1), '') AS earlier
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
), r AS (
  SELECT m.part, filter_order, step, x, n, good, toxic, f[x] AS fails,
         len(list_filter(earlier, lambda y: y <> '' AND f[y])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: f[y])) = 1 AS alone
  FROM m CROSS JOIN steps
), a AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM a
"""
