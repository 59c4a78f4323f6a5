"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over one document, so the operator is a
single narrow projection: no shuffle, no Python, and a hot source or a group
of copies costs the same as any other rows.

Words are ``[^\\x20\\x09-\\x0D]+``. Null text counts as no words; an empty table
gives an empty table; repeated rows are judged independently; other columns
pass through untouched (metrics live in one struct, so names cannot clash).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German, Spanish, Portuguese, Italian, Dutch, Swedish and Polish.
STOP_WORDS = (
    "the be to of and that have with is in it for on as by was this are from or an at not "
    "le la les de des du et un une en que qui dans pour est sur pas au par avec "
    "der die das und ist von zu den mit ein eine auf im für nicht sich dem als auch es "
    "el los las y en un una que del se por con para no su al lo "
    "os as um uma do da dos em não com mais ao "
    "il gli di che per con una sono della non "
    "het een van op dat niet zijn voor "
    "och att det som på är av för "
    "w i z na się do nie jest"
).split()

#: As they stand in running text and at the start of a sentence.
_STOP_FORMS = sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})
_SYMBOLS = "#*$%&|<>"
#: Latin letters, marks and general punctuation; texts in other scripts need no word of the list.
_LATIN = r"[\x00-\x{24F}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}]+"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low * per <= metric <= high * per`` (integers only); ``per`` and ``metric`` name metrics."""

    name: str
    metric: str
    per: str | None = None
    low: float | None = None
    high: float | None = None

    def passes(self, m: Column) -> Column:
        value = m[self.metric].cast("double")
        unit = m[self.per].cast("double") if self.per else F.lit(1.0)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= unit * F.lit(float(self.low)))
        if self.high is not None:
            ok = ok & (value <= unit * F.lit(float(self.high)))
        return ok


#: The contract's base rules.
BASE_RULES = (
    Rule("length", "n_words", low=10),
    Rule("repetition", "n_repeat_words_x100", per="n_words", high=20),
)

#: The method's own verdict on what the base rules let through.
RULES = (
    Rule("word_length", "word_chars", per="n_words", low=2, high=15),
    Rule("symbols", "n_symbols", per="n_words", high=0.1),
    Rule("stop_words", "n_language_signs", low=1),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", high=0.4),
    Rule("bullet_lines", "n_bullet_lines", per="n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", per="n_lines", high=0.3),
)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _twice(keyed: Column, body) -> Column:
    """``body`` of the sorted ``i`` of those structs (k, i) whose k occurs at least twice."""
    return _bind(
        F.sort_array(keyed),
        lambda s: _bind(
            F.sort_array(
                F.transform(
                    F.filter(s, lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"])),
                    lambda x: x["i"],
                )
            ),
            body,
        ),
    )


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that the text holds at least twice.

    Window hashes rule out most texts; where hashes repeat, the windows
    themselves are compared.
    """
    hashes = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)])),
        1,
        F.greatest(F.size(words) - (width - 1), F.lit(0)),
    )

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - x, F.lit(width)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    def verified(starts: Column) -> Column:
        texts = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, width)).alias("k"), i.alias("i")))
        return _twice(texts, covered)

    return _bind(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _twice(F.transform(h, lambda x, i: F.struct(x.alias("k"), i.alias("i"))), verified)
        ),
    )


def metrics(text: Column) -> Column:
    """A struct of every metric that the rules name."""
    clean = F.coalesce(text, F.lit(""))
    stop = F.array(*[F.lit(w) for w in _STOP_FORMS])

    def of(words: Column) -> Column:
        lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        repeat = repeated_window_words(words).cast("long")
        return _bind(
            F.struct(lines.alias("lines"), repeat.alias("repeat")),
            lambda s: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.char_length(F.regexp_replace(clean, f"[^{_SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                F.size(s["lines"]).cast("long").alias("n_lines"),
                (F.size(s["lines"]) - F.size(F.array_distinct(s["lines"]))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(s["lines"], lambda x: x.rlike(r"^\s*[-*•‣▪]"))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(s["lines"], lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
                F.size(F.array_intersect(words, stop)).cast("long").alias("n_stop_words"),
                F.char_length(F.regexp_replace(clean, _LATIN, "")).cast("long").alias("n_other_chars"),
                s["repeat"].alias("n_repeat_words"),
                (s["repeat"] * 100).alias("n_repeat_words_x100"),
            ),
        )

    def signed(m: Column) -> Column:
        other = (m["n_other_chars"] * 4 > m["word_chars"]).cast("long")
        return m.withField("n_language_signs", m["n_stop_words"] + other)

    return _bind(_bind(words_of(text), of), signed)


def assess(docs: DataFrame, text: str = "text", into: str = "quality", rules=RULES) -> DataFrame:
    """``docs`` with a struct ``into``: every metric, ``base_failed``, ``failed`` (names of broken rules) and ``kept``."""
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}; name another")
    m = F.col(into)
    base = ~BASE_RULES[0].passes(m) | ~BASE_RULES[1].passes(m)
    failed = F.filter(F.array(*[F.when(~r.passes(m), F.lit(r.name)) for r in (*BASE_RULES, *rules)]), lambda x: x.isNotNull())
    return docs.withColumn(into, metrics(F.col(f"`{text}`"))).withColumn(
        into, m.withField("base_failed", base).withField("failed", failed).withField("kept", F.size(failed) == 0)
    )


def passes(text: Column, rules=RULES) -> Column:
    """Whether a text passes every rule; the metrics are evaluated once, also where the optimiser moves the condition."""

    def judged(m: Column) -> Column:
        ok = F.lit(True)
        for r in (*BASE_RULES, *rules):
            ok = ok & r.passes(m)
        return ok

    return _bind(metrics(text), judged)


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with the columns of ``docs``."""
    return docs.where(passes(F.col(f"`{text}`"), rules))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    return assess(docs).select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        *[q[c].alias(c) for c in ("n_lines", "n_stop_words", "n_other_chars", "n_bullet_lines", "n_ellipsis_lines")],
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP_FORMS)
OP9_SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM base
), win AS (
  SELECT rid, i, array_to_string(words[i:i+4], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[-*•‣▪]')))::BIGINT AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$')))::BIGINT AS n_ellipsis_lines,
         length(regexp_replace(text, '[\\x00-\\x{{24F}}\\x{{1E00}}-\\x{{1EFF}}\\x{{2000}}-\\x{{206F}}]+', '', 'g'))::BIGINT AS n_other_chars,
         len(list_distinct(list_filter(words, lambda x: x IN ({_STOP_SQL}))))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid
), v AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
        AND n_symbols <= n_words * 0.1::DOUBLE AND (n_stop_words >= 1 OR n_other_chars * 4 > word_chars)
        AND n_dup_lines <= n_lines * 0.4::DOUBLE AND n_bullet_lines <= n_lines * 0.9::DOUBLE
        AND n_ellipsis_lines <= n_lines * 0.3::DOUBLE) AS kept,
       n_lines, n_stop_words, n_other_chars, n_bullet_lines, n_ellipsis_lines
FROM v
"""
