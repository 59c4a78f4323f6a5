from pyspark.sql import functions as F

from tessitura.functions import language as L
from tessitura.functions import text as T
from tessitura.sources import captions, writers


def _one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).head()[0]


def test_sentence_case(spark):
    cases = {'... "É ISSO, MEU Amor!"': '... "É isso, meu amor!"', "123 eu VOU": "123 Eu vou", "sÃO PAULO": "São paulo", "♪...": "♪...", "": ""}
    for text, want in cases.items():
        got = _one(spark, T.sentence_case(F.col("t")), t=text)
        assert got == want
        assert _one(spark, T.sentence_case(F.col("t")), t=got) == want


def test_rounding_modes(spark):
    assert _one(spark, T.half_even_ms(F.lit(0.0025))) == 2
    assert _one(spark, T.half_up_ms(F.lit(0.0025))) == 3


def test_times(spark):
    assert _one(spark, T.milliseconds(F.lit("100:02:03,004"))) == ((100 * 60 + 2) * 60 + 3) * 1000 + 4
    assert _one(spark, T.milliseconds(F.lit("00:61:00,000"))) is None
    assert _one(spark, T.human_time(F.lit("75"))) == 75.0
    assert _one(spark, T.human_time(F.lit("1:02,500"))) == 62.5
    assert _one(spark, T.human_time(F.lit("1:75"))) is None
    assert _one(spark, T.timestamp_text(F.lit(3723004))) == "01:02:03,004"
    assert _one(spark, T.short_time_text(F.lit(62500))) == "01:02,500"


def test_keys_and_numbers(spark):
    assert _one(spark, T.comparison_key(F.lit("Straße-É"))) == "strassee"
    assert _one(spark, T.exact_key(F.col("t")), t="Ça-Vaß") == "cavass"
    assert _one(spark, T.score_of(F.lit(float("nan")))) is None
    assert _one(spark, T.score_of(F.lit(0.5))) == 0.5
    assert _one(spark, T.midi_of(F.lit(440.0))) == 69.0
    assert _one(spark, T.midi_name(F.lit(60))) == "C4"
    assert _one(spark, T.clean_markup(F.lit("♪ <i>A &amp;  b</i>{\\an8} "))) == "A & b"


def test_indel():
    assert T.indel("", "") == 1 and T.indel("a", "") == 0
    assert abs(T.indel("abcd", "acbd") - 0.75) < 1e-12


def test_votes_and_inheritance(spark):
    lines = spark.createDataFrame([(1, 0, "la la"), (1, 1, "the sun"), (1, 2, "oh"), (1, 3, "não vou"), (1, 4, "ah")], "id int, no int, line string")
    got = [r["language"] for r in L.line_languages(lines, ["id"], ["no"]).orderBy("no").collect()]
    assert got == ["pt", "en", "en", "pt", "pt"]


def _choose(spark, rows, probs, voice):
    df = spark.createDataFrame([(1, lang, "x", float(lp), float(ns), float(cr)) for lang, lp, ns, cr in rows], "k int, language string, text string, avg_logprob double, no_speech double, compression double")
    heard = L.acoustic_evidence(F.create_map(*[F.lit(x) for p in probs.items() for x in p]))
    r = L.choose_hypothesis(df.withColumn("heard", heard).withColumn("has_voice", F.lit(voice)), ["k"]).head()
    return r["winner"], r["reason"], r["review"]


def test_hypotheses(spark):
    assert _choose(spark, [("pt", -0.2, 0.1, 1), ("en", -0.7, 0.1, 1)], {"en": 0.5, "pt": 0.3}, True)[::2] == ("pt", True)
    assert _choose(spark, [("pt", -0.2, 0.1, 1), ("en", -0.25, 0.1, 1)], {"en": 0.8, "pt": 0.1}, True)[:2] == ("en", "strong_acoustic_language")
    assert _choose(spark, [("pt", -0.7, 0.1, 1), ("en", -0.2, 0.1, 1)], {"pt": 0.95, "en": 0.02}, True)[:2] == ("pt", "strong_acoustic_language")
    assert _choose(spark, [("pt", -0.05, 0.9, 8), ("en", -0.7, 0.9, 1)], {"en": 0.3, "pt": 0.01}, False)[:2] == (None, "confirmed_silence")


SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500 align:start\r\n<i>Bom</i> dia\r\n\r\n2\r\n00:00:02.000 --> 00:00:03.000\r\namor\r\namor\r\n"


def test_lenient_and_strict(spark):
    files = spark.createDataFrame([("a", SRT)], "path string, content string")
    rows = captions.must_hold(captions.captions(files)).orderBy("idx").collect()
    assert [(r["idx"], r["start_ms"], r["end_ms"], r["text"]) for r in rows] == [(1, 1000, 2500, "Bom dia"), (2, 2000, 3000, "amor amor")]
    assert [r["problem"] for r in captions.captions(files, "strict").orderBy("idx").collect()] == [None, "overlap"]
    bad = spark.createDataFrame([("a", "7\n00:00:02,000 --> 00:00:01,000\nx\n\n1\nno times\ny\n\n9\n00:00:03,000 --> 00:00:04,000\nx\n\n9\n00:00:05,000 --> 00:00:06,000\nx")], "path string, content string")
    assert [r["problem"] for r in captions.captions(bad).orderBy("ord").collect()] == ["end_not_after_start", "no_valid_times", "repeated_index", "repeated_index"]


def test_lyrics(spark):
    files = spark.createDataFrame([("a", "[Refrão]\nla la 2x\nok")], "path string, content string")
    assert [r["problem"] for r in captions.lyrics(files).orderBy("no").collect()] == ["label", "repetition", None]


def test_writers(spark):
    notes = spark.createDataFrame([(1, 0.5, True, ["a", "b"])], "n int, t double, ok boolean, why array<string>")
    r = writers.separated(notes, {"t": 2}).head()
    assert (r["n"], r["t"], r["ok"], r["why"]) == ("1", "0.50", "SIM", "a | b")
    ticks = writers.note_ticks(spark.createDataFrame([(0.0, 0.5), (1.0, 1.00001)], "start double, end double")).orderBy("start").collect()
    assert (ticks[0]["tick_on"], ticks[0]["tick_off"], ticks[0]["problem"]) == (0, 1920, None) and ticks[1]["problem"] == "no_length"


def test_comparison_keys(spark):
    """Keys of all tokens at once are the keys of each, also where the case of a letter hangs on its neighbours."""
    words = ["Straße-É", "ΟΔΟΣ", "Σ", "ΑΣ", "İI", "d'Água", "A’Σ", "ﬁN", "Ǆ", "٣", "ẞ", "x"]
    df = spark.createDataFrame([(words,), (["a"],), ([],), (None,)], "ws array<string>")
    got = df.select(T.comparison_keys(F.col("ws")).alias("all"), F.transform("ws", T.comparison_key).alias("each")).collect()
    assert [r["all"] for r in got] == [r["each"] for r in got] and len(got[0]["all"]) == len(words)


def test_comparison_key_of_documents(spark, tmp_path):
    """only counts of keys are shuffled; documents that stand in several rows count once, those without a name never."""
    from collections import Counter

    from tessitura.plans.catalog import QUERIES

    rows = [(1, "É e E\ne"), (2, "e-a a"), (None, "a ß"), (None, "b"), (4, None), (5, "... !")]
    for name, more in (("once", []), ("again", [(2, "a c"), (1, "e")])):
        own = rows + more
        spark.createDataFrame(own, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        words = [(d, k) for d, t in own for k in {"É e E\ne": ["e"] * 4, "e-a a": ["ea", "a"], "a ß": ["a", "ss"], "b": ["b"], "a c": ["a", "c"], "e": ["e"]}.get(t, [])]
        docs = Counter(k for _, k in {x for x in words if x[0] is not None})
        df = QUERIES["comparison_key"](spark, f"{tmp_path}/{name}")
        assert {(r["key"], r["n"], r["docs"]) for r in df.collect()} == {(k, n, docs[k]) for k, n in Counter(k for _, k in words).items()}
        if not more:
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert "Join" not in plan and plan.count("Exchange") == 1
