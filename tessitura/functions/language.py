"""Language evidence of lines: votes of function words, inherited decisions, acoustic and textual choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Function words that vote for Portuguese.
PT_WORDS = (
    "o a os as um uma uns umas de da do das dos em no na nos nas "
    "eu tu você vocês ele ela nós vós eles elas meu minha meus minhas seu sua seus suas "
    "nosso nossa nossos nossas vosso vossa vossos vossas isto isso aquilo "
    "me te se si consigo lhe lhes vos aqui ali lá cá ainda já só "
    "que não sim se mas porque para com sem por ao aos é são foi ser "
    "estou estás está estamos estão estava estavam tenho tens tem temos têm tinha tinham "
    "sou és somos sois fui fomos eram vou vai vamos vão muito mais também"
).split()
#: Function words that vote for English.
EN_WORDS = (
    "the a an of to in on at from for with without and or but if as no so "
    "i you he she it we they my your his her our their me him us them "
    "is are was were be been being am do does did not have has had "
    "will would shall should can could may might must this that these those"
).split()
ONLY_PT = sorted(set(PT_WORDS) - set(EN_WORDS))
ONLY_EN = sorted(set(EN_WORDS) - set(PT_WORDS))
LANGUAGES = ("pt", "en")


def _one_of(words: list[str]) -> str:
    """A regular expression that matches the words: their common beginnings are written once, so that few branches are tried."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        rest = [c + spelled(below) for c, below in sorted(node.items()) if c]
        if not rest:
            return ""
        return f"(?:{'|'.join(rest)})" + ("?" if "" in node else "")

    return spelled(tree)


_BEGIN, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_EN_VOTE = f"{_BEGIN}{_one_of(ONLY_EN)}{_END}"
_PT_VOTE = f"{_BEGIN}{_one_of([w for w in ONLY_PT if not set(w) & set('ãõç')])}{_END}"
_PT_SIGN = rf"{_BEGIN}[\p{{L}}\p{{N}}]*[ãõç]"


def votes(line: Column) -> Column:
    """A struct of pt and en: words that only one language has; any word with ã, õ or ç votes for pt. Regular expressions count them."""
    low = F.lower(line)
    signs = F.when(low.rlike("[ãõç]"), F.regexp_count(low, F.lit(_PT_SIGN))).otherwise(F.lit(0))
    return F.struct((F.regexp_count(low, F.lit(_PT_VOTE)) + signs).cast("long").alias("pt"), F.regexp_count(low, F.lit(_EN_VOTE)).cast("long").alias("en"))


def line_languages(lines: DataFrame, key: list[str], order: list[str], line: str = "line") -> DataFrame:
    """``lines`` with votes, language and inherited: a tie takes the last decided language of its text, else that of the whole text (tie: pt)."""
    whole, so_far = W.partitionBy(*key), W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    voted = lines.withColumn("votes", votes(F.col(line))).withColumn("pt_votes", F.col("votes.pt")).withColumn("en_votes", F.col("votes.en")).drop("votes")
    own = F.when(F.col("en_votes") > F.col("pt_votes"), F.lit("en")).when(F.col("pt_votes") > F.col("en_votes"), F.lit("pt"))
    overall = F.when(F.sum("en_votes").over(whole) > F.sum("pt_votes").over(whole), F.lit("en")).otherwise(F.lit("pt"))
    return (
        voted.withColumn("own", own)
        .withColumn("language", F.coalesce(F.last("own", ignorenulls=True).over(so_far), overall))
        .withColumn("inherited", F.col("own").isNull())
        .drop("own")
    )


def acoustic_evidence(probabilities: Column) -> Column:
    """The best of pt and en in a map of probabilities (others than 0 to 1 are dropped; tie: pt), and whether it is strong."""
    valid = F.map_filter(probabilities, lambda k, p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1))
    pt, en = (F.coalesce(F.element_at(valid, x), F.lit(0.0)) for x in LANGUAGES)
    best = F.when(en > pt, F.lit("en")).otherwise(F.lit("pt"))
    top = F.array_max(F.map_values(valid))
    leads = F.when(en > pt, en).otherwise(pt)
    known = F.map_contains_key(valid, "pt") | F.map_contains_key(valid, "en")
    strong = (leads >= 0.65) & (leads - F.least(pt, en) >= 0.20) & (leads == top)
    return F.when(known, F.struct(best.alias("language"), leads.alias("probability"), strong.alias("strong")))


def textual_evidence(pt: Column, en: Column) -> Column:
    """The language with two votes and a lead of two, if any; mixed if both have two."""
    best = F.when(en > pt, F.lit("en")).otherwise(F.lit("pt"))
    sure = (F.greatest(pt, en) >= 2) & (F.abs(pt - en) >= 2)
    return F.struct(F.when(sure, best).alias("language"), (F.least(pt, en) >= 2).alias("mixed"))


def select_language(text: Column, local: Column, wide: Column) -> Column:
    """Text beats audio; wide acoustic evidence is used only if it is strong and the local one is not.

    text, local, wide: structs of textual_evidence and acoustic_evidence (wide may be null)."""
    use_wide = F.coalesce(wide["strong"], F.lit(False)) & ~local["strong"]
    heard = F.when(use_wide, wide["language"]).otherwise(local["language"])
    strong = F.when(use_wide, wide["strong"]).otherwise(local["strong"])
    differs = text["language"].isNotNull() & (text["language"] != local["language"])
    return F.struct(
        F.coalesce(text["language"], heard).alias("language"),
        F.when(text["language"].isNotNull(), F.lit("recognised_text")).when(use_wide, F.lit("wide_audio")).otherwise(F.lit("local_audio")).alias("source"),
        differs.alias("text_differs"),
        (differs | ~strong | text["mixed"] | F.coalesce(wide["language"] != local["language"], F.lit(False))).alias("review"),
    )


def choose_hypothesis(hypotheses: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the recognition hypothesis that wins, and why.

    hypotheses: key, language, text, avg_logprob, no_speech, compression, heard (acoustic_evidence), has_voice."""
    valid = (F.length(F.trim("text")) > 0) & F.col("avg_logprob").isNotNull() & ~F.isnan("avg_logprob") & (F.abs("avg_logprob") < float("inf"))
    score = F.col("avg_logprob") - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("compression") - 2.4) * 0.25))
    packed = F.struct((-score).alias("cost"), F.when(F.col("language") == "pt", 0).otherwise(1).alias("rank"), score.alias("score"), "language", "avg_logprob", "no_speech", "compression")
    groups = hypotheses.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(valid, packed))).alias("h"), F.first("heard").alias("heard"), F.bool_or("has_voice").alias("has_voice")
    )
    first, second = F.get("h", F.lit(0)), F.get("h", F.lit(1))
    fits = F.get(F.filter("h", lambda x: x["language"] == F.col("heard")["language"]), F.lit(0))
    margin = first["score"] - second["score"]
    sound = F.col("heard")["strong"] & fits.isNotNull() & (fits["avg_logprob"] >= -1) & (fits["compression"] <= 2.4)
    close = F.col("heard")["strong"] & fits.isNotNull() & (margin < 0.15)
    none, silent = F.size("h") == 0, ~F.col("has_voice") & F.forall("h", lambda x: x["no_speech"] > 0.6)
    won = F.when(F.coalesce(sound, F.lit(False)) | F.coalesce(close, F.lit(False)), fits).otherwise(first)
    reason = F.when(none, F.lit("no_text")).when(silent, F.lit("confirmed_silence")).when(sound, F.lit("strong_acoustic_language")).when(close, F.lit("acoustic_tie_break")).otherwise(F.lit("recognition_probability"))
    review = F.coalesce(margin < 0.15, F.lit(True)) | (won["language"] != first["language"]) | ~F.col("heard")["strong"] | (won["language"] != F.col("heard")["language"]) | (won["compression"] > 2.4) | (won["avg_logprob"] < -1)
    return groups.select(*key, F.when(~none & ~silent, won["language"]).alias("winner"), reason.alias("reason"), F.when(none, F.lit(True)).when(silent, F.lit(False)).otherwise(review).alias("review"))


def roll_up_hypothesis(segments: DataFrame, key: list[str]) -> DataFrame:
    """Token-weighted avg_logprob and no_speech (without tokens -10 and 1) and the largest compression (0)."""
    weight = F.sum("tokens")
    mean = lambda c, empty: F.coalesce(F.sum(F.col(c) * F.col("tokens")) / F.nullif(weight, F.lit(0)), F.lit(empty))
    return segments.groupBy(*key).agg(mean("avg_logprob", -10.0).alias("avg_logprob"), mean("no_speech", 1.0).alias("no_speech"), F.coalesce(F.max("compression"), F.lit(0.0)).alias("compression"))
