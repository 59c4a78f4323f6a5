"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

In every stage an empty table stays empty, other columns pass through (but the
last, whose columns are fixed) and clashing names are avoided. Null ids are kept
where ids decide; what a null text means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import free_name, new_folder
from tessitura.llm.decontaminate import decontaminate
from tessitura.llm.line_dedup import drop_repeated_lines
from tessitura.llm.pieces import default_model, encode_and_decode
from tessitura.llm.quality import keep_good
from tessitura.llm.simhash import NEAR, drop_near_duplicates


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go, those without a text among them; equal rows are judged alike."""
    return keep_good(docs)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, by id and line, go; every document stays, if need be with an empty text.

    Null texts stay null; rows without an id keep all lines; rows that share an id do not take lines from each other."""
    return _measured(drop_repeated_lines(docs))


def simhash_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words) stays: the one with the smallest id.

    Null and empty texts are one group; of rows that share the kept id one stays; rows without an id stay."""
    return drop_near_duplicates(docs, **NEAR)


def benchmark_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that occur in benchmark windows go; the documents stay. Null texts stay null; an empty benchmark takes nothing."""
    return _measured(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def sentencepiece(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids, which are decoded to check them; null texts have none."""
    into = free_name(docs.columns, "pieces")
    p = F.col(into)
    encoded = encode_and_decode(docs, default_model(), into=into)
    return encoded.select("doc_id", "lang", "source", p["n_tokens"].alias("n_tokens"), p["ids"].alias("ids"), p["decoded_sha256"].alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Near-duplicates, edit distances and pieces are beyond SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written under the shared folder and read again."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
