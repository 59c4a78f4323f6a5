"""Readers of subtitle files, lyrics and alignments. Problems become rows of ``violations``, or errors with ``must_hold``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.text import WORD, clean_markup, composed, milliseconds, plain_markup

_TIME = r"(\d+:\d{2}:\d{2}[,.]\d{3})"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file; a byte order mark is dropped, line ends become line feeds."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return normal_lines(raw)


def normal_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("content", F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n?", "\n"))


def captions(files: DataFrame, mode: str = "lenient", key: str = "path") -> DataFrame:
    """(key, idx, ord, start_ms, end_ms, raw, text, is_empty, problem), one row per block of subtitle files.

    lenient: the first line with times counts, the number before it is the
    index (else the block's place), overlap is allowed. strict: number, times
    and text must stand in the first three lines, in this order; its text is not composed and keeps note signs. problem names
    what is wrong with a block, or is null."""
    if mode not in ("lenient", "strict"):
        raise ValueError("mode is 'lenient' or 'strict'")
    blocks = normal_lines(files).select(key, F.posexplode(F.split(F.trim(F.regexp_replace("content", r"^\s+|\s+$", "")), r"\n\s*\n")).alias("ord", "block"))
    lines = F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n")
    at = F.lit(1) if mode == "strict" else F.array_position(F.transform(lines, lambda x: x.rlike(rf"^\s*{_TIME}\s*-->\s*{_TIME}")), True) - 1
    row = blocks.withColumn("lines", lines).withColumn("at", at.cast("int"))
    times = F.get("lines", F.col("at"))
    number = F.trim(F.get("lines", F.col("at") - 1))
    numbered = F.coalesce(number.rlike(r"^\d+$"), F.lit(False))
    raw = F.trim(F.array_join(F.transform(F.slice("lines", F.col("at") + 2, F.size("lines")), lambda x: F.trim(x)), " "))
    parsed = row.select(
        key, (F.col("ord") + 1).alias("ord"), "lines", "at",
        F.when(numbered, number.cast("int")).otherwise(F.col("ord") + 1).alias("idx"),
        milliseconds(F.regexp_extract(times, rf"^\s*{_TIME}\s*-->", 1)).alias("start_ms"),
        milliseconds(F.regexp_extract(times, rf"-->\s*{_TIME}", 1)).alias("end_ms"),
        F.when(F.col("at") >= 0, raw).alias("raw"), numbered.alias("numbered"),
    ).withColumn("text", (plain_markup if mode == "strict" else clean_markup)(F.col("raw")))
    by_idx, by_time = W.partitionBy(key, "idx"), W.partitionBy(key).orderBy("start_ms", "ord")
    shape = (F.size("lines") < 3) | ~F.col("numbered") if mode == "strict" else F.lit(False)
    problem = (
        F.when(shape | F.col("start_ms").isNull() | F.col("end_ms").isNull(), F.lit("no_valid_times"))
        .when(F.count("*").over(by_idx) > 1, F.lit("repeated_index"))
        .when(F.col("end_ms") <= F.col("start_ms"), F.lit("end_not_after_start"))
    )
    if mode == "strict":
        problem = F.coalesce(problem, F.when(F.col("start_ms") < F.lag("end_ms").over(by_time), F.lit("overlap")))
    return parsed.withColumn("problem", problem).select(key, "idx", "ord", "start_ms", "end_ms", "raw", "text", (~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).alias("is_empty"), "problem")


def lyrics(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, no, line, problem): lines of lyrics, composed (NFC); [labels], ``2x`` endings and texts without words are problems."""
    own = normal_lines(files).withColumn("content", composed(F.regexp_replace("content", r"^\s+|\s+$", "")))
    lines = own.select(key, F.col("content").rlike(WORD).alias("words"), F.posexplode(F.split("content", "\n")).alias("no", "line"))
    problem = F.when(F.col("line").rlike(r"^\s*\[.*\]\s*$"), F.lit("label")).when(F.col("line").rlike(r"(?i)(?<![\p{L}\p{N}_])\d+\s*[x×]\s*$"), F.lit("repetition")).when(~F.col("words"), F.lit("no_words"))
    return lines.select(key, "no", "line", problem.alias("problem"))


def must_hold(rows: DataFrame, column: str = "problem") -> DataFrame:
    """``rows`` without the column; running the plan fails on the first problem."""
    checked = F.when(F.col(column).isNotNull(), F.raise_error(F.concat(F.lit("invalid row: "), F.col(column)))).cast("string")
    return rows.withColumn(column, checked).where(F.col(column).isNull()).drop(column)


UNITS_SCHEMA = "song_id string, units array<struct<id:string,word_id:string,block:int,no:int,text:string,start:double,end:double,core_start:double,core_end:double,score:double,origin:string,warnings:array<string>>>"


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Units of JSON alignments, in order of start and number."""
    return in_order(spark.read.json(path, schema=UNITS_SCHEMA, multiLine=True).select("song_id", F.inline("units")))


def in_order(units: DataFrame) -> DataFrame:
    """``units`` with ord, their place in their song by start and number."""
    return units.withColumn("ord", F.row_number().over(W.partitionBy("song_id").orderBy("start", "no", "id")))


def words_as_units(words: DataFrame) -> DataFrame:
    """Word mode: each word is a unit whose core is the whole word; fallback times get a warning."""
    warn = F.when(F.col("origin").contains("fallback"), F.array(F.lit("approximate_times"))).otherwise(F.array().cast("array<string>"))
    return words.withColumns({"word_id": F.col("id"), "core_start": F.col("start"), "core_end": F.col("end"), "warnings": F.array_distinct(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), warn))})


def confirmed_blocks(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """Blocks of a validated manifest (song_id, sha256, block, words) whose source hash still holds and that have a confirmed word."""
    return manifest.join(sources.select("song_id", "sha256"), ["song_id", "sha256"], "left_semi").where(F.exists("words", lambda w: w["confirmed"]))


def one_file_per_role(files: DataFrame) -> DataFrame:
    """(song_id, role, n, problem) over files (song_id, role, length): exactly one file that is not empty."""
    counted = files.groupBy("song_id", "role").agg(F.count("*").alias("n"), F.min("length").alias("least"))
    return counted.select("song_id", "role", "n", F.when(F.col("n") != 1, F.lit("not_one_file")).when(F.col("least") == 0, F.lit("empty_file")).alias("problem"))


def missing(requests: DataFrame, cache: DataFrame, key: str = "identity") -> DataFrame:
    """Requests whose identity the cache does not hold yet."""
    return requests.join(cache.select(key).distinct(), key, "left_anti")
