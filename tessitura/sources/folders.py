"""What lies in the folders of songs: roles of files, whether an operation can begin, what a validated manifest still holds, and a cache by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.shared import spread
from tessitura.functions.text import is_audio
from tessitura.sources.writers import subtitle_text

#: The stem of each role's file, and its suffix (none: any audio).
ROLES = {"voice": ("voz", None), "instrumental": ("instrumental", None), "captions": ("letra", ".srt"), "lyrics": ("letra", ".txt")}
#: What each operation needs, and which files must not be there before it.
NEEDS = {"captions": ("voice",), "notes": ("voice", "instrumental", "captions", "lyrics")}
RESERVED = {"captions": ("letra.srt", "letra_geracao.json"), "notes": ()}
MODES = {"syllables": "silabas", "words": "palavras"}
MANIFEST_VERSION = 1


def caption_suffix(mode: str) -> str:
    """What is added to the names of caption files of a mode."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {sorted(MODES)}, not {mode!r}")
    return MODES[mode]


def roles(files: DataFrame, known: dict[str, tuple[str, str | None]] = ROLES) -> DataFrame:
    """(song_id, role, path, length) of the files (song_id, path, length) that have a role, by stem and suffix whatever their case.

    Deeper folders do not count: files lie in the folder of their song."""
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    found = [F.when(here, F.lit(role)) for role, here in _has_role(name, known).items()]
    return files.withColumn("role", F.explode(F.array_compact(F.array(*found)))).select("song_id", "role", "path", "length")


def _has_role(name: Column, known: dict[str, tuple[str, str | None]]) -> dict[str, Column]:
    """For each role whether a file of this name, in lower case, has it."""
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return {role: (stem == s) & (is_audio(name) if kind is None else suffix == kind) for role, (s, kind) in known.items()}


def folder_state(songs: DataFrame, files: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """(song_id, operation, problem): for each song and operation what is in its way first, or null.

    songs: song_id; files: song_id, path, length; captions: song_id, idx, start_ms, end_ms of the subtitles that were read
    (for notes). Problems: missing_, several_ and empty_ with the role, reserved_file, no_captions, captions_overlap."""
    tasks = spread(songs.sparkSession)  # given, since narrow rows that are put together by bytes are many to a task
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    has = _has_role(name, ROLES)
    marks = {f"_is_{role}": F.when(here, F.struct("length")) for role, here in has.items()}
    taken = {f"_taken_{op}": name.isin(*names) for op, names in RESERVED.items() if names}
    marked = files.select("song_id", *[c.alias(k) for k, c in (marks | taken).items()]).repartition(tasks, "song_id")
    seen = marked.groupBy("song_id").agg(*[F.count(f"_is_{r}").alias(f"_n_{r}") for r in has], *[F.min(f"_is_{r}.length").alias(f"_least_{r}") for r in has], *[F.bool_or(k).alias(k) for k in taken])
    told = songs.select("song_id").repartition(tasks, "song_id").distinct().join(seen, "song_id", "left")

    def first(op):
        """What is in the way of an operation first: a role that it needs, in their order, then a file that must not be there."""
        kinds = [F.concat(F.when(F.coalesce(f"_n_{r}", F.lit(0)) == 0, "missing_").when(F.col(f"_n_{r}") > 1, "several_").when(F.col(f"_least_{r}") == 0, "empty_"), F.lit(r)) for r in NEEDS[op]]
        reserved = [F.when(F.col(f"_taken_{op}"), F.lit("reserved_file"))] if RESERVED[op] else []
        return F.struct(F.lit(op).alias("operation"), F.coalesce(*kinds, *reserved).alias("problem"))

    state = told.select("song_id", F.explode(F.array(*map(first, NEEDS))).alias("x")).select("song_id", "x.*")
    if captions is None:
        return state
    w = W.partitionBy("song_id").orderBy("start_ms", "idx")
    crossed = captions.repartition(tasks, "song_id").withColumn("_over", F.col("start_ms") < F.lag("end_ms").over(w)).groupBy("song_id").agg(F.coalesce(F.bool_or("_over"), F.lit(False)).alias("_over"))
    read = state.join(crossed, "song_id", "left")
    of_notes = F.when(F.col("_over").isNull(), "no_captions").when(F.col("_over"), "captions_overlap")
    return read.withColumn("problem", F.coalesce("problem", F.when(F.col("operation") == "notes", of_notes))).drop("_over")


def manifest_problems(manifest: DataFrame, captions: DataFrame, voices: DataFrame) -> DataFrame:
    """(song_id, problem) of each manifest (song_id, version, sha256, sources map): unknown_version, captions_changed, voice_changed or null.

    captions and voices: song_id, sha256 of the files as they now are; one that is not there counts as changed."""
    now = manifest.join(captions.select("song_id", F.col("sha256").alias("_captions")), "song_id", "left").join(voices.select("song_id", F.col("sha256").alias("_voice")), "song_id", "left")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    problem = (
        F.when(~same(F.col("version"), F.lit(MANIFEST_VERSION)), "unknown_version")
        .when(~same(F.col("sha256"), F.col("_captions")), "captions_changed")
        .when(~same(F.col("sources")["voice"], F.col("_voice")), "voice_changed")
    )
    return now.select("song_id", problem.alias("problem"))


def confirmed_times(manifest: DataFrame, captions: DataFrame, voices: DataFrame) -> DataFrame:
    """(song_id, block, words): the blocks with a confirmed word of manifests that still hold.

    manifest: song_id, version, sha256, sources, blocks array<struct<block,no,text,start,end,confirmed>>."""
    sound = manifest_problems(manifest, captions, voices).where("problem IS NULL").select("song_id")
    words = manifest.join(sound, "song_id", "left_semi").select("song_id", F.explode("blocks").alias("w"))
    blocks = words.groupBy("song_id", F.col("w.block").alias("block")).agg(F.array_sort(F.collect_list(F.struct("w.no", "w.text", "w.start", "w.end", "w.confirmed"))).alias("words"))
    return blocks.where(F.exists("words", lambda w: F.coalesce(w["confirmed"], F.lit(False))))


def differing_captions(blocks: DataFrame, contents: DataFrame) -> DataFrame:
    """(song_id, problem): where the text of a subtitle file (song_id, content) is not what its report's blocks spell (differs, no_file, no_blocks).

    blocks: song_id, idx, start_ms, end_ms, text. Run before publishing, so that a file and its report never disagree."""
    spelled = subtitle_text(blocks, ["song_id"], ["start_ms", "idx"]).select("song_id", F.col("content").alias("_own"))
    both = spelled.join(contents.select("song_id", "content"), "song_id", "full_outer")
    problem = F.when(F.col("content").isNull(), "no_file").when(F.col("_own").isNull(), "no_blocks").when(F.rtrim(F.regexp_replace("content", r"\s+$", "")) != F.regexp_replace("_own", r"\s+$", ""), "differs")
    return both.select("song_id", problem.alias("problem")).where("problem IS NOT NULL")


def cached(requests: DataFrame, root: str, compute: Callable[[DataFrame], DataFrame], key: str = "identity") -> DataFrame:
    """``requests`` with what ``compute`` makes of them, made once for each ``key`` and kept under ``root``.

    ``key`` is a content address (``functions.text.identity``): other content has another one, so an entry is never stale.
    ``compute`` gets the requests whose key is not kept yet, one for each key, and returns rows with ``key``; they are added
    to the table, which is partitioned by the first two digits of the key, so that a lookup reads few files. Two writers may
    make the same entry; it is read once."""
    spark = requests.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    shard = F.substring(F.col(key), 1, 2)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    wanted = requests.dropDuplicates([key])
    if there:
        wanted = wanted.join(spark.read.parquet(root).select(key).distinct(), key, "left_anti")
    fresh = compute(wanted)
    if key not in fresh.columns or "shard" in fresh.columns:
        raise ValueError(f"what is computed needs a column {key!r} and none named 'shard'")
    if not there or not wanted.isEmpty():
        fresh.withColumn("shard", shard).write.mode("append").partitionBy("shard").parquet(root)
    kept = spark.read.schema(fresh.withColumn("shard", shard).schema).parquet(root).dropDuplicates(["shard", key])
    own = [c for c in kept.columns if c not in (key, "shard")]
    return requests.withColumn("shard", shard).join(kept.select("shard", key, *own), ["shard", key], "left").drop("shard")
