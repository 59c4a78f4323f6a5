"""Publication of notes and captions: note files and their check, metadata, and tables with a history."""

from __future__ import annotations

import struct
import uuid
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.text import half_up_ms
from tessitura.operators import audit, series
from tessitura.sources.writers import BEATS_PER_SECOND, TICKS_PER_BEAT, note_ticks, subtitle_text

VELOCITY, PROGRAM = 100, 52


def _number(n: int) -> bytes:
    """A variable-length quantity: seven bits a byte, the last without the high bit."""
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(out[::-1])


#: Quantities of up to two bytes, which nearly all are.
_NUMBERS = [_number(n) for n in range(1 << 14)]
_HEAD = b"\x00\xff\x51\x03" + round(1e6 / BEATS_PER_SECOND).to_bytes(3, "big") + bytes([0, 0xC0, PROGRAM])


def _track(notes) -> bytes:
    """A file of one track: tempo, voice, and for each note its text, its begin and its end."""
    return _track_of([(n["tick_on"], n["tick_off"], n["pitch"], n["text"]) for n in notes])


def _track_of(notes) -> bytes:
    """``_track`` of tuples."""
    number = lambda n: _NUMBERS[n] if 0 <= n < 1 << 14 else _number(n)
    events = []
    for on, off, pitch, text in notes:
        text = (text or "").encode("utf-8")
        events += [(on, 1, b"\xff\x05" + number(len(text)) + text), (on, 2, bytes((0x90, pitch, VELOCITY))), (off, 0, bytes((0x80, pitch, 0)))]
    events.sort(key=itemgetter(0, 1))
    parts, at = [_HEAD], 0
    for tick, _, data in events:
        parts += [number(tick - at), data]
        at = tick
    body = b"".join([*parts, b"\x00\xff\x2f\x00"])
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, TICKS_PER_BEAT) + b"MTrk" + struct.pack(">I", len(body)) + body


def _events(data: bytes):
    """(tick_on, tick_off, pitch) of the notes of a file as ``_track`` writes it; ValueError if it is none."""
    return [{"tick_on": on, "tick_off": off, "pitch": pitch} for on, off, pitch in _notes_of(data)]


def _notes_of(data: bytes) -> list[tuple[int, int, int]]:
    """``_events`` as tuples."""
    if data[:4] != b"MThd" or data[14:18] != b"MTrk" or struct.unpack(">I", data[18:22])[0] != len(data) - 22:
        raise ValueError("not a note file of one track")
    at, tick, open_, found = 22, 0, {}, []

    def number():
        nonlocal at
        n = 0
        while True:
            b = data[at]
            at += 1
            n = n << 7 | b & 0x7F
            if b < 0x80:
                return n

    while at < len(data):
        tick += number()
        status = data[at]
        at += 1
        if status == 0xFF:
            kind = data[at]
            at += 1
            size = number()
            at += size
            if kind == 0x2F:
                break
        elif status == 0xC0:
            at += 1
        elif status in (0x90, 0x80):
            pitch, at = data[at], at + 2
            if status == 0x90:
                open_[pitch] = tick
            else:
                found.append((open_.pop(pitch), tick, pitch))
        else:
            raise ValueError(f"unknown event {status:#x}")
    return sorted(found)


def note_files(notes: DataFrame) -> DataFrame:
    """(song_id, content): a note file of each song. notes: song_id, ord, start, end, pitch, text; a song is one group.

    Notes without length on the tick grid, out of range or overlapping make the plan fail."""
    w = W.partitionBy("song_id").orderBy("start", "ord")
    ticked = note_ticks(notes).withColumn("_last", F.lag("tick_off").over(w))
    wrong = F.col("problem").isNotNull() | (F.col("start") < 0) | (F.col("pitch") < 0) | (F.col("pitch") > 127) | (F.col("tick_on") < F.col("_last"))
    checked = ticked.withColumn("tick_on", F.when(wrong, F.raise_error(F.lit("a note has no valid time or pitch")).cast("long")).otherwise(F.col("tick_on")))

    @F.arrow_udf("binary")
    def files(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        notes = list(zip(*(flat.field(c).to_pylist() for c in ("tick_on", "tick_off", "pitch", "text")), strict=True))
        ends = pc.list_value_length(lists).to_numpy(zero_copy_only=False).cumsum().tolist()
        return pa.array([_track_of(notes[a:z]) for a, z in zip([0, *ends], ends, strict=False)], pa.binary())

    one = F.struct("start", "ord", "tick_on", "tick_off", F.col("pitch").cast("int").alias("pitch"), "text")
    return checked.groupBy("song_id").agg(F.array_sort(F.collect_list(one)).alias("n")).select("song_id", files("n").alias("content"))


def read_notes(files: DataFrame) -> DataFrame:
    """(song_id, no, tick_on, tick_off, pitch) of note files (song_id, content)."""

    @F.arrow_udf("array<struct<tick_on:bigint,tick_off:bigint,pitch:int>>")
    def events(contents: pa.Array) -> pa.Array:
        found = [_notes_of(x) for x in contents.to_pylist()]
        columns = [pa.array(c, k) for c, k in zip(zip(*chain.from_iterable(found), strict=True) if any(found) else ((), (), ()), (pa.int64(), pa.int64(), pa.int32()), strict=True)]
        offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["tick_on", "tick_off", "pitch"]))

    return files.select("song_id", F.posexplode(events("content")).alias("no", "n")).select("song_id", (F.col("no") + 1).alias("no"), "n.*")


def reread_problems(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(song_id, no, rule): where note files do not hold exactly the notes (missing, extra, differs), compared on the tick grid."""
    no = F.row_number().over(W.partitionBy("song_id").orderBy("start", "ord"))
    expected = note_ticks(notes).select("song_id", no.alias("no"), "tick_on", "tick_off", F.col("pitch").cast("int").alias("pitch"))
    return audit.coverage(expected, read_notes(files), ["song_id", "no"], ["tick_on", "tick_off", "pitch"])


def metadata(notes: DataFrame, language: str = "pt-BR") -> DataFrame:
    """(song_id, content): the six fields of a song's metadata as JSON."""
    rated = series.difficulty(notes, ["song_id"], "pitch", "start", "end")
    blank = F.lit("")
    fields = F.struct(blank.alias("title"), blank.alias("artist"), F.col("band").alias("difficulty"), F.lit(language).alias("language"), F.lit(0).alias("offset"), F.lit(0).alias("lyricsOffset"))
    return rated.select("song_id", F.to_json(fields).alias("content"))


def export(units: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """files, captions and metadata of each song, and problems: units without exactly one note, or files that do not hold the notes.

    units: song_id, unit, ord, word_id, block, text; notes: these and start, end, pitch."""
    same = audit.coverage(units, notes, ["song_id", "unit"], ["word_id", "block", "text", "ord"]).select("song_id", F.col("unit").cast("string").alias("part"), "rule")
    twice = audit.not_unique(notes, ["song_id", "unit"]).select("song_id", F.col("unit").cast("string").alias("part"), F.lit("repeated").alias("rule"))
    files = note_files(notes)
    reread = reread_problems(notes, files).select("song_id", F.col("no").cast("string").alias("part"), F.concat(F.lit("file_"), "rule").alias("rule"))
    timed = notes.withColumns({"start_ms": half_up_ms(F.col("start")), "end_ms": half_up_ms(F.col("end")), "text": F.trim("text")})
    unfit = timed.where((F.col("end_ms") <= F.col("start_ms")) | (F.col("text") == "") | F.col("text").rlike("[\r\n]")).select("song_id", F.col("unit").cast("string").alias("part"), F.lit("caption").alias("rule"))
    return {"files": files, "captions": subtitle_text(timed, ["song_id"], ["start", "ord"]), "metadata": metadata(notes), "problems": same.unionByName(twice).unionByName(reread).unionByName(unfit)}


# --- tables with a history


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(path, name)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions of a table, oldest first."""
    files, at = _folder(spark, root)
    found = [s.getPath().getName() for s in files.globStatus(at("v=*"))] if files.exists(at(".")) else []
    return sorted(int(n[2:]) for n in found if files.exists(at(f"{n}/_SUCCESS")))


#: Milliseconds after which the lock of a writer that is gone can be taken.
LEASE = 6 * 3_600_000


class _Lock:
    """The right to publish under a root: a file with its owner's name, made exclusively; one that is older than its lease belongs to a lost driver."""

    def __init__(self, spark: SparkSession, root: str, lease: int = LEASE):
        self.files, self.at = _folder(spark, root)
        self.spark, self.root, self.lease, self.owner = spark, root, lease, uuid.uuid4().hex

    def _create(self) -> bool:
        try:
            out = self.files.create(self.at("_lock"), False)  # fails if it is there
        except Py4JJavaError:
            return False
        out.write(bytearray(self.owner.encode()))
        out.close()
        return True

    def held(self) -> bool:
        """Whether the lock is still this writer's."""
        if not self.files.exists(self.at("_lock")):
            return False
        stream = self.files.open(self.at("_lock"))
        found = bytes(stream.readAllBytes()).decode()
        stream.close()
        return found == self.owner

    def __enter__(self):
        self.files.mkdirs(self.at("."))
        if self._create():
            return self
        made = self.files.getFileStatus(self.at("_lock")).getModificationTime() if self.files.exists(self.at("_lock")) else 0
        if self.spark._jvm.System.currentTimeMillis() - made > self.lease:
            # Of several that find an old lock one moves it away and goes on.
            if made and not self.files.rename(self.at("_lock"), self.at(f"_lock-{self.owner}")):
                raise FileExistsError(f"{self.root} is being published by another writer")
            self.files.delete(self.at(f"_lock-{self.owner}"), False)
            if self._create():
                return self
        raise FileExistsError(f"{self.root} is being published by another writer")

    def __exit__(self, *_):
        if self.held():
            self.files.delete(self.at("_lock"), False)


def publish_version(df: DataFrame, root: str, kind: str = "parquet", lease: int = LEASE) -> int:
    """Writes ``df`` as the next version under ``root`` and makes it the current one; older versions stay as history.

    A lock keeps a second writer out; the lock of a driver that was lost can be taken after ``lease`` milliseconds. A
    write that fails, or that lost its lock meanwhile, leaves the current version as it is: data is written under a name of
    its own, and one rename makes it a version."""
    spark = df.sparkSession
    with _Lock(spark, root, lease) as lock:
        done = versions(spark, root)
        number = (done[-1] if done else 0) + 1
        own = f"_writing-{lock.owner}"
        try:
            df.write.mode("errorifexists").format(kind).save(f"{root}/{own}")
            if not lock.held() or lock.files.exists(lock.at(f"v={number}/_SUCCESS")):
                raise FileExistsError(f"{root} was published by another writer meanwhile")
            if lock.files.exists(lock.at(f"v={number}")):  # left by a write that failed
                lock.files.delete(lock.at(f"v={number}"), True)
            if not lock.files.rename(lock.at(own), lock.at(f"v={number}")):
                raise OSError(f"{root}: version {number} could not be published")
        finally:
            lock.files.delete(lock.at(own), True)
        return number


def current(spark: SparkSession, root: str, kind: str = "parquet") -> DataFrame:
    """The newest version of a table."""
    return spark.read.format(kind).load(f"{root}/v={versions(spark, root)[-1]}")


def roll_back(spark: SparkSession, root: str) -> int:
    """Drops the newest version, so that the one before it is current again; returns its number. A publication under way keeps it out."""
    with _Lock(spark, root) as lock:
        done = versions(spark, root)
        if len(done) < 2:
            raise ValueError("there is no earlier version")
        lock.files.delete(lock.at(f"v={done[-1]}"), True)
        return done[-2]


def manifest(captions: DataFrame, words: DataFrame, sources: DataFrame, pending: DataFrame) -> DataFrame:
    """(song_id, sha256, sources, pending, blocks): what a publication of captions (song_id, content) rests on.

    words: song_id, block, no, text, start, end, confirmed; sources: song_id, name, sha256; pending: song_id."""
    one = F.struct("block", "no", "text", "start", "end", "confirmed")
    blocks = words.groupBy("song_id").agg(F.array_sort(F.collect_list(one)).alias("blocks"))
    from_ = sources.groupBy("song_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "sha256")))).alias("sources"))
    left = pending.groupBy("song_id").agg(F.count("*").alias("pending"))
    whole = captions.select("song_id", F.sha2("content", 256).alias("sha256")).join(from_, "song_id", "left").join(left, "song_id", "left").join(blocks, "song_id", "left")
    return whole.select("song_id", "sha256", "sources", F.coalesce("pending", F.lit(0)).alias("pending"), "blocks")


def seconds_of_ticks(tick: Column) -> Column:
    return tick / (BEATS_PER_SECOND * TICKS_PER_BEAT)
