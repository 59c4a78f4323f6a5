"""Subtitle and note files as data sources of Spark: ``spark.read.format("subtitles")``, ``df.write.format("notefiles")``.

A folder is published as a whole or not at all. Tasks write their songs into a
folder of a new version; the commit lists them and then moves one small file,
``_current``, which names the version. Readers follow it, so they see all files
of a publication or none, also where many files cannot be moved at once; what a
failed task or job leaves is in no list. Appending adds songs to those that are
there (the same song again is refused), overwriting begins a new list; earlier
versions stay as history and ``restore`` makes one current again. A folder
without ``_current`` is read as it is: all files with the right suffix.

Files of a few hundred bytes take a block of the disk each, and a name each in the
list that the driver holds. With the option ``packed`` a task stores its songs in
zip archives instead, under the same names; the list then names the archives. A
packed publication is written at once: it cannot be appended to.

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS by URI).
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessitura.functions.text import plain_text
from tessitura.sources.publication import _events, _track

SUBTITLES = "path string, song_id string, ord int, idx int, start_ms long, end_ms long, raw string, text string, problem string"
NOTES = "path string, song_id string, no int, tick_on long, tick_off long, pitch int"
#: Bytes of files that one task reads, about.
TASK_BYTES = 32 << 20
#: Songs of an archive: what its plain form has room for.
PACK_SONGS = 65_535
_TIMES = re.compile(r"\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})", re.ASCII)


def _store(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local.rstrip("/")) if "://" not in local else fs.FileSystem.from_uri(local.rstrip("/"))


def file_name(song_id: str, suffix: str) -> str:
    """A name that is valid in any store: what is reserved is percent-encoded."""
    coded = re.sub(r'[\x00-\x1f<>:"/\\|?*%]|^\.+|[. ]$', lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), song_id)
    return f"{coded or '%'}{suffix}"


def song_of(path: str, suffix: str) -> str:
    name = path.rsplit("/", 1)[-1].removesuffix(suffix)
    return "" if name == "%" else unquote(name)


# --- reading


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(tuple(paths))
        self.paths = tuple(paths)


class _Reader(DataSourceReader):
    """Deals the files of a folder to tasks of about TASK_BYTES and reads them one by one."""

    def __init__(self, path: str, suffix: str, parse):
        self.path, self.suffix, self.parse = path, suffix, parse

    def _found(self):
        from pyarrow import fs

        store, root = _store(self.path)
        current = _current(store, root)
        if current:
            names = [*_listed(store, root, current["version"]).values(), *_packs(store, root, current["version"])]
            infos = [store.get_file_info(f"{root}/{f}") for f in sorted(names)]
            lost = [i.path for i in infos if i.type != fs.FileType.File]
            if lost:
                raise FileNotFoundError(f"published files are gone: {lost[:3]}")
            return infos
        if store.get_file_info(root).type == fs.FileType.File:
            return [store.get_file_info(root)]
        every = store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(root) + 1 :].split("/"))
        return sorted((i for i in every if i.type == fs.FileType.File and i.path.lower().endswith(self.suffix) and not hidden(i.path)), key=lambda i: i.path)

    def partitions(self):
        out, some, size = [], [], 0
        for info in self._found():
            if info.path.endswith(".zip"):  # many small songs: a task of its own
                out.append(_Files([info.path]))
                continue
            if some and size + info.size > TASK_BYTES:
                out.append(_Files(some))
                some, size = [], 0
            some.append(info.path)
            size += info.size
        return [*out, _Files(some)] if some or not out else out

    def read(self, partition) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, content in self._contents(store, partition.paths):
            song = song_of(path, self.suffix)
            for row in self.parse(content):
                yield (path, song, *row)

    @staticmethod
    def _contents(store, paths) -> Iterator[tuple[str, bytes]]:
        for path in paths:
            if path.endswith(".zip"):
                with store.open_input_file(path) as file, zipfile.ZipFile(file) as pack:
                    for info in pack.infolist():
                        yield f"{path}/{info.filename}", pack.read(info)
                continue
            with store.open_input_stream(path) as stream:
                content = stream.read()
            yield path, content


def subtitle_rows(content: bytes, strict: bool = False) -> Iterator[tuple]:
    """(ord, idx, start_ms, end_ms, raw, text, problem) of the blocks of a file, in the order of the file."""
    text = re.sub("\r\n?", "\n", content.decode("utf-8-sig", "replace")).strip()
    found, seen = [], {}
    for ord_, block in enumerate(re.split(r"\n\s*\n", text) if text else [], 1):
        lines = block.strip().split("\n")
        at = 1 if strict else next((k for k, x in enumerate(lines) if _TIMES.match(x)), -1)
        times = _TIMES.match(lines[at]) if 0 <= at < len(lines) else None
        number = lines[at - 1].strip() if at > 0 else ""
        numbered = re.fullmatch(r"[0-9]{1,9}", number) is not None
        h = [int(x) for x in times.groups()] if times else [0, 60, 0, 0] * 2
        start, end = (((a * 60 + b) * 60 + c) * 1000 + d if b < 60 and c < 60 else None for a, b, c, d in (h[:4], h[4:]))
        raw = " ".join(x.strip() for x in lines[at + 1 :]).strip() if at >= 0 else None
        idx = int(number) if numbered else ord_
        seen[idx] = seen.get(idx, 0) + 1
        bad = start is None or end is None or strict and (len(lines) < 3 or not numbered)
        found.append((ord_, idx, start, end, raw, None if raw is None else plain_text(raw, not strict), bad))
    before = None
    overlap = set()
    for row in sorted((r for r in found if r[2] is not None), key=lambda r: (r[2], r[0])):
        if strict and before is not None and row[2] < before:
            overlap.add(row[0])
        before = row[3]
    for row in found:
        problem = "no_valid_times" if row[6] else "repeated_index" if seen[row[1]] > 1 else "end_not_after_start" if row[3] <= row[2] else "overlap" if row[0] in overlap else None
        yield (*row[:6], problem)


def note_rows(content: bytes) -> Iterator[tuple]:
    """(no, tick_on, tick_off, pitch) of a note file."""
    for no, n in enumerate(_events(content), 1):
        yield no, n["tick_on"], n["tick_off"], n["pitch"]


# --- writing


def _current(store, root: str) -> dict | None:
    from pyarrow import fs

    if store.get_file_info(f"{root}/_current").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/_current") as stream:
        return json.loads(stream.read())


def _listed(store, root: str, version: str) -> dict[str, str]:
    """song: file of a version."""
    with store.open_input_stream(f"{root}/{version}/_files.json") as stream:
        return json.loads(stream.read())["files"]


def _packs(store, root: str, version: str) -> list[str]:
    """The archives of a version, none if it was not packed."""
    with store.open_input_stream(f"{root}/{version}/_files.json") as stream:
        return json.loads(stream.read()).get("packs", [])


@dataclass
class _Written(WriterCommitMessage):
    files: dict[str, str]
    packs: tuple[str, ...] = ()


class _Writer(DataSourceWriter):
    """Writes a file for each song; rows of a song stand together in one task, in their order (``write_files`` sees to it)."""

    def __init__(self, path: str, suffix: str, columns: tuple[str, ...], schema: StructType, overwrite: bool, render, packed: bool = False):
        missing = [c for c in columns if c not in schema.names]
        if missing:
            raise ValueError(f"columns {missing} are needed")
        self.path, self.suffix, self.columns, self.overwrite, self.render, self.packed = path, suffix, columns, overwrite, render, packed
        self.version = f"v-{uuid.uuid4().hex}"

    def write(self, rows) -> WriterCommitMessage:
        store, root = _store(self.path)
        context = TaskContext.get()
        folder = f"{self.version}/part-{context.partitionId()}-{context.taskAttemptId()}" if context else f"{self.version}/part"
        if self.packed:
            return self._write_packs(rows, store, root, folder)
        files: dict[str, str] = {}
        for song, own in groupby(rows, key=lambda r: r["song_id"]):
            if song is None or song in files:
                raise ValueError(f"the rows of song {song!r} do not stand together" if song is not None else "a row has no song_id")
            if not files:
                store.create_dir(f"{root}/{folder}")
            name = f"{folder}/{file_name(song, self.suffix)}"
            with store.open_output_stream(f"{root}/{name}") as out:
                for piece in self.render(song, own):
                    out.write(piece)
            files[song] = name
        return _Written(files)

    def _write_packs(self, rows, store, root: str, folder: str) -> WriterCommitMessage:
        songs, packs, stream, pack = set(), [], None, None
        try:
            for song, own in groupby(rows, key=lambda r: r["song_id"]):
                if song is None or song in songs:
                    raise ValueError(f"the rows of song {song!r} do not stand together" if song is not None else "a row has no song_id")
                if len(songs) % PACK_SONGS == 0:
                    if pack:
                        pack.close()
                        stream.close()
                    store.create_dir(f"{root}/{folder}")
                    packs.append(f"{folder}/{len(packs):05d}.zip")
                    stream = store.open_output_stream(f"{root}/{packs[-1]}")
                    pack = zipfile.ZipFile(stream, "w")
                pack.writestr(zipfile.ZipInfo(file_name(song, self.suffix)), b"".join(self.render(song, own)))
                songs.add(song)
            if pack:
                pack.close()
        finally:
            if stream:
                stream.close()
        return _Written({}, tuple(packs))

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        current = _current(store, root)
        if current and not self.overwrite and (self.packed or _packs(store, root, current["version"])):
            self.abort(messages)
            raise ValueError("a packed publication is written at once: it can be overwritten, not appended to")
        files = {} if self.overwrite or not current else _listed(store, root, current["version"])
        for message in messages:
            twice = [s for s in message.files if s in files]
            if twice:
                self.abort(messages)
                raise ValueError(f"songs are there already, or in two tasks: {sorted(twice)[:3]}")
            files |= message.files
        store.create_dir(f"{root}/{self.version}")
        before = current["version"] if current else None
        with store.open_output_stream(f"{root}/{self.version}/_files.json") as out:
            out.write(json.dumps({"before": before, "files": files, "packs": [p for m in messages for p in m.packs]}, ensure_ascii=False, sort_keys=True).encode())
        _point(store, root, {"version": self.version, "before": before})

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.version}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.version}")


def _point(store, root: str, to: dict) -> None:
    """Makes a version the current one, by one file that is replaced as a whole."""
    with store.open_output_stream(f"{root}/{to['version']}/_pointer.json") as out:
        out.write(json.dumps(to).encode())
    store.move(f"{root}/{to['version']}/_pointer.json", f"{root}/_current")


def restore(path: str) -> str:
    """Makes the version before the current one current again; returns its name."""
    store, root = _store(path)
    current = _current(store, root)
    if not current or not current["before"]:
        raise ValueError("there is no earlier version")
    earlier = current["before"]
    with store.open_input_stream(f"{root}/{earlier}/_files.json") as stream:
        before = json.loads(stream.read())["before"]
    _point(store, root, {"version": earlier, "before": before})
    return earlier


def _stamp(ms: int) -> str:
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def render_subtitles(song: str, rows) -> Iterator[bytes]:
    """Numbered blocks; a caption without times, length or text, or with an empty line in it, is an error."""
    for n, r in enumerate(rows, 1):
        start, end, text = r["start_ms"], r["end_ms"], r["text"]
        if start is None or end is None or not 0 <= start < end or not text or not text.strip() or re.search(r"\n\s*\n|\r", text.strip()):
            raise ValueError(f"song {song!r}, caption {n}: no valid times or text")
        yield f"{chr(10) if n > 1 else ''}{n}\n{_stamp(start)} --> {_stamp(end)}\n{text}\n".encode()


def render_notes(song: str, rows) -> Iterator[bytes]:
    """One track; notes out of range, without length or overlapping are an error. A song's notes are held at once."""
    notes, before = [], 0
    for r in rows:
        n = {c: r[c] for c in ("tick_on", "tick_off", "pitch", "text")}
        if None in (n["tick_on"], n["tick_off"], n["pitch"]) or not before <= n["tick_on"] < n["tick_off"] or not 0 <= n["pitch"] <= 127:
            raise ValueError(f"song {song!r}, note {len(notes) + 1}: no valid time or pitch")
        notes.append(n)
        before = n["tick_off"]
    yield _track(notes)


# --- the sources


def _packed(options) -> bool:
    return options.get("packed", "false").lower() == "true"


class SubtitleFiles(DataSource):
    """Format ``subtitles``: .srt files. Option ``mode``: lenient (the default) or strict."""

    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return SUBTITLES

    def reader(self, schema):
        mode = self.options.get("mode", "lenient")
        if mode not in ("lenient", "strict"):
            raise ValueError("mode is 'lenient' or 'strict'")
        return _Reader(self.options["path"], ".srt", _Subtitles(mode == "strict"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], ".srt", ("song_id", "start_ms", "end_ms", "text"), schema, overwrite, render_subtitles, _packed(self.options))


@dataclass
class _Subtitles:
    strict: bool

    def __call__(self, content: bytes):
        return subtitle_rows(content, self.strict)


class NoteFiles(DataSource):
    """Format ``notefiles``: .mid files of one track on the tick grid."""

    @classmethod
    def name(cls) -> str:
        return "notefiles"

    def schema(self) -> str:
        return NOTES

    def reader(self, schema):
        return _Reader(self.options["path"], ".mid", note_rows)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], ".mid", ("song_id", "tick_on", "tick_off", "pitch", "text"), schema, overwrite, render_notes, _packed(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    for source in (SubtitleFiles, NoteFiles):
        spark.dataSource.register(source)


def write_files(df: DataFrame, kind: str, path: str, order: list[str], overwrite: bool = False, packed: bool = False) -> None:
    """Publishes a file for each song of ``df`` (song_id and what the format needs), its rows in ``order``; ``packed``: in archives.

    One shuffle brings the rows of a song together; a song's file is written by one task."""
    register(df.sparkSession)
    rows = df.withColumn("song_id", df["song_id"].cast("string")).repartition("song_id").sortWithinPartitions("song_id", *order)
    rows.write.format(kind).option("packed", str(packed).lower()).mode("overwrite" if overwrite else "append").save(path)


def read_files(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(**options).load(path)
