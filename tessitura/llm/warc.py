"""WARC archives: a writer of response and revisit records, and a salvage reader.

The writer gives each page a record in a gzip member of its own. Of pages with
equal payloads the one with the smallest id is the response; the others are
revisits that refer to it and keep only the HTTP header, whose Content-Length
still tells the size of the payload. The smallest id is found by partial
aggregation on the payload's SHA-256, so a group that holds a third of all rows
is combined map-side; payloads themselves are not shuffled. Each task writes files of its own name and returns a
manifest row for each; only the manifest of the attempt that Spark keeps is
read again, so lost executors leave unread files behind, never wrong results.

The reader checks each gzip member (CRC and length) and each record (version
line, header, Content-Length, closing blank lines, block and payload digests).
A member is inflated twice as a stream, to check it and to read its records one
by one. After a bad record it goes on at the next version line, inside the
member's content too. Of a member that is torn or fails its CRC, what could be
inflated is searched, and records whose own digest agrees are kept (a digest
does not cover the header); deflate cannot be entered again behind a tear, so
the reader then looks for the next member. What no valid record covers is
returned as a gap with the reason; a gap inside a member has the place of the
member, and its reason tells the bytes of the content. One task reads one file
and holds one record, or a member of up to ``_HELD`` bytes, at a time.

Null payloads count as empty. A null id is written as such: it is a response
unless a page with an id has the same payload. Rows that repeat the smallest
id are responses too. An empty table gives no archives and no rows. Other
columns are left to the caller.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, likely, new_folder

FILE_BYTES = 128 << 20
_READERS = 20_000
_BLOCK = 1 << 20
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HELD = 8 << 20

MANIFEST = "path string, bytes bigint, records bigint"
ROWS = "path string, begin bigint, end bigint, problem string, record_id string, record_type string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, payload binary"
_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
_ROWS_ARROW = pa.schema(
    [("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("problem", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes | None, refers_to=None, size: int | None = None, sha1: bytes | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record, not compressed; a revisit if ``refers_to`` is given, which needs no payload but its size and SHA-1."""
    if payload is not None:
        size, sha1 = len(payload), hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


_TO_WRITE = ["id", "url", "payload", "original", "size", "sha1"]


def with_originals(pages: DataFrame) -> DataFrame:
    """pages (id, url, payload) as ``_TO_WRITE``: revisits have ``original`` (the smallest id whose payload is equal), size and sha1 instead of a payload.

    Payloads surely held once are not shuffled, of others only the responses' are; what is joined are digests and ids."""
    own = F.coalesce("payload", F.lit("").cast("binary"))
    keyed = pages.select("id", "url", own.alias("payload"), F.sha2(own, 256).alias("key"))
    small = cut(keyed.select("id", "url", "key", F.octet_length("payload").cast("long").alias("size"), F.unhex(F.sha1("payload")).alias("sha1")))
    firsts = cut(small.groupBy("key").agg(F.min("id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").drop("n"))
    again = small.join(firsts, "key").where(~F.col("id").eqNullSafe(F.col("original")))
    revisits = again.select("id", "url", F.lit(None).cast("binary").alias("payload"), "original", "size", "sha1")
    marked = likely(keyed, F.xxhash64("key"), firsts.select(F.xxhash64("key")), flag="shared")
    # The response of each group, and what only seemed to be shared.
    kept = small.join(firsts, "key", "left").where(F.col("original").isNull() | F.col("id").eqNullSafe(F.col("original"))).select(F.xxhash64("id", "key").alias("held"))
    maybe = marked.where("shared").withColumn("held", F.xxhash64("id", "key"))
    responses = likely(maybe, F.col("held"), likely(kept, F.col("held"), maybe.select("held")).select("held"))
    responses = responses.join(firsts, "key", "left").where(F.col("original").isNull() | F.col("id").eqNullSafe(F.col("original")))
    none = [F.lit(None).cast("long").alias("original"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("sha1")]
    return marked.where("not shared").union(responses.select(*marked.columns)).select("id", "url", "payload", *none).union(revisits.select(*_TO_WRITE))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (id, url, payload binary) as archives in ``folder``; returns their manifest."""

    def write(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out = name = None
        written = count = 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": written, "records": count}], _MANIFEST_ARROW)

        for batch in batches:
            for page_id, url, payload, original, size, sha1 in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    name, written, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(page_id.as_py(), url.as_py(), payload.as_py(), original.as_py(), size.as_py(), sha1.as_py()))
                out.write(data)
                written, count = written + len(data), count + 1
                if written >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return cut(with_originals(pages).mapInArrow(write, MANIFEST))


class _Problem(Exception):
    pass


def _header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The named fields of the record at ``at``, and where its block begins."""
    if not _VERSION.match(data, at):
        raise _Problem("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise _Problem("header does not end")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Problem("header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise _Problem("no valid Content-Length")
    return fields, end + 4


def _checked(fields: dict[str, str], block: bytes) -> dict:
    """What a record holds, after its digests are compared."""
    stated = fields.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest(block):
        raise _Problem("block digest differs")
    kind, payload, size = fields.get("warc-type"), block, None
    if "application/http" in fields.get("content-type", ""):
        cut_at = block.find(b"\r\n\r\n")
        if cut_at < 0:
            raise _Problem("HTTP header does not end")
        payload = block[cut_at + 4 :]
        if found := re.search(rb"(?im)^content-length:\s*(\d+)\s*$", block[:cut_at].replace(b"\r\n", b"\n")):
            size = int(found[1])
    stated = fields.get("warc-payload-digest", "")
    if kind == "revisit":
        own, payload = stated.removeprefix("sha1:") or None, None
    else:
        own, size = digest(payload), len(payload)
        if stated.startswith("sha1:") and stated[5:] != own:
            raise _Problem("payload digest differs")
    return {"record_id": fields.get("warc-record-id"), "record_type": kind, "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": own, "payload": payload}


def _sure(fields: dict[str, str]) -> bool:
    """Whether a digest of the record was compared."""
    return fields.get("warc-block-digest", "").startswith("sha1:") or fields.get("warc-type") != "revisit" and fields.get("warc-payload-digest", "").startswith("sha1:")


class _Member:
    """The gzip member at ``at``: after its chunks are read, ``end`` is where it ends, or ``problem`` why it does not."""

    def __init__(self, source, at: int):
        self.source, self.at, self.end, self.problem = source, at, None, None

    def chunks(self):
        unpack, raw, at, more = zlib.decompressobj(31), b"", self.at, False
        while not unpack.eof:
            if not raw and not more:
                self.source.seek(at)
                raw = self.source.read(64 << 10)
                at += len(raw)
                if not raw:
                    self.problem = "member is cut off"
                    return
            before = unpack.copy()
            try:
                out = unpack.decompress(raw, _BLOCK)
            except zlib.error as error:
                self.problem = f"gzip: {error}"
                yield from self._up_to_tear(before, raw)
                return
            raw, more = unpack.unconsumed_tail, len(out) == _BLOCK
            if out:
                yield out
        self.end = at - len(unpack.unused_data)

    @staticmethod
    def _up_to_tear(unpack, raw: bytes):
        for k in range(len(raw)):
            try:
                out = unpack.decompress(raw[k : k + 1])
            except zlib.error:
                return
            if out:
                yield out


def _records(chunks, size: int):
    """What the content (``size`` bytes in ``chunks``) of a member holds, in order: (begin, end, problem, None, False) for a gap, (begin, end, None, record, sure)."""
    chunks, held, base = iter(chunks), bytearray(), 0  # held begins at base

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(chunks, None)
            if part is None:
                return False
            held.extend(part)
        return True

    lost, why = None, ""
    while fill(1):
        try:
            fill(64)
            if not _VERSION.match(held):
                raise _Problem("no version line")
            seen = 0
            while held.find(b"\r\n\r\n", max(0, seen - 3)) < 0:
                seen = len(held)
                if not fill(seen + 1):
                    break
            fields, begin = _header(held, 0)
            end = begin + int(fields["content-length"])
            if base + end + 4 > size:
                raise _Problem("record is cut off")
            fill(end + 4)
            if held[end : end + 4] != b"\r\n\r\n":
                raise _Problem("record does not end where its Content-Length says")
            found = _checked(fields, bytes(held[begin:end]))
        except _Problem as problem:
            if lost is None:
                lost, why = base, str(problem)
            # On to the next version line; a line that the chunks cut is kept.
            drop = 1
            while True:
                m = _VERSION.search(held, drop)
                if m:
                    drop = m.start()
                    break
                drop = max(drop, len(held) - 32)
                del held[:drop]
                base, drop = base + drop, 0
                if not fill(len(held) + 1):
                    drop = len(held)
                    break
            del held[:drop]
            base += drop
            continue
        if lost is not None:
            yield lost, base, why, None, False
            lost = None
        yield base, base + end + 4, None, found, _sure(fields)
        del held[: end + 4]
        base += end + 4
    if lost is not None:
        yield lost, size, why, None, False


def _next(source, at: int, size: int, mark: bytes) -> int:
    """Where ``mark`` next stands, at ``at`` or later; ``size`` if nowhere."""
    while at < size:
        source.seek(at)
        raw = source.read(_BLOCK)
        k = raw.find(mark)
        if k >= 0:
            return at + k
        if at + len(raw) >= size:
            return size
        at += len(raw) - len(mark) + 1
    return size


def _member_rows(source, at: int, size: int):
    """Rows of the member at ``at``, inner gaps among them."""
    whole, parts, total = _Member(source, at), [], 0
    for part in whole.chunks():
        total += len(part)
        if parts is not None:
            parts.append(part)
            if total > _HELD:
                parts = None
    stop = whole.end if whole.end is not None else _next(source, at + 1, size, _MEMBER)
    chunks = _Member(source, at).chunks() if parts is None else parts
    kept, gaps = 0, []
    for begin, end, why, found, sure in _records(chunks, total):
        if found is None or not sure and whole.end is None:
            gaps.append({"begin": at, "end": stop, "problem": f"bytes {begin} to {end} of the content: {why or 'no digest, and ' + whole.problem}"})
            continue
        yield from gaps
        gaps, kept = [], kept + 1
        yield found | {"begin": at, "end": stop}
    if not kept:
        raise _Problem(whole.problem or (gaps[0]["problem"] if gaps else "empty member"))
    yield from gaps
    if whole.problem:
        yield {"begin": at, "end": stop, "problem": f"after {kept} records: {whole.problem}"}


def _plain_rows(source, at: int, size: int):
    source.seek(at)
    head, more = source.read(4096), 4096
    while _VERSION.match(head) and b"\r\n\r\n" not in head and (part := source.read(more)):
        head, more = head + part, 2 * more
    fields, begin = _header(head, 0)
    length = int(fields["content-length"])
    if at + begin + length + 4 > size:
        raise _Problem("record is cut off")
    source.seek(at + begin)
    block = source.read(length)
    if source.read(4) != b"\r\n\r\n":
        raise _Problem("record does not end where its Content-Length says")
    yield _checked(fields, block) | {"begin": at, "end": at + begin + length + 4}


def salvage(source, size: int):
    """Rows of an open archive: records, and gaps (``problem`` set) over bytes that no valid record covers."""
    source.seek(0)
    zipped = source.read(3) == _MEMBER or _next(source, 0, size, b"WARC/") > _next(source, 0, size, _MEMBER)
    read, mark = (_member_rows, _MEMBER) if zipped else (_plain_rows, b"WARC/")
    at, lost, why = 0, None, ""
    while at < size:
        end = None
        try:
            for row in read(source, at, size):
                if lost is not None:
                    yield {"begin": lost, "end": at, "problem": why}
                    lost = None
                yield row
                end = row["end"]
        except _Problem as problem:
            if lost is None:
                lost, why = at, str(problem)
            end = _next(source, at + 1, size, mark)
        at = end
    if lost is not None:
        yield {"begin": lost, "end": size, "problem": why}


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records and gaps of all archives that ``manifest`` (a column path) lists."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_file(name) as source:
                    for row in salvage(source, source.size()):
                        held += len(row.get("payload") or b"")
                        if not payloads:
                            row["payload"] = None
                        rows.append({"path": path} | row)
                        if len(rows) >= 2000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ROWS_ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROWS_ARROW)

    # Paths are dealt one to a task up to _READERS tasks: their rows are tiny, so a deal by size would leave all files to one task.
    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), _READERS))).mapInArrow(read, ROWS)


def read_valid(manifest: DataFrame, quarantine: str, payloads: bool = True) -> DataFrame:
    """The valid records of all archives; the gaps (path, begin, end, problem) are written to ``quarantine`` as Parquet."""
    rows = cut(read_archives(manifest, payloads))
    rows.where("problem is not null").select("path", "begin", "end", "problem").coalesce(1).write.mode("errorifexists").parquet(quarantine)
    return rows.where("problem is null").drop("problem")


def _page_id(column):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url", F.col("html").cast("binary").alias("payload"))
    folder = new_folder(spark, "warc")
    rows = read_valid(write_archives(pages, folder), f"{folder}-quarantine", payloads=False)
    return rows.select(_page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_id(F.col("refers_to")).alias("refers_to"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), m AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d, min(page_id) OVER (PARTITION BY d) AS first,
         array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(d, i, 1)) - 1), 4, '0')), '') AS bits
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
            + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""
