"""Line deduplication by a segment-partition edit join.

A line (between line feeds) of at least ``MIN_CHARS`` code points is removed
where an equal line, or one within the threshold, stands earlier in the table,
by (id, line number). The threshold is one edit from ``MIN_CHARS`` on and two
from ``TWO_CHARS`` on (of the shorter line). Lines are judged on the input, not
on what is left. Shorter lines always stay.

Each line is split into one segment more than the threshold. Lines within the
threshold share a segment at a shifted place that the lengths and the number of
edits left of and right of it allow, so a line probes the segments of its own
and of slightly shorter lines there only. Index and probe entries (a segment's
hash and the line's hash) are packed by hash bucket and sorted within a bucket;
runs with several lines become groups. Texts are fetched for lines in groups
only and verified with a banded bit-parallel edit distance.

A segment that over ``_CHUNK`` lines share (a fixed start before a changing
tail) tells too little: lines of up to ``_SHORT`` code points are dealt once
more, by what is left of them without up to threshold characters, which two
lines within the threshold share too, so only lines that are a few edits from
each other meet there. Longer lines, and what is still over ``_CHUNK`` lines
then, are compared in pairs of chunks, which Spark deals to tasks as rows.

Equal lines are folded by partial aggregation before anything is joined, so
one line that makes up a third of all lines is one row. Where its occurrences
are looked up again, lines with more occurrences than a task should have are
broadcast; there are at most four for each shuffle partition.

Null texts stay null. Rows without an id are left as they are and remove
nothing. Rows that share an id count as one place: equal rows never remove
each other's lines. Other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, likely

MIN_CHARS, TWO_CHARS = 20, 48
_BUCKET_BYTES = 16 << 20  # of text, for each bucket
_CHUNK = 128
_SHORT = 128
_HELD, _SEEN = 1 << 17, 200_000
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ENTRY = np.dtype([("hash", "<u4"), ("line", "<u8")])


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(begin, size) of the threshold + 1 segments of a line of ``length``."""
    size, more = divmod(length, threshold + 1)
    sizes = [size] * (threshold + 1 - more) + [size + 1] * more
    return [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]


@dataclass(frozen=True)
class Limits:
    """From how many code points on lines are judged, and from how many on one edit and two edits do not count."""

    least: int = MIN_CHARS
    one: int = MIN_CHARS
    two: int = TWO_CHARS

    def edits(self, length: int) -> int:
        return (length >= self.one) + (length >= max(self.one, self.two))


@lru_cache(maxsize=100_000)
def places(length: int, limits: Limits) -> tuple[tuple[int, int, int], ...]:
    """(seed, begin, end) of each substring that a line of ``length`` looks up, its own segments included."""
    found = set()
    for shorter in range(max(limits.one, length - 2), length + 1):
        threshold, shift = limits.edits(shorter), length - shorter
        for k, (begin, size) in enumerate(segments(shorter, threshold)) if shift <= threshold else ():
            left, right = k, threshold - k  # edits that can lie left of the segment, and right of it
            for at in range(max(begin - left, begin + shift - right, 0), min(begin + left, begin + shift + right, length - size) + 1):
                found.add((shorter * 3 + k, at, at + size))
    return tuple(sorted(found))


def segment_keys(line: str, limits: Limits) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(line[b:e], s) for s, b, e in places(len(line), limits)]


def deletion_keys(line: str, limits: Limits) -> np.ndarray:
    """A hash of ``line`` without each choice of up to as many characters as it may have edits."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) * np.uint64(_MIX)
    n, edits = len(codes), limits.edits(len(line))
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
    hashes, at = [0], 0  # of all beginnings
    for c in codes.tolist():
        at = at * _BASE + c + 1 & (1 << 64) - 1
        hashes.append(at)
    start = np.array(hashes, np.uint64)
    part = lambda i, j: start[j] - start[i] * power[j - i]
    out = [start[n:]]
    if edits:
        i = np.arange(n)
        out.append(start[i] * power[n - 1 - i] + part(i + 1, np.full(n, n)))
    if edits > 1:
        i, j = np.triu_indices(n, 1)
        end = np.full(len(i), n)
        out.append(start[i] * power[n - 2 - i] + part(i + 1, j) * power[n - 1 - j] + part(j + 1, end))
    keys = np.unique(np.concatenate(out))
    return (keys ^ keys >> np.uint64(29)) * np.uint64(_MIX)


def within(a: str, b: str, threshold: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``threshold`` edits apart.

    Bit d of a state vector stands for the diagonal d - threshold; vector e
    holds the diagonals reached with e edits."""
    if abs(len(a) - len(b)) > threshold:
        return False
    begin, least = 0, min(len(a), len(b))
    step = 1 << max(least - 1, 0).bit_length()
    while step:  # the common prefix
        if begin + step <= least and a[begin : begin + step] == b[begin : begin + step]:
            begin += step
        else:
            step >>= 1
    end = 0
    while end < least - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    m, n = len(a), len(b)
    width = (1 << (2 * threshold + 1)) - 1
    states = [((1 << (e + 1)) - 1) << threshold & width for e in range(threshold + 1)]
    for j, c in enumerate(b):
        same = 0
        for d in range(2 * threshold + 1):
            i = j + d - threshold
            if 0 <= i < m and a[i] == c:
                same |= 1 << d
        new = [states[0] & same]
        for e in range(1, threshold + 1):
            new.append((states[e] & same | states[e - 1] | states[e - 1] >> 1 | new[e - 1] << 1) & width)
        states = new
        if not any(states):
            return False
    return bool(states[threshold] >> (m - n + threshold) & 1)


def _entries(keys_of, limits: Limits, buckets: int):
    """Arrow batches of texts to packed entries by bucket."""
    import xxhash

    kind = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])

    def run(batches):
        seen: set[int] = set()
        digest = xxhash.xxh64_intdigest
        hashes: list[np.ndarray] = []
        lines: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) < limits.one:
                        continue
                    key = digest(line, 42)
                    if key in seen:
                        continue
                    seen.add(key)
                    own = np.array(keys_of(line, limits), np.uint64)
                    hashes.append(own)
                    lines.append(np.full(len(own), key, np.uint64))
                    held += len(own)
                    if held >= _HELD:
                        yield packed(np.concatenate(hashes), np.concatenate(lines))
                        hashes, lines, held = [], [], 0
                if len(seen) > _SEEN:
                    seen.clear()
        if held:
            yield packed(np.concatenate(hashes), np.concatenate(lines))

    def packed(hashes, lines):
        table = np.empty(len(hashes), _ENTRY)
        table["hash"], table["line"] = hashes & np.uint64(0xFFFFFFFF), lines
        bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        table, bucket = table[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cuts])]), pa.array([x.tobytes() for x in np.split(table, cuts)], pa.binary())], schema=kind)

    return run


def _groups_of(bucket: int, parts: list[bytes]):
    """(group, lines) for all lines that share an entry with others in one bucket."""
    table = np.unique(np.frombuffer(b"".join(parts), _ENTRY))
    starts = np.flatnonzero(np.concatenate([[True], table["hash"][1:] != table["hash"][:-1]]))
    sizes = np.diff(np.append(starts, len(table)))
    for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        yield f"{bucket}-{table['hash'][s]}", table["line"][s : s + n]


_MEMBERS = "grp string, key bigint, chunk int, chunks int"


def _share(most: int):
    """A bucket's entries to rows of ``_MEMBERS``; chunk and chunks are null in groups of up to ``most`` lines."""

    def run(key, table):
        names, lines, chunk, chunks = [], [np.zeros(0, np.uint64)], [], []
        for name, own in _groups_of(key[0].as_py(), table.column("entries").to_pylist()):
            n = len(own)
            names += [name] * n
            lines.append(own)
            chunk += [None] * n if n <= most else (np.arange(n) // most).tolist()
            chunks += [None if n <= most else -(-n // most)] * n
        return pa.table({"grp": pa.array(names, pa.string()), "key": pa.array(np.concatenate(lines).view(np.int64)), "chunk": pa.array(chunk, pa.int32()), "chunks": pa.array(chunks, pa.int32())})

    return run


def _in_pairs(members: DataFrame) -> DataFrame:
    """(grp, key): large groups as groups of two of their chunks each."""
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk")
    return dealt.select(F.concat_ws("-", "grp", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("grp"), "key")


def _verified(limits: Limits):
    """Sorted (grp, line) batches to pairs of lines within the threshold, as positions of their first occurrence."""
    kind = pa.schema([(x, pa.int64()) for x in ("a1", "a2", "b1", "b2")])

    def pairs(rows):
        bags = np.array([np.bincount(np.frombuffer(x[2].encode("utf-8"), np.uint8) & 31, minlength=32) for x in rows], np.int32)
        sizes = np.array([len(x[2]) for x in rows])
        edits = np.array([limits.edits(n) for n in sizes.tolist()])
        for i in range(len(rows) - 1):
            least = np.minimum(edits[i + 1 :], edits[i])
            # Four bytes at most change with one edit on either side.
            near = (np.abs(bags[i + 1 :] - bags[i]).sum(1) <= 8 * least) & (np.abs(sizes[i + 1 :] - sizes[i]) <= least)
            for j in np.flatnonzero(near) + i + 1:
                if within(rows[i][2], rows[j][2], int(least[j - i - 1])):
                    yield (*rows[i][:2], *rows[j][:2])
                    yield (*rows[j][:2], *rows[i][:2])

    def run(batches):
        name, rows = None, []
        for batch in batches:
            out = []
            for grp, k1, k2, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != name:
                    out += pairs(rows) if len(rows) > 1 else ()
                    name, rows = grp, []
                rows.append((k1, k2, line))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=kind)
        out = list(pairs(rows)) if len(rows) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=kind)

    return run


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", limits: Limits = Limits(), chunk: int = _CHUNK) -> DataFrame:
    """(id, mark, gone): for each document that loses lines, their numbers from 0; mark is the hash of its text."""
    if limits.one <= 2:
        raise ValueError("a line needs more characters than edits")
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    exploded = texts.select("id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.char_length("line") >= limits.least)
    lines = cut(exploded.select("id", "mark", "no", *_keys(F.col("line")), F.char_length("line").alias("n_chars")))
    place = F.struct("id", "no", "mark")
    distinct = cut(lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("n_chars").alias("n_chars")))
    total = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(8, -(-total // _BUCKET_BYTES))
    parts = F.split("text", "\n")
    place_key = F.xxhash64("id", "mark")

    def fetched(keys: DataFrame) -> DataFrame:
        """(k1, k2, line) of the distinct lines with these keys, from where they first stand."""
        wanted = cut(keys.select(F.col("key").alias("k1")).distinct().join(distinct, "k1").groupBy("first.id", "first.mark").agg(F.collect_set("first.no").alias("nos")))
        holders = likely(texts.withColumn("mark", F.xxhash64("text")), place_key, wanted.select(place_key))
        found = holders.join(wanted.hint("shuffle_hash"), ["id", "mark"]).select(F.explode(F.transform("nos", lambda i: F.get(parts, i))).alias("line")).where("line is not null").distinct()
        return found.select(*_keys(F.col("line")), "line")

    dealt = lambda rows, keys_of, n: cut(rows.mapInArrow(_entries(keys_of, limits, n), "bucket int, entries binary").groupBy("bucket").applyInArrow(_share(chunk), _MEMBERS))
    first = dealt(texts.select("text"), segment_keys, buckets)
    hot = first.where("chunk is not null").join(distinct.select(F.col("k1").alias("key"), "n_chars"), "key")
    members = first.where("chunk is null").select("grp", "key").union(_in_pairs(hot.where(F.col("n_chars") > _SHORT)))
    short = hot.where(F.col("n_chars") <= _SHORT + 2).select("key").distinct()
    if not short.isEmpty():
        again = cut(fetched(short).select("line"))
        # Up to some 8,000 entries of 12 bytes for a line.
        second = dealt(again.withColumnRenamed("line", "text"), deletion_keys, max(8, 60_000 * again.count() // _BUCKET_BYTES))
        second = second.withColumn("grp", F.concat(F.lit("d"), "grp"))
        members = members.union(second.where("chunk is null").select("grp", "key")).union(_in_pairs(second.where("chunk is not null")))
    members = cut(members)
    grouped = members.withColumnRenamed("key", "k1").join(fetched(members.select("key")), "k1").select("grp", "k1", "k2", "line")
    near = grouped.repartition("grp").sortWithinPartitions("grp").mapInArrow(_verified(limits), "a1 bigint, a2 bigint, b1 bigint, b2 bigint").distinct()
    other = distinct.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("first").alias("near_first"))
    nearest = near.join(other, ["b1", "b2"]).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.min("near_first").alias("near_first"))
    distinct = distinct.join(nearest, ["k1", "k2"], "left").withColumn("earliest", F.least("first", "near_first"))
    shared = cut(distinct.where("n > 1 or near_first < first").select("k1", "k2", "n", F.col("earliest.id").alias("e_id"), F.col("earliest.no").alias("e_no")))
    # At most four lines for each shuffle partition can stand this often, so they can be broadcast.
    often = (shared.agg(F.sum("n")).head()[0] or 0) / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent, rare = shared.where(F.col("n") > often), shared.where(F.col("n") <= often)
    joined = lines.join(F.broadcast(frequent), ["k1", "k2"]).union(lines.join(F.broadcast(frequent.select("k1", "k2")), ["k1", "k2"], "left_anti").join(rare, ["k1", "k2"]))
    gone = joined.where("e_id < id or (e_id = id and e_no < no)")
    return gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def mark_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", into: str = "lines", **how) -> DataFrame:
    """``docs`` with a struct ``into``: n_lines, gone (numbers of removed lines) and text (what is left)."""
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}; name another")
    taken = list(docs.columns)
    n_id, n_mark, n_gone = (free_name(taken, x) for x in ("gone_id", "gone_mark", "gone"))
    gone = repeated(docs, id_column, text, **how).select(F.col("id").alias(n_id), F.col("mark").alias(n_mark), F.col("gone").alias(n_gone))
    own, parts = F.col(f"`{text}`"), F.split(F.col(f"`{text}`"), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), n_gone), lambda i: i)
    left = F.array_join(F.transform(F.array(parts), lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n")), "")
    joined = docs.join(gone.hint("shuffle_hash"), (F.col(f"`{id_column}`") == F.col(n_id)) & (F.xxhash64(own) == F.col(n_mark)), "left")
    value = F.struct(
        F.when(own.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.col(n_gone), F.array().cast("array<int>")).alias("gone"),
        F.when(F.col(n_gone).isNull(), own).otherwise(left).alias("text"),
    )
    return joined.withColumn(into, value).select(*[F.col(f"`{c}`") for c in taken], into)


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without repeated lines; every document stays, if need be with an empty text."""
    into = free_name(docs.columns, "lines")
    return mark_lines(docs, id_column, text, into, **how).withColumn(text, F.col(into)["text"]).drop(into)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = F.col("lines")
    return mark_lines(docs).select(
        "doc_id", x["n_lines"].alias("n_lines"), F.size(x["gone"]).cast("long").alias("n_removed"), F.array_join(x["gone"].cast("array<string>"), ",").alias("removed_lines"), F.sha2(x["text"], 256).alias("kept_sha256")
    )
