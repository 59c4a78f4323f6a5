"""Removal of substrings that also start in an earlier document.

Texts are UTF-8 bytes. Each byte covered by a ``length``-byte string that also
starts in a document with a smaller id is removed; strings are judged on the
input. Every such string is dealt by the smallest hash of its parts of
``_GRAM`` bytes, so equal strings meet wherever they stand; neighbouring
strings with the same smallest part travel as one run of bytes (about 14
strings in 63 bytes), packed by bucket.

Little is dealt that cannot be removed or remove. A text equal to one with a
smaller id is removed whole, and not looked at again. Of the others the hashes
of runs are counted first, as sorted numbers of 24 to 44 bits; those found more
than once are marked in a bitmap of at most 2**28 bits, which is broadcast.
Runs whose hash is not marked share no string with another one and stay where
they are; what a full bitmap lets through costs time and disk, not results.

Buckets are shards of the corpus: Spark's shuffle is the store on disk, and a
bucket is small enough to be sorted in memory. Within a bucket equal runs are
folded (a hash of their ends proposes, their bytes decide), fingerprints leave
the runs that share a string with another one, and the suffixes of these are
ordered by induced sorting (``induced``). Neighbours in that order that share
``length`` bytes are equal strings, and the smallest id of each group decides.

Runs of one hash over ``_HOT_BYTES`` (one passage in a large share of all
documents) are not gathered: Spark folds equal runs to rows, only the strings
of different runs become rows, whose smallest ids are combined by partial
aggregation and told to the runs again. Both ways compare bytes.

Null texts count as empty. Rows without an id keep everything and remove
nothing; rows that share an id do not remove from each other; a very long text
goes in pieces that share their borders; an empty table stays empty; other
columns are left to the caller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, likely
from .induced import common_prefixes, suffix_order

LENGTH = 50
_GRAM = 24  # at most half of the length
_BUCKET_BYTES = 6 << 20  # of runs, for each bucket
_HOT_BYTES = 10 << 20  # of runs of one hash
_SLICE = 2 << 20
_TASK_BUCKETS = 8  # about 50 MB of runs
_SEGMENT_BYTES = 64 << 20  # of text, for each segment of the hashes
_HELD = 1 << 21  # hashes that are sorted at once
_HELD_BYTES = 32 << 20  # of runs that are packed at once
_MAP_BITS = 28  # of the bitmap, at most
_COPIES = 1 << 21  # ids of copies that are broadcast, at most
_STRINGS = 1 << 16
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_PACKED = pa.schema([("bucket", pa.int64()), ("runs", pa.binary())])
_PRINTS = pa.schema([("segment", pa.int64()), ("prints", pa.binary())])


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of ``data`` (the last seven places apart) as one number."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for k in range(min(8, n)):
        part = data[k : k + (n - k + 7) // 8 * 8]
        out[k::8] = part.view("<u8")
    return out


def _mix(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(odd)
    return x ^ (x >> np.uint64(29))


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(out) - (width - size)], out[width - size :])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


def _gram(length: int) -> int:
    return min(_GRAM, length // 2)


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (8 at least) at each place of ``data``, whose last eight bytes are padding."""
    loads = _loads(data)
    n = len(data) - 8 - gram + 1
    out = loads[:n] * np.uint64(_ODD[0])
    for k, o in enumerate([*range(8, gram - 8, 8), gram - 8] if gram > 8 else []):
        out ^= out >> np.uint64(32)
        out += loads[o : o + n]
        out *= np.uint64(_ODD[k % 6 + 1])
    out ^= out >> np.uint64(31)
    out *= np.uint64(_ODD[3])
    out ^= out >> np.uint64(29)
    return out


def _runs_of(ids, keys, texts: list[bytes], bases, length: int):
    """The hash of each run of some texts, or pieces of texts that begin at ``bases``; and what tells (hashes, ids, keys, places, counts, bytes) of chosen ones."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if len(data) - 8 < length:
        return np.zeros(0, np.uint64), None
    gram = _gram(length)
    smallest = _sliding_minimum(_hashes(data, gram), length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(smallest)]
    valid = np.arange(len(smallest)) + length <= ends[owner]
    change = np.flatnonzero((smallest[1:] != smallest[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])) + 1
    starts = np.concatenate([[0], change])
    counts = np.diff(np.append(starts, len(smallest)))
    kept = valid[starts]
    starts, counts = starts[kept], counts[kept]
    prints = _mix(smallest[starts], _ODD[1])

    def chosen(which):
        s, c, o = starts[which], counts[which], owner[starts[which]]
        i, k, b = (np.array(x, np.int64) for x in (ids, keys, bases))
        return prints[which], i[o], k[o], s - begins[o] + b[o], c, data[_spread(s, c + (length - 1))]

    return prints, chosen


def _by_bucket(prints, ids, keys, places, counts, raw, length: int, buckets: int):
    """Runs by bucket."""
    bucket = (prints % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = counts + (length - 1)
    begins = np.cumsum(sizes) - sizes
    bucket = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        o = order[a:b]
        yield int(bucket[a]), ids[o], keys[o], places[o], counts[o], raw[_spread(begins[o], sizes[o])]


def _runs(ids, keys, texts: list[bytes], bases, length: int, buckets: int):
    """All runs of some texts by bucket."""
    prints, chosen = _runs_of(ids, keys, texts, bases, length)
    if len(prints):
        yield from _by_bucket(*chosen(np.arange(len(prints))), length, buckets)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of some numbers, first bytes first: higher ones, mostly equal, stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(planes: np.ndarray, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel()


class Universe:
    """How hashes of runs are shortened, cut into segments and laid on the bitmap, by the bytes of all texts."""

    def __init__(self, total: int):
        bits = lambda x: max(int(x) - 1, 1).bit_length()
        self.bits = min(44, max(24, bits(4 * total)))
        self.segment_bits = max(3, bits(-(-total // _SEGMENT_BYTES)))
        self.map_bits = min(_MAP_BITS, self.bits - 4)

    def short(self, prints: np.ndarray) -> np.ndarray:
        return prints >> np.uint64(64 - self.bits)


def _counter(length: int, universe: Universe):
    """Sorted hashes and how often each was found, by segment."""
    width = universe.bits - universe.segment_bits

    def packed(held):
        import zstandard

        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(prints, np.arange((1 << universe.segment_bits) + 1, dtype=np.uint64) << np.uint64(width))
        rows = []
        for segment, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if b > a:
                steps = np.diff(prints[a:b] & np.uint64((1 << width) - 1), prepend=np.uint64(0)).astype("<u8")
                rows.append((segment, zstandard.ZstdCompressor(level=1).compress(_planes(steps) + _planes(np.minimum(counts[a:b], 2**32 - 1).astype("<u4")))))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_PRINTS)

    def run(batches):
        held, n = [], 0
        for some in _slices(batches, length):
            prints, _ = _runs_of(*zip(*some, strict=True), length)
            held.append(universe.short(prints))
            n += len(prints)
            if n >= _HELD:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _marker(universe: Universe, most: int):
    """For a segment: its part of the bitmap, how many runs are marked, and the hashes found more than ``most`` times."""
    width = universe.bits - universe.segment_bits
    slots = 1 << (universe.map_bits - universe.segment_bits)

    def run(key, table):
        import zstandard

        prints, counts = [], []
        for blob in table.column("prints").to_pylist():
            body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
            n = len(body) // 12
            prints.append(np.cumsum(_numbers(body[: 8 * n], n, "<u8"), dtype=np.uint64))
            counts.append(_numbers(body[8 * n :], n, "<u4"))
        prints, counts = np.concatenate(prints), np.concatenate(counts)
        order = np.argsort(prints)
        prints = prints[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        prints, counts = prints[first], np.add.reduceat(counts[order], first, dtype=np.int64)
        often, hot = counts > 1, counts > most
        marks = np.zeros(slots, np.uint8)
        marks[(prints[often] >> np.uint64(universe.bits - universe.map_bits)).astype(np.int64)] = 1
        segment = key[0].as_py()
        found = (prints[hot] + (np.uint64(segment) << np.uint64(width))).astype(np.int64).tolist()
        bitmap = zstandard.ZstdCompressor(level=1).compress(np.packbits(marks).tobytes())
        return pa.table({"segment": pa.array([segment], pa.int64()), "bitmap": pa.array([bitmap], pa.binary()), "n_runs": pa.array([int(counts[often & ~hot].sum())], pa.int64()), "hot": pa.array([found], pa.list_(pa.int64()))})

    return run


class Marked:
    """The marked hashes, as workers get them: parts of the bitmap by segment, and the hot ones."""

    def __init__(self, universe: Universe, parts: dict[int, bytes], hot: list[int]):
        self.universe, self.parts, self.hot = universe, parts, hot

    def open(self):
        """What tells of hashes (as they are) whether they are marked and not hot, and whether they are hot."""
        import zstandard

        u = self.universe
        each = (1 << (u.map_bits - u.segment_bits)) // 8
        bitmap = np.zeros((1 << u.map_bits) // 8, np.uint8)
        for segment, part in self.parts.items():
            bitmap[segment * each : (segment + 1) * each] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8)
        hot = np.array(sorted(self.hot), np.uint64)

        def told(prints):
            slot = prints >> np.uint64(64 - u.map_bits)
            marked = bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8) & 1 > 0
            often = np.isin(u.short(prints), hot) if len(hot) else np.zeros(len(prints), bool)
            return marked & ~often, often

        return told


def _pack(ids, keys, places, counts, raw) -> bytes:
    """Runs (those of one document side by side) as bytes: a table of documents, and differences of places."""
    import zstandard

    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]))
    runs = np.diff(np.append(first, len(ids)))
    head = np.array([len(first), len(ids)], "<i8").tobytes()
    columns = [np.diff(ids[first], prepend=0).astype("<i8"), (keys[first] - ids[first]).astype("<i8"), np.diff(places, prepend=0).astype("<i8"), runs.astype("<i4"), counts.astype("<i4"), raw]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(c.tobytes() for c in columns))


def _unpack(blobs):
    """ids, keys, places, counts and bytes of all runs in ``blobs``."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    parts = []
    for blob in blobs:
        body, at = unpack.decompress(blob), 16
        docs, n = np.frombuffer(body, "<i8", 2)
        columns = []
        for kind, size in (("<i8", docs), ("<i8", docs), ("<i8", n), ("<i4", docs), ("<i4", n)):
            columns.append(np.frombuffer(body, kind, size, at))
            at += columns[-1].nbytes
        ids, keys, places, runs, counts = columns
        ids = np.cumsum(ids)
        parts.append([np.repeat(ids, runs), np.repeat(keys + ids, runs), np.cumsum(places), counts.astype(np.int64), np.frombuffer(body, np.uint8, offset=at)])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _strings(counts: np.ndarray, raw: np.ndarray, length: int):
    """Where each string of the runs begins, and the bytes as overlapping loads."""
    begins = np.cumsum(counts + (length - 1)) - (counts + (length - 1))
    loads = _loads(np.concatenate([raw, np.zeros(8, np.uint8)]))
    return _spread(begins, counts), loads, [*range(0, length - 8, 8), length - 8]


def _fingerprint(at, loads, offsets, seed: int) -> np.ndarray:
    out = np.full(len(at), seed, np.uint64)
    for k, o in enumerate(offsets):
        out = (out ^ _mix(loads[at + o], _ODD[(k + seed) % len(_ODD)])) * np.uint64(_ODD[(k + 3) % len(_ODD)])
        out ^= out >> np.uint64(32)
    return out


def _distinct(counts, raw, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run the first run that is seen to have the same bytes, and the first runs."""
    sizes = counts + (length - 1)
    begins = np.cumsum(sizes) - sizes
    loads = _loads(np.concatenate([raw, np.zeros(8, np.uint8)]))
    offsets = [*range(0, length - 8, 8), length - 8]
    prints = _fingerprint(begins, loads, offsets, 1) ^ _mix(_fingerprint(begins + counts - 1, loads, offsets, 2) + counts.astype(np.uint64), _ODD[4])
    order = np.argsort(prints, kind="stable")
    same = (prints[order][1:] == prints[order][:-1]) & (counts[order][1:] == counts[order][:-1])
    active, k = np.flatnonzero(same), 0
    while len(active):  # equal prints: compare the bytes, eight at a time, the last eight as they end
        x, y = order[active], order[active + 1]
        at = np.minimum(k, sizes[x] - 8)
        equal = loads[begins[x] + at] == loads[begins[y] + at]
        same[active[~equal]] = False
        active = active[equal & (k < sizes[x] - 8)]
        k += 8
    group = np.concatenate([[0], np.cumsum(~same)])
    heads = order[np.concatenate([[True], ~same])]
    first = np.empty(len(counts), np.int64)
    first[order] = group
    return first, heads


def _covered(ids, counts, raw, length: int):
    """Run and number of each string that also stands under a smaller id.

    Equal runs are folded to one with the smallest of their ids. Fingerprints
    leave the runs that share a string with another one; the suffixes of these
    are ordered by induced sorting, neighbours that share ``length`` bytes are
    equal strings, and the smallest id of each group decides."""
    first, heads = _distinct(counts, raw, length)
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, first, ids)
    sizes = counts + (length - 1)
    begins = np.cumsum(sizes) - sizes
    h_counts = counts[heads]
    h_raw = raw[_spread(begins[heads], sizes[heads])]
    h_base = np.cumsum(h_counts) - h_counts
    lowest = np.repeat(least, h_counts)  # for each string of the folded runs
    prints = _fingerprint(*_strings(h_counts, h_raw, length), 1)
    order = np.argsort(prints)
    prints = prints[order]
    same = prints[1:] == prints[:-1]
    repeated = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    del prints, order, same
    chosen = np.unique(np.searchsorted(np.cumsum(h_counts), repeated, "right"))
    if len(chosen):
        h_sizes = h_counts + (length - 1)
        h_begins = np.cumsum(h_sizes) - h_sizes
        data = h_raw[_spread(h_begins[chosen], h_sizes[chosen])]
        place = np.full(len(data), -1, np.int64)  # the string that starts here
        place[_spread(np.cumsum(h_sizes[chosen]) - h_sizes[chosen], h_counts[chosen])] = _spread(h_base[chosen], h_counts[chosen])
        suffixes = suffix_order(data)
        suffixes = suffixes[place[suffixes] >= 0]
        groups = np.concatenate([[0], np.flatnonzero(common_prefixes(data, suffixes, length) < length) + 1])
        strings = place[suffixes]
        lowest[strings] = np.repeat(np.minimum.reduceat(lowest[strings], groups), np.diff(np.append(groups, len(strings))))
    # Only runs whose strings can stand under a smaller id are looked at string by string.
    bounds = np.minimum.reduceat(lowest, h_base)
    maybe = np.flatnonzero(ids > bounds[first])
    at = _spread(h_base[first[maybe]], counts[maybe]) if len(maybe) else maybe
    run = np.repeat(maybe, counts[maybe])
    late = ids[run] > lowest[at]
    number = _spread(np.zeros(len(maybe), np.int64), counts[maybe]) if len(maybe) else maybe
    return run[late], number[late]


def _spans(keys: np.ndarray, places: np.ndarray, length: int):
    """(key, begin, end) of the maximal runs of bytes that the strings at ``places`` cover."""
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (places[1:] > places[:-1] + length)])
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(keys)) - 1
    return keys[starts], places[starts], places[last] + length


def _slices(batches, length: int):
    """Lists of (id, key, bytes, base) of about ``_SLICE`` bytes; a long text goes in pieces, each string in one of them."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for i, k, text in zip(*batch.columns, strict=True):
            i, k, text = i.as_py(), k.as_py(), text.as_py()
            for base in range(0, max(len(text) - length + 1, 0), _SLICE):
                piece = text[base : base + _SLICE + length - 1]
                held.append((i, k, piece, base))
                size += len(piece)
                if size >= _SLICE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _packer(length: int, buckets: int, marked, hot: bool = False):
    """Marked runs by bucket, or those of hot hashes."""

    def packed(held):
        parts = [np.concatenate(x) for x in zip(*held, strict=True)]
        rows = [(b, _pack(*x)) for b, *x in _by_bucket(*parts, length, buckets)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_PACKED)

    def run(batches):
        told = marked.value.open()
        held, size = [], 0
        for some in _slices(batches, length):
            prints, chosen = _runs_of(*zip(*some, strict=True), length)
            which = np.flatnonzero(told(prints)[int(hot)])
            if len(which):
                held.append(chosen(which))
                size += len(held[-1][-1])
            if size >= _HELD_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _span_table(keys, begins, ends) -> pa.Table:
    return pa.table({"key": pa.array(keys, pa.int64()), "begin": pa.array(begins, pa.int64()), "end": pa.array(ends, pa.int64())})


def _of_bucket(length: int):
    def run(key, table):
        ids, keys, places, counts, raw = _unpack(table.column("runs").to_pylist())
        r, number = _covered(ids, counts, raw, length)
        if not len(r):
            return _span_table([], [], [])
        return _span_table(*_spans(keys[r], places[r] + number, length))

    return run


def _run_rows(length: int):
    """Packed runs as rows."""
    kind = pa.schema([("run", pa.binary()), ("id", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids, keys, places, counts, raw = _unpack([blob])
                edges = np.concatenate([[0], np.cumsum(counts + (length - 1))]).astype(np.int32)
                for k in range(0, len(ids), _STRINGS):
                    part = slice(k, k + _STRINGS)
                    own = edges[k : k + _STRINGS + 1]
                    runs = pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer(np.ascontiguousarray(own - own[0])), pa.py_buffer(np.ascontiguousarray(raw[own[0] : own[-1]]))])
                    yield pa.RecordBatch.from_arrays([runs, pa.array(ids[part]), pa.array(keys[part]), pa.array(places[part])], schema=kind)

    return run


def _string_rows(length: int):
    """The strings of runs (no, least, run) as rows."""
    kind = pa.schema([("string", pa.binary()), ("no", pa.int64()), ("at", pa.int64()), ("least", pa.int64())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _STRINGS >> 4):
                some = batch.slice(k, _STRINGS >> 4)
                no, least = (some.column(c).to_numpy() for c in (0, 1))
                runs = some.column(2).to_pylist()
                counts = np.array([len(r) - (length - 1) for r in runs], np.int64)
                raw = np.frombuffer(b"".join(runs), np.uint8)
                begins, _, _ = _strings(counts, raw, length)
                strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(begins), [None, pa.py_buffer(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, length)[begins]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([strings, pa.array(np.repeat(no, counts)), pa.array(_spread(np.zeros(len(counts), np.int64), counts)), pa.array(np.repeat(least, counts))], schema=kind)

    return run


def _hot_spans(runs: DataFrame, length: int) -> DataFrame:
    """Spans of runs (run, id, key, place): strings are rows for each different run, not for each time that it is found."""
    different = cut(runs.groupBy("run").agg(F.min("id").alias("least"), F.max("id").alias("most")).withColumn("no", F.monotonically_increasing_id()))
    strings = different.select("no", "least", "run").mapInArrow(_string_rows(length), "string binary, no bigint, at bigint, least bigint")
    lowest = strings.groupBy("string").agg(F.min("least").alias("lowest"))
    told = strings.join(lowest, "string").select("no", "at", "lowest").groupBy("no").agg(F.collect_list(F.struct("at", "lowest")).alias("strings"))
    known = different.join(told, "no").select("run", F.expr("filter(strings, x -> x.lowest < most)").alias("strings")).where(F.size("strings") > 0)
    late = runs.join(known, "run").select("key", F.explode(F.expr("transform(filter(strings, x -> x.lowest < id), x -> place + x.at)")).alias("place"))
    return late.mapInArrow(_joined_spans(length), "key bigint, begin bigint, end bigint")


def _joined_spans(length: int):
    kind = pa.schema([("key", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _spans(*(c.to_numpy() for c in batch.columns), length)], schema=kind)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, buckets: int | None = None, hot_bytes: int = _HOT_BYTES) -> DataFrame:
    """(key, begin, end) over docs (id, key, raw): byte ranges, perhaps overlapping, that strings from smaller ids cover."""
    if length < 16:
        raise ValueError("strings of 16 bytes or more are needed")
    spark = docs.sparkSession
    plain = docs.where("id is not null").select("id", "key", "raw")
    universe = Universe(plain.agg(F.sum(F.octet_length("raw"))).head()[0] or 0)
    mean = length - 1 + (length - _gram(length) + 2) // 2
    prints = plain.mapInArrow(_counter(length, universe), "segment bigint, prints binary")
    segments = prints.repartition(1 << universe.segment_bits, "segment").groupBy("segment").applyInArrow(_marker(universe, max(1, hot_bytes // mean)), "segment bigint, bitmap binary, n_runs bigint, hot array<bigint>").collect()
    hot = [x for r in segments for x in r["hot"]]
    if buckets is None:
        buckets = max(8, -(-sum(r["n_runs"] for r in segments) * mean // _BUCKET_BYTES))
    marked = spark.sparkContext.broadcast(Marked(universe, {r["segment"]: bytes(r["bitmap"]) for r in segments}, hot))
    packed = plain.mapInArrow(_packer(length, buckets, marked), "bucket bigint, runs binary")
    # As many tasks as the buckets need, however many the corpus has.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // _TASK_BUCKETS))
    spans = packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_of_bucket(length), "key bigint, begin bigint, end bigint")
    if hot:
        repeated = cut(plain.mapInArrow(_packer(length, 1, marked, hot=True), "bucket bigint, runs binary").select("runs"))
        runs = repeated.mapInArrow(_run_rows(length), "run binary, id bigint, key bigint, place bigint")
        spans = spans.unionByName(_hot_spans(runs, length))
    return spans


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """Keys of texts that are equal to one with a smaller id, which tells them whole; at most about ``_COPIES`` of them, as the others are told by their strings."""
    digest = F.substring(F.unhex(F.sha2("raw", 256)), 1, 16)
    texts = rows.where(F.col("id").isNotNull() & (F.octet_length("raw") >= length)).select(F.col("id").cast("long").alias("id"), "key", digest.alias("digest"))
    least = texts.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    found = cut(texts.join(least, "digest").where("id > least").select("key").distinct())
    return found.where(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-found.count() // _COPIES)))) == 0)


def _kept(raw: bytes, begins, ends):
    """Merged spans, and the bytes outside them."""
    merged: list[list[int]] = []
    for b, e in sorted(zip(begins or [], ends or [], strict=True)):
        if merged and b <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([b, e])
    out, at = [], 0
    for b, e in merged:
        out.append(raw[at:b])
        at = e
    return merged, b"".join(out) + raw[at:]


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """For each row: id, n_bytes, spans (maximal removed byte ranges) and kept (the remaining bytes)."""
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), raw.alias("raw"))
    # Where no id has two texts, the id tells a text; else its hash does, which no packing can shorten.
    text_key = F.xxhash64("id", "raw")
    shared = rows.where("id is not null").groupBy("id").agg(F.min(text_key).alias("a"), F.max(text_key).alias("b")).where("a <> b")
    rows = rows.withColumn("key", F.col("id").cast("long") if shared.isEmpty() else text_key)
    copies = _copies(rows, length)
    rows = rows.join(F.broadcast(copies.withColumn("copy", F.lit(True))), "key", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    spans = cut(repeated_spans(rows.where("not copy"), length, **how).groupBy("key").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")))
    kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    @F.arrow_udf("struct<n_bytes:bigint,spans:array<struct<begin:bigint,end:bigint>>,kept:binary>")
    def apply(raws: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for r, b, e in zip(raws.to_pylist(), begins.to_pylist(), ends.to_pylist(), strict=True):
            merged, kept = _kept(r, b, e)
            out.append({"n_bytes": len(r), "spans": [{"begin": x, "end": y} for x, y in merged], "kept": kept})
        return pa.array(out, kind)

    # Documents that surely lose nothing, and copies, which lose everything, are not dealt.
    marked = likely(rows, F.col("key"), spans.select("key"), flag="marked")
    applied = marked.where("marked and not copy").join(spans, "key", "left").withColumn("x", apply("raw", "begins", "ends")).select("id", "x.n_bytes", "x.spans", "x.kept")
    size = F.octet_length("raw").cast("long")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("begin"), size.alias("end")))
    whole = marked.where("copy or not marked").select("id", size.alias("n_bytes"), F.when(F.col("copy"), all_of_it).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"), F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("raw")).alias("kept"))
    return applied.unionByName(whole).withColumnRenamed("id", id_column)


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
