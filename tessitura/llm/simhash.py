"""SimHash near-duplicates: fingerprints linked through pigeonhole blocks.

A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are ``width``
consecutive words joined by spaces, repeats included (fewer words: the whole
sequence; none: fingerprint zero, linked like any other). A bit is 1 if it is
set in over half of the shingles' XXH64 (seed 42).

Fingerprints that differ in at most ``distance`` bits share at least
``blocks - distance`` of ``blocks`` bit blocks. Each distinct fingerprint is
therefore dealt once for every choice of that many blocks, fingerprints that
share all chosen blocks meet, and their Hamming distance is verified. Equal
fingerprints are folded to one row before that. A bucket yields a spanning
forest of its links, one edge for each fingerprint at most, never all pairs. A
bucket with more distinct fingerprints than one task should compare is dealt
out again in pairs of chunks, each to a group of its own. Components are found
by star steps in Spark, so nothing is collected.

``words`` adds fingerprints from the same hashes, mixed anew. They are no
blocks, but a link must hold for all words together too (``most``), so texts
that agree in one word by chance are told apart.

Null texts have no words; a null id stays null and takes the smallest id
reachable; an empty table gives an empty table; repeated rows and ties share
a fingerprint and so a component; other columns are left to the caller.
"""

from __future__ import annotations

import re
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, release
from .components import components

WIDTH, DISTANCE, BLOCKS = 3, 3, 6
#: Near-duplicates by five words: the first of three fingerprint words may differ in 6 bits, all three in 32 of 192.
#: Shingle sets with a similarity of 0.8 differ in 29 of 192 bits on average.
NEAR = {"width": 5, "distance": 6, "blocks": 9, "words": 3, "most": 32}
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_WORDS = 1 << 16
_HELD = 1 << 15
_ODD = 0x9E3779B97F4A7C15


def _votes(shingles, words: int) -> tuple[np.ndarray, int]:
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    votes = []
    for k in range(words):
        bits = hashes
        if k:  # further words come from the same hash, mixed anew
            bits = (bits ^ bits >> np.uint64(29)) * np.uint64(_ODD * (2 * k + 1) & (1 << 64) - 1)
            bits = (bits ^ bits >> np.uint64(32)) * np.uint64(_ODD)
            bits ^= bits >> np.uint64(31)
        votes.append(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64))
    return np.concatenate(votes), len(hashes)


def fingerprint(text: str | None, width: int = WIDTH, words: int = 1) -> np.ndarray:
    """The fingerprint as ``words`` unsigned integers; long texts are voted in parts."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    votes, n, kept = np.zeros(64 * words, np.int64), 0, []
    for m in _batches(data):
        found = kept + m
        if len(found) >= width:
            v, k = _votes(map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False)), words)
            votes, n = votes + v, n + k
        kept = found[len(found) - width + 1 :] if len(found) >= width else found
    if not n:
        if not kept:
            return np.zeros(words, np.uint64)
        votes, n = _votes([b" ".join(kept)], words)
    return np.packbits(2 * votes > n, bitorder="little").view(np.uint64)


def _batches(data: bytes):
    if len(data) < 1 << 20:
        yield _WORD.findall(data)
        return
    batch = []
    for m in _WORD.finditer(data):
        batch.append(m.group())
        if len(batch) == _WORDS:
            yield batch
            batch = []
    yield batch


def fingerprints(text: Column, width: int = WIDTH, words: int = 1) -> Column:
    """The fingerprint as an array of (signed) longs."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        values = [fingerprint(x.as_py(), width, words) for x in texts]
        flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
        release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * words, pa.int32()), pa.array(flat))

    return run(text)


def digits(print_: Column, words: int = 1) -> Column:
    """A fingerprint as 16 lower-case hex digits a word."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.get(print_, F.lit(k))), 16, "0") for k in range(words)]))


def masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Signed 64-bit masks: every choice of ``blocks - distance`` of the blocks."""
    if not distance < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    single = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    found = [sum(single[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _forest(prints: np.ndarray, distance: int, most: int | None) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket: pairs of rows of ``prints`` (a column for each word)."""
    left, edges, queue = np.arange(len(prints)), [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        near = np.bitwise_count(prints[left, 0] ^ prints[x, 0]) <= distance
        if most is not None and near.any():
            near[near] = np.bitwise_count(prints[left[near]] ^ prints[x]).sum(1) <= most
        if near.any():
            found = left[near]
            left = left[~near]
            edges += [(x, y) for y in found]
            queue += list(found)
    return edges


def _bucket_links(distance: int, most: int | None, keys: int, held_rows: int | None):
    """Rows (keys, node, words) sorted by their first ``keys`` columns to links (a, b) of nodes; a bucket of over ``held_rows`` rows gives one row with its first keys and no link."""

    def batch(nodes, edges, hot):
        e = np.array(edges, np.int64).reshape(-1, 2)
        none = [None] * len(hot)
        a, b = (nodes[e[:, k]].tolist() + none for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(e) + [k[0] for k in hot], pa.int32()), pa.array([None] * len(e) + [k[1] for k in hot], pa.int64())],
            names=["a", "b", "choice", "part"],
        )

    def equal(columns, key):
        out = np.ones(len(columns[0]), bool)
        for c, k in zip(columns, key, strict=False):
            out &= c == k
        return out

    def done(columns):
        change = np.zeros(len(columns[0]), bool)
        change[0] = True
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(change))
        prints = np.stack(columns[keys + 1 :], 1).view(np.uint64)
        edges = []
        for k in np.flatnonzero(ends - starts > 1):
            edges += [(starts[k] + x, starts[k] + y) for x, y in _forest(prints[starts[k] : ends[k]], distance, most)]
        return batch(columns[keys], edges, [])

    def links(batches):
        parts: list[list[np.ndarray]] = []  # the rows of the open bucket
        now = too_large = None
        for arrow in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in arrow.columns]
            if too_large is not None and len(new[0]):
                other = ~equal(new, too_large)
                new, too_large = [c[other] for c in new], None if other.any() else too_large
            if not len(new[0]):
                continue
            key = tuple(c[-1] for c in new[:keys])
            open_ = equal(new, key)
            if open_.all() and now in (None, key):
                parts.append(new)
            else:
                columns = [np.concatenate(x) for x in zip(*parts, new, strict=True)]
                open_ = equal(columns, key)
                yield done([c[~open_] for c in columns])
                parts = [[c[open_] for c in columns]]
            now = key
            if held_rows is not None and sum(len(x[0]) for x in parts) > held_rows:
                yield batch(np.zeros(0, np.int64), [], [tuple(int(x) for x in key)])
                parts, now, too_large = [], None, key
        if parts:
            yield done([np.concatenate(x) for x in zip(*parts, strict=True)])

    return links


def links(prints: DataFrame, column: str = "fingerprint", node: str | None = None, distance: int = DISTANCE, blocks: int = BLOCKS, words: int = 1, most: int | None = None, held_rows: int = _HELD) -> DataFrame:
    """Edges (a, b) between the nodes (longs; the first word if no column is named) of distinct fingerprints that connect whatever
    is linked: at most ``distance`` bits of the first word differ and, if ``most`` is given, at most that many of all words.

    Buckets of over ``held_rows`` fingerprints are dealt out once more, as pairs of chunks."""
    names = ["node", *[f"w{k}" for k in range(words)]]
    own = [F.get(F.col(column), F.lit(k)) for k in range(words)]
    distinct = prints.where(F.col(column).isNotNull()).select((own[0] if node is None else F.col(node)).alias("node"), *[w.alias(f"w{k}") for k, w in enumerate(own)]).distinct()
    if distance == 0 and most is None:
        return distinct.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    choices = F.array(*[F.struct(F.lit(k).cast("int").alias("choice"), F.col("w0").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks(distance, blocks))])
    dealt = distinct.select(F.explode(choices).alias("c"), *names).select("c.choice", "c.part", *names)
    kind, key = "a bigint, b bigint, choice int, part bigint", ["choice", "part"]
    found = cut(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_bucket_links(distance, most, 2, held_rows), kind))
    hot = found.where("a is null").select(*key)
    edges = found.where("a is not null").select("a", "b")
    if not hot.isEmpty():
        rows = cut(dealt.join(hot, key))
        chunks = rows.groupBy(*key).agg(F.ceil(F.count("*") * 2 / held_rows).cast("int").alias("chunks"))
        own_chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        paired = rows.join(chunks, key).withColumn("own", own_chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        pairs = paired.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *names)
        key = [*key, "i", "j"]
        edges = edges.union(pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(_bucket_links(distance, most, 4, None), kind).select("a", "b"))
    return edges.distinct()


def _noded(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (print) with ``node``: a long for each distinct fingerprint, its word or a hash of its words without collisions."""
    if words == 1:
        return rows.withColumn("node", F.get("print", F.lit(0)))
    seed = 0
    while True:
        noded = rows.withColumn("node", F.xxhash64(F.lit(seed), "print"))
        clash = noded.select("node", F.xxhash64("print", F.lit(1)).alias("h")).groupBy("node").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
        if clash.isEmpty():
            return noded
        seed += 1


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, distance: int = DISTANCE, blocks: int = BLOCKS, words: int = 1, most: int | None = None) -> DataFrame:
    """For each row: id, fingerprint (16 hex digits a word) and component_id (the smallest id reachable, itself included)."""
    rows = cut(docs.select(F.col(f"`{id_column}`").alias("id"), fingerprints(F.col(f"`{text}`"), width, words).alias("print")))
    rows = _noded(rows, words)
    firsts = rows.groupBy("node").agg(F.min("id").alias("first"))
    rooted = components(links(rows, "print", "node", distance, blocks, words, most))
    firsts = firsts.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = firsts.join(lowest, "root").select("node", "component_id")
    return rows.join(of_node, "node").select(F.col("id").alias(id_column), digits(F.col("print"), words).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component: the row with the smallest id (of rows with that id, one). Rows without an id stay. The columns of ``docs``."""
    component = free_name(docs.columns, "component")
    found = near_duplicates(docs, id_column, text, **how).where(F.col(id_column).isNotNull())
    kept = found.where(F.col(id_column) == F.col("component_id")).select(F.col(id_column).alias(component)).distinct()
    identified = docs.where(F.col(f"`{id_column}`").isNotNull()).join(kept, F.col(f"`{id_column}`") == F.col(component), "left_semi")
    once = identified.dropDuplicates([id_column])
    return once.unionByName(docs.where(F.col(f"`{id_column}`").isNull()))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
