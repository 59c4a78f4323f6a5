"""Sharding by minimax contiguous partition of ordered atomic groups.

Equal texts form one atomic group. Groups are ordered by the SHA-256 of the
text, and the ordered list is cut into ``shards`` runs whose largest byte size
is as small as any contiguous cut allows: the smallest feasible capacity is
found by binary search, each capacity checked greedily.

The list of groups stays distributed. The driver sees sums over prefixes of
the hash (4096 at first, then 16 children for each prefix that is opened, at
most ``_MOST_OPENED`` of them at a time), which bound the answer from both sides: cuts at known places give a capacity that is
feasible, cuts anywhere inside a prefix give one that none can beat. Prefixes
in which a cut could still move are opened further, until both capacities
meet; what is collected is bounded by shards and depth, not by rows.

A hot group is summed by partial aggregation first and never gathered: its
rows reach their shard by comparing hashes, and slots are numbered in many
small buckets of each shard.

Null texts count as empty ones; a group larger than the capacity of its
neighbours stays whole; with fewer groups than shards some shards stay empty;
an empty table gives an empty table; repeated rows get slots of their own;
other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, free_name

SHARDS = 16
_FIRST = 3  # hex digits of the first prefixes; further ones are opened digit by digit
_MOST_OPENED = 256
_SLOT_ROWS = 10_000


@dataclass(frozen=True)
class Segment:
    """Consecutive groups whose hashes begin with ``prefix``."""

    prefix: str
    size: int
    groups: int
    largest: int


def _ends(segments, capacity: int, shards: int, loose: bool) -> list[int] | None:
    """Greedy: where each shard ends, in bytes; None if ``shards`` do not suffice.

    loose: a segment of several groups may be cut anywhere."""
    ends, used, at = [], 0, 0
    for s in segments:
        rest = s.size
        while used + rest > capacity:
            if loose and s.groups > 1:
                if s.largest > capacity:
                    return None
                at += capacity - used
                rest -= capacity - used
            elif used == 0:
                return None
            ends.append(at)
            used = 0
            if len(ends) == shards:
                return None
        used += rest
        at += rest
    return [*ends, at]


def _smallest(segments, shards: int, loose: bool) -> int:
    total = sum(s.size for s in segments)
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if _ends(segments, middle, shards, loose) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _children(groups: DataFrame, depth: int, opened: list[str] | None) -> list[Segment]:
    if opened is not None:
        groups = groups.where(F.substring("digest", 1, depth - 1).isin(opened))
    rows = groups.groupBy(F.substring("digest", 1, depth).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("largest")).collect()
    return sorted((Segment(r["prefix"], r["size"], r["groups"], r["largest"]) for r in rows), key=lambda s: s.prefix)


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """The smallest capacity, and the digest prefix at which each shard after the first begins.

    groups: columns digest (hex, distinct) and size."""
    segments = _children(groups, _FIRST, None)
    if not segments:
        return 0, []
    while True:
        capacity, bound = _smallest(segments, shards, False), _smallest(segments, shards, True)
        if capacity == bound or all(s.groups == 1 for s in segments):
            break
        # Where the j-th cut can lie for any capacity between the two, and what stands there unopened. The largest are
        # opened first, whatever their depth: they hold the two capacities apart.
        early, late = _ends(segments, bound, shards, True), _ends(segments, capacity, shards, True)
        zones = [(j + 1) * (capacity - bound) for j in range(shards)]
        places, opened, at = [(a - z, b + z) for a, b, z in zip(early, [*late, *late[-1:] * len(early)], zones, strict=False)], [], 0
        for s in segments:
            if s.groups > 1 and any(at < b and at + s.size > a for a, b in places):
                opened.append(s)
            at += s.size
        opened = sorted(opened or [s for s in segments if s.groups > 1], key=lambda s: (-s.size, s.prefix))[:_MOST_OPENED]
        depth = len(opened[0].prefix)
        chosen = {s.prefix for s in opened if len(s.prefix) == depth}
        segments = sorted([s for s in segments if s.prefix not in chosen] + _children(groups, depth + 1, sorted(chosen)), key=lambda s: s.prefix)
    return capacity, _balanced(segments, capacity, shards)


def _balanced(segments, capacity: int, shards: int) -> list[str]:
    """Cuts within ``capacity``, each as near to an equal share of the rest as the capacity allows."""
    sizes = [s.size for s in segments]
    before = [0]
    for x in sizes:
        before.append(before[-1] + x)
    last = [len(sizes)]  # last[k]: the first segment from which k shards still suffice
    for _ in range(shards):
        i = last[-1]
        while i > 0 and before[last[-1]] - before[i - 1] <= capacity:
            i -= 1
        last.append(i)
    starts, at = [], 0
    for k in range(shards - 1, 0, -1):
        goal = before[at] + (before[-1] - before[at]) / (k + 1)
        choices = [i for i in range(max(at, last[k]), len(sizes) + 1) if before[i] - before[at] <= capacity]
        at = min(choices, key=lambda i: (abs(before[i] - goal), i))
        starts.append(segments[at].prefix if at < len(sizes) else "g")  # "g": beyond every digest
    return starts


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def shard(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` without the text, with size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    taken = [free_name(rest, n) for n in ("size", "text_crc32", "shard", "slot")]
    n_size, n_crc, n_shard, n_slot = taken
    digest, bucket, offset = (free_name([*rest, *taken], n) for n in ("digest", "bucket", "offset"))
    rows = cut(docs.select(*[F.col(f"`{c}`") for c in rest], (F.octet_length(value).cast("long") + 1).alias(n_size), F.crc32(value).alias(n_crc), digest_of(F.col(f"`{text}`")).alias(digest)))
    groups = cut(rows.groupBy(F.col(digest).alias("digest")).agg(F.sum(n_size).alias("size"), F.count("*").alias("rows")))
    n_rows = groups.agg(F.sum("rows")).head()[0] or 0
    _, starts = minimax_cuts(groups, shards)
    place = F.lit(0)
    for s in starts:
        place = place + (F.col(digest) >= F.lit(s)).cast("int")
    buckets = max(1, -(-n_rows // (shards * _SLOT_ROWS)))
    placed = rows.withColumn(n_shard, place).withColumn(bucket, F.pmod(F.xxhash64(id_column, digest), F.lit(buckets)))
    # shards x buckets rows: about a row for each 10,000 documents.
    counts = placed.groupBy(n_shard, bucket).agg(F.count("*").alias("n"))
    offsets = counts.select(n_shard, bucket, (F.sum("n").over(W.partitionBy(n_shard).orderBy(bucket)) - F.col("n")).alias(offset))
    number = F.row_number().over(W.partitionBy(n_shard, bucket).orderBy(id_column, digest))
    numbered = placed.withColumn(n_slot, number.cast("long") - 1)
    joined = numbered.join(offsets, [n_shard, bucket])
    return joined.select(*[F.col(f"`{c}`") for c in rest], n_size, n_crc, n_shard, (F.col(n_slot) + F.col(offset)).alias(n_slot))


def op5_minimax_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
