"""Benchmark decontamination: token windows of training texts looked up in a broadcast hash set of test n-grams.

Both sides are normalised alike: A-Z is lower-cased and words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every ``width`` consecutive words of a
benchmark item form a window; an item of fewer words (but not none) is one
window. A document word inside any occurrence of a window is hit.

The benchmark is measured first. Up to ``block_bytes`` its windows are
broadcast as sorted 64-bit hashes; a larger one is dealt into blocks of about
that size and the documents are scanned once for each block, with what was
found kept in the shared folder, so one block at a time is broadcast; an item of
over half a block goes in pieces that share their borders. A hash that is found is verified word by word.
The scan is narrow: nothing is shuffled, and hot sources, copies and common
passages cost what other rows cost.

Null texts have no words; null items have no windows; an empty table on either
side gives no hits; repeated rows are scanned independently; equal items are
all reported; other columns pass through.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, free_name, release

WIDTH = 10
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_CHUNK = 1 << 20
_BATCH = 1 << 17
_MIX = 0x9E3779B97F4A7C15
_HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,words:array<struct<begin:bigint,end:bigint>>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("words", _SPANS)])


def _chunks(data: bytes):
    """(begin, end) of parts of ``data`` that cut no word."""
    at = 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        if end < len(data):
            inside = _WORD.match(data, end)
            end = inside.end() if inside else end
        yield at, end
        at = end


def _normal(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _hashes_of(spans: np.ndarray) -> np.ndarray:
    """A hash of each row of ids."""
    out = np.zeros(len(spans), np.uint64)
    for k in range(spans.shape[1]):
        out *= np.uint64(_MIX)
        out += spans[:, k].astype(np.uint64) + np.uint64(1)
    return out ^ (out >> np.uint64(29))


class Windows:
    """The windows of some benchmark items: sorted hashes for each width, and where they stand in ``flat``."""

    def __init__(self, items, width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        flat, places = [], {}
        at = 0
        for name, text in items:
            words = _WORD.findall(_normal(text))
            if not words:
                continue
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), np.int64, len(words))
            size = min(width, len(ids))
            starts = np.arange(len(ids) - size + 1) + at
            places.setdefault(size, []).append(np.stack([starts, np.full(len(starts), len(self.names))]))
            self.names.append("" if name is None else str(name))
            flat.append(ids)
            at += len(ids)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.by_width = {}
        for size, parts in places.items():
            starts, owners = np.concatenate(parts, axis=1)
            hashes = _hashes_of(self.flat[starts[:, None] + np.arange(size)])
            order = np.argsort(hashes, kind="stable")
            self.by_width[size] = hashes[order], starts[order], owners[order]

    def ids(self, data: bytes) -> np.ndarray:
        """The words of normalised ``data`` as ids, -1 where the benchmark lacks the word."""
        parts = []
        for begin, end in _chunks(data):
            words = _WORD.findall(data, begin, end)
            parts.append(np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words)))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the names of the items found."""
        hit, found = np.zeros(len(ids) + 1, np.int64), set()
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for size in self.by_width:
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            for k in range(0, len(at), _BATCH):
                self._look(ids, at[k : k + _BATCH], size, hit, found)
        return np.cumsum(hit[:-1]) > 0, found

    def _look(self, ids, at, size, hit, found) -> None:
        """Marks in ``hit`` and ``found`` the windows of ``size`` words that begin at ``at``."""
        hashes, starts, owners = self.by_width[size]
        spans = ids[at[:, None] + np.arange(size)]
        own = _hashes_of(spans)
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        for j in np.flatnonzero(high > low):
            match = False
            for k in range(low[j], high[j]):
                if np.array_equal(self.flat[starts[k] : starts[k] + size], spans[j]):
                    match = True
                    found.add(self.names[owners[k]])
            if match:
                hit[at[j]] += 1
                hit[at[j] + size] -= 1


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _merged(old: dict, new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans = sorted([(x["begin"], x["end"]) for x in old["words"]] + new)
    out: list[list[int]] = []
    for b, e in spans:
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def _scanner(shared, first: bool):
    @F.arrow_udf(_HITS)
    def scan(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        windows = shared.value
        rows = []
        for text, old in zip(texts, earlier, strict=True):
            ids = windows.ids(_normal(text.as_py()))
            mask, found = windows.find(ids)
            runs = _runs(mask) if found else []
            if not first:
                old = old.as_py()
                runs, found = _merged(old, runs), found | set(old["items"])
            rows.append({"n_words": len(ids), "n_hit": sum(e - b for b, e in runs), "items": sorted(found), "words": [{"begin": b, "end": e} for b, e in runs]})
        release()
        return pa.array(rows, _ARROW)

    return scan.asNondeterministic()  # else a condition on the hits scans the texts once more


def _in_pieces(items: DataFrame, width: int, most: int) -> DataFrame:
    """``items`` (id, text), those of over ``most`` bytes in pieces that share ``width`` - 1 words, so that each window stands in one whole."""
    words = F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    size = max(1, most // 16)
    cut_ = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - (width - 1)) / size).cast("int") - 1)), lambda i: F.array_join(F.slice("w", i * size + 1, size + width - 1), " "))
    large = F.octet_length("text") > most
    dealt = items.where(large).select("id", words.alias("w")).select("id", F.explode(cut_).alias("text"))
    return items.where(~large | F.col("text").isNull()).unionByName(dealt)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "hits", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, items (ids as sorted strings) and words (hit word ranges, end excluded)."""
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}; name another")
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    items = _in_pieces(items, width, block_bytes // 2)
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)) + 16)).head()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    empty = F.lit(None).cast(_HITS)
    for k in range(blocks):
        rows = dealt.where(F.col("block") == k).select("id", "text").toArrow()
        shared = spark.sparkContext.broadcast(Windows(zip(rows["id"].to_pylist(), rows["text"].to_pylist(), strict=True), width))
        docs = docs.withColumn(into, _scanner(shared, k == 0)(F.col(f"`{text}`"), F.col(into) if k else empty))
        if k < blocks - 1:  # one block at a time is held by the driver and the executors
            docs = cut(docs)
            shared.destroy()
    return docs


@F.arrow_udf(StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the hit words and what stands between hit words."""
    out = []
    for text, found in zip(texts, spans, strict=True):
        text, found = text.as_py(), found.as_py()
        if not found:
            out.append(text)
            continue
        raw, data = text.encode("utf-8", "surrogatepass"), _normal(text)
        places = [m.span() for m in _WORD.finditer(data)]
        kept, at = [], 0
        for s in found:
            kept.append(raw[at : places[s["begin"]][0]])
            at = places[s["end"] - 1][1]
        out.append((b"".join(kept) + raw[at:]).decode("utf-8", "surrogatepass"))
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **how) -> DataFrame:
    """``docs`` without hit spans (``remove='spans'``) or without the documents that hold any (``remove='documents'``); the columns of ``docs``."""
    into = free_name(docs.columns, "hits")
    found = scan(docs, benchmark, text=text, into=into, **how)
    if remove == "documents":
        return found.where(F.col(into)["n_hit"] == 0).drop(into)
    if remove != "spans":
        raise ValueError("remove is 'spans' or 'documents'")
    clean = F.when(F.col(into)["n_hit"] == 0, F.col(f"`{text}`")).otherwise(_without(F.col(f"`{text}`"), F.col(into)["words"]))
    return found.withColumn(text, clean).drop(into)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = F.col("hits")
    return scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), (hits["n_hit"] > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i+n-1], ' ') AS g
  FROM (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, n, i, array_to_string(words[i:i+n-1], ' ') AS g
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)
), hits AS (
  SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g
), w AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (rid) LEFT JOIN t USING (rid)
"""
