"""Each operator against a brute-force version on a small table with nulls, copies, empty and long texts."""

import base64
import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessitura.llm import components, decontaminate, induced, line_dedup, pieces, quality, sharding, simhash, substrings, surrogates, warc, wrappers
from tessitura.llm.common import likely

from . import fixtures

WS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.table(spark).cache()


ROWS = fixtures.texts()


# --- 9 quality rules


def test_quality_metrics(spark, docs):
    for r in quality.assess(docs).collect():
        words, q = WS.findall(r["text"] or ""), r["quality"]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in (r["text"] or "").split("\n") if WS.search(x)]
        assert (q["n_words"], q["word_chars"], q["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeated))
        assert q["n_dup_lines"] == len(lines) - len(set(lines))
        assert q["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (q["base_failed"] and q["kept"])


def test_quality_verdicts(spark):
    good = "the cat and the dog of a house sat by it in that old way"
    rows = [(1, good, "", "", 0), (2, " ".join(w + "###" for w in good.split()), "", "", 0), (3, "too short", "", "", 0), (4, " ".join(["spam and eggs on toast"] * 9), "", "", 0), (5, None, "", "", 0)]
    kept = quality.keep_good(fixtures.table(spark, rows))
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.columns == fixtures.table(spark, rows).columns
    greek = fixtures.table(spark, [(1, "ένα κείμενο γραμμένο σε άλλη γραφή χωρίς καμία από τις γνωστές λέξεις", "", "", 0), (2, "xa xb xc xd xe xf xg xh xi xj xk", "", "", 0), (3, "the long text " * 200_000, "", "", 0)])
    assert [r["doc_id"] for r in quality.keep_good(greek).collect()] == [1]
    assert quality.assess(fixtures.empty(spark)).count() == 0
    clash = fixtures.table(spark, rows).withColumn("quality", F.lit("mine"))
    assert quality.keep_good(clash).columns == clash.columns
    with pytest.raises(ValueError):
        quality.assess(clash)


# --- 10 decontamination


def _hits(text, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    words, hit, found = word.findall(low(text)), set(), set()
    for name, item in items:
        w = word.findall(low(item))
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(name))
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 24, 200, 70])
def test_decontamination(spark, docs, block_bytes):
    items = [(1, " ".join(WS.findall(ROWS[0][1])[2:25]).upper()), (2, "one TWO"), (3, None), (4, "..."), (5, " ".join(WS.findall(ROWS[0][1])[2:14])), (6, " ".join(WS.findall(ROWS[5][1])[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.scan(docs, bench, block_bytes=block_bytes).collect():
        n, hit, found = _hits(r["text"], items)
        assert (r["hits"]["n_words"], r["hits"]["n_hit"], list(r["hits"]["items"])) == (n, len(hit), found)
        assert {p for s in r["hits"]["words"] for p in range(s["begin"], s["end"])} == hit
    clean = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontaminate.scan(clean, bench).where("hits.n_hit > 0 and hits.n_words > 400").count() == 0
    kept = decontaminate.decontaminate(docs, bench, remove="documents")
    assert kept.count() == sum(not _hits(r[1], items)[1] for r in ROWS)
    assert decontaminate.scan(fixtures.empty(spark), bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("hits.n_hit > 0").count() == 0


def test_long_words_are_not_cut():
    windows = decontaminate.Windows([("a", "x" * (3 << 20))])
    assert len(windows.ids(b"x" * (3 << 20) + b" y")) == 2 and windows.find(windows.ids(b"x" * (3 << 20)))[0].all()


# --- 5 sharding


def _minimax(sizes, shards):
    best = {0: [0] + [10**18] * shards}
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, n = (low + high) // 2, 0, 1
        for s in sizes:
            if used + s > middle:
                used, n = 0, n + 1
            used += s
        low, high = (middle + 1, high) if n > shards else (low, middle)
    del best
    return low


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_minimax(spark, docs, shards):
    got = sharding.shard(docs, shards=shards).collect()
    assert len(got) == len(ROWS)
    groups: Counter = Counter()
    for r in ROWS:
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()] += len((r[1] or "").encode()) + 1
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    assert max(total.values()) <= _minimax([groups[k] for k in sorted(groups)], shards)
    for s in total:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    where = {}
    text_of = {r[0]: r[1] or "" for r in ROWS}
    for r in got:
        assert where.setdefault(text_of[r["doc_id"]], r["shard"]) == r["shard"]
        assert r["text_crc32"] == zlib.crc32(text_of[r["doc_id"]].encode())
    assert sharding.shard(fixtures.empty(spark)).count() == 0


def test_hot_group_and_clashing_names(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", "", "", 0) for i in range(300)]
    df = fixtures.table(spark, rows).withColumnRenamed("n_chars", "shard")
    got = sharding.shard(df, shards=4)
    assert "shard_" in got.columns and got.where("size = 10").select("shard_").distinct().count() == 1


# --- 7 pieces


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    model = pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    odd = [(i, t, "", "", 0) for i, t in enumerate(["", " ", "  a  b ", "a\tb\n\nc", "▁a", "<s> x", "\x00z", "日本𠀀 ééé", "\n a", "x" * 500, " " * 40 + "y", "​﻿ x", None])]
    for df in (docs, fixtures.table(spark, odd)):
        got = pieces.decode(pieces.encode(df, model), model).collect()
        for r in got:
            assert list(r["ids"]) == library.encode(r["text"] or "") and r["decoded"] == library.decode(list(r["ids"]))
    assert pieces.encode(fixtures.empty(spark), model).count() == 0


def test_agendas_in_step_equal_one_agenda(monkeypatch):
    import random

    own = pieces.encoder(pieces.default_model())
    r, out = random.Random(4), {}
    letters = "abcdeinorst▁é日𠀀'."
    words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(400)}, key=len)
    for part, ids in zip(words, own.memory.agenda.merge(words), strict=True):
        out[part] = ids
        assert ids is None or list(ids) == own.vocabulary.merge(part)
    assert sum(x is not None for x in out.values()) > 150
    # Forgetting, sections and long parts change nothing.
    monkeypatch.setattr(pieces, "_PART", 100)
    monkeypatch.setattr(pieces, "_REMEMBERED_BYTES", 3000)
    small = pieces.Encoder(pieces.default_model())
    texts = [" ".join(words), None, "x" * 5000 + " y" * 200, "", "one\n two"] * 2
    assert small.encode_batch(texts) == [small.vocabulary.library.encode(t or "") for t in texts]


def test_pieces_with_long_texts_and_clashing_names(spark):
    model = pieces.default_model()
    long = "many words of a text that goes on " * 40_000
    df = fixtures.table(spark, [(1, long, "", "", 0), (1, long, "", "", 0), (None, "a b", None, None, None)]).withColumnRenamed("lang", "ids")
    with pytest.raises(ValueError):
        pieces.encode(df, model)
    got = pieces.encode_and_decode(df, model).collect()
    own = pieces.encoder(model).vocabulary.library.encode(long)
    assert [r["pieces"]["n_tokens"] for r in got if r["doc_id"]] == [len(own)] * 2 and list(got[0]["pieces"]["ids"]) == own and "ids" in got[0].asDict()


# --- 6 simhash


def _fingerprint(text):
    words = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    prints = [(r[0], _fingerprint(r[1])) for r in ROWS]
    label = {f: min(i for i, g in prints if g == f and i is not None) for _, f in prints}
    while True:
        new = {f: min(label[g] for g in label if (f ^ g).bit_count() <= 3) for f in label}
        if new == label:
            break
        label = new
    want = Counter((i, f"{f:016x}", label[f]) for i, f in prints)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(label.values()))
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_pigeonhole_masks_find_every_close_pair():
    r = np.random.default_rng(1)
    for distance, blocks in ((1, 2), (2, 5), (3, 6)):
        own = [m & (2**64 - 1) for m in simhash.masks(distance, blocks)]
        for _ in range(200):
            x = int(r.integers(0, 2**63))
            y = x
            for b in r.choice(64, distance, replace=False):
                y ^= 1 << int(b)
            assert any(x & m == y & m for m in own)


def test_long_texts_vote_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(300_000))
    whole = simhash.fingerprint(text, words=3).tolist()
    monkeypatch.setattr(simhash, "_WORDS", 1000)
    assert simhash.fingerprint(text, words=3).tolist() == whole and simhash.fingerprint(text).tolist() == whole[:1]


@pytest.mark.parametrize("held_rows", [4, 50, 1 << 15])
def test_hot_buckets_are_dealt_out_again(spark, held_rows):
    r = np.random.default_rng(3)
    near = [int(x) for x in r.integers(0, 2**63, 3)]
    values = sorted({x ^ 1 << int(a) ^ 1 << int(b) for x in near for a, b in r.integers(40, 64, (60, 2))} | {int(x) for x in r.integers(0, 2**63, 100)})
    signed = [[x - (1 << 64) if x >> 63 else x] for x in values]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint array<bigint>"), held_rows=held_rows).collect()
    root = {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in got:
        a, b = e["a"] & (1 << 64) - 1, e["b"] & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 3
        root[find(a)] = find(b)
    for a in values:
        for b in values:
            assert (a ^ b).bit_count() > 3 or find(a) == find(b)


def test_near_copies_by_five_words(spark):
    r = np.random.default_rng(5)
    rows, pairs, at = [], [], 0
    for share in (0.0, 0.005, 0.01, 0.4):
        for _ in range(12):
            words = [f"w{x}" for x in r.integers(0, 5000, 400)]
            other = [f"c{x}" if y < share else w for w, x, y in zip(words, r.integers(0, 5000, 400), r.random(400), strict=True)]
            one, two = ({tuple(x[i : i + 5]) for i in range(396)} for x in (words, other))
            pairs.append((at, at + 1, len(one & two) / len(one | two)))
            rows += [(at, " ".join(words), "", "", 0), (at + 1, " ".join(other), "", "", 0)]
            at += 2
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(fixtures.table(spark, rows), **simhash.NEAR).collect()}
    linked = lambda low, high: [got[a] == got[b] for a, b, j in pairs if low <= j <= high]
    assert all(linked(0.97, 1)) and not any(linked(0, 0.6)) and np.mean(linked(0.9, 1)) >= 0.75


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (50, 2))] + [(100 + i, 101 + i) for i in range(30)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}


# --- 3 lines


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("chunk", [3, 128])
def test_lines(spark, docs, chunk):
    limits = line_dedup.Limits(20, 20, 34)
    how = {"limits": limits, "chunk": chunk}  # with chunks of 3 almost every group is large
    places: dict[str, tuple] = {}
    for d, text, *_ in ROWS:
        if d is not None and text is not None:
            for no, line in enumerate(text.split("\n")):
                if len(line) >= 20:
                    places[line] = min(places.get(line, (d, no)), (d, no))
    allowed = lambda a, b: 2 if min(len(a), len(b)) >= 34 else 1
    near = {a: min([places[a], *(places[b] for b in places if b != a and abs(len(a) - len(b)) <= allowed(a, b) and _distance(a, b) <= allowed(a, b))]) for a in places}
    assert any(near[a] < places[a] for a in places)
    got = line_dedup.mark_lines(docs, **how).collect()
    for r in got:
        if r["text"] is None or r["doc_id"] is None:
            assert list(r["lines"]["gone"]) == [] and r["lines"]["text"] == r["text"]
            continue
        own = r["text"].split("\n")
        gone = [i for i, line in enumerate(own) if line in near and near[line] < (r["doc_id"], i)]
        assert list(r["lines"]["gone"]) == gone
        assert r["lines"]["text"] == "\n".join(x for i, x in enumerate(own) if i not in set(gone))
    assert len(got) == len(ROWS)


def test_lines_keep_columns(spark, docs):
    clash = docs.withColumn("gone", F.lit(1)).withColumn("lines", F.lit("x"))
    out = line_dedup.drop_repeated_lines(clash)
    assert out.columns == clash.columns and out.count() == clash.count()
    assert line_dedup.drop_repeated_lines(fixtures.empty(spark)).count() == 0


def test_large_groups_are_paired(spark):
    table = np.zeros(700, line_dedup._ENTRY)
    table["line"] = np.arange(700)
    rows = line_dedup._share(128)((pa.scalar(1),), pa.table({"entries": [table.tobytes()]}))
    groups = line_dedup._in_pairs(spark.createDataFrame(rows.to_pandas(), line_dedup._MEMBERS)).groupBy("grp").agg(F.collect_list("key").alias("keys")).collect()
    assert max(len(g["keys"]) for g in groups) <= 256
    assert len({(a, b) for g in groups for a in g["keys"] for b in g["keys"] if a < b}) == 700 * 699 // 2


def test_both_kinds_of_keys_find_every_near_line():
    import random

    r, limits = random.Random(8), line_dedup.Limits()
    for _ in range(300):
        a = b = "".join(r.choice("abcé ") for _ in range(r.randrange(20, 70)))
        for _ in range(limits.edits(len(a))):
            at, how = r.randrange(len(b)), r.randrange(3)
            b = b[:at] + ("" if how == 0 else r.choice("xyz")) + b[at + (how < 2) :]
        if line_dedup.within(a, b, min(limits.edits(len(a)), limits.edits(len(b)))) and len(b) >= 20:
            for keys in (line_dedup.segment_keys, line_dedup.deletion_keys):
                assert set(map(int, keys(a, limits))) & set(map(int, keys(b, limits)))


def test_a_fixed_start_before_a_changing_tail(spark):
    start = "the same long beginning of a line that stands in every single document of the table, number "
    rows = [(i, f"{start}{i * 7919 % 100_000:05d}{i * 104_729 % 100_000:05d}", "", "", 0) for i in range(600)] + [(600, start + "0000000000"[:9], "", "", 0), (601, start * 2000, "", "", 0), (602, (start + "\n") * 3, "", "", 0)]
    places: dict[str, tuple] = {}
    for d, text, *_ in rows:
        for no, line in enumerate(text.split("\n")):
            if len(line) >= 20:
                places[line] = min(places.get(line, (d, no)), (d, no))
    short = [x for x in places if len(x) < 200]
    near = {x: min([places[x], *(places[y] for y in short if abs(len(x) - len(y)) <= 2 and line_dedup.within(x, y, 2))]) for x in short}
    got = {r["doc_id"]: list(r["lines"]["gone"]) for r in line_dedup.mark_lines(fixtures.table(spark, rows)).collect()}
    for d, text, *_ in rows:
        assert got[d] == [no for no, x in enumerate(text.split("\n")) if x in near and near[x] < (d, no)]


# --- 2 substrings


@pytest.mark.parametrize("hot_bytes", [1 << 26, 1000])
def test_substrings(spark, docs, hot_bytes, monkeypatch):
    first: dict[bytes, int] = {}
    for d, text, *_ in ROWS:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            if d is not None:
                first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], d), d)
    got = substrings.remove_repeats(docs, hot_bytes=hot_bytes, buckets=5).collect()
    want = Counter()
    for d, text, *_ in ROWS:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i : i + 50]] < d:
                covered[i : i + 50] = b"\1" * 50
        want[d, len(raw), bytes(c for c, k in zip(raw, covered) if not k), len(re.findall(b"\1+", covered))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got) == want
    other = docs.where("doc_id is not null").union(docs.where("doc_id = 3").withColumn("text", F.lit(ROWS[1][1] + " and more")))
    assert substrings.remove_repeats(other, buckets=5).where("doc_id = 3").select("n_bytes").distinct().count() == 2
    assert substrings.remove_repeats(fixtures.empty(spark)).count() == 0


def _shuffled(spark, run) -> tuple:
    """What ``run`` returns, and the bytes that its stages wrote for shuffles."""
    context = spark.sparkContext

    def so_far():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = so_far()
    return run(), so_far() - before


@pytest.mark.parametrize("hot_bytes", [1 << 26, 2000])
def test_little_is_dealt(spark, hot_bytes):
    """runs that share nothing stay where they are, a passage that is in many documents is no row for each of its strings, and copies are not looked at again."""
    r = np.random.default_rng(4)
    text = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = text(400)
    rows = [(k, text(3999) + chr(33 + k // 3) + (passage if k % 3 == 0 else ""), "", "", 0) for k in range(180)]
    rows += [(180 + k, rows[k][1], "", "", 0) for k in range(120)]
    got, shuffled = _shuffled(spark, lambda: {x["doc_id"]: x for x in substrings.remove_repeats(fixtures.table(spark, rows), hot_bytes=hot_bytes).collect()})
    for d, raw, *_ in rows:
        gone = [(0, len(raw))] if d >= 180 else [(4000, 4400)] if d % 3 == 0 and d else []
        assert [(x["begin"], x["end"]) for x in got[d]["spans"]] == gone
        assert bytes(got[d]["kept"]).decode() == ("" if d >= 180 else raw[: gone[0][0]] if gone else raw)
    assert shuffled < sum(len(x[1]) for x in rows)


def test_hashes_that_are_found_again_are_marked():
    """The bitmap marks every hash that stands in two tasks or twice in one; those of hot runs are told apart."""
    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 123, 3000, dtype=np.uint8)) for _ in range(40)]
    texts = [t + texts[k // 2][:500] if k % 4 == 0 else t for k, t in enumerate(texts)] + [texts[1][100:300]] * 9
    universe = substrings.Universe(sum(map(len, texts)))
    blobs: dict[int, list] = {}
    for k in range(0, len(texts), 10):
        some = texts[k : k + 10]
        batch = pa.RecordBatch.from_arrays([pa.array(range(k, k + len(some))), pa.array(range(k, k + len(some))), pa.array(some)], names=["id", "key", "raw"])
        for out in substrings._counter(50, universe)([batch]):
            for row in out.to_pylist():
                blobs.setdefault(row["segment"], []).append(row["prints"])
    marker = substrings._marker(universe, 5)
    found = [marker((pa.scalar(s),), pa.table({"prints": b})).to_pylist()[0] for s, b in blobs.items()]
    told = substrings.Marked(universe, {x["segment"]: x["bitmap"] for x in found}, [h for x in found for h in x["hot"]]).open()
    each = [substrings._runs_of([0], [0], [t], [0], 50)[0] for t in texts]
    n = Counter(h for p in each for h in universe.short(p).tolist())
    assert sum(x["n_runs"] for x in found) == sum(c for c in n.values() if 1 < c <= 5)
    for p in each:
        marked, hot = told(p)
        own = [n[h] for h in universe.short(p).tolist()]
        assert hot.tolist() == [c > 5 for c in own]
        assert all(m for m, c in zip(marked, own) if 1 < c <= 5)
    assert np.mean([m for p in each for m, h in zip(told(p)[0], universe.short(p).tolist()) if n[h] == 1]) < 0.05


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(substrings, "_SLICE", 300)
    import pyarrow as pa

    text = bytes(np.random.default_rng(1).integers(97, 123, 2000, dtype=np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([9]), pa.array([text])], names=["id", "key", "raw"])
    seen = set()
    for held in substrings._slices([batch], 50):
        for _, ids, keys, places, counts, raw in substrings._runs(*zip(*held), 50, 3):
            at = 0
            for p, c in zip(places.tolist(), counts.tolist()):
                assert bytes(raw[at : at + c + 49]) == text[p : p + c + 49]
                seen |= set(range(p, p + c))
                at += c + 49
    assert seen == set(range(2000 - 49))


def test_equal_fingerprints_are_compared(monkeypatch):
    monkeypatch.setattr(substrings, "_fingerprint", lambda at, loads, offsets, seed: np.zeros(len(at), np.uint64))
    a, b = b"a" * 50, b"b" * 50
    run, number = substrings._covered(np.array([1, 2, 3]), np.array([1, 1, 1]), np.frombuffer(a + b + a, np.uint8), 50)
    assert run.tolist() == [2] and number.tolist() == [0]


def test_induced_sorting_against_plain_sorting():
    r = np.random.default_rng(0)
    for k in range(1500):
        d = r.integers(97, 97 + int(r.integers(1, 5)), int(r.integers(1, 40)), dtype=np.uint8)
        if k % 3 == 0:
            d = np.concatenate([d, d, d[: len(d) // 2]])
        if k % 7 == 0:
            d = ((d - 97) * 85).astype(np.uint8)
        b = bytes(d)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert induced.suffix_order(d).tolist() == want
        shared = [next((p for p in range(20) if max(x, y) + p >= len(b) or b[x + p] != b[y + p]), 20) for x, y in zip(want, want[1:])]
        assert induced.common_prefixes(d, np.array(want), 20).tolist() == shared


def test_likely(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"), "id")
    keys = rows.where("id % 7 = 0").select("h")
    got = {r["id"] for r in likely(rows, F.col("h"), keys, bits=16).collect()}
    assert set(range(0, 3000, 7)) <= got and len(got) < 1500
    assert likely(rows, F.col("h"), keys, flag="f").count() == 3000


# --- 4 archives


def test_archives(spark, tmp_path):
    rows = [(3, "u3", b"same"), (1, "u\n1", b"same"), (2, None, None), (5, "u5", b""), (4, "u4", b"other"), (1, "u1", b"same"), (None, "u", b"same"), (None, "u", b"alone")]
    pages = spark.createDataFrame(rows, "id long, url string, payload binary")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a")
    got = Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(manifest).where("problem is null").collect())
    want = Counter()
    for i, _, p in rows:
        same = [j for j, _, q in rows if (q or b"") == (p or b"") and j is not None]
        again = i is not None and bool(same) and min(same) != i or i is None and bool(same)
        want[f"<urn:page:{'' if i is None else i}>", "revisit" if again else "response", f"<urn:page:{min(same)}>" if again else None, len(p or b""), base64.b32encode(hashlib.sha1(p or b"").digest()).decode()] += 1
    assert got == want
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")).count() == 0
    # Gaps go to a table of their own.
    name = manifest.orderBy("path").head()["path"].removeprefix("file://")
    with open(name, "r+b") as f:
        f.seek(40)
        f.write(b"????")
    valid = warc.read_valid(manifest, f"file://{tmp_path}/gaps").count()
    gaps = spark.read.parquet(f"file://{tmp_path}/gaps").collect()
    assert valid < len(rows) and gaps and all(g["problem"] and g["end"] > g["begin"] for g in gaps)


def test_payloads_are_not_shuffled(spark, tmp_path):
    rows = [(i, f"u{i}", b"one" if i % 3 == 0 else f"p{i % 50}".encode() if i % 2 else f"own {i}".encode()) for i in range(400)]
    pages = spark.createDataFrame(rows, "id long, url string, payload binary").repartition(5)
    got = {r["record_id"]: r for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/a")).collect()}
    least: dict[bytes, int] = {}
    for i, _, p in rows:
        least[p] = min(least.get(p, i), i)
    assert len(got) == len(rows)
    for i, u, p in rows:
        r = got[f"<urn:page:{i}>"]
        assert (r["record_type"], r["payload"], r["target_uri"], r["payload_bytes"]) == (("response", p, u, len(p)) if least[p] == i else ("revisit", None, u, len(p)))
        assert r["refers_to"] == (None if least[p] == i else f"<urn:page:{least[p]}>") and r["payload_digest"] == warc.digest(p)


class _Source(io.BytesIO):
    pass


def _salvaged(data):
    return list(warc.salvage(_Source(data), len(data)))


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    made = [warc.record(i, f"u{i}", f"payload {i} ".encode() * 20) for i in range(6)]
    parts = [warc.member(x) for x in made] if zipped else made
    whole = b"".join(parts)
    assert [r["record_id"] for r in _salvaged(whole)] == [f"<urn:page:{i}>" for i in range(6)]
    begins = [sum(map(len, parts[:i])) for i in range(7)]
    broken = bytearray(whole)
    broken[begins[2] + len(parts[2]) // 2] ^= 0xFF
    got = _salvaged(bytes(broken))
    gaps = [(r["begin"], r["end"]) for r in got if r.get("problem")]
    assert gaps == [(begins[2], begins[3])] and [r["record_id"] for r in got if not r.get("problem")] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    torn = whole[: begins[1]] + b"noise" * 9 + whole[begins[1] : begins[3] + 30]
    got = _salvaged(torn)
    assert [r["record_id"] for r in got if not r.get("problem")] == [f"<urn:page:{i}>" for i in range(3)]
    assert [(r["begin"], r["end"]) for r in got if r.get("problem")] == [(begins[1], begins[1] + 45), (begins[3] + 45, len(torn))]
    assert _salvaged(b"") == [] and [r["problem"] is not None for r in _salvaged(b"junk")] == [True]


@pytest.mark.parametrize("held", [8 << 20, 100])
def test_salvage_inside_members(held, monkeypatch):
    monkeypatch.setattr(warc, "_HELD", held)
    monkeypatch.setattr(warc, "_BLOCK", 700)
    noise = np.random.default_rng(3)
    made = [warc.record(i, f"u{i}", noise.bytes(3000)) for i in range(40)]
    ids = lambda got: [int(r["record_id"][10:-1]) for r in got if not r.get("problem")]
    assert ids(_salvaged(warc.member(b"".join(made)))) == list(range(40))
    # One bad record in a valid member of many: the others stay, and the gap is told.
    bad = made.copy()
    bad[7] = bad[7][:2000] + b"?" + bad[7][2001:]
    bad[20] = bad[20][:-100]
    got = _salvaged(warc.member(b"".join(bad)) + warc.member(made[0]))
    assert ids(got) == [i for i in range(40) if i not in (7, 20)] + [0] and sum(bool(r.get("problem")) for r in got) == 2
    # A tear: all records before it, and the next member.
    whole = warc.member(b"".join(made))
    got = _salvaged(whole[: len(whole) // 2] + warc.member(made[39]))
    assert ids(got)[-1] == 39 and ids(got)[:-1] == list(range(len(ids(got)) - 1)) and len(ids(got)) > 18 and any(r.get("problem") for r in got)
    # A wrong CRC: records with digests stay, others go.
    assert ids(_salvaged(whole[:-8] + b"\0\0\0\0" + whole[-4:])) == list(range(40))
    plain = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    one = warc.member(plain)
    assert ids(_salvaged(one)) == [1] and ids(_salvaged(one[:-8] + b"\0\0\0\0" + one[-4:])) == []


@pytest.mark.parametrize("zipped", [True, False])
def test_long_headers_are_read(zipped):
    made = [warc.record(i, "u" * (3 << 20), b"x") for i in range(2)]
    got = _salvaged(b"".join(map(warc.member, made) if zipped else made))
    assert [len(r.get("target_uri") or "") for r in got] == [3 << 20] * 2


# --- 8 wrappers

PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies</p></div>'
    '<main><article><header><h1>T &amp; x</h1></header><p>One<br>two  <b>three</b></p><ul><li>a<li>b</ul><div class="share-buttons">Share</div><p>Last</p></article>'
    '<section class="comments"><article><p>Nice!</p></article></section><aside>Side</aside><form><p>Name</p></form></main><footer>f</footer></body></html>'
)


def test_main_text(spark):
    plain = '<body><div id=menu><a href=x>m</a></div><div id="content"><h2>Head</h2><p>Some long text here that is the main text.</p><table><tr><td>x<td>y</table></div><div class="comments"><p>hm</p></div>'
    rows = [(1, "http://a.example/1", PAGE), (2, "http://A.example:80/2", PAGE.replace("Last", "End &lt; <!-- x -->")), (3, "http://b.example", plain), (4, None, None), (5, "http://a.example", ""), (6, "http://a.example/6", "just text < 3"), (6, "http://a.example/6", "just text < 3")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    out = wrappers.extract(df)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.columns == [*df.columns, "text"] and out.count() == 7
    assert got == {1: "T & x\n\nOne two three\n\na\n\nb\n\nLast", 2: "T & x\n\nOne two three\n\na\n\nb\n\nEnd <", 3: "Head\n\nSome long text here that is the main text.\n\nx\n\ny", 4: "", 5: "", 6: "just text < 3"}
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_align():
    a, b = (wrappers.expression(wrappers.blocks(x)[1]) for x in ("<article><h1>a</h1><p>b</p><p>c</p></article>", "<article><h1>a</h1><p>b</p><aside>x</aside></article>"))
    assert wrappers.written(wrappers._align(a, b)) == "(article(h1(#) p(#)+ aside?(#)))".replace("aside?(#)", "aside(#)?")
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert wrappers.main_text(deep, None) == "x"
    assert wrappers.written(wrappers.expression(wrappers.blocks("<h2>a</h2><p>b</p>" * 3)[1])) == "((h2(#) p(#))+)"


def test_template_texts_are_left_out(spark):
    notice, advert = "Our shop is closed on Sunday.", "Buy two lamps and get one."
    page = lambda k: f"<body><div><h1>Title {k}</h1><p>First text of page {k}.</p><p>{notice}</p><p>Second text {k}.</p></div>{f'<section><p>{advert}</p></section>' if k % 2 else ''}</body>"
    rows = [(k, "http://a.example", page(k)) for k in range(200)] + [(200, "http://b.example", page(1)), (201, "http://b.example", page(1)), (202, "http://c.example", page(1)), (203, "http://c.example", page(1).replace("Second", "Third"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert all(got[k] == f"Title {k}\n\nFirst text of page {k}.\n\nSecond text {k}." for k in range(200))
    # Equal pages, and two pages that are near copies, show no template.
    assert got[200] == got[201] == got[202] and notice in got[200] and notice in got[203]
    found = {r["host"]: r["wrapper"] for r in wrappers.wrappers(df.where("page_id < 200").selectExpr("'a' as host", "html")).collect()}
    assert re.fullmatch(r"\(body\(div\(h1\(#\) p\(#\) p\(=\w+\) p\(#\)\) section\(p\(=\w+\)\)\?\)\)", found["a"]), found


def test_marks_around_the_main_text():
    long = "A long text that makes up the article. " * 3
    article = f"<article><div class='page-header'><h1>Head</h1></div><p>{long}</p><div class='share'>Share</div></article>"
    comments = "<section class='comments'><article><p>Nice!</p></article></section>"
    for around in ("layout has-sidebar", "sidebar-right", "with_menu", "search"):
        page = f"<body><div class='{around}'>{article}<div class='sidebar'>Side</div>{comments}</div><p>Note</p></body>"
        assert wrappers.main_text(page, None) == f"Head\n\n{long.strip()}"
        # The same without an article.
        page = f"<body><div class='{around}'><div><p>{long}</p></div><div class='sidebar'>Side</div>{comments}</div></body>"
        assert wrappers.main_text(page, None) == long.strip()
    # Six tenths of the text in a marked layout.
    assert wrappers.main_text(f"<body><div class='search'><p>{'a' * 60}</p></div><div><p>{'b' * 40}</p></div></body>", None) == "a" * 60 + "\n\n" + "b" * 40
    # Comments stay out, however long they are.
    assert wrappers.main_text(f"<body><div><p>Short</p></div><div class='comments'><p>{long}</p></div></body>", None) == "Short"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><header class='entry-header'><h1>Title</h1></header><p>Body text here.</p></article>", "Title\n\nBody text here."),
        ("<body><div class='layout has-sidebar'><div class='content'><p>Long main text of the page.</p></div></div></body>", "Long main text of the page."),
        ("<article><p>Let <math><mi>x</mi></math> be big.</p></article>", "Let x be big."),
        ("<article><div class='related-work'><p>Section on related work.</p></div><div class='related-posts'><p>Read more</p></div></article>", "Section on related work."),
        ("<body>" + "<div>" * 60 + "<nav><p>Menu of the site</p></nav><p>Deep text that counts.</p>" + "</div>" * 60 + "</body>", "Deep text that counts."),
        ("<article>" + "<p>word</p>" * 20_000 + "</article>", "\n\n".join(["word"] * 20_000)),
    ],
)
def test_probes_of_main_text(page, text):
    assert wrappers.main_text(page, None) == text


def _sites(r, hosts=6, pages=7):
    """Pages of generated sites with their main text: each site has a layout of its own, unmarked notices, and articles that differ."""
    word = lambda n: " ".join("".join(r.choice("abdeilmnorstu") for _ in range(r.randrange(3, 9))) for _ in range(n))
    for h in range(hosts):
        menu, notice, foot = [word(1) for _ in range(6)], word(14), word(9)
        classes = [r.choice(["x1", "wrap", "col-a", "blk"]) for _ in range(4)]
        named = r.choice(["article", "main", "div"])
        for k in range(pages):
            title, body = word(5), [word(r.randrange(25, 60)) for _ in range(r.randrange(2, 7))]
            inner = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" + (f"<div>{notice}</div>" if i == 0 and h % 2 else "") for i, x in enumerate(body))
            top = f"<header class='site-header'><nav><ul>{''.join(f'<li><a href=#>{m}</a></li>' for m in menu)}</ul></nav></header>"
            side = f"<aside>{''.join(f'<p>{word(4)}</p>' for _ in range(k % 3))}</aside><div class='{classes[0]}'>{notice}</div>"
            thread = "".join(f"<div class='comments'><p>{word(12)}</p></div>" for _ in range(k % 4))
            page = f"<html><head><title>{title}</title><script>var a = '<p>no</p>';</script></head><body>{top}<div class='{classes[1]}'><{named} class='{classes[2]}'>{inner}</{named}>{side}{thread}</div><footer>{foot}</footer></body></html>"
            yield f"http://h{h}.example/{k}", page, "\n\n".join([title, *body])


def test_main_text_of_generated_sites(spark):
    import random

    rows = [(i, *x) for i, x in enumerate(_sites(random.Random(12)))]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame([x[:3] for x in rows], "page_id int, url string, html string")).collect()}
    assert [i for i, _, _, want in rows if got[i] != want] == []
    # The template is what leaves the notice between two paragraphs out: a page alone keeps it.
    kept = [i for i, _, page, want in rows if wrappers.main_text(page, None) != want]
    assert len(kept) >= 15


def test_wrappers_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "_GROUP", 3)
    tags = "h1 h2 h3 h4 h5 h6 p pre section dl".split()
    rows = [("a", "".join(f"<{t}>x{i}{j}</{t}>" for t in {tags[i], tags[j]})) for i in range(10) for j in range(10)]
    got = wrappers.wrappers(spark.createDataFrame(rows, "host string, html string")).collect()
    assert len(got) == 1 and all(t in got[0]["wrapper"] for t in tags)


# --- 1 surrogates

PII = [
    (1, "Mail john.Doe7@mail3.example.com or JOHN.doe7@mail3.example.com; ip 10.0.0.255, not 300.1.1.1"),
    (2, "+1 (521) 555-6210 and 4111 1111 1111 1111 4111111111111111 card 1234567890123456. x 7536784127813050 4845168114407329"),
    (3, None),
    (4, "plain text"),
    (5, 'Mr. John Smith met Frau Müller and г-жа Анна Иванова, MR JOHN SMITH. key="04dbebab91ab85687d33eeaaf9ac699e1188f962" DE89 3704 0044 0532 0130 00, 123-45-6789'),
    (6, ""),
    (5, "+1 (521) 555-6210 172.16.0.9"),
]


def test_surrogates(spark):
    df = spark.createDataFrame(PII, "doc_id long, text string").withColumn("draws", F.lit(1))
    out = surrogates.replace(df, "key")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert out.columns == ["doc_id", "text", "draws", "entities"] and got == sorted((tuple(r) for r in surrogates.replace(df, "key").collect()), key=str)
    by = {(r[0], len(r[1] or "")): r for r in got}
    one = next(r for r in got if r[0] == 1)
    assert list(one[3]) == ["email", "email", "ipv4"]
    a, b = re.findall(r"[\w.]+@[\w.]+", one[1])
    assert a.lower() == b.lower() and a != b and a.endswith(".com") and "mail3.example" not in one[1] and "not 300.1.1.1" in one[1]
    two = next(r for r in got if r[0] == 2)
    assert list(two[3]) == ["phone", "card", "card", "card", "card", "card"] and two[1].startswith("+1 (")
    spaced, solid = re.findall(r"(?<!\d)(?:\d{4} ){3}\d{4}(?!\d)|(?<!\d)\d{16}(?!\d)", two[1])[:2]
    assert spaced.replace(" ", "") == solid and solid != "4111111111111111" and solid[0] == "4"
    assert sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(solid))) % 10 == 0
    five = next(r for r in got if r[0] == 5 and "key=" in r[1])
    names = re.findall(r"(?:Mr\.|MR|Frau|г-жа) ([\w]+(?: [\w]+)?)", five[1])
    assert "Smith" not in five[1] and "Иванова" not in five[1] and re.search(r"г-жа [А-яё]+ [А-яё]+", five[1])
    assert re.fullmatch(r"[a-z0-9]{40}", re.search(r'key="(\w+)"', five[1])[1]) and names
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", two[1])[0]
    assert phone in next(r for r in got if r[0] == 5 and "key=" not in r[1])[1]
    assert next(r for r in got if r[0] == 3)[1] is None and next(r for r in got if r[0] == 4)[1] == "plain text" and by
    assert surrogates.replace(df.limit(0), "key").count() == 0


def test_surrogates_of_a_small_space_stay_distinct(spark, monkeypatch):
    # Addresses of one letter: 26 of them map onto 26 letters, so first draws collide.
    rows = [(i, f"x {chr(97 + i)}@b.example y") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(surrogates, "draw", lambda key, kind, canon, turn: F.concat(F.char(F.pmod(F.xxhash64(canon, turn), F.lit(40)).cast("int") + 97), F.lit("@c.example")))
    got = [r["text"] for r in surrogates.replace(df, "key").collect()]
    assert len(set(got)) == 12


NAMED = [
    "Mr. John Smith met MR JOHN SMITH and John Smith. Mr. Smith left. Smith, John came back.",
    "Dr. Anna Jones and Prof. Lee wrote; Anna laughed. The Jones report by Lee.",
    "Frau Müller-Lüdenscheidt, Herr von Goethe und Müller-Lüdenscheidt. Mr. J. R. Tolkien; Tolkien said so.",
    "Mr. Γιώργος Παπάς and г-жа Анна Иванова, Анна, ПАПÁΣ.",
    "Mrs. John Smith is named as her husband; JOHN is not.",
    None, "", "no names here: Smith and John are only words",
]


def test_names_are_coreferent_and_distinct(spark):
    df = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.replace(df, "key").collect()}
    word = re.compile(r"[^\W\d_]+")
    of_word: dict[str, set] = {}
    for k, old in enumerate(NAMED):
        if not old:
            assert got[k] == old
            continue
        # Format: what is no word stays where it is, case stays.
        assert word.sub("", old) == word.sub("", got[k])
        for a, b in zip(word.findall(old), word.findall(got[k]), strict=True):
            assert a.isupper() == b.isupper() and a[0].isupper() == b[0].isupper()
            if a != b and len(a) > 1 and k != 4:
                of_word.setdefault(a.lower(), set()).add(b.lower())
    assert got[7] == NAMED[7]
    hidden = "john smith anna jones lee müller lüdenscheidt goethe tolkien γιώργος παπάς анна иванова".split()
    assert all(len(of_word[w]) == 1 for w in hidden if w != "anna")  # each name has one surrogate,
    new = [next(iter(of_word[w])) for w in hidden]
    assert len(set(new)) == len(new) and not set(new) & set(hidden)  # no two share one
    for k in (0, 1, 2, 3):
        assert not {w for w in word.findall(got[k].lower())} & set(hidden)
    assert re.search("[α-ω]", of_word["γιώργος"].copy().pop()) and re.search("[а-я]", of_word["анна"].copy().pop())
    assert "von " in got[2] and "The " in got[1] and re.search(r"Mr\. [A-Z]\. [A-Z]\. ", got[2]) and "J. R." not in got[2]


def test_more_entities(spark):
    text = "v6 2001:db8:0:1:2:3:4:5 or fe80::1, amex 3782 822463 10005, call 1-800-555-1234 or 555 123 4567 or 030 12345678, at 12:30:45 in 1999 2000"
    r = surrogates.replace(spark.createDataFrame([(1, text), (1, text), (2, "Mr. Long Name " + "and much text " * 100_000)], "doc_id long, text string"), "key").collect()
    assert list(r[0]["entities"]) == ["ipv6", "ipv6", "card", "phone", "phone", "phone"] and r[0] == r[1]
    assert re.fullmatch(r"v6 [\da-f:]+ or [\da-f]{4}::[\da-f], amex \d{4} \d{6} \d{5}, call \d-\d{3}-\d{3}-\d{4} or \d{3} \d{3} \d{4} or \d{3} \d{8}, at 12:30:45 in 1999 2000", r[0]["text"])
    assert len(r[2]["text"]) > 1_400_000 and "Long" not in r[2]["text"]


def test_a_full_space_gets_longer(spark):
    rows = [(k * 26 + i, f"x {chr(97 + k)}{chr(97 + i)}@b.co y") for k in range(26) for i in range(26)]
    got = [re.search(r"\S+@\S+", r["text"])[0] for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()]
    assert len(set(got)) == len(rows) and not {x.split("@")[0] for x in got if x.endswith("@b.co") and len(x) == 7}


def test_surrogate_plan_is_native(spark):
    df = spark.createDataFrame(PII, "doc_id long, text string")
    plan = surrogates.replace(df, "key")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
