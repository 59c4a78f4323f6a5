"""Product codes, filter audit and language identification, each against a plain version on small tables."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from tessitura.llm import filter_audit, language_id, yinyang

from . import fixtures

# --- 11 product codes


def _lloyd(vectors: list[tuple], parts: int, entries: int, rounds: int):
    """(code and error of each row, entries) by looking at every entry for every part."""
    x = np.array([[int(np.floor(c * 4096)) for c in v] for _, v in vectors], object).reshape(len(vectors), parts, -1)
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, vectors[i][1]))[:entries]
    books = [[list(x[i][p]) for i in order] for p in range(parts)]

    def nearest(p, row):
        return min((sum((a - b) ** 2 for a, b in zip(row, entry, strict=True)), k) for k, entry in enumerate(books[p]))

    for k in range(rounds + 1):
        found = [[nearest(p, row[p]) for p in range(parts)] for row in x]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [row[p] for row, f in zip(x, found, strict=True) if f[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in found], books


def _vectors(n: int, dim: int, seed: int, scale: float = 0.01):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.3))) for c in r.choice(centres)]) for i in range(n)]
    rows += [(i + n, [round(c / scale) * scale for c in v]) for i, (_, v) in enumerate(rows[: n // 3])]  # many ties
    rows += [(2 * n, rows[0][1]), rows[5], rows[5], (None, rows[7][1])] + [(3 * n + k, rows[1][1]) for k in range(n)]  # copies, equal ids, a null id
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("dim", "parts", "entries", "groups", "scale"), [(16, 8, 16, 4, 0.01), (6, 2, 5, 2, 1.0), (8, 8, 3, 8, 0.5), (4, 1, 1, 1, 0.1)])
def test_codes_against_every_entry(spark, dim, parts, entries, groups, scale):
    rows = _vectors(60, dim, dim + parts, scale)
    trace = []
    table = spark.createDataFrame([(i, v, k % 3 if k % 5 else None) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(5)
    coded, books = yinyang.compress(table, parts=parts, entries=entries, rounds=4, n_groups=groups, trace=trace)
    codes, entries_found = _lloyd([(i, [float(np.float32(c)) for c in v]) for i, v in rows], parts, entries, 4)
    assert books.entries.tolist() == entries_found
    want = sorted(zip([(i is None, i or 0) for i, _ in rows], codes, strict=True))
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), (r["code"], r["error"])) for r in coded.collect()) == want
    assert trace[0][0] == trace[0][1]  # at first every group is looked at
    if groups > 2:
        assert trace[-1][0] < trace[-1][1] / 2  # later the bounds spare most


def test_bounds_hold():
    """After any moves of the entries a bound is at most the distance to every other entry of its group."""
    r = np.random.default_rng(5)
    x, book = r.integers(-300, 300, (400, 4)), r.integers(-300, 300, (16, 4))
    groups = yinyang.grouped(book[None], 4)[0]
    own, low, moved = np.zeros(400, np.int64), np.zeros((400, 4)), np.zeros(16)
    for _ in range(6):
        own, best, low, _ = yinyang.assign_part(x, book, groups, own, low, moved)
        low = yinyang._down(low).astype(float)
        every = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (own == every.argmin(1)).all() and (best == every.min(1)).all()
        for g in range(4):
            others = np.where((groups == g)[None] & (np.arange(16)[None] != own[:, None]), every, np.iinfo(np.int64).max).min(1)
            assert (low[:, g] <= np.sqrt(others)).all()
        new = book + r.integers(-40, 40, book.shape)
        moved, book = np.sqrt(((new - book) ** 2).sum(1)) * (1 + 1e-9), new


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<double>, label int, entries string"
    good = [(i, [float(i), 1.0, 2.0, float(i % 3)], None, "own") for i in range(6)]
    odd = [(10, None, 1, ""), (11, [1.0, None, 0.0, 0.0], 1, ""), (12, [nan, 0.0, 0.0, 0.0], 1, ""), (13, [0.0, -inf, 0.0, 0.0], 1, ""), (14, [1.0, 2.0], 1, ""), (15, [1e30, 0.0, 0.0, 0.0], 1, ""), (16, [], 1, "")]
    coded, books = yinyang.compress(spark.createDataFrame(good + odd, schema), parts=2, entries=4, rounds=2)
    got = {r["vec_id"]: r for r in coded.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 14, 15, 16] and coded.columns == ["vec_id", "label", "entries", "code", "error"]
    assert all((got[k]["code"] is None) == (k > 9) == (got[k]["error"] is None) for k in got) and got[3]["entries"] == "own"
    assert books.entries.shape == (2, 4, 2)
    errors = {r["vec_id"]: r["label_error"] for r in yinyang.with_label_error(coded).collect()}
    assert errors[0] == errors[5] == sum(r["error"] for r in got.values() if r["error"] is not None) and errors[14] is None
    nothing, none = yinyang.compress(spark.createDataFrame([], schema))
    assert nothing.count() == 0 and none is None
    uneven, none = yinyang.compress(spark.createDataFrame(good, schema), parts=3)
    assert none is None and {r["code"] for r in uneven.collect()} == {None}
    with pytest.raises(ValueError, match="code"):
        yinyang.compress(spark.createDataFrame(good, schema).withColumn("code", F.lit(1)))


def test_label_errors_joined(spark, monkeypatch):
    coded = spark.createDataFrame([(k, k % 9 if k % 4 else None, k) for k in range(300)], "vec_id long, label int, error long")
    few = sorted(map(tuple, yinyang.with_label_error(coded).collect()))
    monkeypatch.setattr(yinyang, "_BROADCAST_LABELS", 2)
    assert sorted(map(tuple, yinyang.with_label_error(coded).collect())) == few


# --- 12 filter audit


def _audited(rows: list[tuple], labels: list[tuple]) -> dict:
    """By walking every order over every document."""
    ws = regex.compile(r"[^\x20\x09-\x0D]+")

    def fails(row):
        words, t = ws.findall(row[1] or ""), row[1] or ""
        copy = row[0] is not None and any(o[0] is not None and o[0] < row[0] and (o[1] or "") == t for o in rows)
        return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": copy}

    flag = lambda k: {i for i, *q in labels if q[k] == 1 and i is not None}
    good, toxic, judged, out = flag(0), flag(1), [(r[3] or "", r[0], fails(r)) for r in rows], {}
    for part in {p for p, _, _ in judged}:
        mine = [(i, f) for p, i, f in judged if p == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone, alone = [(i, f) for i, f in left if f[x]], sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                redundant = sum(f[x] and any(f[y] for y in order[:k]) for _, f in mine)
                left = [(i, f) for i, f in left if not f[x]]
                removed[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x]
        for key in out:
            if key[0] == part:
                out[key][-1] = removed[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def _audit_tables(spark):
    r = random.Random(3)
    rows = [x for x in fixtures.texts(30) if x[1] is None or len(x[1]) < 20000]
    rows = [(i, None if t is None else t + r.choice(["", "#", " LOUD WORDS HERE " * 9, ""]), lang, s, n) for i, t, lang, s, n in rows]
    rows += [(500 + k, "same text", "en", f"src{k % 4}", 9) for k in range(30)] + [(500, "same text", "en", "src9", 9), (900, "", "en", None, 0), (901, rows[0][1], "en", "", 0), (-4, None, None, "src1", None)]
    labels = [(i, int(r.random() < 0.5), int(r.random() < 0.3)) for i, *_ in rows if i is not None and r.random() < 0.6] + [(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0), (77777, 1, 1)]
    return rows, labels, spark.createDataFrame(rows, fixtures.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_by_walking(spark):
    rows, labels, docs, table = _audit_tables(spark)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs.withColumn("mask", F.lit("x")).withColumn("n", F.lit(1)), table).collect()}
    want = _audited(rows, labels)
    assert got == want and len(got) == 600 * len({k[0] for k in want}) and "" in {k[0] for k in want}
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    duck.register("labels", table.toPandas().astype("Int64"))
    assert {(r[0], r[1], r[2]): tuple(map(int, r[3:])) for r in duck.execute(filter_audit.OP12_SQL).fetchall()} == want


def test_audit_of_little(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(fixtures.empty(spark), labels).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000, "en", "a", 0)], fixtures.SCHEMA)
    r = filter_audit.audit(long, labels).where("filter_order = 'BACDE' and step = 1").head()
    assert (r["kept"], r["removed"], r["unique_fails"], r["shapley"]) == (0, 1, 1, 120)
    with pytest.raises(ValueError, match="nowhere"):
        filter_audit.audit(long, labels, "nowhere")


def test_lattice(spark):
    """80 edges and 600 steps, and what an edge weighs is how many orders run through it."""
    counts = spark.createDataFrame([("p", m, 1, 0, 0) for m in range(32)], "part string, mask int, n long, good long, toxic long")
    edges, steps = filter_audit.edges(counts), filter_audit.steps(spark)
    assert (edges.count(), steps.count()) == (80, 600)
    removed = edges.join(steps, ["applied", "next"]).groupBy("next").agg(F.sum("removed").alias("walked"), F.max("shapley").alias("weighed")).collect()
    assert all(r["walked"] == r["weighed"] for r in removed)


# --- 13 language identification


def _letters(t: str) -> bytes:
    return (" " + regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).strip() + " ").encode()


def _tongues(n: int, seed: int = 4):
    r = random.Random(seed)
    words = {x: ["".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(60)] for x, letters in {"aa": "abcdeé", "bb": "defghß", "cc": "μνξοπρ", "": "aegñov"}.items()}
    rows = []
    for i in range(n):
        x = r.choice(sorted(words))
        rows.append((i, " ".join(r.choice(words[x]) for _ in range(r.randrange(2, 60))) + r.choice(["", ". 12 #", "\n"]), x, "s", 0))
    return rows


@pytest.mark.parametrize(("slot_bits", "hashes"), [(19, 4), (12, 2)])
def test_languages_against_sets(spark, slot_bits, hashes):
    """Masks hold every n-gram of the exact sets, others as often as chance says; held-out texts are told right."""
    rows = _tongues(400)
    docs = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3)
    filters = language_id.learn(docs, slot_bits=slot_bits, hashes=hashes)
    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    grams = {x: {} for x in filters.languages}
    for _, t, x, *_ in learned:
        b = _letters(t)
        for g in {b[i : i + n] for n in (3, 4) for i in range(len(b) - n + 1)}:
            grams[x][g] = grams[x].get(g, 0) + 1
    docs_of = {x: sum(r[2] == x for r in learned) for x in grams}
    assert list(filters.languages) == sorted(docs_of, key=lambda x: (-docs_of[x], x))
    share = {x: {g: n / docs_of[x] for g, n in grams[x].items()} for x in grams}
    held = {x: {g for g, s in share[x].items() if grams[x][g] >= 2 and s >= 0.002 and s >= 0.5 * max(share[y].get(g, 0) for y in share)} for x in grams}
    key = lambda g: int.from_bytes(g, "little") | len(g) << 60
    every = sorted({g for x in grams for g in grams[x]})
    masks = filters.containing(np.array(list(map(key, every)), np.uint64))[0]
    for k, x in enumerate(filters.languages):
        found = {g for g, m in zip(every, masks, strict=True) if int(m) >> k & 1}
        assert held[x] <= found
        others = [g for g in every if g not in held[x]]
        assert abs(len(found - held[x]) / len(others) - filters.chance[k]) < 0.05
    got = {r["doc_id"]: r for r in language_id.identify(docs, filters).collect()}
    out = [x for x in rows if x not in learned]
    assert len(got) == 400 and sum(got[i]["lang_pred"] == x for i, _, x, *_ in out) >= 0.98 * len(out) > 50
    if slot_bits == 19:
        for i, t, *_ in rows[:80]:
            b = _letters(t)
            texts = [b[k : k + n] for n in (3, 4) for k in range(len(b) - n + 1)]
            n_of = [sum(g in held[x] for g in texts) for x in filters.languages]
            assert got[i]["lang_pred"] == filters.languages[int(np.argmax(n_of))] and abs(got[i]["score"] - max(n_of) / len(texts)) < 0.02


def test_languages_of_odd_texts(spark):
    rows = _tongues(200)
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    filters = language_id.learn(docs)
    long = " ".join(t for _, t, x, *_ in rows if x == "bb")
    odd = [(1, None), (2, ""), (3, "12 #$ 4"), (4, "字"), (5, long * 300), (6, rows[0][1]), (6, rows[0][1]), (None, rows[0][1])]
    table = spark.createDataFrame(odd, "doc_id long, text string").withColumn("letters", F.lit("own"))
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["letters"]) for r in language_id.identify(table, filters).collect()]
    assert got[:3] == [(i, "und", 0.0, "own") for i in (1, 2, 3)] and got[3][1] == filters.languages[0] and got[3][2] == 0
    assert got[4][1] == "bb" and 0.9 < got[4][2] <= 1 and got[5][1:] == got[6][1:] == got[7][1:]
    assert language_id.learn(fixtures.empty(spark)) is None and language_id.identify(fixtures.empty(spark), filters).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    with pytest.raises(ValueError, match="score"):
        language_id.identify(docs.withColumn("score", F.lit(1)), filters)
    single = language_id.learn(spark.createDataFrame([(1, "uno dos tres", "es", "", 0), (None, "un deux", "fr", "", 0)], fixtures.SCHEMA))
    assert single.languages == ("es",)
    r = language_id.identify(spark.createDataFrame([(1, "uno dos tres")], "doc_id long, text string"), single).head()
    assert (r["lang_pred"], round(r["score"], 2)) == ("es", 1.0)


def test_only_the_text_decides(spark):
    docs = spark.createDataFrame(_tongues(120), fixtures.SCHEMA)
    filters = language_id.learn(docs)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 7000})
    told = lambda df: [(r["text"], r["lang_pred"], r["score"]) for r in language_id.identify(df, filters).collect()]
    assert told(docs) == told(other)


def test_many_languages(spark):
    """More languages than a word of a slot has bits."""
    r = random.Random(2)
    alphabet = [chr(0x4E00 + k) for k in range(700)]
    rows = [(i, " ".join("".join(r.choice(alphabet[i % 70 * 10 : i % 70 * 10 + 10]) for _ in range(4)) for _ in range(20)), f"l{i % 70:02d}", "", 0) for i in range(700)]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    filters = language_id.learn(docs)
    assert filters.masks.shape[0] == 2 and len(filters.languages) == 70
    got = language_id.identify(docs, filters).where(language_id.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 100


def test_pieces_of_long_texts():
    """N-grams by pieces are the n-grams of the whole, and none crosses two texts."""
    r = np.random.default_rng(1)
    sizes = r.integers(0, 40, 30)
    ends = np.cumsum(sizes)
    data, starts = r.integers(97, 101, ends[-1]).astype(np.uint8), ends - sizes
    for size in (1, 3, 4):
        want = sorted((t, bytes(data[i : i + size])) for t in range(30) for i in range(starts[t], ends[t] - size + 1))
        for step in (1, 7, 64, 10_000):
            got = [(int(t), int(k & np.uint64((1 << 56) - 1)).to_bytes(7, "little")[:size]) for keys, text in language_id._pieces(data, starts, ends, size, step) for k, t in zip(keys, text, strict=True)]
            assert sorted(got) == want


def test_op13_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.op13_language_id(spark, sf).collect()}
    assert set(got) == set(docs["doc_id"])
    out = [(got[i], x) for i, x in zip(docs["doc_id"], docs["lang"], strict=True) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(r["held_out"] for r in got.values()) == len(out) and all(r["held_out"] for r, _ in out)
    assert sum(r["lang_pred"] == x for r, x in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in got.values())


def test_op11_digest(spark):
    rows = {r["vec_id"]: r for r in yinyang.op11_yinyang_codes(spark, "/root/testdata/sf0.001").collect()}
    vectors = pd.read_parquet("/root/testdata/sf0.001/embeddings.parquet")
    codes, books = _lloyd([(int(i), [float(c) for c in v]) for i, v in zip(vectors["vec_id"], vectors["embedding"], strict=True)][:500], 8, 16, 6)
    sha = hashlib.sha256(",".join(str(c) for part in books for entry in part for c in entry).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in rows.values()} == {sha}
    assert [(rows[i]["code"], rows[i]["error"]) for i in vectors["vec_id"]] == codes
