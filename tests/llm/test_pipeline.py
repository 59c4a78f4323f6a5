"""The pipeline against a brute-force version of its five stages on a small table."""

import hashlib
import re
from collections import Counter

import xxhash

import corpus_pipeline
from tessitura.llm import pieces, quality

from . import fixtures
from .test_operators import WS, _distance, _hits

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _good(text):
    text = text or ""
    words, lines = WS.findall(text), [x for x in text.split("\n") if WS.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    chars, stop = sum(map(len, words)), set(quality.STOP_WORDS) | {w.capitalize() for w in quality.STOP_WORDS}
    return (
        len(words) >= 10
        and 100 * len(repeated) <= 20 * len(words)
        and 2 * len(words) <= chars <= 15 * len(words)
        and sum(c in "#*$%&|<>" for c in text) <= 0.1 * len(words)
        and (not stop.isdisjoint(words) or 4 * len(re.sub("[\x00-\u024f\u1e00-\u1eff\u2000-\u206f]", "", text)) > chars)
        and len(lines) - len(set(lines)) <= 0.4 * len(lines)
        and sum(bool(re.match(r"\s*[-*•‣▪]", x)) for x in lines) <= 0.9 * len(lines)
        and sum(x.rstrip().endswith(("...", "…")) for x in lines) <= 0.3 * len(lines)
    )


def _without_lines(rows):
    first: dict[str, tuple] = {}
    for d, text in rows:
        for no, line in enumerate(text.split("\n") if d is not None and text is not None else ()):
            if len(line) >= 20:
                first[line] = min(first.get(line, (d, no)), (d, no))
    most = lambda a, b: 2 if min(len(a), len(b)) >= 48 else 1
    close = lambda a, b: abs(len(a) - len(b)) <= most(a, b) and _distance(a, b) <= most(a, b)
    earliest = {a: min([first[a], *(first[b] for b in first if first[b] < first[a] and close(a, b))]) for a in first}
    for d, text in rows:
        if d is None or text is None:
            yield d, text
        else:
            yield d, "\n".join(x for no, x in enumerate(text.split("\n")) if x not in earliest or earliest[x] >= (d, no))


def _print(text):
    """The three words of a fingerprint of five-word shingles."""
    words = WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    full, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    out = []
    for k in range(3):
        mixed = hashes
        if k:
            mixed = [(h ^ h >> 29) * (odd * (2 * k + 1) & full) & full for h in hashes]
            mixed = [(h ^ h >> 32) * odd & full for h in mixed]
            mixed = [h ^ h >> 31 for h in mixed]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)))
    return tuple(out)


def _one_of_each(rows):
    prints = [_print(text) for _, text in rows]
    root = {p: p for p in prints}
    for _ in root:
        for a in root:
            for b in root:
                if (a[0] ^ b[0]).bit_count() <= 6 and sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= 32:
                    root[a] = root[b] = min(root[a], root[b])
    least: dict[int, int] = {}
    for p, (d, _) in zip(prints, rows, strict=True):
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    seen = set()
    for p, (d, text) in zip(prints, rows, strict=True):
        if d is None or (d == least[root[p]] and d not in seen):
            seen.add(d)
            yield d, text


def _clean(text, items):
    _, hit, _ = _hits(text, items)
    spans, out, at = [m.span() for m in _WORD.finditer(text or "")], [], 0
    for k in sorted(hit):
        out.append("" if k - 1 in hit else text[at : spans[k][0]])
        at = spans[k][1]
    return "".join(out) + text[at:] if hit else text


def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    rows = [(d, "the " + t if t and len(t) > 20 else t, *rest) for d, t, *rest in fixtures.texts(30)]
    words = WS.findall(rows[3][1])
    items = [(1, " ".join(words[1:14]).upper()), (2, None), (3, "..."), (4, " ".join(WS.findall(rows[4][1])[2:12]))]
    fixtures.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(d, t) for d, t, *_ in rows if _good(t)]
    lined = list(_without_lines(kept))
    single = list(_one_of_each(lined))
    clean = [(d, _clean(t, items)) for d, t in single]
    assert len(rows) > len(kept) > len(single) > 5 and lined != kept and clean != single
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for d, t in clean:
        ids = library.encode(t or "")
        want.append((d, len(ids), ids, hashlib.sha256(library.decode(ids).encode()).hexdigest()))

    got = [(r["doc_id"], r["n_tokens"], list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_with_empty_tables_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "some words")], "item_id long, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["pieces", "lines", "hits", "quality", "component", "gone"]
    extra = lambda df: df.withColumns({n: F.lit(n) for n in names})
    good = "the words of this text are many and it is long enough to stay here in full"
    some = fixtures.table(spark, [(1, good, "en", "s", 0), (1, good, "en", "s", 0), (None, good, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)])
    for docs, n in ((extra(fixtures.empty(spark)), 0), (extra(some), 2)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                out.write.parquet(f"{tmp_path}/{n}-{k}")
                docs = spark.read.parquet(f"{tmp_path}/{n}-{k}")
        assert out.count() == n and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
