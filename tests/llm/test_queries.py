"""Registered queries against their SQL, or against brute force, on the smallest tables; the pipeline against its parts."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tessitura.llm import pieces, queries

from .test_operators import _distance, _fingerprint, _minimax

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in "documents pages benchmark embeddings labels".split():
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    normal = lambda df: df[sorted(df.columns)].astype(str).replace({"<NA>": "nan", "None": "nan"}).sort_values(sorted(df.columns)).reset_index(drop=True)
    own, other = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).fetch_df()
    pd.testing.assert_frame_equal(normal(own), normal(other))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        assert docs.count() <= rows
        rows = docs.count()
    assert 0 < rows < spark.read.parquet(f"{SF}/documents.parquet").count()
    whole = corpus_pipeline.run(spark, SF)
    pd.testing.assert_frame_equal(*(x.select("doc_id", "n_tokens", "decoded_sha256").toPandas().sort_values("doc_id").reset_index(drop=True) for x in (whole, docs)))


# --- the columns of registered queries, against brute force


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(d["doc_id"], d["text"].where(d["text"].notna(), None), strict=True))


def _rows(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.queries()[name](spark, SF).collect()}


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_op2_columns(spark, texts):
    first: dict[bytes, int] = {}
    raws = {d: (t or "").encode() for d, t in texts.items()}
    for d in sorted(raws):
        for i in range(len(raws[d]) - 49):
            first.setdefault(raws[d][i : i + 50], d)
    got = _rows(spark, "op2_substrings")
    assert set(got) == set(raws)
    for d, raw in raws.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, k in zip(raw, gone, strict=True) if not k)
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(gone), len(re.findall(b"\1+", gone)), _sha(kept))


def test_op3_columns(spark, texts):
    place: dict[str, tuple] = {}
    for d in sorted(texts):
        for no, line in enumerate((texts[d] or "").split("\n")):
            if len(line) >= 20:
                place.setdefault(line, (d, no))
    lines = sorted(place, key=len)
    sizes = np.array([len(x) for x in lines])
    bags = np.array([np.bincount(np.frombuffer(x.encode(), np.uint8) & 63, minlength=64) for x in lines], np.int16)
    earliest = dict(place)
    for i, a in enumerate(lines):
        until = int(np.searchsorted(sizes, len(a) + 2, "right"))
        most = 2 if len(a) >= 48 else 1
        near = np.flatnonzero(np.abs(bags[i + 1 : until] - bags[i]).sum(1) <= 8 * most) + i + 1
        for b in (lines[j] for j in near):
            if len(b) - len(a) <= most and _distance(a, b) <= most:
                earliest[a], earliest[b] = min(earliest[a], place[b]), min(earliest[b], place[a])
    got = _rows(spark, "op3_line_dedup")
    assert set(got) == set(texts) and any(r["n_removed"] for r in got.values())
    for d, t in texts.items():
        own = (t or "").split("\n")
        gone = [no for no, x in enumerate(own) if x in place and earliest[x] < (d, no)]
        assert (got[d]["n_removed"], got[d]["removed_lines"]) == (len(gone), ",".join(map(str, gone)))
        assert got[d]["kept_sha256"] == (None if t is None else _sha("\n".join(x for no, x in enumerate(own) if no not in set(gone)).encode()))


def test_op5_columns(spark, texts):
    got = _rows(spark, "op5_minimax_shards")
    sizes = {d: len((t or "").encode()) + 1 for d, t in texts.items()}
    assert set(got) == set(texts) and {r["law"] for r in got.values()} == {"bytes"} and {r["grown_shard"] for r in got.values()} == {None}
    groups: dict[str, int] = {}
    for d, t in texts.items():
        assert (got[d]["size"], got[d]["text_crc32"]) == (sizes[d], zlib.crc32((t or "").encode())) and 0 <= got[d]["shard"] < 16
        groups[_sha((t or "").encode())] = groups.get(_sha((t or "").encode()), 0) + sizes[d]
    assert len({(t or "", got[d]["shard"]) for d, t in texts.items()}) == len(groups)  # equal texts stay together
    total: dict[int, int] = {}
    for d, r in got.items():
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        assert sum(x["shard"] == r["shard"] for x in got.values()) > r["slot"] >= 0
    assert len({(r["shard"], r["slot"]) for r in got.values()}) == len(got)
    assert max(total.values()) <= _minimax([groups[k] for k in sorted(groups)], 16)


def test_op6_columns(spark, texts):
    prints = {d: _fingerprint(t) for d, t in texts.items()}
    label = {f: min(d for d, g in prints.items() if g == f) for f in prints.values()}
    while True:
        new = {f: min(label[g] for g in label if (f ^ g).bit_count() <= 3) for f in label}
        if new == label:
            break
        label = new
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in _rows(spark, "op6_simhash").items()} == {d: (f"{f:016x}", label[f]) for d, f in prints.items()}


def test_op7_columns(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for d, r in _rows(spark, "op7_sentencepiece").items():
        ids = library.encode(texts[d] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), _sha(",".join(map(str, ids)).encode()), _sha(library.decode(ids).encode()))


def test_op8_columns(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = _rows(spark, "op8_main_text", "page_id")
    assert {k: got[k]["url"] for k in got} == dict(zip(pages["page_id"], pages["url"], strict=True))
    assert all(r["n_chars"] == len(r["text"]) and not re.search(r"<(p|div|script)\b|&(amp|lt|nbsp);", r["text"]) for r in got.values())


def test_op1_columns(spark, texts):
    got = _rows(spark, "op1_surrogates")
    assert set(got) == set(texts)
    seen: dict[str, str] = {}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z0-9-]*")
    for d, r in got.items():
        assert r["n_entities"] == sum(r[c] for c in r.asDict() if c.startswith("n_") and c != "n_entities")
        if not r["n_entities"]:
            assert r["text"] == texts[d]
        for a, b in zip(mail.findall(texts[d] or ""), mail.findall(r["text"] or ""), strict=True):
            assert seen.setdefault(a.lower(), b.lower()) == b.lower() != a.lower()
    assert len(set(seen.values())) == len(seen) and not set(seen.values()) & set(seen)
