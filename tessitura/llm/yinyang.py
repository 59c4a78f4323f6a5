"""Product codes of vectors, trained by Lloyd rounds that skip by group bounds (Yinyang).

Vectors are cut into parts; each part has a codebook. Every round assigns each
part to its nearest entry and moves the entries to the means of their parts. The
entries of a codebook are clustered into a few groups, and for each part of each
vector and each group one lower bound on the distance to the group's other
entries is carried from round to round. An entry that has moved by d is at most
d nearer, so a bound less the largest move of its group still holds. Only groups
whose bound does not exceed the distance to the own entry are scanned.

Components are integers and distances are compared as integers, so results do
not depend on bounds, on rounding or on how Spark deals the rows: a bound only
decides what is scanned, and it is rounded down. What is carried is a table in
the shared folder with one row per vector, dealt as the input is: rounds shuffle
sums and counts of entries (entries times parts rows of each task) and nothing
else, and a lost executor costs the tasks of one round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, new_folder, release

#: What components are multiplied by before they are cut to integers.
SCALE = 4096
#: Relative slack of every bound, far over the rounding of doubles and far under what a bound decides.
_SLACK = 1e-9
#: Vectors that one step of a task holds.
_STEP = 8192
#: Distinct labels up to which their sums are broadcast; more of them are joined.
_BROADCAST_LABELS = 1 << 16


@dataclass(frozen=True)
class Codebooks:
    """``entries`` of shape (parts, entries, components of a part), int64, and ``groups``: the group of each entry, shape (parts, entries)."""

    entries: np.ndarray
    groups: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def largest(dim: int) -> int:
    """The largest size of a component with which an error over ``dim`` components surely fits a long."""
    return int(((1 << 62) / (4 * max(dim, 1))) ** 0.5)


def grouped(entries: np.ndarray, n_groups: int) -> np.ndarray:
    """The group of each entry of each codebook: a few Lloyd rounds over the entries themselves, from the first ones that differ."""
    found = np.zeros(entries.shape[:2], np.int64)
    for p, book in enumerate(entries.astype(float)):
        centres = np.unique(book, axis=0)[:: max(1, len(np.unique(book, axis=0)) // n_groups)][:n_groups]
        for _ in range(5):
            near = ((book[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([book[near == g].mean(0) if (near == g).any() else centres[g] for g in range(len(centres))])
        found[p] = near
    return found


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to the rows of ``book``, exact."""
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], 1) if len(book) else np.zeros((len(x), 0), np.int64)


def assign_part(x: np.ndarray, book: np.ndarray, groups: np.ndarray, own: np.ndarray, low: np.ndarray, moved: np.ndarray):
    """Nearest entries of one part of many vectors: (entry, squared distance, new bounds, scanned groups).

    ``own`` is the entry of the round before, ``low`` the bounds by group (at
    most the distance to any entry of the group but ``own``) and ``moved`` how
    far each entry went since. Ties go to the lower index, by integers."""
    own, rows = own.astype(np.int64), np.arange(len(x))
    old, distance = own, ((x - book[own]) ** 2).sum(1)
    best, first = distance.copy(), own.copy()
    n_groups = low.shape[1]
    most = np.array([moved[groups == g].max(initial=0.0) for g in range(n_groups)])
    low = low - most - _SLACK * (np.abs(low) + most)
    reach = np.sqrt(distance.astype(float)) * (1 + _SLACK)
    scanned, inside = 0, np.full((n_groups, len(x)), -1, np.int64)
    exact: dict[int, tuple] = {}
    for g in range(n_groups):
        members = np.flatnonzero(groups == g)
        if not len(members):
            low[:, g] = np.inf
            continue
        at = np.flatnonzero(low[:, g] <= reach)
        scanned += len(at)
        if not len(at):
            continue
        d = _distances(x[at], book[members])
        k = d.argmin(1)
        least, entry = d[np.arange(len(at)), k], members[k]
        wins = (least < best[at]) | ((least == best[at]) & (entry < first[at]))
        best[at[wins]], first[at[wins]] = least[wins], entry[wins]
        inside[g, at] = np.arange(len(at))
        exact[g] = (members, d)
    for g, (members, d) in exact.items():  # bounds of scanned groups: the least distance but that of the entry now owned
        at = np.flatnonzero(inside[g] >= 0)
        others = np.where(members[None] == first[at][:, None], np.iinfo(np.int64).max, d)
        least = others.min(1)
        low[at, g] = np.where(least == np.iinfo(np.int64).max, np.inf, np.sqrt(least.astype(float)) * (1 - _SLACK))
    left = np.flatnonzero(first != old)  # the entry that was left counts for its group again, also where that was not scanned
    g = groups[old[left]]
    low[left, g] = np.minimum(low[left, g], np.sqrt(distance[left].astype(float)) * (1 - _SLACK))
    return first, best, low, scanned


class _State:
    """How what is carried of a vector lies in binary columns: integers, entries, bounds."""

    def __init__(self, parts: int, width: int, n_groups: int):
        self.parts, self.width, self.n_groups = parts, width, n_groups

    def read(self, batch: pa.RecordBatch, names) -> tuple:
        x, code, low = (np.frombuffer(b"".join(batch.column(n).to_pylist()), t) for n, t in zip(names, (np.int32, np.uint8, np.float32), strict=True))
        n = batch.num_rows
        return x.reshape(n, self.parts, self.width).astype(np.int64), code.reshape(n, self.parts), low.reshape(n, self.parts, self.n_groups).astype(float)

    @staticmethod
    def pack(values: np.ndarray) -> pa.Array:
        raw = np.ascontiguousarray(values)
        n = len(raw)
        step = raw.nbytes // n if n else 0
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * step).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _down(low: np.ndarray) -> np.ndarray:
    """Bounds as float32, never above what they were."""
    return np.nextafter(low.astype(np.float32), np.float32(-np.inf))


def _assigned(x, code, low, books: Codebooks, moved: np.ndarray):
    """All parts of a batch: codes, errors, bounds, and how many groups were scanned."""
    codes, bounds, error, scanned = np.empty_like(code), np.empty_like(low), np.zeros(len(x), np.int64), 0
    for p in range(x.shape[1]):
        first, best, bounds[:, p], n = assign_part(x[:, p], books.entries[p], books.groups[p], code[:, p], low[:, p], moved[p])
        codes[:, p] = first
        error += best
        scanned += n
    return codes, error, bounds, scanned


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def kept_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there, without null or non-finite components."""
    return vectors.where(_finite(F.col(f"`{vector}`")))


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(float) * SCALE).astype(np.int64).reshape(len(column), dim)


def _seed(kept: DataFrame, vector: str, vec_id: str, entries: int) -> np.ndarray:
    """Integers of the vectors with the smallest ids; of equal ids the smaller vector first; null ids last."""
    v = F.col(f"`{vector}`")
    rows = kept.select(F.col(f"`{vec_id}`").alias("i"), v.cast("array<double>").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    return np.array([np.floor(np.array(r["v"]) * SCALE) for r in rows])


def _drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _means(state: DataFrame, names, layout: _State, entries: int) -> list:
    """(part, entry, count, sums) over all rows: sums within tasks, then of the tasks; entries times parts rows at the end."""

    def sums(batches):
        total, count = np.zeros((layout.parts, entries, layout.width), np.int64), np.zeros((layout.parts, entries), np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(batch.num_rows, layout.parts, layout.width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, layout.parts)
            for p in range(layout.parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
            release()
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    each = state.select(*names[:2]).mapInArrow(sums, "part long, entry long, n long, sums array<bigint>")
    totals = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(layout.width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect()


def _replaced(books: Codebooks, found: list) -> Codebooks:
    """Every entry that has parts becomes their mean, cut down to integers; the others stay."""
    new = books.entries.copy()
    for r in found:
        new[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(new.shape[2])]
    return Codebooks(new, books.groups)


def compress(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", carry: tuple[str, ...] | None = None,
    parts: int = 8, entries: int = 16, rounds: int = 6, n_groups: int = 4, code: str = "code", error: str = "error", trace: list | None = None,
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of ``vectors`` and the codebooks that were trained on all of them.

    Vectors that are null or hold null or non-finite components are left out.
    The columns ``carry`` (all but the vector, if not given) come back with
    ``code`` (entry indexes in the order of the parts, two hex digits each) and
    ``error`` (squared distances, summed over the parts). Codebooks start as
    the vectors with the smallest ids (fewer than ``entries`` vectors: as many;
    equal ids: the smaller vector first; null ids last).
    The dimension is that of the vector with the smallest id; vectors of
    another one, or with components over ``largest`` (their error could not
    be a long), cannot be coded: they take no part in the training and come
    back with a null code and a null error. A dimension that ``parts`` does not
    divide, or zero, makes all codes null. Repeated rows are coded alike; an
    empty table gives no rows and no codebooks. ``trace`` gets, for each
    assignment, the groups that were scanned and those that there were."""
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("entries are from 1 to 256, for a code of two hex digits")
    carry = tuple(c for c in vectors.columns if c != vector) if carry is None else carry
    clash = [c for c in (code, error) if free_name(carry, c) != c]
    if clash:
        raise ValueError(f"the table already has columns {clash}; name others")
    kept = kept_vectors(vectors, vector)
    own = [F.col(f"`{c}`") for c in carry]
    nothing = [F.lit(None).cast("string").alias(code), F.lit(None).cast("long").alias(error)]
    first = kept.select(F.size(F.col(f"`{vector}`")).alias("dim"), F.col(f"`{vec_id}`").alias("i")).orderBy(F.col("i").asc_nulls_last(), "dim").limit(1).collect()
    dim = first[0]["dim"] if first else 0
    if not dim or dim % parts:
        return kept.select(*own, *nothing), None
    v, bound = F.col(f"`{vector}`"), largest(dim) / SCALE
    fits = (F.size(v) == dim) & F.forall(v, lambda x: F.abs(x) < bound)
    seeds = _seed(kept.where(fits), vector, vec_id, entries)
    if not len(seeds):
        return kept.select(*own, *nothing), None
    width = dim // parts
    layout = _State(parts, width, n_groups)
    start = seeds.astype(np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    books = Codebooks(start, grouped(start, n_groups))
    names = [free_name(carry, n) for n in ("integers", "entries", "bounds")]
    scanned_name = free_name([*carry, *names, error], "scanned")
    prepared = kept.where(fits).select(*own, v.cast("array<double>").alias(names[0]))
    fields = kept.select(*own).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} binary" for n in names] + [f"`{error}` long", f"{scanned_name} long"])
    state, folder = prepared, None
    moved = np.zeros(books.entries.shape[:2])
    for k in range(rounds + 1):

        def task(batches, books=books, moved=moved, fresh=k == 0):
            for whole in batches:
                for at in range(0, whole.num_rows, _STEP):
                    batch = whole.slice(at, _STEP)
                    if fresh:
                        x = _integers(batch.column(len(carry)), dim).reshape(batch.num_rows, parts, width)
                        old, low = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts, n_groups))
                    else:
                        x, old, low = layout.read(batch, names)
                    codes, errors, bounds, scanned = _assigned(x, old, low, books, moved)
                    seen = np.zeros(len(x), np.int64)
                    seen[:1] = scanned
                    arrays = [batch.column(c) for c in range(len(carry))] + [layout.pack(x.astype(np.int32)), layout.pack(codes.astype(np.uint8)), layout.pack(_down(bounds)), pa.array(errors), pa.array(seen)]
                    yield pa.RecordBatch.from_arrays(arrays, [*carry, *names, error, scanned_name])
                release()

        new_state = new_folder(spark, "yinyang")
        state.select(*own, *([F.col(names[0])] if k == 0 else map(F.col, names))).mapInArrow(task, schema).write.parquet(new_state)
        if folder:
            _drop_folder(spark, folder)  # only the table of the last round is read from now on
        folder, state = new_state, spark.read.schema(schema).parquet(new_state)
        if trace is not None:
            r = state.agg(F.sum(scanned_name).alias("s"), F.count("*").alias("n")).head()
            trace.append((r["s"], r["n"] * int(sum(len(set(g)) for g in books.groups.tolist()))))
        if k == rounds:
            break
        new = _replaced(books, _means(state, names, layout, books.entries.shape[1]))
        moved = np.sqrt(((new.entries - books.entries) ** 2).sum(2).astype(float)) * (1 + _SLACK)
        if not moved.any():  # the rounds to come would change nothing
            break
        books = new
    digits = F.lower(F.hex(names[1]))
    coded = state.select(*own, digits.alias(code), F.col(f"`{error}`"))
    return coded.unionByName(kept.where(~fits).select(*own, *nothing)), books


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", into: str = "label_error") -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together.

    The sums are one row a label: they are broadcast while their number, which
    is counted, stays small, and joined else, where a label that a large share
    of the rows has is split by adaptive execution."""
    name, key = free_name(coded.columns, "label_key"), F.col(f"`{label}`")
    sums = coded.groupBy(key.alias(name)).agg(F.sum(f"`{error}`").alias(into))
    few = sums.select(name).limit(_BROADCAST_LABELS + 1).count() <= _BROADCAST_LABELS
    return coded.join(F.broadcast(sums) if few else sums, key.eqNullSafe(F.col(name)), "left").drop(name)


def op11_yinyang_codes(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    coded, books = compress(vectors)
    sha = F.lit(books.sha256() if books else None).cast("string")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """SQL of the rounds without bounds: every part against every entry."""
    floor = "(s - ((s % n) + n) % n) // n"
    rules = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, (k // w)::INTEGER AS p, (k % w)::INTEGER AS j, floor(4096 * embedding[k + 1]::DOUBLE)::BIGINT AS v
  FROM (SELECT r, w, embedding, unnest(range(len(embedding))) AS k FROM kept)
), b0 AS MATERIALIZED (
  SELECT p, (r - 1)::INTEGER AS e, j, v AS c FROM x WHERE r <= {entries}
)"""]
    for k in range(rounds + 1):
        rules.append(f"""
d{k} AS (
  SELECT r, x.p, e, sum((v - c) * (v - c))::BIGINT AS d FROM x JOIN b{k} b ON b.p = x.p AND b.j = x.j GROUP BY r, x.p, e
), a{k} AS MATERIALIZED (
  SELECT r, p, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM d{k} GROUP BY r, p
)""")
        if k < rounds:
            rules.append(f"""
m{k} AS (
  SELECT p, e, j, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} USING (r, p) GROUP BY p, e, j
), b{k + 1} AS MATERIALIZED (
  SELECT p, e, j, coalesce({floor}, c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e, j)
)""")
    return f"""
WITH {",".join(rules)}, coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r
), books AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r) CROSS JOIN books
"""


OP11_SQL = _sql()
