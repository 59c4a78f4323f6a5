"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score (then from
the left); the best pair is merged and its new neighbours join the agenda,
until no pair is a piece. Merges cannot cross from a word into the white space
after it unless a piece does so; texts are therefore cut at those places. The
agendas of the distinct parts of some texts are rows of a matrix and are worked
off in step; a long part has a heap as its agenda. Frequent parts stay known,
within a bound in bytes. Every part that is newly merged is checked against the
sentencepiece library, some hundred a call; should they ever differ, the
library's ids are used.

The operator is narrow: nothing is shuffled; copies and hot sources cost what
other rows cost. Null texts count as empty, empty texts have no ids, long
texts are cut into sections of about 0.5 MB at word starts, repeated rows are
encoded independently, an empty table stays empty, other columns pass through.
"""

from __future__ import annotations

import gc
import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

SPACE = "▁"
_REMEMBERED_BYTES = 12 << 20
_PART = 1 << 19
_LONG = 48
_ROWS, _CHECKED = 4096, 256
_PLACES = 64  # more than any part in step has
_NONE, _END = (1 << 25) - 1, (1 << 31) - 1



class MergeVocabulary:
    """The pieces of a merge-type model and its agenda."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            data = f.read()
        model = pb.ModelProto()
        model.ParseFromString(data)
        spec = model.normalizer_spec
        kinds = pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or not spec.escape_whitespaces or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("a merge-type vocabulary with identity normalisation and ordinary pieces is needed")
        if spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space must be kept, and stand before words")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        self.cost = {p.piece: -p.score for _, p in normal}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.beside = {p.piece[k : k + 2] for _, p in normal for k in range(len(p.piece) - 1)}
        if any(x[1] == SPACE and x[0] != SPACE for x in self.beside):
            raise ValueError("pieces must not run from a word into white space")
        alone = "" if any("\n" in x for x in self.beside) else "\n"
        self.parts = re.compile(f"{alone}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, part: str) -> list[int]:
        """The ids of one part, by the agenda."""
        symbols, cost = list(part), self.cost
        n = len(symbols)
        agenda = [(cost[p], i, i + 1, 2) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in cost]
        if agenda:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heapify(agenda)
            while agenda:
                _, i, j, size = heappop(agenda)
                left, right = symbols[i], symbols[j]
                if not left or not right or len(left) + len(right) != size:
                    continue
                merged = left + right
                symbols[i], symbols[j] = merged, ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (p := merged + symbols[k]) in cost:
                        heappush(agenda, (cost[p], i, k, len(p)))
                k = before[i]
                if k >= 0 and (p := symbols[k] + merged) in cost:
                    heappush(agenda, (cost[p], k, i, len(p)))
        out, unknown = [], False
        for s in symbols:
            if not s:
                continue
            if (i := self.ids.get(s)) is not None:
                out.append(i)
                unknown = False
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode("utf-8"))
            else:
                if not unknown:
                    out.append(self.unknown)
                unknown = True
        return out


class Agenda:
    """The agendas of many parts, kept as rows of a matrix and worked off in step: in each step every part merges its best pair."""

    def __init__(self, vocabulary: MergeVocabulary):
        chars = {c for p in vocabulary.ids for c in p}
        symbols = [*vocabulary.ids, *sorted(chars - set(vocabulary.ids))]
        number = {s: k for k, s in enumerate(symbols)}
        # The last symbol stands for what is in no piece.
        self.ids = np.array([*(vocabulary.ids.get(s, -1) for s in symbols), -1], np.int32)
        order = {c: k for k, c in enumerate(sorted(set(vocabulary.cost.values())))}
        self.rank = np.array([*(order.get(vocabulary.cost.get(s), _NONE) for s in symbols), _NONE], np.int32)
        self.n = len(symbols) + 1
        self.of_char = np.full(0x110000, self.n - 1, np.int32)
        for c in chars:
            self.of_char[ord(c)] = number[c]
        pairs = {}
        for p in vocabulary.ids:
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    pairs[number[p[:k]] * self.n + number[p[k:]]] = number[p]
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.bits = max(4, len(pairs).bit_length() + 1)
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        values, left, slot = np.fromiter(pairs.values(), np.int32, len(pairs)), np.arange(len(pairs)), self._slot(keys)
        while len(left):
            at = slot[left]
            empty = self.keys[at] < 0
            self.keys[at[empty]] = keys[left[empty]]  # of several keys for one slot the last stays
            done = self.keys[at] == keys[left]
            self.merged[at[done]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _entries(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol that each pair makes (0 where none), and its rank (``_NONE`` where none)."""
        keys = a.astype(np.int64) * self.n + b
        slot = self._slot(keys)
        found = self.keys[slot]
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (1 << self.bits) - 1
            at = slot[left]
            left = left[(self.keys[at] != keys[left]) & (self.keys[at] >= 0)]
        made = np.where(self.keys[slot] == keys, self.merged[slot], self.n - 1)
        return made, self.rank[made]

    def merge(self, parts: list[str]) -> list[tuple[int, ...] | None]:
        """The ids of each part; None if a symbol that is no piece is left.

        A column of the matrices is a part. An entry of the agenda is the rank of a pair and, in its last bits, the
        place of its first symbol, so the smallest entry is the best pair, the leftmost of equals."""
        n, sizes = len(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        most = int(sizes.max())
        places = np.arange(most)[:, None]
        inside = places < sizes
        symbols = np.full((most + 1, n), self.n - 1, np.int32)
        symbols[:-1].T[inside.T] = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
        after = np.repeat(np.arange(1, most + 2, dtype=np.int32)[:, None], n, 1)
        before = after - 2
        made, rank = (x.reshape(most, n) for x in self._entries(symbols[:-1].ravel(), symbols[1:].ravel()))
        agenda = rank * np.int32(_PLACES) + places.astype(np.int32)
        agenda[rank == _NONE] = _END
        going, out = np.arange(n), [None] * n
        while most > 1 and len(going):
            best = agenda.min(0)
            if len(more := np.flatnonzero(best != _END)) < 0.7 * len(going):
                self._finish(going, symbols, sizes, out, np.flatnonzero(best == _END))
                going, symbols, after, before, made, agenda, best = going[more], *(np.ascontiguousarray(x[:, more]) for x in (symbols, after, before, made, agenda)), best[more]
                more = np.arange(len(going))
                if not len(going):
                    break
            width = len(going)
            at = (best[more] % _PLACES).astype(np.int64)
            here = at * width + more
            flat_symbols, flat_after, flat_before, flat_made, flat_agenda = (x.reshape(-1) for x in (symbols, after, before, made, agenda))
            right = flat_after[here].astype(np.int64)
            gone = right * width + more
            beyond = flat_after[gone].astype(np.int64)
            flat_symbols[here] = flat_made[here]
            flat_symbols[gone] = -1
            flat_after[here] = beyond
            flat_agenda[gone[right < most]] = _END
            flat_before[beyond * width + more] = at
            for first, second in ((at, beyond), (flat_before[here].astype(np.int64), at)):
                real = np.flatnonzero((first >= 0) & (second < most))
                none = np.flatnonzero((first >= 0) & (second >= most))
                place = first[real] * width + more[real]
                new, rank = self._entries(flat_symbols[place], flat_symbols[second[real] * width + more[real]])
                flat_made[place] = new
                flat_agenda[place] = np.where(rank == _NONE, _END, rank * np.int32(_PLACES) + first[real].astype(np.int32))
                flat_agenda[first[none] * width + more[none]] = _END
        self._finish(going, symbols, sizes, out, np.arange(len(going)))
        return out

    def _finish(self, going, symbols, sizes, out, columns) -> None:
        """Writes what the parts in ``columns`` have become to ``out``."""
        some = going[columns]
        table = symbols[:-1, columns].T
        left = (np.arange(table.shape[1]) < sizes[some][:, None]) & (table >= 0)
        pieces = self.ids[table]
        whole = ~((pieces < 0) & left).any(1)
        flat, at = pieces[left].tolist(), 0
        for part, size, good in zip(some.tolist(), left.sum(1).tolist(), whole.tolist(), strict=True):
            if good:
                out[part] = tuple(flat[at : at + size])
            at += size


class _Memory(dict):
    """Parts to ids. Parts of over ``_LONG`` characters are not remembered; of the others about two times ``_REMEMBERED_BYTES`` are."""

    def __init__(self, vocabulary: MergeVocabulary):
        super().__init__()
        self.vocabulary, self.agenda, self.older, self.bytes, self.long = vocabulary, Agenda(vocabulary), {}, 0, []
        self.apart = not any("\n" in x for x in vocabulary.beside)  # then parts between line feeds do not touch
        self.lead = vocabulary.library.encode("\n")
        self.between = vocabulary.library.encode("\n\n")[len(self.lead) :]

    def learn(self, parts) -> None:
        """Makes every part of ``parts`` known until ``forget`` is called; what is merged anew is checked against the library."""
        lacking = set(parts).difference(self)
        known = lacking.intersection(self.older)
        self._keep(known, map(self.older.__getitem__, known))
        new = sorted(lacking.difference(known), key=len)
        at = 0
        while at < len(new):
            size = len(new[at])
            if size > _LONG:
                self.long = new[at:]
                self.update((part, self._of_long(part)) for part in self.long)
                break
            end = at
            while end < len(new) and len(new[end]) <= size + size // 4 and end - at < _ROWS:
                end += 1
            some = new[at:end]
            self._keep(some, (ids if ids is not None else tuple(self.vocabulary.merge(part)) for part, ids in zip(some, self.agenda.merge(some), strict=True)))
            at = end
        for at in range(0, len(new), _CHECKED):
            self._check(new[at : at + _CHECKED])

    def _keep(self, parts, ids) -> None:
        self.update(zip(parts, ids, strict=True))
        self.bytes += 300 * len(parts)  # about what a short part, its ids and its place take

    def _check(self, parts: list[str]) -> None:
        """Compares the parts with the library, at first all in one text; after a line feed no white space is put before a part."""
        library, lead = self.vocabulary.library, self.lead
        if self.apart:
            own = [*lead, *chain.from_iterable(chain.from_iterable(zip(repeat(self.between), map(self.__getitem__, parts))))]  # noqa: B905
            if library.encode("\n" + "\n" + "\n".join(parts).replace(SPACE, " "), num_threads=1) == own:
                return
        for part, ids in zip(parts, library.encode(["\n" + x.replace(SPACE, " ") for x in parts], num_threads=1), strict=True):
            if list(self[part]) != ids[len(lead) :]:
                self[part] = tuple(ids[len(lead) :])

    def _of_long(self, part: str) -> tuple[int, ...]:
        """Merged between neighbours that stand side by side in no piece."""
        beside, out, at = self.vocabulary.beside, [], 0
        if not self.vocabulary.bytes:
            return tuple(self.vocabulary.merge(part))  # neighbouring unknown characters make one id
        for k in range(1, len(part) + 1):
            if k == len(part) or part[k - 1 : k + 1] not in beside:
                out += self.vocabulary.merge(part[at:k])
                at = k
        return tuple(out)

    def forget(self) -> None:
        """Drops long parts, and the older half of what is remembered if that is too much."""
        for part in self.long:
            del self[part]
        self.long = []
        if self.bytes > _REMEMBERED_BYTES:
            self.older, self.bytes = dict(self), 0
            self.clear()


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = MergeVocabulary(path)
        self.memory = _Memory(self.vocabulary)
        self.numerals = list(map(str, range(self.vocabulary.library.get_piece_size())))

    def _sections(self, text: str):
        """Normalised text in sections that begin at words."""
        text = self.vocabulary.prefix + text.replace(" ", SPACE)
        at = 0
        while at < len(text):
            end = min(at + _PART, len(text))
            while end < len(text) and not (text[end] == SPACE and text[end - 1] != SPACE):
                end += 1
            yield text[at:end]
            at = end

    def encode_batch(self, texts) -> list[list[int]]:
        """The ids of each text; null texts have none. Parts are learned for about ``_PART`` characters at a time."""
        find, known = self.vocabulary.parts.findall, self.memory
        out: list[list[int]] = []
        held: list[tuple[list[int], list[str]]] = []
        size = 0

        def flush():
            known.learn(chain.from_iterable(parts for _, parts in held))
            for ids, parts in held:
                ids.extend(chain.from_iterable(map(known.__getitem__, parts)))
            known.forget()
            held.clear()

        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and there are many small objects
        try:
            for text in texts:
                out.append([])
                for section in self._sections(text) if text else ():
                    held.append((out[-1], find(section)))
                    size += len(section)
                    if size >= _PART:
                        flush()
                        size = 0
            flush()
        finally:
            if collects:
                gc.enable()
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decimal(self, ids: list[int]) -> bytes:
        """Decimal ids joined by commas."""
        return ",".join(map(self.numerals.__getitem__, ids)).encode()

    def decode_batch(self, ids) -> list[str]:
        return self.vocabulary.library.decode([x or [] for x in ids], num_threads=1)


def _slices(texts: pa.Array):
    """(begin, end) of runs of texts of about ``_PART`` bytes in all."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)) if len(texts) else []
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _PART, "right")))
        yield at, end
        at = end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each model in a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text (no begin or end ids)."""
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}; name another")

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        own, kind = encoder(model), pa.list_(pa.int32())
        return pa.concat_arrays([pa.array([], kind), *(pa.array(own.encode_batch(texts[at:end].to_pylist()), kind) for at, end in _slices(texts))])

    return docs.withColumn(into, run(F.col(f"`{text}`")))


def decode(docs: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for; null ids give an empty text."""
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}; name another")

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array(encoder(model).decode_batch(lists.to_pylist()), pa.string())

    return docs.withColumn(into, run(F.col(f"`{ids}`")))


def encode_and_decode(docs: DataFrame, model: str, text: str = "text", into: str = "pieces", keep_ids: bool = True) -> DataFrame:
    """``docs`` with a struct of n_tokens, ids (if kept), ids_sha256 (decimal ids joined by commas) and decoded_sha256.

    Ids are decoded where they are made, so decoded texts stay in the Arrow batch."""
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}; name another")
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>" * keep_ids + ">")
    def run(texts: pa.Array) -> pa.Array:
        own, columns = encoder(model), [[] for _ in fields]
        for at, end in _slices(texts):
            lists = own.encode_batch(texts[at:end].to_pylist())
            for ids, back in zip(lists, own.decode_batch(lists), strict=True):
                columns[0].append(len(ids))
                columns[1].append(hashlib.sha256(own.decimal(ids)).hexdigest())
                columns[2].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            if keep_ids:
                columns[3].append(pa.array(lists, pa.list_(pa.int32())))
        if keep_ids:
            columns[3] = pa.concat_arrays(columns[3]) if columns[3] else []
        release()
        return pa.StructArray.from_arrays([pa.array(c, kind) if isinstance(c, list) else c for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return docs.withColumn(into, run(F.col(f"`{text}`")))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    p = F.col("pieces")
    return encode_and_decode(docs, default_model(), keep_ids=False).select("doc_id", p["n_tokens"].alias("n_tokens"), p["ids_sha256"].alias("ids_sha256"), p["decoded_sha256"].alias("decoded_sha256"))
