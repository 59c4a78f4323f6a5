"""Language identification by n-gram filters that answer for all languages at once.

Each language has a Bloom filter of its n-grams. The filters are bit-sliced: a
slot holds one word whose bit l belongs to language l, so the slots of an n-gram,
joined by AND, give the mask of all languages that hold it. A text is decided by
counting, for each language, the n-grams whose mask has its bit, less what its
filter would let through by chance.

N-grams are runs of bytes of the text in lower case, everything but letters and
marks made one space, so they also tell where words begin and end. A language
holds an n-gram if a large enough share of its documents does, also against the
language in which it is most common: documents that mix languages, or carry the
same notice in all of them, do not spoil the filters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, release

#: Lengths of n-grams in bytes, eight at most.
SIZES = (3, 4)
#: Slots of the filters, as a power of two, and the slots that an n-gram sets.
SLOT_BITS, HASHES = 19, 4
#: Labelled documents that are learned from in each language, about; chosen by a hash of their ids. The fit is bounded by this.
LEARN_DOCS = 5000
#: Languages that are learned: those with the most labelled documents.
MOST_LANGUAGES = 1024
#: A language holds an n-gram that this share of its documents has, and this share of the share in the language where it is most common.
LEAST_SHARE, OF_MOST = 0.002, 0.5
UNDECIDED = "und"
#: Languages of one word of a slot.
_WORD = 64
#: Odd multipliers of the slots of an n-gram.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes of text that one step of a task holds.
_STEP_BYTES = 1 << 20


def letters(text: Column) -> Column:
    """The text in lower case between spaces, everything but letters and marks one space; a null text stays null."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def held_out(doc_id: Column, of: int = 4, rest: int = 2) -> Column:
    """Whether a document is kept out of learning, by the CRC-32 of its id as text; a null id is not (and is not learned from, see ``learn``)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == rest, F.lit(False))


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text numbers) of all n-grams of ``size`` bytes that lie within one text of a buffer."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    counts = np.maximum(ends - starts - size + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    return key[at] | np.uint64(size) << np.uint64(60) if size < 8 else key[at], text


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, step: int):
    """``_grams`` of a buffer by pieces of ``step`` bytes, each n-gram once, so that what is held does not grow with a text."""
    for low in range(0, len(data), step):
        high = min(len(data), low + step + size - 1)
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        keys, text = _grams(data[low:high], np.maximum(starts[first:last], low) - low, np.minimum(ends[first:last], high) - low, size)
        yield keys, text + first


def slots(keys: np.ndarray, slot_bits: int = SLOT_BITS, hashes: int = HASHES) -> np.ndarray:
    """Slots of n-grams, shape (hashes, n)."""
    mixed = keys ^ (keys >> np.uint64(29))
    return np.stack([((mixed * odd) ^ ((mixed * odd) >> np.uint64(31))) * _ODD[0] >> np.uint64(64 - slot_bits) for odd in _ODD[:hashes]]).astype(np.int64)


def _steps(column: pa.Array):
    """(first row, bytes, starts, ends) of runs of texts of about _STEP_BYTES, whole texts only; nulls are empty."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    row = 0
    while row < len(column):
        until = max(row + 1, int(np.searchsorted(ends, ends[row] + _STEP_BYTES, "right")) - 1)
        base = ends[row]
        starts, stops = ends[row:until] - base, np.where(valid[row:until], ends[row + 1 : until + 1], ends[row:until]) - base
        yield row, data[base : ends[until]], starts, stops
        row = until


@dataclass(frozen=True)
class Filters:
    """``languages`` in the order of their bits (most labelled documents first), the slots ``masks`` (one row a word of languages) and what a language's filter lets through by chance, ``chance``."""

    languages: tuple[str, ...]
    masks: np.ndarray
    chance: np.ndarray
    slot_bits: int
    hashes: int
    sizes: tuple[int, ...]

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """Masks of the languages that hold each n-gram, shape (words, n)."""
        found = None
        for at in slots(keys, self.slot_bits, self.hashes):
            found = self.masks[:, at] if found is None else found & self.masks[:, at]
        return found

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, n-grams of each text by language)."""
        total, by_language = np.zeros(len(starts), np.int64), np.zeros((len(self.languages), len(starts)), np.int64)
        for keys, text in (x for size in self.sizes for x in _pieces(data, starts, ends, size, _STEP_BYTES)):
            total += np.bincount(text, minlength=len(starts))
            masks = self.containing(keys)
            for k in range(len(self.languages)):
                bit = (masks[k // _WORD] >> masks.dtype.type(k % _WORD)) & masks.dtype.type(1)
                by_language[k] += np.bincount(text[bit.astype(bool)], minlength=len(starts))
        return total, by_language

    def decide(self, total: np.ndarray, by_language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language numbers, scores): the largest corrected share of n-grams; ties go to the language with more labelled documents."""
        share = by_language / np.maximum(total, 1)
        right = np.clip((share - self.chance[:, None]) / (1 - self.chance[:, None]), 0, 1)
        best = right.argmax(0)
        return best, right[best, np.arange(len(best))]


def _learned(docs: DataFrame, text: str, language: str, doc_id: str, most: int) -> tuple[list[str], list[int], DataFrame]:
    """Languages and their numbers of labelled documents, most first, and the labelled documents."""
    own = {c: F.col(f"`{c}`") for c in (text, language, doc_id)}
    labelled = docs.where(own[doc_id].isNotNull() & ~held_out(own[doc_id]) & own[language].isNotNull() & own[text].isNotNull())
    sizes = labelled.groupBy(own[language].alias("language")).count().orderBy(F.desc("count"), "language").limit(most).collect()
    return [r["language"] for r in sizes], [r["count"] for r in sizes], labelled


def _distinct(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram of a text once."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))[: len(keys)]
    return keys[new], text[new]


def _gram_counts(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(language, gram, n): how many texts hold each n-gram; counted within batches before it is shuffled. texts: language number, letters."""

    def count(batches):
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, starts, ends in _steps(batch.column(1)):
                pairs = []
                for size in sizes:
                    found = [_distinct(keys, text) for keys, text in _pieces(data, starts, ends, size, _STEP_BYTES)]
                    keys, text = _distinct(*map(np.concatenate, zip(*found, strict=True))) if len(found) > 1 else found[0] if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    pairs.append((number[row + text], keys))
                language, gram = map(np.concatenate, zip(*pairs, strict=True))
                order = np.lexsort((gram, language))
                language, gram = language[order], gram[order]
                new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (language[1:] != language[:-1]))[: len(gram)])
                n = np.diff(np.append(new, len(gram)))
                yield pa.RecordBatch.from_arrays([pa.array(language[new].astype(np.int32)), pa.array(gram[new].view(np.int64)), pa.array(n)], ["language", "gram", "n"])
            release()

    return texts.mapInArrow(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


def members(counts: DataFrame, docs_of: list[int], least: float, of_most: float) -> DataFrame:
    """The n-grams (language, gram) that a language holds; once is never enough."""
    share = F.col("n") / F.get(F.array(*map(F.lit, docs_of)), F.col("language"))
    shares = counts.withColumn("share", share)
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    enough = (F.col("n") >= 2) & (F.col("share") >= least) & (F.col("share") >= F.col("top") * of_most)
    return shares.join(top, "gram").where(enough).select("language", "gram")


def learn(
    docs: DataFrame, text: str = "text", language: str = "lang", doc_id: str = "doc_id", learn_docs: int = LEARN_DOCS, most_languages: int = MOST_LANGUAGES,
    sizes: tuple[int, ...] = SIZES, slot_bits: int = SLOT_BITS, hashes: int = HASHES, least: float = LEAST_SHARE, of_most: float = OF_MOST,
) -> Filters | None:
    """Filters of the languages of the labelled documents (text and language not null, id not held out, not null); None if there are none.

    Of a language with more than ``learn_docs`` labelled documents about so many
    are learned from, by a hash of their ids; with few, an n-gram still needs
    two documents unless the language has one only. What reaches the driver is
    one row per language and one per slot."""
    if not 0 < slot_bits <= 24 or not 0 < hashes <= len(_ODD) or not all(1 <= s < 8 for s in sizes):
        raise ValueError("up to 24 slot bits, up to 4 hashes and n-grams of 1 to 7 bytes")
    languages, n_docs, labelled = _learned(docs, text, language, doc_id, most_languages)
    if not languages:
        return None
    spark = docs.sparkSession
    limits = [(name, k, min(1.0, learn_docs / n)) for k, (name, n) in enumerate(zip(languages, n_docs, strict=True))]
    table = spark.createDataFrame(limits, "learned string, number int, share double")
    picked = F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    texts = labelled.select(F.col(f"`{doc_id}`"), F.col(f"`{language}`").cast("string").alias("learned"), F.col(f"`{text}`").alias("learned_text"))
    texts = texts.join(F.broadcast(table), "learned").where(picked).select("number", letters(F.col("learned_text")).alias("letters"))
    chosen = cut(texts)  # few: learn_docs a language
    found = dict(chosen.groupBy("number").count().collect())
    docs_of = [found.get(k, 0) for k in range(len(languages))]
    lonely = F.col("language").isin([k for k, n in enumerate(docs_of) if n == 1] or [-1])
    counts = _gram_counts(chosen, sizes).withColumn("n", F.when(lonely, F.lit(2)).otherwise(F.col("n")))
    kept = members(counts, [max(1, n if n != 1 else 2) for n in docs_of], least, of_most)

    def positions(batches):
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            at = slots(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), slot_bits, hashes)
            bit = np.int64(1) << (number % _WORD).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(number // _WORD, hashes).astype(np.int32)), pa.array(at.ravel()), pa.array(np.tile(bit, hashes))], ["word", "slot", "mask"])

    by_slot = kept.mapInArrow(positions, "word int, slot long, mask long").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    words = -(-len(languages) // _WORD)
    kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint32 if len(languages) <= 32 else np.uint64
    masks = np.zeros((words, 1 << slot_bits), kind)
    masks[by_slot["word"].to_numpy(), by_slot["slot"].to_numpy()] = by_slot["mask"].to_numpy().view(np.uint64).astype(kind)
    fill = np.array([((masks[k // _WORD] >> kind(k % _WORD)) & kind(1)).mean() for k in range(len(languages))])
    return Filters(tuple(languages), masks, np.minimum(fill**hashes, 0.999), slot_bits, hashes, tuple(sizes))


def identify(docs: DataFrame, filters: Filters | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score: the corrected share of the text's n-grams that the language holds, 0 to 1.

    Only the text decides. A null text, one without a letter, and any text if
    nothing was learned is ``und`` with score 0. A text with letters always
    gets a learned language; if no language holds any of its n-grams, the one
    with the most labelled documents."""
    clash = [c for c in into if free_name(docs.columns, c) != c]
    if clash:
        raise ValueError(f"the table already has columns {clash}; name others")
    if filters is None:
        return docs.withColumns({into[0]: F.lit(UNDECIDED), into[1]: F.lit(0.0)})
    own, name = docs.columns, free_name([*docs.columns, *into], "letters")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # masks: 2**slot_bits words for each 64 languages
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def predict(batches):
        f = shared.value
        names = np.array([*f.languages, UNDECIDED], object)
        for batch in batches:
            lang, score = np.full(batch.num_rows, len(f.languages)), np.zeros(batch.num_rows)
            for row, data, starts, ends in _steps(batch.column(len(own))):
                lettered = ends - starts > 2
                best, right = f.decide(*f.counts(data, starts, ends))
                to = row + len(starts)
                lang[row:to], score[row:to] = np.where(lettered, best, len(f.languages)), np.where(lettered, right, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(names[lang], pa.string()), pa.array(score)], [*own, *into])
            release()

    prepared = docs.withColumn(name, F.when(F.col(f"`{text}`").rlike(r"\p{L}"), letters(F.col(f"`{text}`"))))
    return prepared.mapInArrow(predict, ", ".join([*fields, f"`{into[0]}` string", f"`{into[1]}` double"]))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = learn(docs)
    named = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    text = F.col("text")
    shown = named.select("doc_id", "held_out", F.when(text.rlike(r"\p{L}"), letters(text)).alias("letters"))
    return identify(shown, filters, "letters").select("doc_id", "held_out", "lang_pred", "score")
