"""Text, time and number functions of captions and lyrics, as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three tokenisers that differ on purpose: lyric words with inner marks, word characters, letters and digits.
WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
WORD_CHARS = r"[\p{L}\p{N}_]+"
LETTERS = r"[\p{L}\p{N}]+"
#: Accented letters of Portuguese, English, French, German and Spanish and their bases.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüýÿçñ"
BASE = "aaaaaaeeeeiiiiooooouuuuyycn"


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def comparison_key(word: Column) -> Column:
    """Lower case without accents and marks; ß becomes ss. For the five languages above."""
    return F.regexp_replace(F.translate(F.replace(F.lower(word), F.lit("ß"), F.lit("ss")), ACCENTED, BASE), r"[^\p{L}\p{N}]", "")


def comparison_keys(words: Column) -> Column:
    """``comparison_key`` of each word of an array of tokens, all in one pass: they are joined by line feeds, which no token holds."""
    joined = F.translate(F.replace(F.lower(F.array_join(words, "\n")), F.lit("ß"), F.lit("ss")), ACCENTED, BASE)
    return F.when(F.size(words) > 0, F.split(F.regexp_replace(joined, r"[^\p{L}\p{N}\n]", ""), "\n")).when(words.isNotNull(), F.array().cast("array<string>"))


def accented_key(word: Column) -> Column:
    """Lower case with accents, letters and digits only."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def exact_key(word: Column) -> Column:
    """comparison_key for every script: case folding and decomposition have no built-in function."""

    @F.arrow_udf("string")
    def keys(words: pa.Array) -> pa.Array:
        fold = lambda w: "".join(c for c in unicodedata.normalize("NFD", w.casefold()) if c.isalnum())
        return pa.array([None if w is None else fold(w) for w in words.to_pylist()], pa.string())

    return keys(word)


def sentence_case(text: Column) -> Column:
    """All lower case but the first letter."""
    low = F.lower(text)
    lead = F.regexp_extract(low, r"^[^\p{L}]*", 0)
    n = F.char_length(lead)
    return F.concat(lead, F.upper(F.substring(low, n + 1, F.lit(1))), F.substring(low, n + 2, F.char_length(low)))


#: White space of any script, and the controls that separate.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def resolved(text: Column, composed: bool = True) -> Column:
    """Character references (numbers, and all names, with or without their semicolon where that is allowed) as their characters; then NFC if ``composed``.

    No built-in function knows the names or composes marks, so texts that need it (an ampersand, or a character from
    U+0300 on) go through an Arrow function; the others stay where they are."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        form = (lambda t: unicodedata.normalize("NFC", t)) if composed else str
        return pa.array([None if t is None else form(html.unescape(t)) for t in texts.to_pylist()], pa.string())

    needs = text.rlike(r"&|[^\x00-\x{2FF}]" if composed else "&")
    return F.when(needs, run(F.when(needs, text))).otherwise(text)


def composed(text: Column) -> Column:
    """NFC; texts below U+0300 are composed already."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    needs = text.rlike(r"[^\x00-\x{2FF}]")
    return F.when(needs, run(F.when(needs, text))).otherwise(text)


def _untagged(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\{\\[^}]*\}", "")


def clean_markup(text: Column) -> Column:
    """Character references resolved, composed (NFC); tags, {\\…} commands and byte order marks dropped, note signs spaces; spaces collapsed."""
    signs = F.translate(_untagged(resolved(text)), "♪♫\ufeff", "  ")
    return F.trim(F.regexp_replace(signs, SPACES, " "))


def plain_markup(text: Column) -> Column:
    """As ``clean_markup``, but nothing is composed, and note signs stay."""
    return F.trim(F.regexp_replace(_untagged(resolved(text, False)), SPACES, " "))


def plain_text(raw: str, compose: bool = True) -> str:
    """``clean_markup`` of one text (``plain_markup`` without ``compose``), for readers that work file by file."""
    text = html.unescape(raw)
    text = re.sub(r"<[^>]*>", "", unicodedata.normalize("NFC", text) if compose else text)
    text = re.sub(r"\{\\[^}]*\}", "", text)
    return " ".join((text.translate({0x266A: " ", 0x266B: " ", 0xFEFF: None}) if compose else text).split())


def milliseconds(stamp: Column) -> Column:
    """H+:MM:SS,mmm (or .mmm) as milliseconds; null unless minutes and seconds are below 60."""
    part = lambda k: F.nullif(F.regexp_extract(stamp, r"^\s*(\d+):([0-5]\d):([0-5]\d)[,.](\d{3})\s*$", k), F.lit("")).cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def human_time(text: Column) -> Column:
    """s, mm:ss,mmm or hh:mm:ss,mmm as seconds; only the first part may exceed 59."""
    clean = F.replace(F.trim(text), F.lit(","), F.lit("."))
    parts = F.reverse(F.split(clean, ":"))
    rest = F.slice(parts, 1, F.size(parts) - 1)
    ok = clean.rlike(r"^\d+(:\d+){0,2}(\.\d+)?$") & F.forall(rest, lambda p: p.try_cast("double") < 60)
    return F.when(ok, F.round(F.aggregate(F.transform(parts, lambda p, i: p.try_cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x), 3))


def half_even_ms(seconds: Column) -> Column:
    return F.rint(seconds * 1000).cast("long")


def half_up_ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + 0.5).cast("long")


def timestamp_text(ms: Column, separator: str = ",") -> Column:
    """Milliseconds as HH:MM:SS,mmm; hours are unbounded."""
    whole = lambda n: F.floor(ms / n)
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms % 1000)


def short_time_text(ms: Column) -> Column:
    """Milliseconds as MM:SS,mmm, with hours only from the first hour on."""
    whole = lambda n: F.floor(ms / n)
    return F.when(ms >= 3_600_000, timestamp_text(ms)).otherwise(F.format_string("%02d:%02d,%03d", whole(60_000), whole(1000) % 60, ms % 1000))


def finite(value: Column) -> Column:
    """The number, or null where it is not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def score_of(value: Column) -> Column:
    """A finite number from 0 to 1, else null."""
    return F.when((finite(value) >= 0) & (finite(value) <= 1), value)


def midi_of(hertz: Column) -> Column:
    return F.when(hertz > 0, 69 + 12 * F.log2(hertz / 440))


def midi_name(pitch: Column) -> Column:
    names = F.array(*[F.lit(x) for x in "C C# D D# E F F# G G# A A# B".split()])
    return F.concat(F.get(names, F.pmod(pitch, F.lit(12)).cast("int")), (F.floor(pitch / 12) - 1).cast("string"))


def valid_file_name(name: Column) -> Column:
    """Not empty, no path separators, reserved characters or trailing dot."""
    return F.coalesce(name.rlike(r'^[^<>:"/\\|?*\x00-\x1F]*[^<>:"/\\|?*\x00-\x1F. ]$'), F.lit(False))


def midi_file_name(name: Column) -> Column:
    trimmed = F.trim(name)
    return F.when(F.lower(trimmed).endswith(".mid"), trimmed).otherwise(F.concat(trimmed, F.lit(".mid")))


def is_audio(path: Column) -> Column:
    #: Audio suffixes.
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(".wav", ".mp3", ".flac", ".m4a", ".ogg", ".aac", ".wma")


def identity(parts: Column) -> Column:
    """A content address of a map of names to values: the order of names does not matter."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parts)))), 256)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (len a + len b), 1 for two empty texts."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        known = np.flatnonzero((left.is_valid().to_numpy(zero_copy_only=False)) & (right.is_valid().to_numpy(zero_copy_only=False)))
        out = np.full(len(left), np.nan)
        out[known] = indel_pairs(left.take(pa.array(known)).to_pylist(), right.take(pa.array(known)).to_pylist())
        return pa.array(out, pa.float64(), from_pandas=True)

    return run(a, b)


def indel_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """The Indel ratio of each pair; pairs whose shorter text has up to 64 characters go in step, one bit vector each."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.ones(len(sizes))
    short, long = sizes.min(1, initial=1 << 40), sizes.max(1, initial=0)
    for k in np.flatnonzero((short > 64) & (long > 0)).tolist():
        out[k] = indel(a[k], b[k])
    rows = np.flatnonzero((short <= 64) & (long > 0))
    rows = rows[np.argsort(long[rows], kind="stable")]
    for at in range(0, len(rows), 2048):
        some = rows[at : at + 2048]
        swap = sizes[some, 0] > sizes[some, 1]
        less = [b[k] if s else a[k] for k, s in zip(some.tolist(), swap.tolist(), strict=True)]
        more = [a[k] if s else b[k] for k, s in zip(some.tolist(), swap.tolist(), strict=True)]
        x, y = _codes(less, 64, 0xFFFFFFFF), _codes(more, int(long[some].max()), 0xFFFFFFFE)
        full = np.where(short[some] >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(short[some], 63).astype(np.uint64)) - np.uint64(1))
        state = full.copy()
        for j in range(y.shape[1]):
            hit = state & np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
            state = ((state + hit) | (state - hit)) & full
        out[some] = 2 * (short[some] - np.bitwise_count(state).astype(np.int64)) / (short[some] + long[some])
    return out


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), fill, np.uint32)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def indel(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def run_ratios(texts: Column, parts: Column) -> Column:
    """For each text in turn the Indel ratio of it and of the first, the first two, ... of ``parts`` joined by spaces; null parts are skipped, a null text has no ratio."""

    @F.arrow_udf("array<double>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([indel_runs(tuple(a), b) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return run(texts, parts)


@lru_cache(maxsize=16)
def _packed(texts: tuple[str | None, ...]) -> tuple[dict[str, int], int, list[tuple[int, int, int] | None]]:
    """Places of each character in all texts as one bit vector, a bit apart: it takes the carry of a text, so none goes into the next."""
    places: dict[str, int] = {}
    full, at, spans = 0, 0, []
    for t in texts:
        if t is None:
            spans.append(None)
            continue
        own: dict[str, int] = {}
        for i, c in enumerate(t):
            own[c] = own.get(c, 0) | 1 << i
        for c, bits in own.items():
            places[c] = places.get(c, 0) | bits << at
        ones = (1 << len(t)) - 1
        full |= ones << at
        spans.append((at, ones, len(t)))
        at += len(t) + 1
    return places, full, spans


def indel_runs(texts: tuple[str | None, ...], parts: list[str | None]) -> list[float | None]:
    """``run_ratios`` of one row: a run begins with the run before it, so all of them take one pass over the longest."""
    places, full, spans = _packed(texts)
    row, length, any_part, told = full, 0, False, []
    for part in parts:
        if part is not None:
            piece = f" {part}" if any_part else part
            any_part, length = True, length + len(piece)
            for c in piece:
                mask = places.get(c)
                if mask:
                    hit = row & mask
                    row = (row + hit | row ^ hit) & full
        told.append((row, length))
    ratio = lambda row, length, at, ones, n: 2 * (n - (row >> at & ones).bit_count()) / (n + length) if n + length else 1.0
    return [None if span is None else ratio(row, length, *span) for span in spans for row, length in told]
