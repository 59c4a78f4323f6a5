"""Where captions stand in a lyric: candidate spans and their ranking in Spark; only the cursor goes on from caption to caption."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.binding import bind


def lcs_to_word_ends(text: str, words: list[str], fewest: int, most: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, after, lcs): the longest common subsequence of ``text`` with each span of ``words`` of fewest to most words and up to longest characters.

    One scan from every word at once: the state of a start is a row of bits, one for each character of ``text``, and a
    further character of the words is one addition over all starts, so the spans that begin at a word cost one walk."""
    joined = " ".join(words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    known, index = np.unique(codes, return_inverse=True)
    n_limbs = len(text) // 64 + 1
    masks = np.zeros((len(known), n_limbs), np.uint64)
    place = {int(c): k for k, c in enumerate(known)}
    for i, c in enumerate(text):
        if (k := place.get(ord(c))) is not None:
            masks[k, i // 64] |= np.uint64(1 << i % 64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    word_at = np.zeros(len(codes) + 1, np.int64)  # the number of words that end here, 0 if none does
    word_at[starts + sizes] = np.arange(1, len(words) + 1)
    first = np.arange(len(words))
    last_word = np.minimum(len(words), first + most)
    stop = np.minimum(starts[last_word - 1] + sizes[last_word - 1], starts + longest)
    state = np.full((len(words), n_limbs), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.array([(1 << min(64, max(0, len(text) - 64 * k))) - 1 for k in range(n_limbs)], np.uint64)
    out: list[list[np.ndarray]] = [[], [], []]
    for step in range(int((stop - starts).max(initial=0))):
        going = starts[first] + step < stop[first]
        if not going.all():
            first, state = first[going], state[going]
        at = starts[first] + step
        mask = masks[index[at]]
        hit = state & mask
        carry = np.zeros(len(first), np.uint64)
        new = np.empty_like(state)
        for k in range(n_limbs):
            part = state[:, k] + hit[:, k]
            over = part < state[:, k]
            with_carry = part + carry
            new[:, k] = with_carry | (state[:, k] & ~mask[:, k])
            carry = (over | (with_carry < part)).astype(np.uint64)
        state = new
        after = word_at[at + 1]
        ended = np.flatnonzero((after > 0) & (after - first >= fewest))
        if len(ended):
            out[0].append(first[ended])
            out[1].append(after[ended])
            out[2].append(np.bitwise_count(~state[ended] & full).sum(1).astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def nearly_best(keys: list[str], words: list[str], least: float, margin: float, bonus: float) -> list[dict]:
    """Spans (first, after, ratio, score) of ``words`` that are nearly as like ``keys`` as the best one, in order."""
    n, text = len(keys), " ".join(keys)
    if not n or not words:
        return []
    longest = int(len(text) * (2 - least) / least + 1e-6) if least > 0 else 1 << 40
    first, after, lcs = lcs_to_word_ends(text, words, max(1, n // 2), n + max(6, n), longest)
    upto = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    total = len(text) + upto[after] - upto[first] - 1
    ratio = np.where(total > 0, 2 * lcs / np.maximum(total, 1), 1.0)
    begins = np.array([w == keys[0] for w in words])
    ends = np.array([w == keys[-1] for w in words])
    score = ratio + bonus * (begins[first].astype(int) + ends[after - 1].astype(int))
    some = np.flatnonzero(ratio >= least)
    if not len(some):
        return []
    kept = some[score[some] >= score[some].max() - margin]
    kept = kept[np.lexsort((after[kept], first[kept]))]
    return [{"first": int(first[k]), "after": int(after[k]), "ratio": float(ratio[k]), "score": float(score[k])} for k in kept]


def candidate_spans(captions: DataFrame, lyric: DataFrame, least: float = 0.65, margin: float = 0.025, bonus: float = 0.02) -> DataFrame:
    """(song_id, idx, first, after, ratio, score, span): spans of the lyric nearly as like a caption as the best one.

    captions: song_id, idx, keys; lyric: song_id, pos, key. A span has from half the caption's words to six words (or
    the caption's number) more. One scan over the lyric finds the similarity of all spans of a caption; the lengths that
    ``least`` allows bound it. score adds ``bonus`` for each end that is equal. A caption is a row that has its lyric's
    words with it, so captions of one song can be in many tasks."""
    lyrics = lyric.groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("words"))

    @F.arrow_udf("array<struct<first:int,after:int,ratio:double,score:double>>")
    def near(keys: pa.Array, words: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("ratio", pa.float64()), ("score", pa.float64())]))
        return pa.array([nearly_best(keys[k].as_py() or [], words[k].as_py() or [], least, margin, bonus) for k in range(len(keys))], kind)

    own = captions.where(F.size("keys") > 0).select("song_id", "idx", "keys").join(lyrics, "song_id")
    found = own.select("song_id", "idx", "words", F.explode(near("keys", "words")).alias("c"))
    span = F.array_join(F.slice("words", F.col("c.first") + 1, F.col("c.after") - F.col("c.first")), " ")
    return found.select("song_id", "idx", "c.first", "c.after", "c.ratio", "c.score", span.alias("span"))


_STATE = "struct<cursor:int,after:int,ratio:double,ended:double,out:array<struct<idx:bigint,token_start:bigint,token_end:bigint,score:double,warning:string>>>"


def structure_plan(captions: DataFrame, lyric: DataFrame, context: float = 0.85, apart: float = 3.0) -> DataFrame:
    """(song_id, idx, token_start, token_end, score, warning): the span of each caption, or why it has none (ambiguous, not_in_lyric).

    captions: song_id, idx, start, end, keys; lyric: song_id, pos (from 0), key. One word must be equal, and if it
    stands in several places it must follow the caption before within ``apart`` seconds. Different texts that are nearly as
    good are told apart by a caption before that fits by ``context`` or more. Of equal texts the next from the cursor on counts."""
    near = candidate_spans(captions, lyric).groupBy("song_id", "idx").agg(F.array_sort(F.collect_list(F.struct("first", "after", "score", "ratio", "span"))).alias("near"))
    row = F.struct("start", "idx", "end", F.size("keys").alias("n"), F.array_join("keys", " ").alias("text"), F.coalesce("near", F.array().cast("array<struct<first:int,after:int,score:double,ratio:double,span:string>>")).alias("near"))
    songs = captions.join(near, ["song_id", "idx"], "left").groupBy("song_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    texts = lambda spans: F.size(F.array_distinct(F.transform(spans, lambda c: c["span"])))

    def step(acc, x):
        equal = F.when(x["n"] == 1, F.filter(x["near"], lambda c: c["span"] == x["text"])).otherwise(x["near"])
        follows = (acc["after"] == acc["cursor"]) & (x["start"] - acc["ended"] <= apart)

        def alone(e):
            return F.when((x["n"] == 1) & (F.size(e) > 1), F.filter(e, lambda c: (c["first"] == acc["cursor"]) & F.coalesce(follows, F.lit(False)))).otherwise(e)

        def onward(e):
            on = F.filter(e, lambda c: c["first"] == acc["cursor"])
            return F.when((texts(e) > 1) & (F.coalesce(acc["ratio"], F.lit(0.0)) >= context) & (texts(on) == 1), on).otherwise(e)

        def chosen(e):
            best = F.array_min(F.transform(e, lambda c: F.struct((c["first"] < acc["cursor"]).alias("back"), F.abs(c["first"] - acc["cursor"]).alias("far"), (-c["score"]).alias("s"), c["first"], c["after"], c["ratio"])))
            return F.when(texts(e) == 1, best)

        def placed(b):
            warning = F.when(b.isNull(), F.when(F.size(x["near"]) > 0, "ambiguous").otherwise("not_in_lyric"))
            one = F.struct(x["idx"].cast("long").alias("idx"), b["first"].cast("long").alias("token_start"), b["after"].cast("long").alias("token_end"), b["ratio"].alias("score"), warning.alias("warning"))
            return F.struct(F.coalesce(b["after"], acc["cursor"]).alias("cursor"), b["after"].alias("after"), b["ratio"].alias("ratio"), x["end"].cast("double").alias("ended"), F.concat(acc["out"], F.array(one)).alias("out")).cast(_STATE)

        return bind(bind(bind(bind(equal, alone), onward), chosen), placed)

    first = F.struct(F.lit(0).alias("cursor"), F.lit(None).cast("int").alias("after"), F.lit(None).cast("double").alias("ratio"), F.lit(None).cast("double").alias("ended"), F.array().alias("out")).cast(_STATE)
    return songs.select("song_id", F.inline(F.aggregate("rows", first, step)["out"]))
