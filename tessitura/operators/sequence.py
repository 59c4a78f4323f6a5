"""Choices along an ordered sequence, where each depends on the one before."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEAM = 64


def chosen_times(words: list[list[tuple[int, int, float]]], begin: int, beam: int = BEAM) -> list[int]:
    """For each word the number of the option (start ms, end ms, score) that is taken, or -1.

    The states are the best of those that end at one time, ``beam`` at most; each word keeps where its states come
    from, and the path is read back once at the end. Ties go to the earlier end, then to the state that was there first."""
    n, score, at = np.zeros(1, np.int64), np.zeros(1), np.array([begin], np.int64)
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for options in words:
        parent, option = np.arange(len(at)), np.full(len(at), -1)
        if options:
            start, end, gain = (np.array(x) for x in zip(*options, strict=True))
            s, o = np.nonzero(at[:, None] <= start[None, :])
            parent, option = np.concatenate([parent, s]), np.concatenate([option, o])
            n, score, at = np.concatenate([n, n[s] + 1]), np.concatenate([score, score[s] + gain[o]]), np.concatenate([at, end[o]])
            order = np.lexsort((at, -score, -n))
            order = order[np.sort(np.unique(at[order], return_index=True)[1])][:beam]
            parent, option, n, score, at = parent[order], option[order], n[order], score[order], at[order]
        back.append((parent, option))
    path, state = [], 0
    for parent, option in reversed(back):
        path.append(int(option[state]))
        state = int(parent[state])
    return path[::-1]


def time_choice(options: DataFrame, beam: int = BEAM) -> DataFrame:
    """(song_id, word, start, end): at most one time for each word, without overlap in milliseconds: most words, then the highest score.

    options: song_id, word, start, end, score, window_start, window_end (start null: no option). The states are the
    ``beam`` best ends so far; a song is a row, and its states are small arrays."""
    valid = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") >= F.col("window_start")) & (F.col("end") <= F.col("window_end"))
    score = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    ms = lambda c: F.rint(c * 1000).cast("bigint")
    one = F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.coalesce(score, F.lit(0.0)).cast("double").alias("score"))
    lists = options.groupBy("song_id", "word").agg(F.array_sort(F.collect_list(F.when(valid, one))).alias("o"), F.min("window_start").alias("w0"))
    songs = lists.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("word", "o"))).alias("ws"), ms(F.min("w0")).alias("begin"))
    times = F.transform("ws", lambda w: F.transform(w["o"], lambda o: F.struct(ms(o["start"]).alias("a"), ms(o["end"]).alias("b"), o["score"].alias("s"))))

    @F.arrow_udf("array<int>")
    def choose(words: pa.Array, begin: pa.Array) -> pa.Array:
        return pa.array([chosen_times([[(o["a"], o["b"], o["s"]) for o in w] for w in words[k].as_py()], begin[k].as_py() or 0, beam) for k in range(len(words))], pa.list_(pa.int32()))

    found = songs.withColumn("taken", choose(times, "begin"))
    rows = found.select("song_id", F.explode(F.arrays_zip("ws", "taken")).alias("x"))
    taken = F.when(F.col("x.taken") >= 0, F.get(F.col("x.ws.o"), F.col("x.taken")))
    return rows.select("song_id", F.col("x.ws.word").alias("word"), taken["start"].alias("start"), taken["end"].alias("end"))


def best_paths(steps: DataFrame, start: list[float], moves: list[tuple[int, int, float]], key: str = "song_id") -> DataFrame:
    """(key, step, state): the best state path of each key. Ties go to the lowest state.

    steps: key, step, emit array<double> (log, one for each state); start: log, by state; moves: (from, to, log). Each
    state's sources are padded to one matrix, so a step is one gather and one maximum over all states."""
    n = len(start)
    sources: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, cost in sorted(moves):
        sources[b].append((a, cost))
    width = max(1, max(map(len, sources)))
    origin = np.array([[a for a, _ in s] + [0] * (width - len(s)) for s in sources])
    move = np.array([[c for _, c in s] + [-np.inf] * (width - len(s)) for s in sources])

    def run(names, table):
        table = table.sort_by("step")
        emit = np.array(table.column("emit").to_pylist(), np.float64).reshape(-1, n)
        score, back = np.array(start, np.float64) + emit[0], np.zeros((len(emit), n), np.int64)
        rows = np.arange(n)
        for k in range(1, len(emit)):
            options = score[origin] + move
            best = options.argmax(1)
            back[k], score = origin[rows, best], options[rows, best] + emit[k]
        path = [int(score.argmax())]
        for k in range(len(emit) - 1, 0, -1):
            path.append(int(back[k, path[-1]]))
        return pa.table({key: pa.array([names[0].as_py()] * len(path), table.schema.field(key).type), "step": table.column("step"), "state": pa.array(path[::-1], pa.int64())})

    kinds = dict(steps.dtypes)
    return steps.select(key, "step", "emit").groupBy(key).applyInArrow(run, f"{key} {kinds[key]}, step {kinds['step']}, state bigint")


NOTED = "song_id string, unit long, pitch int, score double, runner_up double"


def _padded(lists: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(pitches, scores) of candidate lists as two matrices, each row in the order of pitches; what is no candidate has the score -inf."""
    lists = lists.cast(pa.list_(pa.struct([("pitch", pa.int64()), ("score", pa.float64())])))
    counts = np.diff(lists.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    counts = np.where(lists.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    flat = lists.flatten()
    row = np.repeat(np.arange(n), counts)
    pitch, score = flat.field("pitch").to_numpy(zero_copy_only=False), flat.field("score").to_numpy(zero_copy_only=False)
    order = np.lexsort((pitch, row))
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    pitches, scores = np.zeros((n, max(1, int(counts.max(initial=0)))), np.int64), np.full((n, max(1, int(counts.max(initial=0)))), -np.inf)
    pitches[row, place], scores[row, place] = pitch[order], score[order]
    return pitches, scores


def note_continuity(units: DataFrame, gap: float = 1.0, scale: float = 4.0, weight: float = 0.05) -> DataFrame:
    """(song_id, unit, pitch, score, runner_up): the pitch of each unit, where each choice depends on the pitch chosen before.

    units: song_id, unit, start, end, cands array<struct<pitch:int,score:double>> (all terms but continuity). The pitch
    before is forgotten over a gap of more than ``gap`` seconds; ties go to the lowest pitch; a unit without candidates keeps
    it. Songs stream past in order; within an Arrow batch the first units of all songs are chosen at once, then the second
    ones, and so on, and of the song that goes on in the next batch its last note is kept."""

    def run(batches):
        now, kept_pitch, kept_end = None, -1, np.nan
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            songs = batch.column("song_id").to_pylist()
            start, end = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("start", "end"))
            pitches, scores = _padded(batch.column("cands"), n)
            first = np.flatnonzero([True, *(x != y for x, y in zip(songs[1:], songs[:-1], strict=True))])
            size = np.diff(np.append(first, n))
            before, ended = np.full(len(first), -1, np.int64), np.full(len(first), np.nan)
            if songs[0] == now:
                before[0], ended[0] = kept_pitch, kept_end
            out, best, second = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n)
            longest = np.argsort(-size, kind="stable")
            for k in range(int(size.max())):
                going = longest[: np.searchsorted(-size[longest], -k)]  # the songs that have a unit of this number
                row = first[going] + k
                last = np.where(start[row] - ended[going] > gap, -1, before[going])
                near = weight * np.exp(-np.abs(pitches[row] - last[:, None]) / scale)
                total = scores[row] + np.where(last[:, None] >= 0, near, 0.0)
                top = total.argmax(1)
                found = total[np.arange(len(row)), top]
                some = found > -np.inf
                chosen = np.where(some, pitches[row, top], last)
                total[np.arange(len(row)), top] = -np.inf
                other = total.max(1)
                best[row], second[row] = np.where(some, found, 0.0), np.where(some & (other > -np.inf), other, 0.0)
                out[row] = before[going] = chosen
                ended[going] = end[row]
            now, kept_pitch, kept_end = songs[-1], int(before[-1]), float(ended[-1])
            yield pa.RecordBatch.from_arrays([batch.column("song_id"), batch.column("unit"), pa.array(out, pa.int32(), mask=out < 0), pa.array(best), pa.array(second)], names=["song_id", "unit", "pitch", "score", "runner_up"])

    ordered = units.select("song_id", "unit", "start", "end", "cands").repartition("song_id").sortWithinPartitions("song_id", "start", "unit")
    return ordered.mapInArrow(run, NOTED)
