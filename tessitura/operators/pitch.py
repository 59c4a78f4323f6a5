"""Pitch of sung sound by frame: probabilistic difference-function candidates from chunks, then one path through them for each song.

The method is the published one of probabilistic YIN. A frame's cumulative mean
normalised difference has troughs; a distribution over thresholds tells how
likely each trough is the period, with earlier ones preferred; and a path over
pairs of voiced and unvoiced states, one pair for each tenth of a semitone, takes
the best of them in time.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators.frames import chunks

#: The lowest and highest note that is sung, C2 and C7; samples of a frame and between frames at 22,050 a second.
LOWEST, HIGHEST, FRAME, HOP, RATE = 36.0, 96.0, 2048, 256, 22050
#: Thresholds, the shape of their distribution (a beta distribution), how much earlier troughs are preferred, and the trust in the deepest where none is under a threshold.
N_THRESHOLDS, BETA, BOLTZMANN, NO_TROUGH = 100, (2, 18), 2.0, 0.01
#: States of a semitone, octaves a second that a voice moves at most, and the chance that it begins or ends.
PER_SEMITONE, FASTEST, SWITCH = 10, 35.92, 0.01


def threshold_weights() -> np.ndarray:
    """The share of the beta distribution between neighbouring thresholds; its density is a polynomial, so sums of its terms give the distribution."""
    a, b = BETA
    x = np.linspace(0, 1, N_THRESHOLDS + 1)
    n = a + b - 1
    term = np.ones(n + 1)
    for k in range(1, n + 1):
        term[k] = term[k - 1] * (n - k + 1) / k
    cdf = sum(term[k] * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))
    return np.diff(cdf)


def normalised_difference(frames: np.ndarray, least: int, most: int) -> np.ndarray:
    """d'(lag) for lags least to most of each frame: squared differences over half a frame, over their mean up to the lag."""
    n, size = frames.shape
    half = size // 2
    width = 1 << (half + most).bit_length()
    head = np.fft.rfft(frames[:, :half], width, axis=1)
    product = np.fft.irfft(np.conj(head) * np.fft.rfft(frames[:, : half + most], width, axis=1), width, axis=1)[:, : most + 1]
    squares = np.concatenate([np.zeros((n, 1)), np.cumsum(frames[:, : half + most] ** 2, 1)], 1)
    energy = squares[:, half : half + most + 1] - squares[:, : most + 1]
    d = np.maximum(energy[:, :1] + energy - 2 * product, 0)
    d[d < 1e-10 * (energy[:, :1] + energy)] = 0  # what the transform leaves of nothing
    lags = np.arange(1, most + 1)
    mean = np.cumsum(d[:, 1:], 1) / lags
    return (d[:, 1:] / (mean + np.finfo(float).tiny))[:, least - 1 :]


def troughs(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, index, shift) of local minima, the first index counting if it is below the next; shift: where a parabola through three points is lowest."""
    lower = np.zeros(d.shape, bool)
    lower[:, 1:-1] = (d[:, 1:-1] < d[:, :-2]) & (d[:, 1:-1] <= d[:, 2:])
    lower[:, 0] = d[:, 0] < d[:, 1]
    frame, at = np.nonzero(lower)
    inner = (at > 0) & (at < d.shape[1] - 1)
    left, mid, right = d[frame, np.maximum(at - 1, 0)], d[frame, at], d[frame, np.minimum(at + 1, d.shape[1] - 1)]
    slope, bend = (right - left) / 2, left + right - 2 * mid
    shift = np.where(inner & (np.abs(bend) > np.abs(slope)), -slope / np.where(bend == 0, 1, bend), 0.0)
    return frame, at, shift


def candidates(d: np.ndarray, least: int, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, hertz, probability) of the periods that frames may have.

    For each threshold the troughs under it share its weight, each an equal factor less than the one before; the deepest trough of a
    frame also gets a little of the weight of thresholds that no trough is under."""
    frame, at, shift = troughs(d)
    if not len(frame):
        return frame, np.zeros(0), np.zeros(0)
    height, weight = d[frame, at], threshold_weights()
    thresholds = np.linspace(0, 1, N_THRESHOLDS + 1)[1:]
    under = height[:, None] < thresholds[None, :]
    first = np.append(True, frame[1:] != frame[:-1])
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    so_far = np.cumsum(under, 0)
    before = np.where(starts[:, None] > 0, so_far[np.maximum(starts - 1, 0)], 0)
    rank = so_far - before[group] - 1
    count = np.append(so_far[starts[1:] - 1], so_far[-1:], 0)[...] - before
    n = count[group]
    share = np.exp(-BOLTZMANN * np.maximum(rank, 0)) * (1 - np.exp(-BOLTZMANN)) / (1 - np.exp(-BOLTZMANN * np.maximum(n, 1)))
    probability = np.where(under, share * weight[None, :], 0).sum(1)
    order = np.lexsort((np.arange(len(frame)), height, frame))
    deepest = order[np.append(True, frame[order][1:] != frame[order][:-1])]
    probability[deepest] += NO_TROUGH * (weight[None, :] * (count == 0)).sum(1)
    kept = probability > 0
    return frame[kept], rate / (least + at + shift)[kept], probability[kept]


def _span(rate: int, size: int, low: float, high: float) -> tuple[int, int]:
    hertz = lambda m: 440 * 2 ** ((m - 69) / 12)
    least, most = max(1, int(np.floor(rate / hertz(high)))), min(int(np.ceil(rate / hertz(low))), size - size // 2 - 1)
    if most - least < 2:
        raise ValueError("the frame holds no period of the range")
    return least, most


def pitch_candidates(signals: DataFrame, key: str = "song_id", n_frames: int = 1024, frame: float = FRAME / RATE, hop: float = HOP / RATE, low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """(key, i, t, rms, bins array<int>, probs array<double>): for each frame of each signal (key, samples, rate) the states that it may be in.

    A bin is a tenth of a semitone from ``low`` on; candidates that fall into one bin are added. Chunks are made as in
    ``frames.chunks``; a task holds one chunk, and looks at up to 256 windows at once, of one signal or of many short ones."""
    parts = chunks(signals, key, n_frames, frame, hop)
    kind, top = dict(signals.dtypes)[key], round((high - low) * PER_SEMITONE)

    def analysed(windows, rate):
        """(rms, bins, probs) of each window."""
        least, most = _span(rate, windows.shape[1], low, high)
        f, hertz, p = candidates(normalised_difference(windows, least, most), least, rate)
        b = np.clip(np.rint((69 + 12 * np.log2(hertz / 440) - low) * PER_SEMITONE), 0, top).astype(np.int64)
        both, index = np.unique(f * (top + 1) + b, return_inverse=True)
        edges = np.searchsorted(both // (top + 1), np.arange(len(windows) + 1)).astype(np.int32)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(edges), v)
        return pa.array(np.sqrt((windows**2).mean(1))), lists(pa.array((both % (top + 1)).astype(np.int32))), lists(pa.array(np.bincount(index, p, len(both))))

    def run(batches):
        for batch in batches:
            some, held, of = [], 0, None  # windows of one rate, of as many signals as they come from
            for k in range(batch.num_rows):
                rate, chunk, first, n, left = (batch.column(c)[k].as_py() for c in range(1, 6))
                part = batch.column(6)[k].values.to_numpy(zero_copy_only=False).astype(float)
                step, size = max(1, round(rate * hop)), max(8, round(rate * frame))
                if some and of != rate:
                    yield out(batch, some, of)
                    some, held = [], 0
                of = rate
                x = np.zeros((n - 1) * step + size)
                x[left : left + len(part)] = part
                own = 1 if chunk else 0
                windows = np.lib.stride_tricks.sliding_window_view(x, size)[::step][own:]
                at = 0
                while at < len(windows):
                    taken = windows[at : at + 256 - held]
                    some.append((k, first + own + at, step, taken))
                    at, held = at + len(taken), held + len(taken)
                    if held == 256:
                        yield out(batch, some, of)
                        some, held = [], 0
            if some:
                yield out(batch, some, of)

    def out(batch, some, rate):
        names = batch.column(0).take(pa.array(np.repeat([k for k, *_ in some], [len(w) for *_, w in some])))
        i = np.concatenate([np.arange(begin, begin + len(w)) for _, begin, _, w in some])
        return pa.RecordBatch.from_arrays([names, pa.array(i), pa.array(i * some[0][2] / rate), *analysed(np.concatenate([w for *_, w in some]), rate)], [key, "i", "t", "rms", "bins", "probs"])

    columns = parts.select(key, *[F.col(c).cast("int") for c in ("rate", "chunk", "first", "n", "left")], F.col("part").cast("array<double>"))
    return columns.mapInArrow(run, f"`{key}` {kind}, i long, t double, rms double, bins array<int>, probs array<double>")


def moves(n: int, reach: int) -> np.ndarray:
    """Log weights of a move by -reach to reach states, for each state that it goes out from (n, 2 reach + 1): a triangle, whose sums are 1 within the range."""
    triangle = 1.0 + reach - np.abs(np.arange(-reach, reach + 1))
    to = np.arange(n)[:, None] + np.arange(-reach, reach + 1)[None, :]
    inside = np.where((to >= 0) & (to < n), triangle[None, :], 0)
    with np.errstate(divide="ignore"):
        return np.log(inside / inside.sum(1, keepdims=True))


@cache
def _sources(n: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each state the states that it can be reached from, and the log weights of those moves."""
    offsets = np.arange(-reach, reach + 1)
    source = np.arange(n)[:, None] + offsets[None, :]
    valid = (source >= 0) & (source < n)
    source = np.clip(source, 0, n - 1)
    return source, np.where(valid, moves(n, reach)[source, (reach - offsets)[None, :]], -np.inf)  # from j + o into j: the move by -o


#: Frames between those whose scores are kept on the way forward, and frames of a group of songs that are walked at once.
STRETCH, TOGETHER = 256, 2048


def voiced_paths(songs: list[tuple[list, list]], n: int, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(state, voiced) of the best path of each song (bins, probs): ``n`` states with a voiced and an unvoiced form each, unvoiced at first. Ties go to voiced, then to the lowest state.

    Songs go on together from frame to frame. Where a state comes from is found on the way back, for the states of the path
    alone, from the scores of the frame before; those are kept for each ``STRETCH``th frame, and made anew in between."""
    if not songs:
        return []
    tiny = np.finfo(float).tiny
    source, into = _sources(n, reach)
    weights = np.ascontiguousarray(into.T)
    stay, switch = np.log(1 - SWITCH), np.log(SWITCH)
    order = sorted(range(len(songs)), key=lambda s: -len(songs[s][0]))  # the longest first: those under way are a prefix
    lengths = np.array([len(songs[s][0]) for s in order])
    last = int(lengths[0])

    def emitted(t):
        at = [songs[s] for s in order[: int((lengths > t).sum())]]
        emit = np.full((len(at), 2, n), np.log(tiny))
        for s, (bins, probs) in enumerate(at):
            emit[s, 0, bins[t]] = np.log(np.maximum(probs[t], tiny))
            emit[s, 1] = np.log(max((1 - min(1.0, float(np.sum(probs[t])))) / n, tiny))
        return emit

    def step(score, t):
        emit = emitted(t)
        wide = np.full((len(emit), 2, n + 2 * reach), -np.inf)
        wide[:, :, reach : reach + n] = score[: len(emit)]
        best = wide[:, :, :n] + weights[0]
        option = np.empty_like(best)
        for k in range(1, 2 * reach + 1):
            np.add(wide[:, :, k : k + n], weights[k], out=option)
            np.maximum(best, option, out=best)
        emit += np.maximum(best + stay, best[:, ::-1] + switch)
        return emit

    score = np.stack([np.full(n, np.log(tiny)), np.full(n, -np.log(n))])
    kept, scores = {}, []
    for t in range(last):
        score = step(score, t) if t else score + emitted(0)
        if t % STRETCH == 0:
            kept[t], scores = score, []
        scores.append(score)
    states, kinds = np.zeros((len(songs), last), np.int64), np.zeros((len(songs), last), np.int64)
    j, v = np.zeros(len(songs), np.int64), np.zeros(len(songs), np.int64)
    for t in range(last - 1, -1, -1):
        if t % STRETCH == STRETCH - 1 and t < last - 1:
            scores = [kept[t + 1 - STRETCH]]
            for u in range(t + 2 - STRETCH, t + 1):
                scores.append(step(scores[-1], u))
        score = scores[t % STRETCH]
        ends = np.flatnonzero(lengths == t + 1)
        v[ends] = np.where(score[ends, 0].max(1) >= score[ends, 1].max(1), 0, 1)
        j[ends] = score[ends, v[ends]].argmax(1)
        rows = np.arange(len(score))
        on = lengths[: len(score)] > t + 1
        if on.any():  # the frame after, whose state is known, tells this one's
            r, came, kind = rows[on], source[j[: len(score)][on]], v[: len(score)][on]
            options = [score[r[:, None], k[:, None], came] + into[j[: len(score)][on]] for k in (kind, 1 - kind)]
            place = [o.argmax(1) for o in options]
            own, other = options[0].max(1) + stay, options[1].max(1) + switch
            cross = np.where(kind == 0, other > own, other >= own)
            j[r] = came[np.arange(len(r)), np.where(cross, place[1], place[0])]
            v[r] = np.where(cross, 1 - kind, kind)
        states[rows, t], kinds[rows, t] = j[: len(score)], v[: len(score)]
    found = {s: (states[k, : lengths[k]], kinds[k, : lengths[k]] == 0) for k, s in enumerate(order)}
    return [found[s] for s in range(len(songs))]


def voiced_path(bins: list, probs: list, n: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """``voiced_paths`` of one song."""
    return voiced_paths([(bins, probs)], n, reach)[0]


def sung_pitch(signals: DataFrame, key: str = "song_id", n_frames: int = 1024, frame: float = FRAME / RATE, hop: float = HOP / RATE, low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """(key, i, t, midi, voiced, prob, rms): the pitch of each frame (null where there is no voice), and how sure a voice is.

    Candidates are made chunk by chunk. Songs then stand one after the other in a task, which holds those whose paths it
    finds together: of each a few numbers a frame."""
    found = pitch_candidates(signals, key, n_frames, frame, hop, low, high)
    kind, n = dict(signals.dtypes)[key], round((high - low) * PER_SEMITONE) + 1
    reach = round(round(FASTEST * 12 * hop) * PER_SEMITONE / 2)

    def paths(table):
        """The rows of whole songs, which stand together in their order."""
        bins, probs = ([x.values.to_numpy(zero_copy_only=False) for x in table.column(c).combine_chunks()] for c in ("bins", "probs"))
        names = table.column(key).to_pylist()
        edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        got = voiced_paths([(bins[a:z], probs[a:z]) for a, z in zip(edges, edges[1:], strict=False)], n, reach)
        states, voiced = (np.concatenate(x) for x in zip(*got, strict=True))
        midi = pa.array(low + states / PER_SEMITONE, mask=~voiced)
        prob = np.array([min(1.0, float(p.sum())) for p in probs])
        return pa.table({key: table.column(key), "i": table.column("i"), "t": table.column("t"), "midi": midi, "voiced": pa.array(voiced), "prob": pa.array(prob), "rms": table.column("rms")}).combine_chunks().to_batches()

    def run(batches):
        held = []  # rows of whole songs, and of the last one
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                held.append(batch.slice(at, TOGETHER))
                if held[0].column(0)[0] == held[-1].column(0)[-1]:
                    continue  # one song still
                table = pa.Table.from_batches(held)
                names = table.column(key).to_pylist()
                end = next(k for k in range(len(names) - 1, 0, -1) if names[k - 1] != names[k])
                yield from paths(table.slice(0, end))
                held = table.slice(end).to_batches()
        if held:
            yield from paths(pa.Table.from_batches(held))

    songs = found.repartition(key).sortWithinPartitions(key, "i")
    return songs.mapInArrow(run, f"`{key}` {kind}, i long, t double, midi double, voiced boolean, prob double, rms double")
