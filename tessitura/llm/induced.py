"""Suffix order of a byte string by induced sorting, in whole-array steps.

Suffixes are of type S or L (smaller or larger than the one after them). The
leftmost S suffixes are ordered first: their substrings are named after one
induction, and if names repeat, the string of names is ordered by doubling.
From them all suffixes follow by induction: bucket by bucket, upwards for L
and downwards for S, each queue passes its suffixes' left neighbours on to
the queue of their first byte. A queue is taken as one array, so the number
of steps depends on the alphabet and on runs of one byte, not on the length.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 257  # bytes from 1 on; 0 ends the string


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = 1
    # Equal neighbours take the type after them: the next place with a step decides.
    place = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    return step[nearest] > 0


def _passed(queues: list[list], t: np.ndarray, wanted: np.ndarray, batch: np.ndarray) -> None:
    """Passes the left neighbours (of the wanted type) of a batch on to the queues of their bytes, in order."""
    left = batch[batch > 0] - 1
    left = left[wanted[left]]
    if not len(left):
        return
    symbol = t[left]
    order = np.argsort(symbol, kind="stable")
    left, symbol = left[order], symbol[order]
    cuts = np.flatnonzero(np.diff(symbol)) + 1
    for part, first in zip(np.split(left, cuts), symbol[np.concatenate([[0], cuts])].tolist(), strict=True):
        queues[first].append(part)


def _induced(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost S suffixes ``seeds``, which must be in order (or only bucketed, to order their substrings)."""
    l_type = ~s_type
    by_byte = np.searchsorted(t[seeds], np.arange(_SYMBOLS + 1))
    queues: list[list] = [[] for _ in range(_SYMBOLS)]
    larger: list[np.ndarray] = []
    for c in range(_SYMBOLS):
        done = []
        while queues[c]:
            batch = np.concatenate(queues[c])
            queues[c] = []
            done.append(batch)
            _passed(queues, t, l_type, batch)
        larger.append(np.concatenate(done) if done else np.zeros(0, np.int64))
        _passed(queues, t, l_type, seeds[by_byte[c] : by_byte[c + 1]])
    queues = [[] for _ in range(_SYMBOLS)]
    smaller: list[np.ndarray] = [np.zeros(0, np.int64)] * _SYMBOLS
    for c in range(_SYMBOLS - 1, -1, -1):
        done = []
        while queues[c]:
            batch = np.concatenate(queues[c])
            queues[c] = []
            done.append(batch)
            _passed(queues, t, s_type, batch)
        smaller[c] = np.concatenate(done)[::-1] if done else np.zeros(0, np.int64)
        _passed(queues, t, s_type, larger[c][::-1])
    return np.concatenate([x for c in range(_SYMBOLS) for x in (larger[c], smaller[c])])


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffix order of a string of names, by doubling the length that is compared."""
    rank, size = names.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-size] = rank[size:] + 1
        key = rank * (len(rank) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        size *= 2
        if new[-1] == len(rank) - 1 or size >= len(rank):
            return order


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The places of ``data`` (bytes) in the order of their suffixes."""
    t = np.concatenate([data.astype(np.int16) + 1, np.zeros(1, np.int16)])
    n = len(t)
    if n == 1:
        return np.zeros(0, np.int64)
    s_type = _types(t)
    leftmost = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1  # in text order; the last is the end
    rough = leftmost[np.argsort(t[leftmost], kind="stable")]
    # The end is induced from nothing: it is the first of all, and a seed.
    order = _induced(t, s_type, rough)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    placed = np.concatenate([[n - 1], order[is_left[order] & (order != n - 1)]])
    after = np.full(n, n - 1)
    after[leftmost[:-1]] = leftmost[1:]
    size = after[placed] - placed + 1
    same = size[1:] == size[:-1]
    active, k = np.flatnonzero(same), 0
    while len(active):  # substrings of equal length, byte by byte while they agree
        equal = t[placed[active] + k] == t[placed[active + 1] + k]
        same[active[~equal]] = False
        active = active[equal]
        k += 1
        active = active[size[active] > k]
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] < len(placed) - 1:
        name_of = np.zeros(n, np.int64)
        name_of[placed] = names
        placed = leftmost[_doubled(name_of[leftmost])]
    order = _induced(t, s_type, placed)
    return order[order != n - 1]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix after the first in ``order``, how many bytes it shares with the one before, up to ``most``; eight bytes a step."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16 + most, np.uint8)])
    loads = np.lib.stride_tricks.sliding_window_view(padded, 8)
    shared = np.zeros(max(len(order) - 1, 0), np.int64)
    active, k = np.arange(len(shared)), 0
    while len(active) and k < most:
        a, b = order[active] + k, order[active + 1] + k
        equal = loads[np.minimum(a, n)] == loads[np.minimum(b, n)]
        run = np.where(equal.all(1), 8, np.argmin(equal, 1))
        shared[active] += run
        active = active[run == 8]
        k += 8
    return np.minimum(np.minimum(shared, most), n - np.maximum(order[1:], order[:-1]))
