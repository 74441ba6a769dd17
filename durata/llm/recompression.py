"""Recompression of word sequences: rounds of naming runs and pairs by content.

A round first names every maximal run of one symbol, then every pair whose left
symbol falls on the left side and whose right symbol on the right side of a
coin that is a function of the symbol's name.  Names are functions of what they
stand for, so equal word sequences get equal names in every task without a
shared dictionary, but for symbols at the rim of the sequence, whose fate
depends on unseen neighbours.  :class:`Levels` tracks which part of a window is
free of such influence: between ``lo[r][p]`` and ``hi[r][p + width]`` the symbols
of round ``r`` are the same wherever the window's words occur.
"""

from __future__ import annotations

import numpy as np

from .wordhash import mix, rolling, window_mask

_SALT = np.uint64(0xD6E8FEB86659FD93)


class Levels:
    """Symbols of a batch of texts after each round, and the certain bounds of every word edge."""

    def __init__(self, names: np.ndarray, offsets: np.ndarray, rounds: int):
        n = len(names)
        edges = np.arange(n + 1)
        barrier = np.zeros(n + 1, dtype=bool)
        barrier[offsets] = True
        self.start, self.name, self.barrier = [edges], [names], [barrier]
        self.lo, self.hi = [edges.astype(np.int32)], [edges.astype(np.int32)]
        for r in range(1, rounds + 1):
            self._round(np.uint64(r))

    def _round(self, salt: np.uint64) -> None:
        name, start, barrier = self.name[-1], self.start[-1], self.barrier[-1]
        m = len(name)
        # maximal runs of one symbol
        new = np.ones(m, dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | barrier[1:m]
        first = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1
        length = np.diff(first, append=m)
        run = np.where(length > 1, mix(name[first] + length.astype(np.uint64) * _SALT), name[first])
        k = len(run)
        run_lo = np.append(run_of + 1, k)  # the run at the left rim may begin earlier
        run_hi = np.concatenate([[0], run_of])  # that at the right rim may end later
        # pairs across a left and a right symbol
        right = (mix(run + mix(np.atleast_1d(salt))) >> np.uint64(63)).astype(bool)
        run_barrier = np.append(barrier[first], True)
        merged = np.zeros(k + 1, dtype=bool)
        merged[1:k] = ~right[:-1] & right[1:] & ~run_barrier[1:k]
        kept = ~merged
        edge = np.arange(k + 1)
        lo = np.where(np.append(right, False), edge + 1, edge)  # a right symbol at the rim may join what precedes it
        hi = np.where(np.concatenate([[False], ~right]), edge - 1, edge)
        index = np.cumsum(kept) - 1
        index_lo, index_hi = index[np.minimum(lo, k)], index[np.maximum(hi, 0)]
        heads = np.flatnonzero(kept[:k])
        pair = np.append(merged[1:k], False)[heads] if k else np.zeros(0, dtype=bool)
        after = run[np.minimum(heads + 1, max(k - 1, 0))] if k else run
        self.name.append(np.where(pair, mix(run[heads] * _SALT + after + salt), run[heads]))
        self.start.append(np.append(start[first], start[m])[np.append(heads, k)])
        self.barrier.append(run_barrier[np.append(heads, k)])
        self.lo.append(index_lo[run_lo[self.lo[-1]]].astype(np.int32))
        self.hi.append(index_hi[run_hi[self.hi[-1]]].astype(np.int32))


def anchors(names: np.ndarray, offsets: np.ndarray, width: int, rounds: int = 2, joined: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``width`` words: its start, its anchor's key and its anchor's word position.

    Of the ``joined`` consecutive certain symbols of the highest round that has so
    many, the anchor is the place with the smallest key.  It is a function of the
    window's words: equal windows have equal keys at equal distances.  The lowest
    round is the words themselves, all of which are certain, so every window that
    is ``joined`` words wide has an anchor; narrower ones take all their words.
    """
    joined = min(joined, width)
    p = np.flatnonzero(window_mask(offsets, width, len(names)))
    key, at = np.zeros(len(p), dtype=np.uint64), np.full(len(p), -1, dtype=np.int64)
    levels = Levels(names, offsets, rounds)
    for r in range(rounds, -1, -1):
        left = np.flatnonzero(at < 0)
        lo, hi = levels.lo[r][p[left]].astype(np.int64), levels.hi[r][p[left] + width].astype(np.int64)
        count = hi - lo - joined + 1
        has = count > 0
        left, lo, count = left[has], lo[has], count[has]
        if not len(left):
            continue
        keys = mix(rolling(levels.name[r], joined) + mix(np.array([r + 1])))
        # the leftmost smallest key of a range, by doubling: the key's high bits over the place's
        bits = np.uint64(max(1, int(len(keys)).bit_length()))
        packed = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
        power = np.floor(np.log2(count)).astype(np.int64)
        best = np.empty(len(left), dtype=np.uint64)
        table, span = packed, 1
        for j in range(int(power.max()) + 1):
            own = power == j
            best[own] = np.minimum(table[lo[own]], table[lo[own] + count[own] - span])
            if 2 * span <= len(keys):
                table = np.minimum(table[:-span], table[span:])
            span *= 2
        place = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        key[left], at[left] = keys[place], levels.start[r][place]
    return p, key, at
