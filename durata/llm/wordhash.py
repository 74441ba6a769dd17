"""Words of whole texts as arrays: the shared numpy kernel of the text operators.

A batch of texts becomes one array of 64-bit word hashes plus the offsets at
which each text starts.  All helpers work on such flat arrays, so a batch costs
a few numpy passes whatever the number of texts in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The bytes that part words, 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# ... and every ASCII byte but letters and digits, for plain words.
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _mask(size: np.ndarray) -> np.ndarray:
    """Ones in the lowest ``size`` bytes, eight at most."""
    full = (np.uint64(1) << (np.minimum(size, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
    return np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), full)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Words:
    """Word hashes of a batch of texts.

    ``hash`` has one entry a word, ``first``/``last`` its byte span in ``data``
    (the texts joined by newlines), ``offsets`` the index of each text's first
    word, with the total at the end.  Null and empty texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, plain: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if texts.type != pa.large_binary():
            texts = texts.cast(pa.large_binary())
        parts = [x or b"" for x in texts.to_pylist()]
        self.data = b"\n".join([*parts, b""])
        raw = np.frombuffer(self.data, dtype=np.uint8)
        sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        inside = ~(_PLAIN if plain else _SPACE)[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.first, self.last = edge[0::2], edge[1::2]
        self.offsets = np.searchsorted(self.first, starts)
        self.hash = self._hashes(_LOWER[raw] if lower else raw)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        """Eight bytes a step: nearly all words take one or two steps, the rest shrink quickly."""
        n = len(self.first)
        size = (self.last - self.first).astype(np.int64)
        padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        out = mix(_mask(size) & eight[self.first]) + size.astype(np.uint64)
        far = np.flatnonzero(size > 8)
        step = 8
        while len(far):
            if step == 256:  # very long words go one by one, each as one vector
                for i in far:
                    rest = raw[self.first[i] + 256 : self.last[i]]
                    rest = np.concatenate([rest, np.zeros(-len(rest) % 8, dtype=np.uint8)]).view("<u8")
                    out[i] += mix(np.atleast_1d((mix(rest) * powers(len(rest))).sum(dtype=np.uint64)))[0]
                break
            out[far] = mix(out[far] * _BASE + (_mask(size[far] - step) & eight[self.first[far] + step]))
            step += 8
            far = far[size[far] > step]
        return mix(out) if n else np.zeros(0, dtype=np.uint64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def text(self, i: int) -> str:
        return self.data[self.first[i] : self.last[i]].decode("utf-8", "replace")


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every run of ``width`` values; runs that cross texts are the caller's to drop.

    Doubling: the fingerprint of 2k values is mixed from those of its halves, so
    it takes log2(width) passes and, unlike a sum, it depends on the order.
    """
    if len(values) < width:
        return np.zeros(0, dtype=np.uint64)
    have, size, out, done = values.astype(np.uint64), 1, None, 0
    left = width
    while left:
        if left & 1:
            out = have.copy() if out is None else mix(out[: len(have) - done] * _BASE + have[done:])
            done += size
        left >>= 1
        if left:
            have = mix(have[: len(have) - size] * _BASE + have[size:] + np.uint64(size))
            size *= 2
    return out[: len(values) - width + 1]


def window_mask(offsets: np.ndarray, width: int, total: int) -> np.ndarray:
    """True where a run of ``width`` values starts that stays within one text."""
    ok = np.zeros(total + 1, dtype=np.int32)
    sizes = np.diff(offsets)
    fits = sizes >= width
    np.add.at(ok, offsets[:-1][fits], 1)
    np.add.at(ok, offsets[1:][fits] - width + 1, -1)
    return np.cumsum(ok)[: max(0, total - width + 1)] > 0


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: (values, offsets by text).

    A text with fewer words than ``width`` has its whole sequence as the one
    shingle; a text without words has none.
    """
    counts = np.diff(words.offsets)
    roll = rolling(words.hash, width)
    ok = window_mask(words.offsets, width, len(words.hash))
    owner = words.doc_of_word()[: len(roll)]
    values, owners = roll[ok], owner[ok]
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            own = rolling(words.hash, size)[words.offsets[short]]
            values, owners = np.concatenate([values, mix(own + np.uint64(size))]), np.concatenate([owners, short])
    if np.any(owners[1:] < owners[:-1]):
        order = np.argsort(owners, kind="stable")
        values, owners = values[order], owners[order]
    bounds = np.searchsorted(owners, np.arange(len(words) + 1))
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    if len(values):
        keep = np.ones(len(values), dtype=bool)
        keep[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
        values, owners = values[keep], owners[keep]
    return values, np.searchsorted(owners, np.arange(len(words) + 1))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most_bytes`` of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        a = 0
        while a < batch.num_rows:
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(a, b - a)
            a = b
