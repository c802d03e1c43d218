"""Elias-Fano sequences and an n-gram trie made of them, memory-mapped and queried for whole arrays at a time."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_BYTES = np.arange(256, dtype=np.uint8)
_POP = np.bitwise_count(_BYTES)
#: place of the r-th set bit of a byte
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
ONE = np.uint64(1)


def _or_into(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Adds bits that do not overlap to words; `at` rises."""
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[first]] += np.add.reduceat(bits, first)


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, flip: bool = False) -> np.ndarray:
    """The place of the set (flip: clear) bit with `rank` such bits before it; before[i]: those before word i."""
    word = np.searchsorted(before, rank, side="right") - 1
    left = rank - before[word]
    x = words[word]
    octets = (~x if flip else x).reshape(-1, 1).view(np.uint8)
    upto = np.cumsum(_POP[octets], axis=1, dtype=np.int16)
    octet = (upto <= left[:, None]).sum(axis=1)
    row = np.arange(len(word))
    left = left - np.where(octet > 0, upto[row, np.maximum(octet, 1) - 1], 0)
    return word * 64 + octet * 8 + _SELECT[octets[row, octet], left]


class EliasFano:
    """A rising sequence of whole numbers below `universe` in about log2(universe / n) + 2 bits each.

    Low bits stand packed, high bits as a unary bit vector: number i sets bit (high + i). `before` counts the set bits
    before each word, so the i-th number and the run of numbers with given high bits are found by selection.
    """

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        values = np.ascontiguousarray(values, np.int64).view(np.uint64)
        self.n, self.universe = n, max(1, int(universe))
        self.bits = max(0, (self.universe // max(1, n)).bit_length() - 1)
        place = np.arange(n, dtype=np.int64)
        self.low = np.zeros(n * self.bits // 64 + 2, np.uint64)
        if self.bits:
            low = values & np.uint64((1 << self.bits) - 1)
            word, shift = place * self.bits >> 6, (place * self.bits & 63).astype(np.uint64)
            _or_into(self.low, word, low << shift)
            over = shift.astype(np.int64) + self.bits > 64
            _or_into(self.low, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        at = (values >> np.uint64(self.bits)).view(np.int64) + place
        self.high = np.zeros((n + (self.universe >> self.bits) + 1) // 64 + 1, np.uint64)
        _or_into(self.high, at >> 6, ONE << (at & 63).astype(np.uint64))
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.high), dtype=np.int64)].astype(np.uint32 if n < 1 << 32 else np.uint64)

    def _ones(self) -> np.ndarray:
        return self.before[:-1].astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        x = self.low[word] >> shift
        x |= np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, ONE)), np.uint64(0))
        return x & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        high = _select(self.high, self._ones(), i) - i
        return (high << self.bits) | self._low(i).view(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each number in the sequence, the first of equal ones, or -1."""
        x = np.asarray(x, np.int64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        inside = (x >= 0) & (x < self.universe)
        x = np.where(inside, x, 0)
        high, low = x >> self.bits, (x & ((1 << self.bits) - 1)).view(np.uint64)
        clear = np.arange(len(self.high), dtype=np.int64) * 64 - self._ones()
        start = np.where(high > 0, _select(self.high, clear, np.maximum(high - 1, 0), flip=True) - high + 1, 0)
        stop = _select(self.high, clear, high, flip=True) - high
        a, b = start.copy(), stop.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        hit = inside & (a < stop)
        at = np.flatnonzero(hit)
        hit[at] = self._low(a[at]) == low[at]
        return np.where(hit, a, -1)


def map_arrays(owners: list) -> None:
    """Moves the arrays of objects to one file without a name, mapped for reading; it goes with its last reader."""
    parts = [(o, k, a) for o in owners for k, a in vars(o).items() if isinstance(a, np.ndarray) and a.size]
    if not parts:
        return
    with tempfile.TemporaryFile() as file:
        at = []
        for _, _, a in parts:
            at.append(file.tell())
            file.write(a.tobytes())
            file.write(b"\0" * (-a.nbytes % 8))
        file.flush()
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    for (o, k, a), start in zip(parts, at):
        setattr(o, k, np.frombuffer(view, a.dtype, a.size, start))


class _Level:
    """Contexts of one length: their children's lists in `successors` with codes of their probabilities, and codes of the mass they leave."""


def code_of(p: np.ndarray, step: float) -> np.ndarray:
    """Probabilities as counts of steps of their negative log10, at most 255."""
    return np.clip(np.rint(-np.log10(p) / step), 0, 255).astype(np.uint8)


class Trie:
    """Interpolated Witten-Bell probabilities of grams whose contexts are read from the nearest word on.

    Level m has the contexts of m words. A context is its parent (its m - 1 nearest words) and one more word, and the words after it are a
    part of those after its parent, so each is kept as its rank in the parent's list, from the context's pointer on: one rising
    sequence a level. A gram (h, w) seen c times in C words after h, T of them different, has (c + T p(w | h')) / (C + T), h' being
    the parent; h leaves T / (C + T) to words not seen after it. Both are kept in one byte.
    """

    def __init__(self, contexts: list[np.ndarray], word: np.ndarray, count: np.ndarray, base: np.ndarray, step: float, words: int):
        """Different grams: contexts[m - 1] is the m-th word back (the first may be any key), `word` and other contexts are below `words`; base: codes of the words alone."""
        self.words, self.levels = int(words), []
        p, at = None, None
        for m, key in enumerate(contexts, 1):
            level = _Level()
            parent = at
            value = key.astype(np.int64) if m == 1 else parent * self.words + key
            seen, at = np.unique(value, return_inverse=True)
            level.contexts = EliasFano(seen, int(seen[-1]) + 1 if len(seen) else 1)
            if m == 1:
                start, size = np.arange(len(seen), dtype=np.int64) * self.words, len(seen) * self.words
                rank = word.astype(np.int64)
            else:
                up = np.zeros(len(seen), np.int64)
                up[at] = parent
                start = np.r_[0, np.cumsum(width[up])]  # noqa: F821
                start, size = start[:-1], int(start[-1])
                rank = below - first[parent]  # noqa: F821
                level.start = EliasFano(start, size + 1)
            next_, where, index = np.unique(start[at] + rank, return_index=True, return_inverse=True)
            c = np.bincount(index, weights=count, minlength=len(next_))
            of = at[where]
            total, kinds = np.bincount(of, weights=c, minlength=len(seen)), np.bincount(of, minlength=len(seen))
            lower = 10.0 ** (-step * base[where].astype(float)) if m == 1 else p[below[where]]
            p = (c + kinds[of] * lower) / (total + kinds)[of]
            level.successors = EliasFano(next_, size)
            level.codes, level.left = code_of(p, step), code_of(kinds / (total + kinds), step)
            first, width, below = np.searchsorted(of, np.arange(len(seen))), kinds, index
            if m < len(contexts):
                level.first = EliasFano(first, len(next_) + 1)
            self.levels.append(level)
        map_arrays([o for x in self.levels for o in (x, *[v for v in vars(x).values() if isinstance(v, EliasFano)])])

    def units(self, contexts: list[np.ndarray], word: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Steps of the negative log10 probability of each gram, backed off where it was not seen; equal contexts should stand together."""
        out, live = base.astype(np.int64), np.arange(len(word))
        at = place = None
        for m, (level, key) in enumerate(zip(self.levels, contexts), 1):
            value = key[live].astype(np.int64) if m == 1 else np.where(key[live] < self.words, at * self.words + key[live], -1)
            new = np.r_[True, value[1:] != value[:-1]][:len(value)]
            found = level.contexts.find(value[new])[np.cumsum(new) - 1] if len(value) else value
            keep = found >= 0
            live, below = live[keep], None if m == 1 else place[keep]
            if m == 1:
                want = np.where(word[live] < self.words, found[keep] * self.words + word[live], -1)
            else:
                parent, now = at[keep], found[keep]
                new = np.r_[True, now[1:] != now[:-1]][:len(now)]
                run = np.cumsum(new) - 1
                origin = (level.start.access(now[new]) - self.levels[m - 2].first.access(parent[new]))[run] if len(now) else now
                want = np.where(below >= 0, origin + below, -1)
            at = found[keep]
            place = level.successors.find(want)
            hit = place >= 0
            out[live] = np.where(hit, level.codes[np.maximum(place, 0)] if len(level.codes) else 0, out[live] + level.left[at])
        return out
