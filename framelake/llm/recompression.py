"""Locally consistent names for word sequences, by rounds of run and pair naming.

A round first names each run of equal symbols, then each pair whose left symbol
falls to class 0 and right symbol to class 1. Names and classes are hashes of
content alone, so every task of a cluster gives equal sequences equal names
without asking another. With each symbol goes its reach: the words that decide
that it stands where it does under its name. Two equal windows hold the same
symbols wherever the reach lies inside, at the same offsets; so the interior
symbol with the least name, of the highest level that has one, is a key that
equal windows share.

Everything here works on numpy arrays over a chunk of whole documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers of the mixing function, and the bases of the two sequence hashes.
_M1, _M2, _PAIR = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, made as far as they are asked for."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_powers = [_Powers(base) for base in _BASES]


@dataclass
class Words:
    """Words of consecutive documents, with their bytes' places. Document i has the words edge[i] to edge[i + 1]."""

    name: np.ndarray
    edge: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edge) - 1), np.diff(self.edge))


def read_words(data: bytes, bounds: np.ndarray, separators: np.ndarray = _SPACE) -> Words:
    """Name of each word of the documents data[bounds[i]:bounds[i + 1]]; ``separators`` flags the bytes between words."""
    size = int(bounds[-1])
    text = np.zeros(size + 16, dtype=np.uint8)
    text[:size] = np.frombuffer(data, dtype=np.uint8, count=size)
    inner = ~separators[text[:size]]
    before, after = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    before[1:], after[:-1] = inner[:-1], inner[1:]
    cut = bounds[(bounds > 0) & (bounds < size)]
    before[cut] = False
    after[cut - 1] = False
    start = np.nonzero(inner & ~before)[0]
    length = np.nonzero(inner & ~after)[0] + 1 - start
    eight = np.ndarray((size + 8,), dtype="<u8", buffer=text, strides=(1,))
    name = mix((eight[start] & _HEAD[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _PAIR))
    more = np.nonzero((length > 8) & (length <= _LONG_WORD))[0]
    at = 8
    while len(more):
        name[more] = mix(name[more] * _PAIR + (eight[start[more] + at] & _HEAD[np.minimum(length[more] - at, 8)]))
        at += 8
        more = more[length[more] > at]
    for i in np.nonzero(length > _LONG_WORD)[0]:
        name[i] = xxhash.xxh64_intdigest(text[start[i] : start[i] + length[i]].tobytes())
    return Words(name, np.searchsorted(start, bounds), start, length)


def sequence_hashes(words: Words, which: int = 0) -> np.ndarray:
    """Prefix sums from which sequence_hash takes the first (0) or second (1) hash of any word sequence."""
    names = mix(words.name + _PAIR) if which else words.name
    out = np.zeros(len(names) + 1, dtype=np.uint64)
    np.cumsum(names * _powers[which](len(names))[0], out=out[1:])
    return out


def sequence_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _powers[which](len(prefix))[1][start])


@dataclass
class Symbols:
    """Symbols in order: their words start to end, names, and reach lo to hi."""

    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    name: np.ndarray
    doc: np.ndarray


def _neighbours(s: Symbols, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reach of the symbol before ``first`` and after ``last``; beyond the document where there is none."""
    n = len(s.name)
    prev, succ = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    lo = np.where((first > 0) & (s.doc[prev] == s.doc[first]), s.lo[prev], s.start[first] - 1)
    hi = np.where((last < n - 1) & (s.doc[succ] == s.doc[last]), s.hi[succ], s.end[last] + 1)
    return lo, hi


def name_runs(s: Symbols) -> Symbols:
    """One symbol for each run of equal symbols. It reaches over both neighbours, as they end the run."""
    new = np.ones(len(s.name), dtype=bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(s.name)) - 1
    times = (last - first + 1).astype(np.uint64)
    name = np.where(times > 1, mix(s.name[first] + times * _PAIR), s.name[first])
    lo, hi = _neighbours(s, first, last)
    return Symbols(s.start[first], s.end[last], np.minimum(lo, s.lo[first]), np.maximum(hi, s.hi[last]), name, s.doc[first])


def name_pairs(s: Symbols, salt: int, longest: int) -> Symbols:
    """One symbol for each neighbouring pair of classes 0 and 1, at most ``longest`` words together."""
    n = len(s.name)
    right = (mix(s.name ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
    pair = np.zeros(n, dtype=bool)
    pair[:-1] = ~right[:-1] & right[1:] & (s.doc[1:] == s.doc[:-1]) & (s.end[1:] - s.start[:-1] <= longest)
    second = np.zeros(n, dtype=bool)
    second[1:] = pair[:-1]
    at = np.nonzero(~second)[0]
    to = np.minimum(at + pair[at], n - 1)
    name = np.where(pair[at], mix(s.name[at] * _PAIR + mix(s.name[to])), s.name[at])
    lo, hi = _neighbours(s, at, at)
    # A symbol left single is so because of one neighbour: of class 0 its right one, of class 1 its left one.
    lo = np.where(~pair[at] & right[at], np.minimum(lo, s.lo[at]), s.lo[at])
    hi = np.where(pair[at], s.hi[to], np.where(right[at], s.hi[at], np.maximum(hi, s.hi[at])))
    return Symbols(s.start[at], s.end[to], lo, hi, name, s.doc[at])


def levels(words: Words, width: int) -> list[Symbols]:
    """Symbols after each round of naming, the highest level first.

    As many rounds, and symbols as long, as have room inside a window with their
    reach: with each doubling of the width one round more, two thirds of its words.
    """
    at = np.arange(len(words.name))
    s = Symbols(at, at + 1, at, at + 1, words.name, words.doc)
    out = []
    for r in range(max(1, width.bit_length() - 2) if len(at) else 0):
        s = name_pairs(name_runs(s), r + 1, 2 * width // 3)
        out.append(s)
    return out[::-1]


def window_keys(words: Words, prefix: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of each window of ``width`` words inside a document.

    The key is the least hash among the reaches of the interior symbols of the
    highest level that has any, or the hash of the window where no level has one.
    """
    n = len(words.name)
    dates = np.repeat(words.edge[1:], np.diff(words.edge))
    is_window = np.arange(n) + width <= dates
    best = np.full(n + 1, _NONE)
    open_ = np.append(is_window, False)
    edges = words.edge
    for depth, s in enumerate(levels(words, width)):
        so_far = np.concatenate([[0], np.cumsum(open_)])
        low = np.maximum(s.hi - width, edges[s.doc])
        use = (s.hi - s.lo <= width) & (s.lo >= edges[s.doc]) & (s.hi <= edges[s.doc + 1])
        use &= so_far[np.minimum(s.lo + 1, n)] > so_far[np.minimum(low, n)]
        lo, low, hi = s.lo[use], low[use], s.hi[use]
        key = sequence_hash(prefix, lo, hi) ^ np.uint64(depth)
        found = np.full(n + 1, _NONE)
        for back in range(width):
            ok = lo - back >= low
            if not ok.any():
                break
            lo, low, key = lo[ok], low[ok], key[ok]
            np.minimum.at(found, lo - back, key)
        hit = open_ & (found != _NONE)
        best[hit] = found[hit]
        open_ &= ~hit
    rest = np.nonzero(open_)[0]
    best[rest] = sequence_hash(prefix, rest, rest + width)
    at = np.nonzero(is_window)[0]
    return at, best[at]
