"""Words of many texts at once: boundaries and hashes from the UTF-8 bytes, without a Python object a word.

A hash has one or two lanes of 64 bits. Each lane takes eight bytes of the word at a time and scatters them by a
bijection, so within eight bytes no two words of one length share a hash, and there is no arithmetic structure that
longer words could exploit; words of more than ``LONG`` bytes are hashed by BLAKE2b."""

from __future__ import annotations

import hashlib

import numpy as np

_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))
_SEED = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
#: Bytes from which on a word is hashed by itself.
LONG = 64


def mix(h: np.ndarray, lane: int = 0) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * _MIX[lane]
    h = (h ^ (h >> np.uint64(29 + 3 * lane))) * _MIX[lane]
    return h ^ (h >> np.uint64(32))


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """256 flags: which bytes separate words. ``ranges`` are inclusive."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words of [^\x20\x09-\x0D]+.
BLANKS = separators([(0x20, 0x20), (0x09, 0x0D)])


class Words:
    """Words of a slice of texts: ``start``, ``end`` (byte places), ``doc`` (row), ``first`` (for each row the number
    of words before it; one more at the end), ``hash`` and, with two lanes, ``more`` (64 bits each)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blank: np.ndarray, lanes: int = 1):
        inside = ~blank[data]
        n, rows = len(data), len(offsets) - 1
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        self.hash, self.more = [*self._hashes(data, lanes), None, None][:2]

    def _hashes(self, data: np.ndarray, lanes: int) -> list[np.ndarray]:
        size = self.end - self.start
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
        out = [mix(size.astype(np.uint64) * _SEED[k] + _SEED[k], k) for k in range(lanes)]
        who = np.flatnonzero(size <= LONG) if len(size) and size.max() > LONG else slice(None)
        start, left = self.start[who], size[who]
        while len(start):
            x = eight[start] & _KEEP[np.minimum(left, 8)]
            for k, h in enumerate(out):
                h[who] = mix(h[who] ^ x, k) + _SEED[k]
            on = np.flatnonzero(left > 8)
            if not len(on):
                break
            who = on if isinstance(who, slice) else who[on]
            start, left = start[on] + 8, left[on] - 8
        for i in np.flatnonzero(size > LONG).tolist() if lanes else []:
            found = np.frombuffer(hashlib.blake2b(data[self.start[i] : self.end[i]].tobytes(), digest_size=16).digest(), np.uint64)
            for k in range(lanes):
                out[k][i] = found[k]
        return out


def runs(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``width`` consecutive words, from a lane of theirs; those over a row's end are the caller's to mask."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64((0xA0761D6478BD642F + 2 * seed * 0x9E3779B97F4A7C15 | 1) % (1 << 64))
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h *= factor
            h += words[k : n + k]
        return mix(h ^ np.uint64(seed))


def whole(first: np.ndarray, width: int) -> np.ndarray:
    """For ``runs``: which of them lie within one row."""
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    out = np.ones(n, bool)
    for k in range(1, width):  # a run that starts k words before the end of a row, short of width
        at = first[1:-1] - k
        at = at[(at >= 0) & (at < n)]
        out[at] = False
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray, most: int = 1 << 20):
    """A slice of texts as (data, offsets), or, if it is one long text, that text in stretches of about ``most`` bytes that
    end between words, so that what is derived from a stretch stays bounded."""
    if len(offsets) != 2 or len(data) <= 2 * most:
        yield data, offsets
        return
    a = 0
    while a < len(data):
        b = min(a + most, len(data))
        while b < len(data) and not blank[data[b]]:
            far = np.flatnonzero(blank[data[b : b + most]])
            b = b + int(far[0]) if len(far) else min(b + most, len(data))
        yield data[a:b], np.array([0, b - a])
        a = b
