"""Vectorised fingerprints of byte ranges, words and word windows (numpy, inside tasks).

A byte range is a polynomial in a fixed odd base over random byte values, modulo 2**64, taken
from prefix sums, then mixed.  Equal ranges have equal fingerprints wherever they stand.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
# Two independent families; the second only chooses buckets.
_BYTE = _RANDOM.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) * 8 + 5 for x in _RANDOM.integers(0, 2**61, 2)]
_STEP = _RANDOM.integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int, base: int) -> np.ndarray:
    """The first n powers of an odd base, modulo 2**64 (kept between calls)."""
    if len(_powers.get(base, ())) < n:
        grown = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Ranges:
    """Fingerprints of ranges of one block of bytes."""

    def __init__(self, data: np.ndarray, family: int = 0):
        self.inverse = powers(len(data) + 1, pow(_BASE[family], -1, 2**64))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[family][data] * powers(len(data), _BASE[family]), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def blocks(offsets: np.ndarray, size: int):
    """Cut consecutive texts into groups of about ``size`` bytes: yields (first, last + 1)."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="left"))
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE):
    """Starts and ends of the words of consecutive texts, and the first word of each text.

    ``gap`` tells which byte values stand between words.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    letter = ~gap[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = ~letter[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    fresh[inner] = True
    starts = np.flatnonzero(letter & fresh)
    final = np.ones(len(data), dtype=bool)
    final[:-1] = ~letter[1:]
    final[inner - 1] = True
    ends = np.flatnonzero(letter & final) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(word_hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Fingerprint of ``width`` consecutive words at every start (ignores text limits)."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = word_hashes[:n] * _STEP[family][0]
    for k in range(1, width):
        total += word_hashes[k : k + n] * _STEP[family][k % 64]
    return mix(total)


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 as differences in byte planes without empty high planes.

    Two or more values have at least one plane, also where all are equal, so none is lost.
    """
    if not len(values):
        return b""
    steps = np.diff(values)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    used = 8 if len(steps) else 0
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + values[:1].tobytes() + planes[:used].tobytes()


def unpack(payload: bytes) -> np.ndarray:
    if not payload:
        return np.zeros(0, dtype=np.uint64)
    used = payload[0]
    first = np.frombuffer(payload, dtype=np.uint64, count=1, offset=1)
    if not used:
        return first.copy()
    planes = np.frombuffer(payload, dtype=np.uint8, offset=9).reshape(used, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :used] = planes.T
    return np.cumsum(np.concatenate([first, steps.view(np.uint64).ravel()]))
