"""Sets of five-word shingles as sorted 64-bit hashes, and parity sketches that bound how far two sets differ."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Most bits of a parity sketch. Fewer bits bound the difference less tightly and send more pairs to verification.
SKETCH_BITS = 1 << 16

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    _PLACE = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(SHINGLE)]


class _Powers:
    """Powers of a base modulo 2^64, as far as texts have needed them."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, 1 << 16), self.base, np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def shingles(raw: bytes | None) -> np.ndarray:
    """The set of a text, as sorted signed 64-bit hashes."""
    if not raw:
        return np.empty(0, np.int64)
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    inside = np.empty(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[b]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = turns[::2], turns[1::2]
    if not len(first):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _UP.upto(len(b)), out=sums[1:])
        words = _mix((sums[last] - sums[first]) * _DOWN.upto(len(b))[first] + (last - first).astype(np.uint64))
        n = len(words) - SHINGLE + 1
        size = SHINGLE if n > 0 else len(words)
        total = np.full(max(n, 1), size * 0x632BE5AB, np.uint64)
        for i in range(size):
            total += words[i : i + max(n, 1)] * _PLACE[i]
        return np.unique(_mix(total).view(np.int64))


def window(n: int) -> int:
    """How many of its first pivots a set of n must be replicated to."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def kept(n: int) -> int:
    """How many pivots a set of n keeps: its window, and more for those that may be moved."""
    return window(n) + window(n) // 8 + 16


def signature(found: np.ndarray) -> tuple[int, int]:
    u = found.view(np.uint64)
    with np.errstate(over="ignore"):
        return int(u.sum(dtype=np.uint64).view(np.int64)), int(_mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def sketch(found: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each of as many bits as the set is large, a power of two from 64 up."""
    bits = min(SKETCH_BITS, 1 << max(6, (len(found) - 1).bit_length()))
    return np.packbits(np.bincount(found & np.int64(bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of two sets' symmetric difference: every shingle of it turns one bit. The longer sketch is folded."""
    one, other = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(one) > len(other):
        one, other = other, one
    return int(np.bitwise_count(one ^ np.bitwise_xor.reduce(other.reshape(-1, len(one)), axis=0)).sum())
