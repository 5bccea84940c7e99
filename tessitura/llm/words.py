"""Words and their 64-bit hashes, for whole blocks of UTF-8 text at once.

Strings are told apart by `string_hashes`: eight bytes at a time are mixed in, so no algebra relates the hashes of
structured strings, and no word becomes a Python object. Word sequences, of which parts are left out, have polynomials
modulo the prime 2**61 - 1 over the words' hashes (`Sequences`). The rolling hash modulo 2**64 (`prefix_sums`,
`span_hashes`) has known collisions; it only picks places and features, and never decides that strings are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(int(_RNG.integers(2**60, 2**61)) * 8 + 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer strings are hashed one by one.
_LONG = 512
_PRIME = np.uint64((1 << 61) - 1)
_FACTOR = int(_RNG.integers(2**40, 2**60))

#: A-Z become a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]+` words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words: digits, a-z and all of other scripts.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = (n >> 18) + 1 << 18
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each string `data[start:end]`; different seeds give independent ones."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E6C63D0876A9A35 + seed))
    if not len(size):
        return out
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    key = (seed & (1 << 64) - 1).to_bytes(8, "little")
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=key).digest(), "little")
    return out


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    carry = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _reduced((a1 * b1 << np.uint64(1)) + carry + a0 * b0)


def _prime_powers(name: str, n: int) -> np.ndarray:
    """The first n powers, at least, of the factor ("prime") or its inverse ("inverse") modulo the prime."""
    base = _FACTOR if name == "prime" else pow(_FACTOR, -1, int(_PRIME))
    held = _POWERS.get(name, np.ones(1, np.uint64))
    while len(held) < n:
        step = np.uint64(pow(base, len(held), int(_PRIME)))
        held = np.concatenate([held, multiplied(held, np.full(len(held), step))])
    _POWERS[name] = held
    return held


class Sequences:
    """Hashes of parts of a long sequence of words, also with one word left out."""

    def __init__(self, words: np.ndarray):
        n, half = len(words) + 1, np.uint64(31)
        self.down = _prime_powers("inverse", n + 1)
        terms = multiplied(_reduced(words), _prime_powers("prime", n)[: n - 1])
        high, low = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (terms >> half, terms & np.uint64((1 << 31) - 1)))
        high = _reduced(high)
        shifted = (high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << half)
        self.sums = _reduced(_reduced(shifted) + _reduced(low))

    def _difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _reduced(self.sums[b] + _PRIME - self.sums[a])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of the words [a, b), wherever they stand."""
        return self._mixed(multiplied(self._difference(a, b), self.down[a]), b - a)

    def without(self, a: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash that the words [a, b) have without the one at p."""
        before = multiplied(self._difference(a, p), self.down[a])
        after = multiplied(self._difference(p + 1, b), self.down[a + 1])
        return self._mixed(_reduced(before + after), b - a - 1)

    def _mixed(self, value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(value + mix(size.astype(np.uint64)))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (bytes where `kind` is true), and for each text the number of the first, as offsets."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashed_words(data: np.ndarray, at: np.ndarray, kind: np.ndarray):
    """(hash of each word, starts, ends, word offsets of the texts), after lowering A-Z."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, at, kind)
    return string_hashes(data, starts, ends), starts, ends, first


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += hashes[k : k + size] * _STEP[k]
    return mix(out)
