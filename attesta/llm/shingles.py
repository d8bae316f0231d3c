"""Hashes of words, of runs of words and of sets of runs, vectorized."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of a 64-bit finalizer
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of _BASE and of its inverse modulo 2**64, made longer on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_powers = _Powers()
_words: dict[bytes, int] = {}
#: Hashing anew costs little more than a look-up, so few words are kept (about 120 bytes each).
_KEEP = 100_000


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; hashes of frequent words are kept, up to a bound."""
    if len(_words) > _KEEP:
        _words.clear()
    get, hash64 = _words.get, xxhash.xxh3_64_intdigest
    out = []
    for w in ws:
        h = get(w)
        if h is None:
            h = _words[w] = hash64(w)
        out.append(h)
    return np.array(out, np.uint64)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the hashes of the words: a polynomial modulo 2**64 over prefix sums, then mixed."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    up, down = _powers.get(len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down, dtype=np.uint64)])
    return mixed((total[n:] - total[:-n]) * up[: len(h) - n + 1])


def shingle_set(ws: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of runs of n words; a shorter text is one run; no words, no runs."""
    if not ws:
        return np.empty(0, np.uint64)
    h = word_hashes(ws)
    return np.unique(windows(h, min(n, len(h))))


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours, by windows of doubled size."""
    size = 1
    out = a
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (n - size)], out[n - size :]) if n > size else out


class MinHash:
    """Signatures of `trees` keys of 64 bits, each 8 hashes of 8 bits: the sorted keys of a tree are its prefix trie."""

    depth = 8

    def __init__(self, trees: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees = trees
        self.flip = rng.integers(0, 1 << 32, (trees * self.depth, 1), np.uint32)
        self.odd = rng.integers(0, 1 << 31, (trees * self.depth, 1), np.uint32) * np.uint32(2) + np.uint32(1)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.trees * self.depth, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            y = (x[None, at : at + 1024] ^ self.flip) * self.odd
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            np.minimum(least, y.min(axis=1), out=least)
        byte = (mixed(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
        return byte.reshape(self.trees, self.depth).copy().view(">u8").ravel().astype(np.uint64)

    @staticmethod
    def sketch(keys: np.ndarray) -> bytes:
        """The two low bits of each hash, as two planes: hashes of two sets agree in both with a probability of J + (1 - J) / 4."""
        byte = keys.astype(">u8").view(np.uint8)
        return np.packbits(byte & 1).tobytes() + np.packbits(byte >> 1 & 1).tobytes()

    def least_agreement(self, similarity: float, sigmas: float = 4.0) -> int:
        """Hashes in which the sketches of sets of that similarity agree, less so many standard deviations."""
        n, p = self.trees * self.depth, similarity + (1 - similarity) / 4
        return int(n * p - sigmas * (n * p * (1 - p)) ** 0.5)
