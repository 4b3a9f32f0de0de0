"""Words, lines and their hashes over the bytes of many texts at once (numpy).

Texts are laid out one after another with a newline before, between and after them, so no
word or line spans two texts. A prefix sum of byte values times powers of an odd base
gives the 64-bit hash of any byte span in constant time.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C17 | 3  # odd, 3 modulo 4
_MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True  # the separators of a word


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(2)
def _bytes_table(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    if fold:
        table[65:91] = table[97:123]
    return table


@lru_cache(4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, U(_BASE)), np.full(n, U(inverse))
    up[0] = down[0] = U(1)
    return np.cumprod(up), np.cumprod(down)


class Scan:
    """The bytes of ``texts``; ``at[i]`` is where text i begins, ``end[i]`` where it ends."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.raw = b"\n" + b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.at = np.cumsum(np.concatenate(([1], lengths + 1)))[:-1] if self.n else np.zeros(0, np.int64)
        self.end = self.at + lengths

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """Text index of sorted byte positions."""
        return np.repeat(np.arange(self.n), self.per_text(positions))

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted positions lie in each text."""
        cuts = np.searchsorted(positions, self.at) if self.n else np.zeros(0, np.int64)
        return np.diff(np.concatenate((cuts, [len(positions)])))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words."""
        space = SPACE[self.data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        return edges[0::2], edges[1::2]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines, newline left out; an empty text has one."""
        breaks = np.flatnonzero(self.data == 10)
        return breaks[:-1] + 1, breaks[1:]

    def hasher(self, fold: bool = False):
        """``f(starts, ends)``: 64-bit hash of each span; ``fold`` equates A-Z and a-z."""
        return span_hasher(self.data, fold)


def span_hasher(data: np.ndarray, fold: bool = False):
    """``f(starts, ends)``: 64-bit hash of each span of the bytes ``data``."""
    up, down = _powers(max(12, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_bytes_table(fold)[data] * up[:len(data)], out=total[1:])
    return lambda a, b: mix((total[b] - total[a]) * down[a] + (b - a).astype(U))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive items; entry i is items i to i+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total, factor = np.zeros(n, U), 1
    for j in range(k):
        total += hashes[j:j + n] * U(factor)
        factor = factor * _BASE & _MASK
    return mix(total)


def prefix_runs(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each run of items a to b-1, of any lengths."""
    up, down = _powers(max(12, int(len(hashes) + 1).bit_length()))
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:len(hashes)], out=total[1:])
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(U))


def inside(owner: np.ndarray, k: int) -> np.ndarray:
    """Whether the run of ``k`` items that begins at i stays with one owner."""
    n = len(owner) - k + 1
    return owner[:n] == owner[k - 1:] if n > 0 else np.zeros(0, bool)


def shingles(scan: Scan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, count per text) of the distinct ``k``-word shingles of each text, sorted
    inside a text. A text of fewer words has one shingle of all of them; none has none."""
    a, b = scan.words()
    owner = scan.text_of(a)
    words = scan.hasher()(a, b)
    keep = inside(owner, k)
    hashes, text = runs(words, k)[keep], owner[:len(keep)][keep]
    count = np.bincount(owner, minlength=scan.n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(owner, short)
        whole = [mix(np.array([sum(int(words[f + j]) * pow(_BASE, j, 1 << 64)
                                   for j in range(count[t])) & _MASK], U))[0]
                 for f, t in zip(first, short, strict=True)]
        hashes, text = np.concatenate((hashes, np.array(whole, U))), np.concatenate((text, short))
        order = np.argsort(text, kind="stable")
        hashes, text = hashes[order], text[order]
    hashes = hashes.copy()
    cuts = np.searchsorted(text, np.arange(scan.n + 1))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        hashes[lo:hi].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=scan.n)
