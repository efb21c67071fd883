"""Word shingles of whole texts as sets of 64-bit hashes, in numpy.

A word is a run of bytes other than white space, A-Z lower-cased; its hash is the
sum of its eight-byte pieces, each mixed with its place, and its length (a
polynomial modulo 2^64 would be equal for some words of a thousand letters); a
shingle's hash mixes the hashes of its words in order. All arithmetic is over
arrays of about a megabyte of text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .common import text_blocks

U = np.uint64
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANKS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
PIECE = 8  # bytes
KEPT = np.array([(1 << 8 * n) - 1 for n in range(PIECE + 1)], U)  # the first n bytes of a piece


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class ShingleHasher:
    def __init__(self, words: int = 5, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words = words
        table = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
        for c in range(ord("A"), ord("Z") + 1):
            table[c] = table[c + 32]
        self.table = table
        self.base = U(int(rng.integers(1 << 62)) * 8 + 5)
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self.order = rng.integers(0, 1 << 63, words, dtype=np.int64).astype(U) * U(2) + U(1)
        self.powers = self.inverses = np.ones(1, U)
        self.seed = U(int(rng.integers(1 << 62)))

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            self.powers, self.inverses = (
                np.cumprod(np.concatenate([[U(1)], np.full(n, b, U)]), dtype=U) for b in (self.base, self.inverse)
            )
        return self.powers[:n], self.inverses[:n]

    def hashes(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The hashes of the words at these places of a buffer, which ends with a piece to spare."""
        pieces = np.ndarray((len(buffer) - PIECE + 1,), "<u8", buffer, strides=(1,))  # one at every byte
        n = -(-lengths // PIECE)
        first = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(first, n)
        left = np.repeat(lengths, n) - PIECE * inner
        parts = pieces[np.repeat(starts, n) + PIECE * inner] & KEPT[np.minimum(left, PIECE)]
        parts = mixed(mixed(parts + self.seed) ^ inner.astype(U))
        return mixed(np.add.reduceat(parts, first) + lengths.astype(U)) if len(n) else np.empty(0, U)

    def shingles(self, block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all shingles of all texts, in order; where each text's begin, and the end)."""
        buffer = LOWER[np.frombuffer(b" ".join([b"", *block, b" " * PIECE]), np.uint8)]
        lengths = np.array([len(x) for x in block], np.int64)
        text_at = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
        word = IS_WORD[buffer]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1  # the buffer begins and ends with a blank
        starts, ends = edges[::2], edges[1::2]
        words = self.hashes(buffer, starts, ends - starts)
        first = np.searchsorted(starts, text_at)  # words of text i: first[i]..first[i + 1]
        counts, k = np.diff(first), self.words
        n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(bounds[-1], U)
        at = np.repeat(first[:-1], n) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
        whole = np.repeat(counts >= k, n)
        long = at[whole]
        h = np.zeros(len(long), U)
        for j in range(k):
            h += words[long + j] * self.order[j]
        out[whole] = mixed(h)
        for i in np.flatnonzero((counts < k) & (counts > 0)):
            part = words[first[i] : first[i + 1]]
            h = np.sum(part * self.order[: len(part)], dtype=U) + U(len(part))
            out[bounds[i]] = mixed(np.array([h], U))[0]
        return out, bounds

    def sets(self, texts: Iterable) -> Iterator[tuple[int, np.ndarray]]:
        """(index, sorted distinct shingle hashes) of every text."""
        for start, block in text_blocks(texts):
            hashes, bounds = self.shingles(block)
            for i in range(len(block)):
                members = np.sort(hashes[bounds[i] : bounds[i + 1]])
                fresh = np.ones(len(members), bool)
                np.not_equal(members[1:], members[:-1], out=fresh[1:])
                yield start + i, members[fresh]


def set_key(members: np.ndarray) -> int:
    """A signed 64-bit key of a set of hashes; equal sets have equal keys."""
    total = np.sum(mixed(members ^ U(0x9E3779B97F4A7C15)), dtype=U, keepdims=True)
    return int(mixed(total + U(len(members))).view(np.int64)[0])
