"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of letters and digits of the lower-cased text.  A shingle is five words in a row; a
text of one to four words has one shingle, all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SEEDS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    np.uint64,
)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table() -> bytes:
    """One bit for each code point: is it part of words?"""
    return np.packbits([chr(c).isalnum() for c in range(0x110000)]).tobytes()


class Shingler:
    """Shingle hashes of lists of texts.  Built once for a task."""

    def __init__(self, table: bytes):
        self.in_word = np.unpackbits(np.frombuffer(table, np.uint8)).astype(bool)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, size: int):
        """Powers of an odd number and of its inverse, modulo 2^64."""
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        steps = np.full(size, BASE, np.uint64)
        back = np.full(size, inverse, np.uint64)
        steps[0] = back[0] = 1
        self.powers, self.inverses = np.cumprod(steps), np.cumprod(back)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Owner (index of the text) and hash of each word, in order."""
        lowered = [text.lower() for text in texts]
        points = np.frombuffer(
            "\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32
        )
        if len(points) > len(self.powers):
            self.grow(len(points) * 5 // 4)
        inside = self.in_word[points]
        change = np.diff(inside, prepend=False, append=False)
        edges = np.flatnonzero(change)
        starts, ends = edges[::2], edges[1::2]
        if len(starts) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points.astype(np.uint64) * self.powers[: len(points)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        limits = np.cumsum([len(text) + 1 for text in lowered])
        return np.searchsorted(limits, starts, side="right"), hashes

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Owner and hash of each shingle, in order, with repeats."""
        owner, word = self.words(texts)
        counts = np.bincount(owner, minlength=len(texts))
        n = len(word) - WORDS + 1
        if n > 0:
            whole = owner[:n] == owner[WORDS - 1 :]
            hashes = word[:n] * SEEDS[0]
            for i in range(1, WORDS):
                hashes = mixed(hashes) + word[i : n + i] * SEEDS[i]
            owners, hashes = owner[:n][whole], mixed(hashes)[whole]
        else:
            owners, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(short) == 0:
            return owners, hashes
        first = np.cumsum(counts) - counts
        single = np.zeros(len(short), np.uint64)
        for i in range(WORDS - 1):
            has = counts[short] > i
            single[has] = mixed(single[has]) + word[first[short[has]] + i] * SEEDS[i]
        owners, hashes = np.concatenate([owners, short]), np.concatenate([hashes, mixed(single)])
        order = np.argsort(owners, kind="stable")
        return owners[order], hashes[order]


def counted(owners: np.ndarray, hashes: np.ndarray):
    """Owner, hash and number of repeats of each different shingle, by owner and hash."""
    order = np.argsort(hashes)
    if len(owners) and owners[-1] < 65536:  # a radix sort
        order = order[np.argsort(owners[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(owners[order], kind="stable")]
    owners, hashes = owners[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    first = np.flatnonzero(new)
    return owners[first], hashes[first], np.diff(first, append=len(hashes))
