"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE = 300_000  # word hashes that a worker remembers; forgetting them changes no result
_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no trace of their order."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, number of words of each text); A-Z lower-cased, words between ASCII white space."""
        return self.of_words([t.lower().split() for t in texts])

    def of_words(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE:
            self.clear()
        counts = np.array([len(w) for w in words], np.int64)
        out = np.empty(int(counts.sum()), np.uint64)
        at = 0
        for w in words:
            out[at : at + len(w)] = np.fromiter(map(self.__getitem__, w), np.uint64, len(w))
            at += len(w)
        return out, counts


def shingle_sets(texts: list[bytes], k: int, words: WordHashes) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, sorted by hash; a text of fewer words is one shingle, one without words none."""
    h, counts = words.of(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            n = len(h) - k + 1
            all_of = np.full(n, np.uint64(k))
            for i in range(k):
                all_of = all_of * _STEP + h[i : i + n]
            all_of = scramble(all_of)
        out = []
        for end, c in zip(ends.tolist(), counts.tolist(), strict=True):
            if c >= k:
                out.append(np.unique(all_of[end - c : end - k + 1]))
            elif c:
                x = np.full(1, np.uint64(c))
                for i in range(end - c, end):
                    x = x * _STEP + h[i]
                out.append(scramble(x))
            else:
                out.append(np.empty(0, np.uint64))
    return out
