"""Word shingles as sorted 64-bit hashes, built with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from scanloom.llm.common import ASCII_LOWER, mix64

_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word -> 64-bit hash; keeps at most `limit` words, which bounds the memory of a long task."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


class Shingler:
    """Sets of w-word shingles of texts: A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`."""

    def __init__(self, words: int = 5, table: int = 200_000):
        self.w, self.hashes = words, _Hashes(table)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's sorted distinct shingle hashes. Fewer than w words make one shingle of them all; no word, none."""
        words, counts = [], []
        for t in texts:
            own = t.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()  # ASCII white space: the contract's
            counts.append(len(own))
            words += own
        n, w = len(words), self.w
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        rolled = np.zeros(max(0, n - w + 1), np.uint64)
        out, start = [], 0
        with np.errstate(over="ignore"):
            for k in range(w if n >= w else 0):
                rolled = rolled * _STEP + h[k : n - w + 1 + k]
            rolled = mix64(rolled)
            for c in counts:
                if c >= w:
                    x = np.sort(rolled[start : start + c - w + 1])
                    out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
                elif c:
                    one = np.uint64(c)
                    for v in h[start : start + c]:
                        one = one * _STEP + v
                    out.append(mix64(np.array([one], np.uint64)))
                else:
                    out.append(np.empty(0, np.uint64))
                start += c
        return out
