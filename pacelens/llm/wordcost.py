"""Additive per-word costs, computed once per distinct word inside a worker.

Two operators score texts by models over the bytes of single words.  A word's cost
under every model is a row of a table; a text's cost is the sum of its words' rows.
Distinct words are scored together in numpy, and the table is emptied when it
reaches its bound, so memory does not grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

SPACE = 32
GROUP_CHARS = 2_000_000


def frames(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words set between single spaces: (packed grams, first gram of each word).

    Every byte after a word's leading space, and the closing space, is a symbol;
    its context is what precedes it in the same word, ``order`` bytes at most.
    A gram holds the symbol in its lowest byte, nearer context below farther,
    and the context's length in bits 40 to 42.
    """
    a = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    at = np.arange(len(a))
    space = a == SPACE
    last = np.maximum.accumulate(np.where(space, at, 0))
    depth = np.minimum(at[1:] - last[:-1], order)
    packed = a[1:].copy()
    for j in range(1, min(order, len(packed)) + 1):
        inside = depth >= j
        back = np.zeros(len(packed), dtype=np.int64)
        back[j - 1 :] = a[: len(a) - j]
        packed |= np.where(inside, back << (8 * j), 0)
    return packed | (depth << 40), np.flatnonzero(space)[:-1]


class WordCosts:
    """Rows of costs by word; ``price`` gives the cost rows of unique packed grams, ``finish`` may rework a word's summed row."""

    def __init__(self, price: Callable[[np.ndarray], np.ndarray], width: int, order: int, most_words: int = 220_000, most_grams: int = 200_000, finish: Callable[[np.ndarray], np.ndarray] | None = None):
        self.price, self.width, self.order, self.finish = price, width, order, finish
        self.most_words, self.most_grams = most_words, most_grams
        self.words: dict[str | bytes, int] = {}
        self.grams: dict[int, int] = {}
        self.word_rows = np.zeros((1024, width), dtype=np.float32)
        self.gram_rows = np.zeros((1024, width), dtype=np.float32)

    @staticmethod
    def _grown(rows: np.ndarray, needed: int) -> np.ndarray:
        if needed <= len(rows):
            return rows
        more = np.zeros((max(needed, 2 * len(rows)), rows.shape[1]), dtype=rows.dtype)
        more[: len(rows)] = rows
        return more

    def _gram_costs(self, packed: np.ndarray) -> np.ndarray:
        unique, inverse = np.unique(packed, return_inverse=True)
        if len(self.grams) + len(unique) > self.most_grams:
            self.grams.clear()
        known = self.grams
        ids = np.fromiter((known.get(g, -1) for g in unique.tolist()), dtype=np.int64, count=len(unique))
        missing = ids < 0
        if missing.any():
            first, n = len(known), int(missing.sum())
            self.gram_rows = self._grown(self.gram_rows, first + n)
            self.gram_rows[first : first + n] = self.price(unique[missing])
            ids[missing] = np.arange(first, first + n)
            known.update(zip(unique[missing].tolist(), range(first, first + n)))
        return self.gram_rows[ids[inverse]]

    def _learn(self, new: list) -> None:
        packed, starts = frames([w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in new], self.order)
        first = len(self.words)
        self.word_rows = self._grown(self.word_rows, first + len(new))
        rows = np.add.reduceat(self._gram_costs(packed), starts, axis=0)
        self.word_rows[first : first + len(new)] = rows if self.finish is None else self.finish(rows)
        self.words.update(zip(new, range(first, first + len(new))))

    def totals(self, texts: list[list]) -> np.ndarray:
        """Summed cost rows of each list of words (str, or bytes without a space)."""
        out = np.zeros((len(texts), self.width))
        distinct = set(chain.from_iterable(texts))
        if len(self.words) + len(distinct) > self.most_words:
            self.words.clear()
        new = [w for w in distinct if w not in self.words]
        for i in range(0, len(new), 50_000):
            self._learn(new[i : i + 50_000])
        row = self.words.__getitem__
        for i, words in enumerate(texts):
            if words:
                out[i] = self.word_rows[np.fromiter(map(row, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64)
        return out


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of texts with a bounded number of characters together."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars >= GROUP_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
