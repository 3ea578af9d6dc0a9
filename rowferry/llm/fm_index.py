"""A bidirectional FM-index over delimited words, and searches for words that are one edit away."""

from __future__ import annotations

import numpy as np

#: Words that are searched for together.
TOGETHER = 2048

#: Steps after which equal intervals become one.
MERGE = 16


def sorted_rotations(text: np.ndarray) -> np.ndarray:
    """The starts of all rotations of a text without period, in order: ranks of 8 symbols, doubled until all differ."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    k = 8
    while True:
        order = np.argsort(key, kind="stable")
        inorder = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, inorder[1:] != inorder[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * n + np.roll(rank, -k)
        k *= 2


class Ranks:
    """How often each symbol occurs before a place of the transformed text: a bit per symbol and place, and counts by 64 places."""

    def __init__(self, text: np.ndarray, symbols: int):
        last = np.roll(text, 1)[sorted_rotations(text)]
        blocks = len(last) // 64 + 1
        padded = np.full(blocks * 64, 255, np.uint8)
        padded[: len(last)] = last
        self.bits = np.empty((blocks, symbols), np.uint64)
        for c in range(symbols):
            self.bits[:, c] = np.packbits(padded == c, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.bits).astype(np.int32)
        self.first = np.cumsum(np.r_[0, counts.sum(axis=0, dtype=np.int64)])[:-1]
        #: The first row of each symbol is added in, so that a rank is a row of the index.
        self.before = np.cumsum(counts, axis=0, dtype=np.int64) - counts + self.first

    def _masks(self, at: np.ndarray) -> np.ndarray:
        return (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)

    def row(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row that a boundary moves to with one more symbol."""
        block = at >> 6
        return self.before[block, symbol] + np.bitwise_count(self.bits[block, symbol] & self._masks(at))

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The same for every symbol."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.bits[block] & self._masks(at)[:, None])


class WordIndex:
    """Both directions of an FM-index over distinct words of single bytes, each word between delimiters.

    A pair of intervals stands for a text: the rows of the rotations that start
    with it, and of those of the reversed text that start with it reversed.
    """

    def __init__(self, words: list[bytes]):
        self.words = sorted(words)
        used, coded = np.unique(np.frombuffer(b"\0" + b"\0".join(self.words), np.uint8), return_inverse=True)
        self.text = coded.astype(np.uint8)
        lengths = np.array([len(w) for w in self.words])
        #: Where each word starts; the delimiter stands before it.
        self.starts = np.cumsum(np.r_[0, lengths[:-1] + 1]) + 1
        self.lengths = lengths
        self.symbols = len(used)
        backwards = self.text[::-1]
        self.left, self.right = Ranks(self.text, self.symbols), Ranks(backwards, self.symbols)
        # A row that starts with a delimiter stands for a word: in the order of the words, or of the words reversed.
        self.by_left = np.arange(len(self.words))
        self.by_right = np.array(sorted(range(len(self.words)), key=lambda i: self.words[i][::-1]), dtype=np.int64)

    def _extended(self, ranks: Ranks, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, other: np.ndarray):
        """Intervals with one more symbol on the side of the ranks, and the first row of the other side's interval."""
        lows, highs = ranks.rows(low), ranks.rows(high)
        at = np.arange(len(low))
        smaller = np.cumsum(highs - lows, axis=1)[at, symbol] - (highs[at, symbol] - lows[at, symbol])
        return lows[at, symbol], highs[at, symbol], other + smaller

    def one_edit(self, words: np.ndarray, suffix: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, near): for each given word those with one edit outside its first (or last) half, which matches exactly.

        The exact half has half of a shorter word's symbols, rounded down at the front and up at the back:
        of two words with one edit between them, each finds the other by its front or by its back half.
        """
        parts = [self._one_edit(words[at : at + TOGETHER], suffix) for at in range(0, len(words), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2

    def _one_edit(self, words: np.ndarray, suffix: bool) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths = self.starts[words], self.lengths[words]
        half = lengths // 2 if suffix else (lengths - 1) // 2
        size = len(self.text)
        # Exact part: from its inner end to the delimiter at the end of the word, both intervals kept.
        exact, loose, way = (self.right, self.left, 1) if suffix else (self.left, self.right, -1)
        inner = starts + lengths - half if suffix else starts + half - 1
        low, high, other = np.zeros(len(words), np.int64), np.full(len(words), size), np.zeros(len(words), np.int64)
        for t in range(int(half.max(initial=0)) + 1):
            on = np.flatnonzero(t <= half)
            symbol = self.text[(inner[on] + way * t) % size].astype(np.int64)
            low[on], high[on], other[on] = self._extended(exact, symbol, low[on], high[on], other[on])
        # Loose part: the other way, with one error; now the other interval is the one that is narrowed.
        first = inner - way
        rest = lengths - half  # symbols before the delimiter
        query, low, high = np.arange(len(words)), other, other + (high - low)
        wrong = tuple(np.empty(0, np.int64) for _ in range(3))  # query, low, high after the error
        for t in range(int(rest.max(initial=0)) + 1):
            on = t <= rest[query]
            query, low, high = query[on], low[on], high[on]
            lows, highs = loose.rows(low), loose.rows(high)
            symbol = self.text[(first[query] - way * t) % size].astype(np.int64)
            letter = t < rest[query]
            some = highs > lows
            some[:, 0] = False  # no error puts in a delimiter
            q, c = np.nonzero(some)
            inserted = query[q], lows[q, c], highs[q, c]
            at = letter[q] & (c != symbol[q])
            replaced = query[q[at]], lows[q[at], c[at]], highs[q[at], c[at]]
            deleted = query[letter], low[letter], high[letter]
            # Those with an error, the inserted symbol before this one among them, go on exactly.
            waiting = [np.concatenate(x) for x in zip(wrong, inserted, strict=True)]
            ended = t > rest[waiting[0]]
            done, going = [x[ended] for x in waiting], [x[~ended] for x in waiting]
            symbols = self.text[(first[going[0]] - way * t) % size].astype(np.int64)
            stepped = going[0], loose.row(symbols, going[1]), loose.row(symbols, going[2])
            wrong = [np.concatenate(x) for x in zip(done, stepped, replaced, deleted, strict=True)]
            alive = wrong[2] > wrong[1]
            wrong = tuple(x[alive] for x in wrong)
            if t % MERGE == MERGE - 1:  # within a run of one letter, errors at all its places lead to the same interval
                wrong = tuple(np.unique(np.stack(wrong), axis=1))
            at = np.arange(len(query))
            low, high = lows[at, symbol], highs[at, symbol]
        names = self.by_left if suffix else self.by_right
        pairs = np.unique(np.stack([wrong[0], wrong[1]]), axis=1)
        return words[pairs[0]], names[pairs[1]]
