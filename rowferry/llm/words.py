"""64-bit hashes of the words of texts, in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a single longer word is taken whole.
CHUNK = 1 << 19

#: Rows of an Arrow batch that are turned into Python objects together.
ROWS = 500

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes that separate words.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NO_WORD = np.ones(256, bool)
NO_WORD[48:58] = NO_WORD[65:91] = NO_WORD[97:123] = NO_WORD[128:] = False

_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2^64, to the powers 0 to n - 1."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 64)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others; in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


def hash_words(raw: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, start and end of each word of the bytes."""
    apart = np.empty(len(raw) + 2, bool)
    apart[0] = apart[-1] = True
    np.take(separators, raw, out=apart[1:-1])
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), starts, ends


def _segments(raw: np.ndarray, separators: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes in runs of about CHUNK, cut at separators."""
    start = 0
    while len(raw) - start > CHUNK:
        cut = start + CHUNK
        inside = np.flatnonzero(separators[raw[start:cut]])
        if len(inside):
            cut = start + int(inside[-1]) + 1
        else:
            while cut < len(raw) and not separators[raw[cut]]:
                cut += 1
        yield raw[start:cut]
        start = cut
    yield raw[start:]


def word_lists(texts: Iterable[str | None], separators: np.ndarray = SPACES) -> Iterator[np.ndarray]:
    """The word hashes of each text, A-Z lower-cased; null has none."""
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode()
        if size + len(data) > CHUNK:
            yield from _together(waiting, separators)
            waiting, size = [], 0
        if len(data) > CHUNK:
            parts = [hash_words(part, separators)[0] for part in _segments(np.frombuffer(data, np.uint8), separators)]
            yield np.concatenate(parts)
        else:
            waiting.append(data)
            size += len(data) + 1
    yield from _together(waiting, separators)


def _together(waiting: list[bytes], separators: np.ndarray) -> Iterator[np.ndarray]:
    if not waiting:
        return
    hashes, starts, _ = hash_words(np.frombuffer(b"\n".join(waiting), np.uint8), separators)
    ends = np.cumsum([len(data) + 1 for data in waiting])
    yield from np.split(hashes, np.searchsorted(starts, ends)[:-1])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of so many words, sorted; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = min(size, len(words))
    count = len(words) - n + 1
    factors, _ = powers(2 * size + 2)
    total = np.full(count, (size - n) * int(factors[-1]) % (1 << 64), np.uint64)
    for at in range(n):
        total += words[at : at + count] * factors[2 * at + 1]
    return np.unique(mixed(total))


def slices(batch, rows: int = ROWS):
    """An Arrow batch in parts of few rows, as its texts take more room as Python objects."""
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def give_back() -> None:
    """Return what a step no longer uses to the system, as its worker stays for steps of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has it
    if trim is not None:
        trim(0)
