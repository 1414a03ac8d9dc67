"""Words of many texts at once: Arrow's UTF-8 buffers as numpy arrays, with no Python string per word.

A word is a maximal run of digits, letters (A-Z in lower case) and any character beyond ASCII. In UTF-8
every byte of a character beyond ASCII is 0x80 or more, so working by bytes gives the words exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0 to ``n`` of the base and of its inverse; kept by the worker for chunks, but not for longer texts."""
    if _powers and n <= CHUNK:
        return _powers
    out = []
    for base in (_BASE, _BASE_INVERSE):
        table = np.full(max(n, CHUNK) + 1, base, dtype=np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    if n <= CHUNK:
        _powers[:] = out
    return out


@dataclass
class Words:
    """Words of consecutive texts. ``first[d]:first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray  # lower-cased bytes of all texts
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray  # uint64 of each word
    sums: np.ndarray  # of the bytes' hashes, from which any part of a word has its own
    sizes: np.ndarray  # bytes of each text

    def __len__(self) -> int:
        return len(self.start)

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than n bytes, and the hashes of their first n bytes."""
        longer = np.flatnonzero(self.end - self.start > n)
        start = self.start[longer]
        return longer, mix((self.sums[start + n] - self.sums[start]) * _power_tables(len(self.data))[1][start])

    def prints(self) -> list[bytes | None]:
        """128 bits of each text's sequence of words; None for no words."""
        place = np.arange(len(self), dtype=np.uint64) - np.repeat(self.first[:-1], np.diff(self.first)).astype(np.uint64)
        out: list[bytes | None] = [None] * self.texts
        full = np.flatnonzero(np.diff(self.first) > 0)
        if len(full):
            heads = self.first[full]
            one = np.add.reduceat(mix(self.hash + place * np.uint64(0xD6E8FEB86659FD93)), heads)
            two = np.add.reduceat(mix((self.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)) + place * np.uint64(0x9E3779B97F4A7C15)), heads)
            for t, x, y in zip(full, one, two, strict=True):
                out[t] = x.tobytes() + y.tobytes()
        return out

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words that start at each word, and which of them stay inside one text. Another ``salt`` gives other hashes."""
        own = mix(self.hash + np.uint64(salt)) if salt else self.hash
        n = len(self) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out *= _GRAM
            out += own[j : j + n]
        last = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return mix(out), np.arange(n) + k <= last


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(raw: np.ndarray, at: np.ndarray) -> Words:
    data = _LOWER[raw]
    inside = _IS_WORD[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    heads, tails = at[:-1][full], at[1:][full] - 1
    begins[heads] = inside[heads]
    finishes[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return Words(data, start, end, np.searchsorted(start, at), mix((sums[end] - sums[start]) * down[start]), sums, np.diff(at))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, next row, words) of parts of about ``limit`` bytes; a longer text is a part of its own."""
    raw, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, stop, words_of(raw[at[row] : at[stop]], at[row : stop + 1] - at[row])
        row = stop
    pa.default_memory_pool().release_unused()


def sliding(least_or_most: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``least_or_most`` (np.minimum or np.maximum) over every full window of ``width`` values."""
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = least_or_most(x[:-size], x[size:])
        size *= 2
    return least_or_most(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def minimisers(words: Words, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions, and hashes, of the k-grams that are least in some window of ``width`` k-grams of their text.

    The choice depends on the window's content alone, so two texts that share ``k + width - 1`` words share a
    chosen k-gram inside them. Of equal hashes in a window all are chosen.
    """
    grams, _ = words.grams(k)
    least = sliding(np.minimum, grams, width)
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    last = np.repeat(words.first[1:], np.diff(words.first))[: len(least)]
    least = np.where(np.arange(len(least)) + (k + width - 1) <= last, least, np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), width) == grams)
    chosen = chosen[grams[chosen] != 0]
    return chosen, grams[chosen]
