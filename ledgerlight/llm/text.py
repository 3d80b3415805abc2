"""Vectorised words and word sequences of Arrow string columns.

A column's bytes are hashed in place, eight at a time, so no Python string is made for a word. Hashes have 64 bits: each
eight bytes of a word are mixed with their place in it before they are added up, so that words of any pattern differ by
chance alone. Sequences of words get theirs from their words'. A block of text takes some ten times its bytes while its
words are found; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK = 2 << 20

U = np.uint64
#: Masks of the first i bytes of eight.
_HEADS = np.array([(1 << 8 * i) - 1 for i in range(9)], U)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything but letters, digits and bytes of longer UTF-8 sequences.
PUNCTUATION = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    PUNCTUATION[_a:_b] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; none is empty."""
    if not len(start):
        return np.zeros(0, U)
    size = stop - start
    eights = np.ndarray((len(data) + 1,), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))
    h = mix((eights[start] & _HEADS[np.minimum(size, 8)]) ^ U(0x2545F4914F6CDD1D))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        head = np.cumsum(more) - more
        turn = np.arange(int(more.sum())) - np.repeat(head, more) + 1
        at = np.repeat(start[long], more) + 8 * turn
        left = np.minimum(np.repeat(stop[long], more) - at, 8)
        h[long] += np.add.reduceat(mix((eights[at] & _HEADS[left]) ^ mix(turn.astype(U))), head)
    return mix(h ^ (size.astype(U) * U(0x9E3779B97F4A7C15)))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is an empty text."""
    array = batch.column(batch.schema.get_field_index(name))
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of consecutive texts: hash, start and end byte of each; first[i]:first[i + 1] are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = SPACE):
        low = int(offsets[0])
        data, ends = data[low : int(offsets[-1])], offsets - low
        gap = apart[data]
        word = ~gap
        starts, stops = word.copy(), word.copy()
        if len(data):
            starts[1:] &= gap[:-1]
            stops[:-1] &= gap[1:]
            some = ends[:-1][ends[1:] > ends[:-1]]
            starts[some] |= word[some]
            last = ends[1:][ends[1:] > ends[:-1]] - 1
            stops[last] |= word[last]
        self.start, self.stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.data, self.ends = data, ends
        self.first = np.searchsorted(self.start, ends)
        self.hash = spans(LOWER[data] if lower else data, self.start, self.stop)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k elements from each position on, as if all were one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, k, U)
    for j in range(k):
        h = (h ^ hashes[j : j + n]) * U(0xFF51AFD7ED558CCD)
        h ^= h >> U(29)
    return mix(h)


def whole(hashes: np.ndarray) -> int:
    """Hash of a sequence shorter than a run."""
    h = 0x51ED270B
    for x in hashes.tolist():
        h = ((h ^ x) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h ^ len(hashes)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word sequences of lower-cased words, sorted; shorter texts have their whole sequence, empty ones nothing."""
    for i, j in blocks(offsets):
        words = Words(data, offsets[i : j + 1], lower=True)
        every, first = runs(words.hash, k), words.first
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                found = np.sort(every[a : b - k + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            else:
                yield np.array([whole(words.hash[a:b])] if b > a else [], U)


def tidy(work: Callable, tokens: bool = False) -> Callable:
    """work over a task's batches, between two clearances: Python workers are reused, and what a task leaves adds up with what the next ones take.

    Without tokens, the caches of tokenizers go as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear(tokens)
        try:
            yield from work(batches)
        finally:
            clear(tokens)

    return run


def clear(tokens: bool) -> None:
    if not tokens and "ledgerlight.llm.tokens" in sys.modules:
        sys.modules["ledgerlight.llm.tokens"]._coders.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
