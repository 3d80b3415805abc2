"""Token ids by the tokenizers library, with a bounded cache of chunks.

A text is cut before single spaces and line ends, and before a full stop or comma that ends a chunk after a letter. Neither
kind of vocabulary lets a token cross such a place, so the ids of a text are those of its chunks, one after another. Chunks
are found and looked up by hash, many texts at once; those that are new are encoded in one call of the library, and the ids
are dealt out again by the bytes that each token stands for. Texts with other white space, with runs of it, or with what may
be the string of a special token are encoded as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerlight.llm import text as T

#: Longer chunks aren't kept; with more than so many the cache is emptied; bytes of texts that are looked up at once.
LONGEST, MOST, BLOCK = 48, 1_500_000, 2 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_ODD = np.zeros(256, bool)  # other white space of one byte, and what separates like it
_ODD[[0x00, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x2C]] = True

_coders: dict[tuple[str, str], "Coder"] = {}


class Coder:
    """Ids of texts, as little-endian integers of the given type."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given this process one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(kind)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << (8 * self.kind.itemsize):
            raise ValueError(f"ids of {path} don't fit {kind}")
        self.drops_space = len(self.whole(" \n ")) == 0
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix("</w>") if self.drops_space else token)
        self.special = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Empties the cache: hashes in order, and where each one's ids begin and how many they are."""
        self.hashes, self.first, self.many = np.zeros(0, T.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _uncut(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which texts must be encoded as a whole."""
        gap = _GAP[data]
        bad = _ODD[data]
        bad[1:] |= gap[1:] & gap[:-1]
        edge = ends[1:][ends[1:] > ends[:-1]] - 1
        bad[ends[:-1][ends[1:] > ends[:-1]]] |= gap[ends[:-1][ends[1:] > ends[:-1]]]
        bad[edge] |= gap[edge]
        far = np.r_[data, np.zeros(2, np.uint8)]
        for one in np.unique(np.array([list(x) for x in self.special if len(x) == 2], np.uint8).reshape(-1, 2), axis=0):
            at = np.flatnonzero(data == one[0])
            bad[at[far[at + 1] == one[1]]] = True
        at = np.flatnonzero((data >= 0xC2) & (data <= 0xE3))
        a, b, c = data[at], far[at + 1], far[at + 2]
        wide = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        wide |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        bad[at[wide]] = True
        total = np.r_[0, np.cumsum(bad)]
        return total[ends[1:]] > total[ends[:-1]]

    def _chunks(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks begin and end; spaces and line ends lead a chunk, or are left out if the vocabulary drops them."""
        gap = _GAP[data]
        last = np.zeros(len(data), bool)  # last bytes of what stands between gaps
        last[:-1] = gap[1:] & ~gap[:-1]
        last[ends[1:][ends[1:] > ends[:-1]] - 1] = True
        stop = last & _STOP[data]
        stop[1:] &= _LETTER[data[:-1]]
        stop[ends[:-1][ends[:-1] < len(data)]] = False
        begins = gap | stop
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        start = np.flatnonzero(begins)
        end = np.r_[start[1:], len(data)]
        return (start + gap[start], end) if self.drops_space else (start, end)

    def _several(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which chunks can be encoded together: in lower case and normal form they have as many bytes as before."""
        fits = end - start <= LONGEST
        if not self.drops_space:
            return fits & _GAP[data[start]] & (end - start > 1)
        after = np.r_[data[1:], np.zeros(1, np.uint8)]
        odd = (data < 0x21) | (data == 0x7F) | (data > 0xC5) | ((data == 0xC2) & (after < 0xA1)) | ((data == 0xC4) & (after == 0xB0)) | ((data == 0xC5) & ((after == 0x89) | (after == 0xBF)))
        total = np.r_[0, np.cumsum(odd)]
        return fits & (total[end] == total[start])

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Puts new chunks into the cache."""
        several = self._several(data, start, end)
        many, alone = np.zeros(len(start), np.int64), np.ones(len(start), bool)
        found = []
        if several.any():
            size = (end - start)[several]
            room = size + self.drops_space
            at = np.repeat(start[several] - np.cumsum(room) + room, room) + np.arange(int(room.sum()))
            joined = data[at] if not self.drops_space else np.where(np.arange(len(at)) == np.repeat(np.cumsum(room) - 1, room), np.uint8(0x20), np.r_[data, np.uint8(0)][at])
            ids = np.array(self.tokenizer.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, np.int64)
            ends, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(size)
            cuts = np.searchsorted(ends, wanted) + 1
            if len(ends) and ends[-1] == wanted[-1] and (ends[cuts - 1] == wanted).all():
                found.append(ids.astype(self.kind))
                many[several], alone = np.diff(np.r_[0, cuts]), ~several
        raw = data.tobytes() if alone.any() else b""
        for i in np.flatnonzero(alone).tolist():
            found.append(self.whole(raw[start[i] : end[i]].decode()))
            many[i] = len(found[-1])
        need = self.used + int(many.sum())
        if need > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.zeros(need - self.used + (need >> 1), self.kind)]
        self.ids[self.used : need] = np.concatenate(found)
        first, order = np.zeros(len(many), np.int64), np.r_[np.flatnonzero(~alone), np.flatnonzero(alone)]
        first[order] = self.used + np.cumsum(many[order]) - many[order]
        self.used = need
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.many = np.insert(self.hashes, at, hashes), np.insert(self.first, at, first), np.insert(self.many, at, many)

    def _encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that can be cut, and how many each has."""
        start, end = self._chunks(data, ends)
        some = end > start
        start, end = start[some], end[some]
        hashes = T.spans(data, start, end)
        order = np.argsort(hashes)
        ordered = hashes[order]
        head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        which = np.empty(len(hashes), np.int64)
        which[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(ordered)]))
        distinct, sample = ordered[head], order[head]
        if len(self.hashes) + len(distinct) > MOST:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(data, start[sample[new]], end[sample[new]], distinct[new])
        at = np.searchsorted(self.hashes, distinct)
        first, many = self.first[at][which], self.many[at][which]
        total = np.cumsum(many)
        ids = self.ids[np.repeat(first - total + many, many) + np.arange(int(total[-1]) if len(total) else 0)]
        before = np.r_[0, total][np.searchsorted(start, ends)]
        return ids, np.diff(before)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column; a null is an empty text."""
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        data, offsets = T.column(batch, "text")
        for i, j in T.blocks(offsets, BLOCK):
            low = int(offsets[i])
            part, ends = data[low : int(offsets[j])], offsets[i : j + 1] - low
            if not len(part):
                yield from [np.zeros(0, self.kind)] * (j - i)
                continue
            uncut = self._uncut(part, ends)
            if uncut.any():
                keep = np.repeat(~uncut, np.diff(ends))
                ids, many = self._encode(part[keep], np.r_[0, np.cumsum(np.where(uncut, 0, np.diff(ends)))])
            else:
                ids, many = self._encode(part, ends)
            raw, at = part.tobytes() if uncut.any() else b"", 0
            for k, n in enumerate(many.tolist()):
                if uncut[k]:
                    yield self.whole(raw[ends[k] : ends[k + 1]].decode())
                else:
                    yield ids[at : at + n]
                    at += n


def coder(path: str, kind: str = "<u4") -> Coder:
    """One for each worker process."""
    if (path, kind) not in _coders:
        _coders[path, kind] = Coder(path, kind)
    return _coders[path, kind]
