"""Arrays that tasks send each other through a shuffle, as one blob for each partition and kind.

A shuffle deals rows by an integer that leads to the wanted partition (see store.homes). Kinds that a task doesn't open are
sent on to the partition they were meant for, so that several kinds can share the shuffles of one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAIL = "home int, kind int, blob binary"
_NAMES, _TYPES = ["home", "kind", "blob"], (pa.int32(), pa.int32(), pa.binary())


def order_and_cuts(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of to that occurs, and the indexes where."""
    order = np.argsort(to, kind="stable")
    ordered = to[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(to)]), len(to)]
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(ordered[i]), order[i:j]


class Mail:
    """What a task has to send."""

    def __init__(self, home: list[int]):
        self.home, self.sent = home, ([], [], [])

    def partition(self, by: np.ndarray) -> np.ndarray:
        return (by.view(np.uint64) % np.uint64(len(self.home))).astype(np.int64)

    def send(self, kind: int, by: np.ndarray, *arrays: np.ndarray) -> None:
        """Rows of several arrays of one item size, each to the partition of its element in by."""
        for p, rows in order_and_cuts(self.partition(by)):
            self.put(self.home[p], kind, b"".join(a[rows].tobytes() for a in arrays))

    def put(self, home: int, kind: int, blob: bytes) -> None:
        for column, value in zip(self.sent, (home, kind, blob)):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        columns, self.sent = self.sent, ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def opened(batches: Iterator[pa.RecordBatch], mail: Mail | None, kinds: set[int]) -> dict[int, list[bytes]]:
    """The blobs of each of kinds; others are sent on."""
    held: dict[int, list[bytes]] = {kind: [] for kind in kinds}
    for batch in batches:
        for home, kind, blob in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if kind in held:
                held[kind].append(blob)
            else:
                mail.put(home, kind, blob)
    return held


def columns(blobs: list[bytes], n: int) -> np.ndarray:
    """What send() put into blobs of n arrays with items of eight bytes: an unsigned array with a row for each."""
    parts = [np.frombuffer(b, np.uint64).reshape(n, -1) for b in blobs]
    return np.concatenate(parts, axis=1) if parts else np.zeros((n, 0), np.uint64)
