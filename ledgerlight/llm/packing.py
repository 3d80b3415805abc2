"""Packing of token sequences into training sequences of a fixed length by the sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlight.llm.store import Scratch
from ledgerlight.llm.text import tidy
from ledgerlight.llm.tokens import coder

#: Pieces that one task packs; each such bunch can leave one sequence that isn't full.
BUNCH = 50_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, and the ids themselves on demand.

    A document's tokens end with end_id; a null text counts as empty and has that id alone. Only longer documents are
    cut, and then the first piece is the shorter one. Rows with null or repeated ids are kept as they are. One pass over
    the texts, without a shuffle; other columns aren't read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = coder(vocabulary, "<u2"), np.array([end_id], "<u2")
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1))):
                ids = np.r_[body, end].astype("<u4")
                n, data = len(ids), memoryview(ids.tobytes())
                at, k = 0, 0
                while at < n:
                    to = at + ((n - 1) % capacity + 1 if k == 0 else capacity)
                    rows.append((doc, k, at, to - at, zlib.crc32(data[4 * at : 4 * to]), bytes(data[4 * at : 4 * to]) if with_ids else None))
                    at, k = to, k + 1
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(cut, tokens=True), _PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length (1 to capacity).

    Longest first, each goes to the open sequence for which the squared counts of open sequences per gap become
    smallest, and to a new one only if no gap is wide enough. Ties go to the smallest gap.
    """
    opened = np.zeros(capacity, np.int64)  # by gap; a full sequence isn't open
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]
    place, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gaps, left = opened[size:], opened[: capacity - size]
        # moving one sequence from gap g to g - size changes the sum by 2 * (count[g - size] - count[g]) + 2, and by 1 - 2 * count[g] if it gets full
        change = np.where(gaps > 0, 2 * (left - gaps) + 2, 1 << 60)
        if len(change) and gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] < 1 << 60:
            where, at = waiting[size + k].pop()
            opened[size + k] -= 1
        else:
            where, at, k, used = used, 0, capacity - size, used + 1
        place[i], offset[i] = where, at
        if k:
            opened[k] += 1
            waiting[k].append((where, at + size))
    return place, offset


def pack(pieces: DataFrame, capacity: int, bunch: int = BUNCH) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns, with length from 1 to capacity).

    Pieces are dealt at random into bunches, each packed in one task, so no task holds more than about a bunch and lengths
    are spread evenly. No pieces: an empty result. A length out of range raises.
    """
    spark = pieces.sparkSession
    parts = max(1, math.ceil(pieces.count() / bunch))
    key = [F.xxhash64(*(F.col(c) for c in pieces.columns if c != "ids"))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        if lengths.min() < 1 or lengths.max() > capacity:
            raise ValueError(f"a length is not between 1 and {capacity}")
        where, offset = sum_of_squares(lengths, capacity)
        table = table.append_column("sequence_id", pa.array((part << 40) + where)).append_column("offset", pa.array(offset))
        yield from table.to_batches()

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return pieces.repartition(parts, *key).mapInArrow(tidy(place), schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, what: str = "packing") -> DataFrame:
    """Pieces of all docs, packed. The pieces are written once to the shared folder, without their ids, so that nothing is tokenized twice."""
    pieces = Scratch(docs.sparkSession, what).save(token_pieces(docs, vocabulary, end_id, capacity), "pieces")
    return pack(pieces, capacity)
