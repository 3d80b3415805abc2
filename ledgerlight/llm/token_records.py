"""Token ids as framed binary records, with an offset index beside them.

A record file is a row of frames: length (8 bytes, little-endian), masked checksum of those 8 bytes (4), payload, masked
checksum of the payload (4). The mask rotates a CRC-32 right by 15 bits and adds 0xA282EAD8, so that a checksum of data
that holds checksums stays sound. A payload is a flag (1: the document has an id), the id (8 bytes), the width of a token
id in bytes, and the token ids. The index file has 24 bytes for each record: offset of its frame, length of the frame,
and the number of tokens before it in the file. Readers that shuffle need the index alone to draw records in any order.

Each task writes files under names of its own attempt, and reports them; a Parquet table `manifest`, which Spark commits,
lists the files of the attempts that counted. Files of lost attempts are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.store import shuffle_width
from ledgerlight.llm.text import tidy
from ledgerlight.llm.tokens import coder

INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("tokens_before", "<u8")])
_HEAD = "<BqB"
_HEAD_SIZE = struct.calcsize(_HEAD)
#: Bytes after which a task begins another file, and records that a reader hands on at once.
ROLL, HAND = 64 << 20, 4 << 20

_MANIFEST = "part int, file int, name string, records long, tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """Payload of the frame at a place, and where the next begins. Raises ValueError if a checksum doesn't hold."""
    head = data[at : at + 12]
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"damaged length of the record at {at}")
    end = at + 12 + struct.unpack("<Q", head[:8])[0]
    payload = data[at + 12 : end]
    if len(data) < end + 4 or struct.unpack("<I", data[end : end + 4])[0] != masked(payload):
        raise ValueError(f"damaged payload of the record at {at}")
    return payload, end + 4


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_records(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenizes docs and writes them in ascending order of id_col under path (a URI that driver and executors share).

    A null text counts as empty: its record has the end id alone. Null ids come first. Rows with the same id are kept,
    in the order of their texts' hashes; equal rows are all written. Other columns aren't read. No rows: an empty manifest.
    One range shuffle moves the texts; the hash beside the id lets one id's rows spread over several tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    docs_folder = path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _folder(docs_folder)
        store.create_dir(folder, recursive=True)
        part, encode = TaskContext.get().partitionId(), coder(vocabulary, f"<u{width}")
        end, out, report = np.array([end_id], f"<u{width}").tobytes(), None, []

        def close():
            if out is not None:
                out.close()
                with store.open_output_stream(f"{folder}/{name}.idx") as f:
                    f.write(np.array(index, INDEX).tobytes())
                report.append((part, len(report), name, len(index), tokens))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, body in zip(ids, encode.encode(batch.column(1))):
                if out is None or size >= ROLL:
                    close()
                    name, index, size, tokens = f"{part:06d}-{len(report):04d}-{uuid.uuid4().hex[:12]}", [], 0, 0
                    out = store.open_output_stream(f"{folder}/{name}.rec")
                framed = frame(struct.pack(_HEAD, doc is not None, doc or 0, width) + body.tobytes() + end)
                out.write(framed)
                index.append((size, len(framed), tokens))
                size += len(framed)
                tokens += len(body) + 1
        close()
        columns = list(zip(*report)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "file", "name", "records", "tokens"])

    rows.mapInArrow(tidy(write, tokens=True), _MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file, in order, with the tokens of all files before it. It grows by a row for each 64 MB."""
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))


def read_token_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record, checked: doc_id, start (tokens of all records before it), n_tokens, ids (little-endian unsigned 32-bit).

    A damaged frame, or an index that doesn't agree with its file, raises.
    """
    files = manifest(spark, path).repartition(shuffle_width(spark), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{folder}/{row['name']}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with store.open_input_file(f"{folder}/{row['name']}.rec") as f:
                    i = 0
                    while i < len(index):
                        j, base = i, int(index["offset"][i])
                        while j < len(index) and (j == i or int(index["offset"][j] + index["length"][j]) - base <= HAND):
                            j += 1
                        f.seek(base)
                        data = f.read(int(index["offset"][j - 1] + index["length"][j - 1]) - base)
                        yield _rows(data, index[i:j], base, row["before"])
                        i = j

    return files.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids binary")


def _rows(data: bytes, index: np.ndarray, base: int, before: int) -> pa.RecordBatch:
    docs, starts, counts, ids = [], [], [], []
    for offset, length, tokens in index.tolist():
        payload, after = unframe(data, offset - base)
        if after != offset - base + length:
            raise ValueError(f"the index doesn't agree with the record at {offset}")
        known, doc, width = struct.unpack_from(_HEAD, payload)
        found = np.frombuffer(payload, f"<u{width}", offset=_HEAD_SIZE)
        docs.append(doc if known else None)
        starts.append(before + tokens)
        counts.append(len(found))
        ids.append(found.astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """The records in a random order that the seed decides: epoch_key sorts them; each is read by its entry of the index."""
    files = manifest(spark, path).repartition(shuffle_width(spark), "name")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{folder}/{row['name']}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                n = len(index)
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]] * n, pa.string()), pa.array([row["before"]] * n, pa.int64()), *(pa.array(index[c].astype(np.int64)) for c in INDEX.names)], ["name", "before", *INDEX.names])

    order = F.xxhash64(F.lit(seed), "name", "offset")
    drawn = files.mapInArrow(entries, "name string, before long, offset long, length long, tokens_before long").withColumn("epoch_key", order)
    drawn = drawn.repartitionByRange(shuffle_width(spark), "epoch_key").sortWithinPartitions("epoch_key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{folder}/{row['name']}.rec") as f:
                    f.seek(row["offset"])
                    one = np.array([(row["offset"], row["length"], row["tokens_before"])], INDEX)
                    got = _rows(f.read(row["length"]), one, row["offset"], row["before"])
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array([row["epoch_key"]], pa.int64())], [*got.schema.names, "epoch_key"])

    return drawn.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, epoch_key long")
