"""Shards balanced in bytes, tokens and rows at once, by vector bin packing of groups.

Rows with equal texts form a group, which stays together. Groups are hashed to small buckets, a fixed number whatever the
input; a group too heavy for a bucket is counted and numbered in slices by its rows' ids, but packed whole as long as it
fits into a shard, and in quarters of a shard if it doesn't. The driver packs buckets and groups and sees a row for each
bucket or slice, never one for each document: heaviest first, each goes where the dot product of its vector with the
shard's residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each shard; a group heavier than a bucket should be is numbered in slices.
BUCKETS = 256
#: Parts of a shard's share in which a group that doesn't fit into a shard is packed.
CHUNKS = 4

_ROW_BYTES = 16


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector (a row of non-negative sizes). Sizes are taken relative to a shard's fair share in each dimension."""
    total = vectors.sum(0)
    share = vectors / np.where(total > 0, total / shards, 1)
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-share.max(1), kind="stable").tolist():
        fits = (left >= share[i] - 1e-12).all(1)
        worth = left @ share[i]
        if fits.any():
            worth = np.where(fits, worth, -np.inf)
        else:  # nothing has room in every dimension: where the largest overrun stays least
            worth = (left - share[i]).min(1)
        out[i] = int(worth.argmax())
        left[out[i]] -= share[i]
    return out


def units(sums: list[dict], shards: int) -> np.ndarray:
    """What each of sums (sorted by bucket, then piece) is packed with: buckets alone, slices of a group together.

    A group heavier than a shard's fair share in some dimension is cut into units of 1 / CHUNKS of that share.
    """
    sizes = np.array([[r["bytes"], r["tokens"], r["n"]] for r in sums], float).reshape(-1, 3)
    total = sizes.sum(0)
    share = sizes / np.where(total > 0, total / shards, 1)
    out, n, i = np.zeros(len(sums), np.int64), 0, 0
    while i < len(sums):
        j = i + 1
        while sums[i]["piece"] >= 0 and j < len(sums) and sums[j]["piece"] >= 0 and sums[j]["bucket"] == sums[i]["bucket"]:
            j += 1
        weight = share[i:j].sum(0).max()
        cuts = 1 if weight <= 1 + 1e-9 else int(np.ceil(weight * CHUNKS))
        before = np.cumsum(sizes[i:j, 2]) - sizes[i:j, 2]
        out[i:j] = n + (before * cuts // sizes[i:j, 2].sum()).astype(np.int64)
        n, i = n + cuts, j
    return out


def shard(docs: DataFrame, shards: int = 40, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), n_tokens (runs of characters other than ASCII white space), text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard).

    A null text has no bytes, counts as a text of its own, and has the checksum of nothing. Null and repeated ids are kept
    as rows. Equal texts share a shard unless their group is heavier than a shard's fair share in bytes, words or rows: then
    quarters of a shard of it do. No rows: no rows.

    Texts are read twice and never moved. The first shuffle counts groups after a partial count in each task, the second
    counts buckets (a bounded number of rows leaves it), and the last one numbers the rows of each bucket.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + _ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.size(F.array_remove(F.split(text, "[ \\t\\n\\r\\f\\x0B]+"), "")).cast("long").alias("n_tokens"),
        F.xxhash64(F.lit(7), F.col(text_col).isNull(), text).alias("group_key"),
        F.xxhash64(F.lit(11), text).alias("group_check"),
    )
    groups = rows.groupBy("group_key", "group_check").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).head()
    many = shards * buckets
    fair = {c: max(1.0, (total[c] or 0) / many) for c in ("bytes", "tokens", "n")}
    heaviness = F.greatest(*(F.col(c) / F.lit(fair[c]) for c in fair))
    # at most three times as many groups as buckets can be heavier than a bucket, so this is a bounded number of rows
    heavy = groups.where((heaviness > 1) & (F.col("n") > 1)).select("group_key", "group_check", F.least(F.ceil(heaviness), F.col("n")).cast("int").alias("pieces"))
    found = heavy.toArrow()
    heavy = spark.createDataFrame(found.to_pylist(), "group_key long, group_check long, pieces int")
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", "group_key"), F.col("pieces")).cast("int")).otherwise(-1)
    keyed = rows.join(F.broadcast(heavy), ["group_key", "group_check"], "left").withColumn("piece", piece)
    keyed = keyed.withColumn("bucket", F.when(F.col("piece") >= 0, F.col("group_key")).otherwise(F.pmod("group_key", F.lit(many)))).drop("pieces", "group_check")
    sums = keyed.groupBy("bucket", "piece").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).toArrow().to_pylist()
    sums.sort(key=lambda r: (r["piece"] >= 0, r["bucket"], r["piece"]))
    unit = units(sums, shards)
    vectors = np.zeros((int(unit.max(initial=-1)) + 1, 3))
    np.add.at(vectors, unit, np.array([[r["bytes"], r["tokens"], r["n"]] for r in sums], float).reshape(-1, 3))
    where = place(vectors, shards)[unit].tolist()
    begun, plan = [0] * shards, []
    for r, s in zip(sums, where):
        plan.append((r["bucket"], r["piece"], s, begun[s]))
        begun[s] += r["n"]
    placed = spark.createDataFrame(plan, "bucket long, piece int, shard int, before long")
    rank = F.row_number().over(Window.partitionBy("bucket", "piece").orderBy("doc_id", "group_key"))
    out = keyed.withColumn("rank", rank).join(F.broadcast(placed), ["bucket", "piece"])
    return out.select("doc_id", "size", "n_tokens", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))
