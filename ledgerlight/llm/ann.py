"""Nearest neighbours by a forest of random-projection trees.

The trees are grown in the driver over a bounded sample of vectors; then every vector is put into a leaf of each tree. A
query walks all trees through one priority queue, in which a subtree waits with the largest margin by which the query lies on
its other side, until the leaves it has reached hold enough candidates. Those are ranked by their exact inner products.
How many are enough is measured on the sample, against brute force there: few where vectors form groups, and a large part
of all where they are spread evenly.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.store import Scratch

#: Vectors that the trees are grown over, trees, the recall aimed at and the queries that it is measured with, rows of a leaf and queries in one task, and least number of bins of leaves.
SAMPLE, TREES, RECALL, PROBES, TASK_ROWS, TASK_ASKS, BINS = 20_000, 4, 0.96, 200, 20_000, 20_000, 16
#: Budgets that are tried, as shares of all vectors; those seen in several trees count in each.
SHARES = (0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 3.0)


class Tree:
    """Node i: normal[i] and offset[i], with children left[i] and right[i]; a negative child is leaf -1 - child."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normal, self.offset, self.left, self.right, self.sizes = [], [], [], [], []
        self.top = self._grow(x, np.arange(len(x)), leaf, rng)
        self.normal = np.array(self.normal).reshape(-1, x.shape[1])

    def _grow(self, x, rows, leaf, rng) -> int:
        side = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = a / max(np.linalg.norm(a), 1e-30) - b / max(np.linalg.norm(b), 1e-30)
                if not (size := np.linalg.norm(normal)):
                    continue
                normal /= size
                height = x[rows] @ normal
                offset = float(np.median(height))
                side = height > offset
                if 0.1 < side.mean() < 0.9:
                    break
                side = None
        if side is None:
            self.sizes.append(len(rows))
            return -len(self.sizes)
        i = len(self.offset)
        self.normal.append(normal)
        self.offset.append(offset)
        self.left.append(0)
        self.right.append(0)
        self.left[i] = self._grow(x, rows[~side], leaf, rng)
        self.right[i] = self._grow(x, rows[side], leaf, rng)
        return i

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.full(len(x), -1 - self.top if self.top < 0 else -1)
        waiting = [(self.top, np.arange(len(x)))] if self.top >= 0 else []
        while waiting:
            i, rows = waiting.pop()
            up = x[rows] @ self.normal[i] > self.offset[i]
            for child, part in ((self.left[i], rows[~up]), (self.right[i], rows[up])):
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    waiting.append((child, part))
        return out


def reached(trees: list[Tree], q: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Leaves of all trees, nearest first, until they hold wanted vectors of the sample."""
    heap = [(0.0, t, tree.top) for t, tree in enumerate(trees)]
    margin = [tree.normal @ q - tree.offset for tree in trees]
    out, held = [], 0
    while heap and held < wanted:
        far, t, i = heapq.heappop(heap)
        tree = trees[t]
        while i >= 0:
            m = float(margin[t][i])
            near, other = (tree.right[i], tree.left[i]) if m > 0 else (tree.left[i], tree.right[i])
            heapq.heappush(heap, (max(far, abs(m)), t, other))
            i = near
        out.append((t, -1 - i))
        held += tree.sizes[-1 - i]
    return out


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Rows on the unit sphere of one more dimension, where the nearest to a query's direction have the largest inner products with it."""
    v = v / longest
    return np.c_[v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))]


def direction(q: np.ndarray) -> np.ndarray:
    return np.r_[q / np.linalg.norm(q), 0.0]


def budget(forest: list[Tree], x: np.ndarray, k: int, recall: float) -> float:
    """x: lifted. Vectors of the sample that a query has to reach, measured: the least share with which probes find enough of their k nearest in the sample."""
    seats = [tree.leaves(x) for tree in forest]
    probes = np.random.default_rng(23).choice(len(x), min(PROBES, len(x)), replace=False)
    wanted = []
    for q in probes.tolist():
        scores = x[:, :-1] @ x[q, :-1]
        scores[q] = -np.inf
        wanted.append(np.argsort(-scores)[: min(k, len(x) - 1)])
    every = [reached(forest, direction(x[q, :-1]), math.inf) for q in probes]
    for share in SHARES:
        hit = total = 0
        for q, near, walk in zip(probes, wanted, every):
            held, seen = 0, set()
            for t, leaf in walk:
                if held >= share * len(x):
                    break
                seen.add((t, leaf))
                held += forest[t].sizes[leaf]
            hit += sum(any((t, seats[t][i]) in seen for t in range(len(forest))) for i in near.tolist())
            total += len(near)
        if hit >= recall * total:
            return share * len(x)
    return math.inf


def nearest(vectors: DataFrame, asks, k: int = 20, trees: int = TREES, recall: float = RECALL, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row where asks holds, the k others with the largest inner product.

    Ties go to the smaller id; a row isn't its own neighbour. Null ids, vectors that are null, zero, or hold null or
    non-finite components, and those of another length than the most common one take no part. Equal rows count once, and
    rows of one id with different vectors each count. Equal vectors are one class: it can contribute its k + 1 least ids
    alone, so a large group of copies is neither in one task nor searched more than once. No rows: no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asks.alias("asks")).where("id is not null and v is not null").where(good)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    shape = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], shape)
    rows = rows.where(F.size("v") == length["d"]).withColumn("class", F.xxhash64("v")).withColumn("check", F.xxhash64(F.lit(5), "v"))
    one = rows.select("id", "class", "check", "v", "asks").groupBy("id", "class", "check").agg(F.first("v").alias("v"), F.max("asks").alias("asks"))
    one = scratch.save(one, "rows")
    order = Window.partitionBy("class", "check").orderBy("id")
    kept = one.select("id", "class", "check").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    ids = kept.groupBy("class", "check").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = one.groupBy("class", "check").agg(F.first("v").alias("v"), F.count("*").alias("many")).join(ids, ["class", "check"]).select("class", "v", "ids")
    classes = scratch.save(classes, "classes")
    n = classes.count()
    drawn = classes.select("class", "v").orderBy(F.xxhash64(F.lit(9), "class"), "v").limit(sample).toArrow()
    longest = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).head()[0] ** 0.5
    x = lifted(np.array(drawn.column("v").to_pylist(), float), longest)
    rng = np.random.default_rng(17)
    # leaves grow in number and in size with the input, so that neither a walk nor a leaf gets long
    size = max(8, math.ceil(len(x) / (3 * n ** (1 / 3))))
    forest = [Tree(x, size, rng) for _ in range(trees)]
    wanted = budget(forest, x, max(1, math.ceil(k * len(x) / n)), recall)
    # by the number of rows alone: each query hands on its k best from every bin, however many partitions there are
    bins = max(BINS, math.ceil(n * trees / TASK_ROWS))
    model = spark.sparkContext.broadcast(pickle.dumps(forest))  # at most sample / 4 splits a tree

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = pickle.loads(model.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(0))
            x = lifted(v, longest)
            for t, tree in enumerate(grown):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(tree.leaves(x).astype(np.int32)), *batch.columns], ["tree", "leaf", *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = pickle.loads(model.value)
        for batch in batches:
            for i, q in enumerate(_matrix(batch.column(0)) if batch.num_rows else []):
                found = reached(grown, direction(q), wanted)
                take = pa.array([i] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array([leaf for _, leaf in found], pa.int32()), *(c.take(take) for c in batch.columns)], ["tree", "leaf", *batch.schema.names])

    columns = "tree int, leaf int, v array<double>, ids array<bigint>, query_id long"
    seats = classes.select("v", "ids", F.lit(None).cast("long").alias("query_id")).mapInArrow(seat, columns)
    crowded = seats.groupBy("tree", "leaf").count().where(F.col("count") > TASK_ROWS).withColumn("parts", F.ceil(F.col("count") / TASK_ROWS).cast("int")).drop("count")
    crowded = F.broadcast(crowded)  # a row for each large leaf: at most trees * sample / 8
    walks = one.where("asks").select("v", F.array("id").alias("ids"), F.col("id").alias("query_id")).mapInArrow(walk, columns)
    seats = seats.join(crowded, ["tree", "leaf"], "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    walks = walks.join(crowded, ["tree", "leaf"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def rank(table: pa.Table) -> pa.Table:
        """The k best of each query among all leaves of a bin."""
        place = np.stack([table.column(c).to_numpy() for c in ("tree", "leaf", "part")], 1)
        _, where = np.unique(place, axis=0, return_inverse=True)
        asked = table.column("query_id").is_valid().to_numpy(zero_copy_only=False)
        queries = table.column("query_id").fill_null(0).to_numpy()
        v, ids = _matrix(table.column("v").combine_chunks()), table.column("ids").combine_chunks()
        flat, first = ids.flatten().to_numpy(), np.r_[0, np.cumsum(pa.compute.list_value_length(ids).to_numpy())]
        order = np.argsort(where, kind="stable")
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for rows in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            base, mine = rows[~asked[rows]], rows[asked[rows]]
            many = first[base + 1] - first[base]
            members = np.concatenate([flat[first[i] : first[i + 1]] for i in base.tolist()]) if len(base) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(base)), many)
            for i in range(0, len(mine) if len(base) else 0, 256):
                some = mine[i : i + 256]
                for i, s in zip(some.tolist(), v[some] @ v[base].T):
                    q = int(queries[i])
                    near_k = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -np.inf
                    best = np.flatnonzero(s >= near_k - 1e-9 * abs(near_k))
                    s[best] = (v[base[best]] * v[i]).sum(1)  # the same to the last bit in whichever leaf the pair meets
                    pick = np.flatnonzero(np.isin(of, best)) if len(members) > len(base) else best
                    near, worth = members[pick], s[of[pick]]
                    near, worth = near[near != q], worth[near != q]
                    top = np.lexsort((near, -worth))[:k]
                    for column, found in zip(out, (np.full(len(top), q), near[top], worth[top])):
                        column.append(found)
        q, near, worth = map(np.concatenate, out)
        order = np.lexsort((near, -worth, q))
        q, near, worth = q[order], near[order], worth[order]
        once = np.r_[True, (q[1:] != q[:-1]) | (near[1:] != near[:-1])][: len(q)]
        q, near, worth = q[once], near[once], worth[once]
        head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
        number = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)]))
        return pa.table({"query_id": q[number < k], "vec_id": near[number < k], "score": worth[number < k]})

    bin_of = F.pmod(F.xxhash64("tree", "leaf", "part"), F.lit(bins)).cast("int").alias("bin")
    # a bin meets its queries slice by slice: no task holds more than TASK_ASKS of them, however many reach a leaf
    slices = max(1, math.ceil(one.where("asks").count() / TASK_ASKS))
    seats = seats.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    walks = walks.withColumn("slice", F.pmod(F.xxhash64(F.lit(3), "query_id", "v"), F.lit(slices)).cast("int"))
    found = seats.unionByName(walks).select("*", bin_of).groupBy("bin", "slice").applyInArrow(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
