"""Quality by learning from positive and unlabelled documents.

Trusted good documents and unlabelled ones are told apart with the non-negative unbiased risk: the risk on the unseen
bad ones is what is left of the unlabelled risk without the good ones' share, and may not fall below zero. That share,
the class prior, is estimated: it is the least ratio of unlabelled to good documents in any upper part of the scores of
a first classifier that tells good from unlabelled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ledgerlight.llm import text as T

#: Documents that a model is fitted on, of either kind.
FIT_ROWS = 5_000

_CLASSES = ["0123456789", "|", "!", "?.,;:", "%&*#$@^~=+", "<>{}[]()\\/_`\"'-", "\n"]
_IN = np.zeros((len(_CLASSES) + 2, 256), bool)
for _i, _c in enumerate(_CLASSES):
    _IN[_i, [ord(x) for x in _c]] = True
_IN[-2, 65:91] = True
_IN[-1] = T.SPACE
FEATURES = len(_IN) + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: shares of kinds of bytes, lengths, and how much words, pairs of words and lines repeat."""
    out = []
    for i, j in T.blocks(offsets):
        words = T.Words(data, offsets[i : j + 1], lower=True)
        sizes = np.diff(words.ends)
        x = np.zeros((j - i, FEATURES))
        for c in range(len(_IN)):
            total = np.r_[0, np.cumsum(_IN[c][words.data])]
            x[:, c] = (total[words.ends[1:]] - total[words.ends[:-1]]) / np.maximum(sizes, 1)
        counts = words.counts()
        lengths = words.stop - words.start
        total = np.r_[0, np.cumsum(lengths)]
        square = np.r_[0, np.cumsum(lengths.astype(float) ** 2)]
        a, b = words.first[:-1], words.first[1:]
        n = np.maximum(counts, 1)
        mean = (total[b] - total[a]) / n
        k = len(_IN)
        x[:, k], x[:, k + 1], x[:, k + 2] = np.log1p(counts), mean, np.sqrt(np.maximum((square[b] - square[a]) / n - mean**2, 0))
        pairs = T.runs(words.hash, 2)
        lines = T.Words(data, offsets[i : j + 1], apart=_IN[len(_CLASSES) - 1])
        for r, (p, q, s, t) in enumerate(zip(a.tolist(), b.tolist(), lines.first[:-1].tolist(), lines.first[1:].tolist())):
            if q > p:
                _, seen = np.unique(words.hash[p:q], return_counts=True)
                x[r, k + 3], x[r, k + 4] = len(seen) / (q - p), seen.max() / (q - p)
                x[r, k + 5] = np.mean(words.hash[p + 1 : q] == words.hash[p : q - 1]) if q - p > 1 else 0
                x[r, k + 6] = len(np.unique(pairs[p : q - 1])) / (q - p - 1) if q - p > 1 else 1
                x[r, k + 7] = len(np.unique(lines.hash[s:t])) / max(1, t - s)
                x[r, k + 8] = np.log1p((q - p) / max(1, t - s))
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


class Model:
    """A network with one hidden layer over standardised features."""

    def __init__(self, low, high, mean, scale, parts, prior):
        self.low, self.high, self.mean, self.scale, self.parts, self.prior = low, high, mean, scale, parts, prior

    def ready(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(x, self.low, self.high) - self.mean) / self.scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_net(self.parts, self.ready(x))[0], -30, 30)))


def _net(parts, z):
    w1, b1, w2, b2 = parts
    h = np.tanh(z @ w1 + b1)
    return h @ w2 + b2, h


def _train(zp: np.ndarray, zu: np.ndarray, prior: float | None, steps: int, seed: int):
    """Without a prior: plain logistic loss of good against unlabelled. With one: the non-negative risk."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 1 / np.sqrt(zp.shape[1]), (zp.shape[1], 16)), np.zeros(16), rng.normal(0, 0.25, 16), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for t in range(1, steps + 1):
        p, u = zp[rng.integers(0, len(zp), 1024)], zu[rng.integers(0, len(zu), 1024)]
        (gp, hp), (gu, hu) = _net(parts, p), _net(parts, u)
        if prior is None:
            dp, du = (sig(gp) - 1) / 2, sig(gu) / 2
        else:
            bad = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if bad >= 0:
                dp, du = prior * (sig(gp) - 1) - prior * sig(gp), sig(gu)
            else:  # step back until the risk on bad documents is not negative any more
                dp, du = prior * sig(gp), -sig(gu)
        grads = [np.zeros_like(x) for x in parts]
        for z, h, d in ((p, hp, dp / len(p)), (u, hu, du / len(u))):
            back = np.outer(d, parts[2]) * (1 - h * h)
            for k, g in enumerate((z.T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True))):
                grads[k] += g
        for k in range(4):
            g = grads[k] + 1e-4 * parts[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            parts[k] = parts[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return parts


def estimate_prior(good: np.ndarray, unlabelled: np.ndarray) -> float:
    """From scores: the least share of unlabelled documents above a threshold, for each good one above it. Thresholds keep 30 % of the good ones at least."""
    cuts = np.quantile(good, np.linspace(0, 0.7, 141))
    ratio = [np.mean(unlabelled >= c) / np.mean(good >= c) for c in cuts]
    return float(np.clip(min(ratio), 0.02, 0.98))


def fit(good: np.ndarray, unlabelled: np.ndarray, steps: int = 1500) -> Model:
    """good, unlabelled: rows of features. The prior's classifier is judged on the half that it wasn't trained on."""
    every = np.concatenate([good, unlabelled])
    if not len(good) or not len(unlabelled):
        share = 0.5 if not len(good) else 1.0
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES), np.ones(FEATURES), [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.array([0.0 if share == 0.5 else 2.0])], share)
    low, high = np.quantile(every, 0.002, axis=0), np.quantile(every, 0.998, axis=0)
    clipped = np.clip(every, low, high)
    model = Model(low, high, clipped.mean(0), np.maximum(clipped.std(0), 1e-6), None, None)
    zp, zu = model.ready(good), model.ready(unlabelled)
    mixed = np.random.default_rng(3)
    zp, zu = zp[mixed.permutation(len(zp))], zu[mixed.permutation(len(zu))]
    half = lambda z, k: z[k::2] if len(z) > 1 else z
    first = _train(half(zp, 0), half(zu, 0), None, steps // 3, 1)
    model.prior = estimate_prior(_net(first, half(zp, 1))[0], _net(first, half(zu, 1))[0])
    model.parts = _train(zp, zu, model.prior, steps, 2)
    return model


def fit_quality(docs: DataFrame, positives: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A pickled Model from at most rows trusted positives and rows unlabelled documents, those with the smallest hashes of their ids.

    positives: ids of trusted good documents. Ids that are null or not in docs are left out; of an id's several texts any
    one is taken. The features of both (numbers only, bounded by rows) are collected and fitted in the driver.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    first = lambda df, salt: df.distinct().orderBy(F.xxhash64(F.lit(salt), "id"), "id").limit(rows)
    good = first(positives.select(F.col(id_col).cast("long").alias("id")).where("id is not null"), 1).withColumn("good", F.lit(1))
    plain = first(ids, 2).withColumn("good", F.lit(0))
    sample = F.broadcast(good.unionByName(plain))  # at most 2 * rows pairs of numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "id").groupBy("id", "good").agg(F.min("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*T.column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "good", "x"])

    got = texts.select("id", "good", "text").mapInArrow(T.tidy(measure), "id long, good int, x array<double>").toArrow()
    order = np.lexsort((got.column("id").to_numpy(), got.column("good").to_numpy()))
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, FEATURES)[order]
    y = got.column("good").to_numpy()[order]
    model = fit(x[y == 1], x[y == 0])
    return pickle.dumps((model.low, model.high, model.mean, model.scale, model.parts, model.prior))


def score_quality(docs: DataFrame, model: bytes, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """For each row of docs: all its columns, then score and predicted (score >= threshold); columns of those names are replaced.

    prefix: put before the names of the new columns.

    A null text counts as empty. Repeated rows and null ids are kept. Whole texts are read, in one pass without a shuffle.
    """
    added = [f"{prefix}score", f"{prefix}predicted"]
    rest = docs.drop(*added)
    schema = StructType([*rest.schema.fields, StructField(added[0], DoubleType()), StructField(added[1], IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*pickle.loads(model))
        for batch in batches:
            p = judge.scores(features(*T.column(batch, text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, *added])

    return rest.mapInArrow(T.tidy(score), schema)
