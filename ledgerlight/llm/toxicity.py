"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Labels exist for documents only. A sentence's probability is logistic in the words it has; a document's is the noisy-or
of its sentences', 1 - prod(1 - p). Both are trained together on document labels, and the sentences whose own
probability reaches the threshold are those to blame.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import text as T

#: Labelled documents that a model is fitted on, at most so many of either label, and words that it may use.
FIT_ROWS, FIT_WORDS = 3_000, 5_000
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


def _sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """Words, the sentence of each, and the first sentence of each text (one more than texts). A text has one sentence at least."""
    words = T.Words(data, offsets, lower=True, apart=T.PUNCTUATION)
    ends = np.zeros(len(words.data) + 1, np.int64)
    ends[1:] = ENDS[words.data]
    passed = np.cumsum(ends)  # sentence ends before each byte
    number = np.arange(len(words.ends))
    first = passed[words.ends] + number  # each text begins one
    return words, passed[words.start] + np.repeat(number[:-1], words.counts()), first


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(words)
        self.words, self.weights, self.bias = words[order], weights[order], bias
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.words >> T.U(44)).astype(np.int64)] = True

    def sentence_scores(self, words: T.Words, sentence: np.ndarray, n: int) -> np.ndarray:
        """Each sentence's probability; a word counts once in it."""
        near = np.flatnonzero(self.may[(words.hash >> T.U(44)).astype(np.int64)])
        logit = np.full(n, self.bias)
        if len(near) and len(self.words):
            found = np.searchsorted(self.words, words.hash[near])
            found[found == len(self.words)] = 0
            hit = self.words[found] == words.hash[near]
            pairs = np.unique(sentence[near[hit]] * len(self.words) + found[hit])
            np.add.at(logit, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _noisy_or(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    return -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first[:-1]))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, steps: int = 250) -> Model:
    """texts: columns (bytes and offsets) of all labelled texts, in the order of labels. prior: share of label 1 among all labelled rows."""
    hashes, sents, docs, sent_doc, base, doc_base = [], [], [], [], 0, 0
    for data, offsets in texts:
        for i, j in T.blocks(offsets):
            words, sentence, first = _sentences(data, offsets[i : j + 1])
            hashes.append(words.hash)
            sents.append(sentence + base)
            docs.append(np.repeat(np.arange(j - i), words.counts()) + doc_base)
            sent_doc.append(np.repeat(np.arange(j - i), np.diff(first)) + doc_base)
            base, doc_base = base + int(first[-1]), doc_base + j - i
    y = labels.astype(bool)
    n1, n0 = int(y.sum()), int((~y).sum())
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not n1 or not n0:
        return Model(np.zeros(0, T.U), np.zeros(0), bias if len(y) else -20.0)
    word, hashes = np.unique(np.concatenate(hashes), return_inverse=True)
    docs, sents, sent_doc = np.concatenate(docs), np.concatenate(sents), np.concatenate(sent_doc)
    pair = np.unique(docs * len(word) + hashes)
    of = pair % len(word)
    with1 = np.bincount(of[y[pair // len(word)]], minlength=len(word))
    with_any = np.bincount(of, minlength=len(word))
    p = with_any / len(y)
    z = (with1 / n1 - (with_any - with1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[with_any < 5] = 0
    chosen = np.argsort(-np.abs(z))[:FIT_WORDS]
    chosen = chosen[np.abs(z[chosen]) > 4]
    at = np.full(len(word), -1)
    at[chosen] = np.arange(len(chosen))
    used = at[hashes] >= 0
    pair = np.unique(sents[used] * max(1, len(chosen)) + at[hashes[used]])
    s, f = pair // max(1, len(chosen)), pair % max(1, len(chosen))
    first = np.r_[np.flatnonzero(np.r_[True, np.diff(sent_doc) > 0]), len(sent_doc)]
    theta, b = np.zeros(len(chosen)), -4.0
    weight = np.where(y, prior / n1, (1 - prior) / n0)
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        logit = np.full(len(sent_doc), b)
        logit += np.bincount(s, theta[f], len(sent_doc))
        ps = np.minimum(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 1 - 1e-9)
        doc = np.clip(_noisy_or(ps, first), 1e-12, 1)
        pull = np.where(y, (1 - doc) / doc, -1.0) * weight  # of log-likelihood, for each p that a sentence adds
        slope = pull[sent_doc] * ps
        g = np.r_[np.bincount(f, slope[s], len(chosen)) - 1e-6 * theta, slope.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        theta, b = theta + move[:-1], b + move[-1]
    return Model(word[chosen], theta, float(b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A pickled Model, fitted on at most rows documents of either label, those whose id has the smallest hashes.

    labels: id and label (0 or 1), of the rows to learn from alone. Null ids and labels are left out, of an id's several
    labels the largest counts, of its several texts any one. Without rows of both labels the model has no words.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * rows pairs of numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        y = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held]) if held else np.zeros(0)
        model = fit([T.column(b, "text") for b in held], y, prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.words, model.weights, model.bias))], pa.binary())], ["model"])

    # the fit takes one task: its input is bounded by rows
    got = texts.select("id", "text", "y").coalesce(1).sortWithinPartitions("id").mapInArrow(T.tidy(train), "model binary").head()
    if got is None:  # Spark runs no task over a table that it knows to be empty
        empty = fit([], np.zeros(0), prior)
        return pickle.dumps((empty.words, empty.weights, empty.bias))
    return got["model"]


def score_toxicity(docs: DataFrame, model: bytes, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, score, predicted (score >= threshold), and its offending sentences (first byte, end byte, score).

    A null text counts as empty, and an empty one has a single empty sentence. Repeated rows and null ids are kept. Whole
    texts are read, in one pass without a shuffle; columns other than id and text aren't read.
    """
    schema = "doc_id long, score double, predicted int, offending array<struct<start:long,stop:long,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*pickle.loads(model))
        for batch in batches:
            data, offsets = T.column(batch, "text")
            scores, blame = [], []
            for i, j in T.blocks(offsets):
                words, sentence, first = _sentences(data, offsets[i : j + 1])
                p = judge.sentence_scores(words, sentence, int(first[-1]))
                scores.append(_noisy_or(p, first))
                ends = np.flatnonzero(ENDS[words.data]) + 1
                bounds = np.sort(np.r_[words.ends[:-1], ends + 0], kind="stable")  # where sentences begin, in order
                stops = np.r_[bounds[1:], len(words.data)]
                found: list[list] = [[] for _ in range(j - i)]
                for s in np.flatnonzero(p >= threshold).tolist():
                    d = int(np.searchsorted(first, s, "right")) - 1
                    low = int(words.ends[d])
                    found[d].append({"start": int(bounds[s]) - low, "stop": int(stops[s]) - low, "score": float(p[s])})
                blame += found
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(blame, kind)], ["doc_id", "score", "predicted", "offending"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(T.tidy(score), schema)
