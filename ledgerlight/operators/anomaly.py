"""Streaming half-space trees over the nine features, and the search for their shape.

A forest's reference counts change only when a window of events is full. All events of a window are therefore scored and
learned at once, with arrays over events and trees; results are those of one event after another. Events of a model are
streamed in time order through one task in batches, so memory holds a window and the forest, not the history.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.functions.crypto import below_line, fnv1a
from ledgerlight.operators.evaluate import running_totals
from ledgerlight.operators.velocity import FEATURES

NAMES = [f[0] for f in FEATURES]
NEUTRAL = np.array([f[2] for f in FEATURES])
BUCKETS = 256


@dataclass(frozen=True)
class Shape:
    """The defaults of the model."""

    trees: int = 25
    depth: int = 8
    window: int = 256
    blend: float = 0.25
    review: float = 0.01
    sample: float = 0.001
    warm: int = 0
    seed: int = 1

    def __post_init__(self):
        if not (1 <= self.depth <= 24 and self.nodes() <= 262_144 and self.trees > 0 and self.window > 0 and 0 < self.blend <= 1 and 0 < self.review <= 0.5):
            raise ValueError("no such shape")

    def nodes(self) -> int:
        return self.trees * ((2 << self.depth) - 1)

    def warm_after(self) -> int:
        return self.warm if self.warm >= 2 * self.window else 8 * self.window

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:32]


class Forest:
    def __init__(self, shape: Shape, org: str):
        self.shape, n = shape, (2 << shape.depth) - 1
        rng = np.random.default_rng([shape.seed, fnv1a(org.encode())])
        inner, dims = (1 << shape.depth) - 1, len(NAMES)
        self.dim, self.split = np.zeros((shape.trees, n), np.int64), np.zeros((shape.trees, n))
        for t in range(shape.trees):
            s = rng.random(dims)
            w = 2 * np.maximum(s, 1 - s)
            low, high = np.zeros((n, dims)), np.zeros((n, dims))
            low[0], high[0] = s - w, s + w
            self.dim[t, :inner] = rng.integers(0, dims, inner)
            for i in range(inner):
                q = self.dim[t, i]
                self.split[t, i] = middle = (low[i, q] + high[i, q]) / 2
                for child in (2 * i + 1, 2 * i + 2):
                    low[child], high[child] = low[i], high[i]
                high[2 * i + 1, q] = low[2 * i + 2, q] = middle
        self.ref, self.cur = np.zeros((shape.trees, n)), np.zeros((shape.trees, n))
        self.hist, self.learned, self.seen, self.cut = np.zeros(BUCKETS), 0, 0, 1.0

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Nodes of each event (rows) in each tree, from the root down."""
        trees = np.arange(self.shape.trees)
        out = np.zeros((self.shape.depth + 1, len(x), self.shape.trees), np.int64)
        for d in range(self.shape.depth):
            i = out[d]
            value = np.take_along_axis(x, self.dim[trees, i], 1)
            out[d + 1] = 2 * i + 1 + (value >= self.split[trees, i])
        return out

    def scores(self, x: np.ndarray, paths: np.ndarray | None = None) -> np.ndarray:
        scale = self.ref[:, 0]
        voters = scale > 0
        if not voters.any():
            return np.ones(len(x))
        paths = self.paths(x) if paths is None else paths
        trees = np.arange(self.shape.trees)
        mass, open_ = np.zeros((len(x), len(trees))), np.ones((len(x), len(trees)), bool)
        for d in range(self.shape.depth + 1):
            r = self.ref[trees, paths[d]]
            ends = open_ & ((r <= 0.1 * scale) | (d == self.shape.depth))
            mass[ends] = (r * float(1 << d))[ends]
            open_ &= ~ends
        vote = np.where(mass < scale, 1 - mass / np.where(voters, scale, 1), 0)
        return vote[:, voters].sum(1) / voters.sum()

    def _learn(self, paths: np.ndarray, scores: np.ndarray) -> None:
        trees = np.broadcast_to(np.arange(self.shape.trees), paths.shape[1:])
        for level in paths:
            np.add.at(self.cur, (trees, level), 1)
        counted = self.learned + 1 + np.arange(len(scores)) > self.shape.window
        np.add.at(self.hist, np.clip((scores[counted] * BUCKETS).astype(int), 0, BUCKETS - 1), 1)
        self.learned += len(scores)
        self.seen += len(scores)
        if self.seen >= self.shape.window:
            self.ref += self.shape.blend * (self.cur - self.ref)
            self.cur[:] = 0
            self.seen = 0
            self.hist *= 1 - self.shape.blend
            self.cut = self._cut()

    def _cut(self) -> float:
        total = self.hist.sum()
        if total <= 0:
            return 1.0
        above = np.cumsum(self.hist[::-1])
        over = np.flatnonzero(above > self.shape.review * total)
        return float((BUCKETS - over[0]) / BUCKETS) if len(over) else 0.0

    def feed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores events in order and learns them: score, cut, and whether the model was warm. Unusable points (outside 0 to 1) score null and aren't learned."""
        score, cut, warm = np.full(len(x), np.nan), np.ones(len(x)), np.zeros(len(x), bool)
        good = np.flatnonzero(np.isfinite(x).all(1) & (x >= 0).all(1) & (x <= 1).all(1))
        at = 0
        while at < len(good):
            some = good[at : at + self.shape.window - self.seen]
            paths = self.paths(x[some])
            score[some], cut[some] = self.scores(x[some], paths), self.cut
            warm[some] = self.learned + np.arange(len(some)) >= self.shape.warm_after()
            self._learn(paths, score[some])
            at += len(some)
        return score, cut, warm

    def causes(self, x: np.ndarray, score: float) -> list[tuple[str, float, float]]:
        """Feature, share and the score without it, of every feature that isn't neutral: largest share first; without any, the farthest from neutral first."""
        away = np.flatnonzero(x != NEUTRAL)
        if not len(away):
            return []
        other = np.repeat(x[None], len(away), 0)
        other[np.arange(len(away)), away] = NEUTRAL[away]
        without = self.scores(other)
        drop = np.maximum(0, score - without)
        total = drop.sum()
        key = -drop if total > 0 else -np.abs(x - NEUTRAL)[away]
        return [(NAMES[away[i]], float(drop[i] / total) if total > 0 else 0.0, float(without[i])) for i in np.argsort(key, kind="stable")]

    def snapshot(self) -> dict:
        return {"shape": self.shape.digest(), "ref": self.ref.ravel().tolist(), "cur": self.cur.ravel().tolist(), "hist": self.hist.tolist(), "learned": self.learned, "seen": self.seen, "cut": self.cut}

    def restore(self, snap: dict) -> "Forest":
        """Refused under another shape, or if a node's count isn't that of its children."""
        if snap["shape"] != self.shape.digest():
            raise ValueError("a snapshot of another shape")
        ref, cur = (np.array(snap[k], float).reshape(self.ref.shape) for k in ("ref", "cur"))
        inner = np.arange((1 << self.shape.depth) - 1)
        for a in (ref, cur):
            if not np.isfinite(a).all() or (a < 0).any() or not np.allclose(a[:, inner], a[:, 2 * inner + 1] + a[:, 2 * inner + 2], rtol=1e-6, atol=1e-6):
                raise ValueError("a snapshot whose counts don't add up")
        self.ref, self.cur, self.hist = ref, cur, np.array(snap["hist"], float)
        self.learned, self.seen, self.cut = int(snap["learned"]), int(snap["seen"]), float(snap["cut"])
        return self


SCORED = "org_id string, tx_id string, us long, score double, cut double, warm boolean, alert boolean, causes array<struct<feature:string,share:double,without:double>>"


def score(points: DataFrame, shape: Shape = Shape(), shards: int = 1, top: int | None = None) -> DataFrame:
    """Each event with its score, the cut in force, whether the model was warm, and the causes of an alert.

    points: what velocity.features() gives. A model belongs to an organisation and takes its events in time order (ties by
    tx_id), which one task does; shards splits a large organisation into so many models by account.
    """
    shard = F.pmod(F.xxhash64("account"), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    columns = ["x_" + n for n in NAMES]
    rows = points.select("org_id", shard.alias("shard"), "us", "tx_id", *columns)
    rows = rows.repartition("org_id", "shard").sortWithinPartitions("org_id", "shard", "us", "tx_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, forest = None, None
        for pdf in frames:
            for key, part in pdf.groupby(["org_id", "shard"], sort=False, dropna=False):
                if key != now:
                    now, forest = key, Forest(shape, f"{key[0]}#{key[1]}")
                yield _judge(forest, part, columns, top)

    return rows.mapInPandas(run, SCORED)


def _judge(forest: Forest, part: pd.DataFrame, columns: list[str], top: int | None) -> pd.DataFrame:
    x = part[columns].to_numpy(float)
    score, cut, warm, causes = np.full(len(x), np.nan), np.ones(len(x)), np.zeros(len(x), bool), [[] for _ in range(len(x))]
    at = 0
    while at < len(x):  # causes need the counts of their own window
        n = forest.shape.window - forest.seen
        before = forest.ref.copy()
        score[at : at + n], cut[at : at + n], warm[at : at + n] = forest.feed(x[at : at + n])
        hit = at + np.flatnonzero(warm[at : at + n] & (score[at : at + n] > cut[at : at + n]))
        if len(hit):
            after, forest.ref = forest.ref, before
            for i in hit.tolist():
                causes[i] = [{"feature": f, "share": s, "without": w} for f, s, w in forest.causes(x[i], score[i])[:top]]
            forest.ref = after
        at += n
    return pd.DataFrame({"org_id": part["org_id"].to_numpy(), "tx_id": part["tx_id"].to_numpy(), "us": part["us"].to_numpy(), "score": score, "cut": cut, "warm": warm, "alert": warm & (score > cut), "causes": causes})


def grid(trees=(25,), depth=(8,), window=(256,), blend=(0.25,), review=(0.01,), seed: int = 1, most: int = 256) -> list[Shape]:
    shapes = [Shape(t, d, w, b, r, seed=seed) for t, d, w, b, r in itertools.product(trees, depth, window, blend, review)]
    if not shapes or len(shapes) > most:
        raise ValueError(f"a search has 1 to {most} shapes")
    return shapes


#: Fixed value: events that a search looks at.
SEARCH_EVENTS = 50_000


def search(spark: SparkSession, points: DataFrame, judged: DataFrame, shapes: list[Shape], events: int = SEARCH_EVENTS) -> DataFrame:
    """How each shape would have done on the newest events: AUC on judged ones, alert share, drift between halves, and why it is refused.

    points: velocity.features(); judged: tx_id and productive. The events are a bounded number of rows, sent to every
    task once; shapes run side by side, one to a task.
    """
    held = points.join(judged.select("tx_id", "productive"), "tx_id", "left").orderBy(F.desc("us"), F.desc("tx_id")).limit(events)
    pdf = held.select("tx_id", "us", "productive", *["x_" + n for n in NAMES]).toPandas().sort_values(["us", "tx_id"])
    data = spark.sparkContext.broadcast((pdf[["x_" + n for n in NAMES]].to_numpy(float), pdf["productive"].map({True: 1, False: 0}).fillna(-1).to_numpy(int)))
    rows = spark.createDataFrame([(i, json.dumps(asdict(s))) for i, s in enumerate(shapes)], "trial int, shape string").repartition(max(1, len(shapes)), "trial")

    def trial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = data.value
        for part in frames:
            out = []
            for i, text in zip(part["trial"], part["shape"]):
                shape = Shape(**json.loads(text))
                s, cut, warm = Forest(shape, "search").feed(x)
                ok = warm & np.isfinite(s)
                alert = ok & (s > cut)
                told = ok & (y >= 0)
                pos, neg = s[told & (y == 1)], s[told & (y == 0)]
                auc = None
                if len(pos) and len(neg):
                    r = pd.Series(np.r_[pos, neg]).rank().to_numpy()
                    auc = float((r[: len(pos)].sum() - len(pos) * (len(pos) + 1) / 2) / (len(pos) * len(neg)))
                half = np.flatnonzero(ok)
                drift = float(abs(s[half[: len(half) // 2]].mean() - s[half[len(half) // 2 :]].mean())) if len(half) > 1 else None
                share = float(alert.sum() / ok.sum()) if ok.any() else None
                refused = "warming" if not ok.any() else "unjudged" if auc is None else "saturated" if share > 0.5 else None
                out.append((i, text, auc, share, drift, shape.nodes(), int(alert.sum()), refused))
            yield pd.DataFrame(out, columns=["trial", "shape", "separation", "alert_share", "drift", "nodes", "alerts", "refused"])

    return rows.mapInPandas(trial, "trial int, shape string, separation double, alert_share double, drift double, nodes int, alerts int, refused string")


def ranked(trials: DataFrame) -> DataFrame:
    """Trials that aren't refused: the best separation first, then the least drift, then the fewest nodes."""
    return trials.where("refused is null").orderBy(F.desc("separation"), "drift", "nodes", "trial")


def placed(trials: DataFrame) -> DataFrame:
    """ranked() trials with their place, from 1.

    Trials of one separation, drift and nodes are placed among themselves, behind all that such groups before them hold. Only
    groups are added up across the table, each separation's in a window of its own and the separations by ranges.
    """
    some = trials.where("refused is null")
    groups = some.groupBy("separation", "drift", "nodes").agg(F.count("*").alias("_n"))
    totals = groups.groupBy("separation").agg(F.sum("_n").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = running_totals(totals, "separation", ["_n"]).select("separation", (F.col("to__n") - F.col("_n")).alias("_above"))
    ahead = groups.select("separation", "drift", "nodes", before(Window.partitionBy("separation").orderBy("drift", "nodes")).alias("_ahead"))
    same = lambda *cs: [F.col("a." + c).eqNullSafe(F.col("b." + c)) for c in cs]
    offset = ahead.alias("a").join(above.alias("b"), same("separation")).select("a.*", (F.col("_above") + F.col("_ahead")).alias("_offset")).drop("_ahead")
    keys = ("separation", "drift", "nodes")
    out = some.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("trial"))).alias("a").join(offset.alias("b"), same(*keys))
    return out.select("a.*", (F.col("_i") + F.col("_offset")).alias("place")).drop("_i")


def reason(feature: str, observed: float, baseline: float, neutral: float) -> str:
    """The code of a cause: below only where the feature has a middle and the value is under its baseline."""
    return f"{feature}.{'below' if neutral > 0 and observed < baseline else 'above'}"


def reasons(scored: DataFrame, top: int = 3) -> DataFrame:
    """The leading causes of each alert, as ranked codes."""
    low = F.col("c.feature").isin([n for n, _, neutral in FEATURES if neutral > 0])
    each = scored.where("alert").select("org_id", "tx_id", F.posexplode(F.slice("causes", 1, top)).alias("rank", "c"))
    return each.select("org_id", "tx_id", (F.col("rank") + 1).alias("rank"), F.concat("c.feature", F.when(low & (F.col("c.share") == 0), ".below").otherwise(".above")).alias("code"), "c.share")


#: Fixed value: unremarkable transactions that are kept for review, for each organisation.
BELOW_LINE = 256


def below_line_kept(scored: DataFrame, rate: float, most: int = BELOW_LINE) -> DataFrame:
    """The newest unremarkable events of the sample that their ids decide: what a review looks at besides alerts.

    A window over an organisation's sample would take it all in one task; so each day keeps its newest first, and the newest
    of those are what is left.
    """
    some = scored.where("not coalesce(alert, false)").where(below_line(F.col("tx_id"), F.lit(rate)))
    newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("us"), F.desc("tx_id")))
    day = some.withColumn("_day", F.floor(F.col("us") / 86_400_000_000)).withColumn("_n", newest("org_id", "_day")).where(F.col("_n") <= most)
    return day.withColumn("_n", newest("org_id")).where(F.col("_n") <= most).drop("_n", "_day")


def fit(points: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """org_id, digest and state (a snapshot as JSON) of a forest that has learned each organisation's events in time order."""

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Forest] = {}
        for pdf in frames:
            for org, part in pdf.groupby("org_id", sort=False):
                held.setdefault(org, Forest(shape, org)).feed(part[["x_" + n for n in NAMES]].to_numpy(float))
        yield pd.DataFrame([(org, shape.digest(), json.dumps(forest.snapshot())) for org, forest in held.items()], columns=["org_id", "digest", "state"])

    rows = points.select("org_id", "us", "tx_id", *("x_" + n for n in NAMES)).repartition("org_id").sortWithinPartitions("org_id", "us", "tx_id")
    return rows.mapInPandas(learn, "org_id string, digest string, state string")
