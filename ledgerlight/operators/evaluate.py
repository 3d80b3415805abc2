"""How well scores tell productive cases from others: metrics, curves, calibration, policies and replays."""

from __future__ import annotations

import bisect
import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.plans.library import ACTIONS


def judged(obs: DataFrame) -> DataFrame:
    """Observations (score, disposition, weight) that were decided, as score, y and w; weights that aren't positive numbers count as 1."""
    w = F.coalesce("weight", F.lit(1.0)) if "weight" in obs.columns else F.lit(1.0)
    return obs.where(F.col("disposition").isin("productive", "unproductive")).select("score", (F.col("disposition") == "productive").alias("y"), F.when((w > 0) & (w < float("inf")), w).otherwise(1.0).alias("w"))


def running_totals(rows: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """rows (each with another value of order) with to_<c> for each c of sums: its total over rows down to this one, highest order first.

    No window takes all rows: rows are sorted into ranges, each range's total is a row, and only those are added up in one
    task; there are as many as the session has shuffle partitions. Ranges are sampled anew in each run, and equal in one run.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("b")).head()["b"] if parts > 1 else []
    cuts = sorted(set(bounds or []))
    part = F.lit(0)
    for c in reversed(cuts):
        part = F.when(F.col(order) > c, F.lit(1)).otherwise(0) + part
    rows = rows.withColumn("_part", part)
    per = rows.groupBy("_part").agg(*(F.sum(c).alias(c) for c in sums))
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias("_" + c) for c in sums))
    down = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(before), "_part")
    return out.select(*(c for c in rows.columns if c != "_part"), *((F.sum(c).over(down) + F.col("_" + c)).alias("to_" + c) for c in sums))


def by_score(rows: DataFrame) -> DataFrame:
    """One row for each distinct score: weights and rows of both outcomes, and what scores at or above it hold.

    i is the score's place from the top, from 0. A score that isn't a number can't be ordered and is left out.
    """
    each = rows.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("score").agg(F.sum(F.when(F.col("y"), F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(~F.col("y"), F.col("w")).otherwise(0.0)).alias("n"), F.count_if("y").alias("cp"), F.count_if(~F.col("y")).alias("cn"), F.lit(1).alias("one"))
    total = each.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.sum("cp").alias("all_cp"), F.sum("cn").alias("all_cn"), F.count("*").alias("scores"))
    each = running_totals(each, "score", ["p", "n", "cn", "one"])
    named = each.withColumnsRenamed({"to_p": "tp", "to_n": "fp", "to_cn": "cn_above"}).withColumn("i", F.col("to_one") - 1).drop("one", "to_one")
    return named.crossJoin(F.broadcast(total))  # one row is joined


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("score") >= threshold
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0))
    return rows.agg(add(hit & F.col("y")).alias("tp"), add(hit & ~F.col("y")).alias("fp"), add(~hit & F.col("y")).alias("fn"), add(~hit & ~F.col("y")).alias("tn"))


def round6(c: Column) -> Column:
    return F.round(c, 6)


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties at one half; null without both outcomes."""
    below = F.col("n") / 2 + F.col("all_n") - F.col("fp")
    return by_score(rows).agg(round6(F.try_divide(F.sum(F.col("p") * below), F.max("all_p") * F.max("all_n"))).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Sum over groups of tied scores, from the top, of the recall gained times the precision reached."""
    step = F.col("p") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return by_score(rows).where("all_p > 0").agg(round6(F.sum(step)).alias("ap"))


def curve(rows: DataFrame, miss: float = 0.0, alarm: float = 0.0, points: int = 1000) -> DataFrame:
    """score, tpr, fpr, precision and cost at each distinct score, evenly thinned to points at most."""
    s = by_score(rows)
    s = s.withColumn("last", F.col("scores") - 1)
    kept = (F.col("last") < points) | (F.floor(F.floor(F.col("i") * (points - 1) / F.col("last")) * F.col("last") / (points - 1)) == F.col("i")) | (F.floor(F.ceil(F.col("i") * (points - 1) / F.col("last")) * F.col("last") / (points - 1)) == F.col("i"))
    cost = (F.col("all_p") - F.col("tp")) * miss + F.col("fp") * alarm
    return s.where(kept).select("score", round6(F.try_divide("tp", "all_p")).alias("tpr"), round6(F.try_divide("fp", "all_n")).alias("fpr"), round6(F.try_divide("tp", F.col("tp") + F.col("fp"))).alias("precision"), cost.alias("cost"))


def cheapest(rows: DataFrame, miss: float, alarm: float) -> DataFrame:
    """The threshold of least cost; null if flagging nothing is cheapest. Ties go to the higher threshold."""
    cost = (F.col("all_p") - F.col("tp")) * miss + F.col("fp") * alarm
    best = by_score(rows).select("score", cost.alias("cost"), (F.col("all_p") * miss).alias("nothing")).agg(F.min(F.struct("cost", (-F.col("score")).alias("s"))).alias("best"), F.max("nothing").alias("nothing"))
    return best.select(F.when(F.col("best.cost") < F.col("nothing"), -F.col("best.s")).alias("threshold"), F.least("best.cost", "nothing").alias("cost"))


def metrics(obs: DataFrame, threshold: float, probability: Column | None = None, miss: float | None = None, alarm: float | None = None) -> DataFrame:
    """One row: prevalence, AUC, average precision, precision, recall, F1, alarm rate and lift. Nothing measured is null, never 0.

    With a probability also the Brier score; with the costs of a miss and an alarm also what the threshold costs, and the
    threshold of least cost with its cost; with either, refused says why there is no verdict (null if there is one).
    """
    rows = judged(obs)
    c = confusion(rows, threshold)
    all_w = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    prevalence = F.try_divide(F.col("tp") + F.col("fn"), all_w)
    out = c.select("*", round6(prevalence).alias("prevalence"), round6(precision).alias("precision"), round6(recall).alias("recall"), round6(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"), round6(F.try_divide(F.col("tp") + F.col("fp"), all_w)).alias("alarm_rate"), round6(F.try_divide(precision, prevalence)).alias("lift"))
    out = out.crossJoin(roc_auc(rows)).crossJoin(average_precision(rows))  # single rows
    if probability is not None:
        out = out.crossJoin(brier(obs_rows(obs), probability))  # a single row
    if miss is not None and alarm is not None:
        best = cheapest(rows, miss, alarm).select(F.col("threshold").alias("best_threshold"), F.col("cost").alias("best_cost"))
        out = out.withColumn("cost", F.col("fn") * miss + F.col("fp") * alarm).crossJoin(best)  # a single row
    if probability is not None or miss is not None:
        positives, negatives = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
        why = F.when(positives + negatives == 0, "nothing was judged").when(positives == 0, "no productive case").when(negatives == 0, "no unproductive case")
        out = out.withColumn("refused", why)
    return out


def obs_rows(obs: DataFrame) -> DataFrame:
    """judged(), with the other columns of the observations kept for a probability to read."""
    rest = [c for c in obs.columns if c not in ("score", "y", "w")]
    w = F.coalesce("weight", F.lit(1.0)) if "weight" in obs.columns else F.lit(1.0)
    return obs.where(F.col("disposition").isin("productive", "unproductive")).select("score", *rest, (F.col("disposition") == "productive").alias("y"), F.when((w > 0) & (w < float("inf")), w).otherwise(1.0).alias("w"))


def brier(rows: DataFrame, probability: Column) -> DataFrame:
    return rows.agg(round6(F.sum(F.col("w") * F.pow(probability - F.col("y").cast("double"), 2)) / F.sum("w")).alias("brier"))


def reliability(rows: DataFrame, probability: Column, bins: int = 10) -> DataFrame:
    """For each of bins equal parts of the probabilities: rows, mean predicted and observed share (null if it is empty)."""
    b = F.least(F.floor(probability * bins), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("rows"), round6(F.avg(probability)).alias("predicted"), round6(F.avg(F.col("y").cast("double"))).alias("observed"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).alias("rows"), "predicted", "observed")


@dataclass(frozen=True)
class Calibration:
    """A map from scores to probabilities, read only under the model shape that it was fitted for."""

    method: str
    shape: str
    knots: tuple[tuple[float, float], ...] = ()
    a: float = 0.0
    b: float = 0.0

    def column(self, score: Column, shape: str) -> Column:
        if shape != self.shape:
            raise ValueError("fitted under another shape")
        if self.method == "platt":
            p = 1 / (1 + F.exp(self.a * score + self.b))
        else:
            x, y = [k[0] for k in self.knots], [k[1] for k in self.knots]
            p = F.when(score <= x[0], y[0])
            for i in range(1, len(x)):
                p = p.when(score <= x[i], y[i - 1] + (score - x[i - 1]) / (x[i] - x[i - 1]) * (y[i] - y[i - 1]))
            p = p.otherwise(y[-1])
        return F.when(F.isnan(p), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.method, self.shape, self.knots, self.a, self.b]).encode()).hexdigest()[:32]


#: Rows and rows of either outcome that a calibration needs; distinct scores that are fitted as they are.
FIT_ROWS, FIT_EACH, FIT_SCORES = 20, 5, 100_000


def calibrate(obs: DataFrame, method: str = "isotonic", shape: str = "") -> Calibration:
    """Fitted over scores grouped in Spark (rounded to 5 places, so at most FIT_SCORES + 1 groups leave it for scores from 0 to 1)."""
    rows = judged(obs).groupBy(F.round("score", int(math.log10(FIT_SCORES))).alias("s")).agg(F.sum("w").alias("w"), F.sum(F.when(F.col("y"), F.col("w")).otherwise(0.0)).alias("p"), F.count_if("y").alias("cp"), F.count("*").alias("c"))
    got = sorted((r["s"], r["w"], r["p"], r["cp"], r["c"]) for r in rows.limit(FIT_SCORES + 2).collect())
    pos, every = sum(r[3] for r in got), sum(r[4] for r in got)
    if len(got) > FIT_SCORES + 1:
        raise ValueError("scores must be from 0 to 1")
    if every < FIT_ROWS or pos < FIT_EACH or every - pos < FIT_EACH:
        raise ValueError("too few decided observations")
    if method == "isotonic":
        blocks: list[list[float]] = []  # weight, weighted score, weighted outcome
        for s, w, p, _, _ in got:
            blocks.append([w, w * s, p])
            while len(blocks) > 1 and blocks[-2][2] / blocks[-2][0] >= blocks[-1][2] / blocks[-1][0]:
                last = blocks.pop()
                blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
        return Calibration("isotonic", shape, tuple((round(s / w, 6), round(p / w, 6)) for w, s, p in blocks))
    total_p, total_n = sum(r[2] for r in got), sum(r[1] - r[2] for r in got)
    high, low = (total_p + 1) / (total_p + 2), 1 / (total_n + 2)
    a, b = 0.0, math.log((total_n + 1) / (total_p + 1))
    for _ in range(128):
        ga = gb = haa = hab = hbb = 0.0
        for s, w, p, _, _ in got:
            q = 1 / (1 + math.exp(max(-500.0, min(500.0, a * s + b))))
            t = (p * high + (w - p) * low) / w
            d, h = w * (t - q), w * q * (1 - q)
            ga, gb, haa, hab, hbb = ga + d * s, gb + d, haa + h * s * s, hab + h * s, hbb + h
        det = (haa + 1e-12) * (hbb + 1e-12) - hab * hab
        da, db = ((hbb + 1e-12) * ga - hab * gb) / det, ((haa + 1e-12) * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-10:
            break
    return Calibration("platt", shape, a=round(a, 9), b=round(b, 9))


@dataclass(frozen=True)
class Policy:
    """A floor action and rungs (probability from which an action holds), ascending in both."""

    rungs: tuple[tuple[float, str], ...]
    floor: str = "allow"
    shadow: bool = False

    def __post_init__(self):
        at = [p for p, _ in self.rungs]
        rank = [ACTIONS[self.floor], *(ACTIONS[a] for _, a in self.rungs)]
        if at != sorted(set(at)) or any(not 0 <= p <= 1 for p in at) or rank != sorted(set(rank)):
            raise ValueError("rungs ascend in probability and action")

    def action(self, probability: Column) -> Column:
        if self.shadow:
            return F.lit(self.floor)
        out = F.lit(self.floor)
        for p, action in self.rungs:
            out = F.when(probability >= p, action).otherwise(out)
        return out

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.rungs, self.floor, self.shadow]).encode()).hexdigest()[:32]


def replay_policy(recorded: DataFrame, calibration: Calibration, policy: Policy) -> DataFrame:
    """recorded (id, score, action, ...) with the action that the policy would take, and whether that tightens or loosens."""
    rank = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    would = policy.action(calibration.column(F.col("score"), calibration.shape))
    out = recorded.withColumn("would", would)
    was, will = F.element_at(rank, F.col("action")), F.element_at(rank, F.col("would"))
    return out.withColumns({"tightened": will > was, "loosened": will < was})


def score_at(calibration: Calibration, probability: float) -> float:
    """The least score from 0 to 1 whose probability reaches this one, to six places; above 1 if none does. Found by halving, so for any rising map."""

    def p(score: float) -> float:
        if calibration.method == "platt":
            return 1 / (1 + math.exp(max(-500.0, min(500.0, calibration.a * score + calibration.b))))
        x, y = zip(*calibration.knots)
        i = bisect.bisect_left(x, score)
        if i == 0 or i == len(x):
            return y[min(i, len(x) - 1)]
        return y[i - 1] + (score - x[i - 1]) / (x[i] - x[i - 1]) * (y[i] - y[i - 1])

    if p(1.0) < probability:
        return 1.0000001
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if p(middle) >= probability else (middle, high)
    return round(high, 6)


def policy_report(recorded: DataFrame, calibration: Calibration, policy: Policy) -> DataFrame:
    """One row: rows, changed, tightened and loosened by the policy, the share of judged ones that come from the sample below the line (explore), and the metrics at the score where the policy begins to act.

    recorded: id, score, action, disposition, and optionally weight and source (sample for those below the line).
    """
    told = replay_policy(recorded, calibration, policy)
    known = F.col("disposition").isin("productive", "unproductive")
    sampled = F.col("source") == "sample" if "source" in recorded.columns else F.lit(False)
    counts = told.agg(F.count("*").alias("rows"), F.count_if(F.col("would") != F.col("action")).alias("changed"), F.count_if("tightened").alias("tightened"), F.count_if("loosened").alias("loosened"), round6(F.try_divide(F.count_if(known & sampled), F.count_if(known))).alias("explore"))
    at = score_at(calibration, policy.rungs[0][0])
    measured = metrics(recorded, at, calibration.column(F.col("score"), calibration.shape))
    return counts.withColumn("at", F.lit(at)).crossJoin(measured)  # one row each


def tally(replayed: DataFrame) -> DataFrame:
    """Rows per action, as it was and as it would be."""
    each = replayed.select(F.explode(F.array(F.struct(F.col("action").alias("action"), F.lit(1).alias("was"), F.lit(0).alias("would")), F.struct(F.col("would").alias("action"), F.lit(0).alias("was"), F.lit(1).alias("would")))).alias("x"))
    return each.groupBy("x.action").agg(F.sum("x.was").alias("was"), F.sum("x.would").alias("would"))


def learning(history: DataFrame, order: str, steps: int = 5, method: str = "isotonic", holdout: float = 0.2) -> list[dict]:
    """Calibrations on growing first parts of the history, each judged by its Brier score on the same last part."""
    w = Window.orderBy(order)
    n = history.count()
    numbered = history.withColumn("_i", F.row_number().over(w))
    cut = int(n * (1 - holdout))
    tail, out = judged(numbered.where(F.col("_i") > cut)), []
    for k in range(1, steps + 1):
        some = numbered.where(F.col("_i") <= cut * k // steps)
        try:
            fitted = calibrate(some, method)
            out.append({"rows": cut * k // steps, "brier": brier(tail, fitted.column(F.col("score"), "")).head()["brier"]})
        except ValueError as e:
            out.append({"rows": cut * k // steps, "brier": None, "refused": str(e)})
    return out


def outcome(events: DataFrame, fired: str) -> DataFrame:
    """What a rule did to a history: alerts, judged, productive, unproductive, and their shares (null if nothing was judged)."""
    f, good, bad = F.col(fired), F.col("disposition") == "productive", F.col("disposition") == "unproductive"
    counts = events.agg(F.count_if(f).alias("alerts"), F.count_if(f & (good | bad)).alias("judged"), F.count_if(f & good).alias("productive"), F.count_if(f & bad).alias("unproductive"), F.count("*").alias("observed"))
    return counts.select("*", round6(F.try_divide("unproductive", "judged")).alias("false_positives"), round6(F.try_divide("productive", "judged")).alias("intelligence_value"))


def compare(events: DataFrame, candidate: str, incumbent: str) -> DataFrame:
    """Alerts that a candidate keeps, adds and drops against the rule in place, in one pass."""
    c, i = F.col(candidate), F.col(incumbent)
    return events.agg(F.count_if(c & i).alias("kept"), F.count_if(c & ~i).alias("added"), F.count_if(~c & i).alias("dropped"))
