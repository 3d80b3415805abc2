"""Sliding aggregates at a bounded resolution, and the features that are made of them.

A key's events are counted per bucket first; a window is a range over bucket numbers. So a busy key costs a row for each
of its buckets, not for each event, and what is shuffled after the first, partly pre-aggregated, grouping is bounded by
the number of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.plans.terms import DAY_US, blank

#: Name, span and buckets of the standard windows.
WINDOWS = (("1h", 3_600_000_000, 60), ("24h", DAY_US, 96), ("7d", 7 * DAY_US, 168), ("30d", 30 * DAY_US, 120))
THRESHOLD, BAND = 10_000.0, 0.1


def is_near(amount: Column, threshold: float, band: float) -> Column:
    if threshold <= 0 or not 0 < band <= 1:
        return F.lit(False)
    return (amount > 0) & (amount >= threshold * (1 - band)) & (amount < threshold)


def deviation(value: Column, baseline: Column) -> Column:
    """Relative distance from a baseline, 0 where there is none."""
    return F.when((baseline > 0) & ~F.isnan(baseline), F.try_divide(value - baseline, baseline)).otherwise(0.0)


def observe(tx: DataFrame, key: Column, name: str = "key", threshold: float = THRESHOLD, band: float = BAND, windows=WINDOWS, usd: str = "usd") -> DataFrame:
    """For each key and window: count, sum, near, near_sum and days of the buckets that end with the key's newest one."""
    near = is_near(F.col(usd), threshold, band)
    each = F.explode(F.array(*(F.struct(F.lit(window).alias("window"), F.lit(buckets).alias("buckets"), F.floor(F.col("us") / (span // buckets)).cast("long").alias("b")) for window, span, buckets in windows)))
    base = tx.where(~blank(key)).select("org_id", key.alias(name), F.floor(F.col("us") / DAY_US).alias("d"), F.col(usd).alias("usd"), near.alias("near"), each.alias("w")).select("*", "w.*")
    # one scan and one partly aggregated shuffle for all windows, and one more for the buckets of each key and window
    per = base.groupBy("org_id", name, "window", "buckets", "b").agg(F.count("*").alias("n"), F.sum("usd").alias("s"), F.count_if("near").alias("near"), F.sum(F.when(F.col("near"), F.col("usd")).otherwise(0.0)).alias("near_sum"), F.collect_set("d").alias("ds"))
    lead = F.max("b").over(Window.partitionBy("org_id", name, "window"))
    held = per.withColumn("lead", lead).where(F.col("b") > F.col("lead") - F.col("buckets"))
    return held.groupBy("org_id", name, "window").agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.sum("near").alias("near"), F.sum("near_sum").alias("near_sum"), F.size(F.array_distinct(F.flatten(F.collect_list("ds")))).alias("days"))


def structuring(observations: DataFrame, least: int, threshold: float = THRESHOLD) -> DataFrame:
    """Windows with enough amounts just below the threshold whose sum reaches it, most first."""
    return observations.where((F.col("near") >= least) & (F.col("near_sum") >= threshold)).orderBy(F.desc("near"))


def running(tx: DataFrame, kind: str, key: Column, windows=WINDOWS, threshold: float = THRESHOLD, band: float = BAND) -> DataFrame:
    """Each transaction with its key's aggregates as of itself: columns <kind>_<window>_count, _sum, _near, _near_sum and _days.

    What counts are the transactions of the window's buckets, the newest of which is the transaction's own, up to its
    instant; those of the same instant count too. So a frame is a range over the numbers of older buckets, and to it comes
    the own bucket so far. All frames of a key share one shuffle.
    """
    near = is_near(F.col("usd"), threshold, band)
    safe = F.when(blank(key), F.concat(F.lit("\0"), F.col("tx_id"))).otherwise(key)
    day = F.floor(F.col("us") / DAY_US)
    by = Window.partitionBy("org_id", "_key")
    rows = tx.withColumns({"_key": safe, "_near": near.cast("int"), "_near_usd": F.when(near, F.col("usd")).otherwise(0.0), "_day": F.dense_rank().over(Window.partitionBy("org_id", safe).orderBy(day))})
    named = {}
    for window, span, buckets in windows:
        bucket = F.floor(F.col("us") / (span // buckets))
        older, frame = by.orderBy(bucket).rangeBetween(-(buckets - 1), -1), by.orderBy(bucket).rangeBetween(-(buckets - 1), 0)
        own = Window.partitionBy("org_id", "_key", bucket).orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
        upto = lambda c, older=older, own=own: F.coalesce(F.sum(c).over(older), F.lit(0)) + F.sum(c).over(own)
        p = f"{kind}_{window}_"
        named |= {p + "count": upto(F.lit(1)), p + "sum": upto(F.col("usd")), p + "near": upto(F.col("_near")), p + "near_sum": upto(F.col("_near_usd")), p + "days": F.col("_day") - F.min("_day").over(frame) + 1}
    return rows.select("*", *(c.alias(n) for n, c in named.items())).drop("_key", "_near", "_near_usd", "_day")


#: Name, window and neutral value of the features.
FEATURES = (("amount", "30d", 0.5), ("count", "24h", 0.5), ("volume", "24h", 0.5), ("burst", "1h", 0.0), ("subthreshold", "7d", 0.0), ("subvalue", "7d", 0.0), ("counterparty", "30d", 0.0), ("device", "24h", 0.5), ("novelty", "30d", 0.0))


def over(total: Column, n: Column) -> Column:
    return F.when((n > 0) & (total > 0), total / n).otherwise(0.0)


def ratio(value: Column, baseline: Column) -> Column:
    """A multiple of the baseline, pressed into 0 to 1 with one half for the baseline itself."""
    r = 1 + deviation(value, baseline)
    return F.when(F.isnan(r) | (r <= 0), 0.0).when(r == float("inf"), 1.0).otherwise(r / (1 + r))


def share(part: Column, whole: Column) -> Column:
    return F.when((whole > 0) & (part > 0), F.least(F.lit(1.0), part / whole)).otherwise(0.0)


def features(tx: DataFrame) -> DataFrame:
    """Each transaction with nine features from 0 to 1 (x_<name>), and whether each was blind (blind_<name>: nothing to go by)."""
    account = F.when(~blank(F.col("account")), F.col("account")).otherwise(F.col("user"))
    pair = F.when(~blank(F.col("counterparty")), F.concat_ws("\x1f", account, F.col("counterparty")))
    seen = running(tx, "acct", account)
    seen = running(seen, "pair", pair, windows=[w for w in WINDOWS if w[0] == "30d"])
    seen = running(seen, "dev", F.col("device"), windows=[w for w in WINDOWS if w[0] == "24h"])
    c = lambda n: F.col(n).cast("double")
    usd, day, month = c("usd"), c("acct_24h_count"), c("acct_30d_count")
    per_tx = over(c("acct_30d_sum") - usd, month - 1)
    rate, flow = over(month - 1, c("acct_30d_days")), over(c("acct_30d_sum") - usd, c("acct_30d_days"))
    no_pair, no_device = blank(F.col("counterparty")), blank(F.col("device"))
    prior = F.when(no_pair, 0.0).otherwise(F.greatest(F.lit(0.0), c("pair_30d_count") - 1))
    points = {
        "amount": (ratio(usd, per_tx), per_tx <= 0),
        "count": (ratio(day, rate), rate <= 0),
        "volume": (ratio(c("acct_24h_sum"), flow), flow <= 0),
        "burst": (share(c("acct_1h_count"), day), day < 2),
        "subthreshold": (share(c("acct_7d_near"), c("acct_7d_count")), c("acct_7d_count") == 0),
        "subvalue": (share(c("acct_7d_near_sum"), c("acct_7d_sum")), c("acct_7d_sum") <= 0),
        "counterparty": (1 / (1 + prior), no_pair),
        "device": (ratio(c("dev_24h_count"), day), no_device | (day == 0)),
        "novelty": (1 / (1 + F.greatest(F.lit(0.0), month - 1)), F.lit(False)),
    }
    out = []
    for name, _, neutral in FEATURES:
        x, blind = points[name]
        out += [F.when(blind, neutral).otherwise(x).alias("x_" + name), blind.alias("blind_" + name)]
    return seen.select("org_id", "tx_id", "ts", "us", "user", "account", "usd", *out)
