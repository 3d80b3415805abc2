"""The streaming form: exactly-once offers, sliding aggregates with late events, and rules on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerlight.operators import profile
from ledgerlight.operators.velocity import BAND, THRESHOLD
from ledgerlight.plans.engine import RuleSet
from ledgerlight.plans.terms import DAY_US, SUBJECTS, blank


def once(stream: DataFrame, lateness: str = "24 hours", keys: tuple[str, ...] = ("org_id", "tx_id")) -> DataFrame:
    """Each transaction once within the lateness; the state of older ones is dropped."""
    event = stream if dict(stream.dtypes)["ts"] == "timestamp" else stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return event.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


OBSERVED = "org_id string, account string, tx_id string, us long, count long, sum double, near long, near_sum double, days int, late boolean"


def velocity(stream: DataFrame, span: int = DAY_US, buckets: int = 96, threshold: float = THRESHOLD, band: float = BAND) -> DataFrame:
    """Each event with the aggregates of its account's buckets, up to the newest one seen.

    State is one row of at most so many buckets for each account, whatever the number of events, and goes when the account
    has been quiet for a window. An event older than the window counts in the newest bucket and is marked late.
    """
    step = span // buckets

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[int, list] = {r[0]: list(r[1:]) for r in state.get[0]} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["us", "tx_id"], kind="stable")
        out = []
        lead = max(held, default=0)
        for tx, us, usd in zip(rows["tx_id"], rows["us"], rows["usd"]):
            b = int(us // step)
            lead = max(lead, b)
            late = lead - b >= buckets
            b = lead if late else b
            slot = held.setdefault(b, [0, 0.0, 0, 0.0, 0])
            near = threshold * (1 - band) <= usd < threshold and usd > 0
            slot[0] += 1
            slot[1] += usd
            slot[2] += near
            slot[3] += usd if near else 0.0
            slot[4] |= 1 << (us // DAY_US % 63)
            held = {k: v for k, v in held.items() if k > lead - buckets}
            days = 0
            for v in held.values():
                days |= v[4]
            out.append((key[0], key[1], tx, us, sum(v[0] for v in held.values()), sum(v[1] for v in held.values()), sum(v[2] for v in held.values()), sum(v[3] for v in held.values()), days.bit_count(), late))
        state.update(([(k, *v) for k, v in held.items()],))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (lead + buckets) * step // 1000))
        yield pd.DataFrame(out, columns=["org_id", "account", "tx_id", "us", "count", "sum", "near", "near_sum", "days", "late"])

    kept = "buckets array<struct<b:long,count:long,sum:double,near:long,near_sum:double,days:long>>"
    return stream.groupBy("org_id", "account").applyInPandasWithState(update, OBSERVED, kept, "append", GroupStateTimeout.EventTimeTimeout)


def of_subjects(known: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of known that share a subject (kind and value, within an organisation) with a row of new.

    Subjects of new are a table of distinct values; each kind is a semi-join on them, and a row that several kinds find
    counts once. Whatever shares no subject can be in no window of new.
    """
    found = None
    for kind in SUBJECTS:
        asked = new.where(~blank(F.col(kind))).select("org_id", kind).distinct()
        ids = known.join(asked, ["org_id", kind], "left_semi").select("org_id", "tx_id")
        found = ids if found is None else found.unionByName(ids)
    found = found.unionByName(new.select("org_id", "tx_id")).distinct()
    return known.join(found, ["org_id", "tx_id"], "left_semi")


def rules_on_batches(rules: RuleSet, history: str, alerts: str, widest_us: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch to the history and its alerts to a table, once for each batch.

    A batch is judged with the part of the history that its subjects' windows reach back to: rows that share a subject of any
    kind with the batch, of the days from the oldest window on. The history is partitioned by day within a batch, so that
    older days aren't read. Both tables are written by replacing the batch's partition, so a batch that is run again after a
    failure leaves no second copy.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("day", F.floor(F.col("us") / DAY_US).cast("int"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{history}/batch={number}")
        new = spark.read.schema(rows.schema).parquet(f"{history}/batch={number}")
        bounds = new.agg(F.min("us"), F.max("us")).head()
        if bounds[0] is None:
            return
        first = (bounds[0] - widest_us) // DAY_US
        known = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", IntegerType())])).option("basePath", history).parquet(history).where((F.col("batch") <= number) & (F.col("day") >= first) & F.col("us").between(bounds[0] - widest_us, bounds[1]))
        known = of_subjects(known, new)
        found = rules.alerts(known)
        found.join(new.select("org_id", "tx_id"), ["org_id", "tx_id"], "left_semi").write.mode("overwrite").parquet(f"{alerts}/batch={number}")

    return step


def run(spark: SparkSession, stream: DataFrame, rules: RuleSet, folder: str, widest_us: int, lateness: str = "24 hours"):
    """A query that monitors a stream of transactions until it is stopped; alerts are in folder/alerts."""
    step = rules_on_batches(rules, f"{folder}/history", f"{folder}/alerts", widest_us)
    return once(stream, lateness).writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").start()


def profile_on_batches(path: str, cells: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes what a batch adds to the field profile; published_profile() puts all batches together.

    cells makes profile cells of a batch. A batch that is run again replaces what it wrote before, so nothing counts twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        profile.partial(cells(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def published_profile(spark: SparkSession, path: str) -> DataFrame:
    return profile.published(spark.read.option("basePath", path).parquet(path).drop("batch"))


def pressure(query) -> dict:
    """How a running query keeps up: rows read and processed a second, rows and bytes of state, rows dropped as too late, and the watermark."""
    p = query.lastProgress or {}
    state = p.get("stateOperators") or []
    return {
        "batch": p.get("batchId"), "rows_in": p.get("inputRowsPerSecond"), "rows_done": p.get("processedRowsPerSecond"), "state_rows": sum(s.get("numRowsTotal", 0) for s in state),
        "state_bytes": sum(s.get("memoryUsedBytes", 0) for s in state), "late": sum(s.get("numRowsDroppedByWatermark", 0) for s in state), "watermark": (p.get("eventTime") or {}).get("watermark"),
    }
