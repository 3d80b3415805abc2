"""The streaming form gives what the batch form gives."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.adapters import transactions
from ledgerlight.operators import velocity
from ledgerlight.plans.engine import RuleSet
from ledgerlight.plans.library import Rule
from ledgerlight.streaming import monitor, webhook

SMALL = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, tx, parts=3):
    tx = tx.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("us")
    pdf = tx.toPandas()
    for i in range(parts):
        part = pdf.iloc[i * len(pdf) // parts : (i + 1) * len(pdf) // parts]
        extra = pdf.iloc[max(0, i * len(pdf) // parts - 3) : i * len(pdf) // parts]  # offered again
        spark.createDataFrame(part._append(extra) if i else part, tx.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_rules_on_a_stream(spark, tmp_path):
    tx = transactions(spark, SMALL)
    rules = RuleSet([Rule("day", 'Structured("user", "24h", 10000, 3)'), Rule("n", 'Count("user", "24h") > 3')])
    q = monitor.run(spark, _stream(spark, tmp_path, tx), rules, f"{tmp_path}/out", 86_400_000_000, lateness="60 days")
    q.processAllAvailable()
    q.stop()
    found = spark.read.parquet(f"{tmp_path}/out/alerts")
    key = lambda df: sorted((r["tx_id"], r["rule_id"]) for r in df.collect())
    assert key(found) == key(rules.alerts(tx))


def test_velocity_on_a_stream(spark, tmp_path):
    rows = [("a", 0, 9500.0), ("a", 10, 100.0), ("a", 30 * 3600, 50.0), ("a", 5, 1.0)]
    t0 = dt.datetime(2024, 1, 1)
    us = 1704067200000000
    df = spark.createDataFrame([("o", a, f"t{i}", t0 + dt.timedelta(seconds=s), us + s * 1_000_000, v) for i, (a, s, v) in enumerate(rows)], "org_id string, account string, tx_id string, ts timestamp, us long, usd double")
    for i in range(len(rows)):
        df.where(F.col("tx_id") == f"t{i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("ts", "60 days")
    q = monitor.velocity(stream).writeStream.format("memory").queryName("velocities").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r["tx_id"]: r for r in spark.table("velocities").collect()}
    assert (got["t0"]["near"], got["t1"]["count"], got["t1"]["sum"]) == (1, 2, 9600.0)
    assert (got["t2"]["count"], got["t3"]["late"], got["t3"]["count"]) == (1, True, 2)


def test_velocity_batch_is_stream(spark, tmp_path):
    """Events in order have the same aggregates in a batch as on a stream, bucket by bucket."""
    tx = transactions(spark, SMALL).where("user in ('u1', 'u2', 'u3', 'u4', 'u5', 'u6')").select("org_id", "account", "tx_id", F.col("ts").cast("timestamp").alias("ts"), "us", "usd")
    rows = tx.orderBy("us").toPandas()
    for i in range(3):
        spark.createDataFrame(rows.iloc[len(rows) * i // 3 : len(rows) * (i + 1) // 3], tx.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("ts", "60 days")
    q = monitor.velocity(stream).writeStream.format("memory").queryName("twins").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    fields = ("count", "sum", "near", "near_sum", "days")
    got = {r["tx_id"]: tuple(round(float(r[c]), 6) for c in fields) for r in spark.table("twins").collect()}
    batch = velocity.running(tx, "a", F.col("account"), [w for w in velocity.WINDOWS if w[0] == "24h"])
    assert got == {r["tx_id"]: tuple(round(float(r["a_24h_" + c]), 6) for c in fields) for r in batch.collect()} and len(got) == len(rows)


def test_webhook(spark):
    tried = []

    def send(body, headers):
        tried.append(headers["X-Signature"])
        return 500 if len(tried) < 3 else 200

    assert webhook.deliver({"a": 1}, "s", send, wait=lambda s: None) and len(tried) == 3 and len(set(tried)) == 1
