"""Durable tables: appended once, replaced by source, and checked before use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: hours after which a loaded list is stale.
STALE_HOURS = 48
#: Fixed value: bytes that an identifier may have.
LONGEST_ID = 256


def scoped(df: DataFrame, org: str) -> DataFrame:
    """Rows of one organisation; without one nothing may be read."""
    if not org:
        raise ValueError("an organisation is needed")
    return df.where(F.col("org_id") == org)


def find(df: DataFrame, org: str, condition: str | None = None, sort: list | None = None, limit: int | None = None) -> DataFrame:
    out = scoped(df, org)
    out = out.where(condition) if condition else out
    out = out.orderBy(*sort) if sort else out
    return out.limit(limit) if limit else out


def bounded(df: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose identifiers are short enough, and the others with the columns that aren't."""
    long = F.array_compact(F.array(*(F.when(F.octet_length(F.coalesce(c, F.lit(""))) > LONGEST_ID, F.lit(c)) for c in ids)))
    marked = df.withColumn("errors", long)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def append_once(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Adds the rows whose keys the table doesn't have; of equal keys in rows one is added."""
    new = rows.dropDuplicates(keys)
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def replace_source(spark: SparkSession, entries: DataFrame, path: str, source: str) -> None:
    """Puts a list's entries in place of those that its partition has; no entries are refused. Other lists stay as they are."""
    if not entries.limit(1).count():
        raise ValueError(f"{source}: no entries")
    rows = entries.withColumn("source", F.lit(source))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def readiness(loads: DataFrame, sources: list[str], now: str, stale_hours: float = STALE_HOURS) -> DataFrame:
    """source, entries, digest, age_hours and fit of each wanted source; loads: source, entries, digest, loaded_at."""
    last = loads.groupBy("source").agg(F.max_by(F.struct("entries", "digest", "loaded_at"), "loaded_at").alias("x")).select("source", "x.*")
    wanted = loads.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("loaded_at")) / 3600
    out = wanted.join(last, "source", "left").withColumn("age_hours", age)
    return out.withColumn("fit", F.coalesce((F.col("entries") > 0) & (F.col("age_hours") <= stale_hours), F.lit(False)))


def require_ready(state: DataFrame) -> None:
    unfit = [r["source"] for r in state.where("not fit").select("source").collect()]  # a row for each list
    if unfit:
        raise RuntimeError(f"lists not fit for screening: {', '.join(sorted(unfit))}")


def judgements(spark: SparkSession, alerts: DataFrame, path: str) -> None:
    """Adds the alerts of transactions that have none yet: the first judgement of a transaction stands, with all its alerts."""
    new = alerts.dropDuplicates(["org_id", "tx_id", "rule_id"])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select("org_id", "tx_id").distinct(), ["org_id", "tx_id"], "left_anti")
    new.write.mode("append").parquet(path)


def workspace(spark: SparkSession, what: str) -> str:
    """A new folder for tables that a run needs, in the one that spark.checkpoint.dir names; in a temporary one where all runs on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}"
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
