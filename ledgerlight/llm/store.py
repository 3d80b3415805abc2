"""Tables in, and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Short rows of numbers that a task takes before more tasks do better.
TASK_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and all runs on one machine a temporary one is made; on a cluster that raises."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or getattr(spark, "_ledgerlight_folder", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerlight-')}"
        spark._ledgerlight_folder = folder
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables of one run. They cut lineage, survive lost executors, and go when the driver ends or on drop()."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """A table of df. If at most so many short rows are to be expected, no more tasks than they need write it, however many partitions shuffles have."""
        some = df if rows is None else gathered(df, rows)
        some.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended before the interpreter: nothing can be deleted through it any more
            return


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as so many short rows need, and every core one at least; unchanged if those aren't fewer than shuffles have."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
    return df.coalesce(wanted) if wanted < shuffle_width(df.sparkSession) else df


def _murmur_of_int(x: int) -> int:
    """Spark's hash of an int, by which it deals rows to partitions."""
    full = 0xFFFFFFFF
    turn = lambda v, n: ((v << n) | (v >> (32 - n))) & full
    k = turn((x & full) * 0xCC9E2D51 & full, 15) * 0x1B873593 & full
    h = (turn(42 ^ k, 13) * 5 + 0xE6546B64) & full
    h ^= 4
    h = (h ^ (h >> 16)) * 0x85EBCA6B & full
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & full
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def homes(parts: int) -> list[int]:
    """For each of parts partitions an int that repartition(parts, column) sends there."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < parts:
        found.setdefault(_murmur_of_int(x) % parts, x)
        x += 1
    return [found[i] for i in range(parts)]
