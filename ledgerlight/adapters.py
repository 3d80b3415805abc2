"""From the test tables to the engine's inputs. Instants are UTC wall-clock timestamps beside their microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORG = "demo/acme"
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} as timestamp_ntz))")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as transactions of one organisation."""
    e = table(spark, sf_dir, "events")
    k, user = F.get_json_object("props", "$.k"), F.col("user_id")
    raw = F.col("value") * F.when(F.col("event_type") == "purchase", 200).otherwise(60)
    usd = F.when(user % 10 == 0, F.greatest(F.lit(1000.0), F.round(raw / 1000) * 1000)).otherwise(raw)
    text = lambda c: c.cast("string")
    return e.select(
        F.lit(ORG).alias("org_id"),
        text(F.col("event_id")).alias("tx_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        micros("ts").alias("us"),
        F.concat(F.lit("u"), text(user)).alias("user"),
        F.concat(F.lit("a"), text(user), F.lit("-"), text(F.col("event_id") % 3)).alias("account"),
        F.concat(F.lit("cp-"), k).alias("counterparty"),
        F.concat(F.lit("dev-"), text(user % 20)).alias("device"),
        F.concat(F.lit("10.0."), text(user % 8), F.lit("."), k).alias("address"),
        F.when(F.col("event_type").isin("purchase", "error"), "out").otherwise("in").alias("direction"),
        F.when(user % 5 == 3, "EUR").when(user % 5 == 4, "KWD").otherwise("USD").alias("currency"),
        F.when(F.col("event_type") == "signup", "crypto").otherwise("fiat").alias("asset_class"),
        F.concat(F.lit("NATION_"), text(user % 25)).alias("jurisdiction"),
        F.col("event_type").alias("symbol"),
        usd.alias("usd"),
        F.col("props").alias("raw"),
    )


#: The same as transactions(), for DuckDB.
TX_SQL = """tx AS (
  SELECT CAST(event_id AS VARCHAR) AS tx_id, event_id, ts, epoch_us(ts) AS us,
         'u' || user_id AS "user", 'a' || user_id || '-' || (event_id % 3) AS account, 'cp-' || json_extract_string(props, '$.k') AS counterparty,
         'dev-' || (user_id % 20) AS device, '10.0.' || (user_id % 8) || '.' || json_extract_string(props, '$.k') AS address,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'out' ELSE 'in' END AS direction,
         CASE user_id % 5 WHEN 3 THEN 'EUR' WHEN 4 THEN 'KWD' ELSE 'USD' END AS currency,
         CASE WHEN event_type = 'signup' THEN 'crypto' ELSE 'fiat' END AS asset_class,
         'NATION_' || (user_id % 25) AS jurisdiction, event_type AS symbol,
         CASE WHEN user_id % 10 = 0 THEN greatest(1000.0, round(raw / 1000) * 1000) ELSE raw END AS usd
  FROM (SELECT *, value * (CASE WHEN event_type = 'purchase' THEN 200 ELSE 60 END) AS raw FROM events)
)"""


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a history of several years."""
    o = table(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    blank = F.lit("")
    return o.select(
        F.lit(ORG).alias("org_id"), text("o_orderkey").alias("tx_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), micros("o_orderdate").alias("us"),
        F.concat(F.lit("c"), text("o_custkey")).alias("user"), F.concat(F.lit("c"), text("o_custkey")).alias("account"),
        blank.alias("counterparty"), blank.alias("device"), blank.alias("address"),
        F.when(F.col("o_orderstatus") == "F", "out").otherwise("in").alias("direction"), F.lit("USD").alias("currency"),
        F.lit("fiat").alias("asset_class"), blank.alias("jurisdiction"), F.col("o_orderpriority").alias("symbol"),
        F.col("o_totalprice").alias("usd"), F.lit(None).cast("string").alias("raw"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their names, nations and a risk between 0 and 1."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("c_acctbal") + 1000) / 11000))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.lit(ORG).alias("org_id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"),
        F.col("n_name").alias("jurisdiction"), risk.alias("risk_score"), (F.col("c_custkey") % 97 == 0).alias("pep"), F.lit("user").alias("entity_type"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored cases: longer ones score higher, labels say how they turned out."""
    d, label = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    score = F.round(F.least(F.col("n_chars"), F.lit(5000)) / 5000.0, 3)
    verdict = F.when(F.col("toxic") == 1, "productive").when(F.col("toxic") == 0, "unproductive").otherwise("")
    return d.join(label, "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), score.alias("score"), verdict.alias("disposition"), F.lit(1.0).alias("weight"))


OBS_SQL = """obs AS (
  SELECT round(least(n_chars, 5000) / 5000.0, 3) AS score, toxic = 1 AS productive FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL
)"""
