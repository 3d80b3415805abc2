"""Histories for backtests, and what models and outside services add to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.records import dispositions
from ledgerlight.plans.engine import RuleSet
from ledgerlight.plans.library import Rule

#: Events of a replay, and ids that an outcome lists.
EVENTS, IDS = 100_000, 1_000


def history(tx: DataFrame, alerts: DataFrame, assessments: DataFrame, include_refusals: bool = False, events: int | None = EVENTS) -> DataFrame:
    """Retained transactions with the rules that alerted on them and how the last judged alert turned out, newest first.

    alerts: org_id, tx_id, alert_id, rule_id. Blocked transactions are left out unless asked for (column refused).
    """
    told = alerts.join(dispositions(assessments), ["org_id", "alert_id"], "left")
    per = told.groupBy("org_id", "tx_id").agg(F.array_sort(F.collect_set("rule_id")).alias("alerted"), F.max_by("disposition", F.when(F.col("disposition").isNotNull(), F.col("alert_id"))).alias("disposition"))
    rows = tx if include_refusals or "refused" not in tx.columns else tx.where("not coalesce(refused, false)")
    out = rows.join(per, ["org_id", "tx_id"], "left").withColumn("disposition", F.coalesce("disposition", F.lit("")))
    return out.orderBy(F.desc("us"), F.desc("tx_id")).limit(events) if events else out


def backtest(events: DataFrame, candidate: Rule, incumbent: Rule | None = None, providers=None) -> DataFrame:
    """events with candidate (and incumbent) fired, in one plan. A rule that fails on any event fails the run."""
    rules = [Rule(**{**r.__dict__, "id": name, "enabled": True}) for name, r in (("candidate", candidate), ("incumbent", incumbent)) if r]
    rs = RuleSet(rules, providers)
    named = rs.prepare(events).select("org_id", "tx_id", "disposition", rs.hits_column().alias("hits"))
    strict = F.when(F.exists("hits", lambda h: h["error"].isNotNull()), F.raise_error(F.concat_ws(": ", F.lit("a rule failed"), F.element_at(F.filter("hits", lambda h: h["error"].isNotNull()), 1)["error"])).cast("boolean"))
    fired = lambda name: F.coalesce(strict, F.exists("hits", lambda h: h["rule_id"] == name))
    return named.select("org_id", "tx_id", "disposition", *(fired(r.id).alias(r.id) for r in rules))


def fired_ids(events: DataFrame, fired: str, most: int = IDS) -> DataFrame:
    """The first ids that a rule alerted on."""
    return events.where(fired).select("tx_id").orderBy("tx_id").limit(most)


def contributions(scored: DataFrame) -> DataFrame:
    """For each feature the alerts that it took part in and its mean share; most alerts first."""
    each = scored.where("alert").select(F.explode("causes").alias("c"))
    return each.groupBy("c.feature").agg(F.count("*").alias("alerts"), F.round(F.avg("c.share"), 6).alias("share")).orderBy(F.desc("alerts"), "feature")


def refusals(scored: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Events that weren't scored by reason, and events on which each feature was blind."""
    why = scored.agg(F.count_if(F.col("score").isNull()).alias("unusable"), F.count_if(F.col("score").isNotNull() & ~F.col("warm")).alias("warming"), F.count_if("warm").alias("scored"), F.count_if("alert").alias("alerted"))
    blind = features.agg(*(F.count_if("blind_" + n).alias("blind_" + n) for n in names))
    return why.crossJoin(blind)  # one row each


def chain_risk(tx: DataFrame, risks: DataFrame, address: str = "address") -> DataFrame:
    """tx with the risk of its address: high from 0.7 on or by category, blocked if sanctioned. risks: address, risk, category."""
    key = F.lower(F.trim(F.col(address)))
    r = risks.select(F.lower(F.trim("address")).alias("_a"), "risk", "category").dropDuplicates(["_a"])
    out = tx.join(r, key == F.col("_a"), "left").drop("_a")
    return out.withColumns({"high_risk": high_risk(F.col("risk"), F.col("category")), "blocked": F.coalesce(F.col("category") == "sanctions", F.lit(False))})


def transfer_risk(tx: DataFrame, risks: DataFrame, key: str = "tx_hash") -> DataFrame:
    """tx with the risk of its transfer: the highest of what is known of it (risks: key, risk, category), and high_risk and blocked as for addresses."""
    k = F.lower(F.trim(F.col(key)))
    r = risks.groupBy(F.lower(F.trim(key)).alias("_k")).agg(F.max("risk").alias("risk"), F.array_sort(F.collect_set("category")).alias("categories"))
    out = tx.join(r, k == F.col("_k"), "left").drop("_k")
    bad = F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, BAD))), F.lit(False))
    return out.withColumns({"high_risk": F.coalesce(F.col("risk") >= HIGH_RISK, F.lit(False)) | bad, "blocked": F.coalesce(F.array_contains("categories", "sanctions"), F.lit(False))})


#: The least high risk, and categories that are high whatever the risk.
HIGH_RISK, BAD = 0.7, ("mixer", "darknet", "sanctions", "scam", "ransomware", "stolen_funds")


def high_risk(risk: Column, category: Column) -> Column:
    return F.coalesce(risk >= HIGH_RISK, F.lit(False)) | F.coalesce(category.isin(*BAD), F.lit(False))
