"""Catalogues of changes, replayed histories and risks."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.adapters import transactions
from ledgerlight.operators import anomaly, catalog, evaluate, replay, velocity
from ledgerlight.plans.library import Rule

SMALL = "/root/testdata/sf0.001"


def test_suppressions_and_rungs(spark):
    s = spark.createDataFrame([("suppress", "o", "a", 1, "r", "", "", 0, 9), ("suppress", "o", "a", 3, "other", "", "", 0, 9), ("lift", "o", "a", 7, None, None, None, None, None), ("lift", "o", "a", 5, None, None, None, None, None)], "op string, org_id string, id string, at_us long, rule string, kind string, value string, from_us long, until_us long")
    assert catalog.suppressions(s).select("rule", "lifted_us").collect() == [("r", 5)]
    r = spark.createDataFrame([("declare", "o", "a", 1, "r", "user", 3, 10, "block"), ("declare", "o", "bad", 1, "r", "user", 0, 10, "block"), ("declare", "o", "odd", 1, "r", "user", 1, 10, "shout"), ("retire", "o", "a", 5, None, None, None, None, None)], "op string, org_id string, id string, at_us long, rule string, kind string, count int, within_us long, to string")
    rungs = catalog.ladder(r)
    assert [(x["id"], x["retired_us"]) for x in rungs.collect()] == [("a", 5)]
    assert catalog.rungs_in_force(rungs, F.lit(5)).count() == 1 and catalog.rungs_in_force(rungs, F.lit(6)).count() == 0


def test_entries_and_cases(spark):
    e = spark.createDataFrame([("add", "o", "l", "v", 1), ("remove", "o", "l", "v", 2), ("add", "o", "l", "w", 1)], "op string, org_id string, list string, value string, at long")
    assert {r["value"]: r["removed"] for r in catalog.entries(e).collect()} == {"v": True, "w": False}
    c = spark.createDataFrame([("o", "1", "note", "x", "a", 1), ("o", "1", "assign", "ann", "a", 2), ("o", "1", "status_change", "in_review", "a", 3), ("o", "1", "assign", "bob", "a", 4), ("o", "2", "resolve", "sar_filed", "a", 5)], "org_id string, case_id string, kind string, body string, author string, at_us long")
    got = {r["case_id"]: r for r in catalog.cases(c).collect()}
    assert (got["1"]["status"], got["1"]["assignee"], got["2"]["status"], got["2"]["resolution"]) == ("in_review", "bob", "closed", "sar_filed")
    assert [r["case_id"] for r in catalog.expired_cases(catalog.cases(c), F.lit(100), 50).collect()] == ["2"]
    rows, more = catalog.page(c, ["at_us"], 3)
    assert rows.count() == 3 and more


def test_replay(spark):
    tx = transactions(spark, SMALL)
    alerts = tx.where("usd > 20000").select("org_id", "tx_id", F.concat(F.lit("a"), "tx_id").alias("alert_id"), F.lit("big").alias("rule_id"))
    judged = alerts.select("org_id", F.array("alert_id").alias("alert_ids"), (F.length("tx_id") % 2 == 0).alias("reported"), F.lit(1).alias("at_us"))
    h = replay.history(tx, alerts, judged)
    assert h.count() == tx.count() and h.where("disposition != ''").count() == alerts.count()
    done = replay.backtest(h, Rule("c", "USD() > 15000"), Rule("i", "USD() > 20000"))
    row = evaluate.compare(done, "candidate", "incumbent").head()
    assert row["kept"] == alerts.count() and row["dropped"] == 0 and row["added"] == tx.where("usd > 15000 and usd <= 20000").count()
    assert replay.fired_ids(done, "candidate", 5).count() == 5
    with pytest.raises(Exception, match="a rule failed"):
        replay.backtest(h, Rule("c", 'Count("user", "9x") > 1')).collect()


def test_model_summaries(spark):
    points = velocity.features(transactions(spark, SMALL))
    scored = anomaly.score(points, anomaly.Shape(trees=5, depth=4, window=16, review=0.05))
    s = replay.refusals(scored, points, anomaly.NAMES).head()
    assert s["warming"] == 128 and s["scored"] == points.count() - 128 and s["blind_novelty"] == 0
    assert replay.contributions(scored).count() <= 9


def test_chain_risk(spark):
    tx = spark.createDataFrame([("A1",), ("b2",), ("c3",)], "address string")
    risks = spark.createDataFrame([("a1", 0.8, None), ("B2", 0.1, "sanctions")], "address string, risk double, category string")
    assert [(r["high_risk"], r["blocked"]) for r in replay.chain_risk(tx, risks).orderBy("address").collect()] == [(True, False), (True, True), (False, False)]


def test_coverage_and_refusals(spark):
    from ledgerlight.operators import records

    c = {r["rule"]: r for r in catalog.coverage(spark).collect()}
    assert len(c) == 20 and c["exposure-political"]["providers"] == ["rates", "screening"] and c["structuring-day"]["terms"] == ["Structured"]
    rows = spark.createDataFrame([("o", "relationship", "relationship_end", ["p"], "r", "2024-01-01", "loan", None), ("", "x", None, [], " ", None, None, None), ("o", "refusal", "refusal", ["p"], "r", "2024-01-01", None, "")], "org_id string, class string, trigger string, parties array<string>, ref string, occurred string, nature string, reason string")
    assert [r["errors"] for r in records.refused(rows).collect()] == [[], ["org", "class", "trigger", "parties", "ref", "occurred"], ["reason"]]
