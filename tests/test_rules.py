"""The rule language and the window terms, on small histories."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.adapters import micros
from ledgerlight.plans.dsl import RuleError, parse
from ledgerlight.plans.engine import Providers, RuleSet, with_entities
from ledgerlight.plans.library import LIBRARY, Rule

T0 = dt.datetime(2024, 1, 10, 12)


def tx(spark, rows):
    """rows: hours after T0, usd, and other fields."""
    full = []
    for i, (h, usd, *more) in enumerate(rows):
        r = {"org_id": "o", "tx_id": f"t{i:03d}", "ts": T0 + dt.timedelta(hours=h), "user": "u", "account": "a", "counterparty": "c", "device": "d", "address": "10.0.0.1", "direction": "out", "currency": "USD", "asset_class": "fiat", "jurisdiction": "X", "symbol": "s", "usd": usd}
        full.append(r | (more[0] if more else {}))
    schema = "org_id string, tx_id string, ts timestamp_ntz, user string, account string, counterparty string, device string, address string, direction string, currency string, asset_class string, jurisdiction string, symbol string, usd double"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in full], schema).withColumn("us", micros("ts"))


def fired(spark, dsl, rows, **providers):
    """Ids of the transactions on which a rule fires without an error."""
    found = RuleSet([Rule("r", dsl)], Providers(**providers)).alerts(tx(spark, rows))
    return sorted(r["tx_id"] for r in found.where("error is null").collect())


def failed(spark, dsl, rows, **providers):
    found = RuleSet([Rule("r", dsl)], Providers(**providers)).alerts(tx(spark, rows))
    return {r["tx_id"]: (r["error"], r["action"], r["tx_score"]) for r in found.where("error is not null").collect()}


def test_structured(spark):
    five = [(h, 2500.0) for h in range(5)]
    assert fired(spark, 'Structured("user", "24h", 10000, 3)', five) == ["t003", "t004"]
    for rows in ([(0, 12000.0)], [(0, 12000.0), (1, 1000.0), (2, 1000.0)], [(0, 9000.0)]):
        assert fired(spark, 'Structured("user", "24h", 10000, 3)', rows) == []
    assert fired(spark, 'Structured("user", "24h", 0, 1)', five) == []


def test_near_band(spark):
    rows = [(0, 8999.99), (1, 9000.0), (2, 9999.99), (3, 10000.0)]
    assert fired(spark, "Near(10000, 0.1)", rows) == ["t001", "t002"]
    assert fired(spark, "Near(10000, 1.5)", rows) == []


def test_day_and_zone(spark):
    rows = [(-1, 6000.0), (0, 6000.0), (13, 6000.0)]  # 11:00, 12:00 and 01:00 of the next day
    assert fired(spark, 'Day("user") > 10000', rows) == ["t001"]
    assert fired(spark, 'Day("user") > 10000', [(11, 6000.0), (13, 6000.0)]) == []
    assert fired(spark, 'Day("user") > 10000', [(11, 6000.0), (13, 6000.0)], zone="America/New_York") == ["t001"]


def test_in_out(spark):
    out, into = {"direction": "out"}, {"direction": "in"}
    rule = 'InOut("user", "24h", 10000, 0.05)'
    assert fired(spark, rule, [(0, 20000.0, into), (1, 19500.0, out)]) == ["t001"]
    assert fired(spark, rule, [(0, 20000.0, into), (1, 12000.0, out)]) == []
    assert fired(spark, rule, [(0, 900.0, into), (1, 900.0, out)]) == []


def test_dormancy(spark):
    assert fired(spark, 'Dormant("user", "30d") > 2', [(0, 1.0), (72, 1.0)]) == ["t001"]
    assert fired(spark, 'Dormant("user", "30d") > 2', [(0, 1.0), (72, 1.0), (72, 2.0)]) == []
    assert fired(spark, 'Dormant("user", "2d") > 1', [(0, 1.0), (72, 1.0)]) == []


def test_deviation(spark):
    flat = [(h, 100.0 + h % 3) for h in range(12)]
    assert fired(spark, 'Deviation("user", "90d", 10) > 3.5', [*flat, (13, 5000.0)]) == ["t012"]
    assert fired(spark, 'Deviation("user", "90d", 10) > 3.5', [*flat[:5], (13, 5000.0)]) == []
    assert fired(spark, 'Deviation("user", "90d", 4) != 0', [(h, 5.0) for h in range(9)]) == []


def test_seen_distinct_round(spark):
    rows = [(0, 1000.0, {"counterparty": "A"}), (1, 2000.0, {"counterparty": ""}), (2, 1500.5, {"counterparty": "b"})]
    assert fired(spark, 'Seen("user", "counterparty", "a", "24h")', rows) == ["t000", "t001", "t002"]
    assert fired(spark, 'Distinct("user", "counterparty", "24h") > 1', rows) == ["t002"]
    assert fired(spark, 'Round("user", "24h", 1000) > 0.9', rows) == ["t000", "t001"]


def test_tenants_are_apart(spark):
    rows = [(0, 6000.0), (1, 6000.0, {"org_id": "other"})]
    assert fired(spark, 'Sum("user", "24h") > 10000', rows) == []


def test_errors_are_values(spark):
    rows = [(0, 5.0), (1, 5.0, {"user": " "}), (2, None)]
    assert set(failed(spark, 'Count("user", "24h") > 5', rows)) == {"t001"}
    assert failed(spark, 'Count("user", "24h") > 5', rows)["t001"][1:] == ("review", 0.0)
    assert set(failed(spark, "USD() > 1", rows)) == {"t002"}
    assert len(failed(spark, 'Count("user", "24x") > 5', rows)) == 3
    assert len(failed(spark, 'Distinct("user", "colour", "24h") > 5', rows)) == 3
    assert failed(spark, 'Tx.symbol == "no" && Count("user", "24h") > 5', rows) == {}
    assert failed(spark, 'Tx.symbol == "s" || Count("user", "24h") > 5', rows) == {}
    assert len(failed(spark, 'Tx.device != "" && Distinct("device", "user", "7d") > 5', rows, compat=True)) == 3
    assert failed(spark, "USD() / 0 > 1", [(0, 5.0)])["t000"][0] == "division by zero"


@pytest.mark.parametrize("dsl", ['Screened(Entity.name, "pep")', "USD()", "USD() >", 'Tier(Tx.jurisdiction) == "action"', "Tx.colour == 1", "Tx.usd && true", "x" * 3000, 'Listed("l", Tx.user)', "1 + 'a' > 2", "Tx.usd in ['a']", "sum(Tx.usd) > 1"])
def test_refused(dsl):
    with pytest.raises(RuleError):
        RuleSet([Rule("ok", "USD() > 1"), Rule("r", dsl)])


def test_refused_sets():
    with pytest.raises(RuleError):
        RuleSet([Rule("r", "USD() > 1"), Rule("r", "USD() > 2")])
    with pytest.raises(RuleError):
        RuleSet([Rule("r", "USD() > 1", weight=-1.0)])


def test_language(spark):
    assert parse("1 + 2 * 3 == 7 && not (2 > 3)").value == "&&"
    for dsl in ('lower("AB") == "ab"', "2 ** 3 ** 2 == 512", "-2 + 5 == 3", "7 % 4 == 3", '"x" in ["x", "y"]', 'Tx.symbol not in ["x"]', 'len("abc") == 3', "max(1, 2, 3) == 3", 'Tx.address matches "^10\\\\."', "Tx.usd > 1 ? true : false", 'Tx.user + "!" == "u!"', "abs(0 - 2) == 2", "Entity.name == nil || true", 'Tx.address startsWith "10" && Tx.address endsWith ".1"'):
        assert fired(spark, dsl, [(0, 5.0)]) == ["t000"], dsl


def test_scope_and_disabled(spark):
    rows = tx(spark, [(0, 5.0), (1, 5.0, {"asset_class": "Crypto", "jurisdiction": "ch"})])
    rs = RuleSet([Rule("a", "USD() > 1", asset_classes=("crypto",)), Rule("b", "USD() > 1", enabled=False), Rule("c", "USD() > 1", jurisdictions=("CH",))])
    assert sorted((r["tx_id"], r["rule_id"]) for r in rs.alerts(rows).collect()) == [("t001", "a"), ("t001", "c")]


def test_score_and_action(spark):
    rs = RuleSet([Rule("a", "USD() > 1", "critical", 0.4, "flag"), Rule("b", "USD() > 1", "low", 0.1, "block"), Rule("c", "USD() > 100", "high", 0.5, "report")])
    one, none, much = rs.evaluate(tx(spark, [(0, 5.0), (1, 0.5), (2, 500.0)])).orderBy("tx_id").collect()
    assert (round(one["score"], 6), one["action"], {k: round(v, 6) for k, v in one["breakdown"].items()}) == (0.85, "block", {"a": 0.8, "b": 0.05})
    assert (none["score"], none["action"]) == (0.0, "allow")
    assert much["score"] == 1.0


def test_providers(spark):
    names = spark.createDataFrame([("ivan petrov",)], "name string")
    people = spark.createDataFrame([("o", "u", "ivan petrov", "CH", "user", 0.5, False)], "org_id string, id string, name string, jurisdiction string, entity_type string, risk_score double, pep boolean")
    held = spark.createDataFrame([("c",)], "value string")
    rs = RuleSet([Rule("s", 'Entity.name != "" && Screened(Entity.name, "sanctions")'), Rule("l", 'Listed("deny", Tx.counterparty)'), Rule("t", 'Tier(Tx.jurisdiction) == "action"')], Providers(screened={"sanctions": names}, listed={"deny": held}, tiers={"X": "action"}, entities=True))
    rows = with_entities(tx(spark, [(0, 5.0), (1, 5.0, {"user": "v", "counterparty": "z", "jurisdiction": "Y"})]), people)
    assert sorted((r["tx_id"], r["rule_id"]) for r in rs.alerts(rows).collect()) == [("t000", "l"), ("t000", "s"), ("t000", "t")]


def test_whole_library(spark):
    empty = spark.createDataFrame([], "name string")
    rs = RuleSet(LIBRARY, Providers(screened={"sanctions": empty, "pep": empty}, tiers={"X": "monitoring"}, entities=True))
    people = spark.createDataFrame([], "org_id string, id string, name string, jurisdiction string, entity_type string, risk_score double, pep boolean")
    out = rs.evaluate(with_entities(tx(spark, [(0, 12000.0), (1, 9500.0)]), people)).orderBy("tx_id").collect()
    assert {h["rule_id"] for h in out[0]["hits"]} == {"currency-day", "transmittal-recordkeeping", "transmittal-payment-transparency", "geography-monitoring"}
    assert "structuring-near-threshold" in {h["rule_id"] for h in out[1]["hits"]}


def test_windows_share_their_shuffle(spark):
    rs = RuleSet([Rule(f"r{i}", f'Sum("user", "{i}h") > {i}') for i in range(1, 6)])
    plan = rs.evaluate(tx(spark, [(0, 5.0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_language_forms(spark):
    """Named parts, defaults, ranges, pipes and tests of lists."""
    rows = [(0, 50.0), (1, 150.0, {"currency": "EUR"}), (2, 3.0, {"symbol": "BUY"})]
    cases = {
        "let limit = 100; USD() > limit": ["t001"],
        "let a = USD(); let b = a * 2; b > 90 && b < 110": ["t000"],
        "Tx.usd in 1..5": ["t002"],
        "Tx.usd in 1..2 + 1": ["t002"],
        'Tx.currency | lower() == "eur"': ["t001"],
        '(nil ?? "EUR") == Tx.currency': ["t001"],
        'any(["EUR", "GBP"], # == Tx.currency)': ["t001"],
        'none(["EUR", "GBP"], {# == Tx.currency})': ["t000", "t002"],
        "all(1..3, # < Tx.usd)": ["t000", "t001"],
        "one([100, 200], # < Tx.usd)": ["t001"],
        "count(1..5, # < Tx.usd) == 2": ["t002"],
        "any([1, 2], any([3], # == Tx.usd))": ["t002"],
        'Tx?.symbol == "BUY"': ["t002"],
        "ceil(Tx.usd / 100) == 2 && floor(Tx.usd / 100) == 1": ["t001"],
    }
    for dsl, wanted in cases.items():
        assert fired(spark, dsl, rows) == wanted, dsl
    for broken in ("let = 3; true", "let x = 3 x > 2", "# > 2", "1..2.5 == 3", "any(Tx.usd, # > 1)", "Tx.usd | 3", "Tx.usd in 1..5000", "count([1], #) == 1", '(3 ?? "a") == 3'):
        with pytest.raises(RuleError):
            RuleSet([Rule("r", broken)])


def test_scorer_is_contained(spark):
    from ledgerlight.plans.engine import with_scorer

    rows = tx(spark, [(0, 50.0), (1, 150.0)])
    decided = RuleSet([Rule("r", "USD() > 100", "high", 0.4, "report")]).evaluate(rows)
    said = spark.createDataFrame([("o", "t000", "m", "medium", 0.3, "block"), ("o", "t001", "m", "medium", -0.3, "block"), ("o", "t009", "m", "medium", 0.3, "block")], "org_id string, tx_id string, rule_id string, severity string, weight double, action string")
    got = {r["tx_id"]: (r["action"], round(r["score"], 6), len(r["hits"])) for r in with_scorer(decided, said).collect()}
    assert got == {"t000": ("review", 0.3, 1), "t001": ("report", 0.6, 1)}
