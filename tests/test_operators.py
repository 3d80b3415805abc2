"""Operators without an SQL equivalent, against small cases and brute force."""

import datetime as dt
import ipaddress

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.adapters import transactions
from ledgerlight.functions import crypto, dates, names
from ledgerlight.operators import anomaly, evaluate, lists, records, screening, velocity, watch
from ledgerlight.sources import sanctions, tables

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert names.fold("  José-María  ÑÚÑEZ ") == "jose maria nunez"
    assert names.fold("Юрий Щукин") == "yurii shchukin"
    assert names.similarity("Ivan Petrov", "PETROV, Ivan") == 1.0 or names.similarity("Ivan Petrov", "PETROV, Ivan") > 0.99
    assert names.similarity("Smith", "Smirnov") == 0
    assert names.similarity("Acme Ltd", "Acme Limited") > 0.99
    assert names.similarity("", "x") == 0 and names.similarity(None, None) == 0
    assert names.similarity("Petr", "Ivan Petrovic") == 0


def _entries(spark, path):
    return [r.asDict(True) for r in path.collect()]


OFAC = """<sdnList xmlns="urn:x"><publshInformation><Publish_Date>01/02/2024</Publish_Date><Record_Count>{n}</Record_Count></publshInformation>
<sdnEntry><uid>7</uid><firstName>Ivan</firstName><lastName>PETROV</lastName><sdnType>Individual</sdnType><programList><program>P1</program></programList>
<akaList><aka><type>a.k.a.</type><category>weak</category><lastName>VANYA</lastName></aka></akaList><idList><id><idType>Digital Currency Address - XBT</idType><idNumber>bc1qxyz</idNumber></id><id><idType>Passport</idType><idNumber>AB-123</idNumber></id></idList>
<dateOfBirthList><dateOfBirthItem><dateOfBirth>circa 1961</dateOfBirth><mainEntry>false</mainEntry></dateOfBirthItem><dateOfBirthItem><dateOfBirth>05 Mar 1960</dateOfBirth><mainEntry>true</mainEntry></dateOfBirthItem></dateOfBirthList>
<nationalityList><nationality><country>Russia</country></nationality></nationalityList></sdnEntry>
<sdnEntry><uid>8</uid><lastName>SEA STAR</lastName><sdnType>Vessel</sdnType></sdnEntry></sdnList>"""
UN = """<CONSOLIDATED_LIST><INDIVIDUALS><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>Omar</FIRST_NAME><SECOND_NAME>Said</SECOND_NAME><REFERENCE_NUMBER>QDi.1</REFERENCE_NUMBER><NAME_ORIGINAL_SCRIPT>عمر</NAME_ORIGINAL_SCRIPT>
<INDIVIDUAL_ALIAS><QUALITY>Low</QUALITY><ALIAS_NAME>Abu Omar</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_DATE_OF_BIRTH><TYPE_OF_DATE>BETWEEN</TYPE_OF_DATE><FROM_YEAR>1960</FROM_YEAR><TO_YEAR>1965</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH></INDIVIDUAL></INDIVIDUALS>
<ENTITIES><ENTITY><DATAID>2</DATAID><FIRST_NAME>Front Company</FIRST_NAME><REFERENCE_NUMBER>QDe.2</REFERENCE_NUMBER></ENTITY></ENTITIES></CONSOLIDATED_LIST>"""
EU = """<export generationDate="2024-01-01"><sanctionEntity euReferenceNumber="EU.1" logicalId="9"><subjectType classificationCode="P"/><nameAlias wholeName="Ana Silva" strong="true"/><nameAlias firstName="Anna" lastName="Sylva" strong="false"/>
<birthdate year="1970" monthOfYear="3" calendarType="GREGORIAN"/><birthdate year="1390" calendarType="ISLAMIC"/><citizenship countryIso2Code="BR" countryDescription="BRAZIL"/><identification number="X1" identificationTypeDescription="National passport"/></sanctionEntity></export>"""
OFSI = """Last Updated,10/01/2024
Name 6,Name 1,Name 2,Name 3,Name 4,Name 5,DOB,Nationality,Passport Number,Alias Type,Alias Quality,Group Type,Regime,Group ID
KIM,Chol,,,,,00/00/1965,North Korea,P1,AKA,,Individual,DPRK,100
KIM,Chul,,,,,01/02/1965,North Korea,,AKA,Low quality,Individual,DPRK,100
BRIGHT STAR,,,,,,,,,Primary name,,Ship,DPRK,101
"""


def test_published_lists(spark, tmp_path):
    for name, text in (("o.xml", OFAC.format(n=2)), ("bad.xml", OFAC.format(n=3)), ("u.xml", UN), ("e.xml", EU), ("f.csv", OFSI), ("none.xml", "<CONSOLIDATED_LIST/>")):
        (tmp_path / name).write_text(text)
    o = {e["ref_id"]: e for e in _entries(spark, sanctions.ofac(spark, f"{tmp_path}/o.xml"))}
    assert o["7"]["names"][0]["full"] == "Ivan PETROV" and o["7"]["names"][1]["strong"] is False and o["8"]["kind"] == "vessel"
    assert [b["from_s"] for b in o["7"]["births"]] == ["1960-03-05", "1961"] and o["7"]["births"][1]["circa"]
    assert [(d["kind"], d["chain"]) for d in o["7"]["documents"]] == [("address", "XBT"), ("passport", "")]
    with pytest.raises(sanctions.ListRefused):
        sanctions.ofac(spark, f"{tmp_path}/bad.xml")
    u = {e["ref_id"]: e for e in _entries(spark, sanctions.un(spark, f"{tmp_path}/u.xml"))}
    assert u["QDi.1"]["names"][0] == {"full": "Omar Said", "type": "primary", "strong": True, "script": "عمر"} and not u["QDi.1"]["names"][1]["strong"]
    assert (u["QDi.1"]["births"][0]["from_s"], u["QDi.1"]["births"][0]["to_s"], u["QDe.2"]["kind"]) == ("1960", "1965", "entity")
    with pytest.raises(sanctions.ListRefused):
        sanctions.un(spark, f"{tmp_path}/none.xml")
    (e,) = _entries(spark, sanctions.eu(spark, f"{tmp_path}/e.xml"))
    assert [n["full"] for n in e["names"]] == ["Ana Silva", "Anna Sylva"] and [b["from_s"] for b in e["births"]] == ["1970-03"] and e["citizenships"] == ["BRAZIL"] and e["documents"][0]["kind"] == "passport"
    f = {e["ref_id"]: e for e in _entries(spark, sanctions.ofsi(spark, f"{tmp_path}/f.csv"))}
    assert [(n["full"], n["type"], n["strong"]) for n in f["100"]["names"]] == [("Chol KIM", "primary", True), ("Chul KIM", "also", False)]
    assert [b["from_s"] for b in f["100"]["births"]] == ["1965", "1965-02-01"] and f["101"]["kind"] == "vessel" and f["100"]["nationalities"] == ["North Korea"]


def test_screening_is_exhaustive(spark, tmp_path):
    (tmp_path / "o.xml").write_text(OFAC.format(n=2))
    entries = sanctions.ofac(spark, f"{tmp_path}/o.xml")
    q = spark.createDataFrame([("1", "petrov ivan", ("1960", "1960", False), "russia"), ("2", "Vanya", None, None), ("3", "Ivan Petrow", ("1980", "1980", False), None), ("4", "Nobody Else", None, None), ("5", None, None, None)], "query_id string, name string, birth struct<from_s:string,to_s:string,circa:boolean>, nationality string")
    found = {r["query_id"]: r for r in screening.screen(q, entries).collect()}
    assert set(found) == {"1", "2"} and found["1"]["score"] == 1.0 and found["1"]["agree"] == ["birth", "nationality"]
    assert found["2"]["score"] == pytest.approx(0.88)
    assert screening.by_document(spark.createDataFrame([("ab 123",), ("zz",)], "n string"), entries, "n").count() == 1
    assert screening.by_document(spark.createDataFrame([("BC1QXYZ",)], "n string"), entries, "n", chain=True).count() == 1


def test_name_search_equals_comparing_all():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcde"), rng.integers(1, 7)))
    people = [" ".join(word() for _ in range(rng.integers(1, 4))) for _ in range(120)]
    index = screening.NameIndex([(str(i), 0, n, "") for i, n in enumerate(people[:60])])
    for q in people[60:]:
        assert {e for e, _, _ in index.search(q, 0.75)} == {str(i) for i, n in enumerate(people[:60]) if names.similarity(q, n) >= 0.75}


def test_partial_dates(spark):
    assert dates.loose_birth("circa 1961 to Mar 1962") == {"from_s": "1961", "to_s": "1962-03", "circa": True}
    assert dates.loose_birth("unknown") is None and dates.slash_birth("00/00/1965")["from_s"] == "1965"
    s = "struct<from_s:string,to_s:string,circa:boolean>"
    df = spark.createDataFrame([((("1960", "1965", False)), ("1963-02", "1963-02", False)), (("1960-03", "1960-03", False), ("1960", "1960", False)), (("1960-03", "1960-03", False), ("1960-04-01", "1960-04-01", False))], f"a {s}, b {s}")
    assert [r[0] for r in df.select(dates.overlap(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_crypto(spark):
    vault = crypto.Vault("o", b"k" * 32)
    df = spark.createDataFrame([("  Ann   Lee ",), ("ann lee",), ("",), (None,)], "n string")
    p = [r[0] for r in df.select(vault.pseudonym("name", F.col("n"))).collect()]
    assert p[0] == p[1] and p[0].startswith("name:") and p[2:] == [None, None]
    assert crypto.json_mark('{"b": 1, "a": [1.50]}') == crypto.json_mark('{"a":[1.50],"b":1}') != crypto.json_mark('{"a":[1.5],"b":2}')
    assert crypto.verify(b"x", "s", crypto.sign(b"x", "s")) and not crypto.verify(b"y", "s", crypto.sign(b"x", "s"))
    assert crypto.fnv1a(b"a") == 0xAF63DC4C8601EC8C and crypto.fnv1a(b"a", 32) == 0xE40C292C
    assert crypto.valid_webhook("https://example.com/x") and not any(map(crypto.valid_webhook, ("http://example.com", "https://127.0.0.1/", "https://10.0.0.1", "https://localhost", "https://u@example.com")))
    with pytest.raises(ValueError):
        crypto.Vault("o", b"short")


def test_lists(spark):
    forms = [("ip", " 10.0.0.1 ", "10.0.0.1"), ("ip", "::ffff:10.0.0.1", "10.0.0.1"), ("ip", "10.0.0.256", None), ("email", "A@B.c", "a@b.c"), ("email", "a@b@c", None), ("country", "ch", "CH"), ("asn", "AS12", "12"), ("bin", "4x", None), ("device", " d ", "d")]
    for klass, value, want in forms:
        assert spark.range(1).select(lists.normalise(klass, F.lit(value))).head()[0] == want, value


def test_lists_of_both_families(spark):
    forms = ["2001:db8::1", "2001:DB8:0:0:0:0:0:1", "::", "::1", "1::", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "64:ff9b::10.0.0.1", "::ffff:10.0.0.1", "::FFFF:a00:1", "10.0.0.1", "fe80::1", "2001:db8:ffff:ffff:8000::"]
    wrong = ["1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "g::", "::10.0.0.256", "10.0.0.1::", ":::", ":", "", "::/64", "fe80::%"]
    got = {r[0]: r[1:] for r in spark.createDataFrame([(x,) for x in forms + wrong], "v string").select("v", lists.normalise("ip", F.col("v")), lists.ip_bits(F.col("v"))).collect()}
    for x in forms:
        ip = ipaddress.ip_address(x)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        assert got[x] == (str(ip), f"{int(ip):0{ip.max_prefixlen}b}"), x
    assert all(got[x] == (None, None) for x in wrong), got
    assert spark.range(1).select(lists.normalise("ip", F.lit("FE80:0::1%eth0")), lists.ip_bits(F.lit("fe80::1%eth0"))).head()[:] == ("fe80::1%eth0", None)
    nets = ["2001:db8::/32", "2001:db8:ffff:ffff:8000::/65", "fe80::7/10", "::/0", "0.0.0.0/0", "10.0.0.7/8", "::1/128", "::ffff:10.0.0.0/104", "64:ff9b::/129", "2001:db8::/x"]
    entries = [(n, "ip", n, True, None, None) for n in nets] + [("host", "ip", "2001:DB8:0::1", False, None, None)]
    held = spark.createDataFrame(entries, "list string, class string, value string, range boolean, removed boolean, until timestamp")
    found = lists.listed(spark.createDataFrame([(x,) for x in [*forms, *wrong, None]], "v string").withColumnRenamed("v", "address"), "address", held, F.lit(None).cast("timestamp")).collect()
    assert len(found) == len(forms) + len(wrong) + 1
    for r in found:
        want = []
        if r["address"] in forms:
            ip = ipaddress.ip_address(r["address"])
            ip = getattr(ip, "ipv4_mapped", None) or ip
            want = [n for n in nets[:7] if ip in ipaddress.ip_network(n, strict=False)] + ["host"] * (str(ip) == "2001:db8::1")
        assert r["lists"] == sorted(want), r


def _obs(spark, rows):
    return spark.createDataFrame([(float(s), d, 1.0) for s, d in rows], "score double, disposition string, weight double")


def test_metrics(spark):
    good, bad = "productive", "unproductive"
    perfect = evaluate.judged(_obs(spark, [(0.9, good), (0.8, good), (0.2, bad), (0.1, bad), (0.5, "")]))
    assert evaluate.roc_auc(perfect).head()[0] == 1.0 and evaluate.average_precision(perfect).head()[0] == 1.0
    tied = evaluate.judged(_obs(spark, [(0.5, good), (0.5, bad)]))
    assert evaluate.roc_auc(tied).head()[0] == 0.5
    mixed = evaluate.judged(_obs(spark, [(0.9, good), (0.8, bad), (0.7, good), (0.6, bad)]))
    assert evaluate.average_precision(mixed).head()[0] == 0.833333
    assert evaluate.roc_auc(evaluate.judged(_obs(spark, [(0.9, good)]))).head()[0] is None
    assert evaluate.cheapest(perfect, 10.0, 1.0).head().asDict() == {"threshold": 0.8, "cost": 0.0}
    assert evaluate.cheapest(evaluate.judged(_obs(spark, [(0.9, bad), (0.1, good)])), 1.0, 5.0).head()["threshold"] is None


def test_calibration(spark):
    rng = np.random.default_rng(1)
    s = rng.random(6000).round(3)
    obs = _obs(spark, [(x, "productive" if y else "unproductive") for x, y in zip(s, rng.random(6000) < s * s)])
    for method, off in (("isotonic", 0.06), ("platt", 0.12)):
        c = evaluate.calibrate(obs, method, "m")
        got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.1, 0.5, 0.9)], "x double").select(c.column(F.col("x"), "m")).collect()]
        assert np.allclose(got, [0.01, 0.25, 0.81], atol=off) and got == sorted(got)
    with pytest.raises(ValueError):
        c.column(F.col("x"), "other")
    with pytest.raises(ValueError):
        evaluate.calibrate(_obs(spark, [(0.5, "productive")] * 30))
    with pytest.raises(ValueError):
        evaluate.Policy(((0.5, "block"), (0.6, "flag")))
    assert [s["rows"] for s in evaluate.learning(obs.withColumn("i", F.monotonically_increasing_id()), "i", 2)] == [2400, 4800]


def _acts(spark, rows):
    return spark.createDataFrame([(f"i{k}", "o", "r", "account", "a", f"t{k}", us, action, sil) for k, (us, action, sil) in enumerate(rows)], "id string, org_id string, rule string, kind string, value string, tx string, us long, action string, silenced boolean")


def test_ladder(spark):
    rungs = spark.createDataFrame([("up", "o", "r", "account", 3, 100, "block", None), ("fold", "o", "r", "account", 2, 10, "fold", None)], "id string, org_id string, rule string, kind string, count int, within_us long, to string, retired_us long")
    out = {r["id"]: r for r in watch.ladder(_acts(spark, [(0, "review", False), (5, "review", False), (50, "review", False), (55, "block", False), (300, "review", True)]), rungs).collect()}
    assert (out["i0"]["streak"], out["i0"]["response"]) == (1, "review")
    assert (out["i1"]["duplicate"], out["i1"]["duplicate_of"], out["i1"]["response"]) == (True, "i0", "allow")
    assert (out["i2"]["rung"], out["i2"]["response"]) == ("up", "block")
    assert (out["i3"]["duplicate"], out["i3"]["duplicate_of"]) == (True, "i2")  # block can't be raised, so it folds
    assert (out["i4"]["streak"], out["i4"]["response"]) == (0, "allow")
    page = watch.feed(_acts(spark, [(0, "review", False), (5, "review", False), (9, "review", False)]), since=(0, "i0"), limit=1).collect()
    assert [r["id"] for r in page] == ["i1", "i2"]


def test_velocity_by_brute_force(spark):
    tx = transactions(spark, SMALL)
    got = {r["tx_id"]: r for r in velocity.running(tx, "k", F.col("account"), windows=velocity.WINDOWS[1:2]).collect()}
    rows = sorted((r["account"], r["us"], r["usd"], r["tx_id"]) for r in tx.collect())
    for a, us, _, t in rows[::37]:
        mine = [x for x in rows if x[0] == a and us - (86_400_000_000 - 900_000_000) <= x[1] <= us]
        assert got[t]["k_24h_count"] == len(mine) and got[t]["k_24h_sum"] == pytest.approx(sum(x[2] for x in mine))


def test_forest():
    shape = anomaly.Shape(trees=10, depth=5, window=32, review=0.05)
    rng = np.random.default_rng(3)
    x = rng.normal(0.5, 0.05, (2000, 9)).clip(0, 1)
    forest = anomaly.Forest(shape, "o")
    score, cut, warm = forest.feed(x)
    assert not warm[: 8 * 32].any() and warm[8 * 32 :].all()
    assert (score[1000:] > cut[1000:]).mean() <= 0.12
    odd = np.full((1, 9), 0.99)
    assert forest.scores(odd)[0] > np.median(forest.scores(x[-200:]))
    causes = forest.causes(odd[0], forest.scores(odd)[0])
    assert abs(sum(s for _, s, _ in causes) - 1) < 1e-9
    again = anomaly.Forest(shape, "o")
    parts = [again.feed(p)[0] for p in np.array_split(x, 7)]
    assert np.array_equal(np.concatenate(parts), score)
    copy = anomaly.Forest(shape, "o").restore(forest.snapshot())
    assert np.array_equal(copy.scores(x[:50]), forest.scores(x[:50]))
    with pytest.raises(ValueError):
        anomaly.Forest(anomaly.Shape(trees=9, depth=5, window=32), "o").restore(forest.snapshot())
    broken = forest.snapshot()
    broken["ref"][3] += 5
    with pytest.raises(ValueError):
        anomaly.Forest(shape, "o").restore(broken)
    assert np.isnan(forest.feed(np.full((1, 9), np.nan))[0][0])
    with pytest.raises(ValueError):
        anomaly.grid(depth=(30,))


def test_records(spark):
    vals = spark.createDataFrame([("transaction", dt.date(2020, 1, 1), dt.date(2012, 1, 1), 3000), ("transaction", dt.date(2020, 1, 1), dt.date(2016, 1, 1), 3000), ("x", dt.date(2020, 1, 1), None, None), ("x", None, None, None)], "class string, start date, occurred date, extended_days int")
    assert [str(r["expiry"]) for r in records.with_expiry(vals).collect()] == ["2030-01-01", "2026-01-01", "2025-01-01", "None"]
    with pytest.raises(ValueError):
        records.permitted(vals, "curiosity")
    cases = spark.createDataFrame([("o", 1, None, "open"), ("o", 2, None, "open"), ("o", 3, "ann", "open")], "org_id string, number int, assignee string, status string")
    got = {r["number"]: r["assignee"] for r in records.assign(cases, ["ann", "bob"], {"ann": 1}).collect()}
    assert got == {1: "bob", 2: "ann", 3: "ann"}
    assert records.least_loaded(cases, ["ann", "bob"]).head()["assignee"] == "bob"


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("o", "1", 5), ("o", "1", 6), ("p", "1", 7)], "org_id string, tx_id string, v int")
    for _ in range(2):
        tables.append_once(spark, rows, f"{tmp_path}/t", ["org_id", "tx_id"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    with pytest.raises(ValueError):
        tables.scoped(rows, "")
    for source, n in (("a", 3), ("b", 2), ("a", 1)):
        tables.replace_source(spark, spark.range(n), f"{tmp_path}/s", source)
    assert {r["source"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/s").groupBy("source").count().collect()} == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        tables.replace_source(spark, spark.range(0), f"{tmp_path}/s", "a")
    good, bad = tables.bounded(spark.createDataFrame([("x", "y"), ("z" * 300, "y")], "a string, b string"), ["a", "b"])
    assert good.count() == 1 and bad.head()["errors"] == ["a"]
    loads = spark.createDataFrame([("a", 5, "d", dt.datetime(2024, 1, 1)), ("b", 0, "d", dt.datetime(2024, 1, 2))], "source string, entries int, digest string, loaded_at timestamp")
    state = tables.readiness(loads, ["a", "b", "c"], "2024-01-02 00:00:00")
    assert {r["source"]: r["fit"] for r in state.collect()} == {"a": True, "b": False, "c": False}
    with pytest.raises(RuntimeError):
        tables.require_ready(state)
