"""Registered queries over lists, screening, catalogues, tables and judgements, with SQL for each."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from ledgerlight.adapters import OBS_SQL, ORG, TX_SQL, entities, observations, table, transactions
from ledgerlight.functions import crypto, dates
from ledgerlight.functions.names import LEGAL_FORMS
from ledgerlight.operators import anomaly, catalog, evaluate, profile, records, reference, replay, screening, velocity, watch
from ledgerlight.plans.engine import Providers, RuleSet, with_entities, with_scorer
from ledgerlight.plans.library import LIBRARY, Rule
from ledgerlight.plans.queries_records import _people, _retained, sanctions_entries
from ledgerlight.sources import sanctions, tables
from ledgerlight.streaming import monitor

DAY = 86_400_000_000
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _registered(sql: str):
    def add(query):
        QUERIES[query.__name__] = query
        ORACLE[query.__name__] = sql
        return query

    return add


# --- names -------------------------------------------------------------------------------------------------------------

#: Pairs of names with their similarity, for DuckDB: queries q(id, f), list names n(e, position, strong, f), all folded.
PAIRS_SQL = f"""parts AS (SELECT id, e, position, strong, q.f AS qf, n.f AS nf, string_split(q.f, ' ') AS qp, string_split(n.f, ' ') AS np FROM q, n WHERE q.f <> '' AND n.f <> ''),
sided AS (SELECT *, CASE WHEN len(qp) > len(np) THEN np ELSE qp END AS short, CASE WHEN len(qp) > len(np) THEN qp ELSE np END AS long FROM parts),
each AS (SELECT *, unnest(short) AS x FROM sided),
named AS (SELECT * FROM each WHERE length(x) >= 3 AND regexp_matches(x, '\\p{{L}}') AND x NOT IN ({", ".join(f"'{w}'" for w in sorted(LEGAL_FORMS))})),
against AS (SELECT *, unnest(long) AS y FROM named),
j AS (SELECT *, CASE WHEN x = y THEN 1.0 ELSE jaro_similarity(x, y) END AS j, CASE WHEN left(x, 4) = left(y, 4) THEN 4 WHEN left(x, 3) = left(y, 3) THEN 3 WHEN left(x, 2) = left(y, 2) THEN 2 WHEN left(x, 1) = left(y, 1) THEN 1 ELSE 0 END AS p FROM against),
best AS (SELECT id, e, position, x, len(long) AS n_long, max(CASE WHEN x = y THEN 1.0 ELSE j + 0.1 * least(p, length(x), length(y)) * (1 - j) END) AS s FROM j GROUP BY id, e, position, x, len(long)),
summed AS (SELECT id, e, position, min(s) AS low, avg(s) AS s, count(*) AS k, max(n_long) AS n_long FROM (SELECT b.*, unnest(generate_series(1, len(list_filter(short, lambda z: z = b.x)))) AS again FROM best b JOIN sided USING (id, e, position)) GROUP BY ALL),
similarity AS (SELECT id, e, position, strong, CASE WHEN qf = nf THEN 1.0 WHEN low < 0.8 OR low IS NULL THEN 0.0 WHEN k = 1 AND n_long > 1 AND s.s < 0.95 THEN 0.0 ELSE s.s END AS s FROM sided LEFT JOIN summed s USING (id, e, position)),
matched AS (SELECT id, e, arg_max(strong, (s, -position)) AS strong, max(s) AS s FROM similarity WHERE s >= 0.75 GROUP BY id, e)"""


def _folded(text: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({text})), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


PEOPLE_SQL = """people AS (SELECT doc_id, concat_ws(' ', CASE WHEN len(w) > 0 THEN w[1] END, CASE WHEN len(w) > 1 THEN w[2] END) AS name FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
listed AS (SELECT CAST(doc_id AS VARCHAR) AS e, doc_id % 3 AS nation, [substr(name, 1, 1) || substr(name, 3), string_split(name, ' ')[1]] AS names FROM people WHERE doc_id % 40 = 0),
n AS (SELECT e, position, position = 0 AS strong, """ + _folded("full_") + """ AS f FROM (SELECT e, unnest([0, 1]) AS position, unnest(names) AS full_ FROM listed) WHERE full_ <> '')"""

SCREEN_SQL = f"""WITH {PEOPLE_SQL}, q AS (SELECT doc_id AS id, {_folded("name")} AS f FROM people), {PAIRS_SQL},
scored AS (SELECT id, m.e, s - CASE WHEN strong THEN 0 ELSE 0.12 END + CASE WHEN id % 2 = nation THEN 0.05 ELSE -0.05 END AS raw, id % 2 = nation AS home FROM matched m JOIN listed ON listed.e = m.e)
SELECT CAST(id AS VARCHAR) AS query_id, e AS ref_id, round(least(1, greatest(0, raw)), 6) AS score, CASE WHEN home THEN 'nationality' ELSE '' END AS agree, CASE WHEN home THEN '' ELSE 'nationality' END AS conflict
FROM scored WHERE raw >= 0.85"""

RESCREEN_SQL = f"""WITH {PEOPLE_SQL}, customers AS (SELECT 'demo/acme|u' || c_custkey AS id, name, lower(n_name) AS home FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN people ON doc_id = c_custkey
  WHERE greatest(0, least(1, (c_acctbal + 1000) / 11000)) > 0.5 OR c_custkey % 97 = 0), q AS (SELECT id, {_folded("name")} AS f FROM customers), {PAIRS_SQL},
scored AS (SELECT m.id, s - CASE WHEN strong THEN 0 ELSE 0.12 END + CASE WHEN home = 'nation_' || nation THEN 0.05 ELSE -0.05 END AS raw FROM matched m JOIN listed ON listed.e = m.e JOIN customers ON customers.id = m.id)
SELECT id AS query_id, round(max(least(1, greatest(0, raw))), 6) AS score, count(*) AS matches, substr(sha256('rescreen|' || id), 1, 32) AS alert_id FROM scored WHERE raw >= 0.85 GROUP BY id"""
ORACLE |= {"screen_names": SCREEN_SQL, "rescreen_customers": RESCREEN_SQL}


@_registered(f"""WITH {TX_SQL}, {PEOPLE_SQL}, q AS (SELECT doc_id AS id, {_folded("name")} AS f FROM people), {PAIRS_SQL},
hits AS (SELECT DISTINCT name FROM matched JOIN people ON doc_id = id WHERE s - CASE WHEN strong THEN 0 ELSE 0.12 END >= 0.85 AND name <> ''),
c AS (SELECT 'u' || c_custkey AS "user", name, name IN (SELECT name FROM hits) AS hit FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN people ON doc_id = c_custkey),
t AS (SELECT tx_id, usd, coalesce(hit, false) AS a, counterparty IN ('cp-7', 'cp-8') AS b FROM tx LEFT JOIN c USING ("user"))
SELECT tx_id, unnest([CASE WHEN a THEN 'sanctions-customer' END, CASE WHEN b THEN 'sanctions-counterparty' END, CASE WHEN a AND usd > 10000 THEN 'exposure-political' END]) AS rule_id, 'block' AS action FROM t WHERE a OR b
QUALIFY rule_id IS NOT NULL""".replace("QUALIFY rule_id IS NOT NULL", ""))
def rules_screened(spark, sf_dir):
    """The three starter rules that look names up in screened lists."""
    people = _people(spark, sf_dir).select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("id"), F.col("name").alias("person"))
    customers = entities(spark, sf_dir).join(people, "id").withColumn("name", F.col("person")).drop("person")
    names = screening.hit_names(_people(spark, sf_dir), sanctions_entries(spark, sf_dir), octets=True)
    held = names.unionByName(spark.createDataFrame([("cp-7",), ("cp-8",)], "name string"))
    rules = [r for r in LIBRARY if r.id in ("sanctions-customer", "sanctions-counterparty", "exposure-political")]
    found = RuleSet(rules, Providers(entities=True, screened={"sanctions": held, "pep": held})).alerts(with_entities(transactions(spark, sf_dir), customers))
    return found.select("tx_id", "rule_id", F.col("tx_action").alias("action"))


ORACLE["rules_screened"] = f"SELECT * FROM ({ORACLE['rules_screened']}) WHERE rule_id IS NOT NULL"


@_registered("""SELECT c_custkey, CAST(doc_id AS VARCHAR) AS ref_id FROM customer JOIN documents ON doc_id = c_custkey AND doc_id % 40 = 0 AND doc_id % 80 = 0""")
def screen_addresses(spark, sf_dir):
    """Wallets of customers against listed ones: hex in either case, others as they are written."""
    wallet = lambda k, up: F.when(k % 80 == 0, F.concat(F.lit("0x"), F.upper(F.lpad(F.hex(k), 8, "0")) if up else F.lower(F.lpad(F.hex(k), 8, "0")))).otherwise(F.concat(F.lit("Wallet") if up else F.lit("wallet"), k.cast("string")))
    key = F.col("ref_id").cast("long")
    listed = sanctions_entries(spark, sf_dir).withColumn("documents", F.array(F.struct(F.lit("address").alias("kind"), wallet(key, True).alias("number"), F.lit("").alias("country"), F.lit("ETH").alias("chain"))))
    asked = table(spark, sf_dir, "customer").select("c_custkey", wallet(F.col("c_custkey"), False).alias("wallet"))
    return screening.by_document(asked, listed, "wallet", chain=True).select("c_custkey", "ref_id")


@_registered("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT *, strftime(d, '%Y-%m-%d') AS iso, strftime(d, '%Y-%m') AS m, strftime(d, '%Y') AS y FROM o)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN iso WHEN 1 THEN m WHEN 2 THEN y ELSE y END AS from_s, CASE o_orderkey % 4 WHEN 0 THEN iso WHEN 1 THEN m WHEN 2 THEN y ELSE CAST(year(d) + 2 AS VARCHAR) END AS to_s, o_orderkey % 4 = 2 AS circa,
  CASE o_orderkey % 4 WHEN 0 THEN iso >= '1995' AND left(iso, 4) <= '1996' WHEN 3 THEN y <= '1996' AND year(d) + 2 >= 1995 ELSE y BETWEEN '1995' AND '1996' END AS overlaps FROM b""")
def births(spark, sf_dir):
    """Loosely written dates and ranges, and whether they can share a day with 1995 to 1996."""
    d = F.to_date("o_orderdate")
    k, year = F.col("o_orderkey") % 4, F.year(d)
    text = F.when(k == 0, F.date_format(d, "dd MMM yyyy")).when(k == 1, F.date_format(d, "MMM yyyy")).when(k == 2, F.concat(F.lit("circa "), year.cast("string"))).otherwise(F.concat(year.cast("string"), F.lit(" to "), (year + 2).cast("string")))
    born = table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_loose_birth(text).alias("b"))
    span = F.struct(F.lit("1995").alias("from_s"), F.lit("1996").alias("to_s"), F.lit(False).alias("circa"))
    return born.select("o_orderkey", "b.from_s", "b.to_s", "b.circa", dates.overlap(F.col("b"), span).alias("overlaps"))


# --- published lists ---------------------------------------------------------------------------------------------------


def _written(spark, rows, what: str, root: str | None = None) -> str:
    """A list's file made of one text column, in a folder of its own; its lines may stand in a root element."""
    path = tables.workspace(spark, what)
    if root:
        ends = spark.createDataFrame([(0, f"<{root}>"), (2, f"</{root}>")], "i int, value string")
        rows = rows.select(F.lit(1).alias("i"), "value").unionByName(ends).coalesce(1).sortWithinPartitions("i").select("value")
    rows.write.text(path)
    return path


def _listed(found):
    each = lambda c, f: F.array_join(F.transform(c, f), "; ")
    return found.select(
        "list", "ref_id", "kind", each("names", lambda n: F.concat_ws("|", n["full"], n["type"], n["strong"].cast("string"))).alias("names"), each("births", lambda b: F.concat_ws("|", b["from_s"], b["to_s"])).alias("births"),
        F.array_join(F.concat("nationalities", "citizenships"), "; ").alias("homes"), each("documents", lambda d: F.concat_ws("|", d["kind"], d["number"])).alias("documents"), F.array_join("programs", "; ").alias("programs"),
    )


@_registered("""SELECT 'ofac' AS list, CAST(s_suppkey AS VARCHAR) AS ref_id, CASE WHEN s_suppkey % 2 = 0 THEN 'individual' ELSE 'entity' END AS kind, 'First ' || s_name || '|primary|true; Other ' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '|formerly|false' ELSE '|also|true' END AS names,
  '1970-03-02|1970-03-02' AS births, 'Nation ' || s_nationkey AS homes, 'passport|P' || s_suppkey || '; address|0xab' || s_suppkey AS documents, 'SDGT' AS programs FROM supplier""")
def list_ofac(spark, sf_dir):
    s, text = table(spark, sf_dir, "supplier"), lambda c: F.col(c).cast("string")
    k, turn = text("s_suppkey"), F.col("s_suppkey")
    rows = s.select(F.concat(
        F.lit("<sdnEntry><uid>"), k, F.lit("</uid><firstName> First </firstName><lastName>"), F.col("s_name"), F.lit("</lastName><sdnType>"), F.when(turn % 2 == 0, "Individual").otherwise("Entity"), F.lit("</sdnType><programList><program>SDGT</program></programList><akaList><aka><type>"),
        F.when(turn % 3 == 0, "f.k.a.").otherwise("a.k.a."), F.lit("</type><category>"), F.when(turn % 3 == 0, "weak").otherwise("strong"), F.lit("</category><lastName>Other "), k, F.lit("</lastName></aka></akaList><idList><id><idType>Passport</idType><idNumber>P"), k,
        F.lit("</idNumber></id><id><idType>Digital Currency Address - ETH</idType><idNumber>0xab"), k, F.lit("</idNumber></id></idList><dateOfBirthList><dateOfBirthItem><dateOfBirth>02 Mar 1970</dateOfBirth><mainEntry>true</mainEntry></dateOfBirthItem></dateOfBirthList><nationalityList><nationality><country>Nation "),
        text("s_nationkey"), F.lit("</country></nationality></nationalityList></sdnEntry>")).alias("value"))
    head = spark.createDataFrame([(f"<publshInformation><Record_Count>{s.count()}</Record_Count></publshInformation>",)], "value string")
    return _listed(sanctions.ofac(spark, _written(spark, head.unionByName(rows), "ofac", "sdnList")))


@_registered("""SELECT 'un' AS list, 'R' || s_suppkey AS ref_id, CASE WHEN s_suppkey % 2 = 0 THEN 'individual' ELSE 'entity' END AS kind, 'First ' || s_name || '|primary|true; Known ' || s_suppkey || '|also|' || CASE WHEN s_suppkey % 3 = 0 THEN 'false' ELSE 'true' END AS names,
  CASE WHEN s_suppkey % 2 = 0 THEN '1960|1965' ELSE '' END AS births, 'Nation ' || s_nationkey AS homes, CASE WHEN s_suppkey % 2 = 0 THEN 'passport|P' || s_suppkey ELSE '' END AS documents, 'Type ' || s_nationkey AS programs FROM supplier""")
def list_un(spark, sf_dir):
    s, text = table(spark, sf_dir, "supplier"), lambda c: F.col(c).cast("string")
    k, person = text("s_suppkey"), F.col("s_suppkey") % 2 == 0
    tag = F.when(person, "INDIVIDUAL").otherwise("ENTITY")
    rows = s.select(F.concat(
        F.lit("<"), tag, F.lit("><DATAID>"), k, F.lit("</DATAID><FIRST_NAME>First</FIRST_NAME><SECOND_NAME> "), F.col("s_name"), F.lit("</SECOND_NAME><UN_LIST_TYPE>Type "), text("s_nationkey"), F.lit("</UN_LIST_TYPE><REFERENCE_NUMBER>R"), k, F.lit("</REFERENCE_NUMBER><NATIONALITY><VALUE>Nation "), text("s_nationkey"),
        F.lit("</VALUE></NATIONALITY><"), tag, F.lit("_ALIAS><QUALITY>"), F.when(F.col("s_suppkey") % 3 == 0, "Low").otherwise("Good"), F.lit("</QUALITY><ALIAS_NAME>Known "), k, F.lit("</ALIAS_NAME></"), tag, F.lit("_ALIAS>"),
        F.when(person, F.concat(F.lit("<INDIVIDUAL_DATE_OF_BIRTH><TYPE_OF_DATE>BETWEEN</TYPE_OF_DATE><FROM_YEAR>1960</FROM_YEAR><TO_YEAR>1965</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH><INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>Passport</TYPE_OF_DOCUMENT><NUMBER>P"), k, F.lit("</NUMBER></INDIVIDUAL_DOCUMENT>"))).otherwise(""),
        F.lit("</"), tag, F.lit(">")).alias("value"))
    return _listed(sanctions.un(spark, _written(spark, rows, "un", "CONSOLIDATED_LIST")))


@_registered("""SELECT 'eu' AS list, 'EU.' || s_suppkey AS ref_id, CASE WHEN s_suppkey % 2 = 0 THEN 'individual' ELSE 'entity' END AS kind, s_name || '|primary|true; Given ' || s_suppkey || '|also|false' AS names, '1971-05-09|1971-05-09' AS births,
  'Nation ' || s_nationkey AS homes, 'passport|L' || s_suppkey AS documents, 'UKR' AS programs FROM supplier""")
def list_eu(spark, sf_dir):
    s, text = table(spark, sf_dir, "supplier"), lambda c: F.col(c).cast("string")
    k = text("s_suppkey")
    rows = s.select(F.concat(
        F.lit('<sanctionEntity euReferenceNumber="EU.'), k, F.lit('"><regulation programme="UKR"/><subjectType classificationCode="'), F.when(F.col("s_suppkey") % 2 == 0, "P").otherwise("E"), F.lit('"/><nameAlias wholeName="'), F.col("s_name"), F.lit('" strong="true"/><nameAlias firstName="Given" lastName="'), k,
        F.lit('" strong="false"/><birthdate year="1971" monthOfYear="5" dayOfMonth="9" calendarType="GREGORIAN"/><birthdate year="1350" calendarType="ISLAMIC"/><citizenship countryDescription="Nation '), text("s_nationkey"),
        F.lit('"/><identification latinNumber="L'), k, F.lit('" identificationTypeDescription="National passport"/></sanctionEntity>')).alias("value"))
    return _listed(sanctions.eu(spark, _written(spark, rows, "eu", "export")))


@_registered("""SELECT 'ofsi' AS list, CAST(s_suppkey AS VARCHAR) AS ref_id, CASE s_suppkey % 3 WHEN 0 THEN 'individual' WHEN 1 THEN 'vessel' ELSE 'entity' END AS kind, s_name || ' Last|primary|true; Low ' || s_suppkey || '|also|false' AS names,
  CASE WHEN s_suppkey % 2 = 0 THEN '1950-01|1950-01' ELSE '1950-01-07|1950-01-07' END AS births, 'Nation ' || s_nationkey AS homes, 'passport|P' || s_suppkey AS documents, 'Regime' AS programs FROM supplier""")
def list_ofsi(spark, sf_dir):
    """Two rows for each group, of which the second repeats the nationality in capitals; a preamble comes first."""
    s, text = table(spark, sf_dir, "supplier"), lambda c: F.col(c).cast("string")
    k = text("s_suppkey")
    group = F.when(F.col("s_suppkey") % 3 == 0, "Individual").when(F.col("s_suppkey") % 3 == 1, "Ship").otherwise("Entity")
    born = F.when(F.col("s_suppkey") % 2 == 0, "00/01/1950").otherwise("07/01/1950")
    first = s.select(F.col("s_suppkey").alias("g"), F.lit(0).alias("i"), F.concat_ws(",", F.lit("Last"), F.col("s_name"), F.lit("Primary name"), F.lit(""), born, F.concat(F.lit("Nation "), text("s_nationkey")), F.concat(F.lit("P"), k), group, k, F.lit("Regime")).alias("value"))
    again = s.select(F.col("s_suppkey").alias("g"), F.lit(1).alias("i"), F.concat_ws(",", k, F.lit("Low"), F.lit("AKA"), F.lit("Low quality"), F.lit(""), F.concat(F.lit("NATION "), text("s_nationkey")), F.lit(""), group, k, F.lit("Regime")).alias("value"))
    head = spark.createDataFrame([(-2, 0, "Last Updated,01/01/2024"), (-1, 0, "Name 6,Name 1,Alias Type,Alias Quality,DOB,Nationality,Passport Number,Group Type,Group ID,Regime")], "g long, i int, value string")
    rows = head.unionByName(first).unionByName(again).coalesce(1).sortWithinPartitions("g", "i").select("value")
    return _listed(sanctions.ofsi(spark, _written(spark, rows, "ofsi")))


# --- hashes ------------------------------------------------------------------------------------------------------------

_ROOT = b"0123456789abcdef0123456789abcdef"


def _hmac_sql(key: bytes, message: str) -> str:
    """HMAC-SHA256 of a blob, as hex."""
    pad = lambda x: bytes(b ^ x for b in key.ljust(64, b"\0")).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || {message})))"


_VAULT = crypto.Vault(ORG, _ROOT)
ORACLE["pseudonyms"] = f"SELECT c_custkey, 'name:' || left({_hmac_sql(_VAULT.key('pseudonym/name'), 'encode(lower(trim(c_name)))')}, 32) AS pseudonym, TRUE AS opens, TRUE AS bound FROM customer"


@_registered(f"SELECT c_custkey, {_hmac_sql(_VAULT.key('fingerprint'), f'''encode('{ORG}|customer') || unhex('00') || encode(c_name)''')} AS fingerprint FROM customer")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", _VAULT.fingerprint("customer", F.col("c_name").cast("binary")).alias("fingerprint"))


@_registered("SELECT event_id, sha256(json_object('a', event_type, 'k', CAST(json_extract(props, '$.k') AS BIGINT))) AS mark FROM events")
def json_marks(spark, sf_dir):
    """The same body with its keys in either order and any white space."""
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k":'), k, F.lit(', "a" : "'), F.col("event_type"), F.lit('"}'))).otherwise(F.concat(F.lit('{ "a":"'), F.col("event_type"), F.lit('",\n "k": '), k, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", crypto.mark(body).alias("mark"))


def _fnv(text: str, bits: int) -> str:
    basis, prime = ("14695981039346656037", "1099511628211") if bits == 64 else ("2166136261", "16777619")
    return f"list_reduce(list_prepend(CAST({basis} AS HUGEINT), list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda h, b: (xor(h, b) * {prime}) % CAST({1 << bits} AS HUGEINT))"


@_registered(f"SELECT CAST(event_id AS VARCHAR) AS tx_id, {_fnv('CAST(event_id AS VARCHAR)', 32)} % 1048576 < 0.05 * 1048576 AS sampled FROM events")
def below_line_sample(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", crypto.below_line(F.col("tx_id"), F.lit(0.05)).alias("sampled"))


@_registered(f"""WITH {TX_SQL}, s AS (SELECT tx_id, us FROM tx WHERE usd <= 30000 AND {_fnv("tx_id", 32)} % 1048576 < 0.2 * 1048576) SELECT tx_id FROM s QUALIFY row_number() OVER (ORDER BY us DESC, tx_id DESC) <= 256""")
def below_line_kept(spark, sf_dir):
    scored = transactions(spark, sf_dir).select("org_id", "tx_id", "us", (F.col("usd") > 30000).alias("alert"))
    return anomaly.below_line_kept(scored, 0.2).select("tx_id")


ORACLE["field_distinct"] = f"""WITH {TX_SQL}, cells AS (SELECT unnest(['tx_id', 'user', 'account', 'counterparty', 'device', 'currency', 'jurisdiction', 'symbol', 'usd', 'raw.k']) AS field, unnest([tx_id, "user", account, counterparty, device, currency, jurisdiction, symbol, CASE WHEN usd <> 0 THEN CAST(usd AS VARCHAR) END, substr(counterparty, 4)]) AS value FROM tx),
held AS (SELECT DISTINCT field, value FROM cells WHERE value <> ''), hashed AS (SELECT field, count(DISTINCT {_fnv(f"'{ORG}' || chr(0) || field || chr(0) || value", 64)} % 4096) AS b FROM held GROUP BY field)
SELECT field, CAST(round(-4096 * ln((4096 - b) / 4096)) AS BIGINT) AS "distinct", b >= 0.95 * 4096 AS saturated FROM hashed"""


# --- tables and catalogues ---------------------------------------------------------------------------------------------


@_registered("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'id' ELSE '' END AS errors FROM customer")
def ids_bounded(spark, sf_dir):
    """Identifiers of more than 256 bytes are told apart, with the column that is too long."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.repeat(F.lit("é"), 129)).otherwise(F.repeat(F.lit("e"), 256)).alias("id"), F.col("c_name").alias("name"))
    good, long = tables.bounded(c, ["id", "name"])
    return good.select("c_custkey", F.lit("").alias("errors")).unionByName(long.select("c_custkey", F.array_join("errors", ",").alias("errors")))


@_registered("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS load FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def appended_once(spark, sf_dir):
    """Rows of a second load whose keys are there already aren't added, nor is the first load run again."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey"), tables.workspace(spark, "append")
    first, second = o.where("o_orderkey % 2 = 0").withColumn("load", F.lit("first")), o.where("o_orderkey % 3 = 0").withColumn("load", F.lit("second"))
    for rows in (first, second, first):
        tables.append_once(spark, rows, path, ["o_orderkey"])
    return spark.read.parquet(path)


@_registered("SELECT 'a' AS source, s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'b', s_suppkey FROM supplier")
def source_replaced(spark, sf_dir):
    """Loading one source again replaces its entries and leaves the others'."""
    s, path = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), tables.workspace(spark, "sources")
    for rows, source in ((s, "a"), (s, "b"), (s.where("k % 2 = 1"), "a")):
        tables.replace_source(spark, rows, path, source)
    return spark.read.parquet(path).select("source", "k")


@_registered("""WITH l AS (SELECT 'NATION-' || o_custkey % 7 AS source, o_orderkey % 5 AS entries, CAST(o_orderdate AS TIMESTAMP) AS loaded FROM orders), x AS (SELECT source, max(loaded) AS loaded, arg_max(entries, loaded) AS entries FROM (SELECT source, loaded, max(entries) AS entries FROM l GROUP BY ALL) GROUP BY source),
w AS (SELECT 'NATION-' || r AS source FROM range(9) t(r)), a AS (SELECT source, entries, epoch(TIMESTAMP '1998-09-01') - epoch(loaded) AS age FROM w LEFT JOIN x USING (source))
SELECT source, round(age / 3600, 6) AS age_hours, coalesce(entries > 0 AND age / 3600 <= 2000, false) AS fit FROM a""")
def lists_ready(spark, sf_dir):
    """Seven lists with loads of their own and two without any."""
    o = table(spark, sf_dir, "orders")
    loads = o.groupBy(F.concat(F.lit("NATION-"), (F.col("o_custkey") % 7).cast("string")).alias("source"), F.col("o_orderdate").cast("timestamp").alias("loaded_at")).agg(F.max(F.col("o_orderkey") % 5).alias("entries")).withColumn("digest", F.lit("d"))
    state = tables.readiness(loads, [f"NATION-{i}" for i in range(9)], "1998-09-01 00:00:00", stale_hours=2000)
    return state.select("source", F.round("age_hours", 6).alias("age_hours"), "fit")


@_registered(f"""WITH {TX_SQL}, a AS (SELECT DISTINCT tx_id FROM tx WHERE usd >= 3000), r AS (SELECT tx_id, 'first' AS rule_id FROM tx WHERE usd >= 20000 UNION ALL SELECT tx_id, 'second' FROM tx WHERE usd >= 3000 AND usd < 20000) SELECT tx_id, rule_id FROM r""")
def alerts_kept(spark, sf_dir):
    """The first judgement of a transaction stands; a later one of the same transaction isn't added."""
    tx, path = transactions(spark, sf_dir), tables.workspace(spark, "alerts")
    for rule, least in (("first", 20000), ("second", 3000)):
        tables.judgements(spark, tx.where(F.col("usd") >= least).select("org_id", "tx_id", F.lit(rule).alias("rule_id")), path)
    return spark.read.parquet(path).select("tx_id", "rule_id")


def _changes(spark, sf_dir):
    """Orders as changes: of each customer's rows the first few make something and later ones end it."""
    o = table(spark, sf_dir, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    return o.select(F.lit(ORG).alias("org_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 200).cast("string")).alias("id"), at.alias("at_us"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("text"))


_CHANGES = "c AS (SELECT 's' || (o_custkey % 200) AS id, epoch_us(o_orderdate) + o_orderkey AS at_us, o_orderkey AS key, o_orderpriority AS text FROM orders)"


@_registered(f"""WITH {_CHANGES}, m AS (SELECT id, min(at_us) AS from_us, arg_min(text, at_us) AS rule FROM c WHERE key % 3 <> 0 GROUP BY id), l AS (SELECT id, min(at_us) AS lifted_us FROM c WHERE key % 3 = 0 GROUP BY id)
SELECT id, rule, from_us, lifted_us, from_us <= 800000000000000 AND (lifted_us IS NULL OR lifted_us > 800000000000000) AS held FROM m LEFT JOIN l USING (id)""")
def catalog_suppressions(spark, sf_dir):
    """What was suppressed first and lifted first, and what holds at an instant."""
    c = _changes(spark, sf_dir).withColumns({"op": F.when(F.col("key") % 3 == 0, "lift").otherwise("suppress"), "rule": F.col("text"), "kind": F.lit("user"), "value": F.col("id"), "from_us": F.col("at_us"), "until_us": F.lit(None).cast("long")})
    found = catalog.suppressions(c)
    return found.select("id", "rule", "from_us", "lifted_us", watch.in_force("from_us", "until_us", "lifted_us", F.lit(800000000000000)).alias("held"))


@_registered(f"""WITH {_CHANGES}, m AS (SELECT id, arg_min(key % 4, at_us) AS n FROM c WHERE key % 3 <> 0 AND key % 4 >= 1 GROUP BY id), r AS (SELECT id, min(at_us) AS retired_us FROM c WHERE key % 3 = 0 GROUP BY id)
SELECT id, CAST(n AS INT) AS "count", retired_us FROM m LEFT JOIN r USING (id) WHERE retired_us IS NULL OR retired_us >= 740000000000000""")
def catalog_rungs(spark, sf_dir):
    """Rungs that hold at an instant; one with a count of 0 was never declared."""
    c = _changes(spark, sf_dir).withColumns({"op": F.when(F.col("key") % 3 == 0, "retire").otherwise("declare"), "rule": F.col("text"), "kind": F.lit("user"), "count": (F.col("key") % 4).cast("int"), "within_us": F.lit(DAY), "to": F.lit("block")})
    return catalog.rungs_in_force(catalog.ladder(c), F.lit(740000000000000)).select("id", "count", "retired_us")


@_registered(f"""WITH {_CHANGES}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY at_us DESC) = 1) SELECT id AS value, key % 3 = 0 AS removed, key FROM l""")
def catalog_entries(spark, sf_dir):
    """The last change of each value decides."""
    c = _changes(spark, sf_dir).select("org_id", F.when(F.col("key") % 3 == 0, "remove").otherwise("add").alias("op"), F.lit("deny").alias("list"), F.lit("account").alias("class"), F.col("id").alias("value"), F.lit(False).alias("range"), F.lit(None).cast("timestamp").alias("until"), F.col("at_us").alias("at"), "key")
    return catalog.entries(c).select("value", "removed", "key")


@_registered(f"""WITH {_CHANGES}, e AS (SELECT id, min(at_us) AS opened_us, max(at_us) AS updated_us, count(*) AS events, arg_max(text, at_us) FILTER (key % 4 = 0) AS status, arg_max(text, at_us) FILTER (key % 4 = 1) AS assignee, arg_max(text, at_us) FILTER (key % 40 = 2) AS resolution FROM c GROUP BY id)
SELECT id AS case_id, opened_us, updated_us, events, CASE WHEN resolution IS NOT NULL THEN 'closed' ELSE coalesce(status, 'open') END AS status, assignee, resolution FROM e""")
def catalog_cases(spark, sf_dir):
    k = F.col("key")
    e = _changes(spark, sf_dir).select("org_id", F.col("id").alias("case_id"), F.when(k % 4 == 0, "status_change").when(k % 4 == 1, "assign").when(k % 40 == 2, "resolve").otherwise("note").alias("kind"), F.col("text").alias("body"), "at_us")
    return catalog.cases(e).select("case_id", "opened_us", "updated_us", "events", "status", "assignee", "resolution")


@_registered(f"""WITH {_CHANGES}, f AS (SELECT id, min(at_us) AS made, arg_min(text, at_us) AS digest FROM c WHERE key % 3 <> 0 GROUP BY id), a AS (SELECT c.id, at_us, digest, made, min(at_us) FILTER (at_us >= made) OVER (PARTITION BY c.id) AS first FROM c LEFT JOIN f ON f.id = c.id WHERE key % 3 = 0)
SELECT id, at_us, CASE WHEN made IS NULL OR first IS NULL THEN 'no such fit' WHEN at_us <> first THEN 'adopted before' WHEN digest <> '1-URGENT' THEN 'another shape' END AS refused FROM a""")
def models_adopted(spark, sf_dir):
    """Which wishes to adopt a fitted model are refused, and why."""
    c = _changes(spark, sf_dir).withColumns({"op": F.when(F.col("key") % 3 == 0, "adopt").otherwise("fit"), "who": F.lit("ann"), "why": F.lit("better"), "digest": F.col("text"), "state": F.lit("{}")})
    return catalog.adoptions(c, "1-URGENT").select("id", "at_us", "refused")


# --- judgements --------------------------------------------------------------------------------------------------------


@_registered(f"""WITH {TX_SQL}, j AS (SELECT tx_id, usd, event_id % 5 AS k FROM tx), s AS (SELECT *, CASE WHEN usd >= 20000 THEN 0.3 ELSE 0 END AS own, CASE k WHEN 0 THEN 0.2 WHEN 4 THEN 0.5 ELSE 0 END AS said FROM j)
SELECT tx_id, CAST((own > 0)::INT + (said > 0)::INT AS BIGINT) AS n_hits, CAST(round(least(1, own * 1.5 + said), 6) AS DOUBLE) AS score, CASE WHEN own > 0 THEN 'report' WHEN said > 0 THEN 'review' ELSE 'allow' END AS action FROM s""")
def scorer_contained(spark, sf_dir):
    """A scorer that asks for blocks, and gives negative, missing or infinite weights at times."""
    tx = transactions(spark, sf_dir)
    decided = RuleSet([Rule("large", "USD() >= 20000", "high", 0.3, "report")]).evaluate(tx)
    k = F.col("tx_id").cast("long") % 5
    weight = F.when(k == 0, 0.2).when(k == 1, -1.0).when(k == 2, F.lit("NaN").cast("double")).when(k == 3, F.lit("Infinity").cast("double")).otherwise(0.5)
    said = tx.select("org_id", "tx_id", F.lit("model").alias("rule_id"), F.lit("medium").alias("severity"), weight.alias("weight"), F.lit("block").alias("action"))
    return with_scorer(decided, said).select("tx_id", F.size("hits").cast("long").alias("n_hits"), F.round("score", 6).alias("score"), "action")


@_registered(f"""WITH {OBS_SQL}, c AS (SELECT count(*) FILTER (score >= 0.4 AND productive) AS tp, count(*) FILTER (score >= 0.4 AND NOT productive) AS fp, count(*) FILTER (score < 0.4 AND productive) AS fn FROM obs),
b AS (SELECT round(avg(power(1 / (1 + exp(2.5 * score - 1.5)) - CASE WHEN productive THEN 1 ELSE 0 END, 2)), 6) AS brier FROM obs), s AS (SELECT score, sum(CASE WHEN productive THEN 1 ELSE 0 END) AS p, sum(CASE WHEN productive THEN 0 ELSE 1 END) AS n FROM obs GROUP BY score),
t AS (SELECT score, (sum(p) OVER () - sum(p) OVER w) * 20.0 + sum(n) OVER w AS cost, sum(p) OVER () * 20.0 AS nothing FROM s WINDOW w AS (ORDER BY score DESC)), m AS (SELECT * FROM t QUALIFY row_number() OVER (ORDER BY cost, score DESC) = 1)
SELECT brier, CAST(fn * 20.0 + fp AS DOUBLE) AS cost, CASE WHEN m.cost < nothing THEN score END AS best_threshold, CAST(least(m.cost, nothing) AS DOUBLE) AS best_cost, CAST(NULL AS VARCHAR) AS refused FROM c, b, m""")
def metrics_costed(spark, sf_dir):
    """Brier score of a logistic probability, cost, and the threshold of least cost."""
    logistic = evaluate.Calibration("platt", "s", a=2.5, b=-1.5).column(F.col("score"), "s")
    found = evaluate.metrics(observations(spark, sf_dir), 0.4, logistic, miss=20.0, alarm=1.0)
    return found.select("brier", "cost", "best_threshold", "best_cost", "refused")


@_registered(f"""WITH {OBS_SQL}, s AS (SELECT score, count(*) FILTER (productive) AS p, count(*) FILTER (NOT productive) AS n FROM obs GROUP BY score),
t AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an, row_number() OVER w - 1 AS i, count(*) OVER () - 1 AS last FROM s WINDOW w AS (ORDER BY score DESC)),
k AS (SELECT DISTINCT CAST(floor(j * last / 24) AS BIGINT) AS i FROM range(25) r(j), (SELECT max(last) AS last FROM t))
SELECT score, round(tp / ap, 6) AS tpr, round(fp / an, 6) AS fpr FROM t JOIN k USING (i)""")
def curve_thinned(spark, sf_dir):
    """25 points, evenly drawn from all of the operating curve."""
    return evaluate.curve(evaluate.judged(observations(spark, sf_dir)), points=25).select("score", "tpr", "fpr")


@_registered(f"""WITH {TX_SQL}, {"a AS (SELECT *, lag(us, 1) OVER w AS p1, lag(us, 2) OVER w AS p2, lag(us, 3) OVER w AS p3 FROM (SELECT *, substr(sha256('demo/acme' || chr(0) || tx_id || chr(0) || 'recordkeeping' || chr(0) || 'account' || chr(0) || account || chr(0)), 1, 32) AS id FROM tx WHERE usd >= 3000) WINDOW w AS (PARTITION BY account ORDER BY us, tx_id))"},
n AS (SELECT *, (coalesce(us - p1 <= {7 * DAY}, false))::INT + (coalesce(us - p2 <= {7 * DAY}, false))::INT + (coalesce(us - p3 <= {7 * DAY}, false))::INT AS n FROM a),
f AS (SELECT *, n >= 2 AS up, n = 1 AND us - p1 <= {DAY} AS fold FROM n), g AS (SELECT *, lag(id) OVER w AS before, lag(fold) OVER w AS folded FROM f WINDOW w AS (PARTITION BY account ORDER BY us, tx_id))
SELECT id, n + 1 AS streak, CASE WHEN up THEN 'r1' WHEN fold THEN 'r2' END AS rung, CASE WHEN up THEN 'block' WHEN fold THEN 'allow' ELSE 'review' END AS response, CASE WHEN fold AND NOT folded THEN before END AS duplicate_of, fold AS duplicate FROM g""")
def _ladder(spark, sf_dir):
    """Holds the SQL of watch_ladder."""


QUERIES.pop("_ladder")
ORACLE["watch_ladder"] = ORACLE.pop("_ladder")


@_registered(f"""WITH {TX_SQL}, a AS (SELECT tx_id, us, substr(sha256('demo/acme' || chr(0) || tx_id || chr(0) || 'recordkeeping' || chr(0) || 'account' || chr(0) || account || chr(0)), 1, 32) AS id FROM tx WHERE usd >= 3000),
s AS (SELECT us, id FROM a ORDER BY us, id LIMIT 1 OFFSET 9), p AS (SELECT a.* FROM a, s WHERE a.us > s.us OR (a.us = s.us AND a.id > s.id) ORDER BY a.us, a.id LIMIT 40) SELECT id, true AS cut, max(us) OVER () AS through FROM p""")
def feed_page(spark, sf_dir):
    """The second page of the feed: after the tenth activation, forty more."""
    from ledgerlight.plans.queries import _activations

    acts = _activations(spark, sf_dir)
    _, _, tenth = watch.feed_page(acts, limit=10)
    page, cut, through = watch.feed_page(acts, since=tenth, limit=40)
    return page.select("id", F.lit(cut).alias("cut"), F.lit(through[0]).alias("through"))


@_registered(f"""WITH {TX_SQL}, a AS (SELECT tx_id, CASE WHEN usd >= 20000 THEN 3 ELSE 2 END AS r FROM tx WHERE usd >= 3000) SELECT tx_id AS tx, CASE r WHEN 3 THEN 'report' ELSE 'review' END AS response FROM a""")
def watch_responses(spark, sf_dir):
    """The strongest response of a transaction with several activations."""
    rules = RuleSet([Rule("some", "USD() >= 3000", "low", 0.05, "review"), Rule("much", "USD() >= 20000", "low", 0.05, "report")])
    acts = watch.activations(rules.alerts(transactions(spark, sf_dir))).withColumn("response", F.col("action"))
    return watch.responses(acts).select("tx", "response")


@_registered("""WITH VELOCITY SELECT 1""")
def structuring_found(spark, sf_dir):
    """Windows of accounts with three amounts just below the threshold that reach it together."""
    seen = velocity.observe(transactions(spark, sf_dir), F.col("account"), "account")
    return velocity.structuring(seen, 3).select("account", "window", "near", F.round("near_sum", 4).alias("near_sum"))


@_registered("""WITH c AS (SELECT o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN ['ann', 'bob', 'cyd'][o_custkey % 3 + 1] END AS who FROM orders), w AS (SELECT number, row_number() OVER (ORDER BY number) - 1 AS n FROM c WHERE who IS NULL)
SELECT number, ['bob', 'cyd', 'ann'][n % 3 + 1] AS assignee FROM w UNION ALL SELECT number, who FROM c WHERE who IS NOT NULL""")
def cases_assigned(spark, sf_dir):
    """Cases without an analyst go to the least loaded one first, then in turn."""
    k = F.col("o_orderkey")
    who = F.element_at(F.array(*map(F.lit, ("ann", "bob", "cyd"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    cases = table(spark, sf_dir, "orders").select(F.lit(ORG).alias("org_id"), k.alias("number"), F.when(k % 3 == 0, who).alias("assignee"))
    return records.assign(cases, ["ann", "bob", "cyd"], {"ann": 5, "bob": 1, "cyd": 2}).select("number", "assignee")


@_registered("""WITH c AS (SELECT ['ann', 'bob', 'cyd'][o_custkey % 3 + 1] AS a, o_orderstatus FROM orders) SELECT x AS assignee, count(a) FILTER (o_orderstatus <> 'F') AS open FROM unnest(['ann', 'bob', 'cyd', 'dan']) t(x) LEFT JOIN c ON a = x GROUP BY x""")
def analysts_loaded(spark, sf_dir):
    who = F.element_at(F.array(*map(F.lit, ("ann", "bob", "cyd"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    cases = table(spark, sf_dir, "orders").select(who.alias("assignee"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))
    return records.least_loaded(cases, ["ann", "bob", "cyd", "dan"]).select("assignee", "open")


@_registered("""WITH r AS (SELECT o_orderkey, o_orderkey % 50 AS rel, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS s FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(coalesce(s, CASE WHEN rel % 2 = 0 THEN DATE '1999-01-01' END) AS VARCHAR) AS start FROM r""")
def relationships_closed(spark, sf_dir):
    """Half of the relationships end: the clocks of their records that had none begin."""
    closed = spark.range(0, 50, 2).select(F.lit(ORG).alias("org_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.lit("1999-01-01").cast("date").alias("ended"))
    return records.close_relationships(_retained(spark, sf_dir).drop("ended"), closed).select("id", F.col("start").cast("string").alias("start"))


@_registered("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN greatest(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 2500 END, 0), 3000 + o_orderkey % 2) WHEN o_orderkey % 4 = 0 THEN 2500 END::INT AS extended_days, CAST(0 AS BIGINT) AS overdue, CAST(0 AS BIGINT) AS orphans FROM orders""")
def retention_extended(spark, sf_dir):
    """Extensions, of which the longest with a reason counts, and the proof of a disposal."""
    r = _retained(spark, sf_dir)
    some = r.where("cast(id as long) % 3 = 0").select("org_id", "id", F.lit("inquiry").alias("reason"), F.explode(F.array(F.lit(100), 3000 + F.col("id").cast("long") % 2)).alias("days"))
    none = r.select("org_id", "id", F.lit(" ").alias("reason"), F.lit(9999).cast("long").alias("days"))
    longer = records.extend(r, some.unionByName(none))
    now = F.lit("2003-01-01").cast("date")
    index = r.select("org_id", F.col("id").alias("record_id"), F.explode("parties").alias("party"))
    kept, _, orphans = records.dispose(longer, index, now)
    rest = index.join(orphans.select("org_id", "record_id"), ["org_id", "record_id"], "left_anti")
    return longer.select("id", "extended_days").crossJoin(records.disposal_proof(kept, rest, now))  # one row is joined


@_registered(f"""WITH {TX_SQL}, d AS (SELECT tx_id, event_id, us, usd, usd >= 30000 AS alerted, CASE WHEN usd >= 30000 AND event_id % 3 <> 0 THEN CASE WHEN event_id % 3 = 1 THEN 'productive' ELSE 'unproductive' END ELSE '' END AS disposition FROM tx)
SELECT tx_id, CASE WHEN alerted THEN 'big' END AS alerted, disposition FROM d ORDER BY us DESC, tx_id DESC""")
def replay_history(spark, sf_dir):
    """All events with the rules that alerted on them, and how the latest assessment of their alert turned out."""
    tx = transactions(spark, sf_dir)
    big = tx.where("usd >= 30000")
    k = F.col("tx_id").cast("long") % 3
    alerts = big.select("org_id", "tx_id", F.col("tx_id").alias("alert_id"), F.lit("big").alias("rule_id"))
    said = big.where(k != 0).select("org_id", F.array("tx_id").alias("alert_ids"), (k == 1).alias("reported"), F.lit(2).alias("at_us"))
    before = big.where(k != 0).select("org_id", F.array("tx_id").alias("alert_ids"), (k != 1).alias("reported"), F.lit(1).alias("at_us"))
    return replay.history(tx, alerts, said.unionByName(before), events=None).select("tx_id", F.array_join("alerted", ",").alias("alerted"), "disposition")


@_registered(f"""WITH {TX_SQL}, r AS (SELECT tx_id, event_id % 4 AS k, TRY_CAST(substr(counterparty, 4) AS INT) AS n FROM tx) SELECT tx_id, coalesce(n / 100.0 >= 0.7, false) OR k < 2 AS high_risk, k = 1 AS blocked FROM r""")
def chain_risks(spark, sf_dir):
    """Addresses with a risk and a category; mixers are high whatever the risk, sanctioned ones are blocked."""
    tx = transactions(spark, sf_dir).withColumn("address", F.concat(F.lit(" 0xAB"), F.col("tx_id")))
    k, n = F.col("tx_id").cast("long") % 4, F.substring("counterparty", 4, 9).try_cast("int")
    risks = tx.select(F.lower("address").alias("address"), (n / 100.0).alias("risk"), F.when(k == 0, "mixer").when(k == 1, "sanctions").otherwise("exchange").alias("category"))
    return replay.chain_risk(tx, risks).select("tx_id", "high_risk", "blocked")


@_registered(f"""WITH {TX_SQL}, t AS (SELECT tx_id, "user", coalesce(n_name, jurisdiction) AS home FROM tx LEFT JOIN (SELECT 'u' || c_custkey AS "user", n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0) USING ("user"))
SELECT tx_id, CASE WHEN home IN ('NATION_3', 'FRANCE') THEN 'action' WHEN home IN ('NATION_4') THEN 'monitoring' ELSE '' END AS tier FROM t""")
def jurisdictions_from_env(spark, sf_dir):
    """Tiers by lists from the environment, of the customer's jurisdiction, or else the transaction's."""
    os.environ["LEDGERLIGHT_QUERY_JURISDICTIONS"] = json.dumps({"as_of": "2024-01-01T00:00:00Z", "action": ["nation_3", "France"], "monitoring": [" NATION_4 "]})
    held = reference.jurisdictions_from_env("LEDGERLIGHT_QUERY_JURISDICTIONS")
    homes = entities(spark, sf_dir).where("cast(substring(id, 2) as long) % 2 = 0").select(F.col("id").alias("user"), F.col("jurisdiction").alias("home"))
    tx = transactions(spark, sf_dir).join(homes, "user", "left")
    return tx.select("tx_id", reference.tier(reference.history_jurisdiction(F.col("home"), F.col("jurisdiction")), held["action"], held["monitoring"]).alias("tier"))


@_registered("SELECT 1")
def field_profile_streamed(spark, sf_dir):
    """The field profile put together from micro-batches, one of which is run twice."""
    from ledgerlight.plans.queries_records import _cells

    path = tables.workspace(spark, "profile")
    step = monitor.profile_on_batches(path, lambda df: df)
    cells = _cells(spark, sf_dir, zeros=True)
    for n in (0, 1, 2, 1):
        step(cells.where(F.coalesce(F.pmod(F.floor(F.col("us") / 1000), F.lit(3)), F.lit(0)) == n), n)
    found = monitor.published_profile(spark, path)
    return found.select("field", "seen", "filled", F.round("fill", 6).alias("fill"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "first_us", "last_us")


@_registered("SELECT 'demo/acme' AS org_id, CAST(sum(greatest(0, event_id % 300 - 256)) AS BIGINT) AS skipped FROM events")
def bag_skipped(spark, sf_dir):
    """Keys beyond the first 256 of a bag, which the profile leaves out and counts."""
    many = (F.col("event_id") % 300).cast("int")
    keys = F.concat(F.lit("{"), F.array_join(F.transform(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array()), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('":1'))), ","), F.lit("}"))
    return profile.skipped(table(spark, sf_dir, "events").select(F.lit(ORG).alias("org_id"), keys.alias("raw")), "raw")


def anomaly_fit(spark, sf_dir):
    """The state of a forest that has learned all events, restored and checked: nodes, and how much it has learned."""
    shape = anomaly.Shape(window=64)
    fitted = anomaly.fit(velocity.features(transactions(spark, sf_dir)), shape)
    state = F.get_json_object("state", "$.learned").cast("long")
    return fitted.select("org_id", (F.col("digest") == shape.digest()).alias("own"), state.alias("learned"))


QUERIES["anomaly_fit"] = anomaly_fit
ORACLE["anomaly_fit"] = f"SELECT '{ORG}' AS org_id, true AS own, count(*) AS learned FROM events"


#: Isotonic regression by its min-max form, knots at the blocks' means, and a line between neighbouring knots.
ORACLE["calibration_reliability"] = f"""WITH {OBS_SQL}, g AS (SELECT round(score, 5) AS s, CAST(count(*) AS DOUBLE) AS w, CAST(count(*) FILTER (productive) AS DOUBLE) AS p FROM obs GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY s) AS i, sum(w) OVER (ORDER BY s) AS cw, sum(p) OVER (ORDER BY s) AS cp FROM g),
m AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.p) / (b.cw - a.cw + a.w) AS mean FROM o a JOIN o b ON a.i <= b.i),
lo AS (SELECT o.i, m.j, min(m.mean) AS v FROM o JOIN m ON m.j <= o.i AND m.k >= o.i GROUP BY o.i, m.j), iso AS (SELECT i, max(v) AS v FROM lo GROUP BY i),
knots AS (SELECT round(sum(w * s) / sum(w), 6) AS x, round(sum(p) / sum(w), 6) AS y FROM iso JOIN o USING (i) GROUP BY v), line AS (SELECT x, y, lag(x) OVER (ORDER BY x) AS x0, lag(y) OVER (ORDER BY x) AS y0 FROM knots),
fitted AS (SELECT score, productive, CASE WHEN x IS NULL THEN (SELECT arg_max(y, x) FROM knots) WHEN x0 IS NULL THEN y ELSE y0 + (score - x0) / (x - x0) * (y - y0) END AS f FROM obs ASOF LEFT JOIN line ON obs.score <= line.x),
b AS (SELECT least(CAST(floor(f * 10) AS INT), 9) AS bin, count(*) AS n, round(avg(f), 6) AS predicted, round(avg(CASE WHEN productive THEN 1.0 ELSE 0 END), 6) AS observed FROM fitted GROUP BY 1)
SELECT CAST(r AS INT) AS bin, coalesce(n, 0) AS "rows", predicted, observed FROM range(10) t(r) LEFT JOIN b ON b.bin = r"""


@_registered(f"""WITH {TX_SQL}, c AS (SELECT *, event_id % 3 AS k FROM tx WHERE usd > 20000), e AS (SELECT unnest(['amount', 'count', 'burst'][1:k + 1]) AS feature, unnest([0.5, 0.3, 0.2][1:k + 1]) AS share FROM c)
SELECT feature, count(*) AS alerts, round(avg(share), 6) AS share FROM e GROUP BY feature""")
def anomaly_contributions(spark, sf_dir):
    """The alerts that each feature took part in, and its mean share."""
    return replay.contributions(_alerted(spark, sf_dir)).select("feature", "alerts", "share")


@_registered(f"""WITH {TX_SQL}, c AS (SELECT *, event_id % 3 AS k FROM tx WHERE usd > 20000), e AS (SELECT tx_id, unnest(range(1, k + 2)) AS rank, unnest(['amount.above', 'count.above', 'burst.above'][1:k + 1]) AS code, unnest([0.5, 0.3, 0.2][1:k + 1]) AS share FROM c)
SELECT tx_id, CAST(rank AS INT) AS rank, code, CAST(share AS DOUBLE) AS share FROM e WHERE rank <= 2""")
def anomaly_reasons(spark, sf_dir):
    """The two leading causes of each alert, as codes."""
    return anomaly.reasons(_alerted(spark, sf_dir), top=2).select("tx_id", "rank", "code", "share")


def _alerted(spark, sf_dir):
    k = (F.col("tx_id").cast("long") % 3).cast("int")
    causes = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(s).alias("share"), F.lit(0.1).alias("without")) for f, s in (("amount", 0.5), ("count", 0.3), ("burst", 0.2))))
    return transactions(spark, sf_dir).select("org_id", "tx_id", (F.col("usd") > 20000).alias("alert"), F.slice(causes, F.lit(1), k + 1).alias("causes"))


@_registered(f"""WITH {TX_SQL}, f AS (SELECT event_id % 4 = 0 AS unusable, event_id % 4 = 1 AS warming, event_id % 4 > 1 AS warm, event_id % 8 = 3 AS alert, counterparty = 'cp-7' AS blind FROM tx)
SELECT count(*) FILTER (unusable) AS unusable, count(*) FILTER (warming) AS warming, count(*) FILTER (warm) AS scored, count(*) FILTER (alert) AS alerted, count(*) FILTER (blind) AS blind_counterparty FROM f""")
def anomaly_refusals(spark, sf_dir):
    """Events that weren't scored, by reason, and how often a feature had nothing to go by."""
    tx = transactions(spark, sf_dir)
    k = F.col("tx_id").cast("long")
    scored = tx.select(F.when(k % 4 != 0, 0.5).alias("score"), (k % 4 > 1).alias("warm"), (k % 8 == 3).alias("alert"))
    return replay.refusals(scored, tx.select((F.col("counterparty") == "cp-7").alias("blind_counterparty")), ["counterparty"])


@_registered("""WITH t AS (SELECT o_orderkey AS trial, round(o_totalprice / 1e6, 2) AS separation, o_custkey % 7 / 10.0 AS drift, o_orderkey % 5 AS nodes FROM orders WHERE o_orderstatus <> 'F')
SELECT trial, row_number() OVER (ORDER BY separation DESC, drift, nodes, trial) AS place FROM t""")
def trials_ranked(spark, sf_dir):
    """Trials in order of separation, drift and nodes; refused ones have no place."""
    o = table(spark, sf_dir, "orders")
    trials = o.select(F.col("o_orderkey").alias("trial"), (F.round(F.col("o_totalprice") / 1e6 * 100) / 100).alias("separation"), (F.col("o_custkey") % 7 / 10.0).alias("drift"), (F.col("o_orderkey") % 5).alias("nodes"), F.when(F.col("o_orderstatus") == "F", "warming").alias("refused"))
    return anomaly.placed(trials).select("trial", "place")


def _obligations_sql() -> str:
    """What each rule serves, spelled out, grouped in the order of the rules."""
    rows = ", ".join("(" + ", ".join([str(i), f"'{r.id}'", *("'" + x.replace("'", "''") + "'" for x in catalog.REQUIREMENTS[name])]) + ")" for i, (r, name) in enumerate((r, n) for r in LIBRARY for n in catalog.SERVES[r.id]))
    return f"""WITH s(i, rule, authority, document, locator) AS (VALUES {rows}), g AS (SELECT authority, document, locator, min(i) AS i, string_agg(rule, ',' ORDER BY i) AS rules FROM s GROUP BY ALL)
SELECT row_number() OVER (ORDER BY i) - 1 AS place, authority, document, locator, rules FROM g"""


@_registered(_obligations_sql())
def coverage_obligations(spark, sf_dir):
    return catalog.obligations(spark).select(F.col("place").cast("long").alias("place"), "authority", "document", "locator", F.array_join("rules", ",").alias("rules"))


@_registered(f"""WITH {TX_SQL}, c AS (SELECT tx_id, us, event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 24 ELSE 72 END * CAST(3600000000 AS BIGINT) AS sla FROM tx WHERE usd > 20000),
d AS (SELECT tx_id, us + sla <= 1706400000000000 AS breached, us < 1706400000000000 - CAST(2592000000000 AS BIGINT) AS stale FROM c WHERE event_id % 7 <> 0)
SELECT tx_id AS case_id, 'escalated' AS body, 'escalation: ' || CASE WHEN breached THEN 'deadline passed' ELSE 'left alone' END AS author FROM d WHERE breached OR stale""")
def cases_escalated(spark, sf_dir):
    """Open cases past their deadline, or left alone, are escalated."""
    now = F.lit(1706400000000000)
    k = F.col("tx_id").cast("long")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (k % 4 + 1).cast("int"))
    cases = transactions(spark, sf_dir).where("usd > 20000").select("org_id", F.col("tx_id").alias("case_id"), severity.alias("severity"), F.when(k % 7 == 0, "closed").otherwise("open").alias("status"), F.col("us").alias("opened_us"), F.col("us").alias("updated_us"))
    return catalog.escalate_stale(records.due(cases, now), now).select("case_id", "body", "author")


@_registered(f"""WITH r AS (SELECT round(least(n_chars, 5000) / 5000.0, 3) AS s, toxic, doc_id FROM documents LEFT JOIN labels USING (doc_id)), a AS (SELECT *, CASE WHEN s > 0.8 THEN 2 ELSE 0 END AS was, CASE WHEN s >= 0.9 THEN 4 WHEN s >= 0.6 THEN 2 WHEN s >= 0.3 THEN 1 ELSE 0 END AS would FROM r),
{OBS_SQL}, c AS (SELECT count(*) FILTER (score >= 0.3 AND productive) AS tp, count(*) FILTER (score >= 0.3 AND NOT productive) AS fp FROM obs)
SELECT count(*) AS rows, count(*) FILTER (was <> would) AS changed, count(*) FILTER (would > was) AS tightened, count(*) FILTER (would < was) AS loosened, round(count(*) FILTER (toxic IS NOT NULL AND doc_id % 5 = 0) / count(toxic), 6) AS explore, CAST(0.3 AS DOUBLE) AS at,
  any_value(round(tp / (tp + fp), 6)) AS precision, (SELECT round(avg(power(score - CASE WHEN productive THEN 1 ELSE 0 END, 2)), 6) FROM obs) AS brier FROM a, c""".replace(" AS at,", ' AS "at",').replace(" AS rows,", ' AS "rows",'))
def policy_reported(spark, sf_dir):
    """What a policy changes, and how it does where it begins to act."""
    obs = observations(spark, sf_dir).withColumns({"action": F.when(F.col("score") > 0.8, "review").otherwise("allow"), "source": F.when(F.col("id").cast("long") % 5 == 0, "sample").otherwise("alert")})
    flat = evaluate.Calibration("isotonic", "identity", ((0.0, 0.0), (1.0, 1.0)))
    found = evaluate.policy_report(obs, flat, evaluate.Policy(((0.3, "flag"), (0.6, "review"), (0.9, "block"))))
    return found.select("rows", "changed", "tightened", "loosened", "explore", "at", "precision", "brier")


@_registered(f"SELECT query_id, arg_max(ref_id, (score, -CAST(ref_id AS BIGINT))) AS ref_id, max(score) AS score FROM ({SCREEN_SQL}) GROUP BY query_id")
def screen_hits(spark, sf_dir):
    """The best match of each name."""
    q = _people(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "name", F.concat(F.lit("nation_"), (F.col("doc_id") % 2).cast("string")).alias("nationality"))
    listed = sanctions_entries(spark, sf_dir).withColumn("ref_id", F.lpad("ref_id", 9, "0"))
    return screening.hits(screening.screen(q, listed, octets=True)).select("query_id", F.col("ref_id").cast("long").cast("string").alias("ref_id"), F.round("score", 6).alias("score"))


# --- streams -----------------------------------------------------------------------------------------------------------


def _streamed(spark, sf_dir, twice: bool = False):
    """All transactions as a stream of one micro-batch for each file; the second file offers the first one's rows again."""
    path = tables.workspace(spark, "stream")
    tx = transactions(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(1 + twice):
        tx.coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def _drained(query) -> None:
    query.processAllAvailable()
    query.stop()


@_registered(f"WITH {TX_SQL} SELECT tx_id, usd FROM tx")
def stream_once(spark, sf_dir):
    """Every transaction once, though the stream has each twice."""
    path = tables.workspace(spark, "once")
    stream = monitor.once(_streamed(spark, sf_dir, twice=True), "60 days").select("tx_id", "usd")
    _drained(stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").start())
    return spark.read.parquet(f"{path}/out")


@_registered(f"""WITH {TX_SQL} SELECT t.tx_id, count(*) AS "count", round(sum(p.usd), 4) AS "sum", count(*) FILTER (p.usd >= 9000 AND p.usd < 10000) AS near, count(DISTINCT p.us // {DAY}) AS days
FROM tx t JOIN tx p ON p.account = t.account AND (p.us, p.tx_id) <= (t.us, t.tx_id) AND p.us // 900000000 > t.us // 900000000 - 96 GROUP BY t.tx_id""")
def stream_velocity(spark, sf_dir):
    """The stateful form of the day's sliding aggregates."""
    path = tables.workspace(spark, "velocity")
    stream = monitor.velocity(_streamed(spark, sf_dir).withWatermark("ts", "60 days"))
    _drained(stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").start())
    return spark.read.schema(monitor.OBSERVED).parquet(f"{path}/out").select("tx_id", "count", F.round("sum", 4).alias("sum"), "near", F.col("days").cast("long").alias("days"))


@_registered("SELECT 1")
def stream_rules(spark, sf_dir):
    """Structuring over a day, judged micro-batch by micro-batch on a stream that offers each transaction twice."""
    path = tables.workspace(spark, "rules")
    rules = RuleSet([Rule("structuring-day", 'Structured("user", "24h", 10000, 3)', "high", 0.35, "review")])
    _drained(monitor.run(spark, _streamed(spark, sf_dir, twice=True), rules, path, DAY, lateness="60 days"))
    return spark.read.parquet(f"{path}/alerts").select("tx_id", "rule_id", "severity", F.round("tx_score", 6).alias("score"), F.col("tx_action").alias("action"))
