"""Registered queries of the monitoring engine and their SQL equivalents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ledgerlight.adapters import OBS_SQL, TX_SQL, entities, observations, order_history, table, transactions
from ledgerlight.operators import evaluate, lists, reference, velocity, watch
from ledgerlight.plans import queries_more, queries_records
from ledgerlight.plans.engine import Providers, RuleSet, with_entities
from ledgerlight.plans.library import LIBRARY, Rule

#: Rates and tiers of the queries.
RATES = {"EUR": 1.08, "KWD": 3.25}
ACTION, MONITORING = ["NATION_7"], ["NATION_11", "NATION_13"]

#: Rules whose library threshold the test tables never reach, with the threshold of the query.
TUNED = {
    "velocity-count": 'Count("user", "24h") > 8',
    "concentration-counterparties": 'Distinct("user", "counterparty", "24h") > 7',
    "dormancy-reactivation": 'Dormant("user", "730d") > 2 && USD() > 5000',
}

DAY, WEEK, MONTH = 86_400_000_000, 7 * 86_400_000_000, 30 * 86_400_000_000


def _frame(back: int, key: str = '"user"') -> str:
    return f"(PARTITION BY {key} ORDER BY us RANGE BETWEEN {back} PRECEDING AND CURRENT ROW)"


def _structured(back: int, least: int, key: str = '"user"') -> str:
    w = _frame(back, key)
    return f"(count(*) FILTER (usd > 0 AND usd < 10000) OVER {w} >= {least} AND coalesce(sum(usd) FILTER (usd > 0 AND usd < 10000) OVER {w}, 0) >= 10000)"


#: For each rule the condition that its SQL asks of the table tx.
CONDITIONS = {
    "currency-day": f'sum(usd) OVER (PARTITION BY "user", CAST(ts AS DATE) ORDER BY us RANGE UNBOUNDED PRECEDING) > 10000',
    "structuring-day": _structured(DAY, 3),
    "structuring-week": _structured(WEEK, 5),
    "structuring-accounts": f"count(DISTINCT account) OVER {_frame(DAY)} > 1 AND {_structured(DAY, 2)}",
    "structuring-near-threshold": "usd >= 9000 AND usd < 10000",
    "transmittal-recordkeeping": "usd >= 3000",
    "transmittal-payment-transparency": "usd > 1000 AND jurisdiction <> ''",
    "transmittal-crypto": "asset_class = 'crypto' AND counterparty <> ''",
    "geography-countermeasures": "jurisdiction = 'NATION_7'",
    "geography-monitoring": "jurisdiction IN ('NATION_11', 'NATION_13')",
    "layering-pass-through": "i >= 10000 AND o >= 10000 AND abs(i - o) / greatest(i, o) <= 0.05",
    "velocity-count": f"count(*) OVER {_frame(DAY)} > 8",
    "behaviour-deviation": f"(CASE WHEN count(*) OVER {_frame(3 * MONTH)} >= 10 AND mad(usd) OVER {_frame(3 * MONTH)} > 0 THEN 0.6745 * (usd - quantile_cont(usd, 0.5) OVER {_frame(3 * MONTH)}) / mad(usd) OVER {_frame(3 * MONTH)} ELSE 0 END) > 3.5",
    "dormancy-reactivation": f"coalesce(us - max(us) OVER (PARTITION BY \"user\" ORDER BY us RANGE BETWEEN {730 * DAY} PRECEDING AND 1 PRECEDING), 0) > 2 * {DAY} AND count(*) OVER (PARTITION BY \"user\", us) = 1 AND usd > 5000",
    "concentration-counterparties": f"count(DISTINCT counterparty) OVER {_frame(DAY)} > 7",
    "concentration-device": f"device <> '' AND count(DISTINCT \"user\") OVER {_frame(WEEK, 'device')} > 5",
    "round-amounts": f"count(*) OVER {_frame(MONTH)} >= 10 AND avg(CASE WHEN usd > 0 AND usd % 1000 = 0 THEN 1.0 ELSE 0 END) OVER {_frame(MONTH)} > 0.8",
}


def _providers(**more) -> Providers:
    return Providers(tiers=reference.tiers(ACTION, MONITORING), **more)


def _rule(rule: Rule, spark, sf_dir):
    found = RuleSet([rule], _providers()).alerts(transactions(spark, sf_dir))
    return found.select("tx_id", "rule_id", "severity", F.round("tx_score", 6).alias("score"), F.col("tx_action").alias("action"))


def _rule_sql(rule: Rule) -> str:
    times = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}[rule.severity]
    sums = f", sum(CASE WHEN direction = 'in' THEN usd ELSE 0 END) OVER {_frame(DAY)} AS i, sum(CASE WHEN direction = 'out' THEN usd ELSE 0 END) OVER {_frame(DAY)} AS o" if "layering" in rule.id else ""
    return f"""WITH {TX_SQL}, seen AS (SELECT *{sums} FROM tx), judged AS (SELECT tx_id, ({CONDITIONS[rule.id]}) AS hit FROM seen)
SELECT tx_id, '{rule.id}' AS rule_id, '{rule.severity}' AS severity, CAST({round(min(1.0, rule.weight * times), 6)} AS DOUBLE) AS score, '{rule.action}' AS action FROM judged WHERE hit"""


def _scored_rules() -> list[Rule]:
    return [Rule(**{**r.__dict__, "dsl": TUNED.get(r.id, r.dsl)}) for r in LIBRARY if r.id in CONDITIONS]


def rules_decisions(spark, sf_dir):
    """Every rule that needs no name screening, over all transactions, in one plan."""
    found = RuleSet(_scored_rules(), _providers()).evaluate(transactions(spark, sf_dir))
    return found.select("tx_id", F.size("hits").cast("long").alias("n_hits"), F.round("score", 6).alias("score"), "action")


def _decisions_sql() -> str:
    parts = [_rule_sql(r) for r in _scored_rules()]
    union = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    rank = "CASE action WHEN 'block' THEN 4 WHEN 'report' THEN 3 WHEN 'review' THEN 2 WHEN 'flag' THEN 1 ELSE 0 END"
    return f"""WITH hits AS ({union}), per AS (SELECT tx_id, count(*) AS n, sum(score) AS s, max({rank}) AS r FROM hits GROUP BY tx_id)
SELECT CAST(e.event_id AS VARCHAR) AS tx_id, coalesce(n, 0) AS n_hits, round(least(1.0, coalesce(s, 0)), 6) AS score,
       CASE coalesce(r, 0) WHEN 4 THEN 'block' WHEN 3 THEN 'report' WHEN 2 THEN 'review' WHEN 1 THEN 'flag' ELSE 'allow' END AS action
FROM events e LEFT JOIN per ON per.tx_id = CAST(e.event_id AS VARCHAR)"""


def history_terms(spark, sf_dir):
    """The additive terms over a week and a day, for every transaction."""
    from ledgerlight.plans.terms import History, lookback

    h = History()
    day, week = lookback("24h"), lookback("7d")
    cols = {"n": h.count("user", day), "s": h.sum("user", week), "m": h.max("user", week), "d": h.distinct("user", "counterparty", week), "e": h.seen("user", "symbol", F.lit("LOGIN"), week), "i": h.direction("user", "in", week), "gap": h.dormant("user", lookback("30d")), "r": h.round("user", week, 1000)}
    tx = transactions(spark, sf_dir).select("*", *(c.alias(n) for n, c in h.named.items()))
    return tx.select("tx_id", cols["n"].alias("n_day"), F.round(cols["s"], 4).alias("sum_week"), F.round(cols["m"], 4).alias("max_week"), cols["d"].cast("long").alias("counterparties"), cols["e"].alias("login_seen"), F.round(cols["i"], 4).alias("in_week"), F.round(cols["gap"], 6).alias("gap_days"), F.round(cols["r"], 6).alias("round_share"))


HISTORY_SQL = f"""WITH {TX_SQL} SELECT tx_id, count(*) OVER {_frame(DAY)} AS n_day, round(sum(usd) OVER {_frame(WEEK)}, 4) AS sum_week,
  round(greatest(0, max(usd) OVER {_frame(WEEK)}), 4) AS max_week, count(DISTINCT counterparty) OVER {_frame(WEEK)} AS counterparties,
  coalesce(bool_or(lower(symbol) = 'login') OVER {_frame(WEEK)}, false) AS login_seen,
  round(sum(CASE WHEN direction = 'in' THEN usd ELSE 0 END) OVER {_frame(WEEK)}, 4) AS in_week,
  round(CASE WHEN count(*) OVER (PARTITION BY "user", us) > 1 THEN 0 ELSE coalesce((us - max(us) OVER (PARTITION BY "user" ORDER BY us RANGE BETWEEN {MONTH} PRECEDING AND 1 PRECEDING)) / {DAY}.0, 0) END, 6) AS gap_days,
  round(avg(CASE WHEN usd > 0 AND usd % 1000 = 0 THEN 1.0 ELSE 0 END) OVER {_frame(WEEK)}, 6) AS round_share FROM tx"""


def dormancy_orders(spark, sf_dir):
    rule = Rule("dormancy-reactivation", 'Dormant("user", "730d") > 180 && USD() > 10000', "medium", 0.2, "review")
    return RuleSet([rule]).alerts(order_history(spark, sf_dir)).select("tx_id", "user")


DORMANCY_SQL = f"""SELECT tx_id, "user" FROM (SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, 'c' || o_custkey AS "user", o_totalprice AS usd, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS peers,
  epoch_us(o_orderdate) - max(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) RANGE BETWEEN {730 * DAY} PRECEDING AND 1 PRECEDING) AS gap FROM orders)
WHERE peers = 1 AND gap > CAST(180 AS BIGINT) * {DAY} AND usd > 10000"""


def fx_convert(spark, sf_dir):
    tx = transactions(spark, sf_dir).withColumnRenamed("usd", "notional")
    tx = tx.withColumn("currency", F.when(F.col("symbol") == "error", "XXX").otherwise(F.col("currency")))
    return reference.convert(tx, RATES).select("tx_id", F.round("usd", 4).alias("usd"), F.col("usd_error").isNotNull().alias("failed"))


FX_SQL = f"""WITH {TX_SQL} SELECT tx_id, CASE WHEN symbol = 'error' THEN NULL ELSE round(usd * CASE currency WHEN 'EUR' THEN 1.08 WHEN 'KWD' THEN 3.25 ELSE 1 END, 4) END AS usd, symbol = 'error' AS failed FROM tx"""


def jurisdiction_tiers(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.groupBy(reference.tier(F.col("jurisdiction"), ACTION, MONITORING).alias("tier")).agg(F.count("*").alias("n"))


TIER_SQL = f"""WITH {TX_SQL} SELECT CASE WHEN jurisdiction = 'NATION_7' THEN 'action' WHEN jurisdiction IN ('NATION_11', 'NATION_13') THEN 'monitoring' ELSE '' END AS tier, count(*) AS n FROM tx GROUP BY 1"""


def list_lookup(spark, sf_dir):
    entries = [("deny-net", "ip", "10.0.3.0/24", True, None, None), ("deny-net", "ip", "10.0.0.0/30", True, None, None), ("deny-host", "ip", "10.0.5.7", False, None, None), ("old", "ip", "10.0.6.0/24", True, True, None), ("wide", "ip", "10.0.4.64/26", True, None, None)]
    held = spark.createDataFrame(entries, "list string, class string, value string, range boolean, removed boolean, until timestamp")
    found = lists.listed(transactions(spark, sf_dir), "address", held, F.lit(None).cast("timestamp"))
    return found.select("tx_id", "address", F.array_join("lists", ",").alias("lists"))


LIST_SQL = f"""WITH {TX_SQL}, octets AS (SELECT tx_id, address, CAST(split_part(address, '.', 3) AS INT) AS c, CAST(split_part(address, '.', 4) AS INT) AS d FROM tx)
SELECT tx_id, address, concat_ws(',', CASE WHEN address = '10.0.5.7' THEN 'deny-host' END, CASE WHEN c = 3 OR (c = 0 AND d < 4) THEN 'deny-net' END, CASE WHEN c = 4 AND d BETWEEN 64 AND 127 THEN 'wide' END) AS lists FROM octets"""


def velocity_observe(spark, sf_dir):
    found = velocity.observe(transactions(spark, sf_dir), F.col("account"), "account")
    return found.select("account", "window", "count", F.round("sum", 4).alias("sum"), "near", F.round("near_sum", 4).alias("near_sum"), F.col("days").cast("long").alias("days"))


VELOCITY_SQL = f"""WITH {TX_SQL}, w(name, step, buckets) AS (VALUES ('1h', 60000000, 60), ('24h', 900000000, 96), ('7d', 3600000000, 168), ('30d', 21600000000, 120)),
b AS (SELECT account, name, buckets, us // step AS b, us // {DAY} AS d, usd FROM tx, w), l AS (SELECT *, max(b) OVER (PARTITION BY account, name) AS lead FROM b)
SELECT account, name AS "window", count(*) AS "count", round(sum(usd), 4) AS "sum", count(*) FILTER (usd >= 9000 AND usd < 10000) AS near,
  round(coalesce(sum(usd) FILTER (usd >= 9000 AND usd < 10000), 0), 4) AS near_sum, count(DISTINCT d) AS days FROM l WHERE b > lead - buckets GROUP BY account, name"""


def velocity_features(spark, sf_dir):
    found = velocity.features(transactions(spark, sf_dir))
    return found.select("tx_id", *(F.round("x_" + n, 6).alias("x_" + n) for n, _, _ in velocity.FEATURES))


def _to_date(key: str, names: dict[str, str], span: int, step: int) -> str:
    """Aggregates over the buckets of a window that ends with each row's own, up to its instant, in a table of their own."""
    return f"""(SELECT t.tx_id, {", ".join(f"{sql} AS {name}" for name, sql in names.items())} FROM tx t JOIN tx p ON {" AND ".join(f"p.{k} = t.{k}" for k in key.split(", "))}
  AND p.us <= t.us AND p.us // {step} > t.us // {step} - {span // step} GROUP BY t.tx_id)"""


NEAR = "p.usd >= 9000 AND p.usd < 10000"
FEATURES_SQL = f"""WITH {TX_SQL},
h AS {_to_date("account", {"hc": "count(*)"}, 3600000000, 60000000)},
d AS {_to_date("account", {"dc": "count(*)", "ds": "sum(p.usd)"}, DAY, 900000000)},
w AS {_to_date("account", {"wc": "count(*)", "ws": "sum(p.usd)", "wn": f"count(*) FILTER ({NEAR})", "wns": f"coalesce(sum(p.usd) FILTER ({NEAR}), 0)"}, WEEK, 3600000000)},
m AS {_to_date("account", {"mc": "count(*)", "ms": "sum(p.usd)", "md": f"count(DISTINCT p.us // {DAY})"}, MONTH, 21600000000)},
p AS {_to_date("account, counterparty", {"pc": "count(*)"}, MONTH, 21600000000)},
v AS {_to_date("device", {"vc": "count(*)"}, DAY, 900000000)},
s AS (SELECT * FROM tx JOIN h USING (tx_id) JOIN d USING (tx_id) JOIN w USING (tx_id) JOIN m USING (tx_id) JOIN p USING (tx_id) JOIN v USING (tx_id)),
k AS (SELECT *, CASE WHEN mc > 1 AND ms - usd > 0 THEN (ms - usd) / (mc - 1) ELSE 0 END AS per, CASE WHEN mc > 1 THEN (mc - 1) / md ELSE 0 END AS rate, CASE WHEN ms - usd > 0 THEN (ms - usd) / md ELSE 0 END AS flow FROM s)
SELECT tx_id, round(CASE WHEN per > 0 THEN (usd / per) / (1 + usd / per) ELSE 0.5 END, 6) AS x_amount, round(CASE WHEN rate > 0 THEN (dc / rate) / (1 + dc / rate) ELSE 0.5 END, 6) AS x_count,
  round(CASE WHEN flow > 0 THEN (ds / flow) / (1 + ds / flow) ELSE 0.5 END, 6) AS x_volume, round(CASE WHEN dc < 2 THEN 0 ELSE least(1, hc / dc) END, 6) AS x_burst,
  round(least(1, wn / wc), 6) AS x_subthreshold, round(CASE WHEN ws > 0 THEN least(1, wns / ws) ELSE 0 END, 6) AS x_subvalue, round(1 / pc, 6) AS x_counterparty,
  round((vc / dc) / (1 + vc / dc), 6) AS x_device, round(1 / mc, 6) AS x_novelty FROM k"""


def _activations(spark, sf_dir):
    rule = Rule("recordkeeping", "USD() >= 3000", "low", 0.05, "review")
    return watch.activations(RuleSet([rule]).alerts(transactions(spark, sf_dir)))


def watch_streaks(spark, sf_dir):
    return watch.streaks(_activations(spark, sf_dir), WEEK).select("id", "value", "streak")


STREAK_SQL = f"""WITH {TX_SQL}, a AS (SELECT * FROM tx WHERE usd >= 3000)
SELECT substr(sha256('demo/acme' || chr(0) || tx_id || chr(0) || 'recordkeeping' || chr(0) || 'account' || chr(0) || account || chr(0)), 1, 32) AS id, account AS value,
  count(*) OVER (PARTITION BY account ORDER BY us RANGE BETWEEN {WEEK} PRECEDING AND 1 PRECEDING) + row_number() OVER (PARTITION BY account, us ORDER BY tx_id) AS streak FROM a"""


def watch_suppressed(spark, sf_dir):
    s = [("s1", "demo/acme", "recordkeeping", "", "", 0, None, None), ("s2", "demo/acme", "recordkeeping", "account", "a10-0", 0, None, None), ("s3", "demo/acme", "", "account", "a20-1", 0, 1704844800000000, None), ("s4", "demo/acme", "", "account", "a20-1", 5, None, 1)]
    held = spark.createDataFrame(s, "id string, org_id string, rule string, kind string, value string, from_us long, until_us long, lifted_us long")
    found = watch.suppress(_activations(spark, sf_dir), held.where("id != 's1'"))
    return watch.rates(found.withColumn("rule", F.coalesce("by_suppression", F.lit("live")))).select("rule", "fired", "live", "silenced", "last_us", "subjects")


SUPPRESSED_SQL = f"""WITH {TX_SQL}, a AS (SELECT *, CASE WHEN account = 'a10-0' THEN 's2' WHEN account = 'a20-1' AND us < 1704844800000000 THEN 's3' ELSE 'live' END AS rule FROM tx WHERE usd >= 3000)
SELECT rule, count(*) AS fired, count(*) FILTER (rule = 'live') AS live, count(*) FILTER (rule <> 'live') AS silenced, max(us) AS last_us, count(DISTINCT account) AS subjects FROM a GROUP BY rule"""


def watch_ladder(spark, sf_dir):
    rungs = [("r1", "demo/acme", "recordkeeping", "account", 3, 7 * DAY, "block", None), ("r2", "demo/acme", "recordkeeping", "account", 2, DAY, "fold", None)]
    held = spark.createDataFrame(rungs, "id string, org_id string, rule string, kind string, count int, within_us long, to string, retired_us long")
    found = watch.ladder(_activations(spark, sf_dir).withColumn("silenced", F.lit(False)), held)
    return found.select("id", "streak", "rung", "response", "duplicate_of", "duplicate")


def replay_compare(spark, sf_dir):
    """Structuring over a day against structuring over a week, on the same history in one pass."""
    rs = RuleSet([Rule("new", 'Structured("user", "7d", 10000, 5)'), Rule("old", 'Structured("user", "24h", 10000, 3)')])
    found = rs.evaluate(transactions(spark, sf_dir))
    return evaluate.compare(found.select(F.exists("hits", lambda h: h["rule_id"] == "new").alias("c"), F.exists("hits", lambda h: h["rule_id"] == "old").alias("i")), "c", "i")


REPLAY_SQL = f"""WITH {TX_SQL}, j AS (SELECT {_structured(WEEK, 5)} AS c, {_structured(DAY, 3)} AS i FROM tx)
SELECT count(*) FILTER (c AND i) AS kept, count(*) FILTER (c AND NOT i) AS added, count(*) FILTER (NOT c AND i) AS dropped FROM j"""


def replay_outcome(spark, sf_dir):
    return evaluate.outcome(observations(spark, sf_dir).withColumn("fired", F.col("score") >= 0.4), "fired")


OUTCOME_SQL = """WITH o AS (SELECT round(least(n_chars, 5000) / 5000.0, 3) >= 0.4 AS f, toxic FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (f) AS alerts, count(*) FILTER (f AND toxic IS NOT NULL) AS judged, count(*) FILTER (f AND toxic = 1) AS productive, count(*) FILTER (f AND toxic = 0) AS unproductive, count(*) AS observed FROM o)
SELECT *, round(unproductive / judged, 6) AS false_positives, round(productive / judged, 6) AS intelligence_value FROM c"""


def metrics_bundle(spark, sf_dir):
    return evaluate.metrics(observations(spark, sf_dir), 0.4)


METRICS_SQL = f"""WITH {OBS_SQL}, c AS (SELECT CAST(count(*) FILTER (score >= 0.4 AND productive) AS DOUBLE) AS tp, CAST(count(*) FILTER (score >= 0.4 AND NOT productive) AS DOUBLE) AS fp, CAST(count(*) FILTER (score < 0.4 AND productive) AS DOUBLE) AS fn, CAST(count(*) FILTER (score < 0.4 AND NOT productive) AS DOUBLE) AS tn FROM obs),
r AS (SELECT productive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM obs),
auc AS (SELECT round((sum(r) FILTER (productive) - count(*) FILTER (productive) * (count(*) FILTER (productive) + 1) / 2) / (count(*) FILTER (productive) * count(*) FILTER (NOT productive)), 6) AS auc FROM r),
s AS (SELECT score, count(*) FILTER (productive) AS p, count(*) AS n FROM obs GROUP BY score), t AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, sum(p) OVER () AS pp FROM s),
ap AS (SELECT round(sum(p / pp * tp / k), 6) AS ap FROM t)
SELECT tp, fp, fn, tn, round((tp + fn) / (tp + fp + fn + tn), 6) AS prevalence, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round((tp + fp) / (tp + fp + fn + tn), 6) AS alarm_rate, round((tp / (tp + fp)) / ((tp + fn) / (tp + fp + fn + tn)), 6) AS lift, auc, ap FROM c, auc, ap"""


def operating_curve(spark, sf_dir):
    return evaluate.curve(evaluate.judged(observations(spark, sf_dir)), miss=50.0, alarm=1.0, points=1 << 30)


CURVE_SQL = f"""WITH {OBS_SQL}, s AS (SELECT score, count(*) FILTER (productive) AS p, count(*) FILTER (NOT productive) AS n FROM obs GROUP BY score),
t AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM s WINDOW w AS (ORDER BY score DESC))
SELECT score, round(tp / ap, 6) AS tpr, round(fp / an, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, CAST((ap - tp) * 50.0 + fp AS DOUBLE) AS cost FROM t"""


def calibration_reliability(spark, sf_dir):
    obs = observations(spark, sf_dir)
    fitted = evaluate.calibrate(obs, "isotonic", "shape")
    return evaluate.reliability(evaluate.judged(obs), fitted.column(F.col("score"), "shape"))


def score_reliability(spark, sf_dir):
    return evaluate.reliability(evaluate.judged(observations(spark, sf_dir)), F.col("score"))


RELIABILITY_SQL = f"""WITH {OBS_SQL}, b AS (SELECT least(CAST(floor(score * 10) AS INT), 9) AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(CASE WHEN productive THEN 1.0 ELSE 0 END), 6) AS observed FROM obs GROUP BY 1)
SELECT CAST(r AS INT) AS bin, coalesce(n, 0) AS "rows", predicted, observed FROM range(10) t(r) LEFT JOIN b ON b.bin = r"""


def policy_replay(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("action", F.when(F.col("score") > 0.8, "review").otherwise("allow"))
    flat = evaluate.Calibration("isotonic", "identity", ((0.0, 0.0), (1.0, 1.0)))
    policy = evaluate.Policy(((0.3, "flag"), (0.6, "review"), (0.9, "block")))
    return evaluate.tally(evaluate.replay_policy(obs, flat, policy))


POLICY_SQL = """WITH o AS (SELECT round(least(n_chars, 5000) / 5000.0, 3) AS s FROM documents), a AS (SELECT CASE WHEN s > 0.8 THEN 'review' ELSE 'allow' END AS was, CASE WHEN s >= 0.9 THEN 'block' WHEN s >= 0.6 THEN 'review' WHEN s >= 0.3 THEN 'flag' ELSE 'allow' END AS would FROM o),
u AS (SELECT was AS action, 1 AS w, 0 AS v FROM a UNION ALL SELECT would, 0, 1 FROM a) SELECT action, CAST(sum(w) AS BIGINT) AS was, CAST(sum(v) AS BIGINT) AS would FROM u GROUP BY action"""


def rules_with_entities(spark, sf_dir):
    """Rules that look at the customer behind the transaction."""
    rules = [Rule("risky-nation", 'Entity.jurisdiction in ["FRANCE", "CHINA", "NATION_1"] && USD() > 2000', "medium", 0.2, "review"), Rule("risk", 'Entity.risk_score > 0.9 ? USD() > 100 : USD() > 20000', "high", 0.3, "report"), Rule("pep", "Entity.pep && not (Tx.symbol contains \"log\")", "low", 0.1, "flag")]
    found = RuleSet(rules, Providers(entities=True)).evaluate(with_entities(transactions(spark, sf_dir), entities(spark, sf_dir)))
    return found.select("tx_id", F.array_join("hits.rule_id", ",").alias("rules"), F.round("score", 6).alias("score"), "action").where("rules != ''")


ENTITY_SQL = f"""WITH {TX_SQL}, e AS (SELECT 'u' || c_custkey AS id, n_name AS nation, greatest(0, least(1, (c_acctbal + 1000) / 11000)) AS risk, c_custkey % 97 = 0 AS pep FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT tx_id, coalesce(nation IN ('FRANCE', 'CHINA', 'NATION_1'), false) AND usd > 2000 AS a, CASE WHEN coalesce(risk, 0) > 0.9 THEN usd > 100 ELSE usd > 20000 END AS b, coalesce(pep, false) AND NOT contains(symbol, 'log') AS c FROM tx LEFT JOIN e ON e.id = tx."user")
SELECT tx_id, concat_ws(',', CASE WHEN a THEN 'risky-nation' END, CASE WHEN b THEN 'risk' END, CASE WHEN c THEN 'pep' END) AS rules, round(CASE WHEN a THEN 0.2 ELSE 0 END + CASE WHEN b THEN 0.45 ELSE 0 END + CASE WHEN c THEN 0.05 ELSE 0 END, 6) AS score,
  CASE WHEN b THEN 'report' WHEN a THEN 'review' ELSE 'flag' END AS action FROM h WHERE a OR b OR c"""


QUERIES: dict = {f"rule_{r.id.replace('-', '_')}": partial(_rule, r) for r in _scored_rules()}
ORACLE: dict[str, str] = {f"rule_{r.id.replace('-', '_')}": _rule_sql(r) for r in _scored_rules()}
for _query, _sql in (
    (rules_decisions, _decisions_sql()), (history_terms, HISTORY_SQL), (dormancy_orders, DORMANCY_SQL), (fx_convert, FX_SQL), (jurisdiction_tiers, TIER_SQL),
    (list_lookup, LIST_SQL), (velocity_observe, VELOCITY_SQL), (velocity_features, FEATURES_SQL), (watch_streaks, STREAK_SQL), (watch_suppressed, SUPPRESSED_SQL),
    (watch_ladder, None), (replay_compare, REPLAY_SQL), (replay_outcome, OUTCOME_SQL), (metrics_bundle, METRICS_SQL), (operating_curve, CURVE_SQL),
    (calibration_reliability, None), (score_reliability, RELIABILITY_SQL), (policy_replay, POLICY_SQL), (rules_with_entities, ENTITY_SQL),
):
    QUERIES[_query.__name__] = _query
    if _sql:
        ORACLE[_query.__name__] = _sql
QUERIES |= queries_records.QUERIES | queries_more.QUERIES
ORACLE |= queries_records.ORACLE | queries_more.ORACLE
ORACLE["structuring_found"] = f"""SELECT account, "window", near, near_sum FROM ({VELOCITY_SQL}) WHERE near >= 3 AND near_sum >= 10000"""
ORACLE["stream_rules"] = ORACLE["rule_structuring_day"]
ORACLE["field_profile_streamed"] = queries_records.PROFILE_SQL
