"""Governed catalogues: every change is a row, and what holds at an instant is a view of the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.plans.dsl import parse, walk
from ledgerlight.plans.library import ACTIONS, LIBRARY

#: Rows of a page, states of a case and how one ends.
PAGE = 500
STATES, RESOLUTIONS = ("open", "in_review", "escalated", "closed"), ("cleared", "sar_filed", "account_frozen", "false_positive")

SUPPRESSIONS = "id string, org_id string, rule string, kind string, value string, from_us long, until_us long, lifted_us long, who string, why string"
RUNGS = "id string, org_id string, rule string, kind string, count int, within_us long, to string, retired_us long, who string"


def suppressions(changes: DataFrame) -> DataFrame:
    """What was suppressed, with the instant of the first lift. changes: op (suppress or lift), id, at_us and the fields of a suppression."""
    made = changes.where("op = 'suppress'").groupBy("org_id", "id").agg(F.min_by(F.struct("rule", "kind", "value", "from_us", "until_us"), "at_us").alias("x")).select("org_id", "id", "x.*")
    lifted = changes.where("op = 'lift'").groupBy("org_id", "id").agg(F.min("at_us").alias("lifted_us"))
    return made.join(lifted, ["org_id", "id"], "left")


def ladder(changes: DataFrame) -> DataFrame:
    """Rungs with the instant of their retirement. changes: op (declare or retire), id, at_us and the fields of a rung. A rung has a count of one at least, a window, and an action or fold."""
    ok = (F.col("count") >= 1) & (F.col("within_us") > 0) & F.col("to").isin("fold", *ACTIONS)
    made = changes.where("op = 'declare'").where(ok).groupBy("org_id", "id").agg(F.min_by(F.struct("rule", "kind", "count", "within_us", "to"), "at_us").alias("x")).select("org_id", "id", "x.*")
    retired = changes.where("op = 'retire'").groupBy("org_id", "id").agg(F.min("at_us").alias("retired_us"))
    return made.join(retired, ["org_id", "id"], "left")


def rungs_in_force(rungs: DataFrame, at: Column) -> DataFrame:
    return rungs.where(F.col("retired_us").isNull() | (at <= F.col("retired_us")))


def entries(changes: DataFrame) -> DataFrame:
    """The entries of all lists: the last change of each value decides. changes: op (add or remove), list, class, value, range, until, at."""
    last = Window.partitionBy("org_id", "list", "value").orderBy(F.desc("at"))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").withColumn("removed", F.col("op") == "remove").drop("_n", "op")


def cases(events: DataFrame) -> DataFrame:
    """Cases as their events left them: status, assignee, resolution, opened and updated. events: org_id, case_id, kind, body, author, at_us."""
    e = events.groupBy("org_id", "case_id").agg(
        F.min("at_us").alias("opened_us"), F.max("at_us").alias("updated_us"), F.count("*").alias("events"),
        F.max_by(F.when(F.col("kind") == "status_change", F.col("body")), F.when(F.col("kind") == "status_change", F.col("at_us"))).alias("status"),
        F.max_by(F.when(F.col("kind") == "assign", F.col("body")), F.when(F.col("kind") == "assign", F.col("at_us"))).alias("assignee"),
        F.max_by(F.when(F.col("kind") == "resolve", F.col("body")), F.when(F.col("kind") == "resolve", F.col("at_us"))).alias("resolution"),
    )
    return e.withColumn("status", F.when(F.col("resolution").isNotNull(), "closed").otherwise(F.coalesce("status", F.lit("open"))))


def expired_cases(states: DataFrame, now_us: Column, keep_us: int) -> DataFrame:
    """Closed cases whose last change is older than the time they are kept."""
    return states.where((F.col("status") == "closed") & (F.col("updated_us") < now_us - F.lit(keep_us)))


def fits(changes: DataFrame) -> DataFrame:
    """Fitted states, each with its first adoption. changes: op (fit or adopt), org_id, id, at_us, who, why, digest, state.

    What counts as an adoption has a decider and is of a fit of the same organisation that was there before.
    """
    made = changes.where("op = 'fit' and trim(coalesce(who, '')) != ''").groupBy("org_id", "id").agg(F.min_by(F.struct("at_us", "who", "digest", "state"), "at_us").alias("x")).select("org_id", "id", "x.*")
    asked = changes.where("op = 'adopt' and trim(coalesce(who, '')) != ''").select("org_id", "id", F.struct(F.col("at_us").alias("adopted_us"), F.col("who").alias("adopted_by"), F.trim("why").alias("why")).alias("a"))
    first = asked.join(made.select("org_id", "id", F.col("at_us").alias("_made")), ["org_id", "id"]).where("a.adopted_us >= _made").groupBy("org_id", "id").agg(F.min("a").alias("a"))
    return made.join(first, ["org_id", "id"], "left").select("org_id", "id", "at_us", "who", "digest", "state", "a.adopted_us", "a.adopted_by", "a.why")


def adoptions(changes: DataFrame, digest: str) -> DataFrame:
    """Every wish to adopt with what kept it from being followed: no decider, no such fit, adopted before, or another shape than digest's."""
    made = fits(changes).select("org_id", "id", F.col("digest").alias("_digest"), F.col("adopted_us").alias("_first"), F.lit(True).alias("_there"))
    out = changes.where("op = 'adopt'").select("org_id", "id", "at_us", "who").join(made, ["org_id", "id"], "left")
    nth = F.row_number().over(Window.partitionBy("org_id", "id", F.col("at_us") == F.col("_first")).orderBy("who"))
    why = F.when(F.trim(F.coalesce("who", F.lit(""))) == "", "no decider").when(F.col("_there").isNull() | F.col("_first").isNull(), "no such fit").when((F.col("at_us") != F.col("_first")) | (nth > 1), "adopted before").when(F.col("_digest") != digest, "another shape")
    return out.withColumn("refused", why).select("org_id", "id", "at_us", "who", "refused")


def adopted(found: DataFrame) -> DataFrame:
    """Each organisation's most recently adopted fit: what its model is restored from. Ties go to the larger id."""
    return found.where("adopted_us is not null").groupBy("org_id").agg(F.max_by(F.struct("id", "digest", "state", "adopted_us"), F.struct("adopted_us", "id")).alias("x")).select("org_id", "x.*")


def page(df: DataFrame, order: list[str], limit: int = PAGE) -> tuple[DataFrame, bool]:
    """The first rows, and whether there are more."""
    rows = df.orderBy(*order).limit(min(limit, PAGE) + 1)
    return rows.limit(min(limit, PAGE)), rows.count() > min(limit, PAGE)


def coverage(spark, rules=LIBRARY) -> DataFrame:
    """Each rule with its typology, the terms it uses and the providers that these need."""
    needs = {"Screened": "screening", "Listed": "lists", "Tier": "jurisdictions", "USD": "rates", "Near": "rates"}
    rows = []
    for r in rules:
        calls = sorted({n.value for n in walk(parse(r.dsl)) if n.kind == "call"})
        rows.append((r.id, r.typology, r.severity, r.action, float(r.weight), calls, sorted({needs.get(c, "history") for c in calls if c[0].isupper()})))
    return spark.createDataFrame(rows, "rule string, typology string, severity string, action string, weight double, terms array<string>, providers array<string>")


#: Documents that requirements stand in.
_FATF = "FATF, International Standards on Combating Money Laundering and the Financing of Terrorism & Proliferation — The FATF Recommendations (2012-2026, updated June 2026)"
_AMLD = "Directive (EU) 2015/849 on the prevention of the use of the financial system for the purposes of money laundering or terrorist financing"
_UK = "The Money Laundering, Terrorist Financing and Transfer of Funds (Information on the Payer) Regulations 2017 (S.I. 2017/692)"
#: The requirements that the starter rules serve: authority, document, place.
REQUIREMENTS = {
    "aggregation": ("FinCEN", "31 CFR 1010.313", "§ 1010.313(b)"),
    "currency": ("FinCEN", "31 CFR 1010.311", "§ 1010.311"),
    "evasion": ("FinCEN", "31 U.S.C. 5324 — Structuring transactions to evade reporting requirement prohibited", "§ 5324(a)(1)-(3)"),
    "exposure": ("FATF", _FATF, "Recommendation 12, measures (a)-(d)"),
    "exposure (EU)": ("EU", _AMLD, "Article 20(b)(iii)"),
    "higher risk": ("FATF", _FATF, "Recommendation 19; INR.19 paragraphs 1-2"),
    "monitoring": ("FATF", _FATF, "Recommendation 10, measure (d)"),
    "monitoring (EU)": ("EU", _AMLD, "Article 13(1)(d)"),
    "monitoring (UK)": ("UK", _UK, "regulation 28(11)"),
    "monitoring (Wolfsberg)": ("Wolfsberg", "The Wolfsberg Group Statement on Effective Monitoring for Suspicious Activity — Part I: Moving Beyond Automated Transaction Monitoring", "Part I, whole statement"),
    "new technologies": ("FATF", _FATF, "Recommendation 15; INR.15 paragraph 7(a)-(b)"),
    "no purpose": ("FinCEN", "31 CFR 1020.320", "§ 1020.320(a)(2)(iii)"),
    "payment": ("FATF", _FATF, "Recommendation 16 (Payment transparency); INR.16 paragraph 8"),
    "programme": ("FinCEN", "31 CFR 1020.210", "§ 1020.210"),
    "risk-based approach": ("FATF", _FATF, "Recommendation 1"),
    "structuring": ("FinCEN", "31 CFR 1010.314", "§ 1010.314(a)-(c)"),
    "transfers (EU)": ("EU", "Regulation (EU) 2023/1113 on information accompanying transfers of funds and certain crypto-assets (recast)", "Article 14; recital 30"),
    "transmittal, kept": ("FinCEN", "31 CFR 1010.410", "§ 1010.410(e)(1)"),
    "transmittal, sent": ("FinCEN", "31 CFR 1010.410", "§ 1010.410(f)(1)"),
}
#: Which of them each starter rule serves.
SERVES = {
    "currency-day": ("currency", "aggregation"),
    "structuring-day": ("structuring", "evasion"),
    "structuring-week": ("structuring", "evasion"),
    "structuring-accounts": ("aggregation", "structuring"),
    "structuring-near-threshold": ("structuring",),
    "transmittal-recordkeeping": ("transmittal, sent", "transmittal, kept"),
    "transmittal-payment-transparency": ("payment",),
    "transmittal-crypto": ("transfers (EU)", "new technologies"),
    "sanctions-customer": ("programme", "risk-based approach"),
    "sanctions-counterparty": ("programme", "risk-based approach"),
    "exposure-political": ("exposure", "exposure (EU)"),
    "geography-countermeasures": ("higher risk",),
    "geography-monitoring": ("higher risk",),
    "layering-pass-through": ("no purpose", "monitoring"),
    "velocity-count": ("no purpose", "monitoring"),
    "behaviour-deviation": ("no purpose", "monitoring", "monitoring (EU)", "monitoring (UK)", "monitoring (Wolfsberg)"),
    "dormancy-reactivation": ("no purpose", "monitoring", "monitoring (EU)", "monitoring (UK)"),
    "concentration-counterparties": ("no purpose", "monitoring"),
    "concentration-device": ("no purpose", "monitoring (Wolfsberg)"),
    "round-amounts": ("no purpose",),
}


def typologies(rules=LIBRARY) -> list[str]:
    """The distinct typologies of rules, in their order."""
    return list(dict.fromkeys(r.typology for r in rules))


def obligations(spark, rules=LIBRARY) -> DataFrame:
    """The distinct requirements that rules serve, in their order (place), with the rules of each."""
    held: dict[tuple, list[str]] = {}
    for r in rules:
        for name in SERVES.get(r.id, ()):
            held.setdefault(REQUIREMENTS[name], []).append(r.id)
    return spark.createDataFrame([(i, *k, v) for i, (k, v) in enumerate(held.items())], "place int, authority string, document string, locator string, rules array<string>")


#: Requirements that nothing here meets: authority, document, place, why, and what it would take. The citations are fixed values.
GAPS = (
    ("FATF", _FATF, "Recommendation 20; INR.20 paragraph 3", "drafts are made, but no report is approved or sent, and attempts that never became transactions aren't seen", "a workflow of reports, and a feed of attempts"),
    ("FinCEN", "31 CFR 1020.320", "§ 1020.320(a)(2)", "an alert has a rule and a score, not one of the bases of suspicion", "a finding on each case, and its transactions added up against the threshold"),
    ("FinCEN", "31 CFR 1020.320", "§ 1020.320(b)(3)", "cases have deadlines by severity, not by the day of detection", "that day on the case, and a clock that begins with it"),
    ("FATF", _FATF, "Recommendation 21, (a)-(b)", "tables know no confidential columns", "a mark on cases, and readers told apart by role"),
    ("FATF", _FATF, "Recommendation 13, measures (a)-(e)", "a transaction has one customer, not the customer of a respondent bank", "relationships between institutions in the data"),
    ("FATF", _FATF, "Recommendation 10, measures (a)-(d)", "customers come as they are; nobody is identified here", "the part of a system for taking on customers"),
)


def gaps(spark) -> DataFrame:
    return spark.createDataFrame(list(GAPS), "authority string, document string, locator string, why string, needs string")


def declared(changes: DataFrame) -> DataFrame:
    """Lists that were declared, each as it was first: changes: op (declare), org_id, list, class, who, why, at. A list has a name, a class and a decider."""
    ok = changes.where("op = 'declare' and trim(coalesce(list, '')) != '' and trim(coalesce(class, '')) != '' and trim(coalesce(who, '')) != ''")
    return ok.groupBy("org_id", "list").agg(F.min_by(F.struct("class", "who", "why", "at"), "at").alias("x")).select("org_id", "list", "x.*")


def escalate_stale(found: DataFrame, now_us: Column) -> DataFrame:
    """The change of status that each breached or stale case gets: events for cases(). found: records.due() with org_id and case_id."""
    some = found.where("(breached or stale) and status in ('open', 'in_review')")
    why = F.when(F.col("breached"), "deadline passed").otherwise("left alone")
    return some.select("org_id", "case_id", F.lit("status_change").alias("kind"), F.lit("escalated").alias("body"), F.concat(F.lit("escalation: "), why).alias("author"), now_us.alias("at_us"))
