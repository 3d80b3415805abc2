"""Receipts, retained records and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.dates import expiry

#: Why a record may be read, hours until a case must be handled, and days until it counts as left alone.
PURPOSES = ("monitoring", "investigation", "disclosure", "retention")
CLASSES = ("relationship", "transaction", "assessment", "refusal")
TRIGGERS = ("relationship_end", "occasional_transaction", "refusal")
SLA_HOURS = {"critical": 1, "high": 4, "medium": 24, "low": 72}
STALE_DAYS = 30
LOOKBACK_YEARS = 5


def settle(offers: DataFrame, receipts: DataFrame) -> DataFrame:
    """offers (org_id, ref, mark) with verdict: new, answered (with the answer that was given) or conflict.

    An offer with the mark that its reference had before is answered, another mark is a conflict. Of new offers with one
    reference the first by arrival counts, and those with its mark are answered by it.
    """
    kept = receipts.select("org_id", "ref", F.col("mark").alias("had"), "answer")
    first = Window.partitionBy("org_id", "ref").orderBy("arrived")
    out = offers.join(kept, ["org_id", "ref"], "left").withColumn("n", F.row_number().over(first)).withColumn("lead", F.first("mark").over(first))
    verdict = F.when(F.col("had").isNotNull(), F.when(F.col("had") == F.col("mark"), "answered").otherwise("conflict")).when(F.col("n") == 1, "new").when(F.col("lead") == F.col("mark"), "answered").otherwise("conflict")
    return out.withColumn("verdict", verdict).drop("n", "lead", "had")


def permitted(records: DataFrame, purpose: str) -> DataFrame:
    if purpose not in PURPOSES:
        raise ValueError(f"records aren't read for {purpose!r}")
    return records


def refused(records: DataFrame) -> DataFrame:
    """records with errors: what keeps each from being retained."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = {
        "org": blank("org_id"), "class": ~F.coalesce(F.col("class").isin(*CLASSES), F.lit(False)), "trigger": ~F.coalesce(F.col("trigger").isin(*TRIGGERS), F.lit(False)), "parties": F.coalesce(F.size("parties"), F.lit(0)) < 1,
        "ref": blank("ref"), "occurred": F.col("occurred").isNull(), "nature": (F.col("class") == "relationship") & blank("nature"), "reason": (F.col("class") == "refusal") & blank("reason"),
    }
    return records.withColumn("errors", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items()))))


def with_expiry(records: DataFrame) -> DataFrame:
    """records (class, start, occurred, extended_days) with expiry; without a start there is none."""
    return records.withColumn("expiry", expiry(F.col("class"), F.col("start"), F.col("occurred"), F.col("extended_days")))


def close_relationships(records: DataFrame, closed: DataFrame) -> DataFrame:
    """Starts the clock of records whose relationship has ended and that had none."""
    ends = closed.select("org_id", F.col("id").alias("relationship"), "ended")
    out = records.join(ends, ["org_id", "relationship"], "left")
    return out.withColumn("start", F.coalesce("start", "ended")).drop("ended")


def extend(records: DataFrame, extensions: DataFrame) -> DataFrame:
    """records with the longest extension that any of extensions (org_id, id, days, reason) gives; one without days or a reason gives none."""
    longer = extensions.where("days > 0 and trim(coalesce(reason, '')) != ''").groupBy("org_id", "id").agg(F.max("days").cast("int").alias("_days"))
    out = records.join(longer, ["org_id", "id"], "left")
    return out.withColumn("extended_days", F.greatest("extended_days", "_days")).drop("_days")


def disposal_proof(kept: DataFrame, index: DataFrame, now: Column) -> DataFrame:
    """One row that proves a disposal: records past their time that are still there, and index rows without a record. Both must be 0."""
    late = kept.where(F.col("expiry").isNotNull() & (F.col("expiry") <= now)).agg(F.count("*").alias("overdue"))
    lost = index.join(kept.select("org_id", F.col("id").alias("record_id")), ["org_id", "record_id"], "left_anti").agg(F.count("*").alias("orphans"))
    return late.crossJoin(lost)  # one row each


def live_receipts(receipts: DataFrame, now_us: Column, keep_us: int) -> DataFrame:
    """Receipts (answered_us) that still bind an offer; older ones may go."""
    return receipts.where(F.col("answered_us") > now_us - F.lit(keep_us))


def dispose(records: DataFrame, parties: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records that stay, those that go, and index rows left without a record."""
    dated = with_expiry(records)
    gone = dated.where(F.col("expiry").isNotNull() & (F.col("expiry") <= now))
    kept = dated.where(F.col("expiry").isNull() | (F.col("expiry") > now))
    return kept, gone, parties.join(kept.select("org_id", F.col("id").alias("record_id")), ["org_id", "record_id"], "left_anti")


def lookback(records: DataFrame, now: Column, years: int = LOOKBACK_YEARS) -> DataFrame:
    """For each party: whether a relationship was maintained in the last years, whether one still is, of which natures, and which were examined."""
    since = F.add_months(now, -12 * years)
    rel = records.where(F.col("class") == "relationship").select("org_id", "id", "nature", "occurred", "ended", F.explode("parties").alias("party"))
    inside = rel.where((F.col("occurred") <= now) & (F.col("ended").isNull() | (F.col("ended") >= since)))
    return inside.groupBy("org_id", "party").agg(F.lit(True).alias("maintained"), F.bool_or(F.col("ended").isNull() | (F.col("ended") > now)).alias("current"), F.array_sort(F.collect_set("nature")).alias("natures"), F.array_sort(F.collect_set("id")).alias("ids"), F.count("*").alias("examined"))


def open_cases(decisions: DataFrame) -> DataFrame:
    """A case for each blocked or reported transaction, numbered in time order within its organisation."""
    some = decisions.where(F.col("action").isin("block", "report"))
    n = F.row_number().over(Window.partitionBy("org_id").orderBy("us", "tx_id"))
    return some.select("org_id", n.alias("number"), "tx_id", "us", F.lit("critical").alias("severity"), F.lit("open").alias("status"))


def due(cases: DataFrame, now_us: Column) -> DataFrame:
    """cases (severity, status, opened_us, updated_us) with deadline_us, breached and stale; closed and escalated ones are neither."""
    hours = F.element_at(F.create_map(*(F.lit(x) for p in SLA_HOURS.items() for x in p)), F.col("severity"))
    alive = ~F.col("status").isin("closed", "escalated")
    deadline = F.col("opened_us") + hours * F.lit(3_600_000_000)
    out = cases.withColumn("deadline_us", deadline)
    return out.withColumns({"breached": alive & F.coalesce(now_us >= deadline, F.lit(False)), "stale": alive & (F.col("updated_us") < now_us - F.lit(STALE_DAYS * 86_400_000_000))})


def assign(cases: DataFrame, analysts: list[str], load: dict[str, int] | None = None) -> DataFrame:
    """Unassigned cases, in order, to analysts in turn, beginning with the least loaded one."""
    order = sorted(analysts, key=lambda a: ((load or {}).get(a, 0), analysts.index(a)))
    n = F.row_number().over(Window.partitionBy("org_id").orderBy("number")) - 1
    waiting = cases.where("assignee is null").withColumn("assignee", F.element_at(F.array(*map(F.lit, order)), (n % len(order) + 1).cast("int")))
    return waiting.unionByName(cases.where("assignee is not null"))


def least_loaded(cases: DataFrame, analysts: list[str]) -> DataFrame:
    """Open cases of each analyst, and who has the fewest; ties go to the first."""
    every = cases.sparkSession.createDataFrame([(a, i) for i, a in enumerate(analysts)], "assignee string, place int")
    held = cases.where("status != 'closed'").groupBy("assignee").agg(F.count("*").alias("open"))
    return every.join(held, "assignee", "left").withColumn("open", F.coalesce("open", F.lit(0))).orderBy("open", "place")


def report_drafts(cases: DataFrame, alerts: DataFrame, entities: DataFrame, tx: DataFrame) -> DataFrame:
    """A draft for each case: its alerts, the amount its transactions moved, an estimate by scores, and a narrative."""
    a = alerts.groupBy("org_id", "tx_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"), F.count("*").alias("alerts"), F.sum("weight").alias("weights"))
    t = tx.select("org_id", "tx_id", "user", "usd")
    e = entities.select("org_id", F.col("id").alias("user"), "name")
    out = cases.join(a, ["org_id", "tx_id"], "left").join(t, ["org_id", "tx_id"], "left").join(e, ["org_id", "user"], "left")
    who = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("user"))
    story = F.concat(F.lit("Subject "), who, F.lit(" moved "), F.format_number("usd", 2), F.lit(" USD. Rules: "), F.array_join("rules", ", "), F.lit("."))
    return out.select("org_id", "number", "tx_id", "user", "alerts", "rules", F.col("usd").alias("amount"), (F.col("weights") * 10000).alias("draft_amount_estimate"), story.alias("narrative"))


def dispositions(assessments: DataFrame) -> DataFrame:
    """Each alert's outcome, from the assessment of the case that holds it; the latest one wins."""
    each = assessments.select("org_id", F.explode("alert_ids").alias("alert_id"), "reported", "at_us")
    return each.groupBy("org_id", "alert_id").agg(F.max_by("reported", "at_us").alias("r")).select("org_id", "alert_id", F.when(F.col("r"), "productive").otherwise("unproductive").alias("disposition"))
