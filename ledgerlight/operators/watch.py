"""Activations: what an alert sets off, what silences it, and how repeats escalate or fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.plans.library import ACTIONS

FOLD = "fold"


def firing_id(org: Column, tx: Column, rule: Column, kind: Column, value: Column) -> Column:
    """The same firing always has the same id."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    parts = [x for c in (org, tx, rule, kind, value) for x in (F.coalesce(c, F.lit("")), nul)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def in_force(start: str, end: str, lifted: str, at: Column) -> Column:
    """A suppression counts from its start until its end, unless it was lifted before."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)) & (F.col(lifted).isNull() | (F.col(lifted) > at))


def covers(rule: Column, kind: Column, value: Column) -> Column:
    """A blank coordinate of a suppression (s_rule, s_kind, s_value) matches anything."""
    one = lambda mine, its: (F.coalesce(mine, F.lit("")) == "") | (mine == its)
    return one(F.col("s_rule"), rule) & one(F.col("s_kind"), kind) & one(F.col("s_value"), value)


def activations(alerts: DataFrame) -> DataFrame:
    """One activation for each alert: id, rule, subject (account, else user), action, tx and instant."""
    has = F.coalesce("account", F.lit("")) != ""
    kind, value = F.when(has, "account").otherwise("user"), F.when(has, F.col("account")).otherwise(F.col("user"))
    return alerts.select(firing_id(F.col("org_id"), F.col("tx_id"), F.col("rule_id"), kind, value).alias("id"), "org_id", F.col("rule_id").alias("rule"), kind.alias("kind"), value.alias("value"), F.col("tx_id").alias("tx"), "ts", "us", "action")


def suppress(acts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """acts with suppressed and by (the narrowest suppression in force; then the newest, then the least id).

    suppressions: id, org_id, rule, kind, value, from_us, until_us, lifted_us. A blank coordinate would make the join a
    comparison of all pairs. Instead each of the eight patterns of named coordinates is an equi-join of its own.
    """
    s = suppressions.select(F.col("id").alias("s_id"), F.col("org_id").alias("s_org"), *(F.coalesce(c, F.lit("")).alias("s_" + c) for c in ("rule", "kind", "value")), "from_us", "until_us", "lifted_us")
    reach = sum((F.col("s_" + c) != "").cast("int") for c in ("rule", "kind", "value"))
    s = s.withColumn("reach", reach)
    found = None
    for pattern in range(8):
        named = [c for i, c in enumerate(("rule", "kind", "value")) if pattern >> i & 1]
        some = s
        for i, c in enumerate(("rule", "kind", "value")):
            some = some.where((F.col("s_" + c) != "") == bool(pattern >> i & 1))
        on = F.col("org_id") == F.col("s_org")
        for c in named:
            on = on & (F.col(c) == F.col("s_" + c))
        hit = acts.join(some, on).where(in_force("from_us", "until_us", "lifted_us", F.col("us"))).select("id", F.struct("reach", "from_us", F.col("s_id").alias("s")).alias("hit"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("id").agg(F.max("hit.reach").alias("reach"), F.max_by("hit", F.struct("hit.reach", "hit.from_us")).alias("top"), F.collect_list("hit").alias("hits"))
    least = F.array_min(F.transform(F.filter("hits", lambda h: (h["reach"] == F.col("top.reach")) & (h["from_us"] == F.col("top.from_us"))), lambda h: h["s"]))
    best = best.select("id", least.alias("by_suppression"))
    return acts.join(best, "id", "left").withColumn("silenced", F.col("by_suppression").isNotNull())


def ladder(acts: DataFrame, rungs: DataFrame) -> DataFrame:
    """acts (with silenced) with streak, rung, response and duplicate_of.

    rungs: id, org_id, rule, kind, count, within_us, to (an action, or fold), retired_us. Of the rungs in force that the
    streak satisfies, the one with the highest count that raises the action wins; failing that, the first satisfied fold
    makes the activation a duplicate of the newest live one within the rung's window. A silenced one is left alone.
    Each subject's activations are folded in time order, one subject at a time, holding those of the widest window.
    """
    named = [tuple(r) for r in rungs.select("id", "org_id", "rule", "kind", "count", "within_us", "to", "retired_us").orderBy(F.desc("count"), "id").collect()]  # the ladder is a small configured table
    rank = dict(ACTIONS)

    def climb(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.sort_values(["us", "tx"], kind="stable")
            first = pdf.iloc[0]
            mine = [r for r in named if (r[1], r[2], r[3]) == (first["org_id"], first["rule"], first["kind"])]
            before: list[tuple[int, str, bool]] = []
            out = []
            for a in pdf.itertuples(index=False):
                live = [r for r in mine if r[7] is None or pd.isna(r[7]) or a.us <= r[7]]
                streak, rung, response, by, folded = 0, None, a.action, None, False
                if a.silenced:
                    response = "allow"
                elif live:
                    widest, deepest = max(r[5] for r in live), max(r[4] for r in live)
                    prior = [p for p in before if a.us - p[0] <= widest][-deepest:]
                    streak = len(prior) + 1
                    count = lambda w: sum(a.us - p[0] <= w for p in prior) + 1
                    up = [r for r in live if r[6] != FOLD and r[4] <= streak and count(r[5]) >= r[4]]
                    if up and rank[up[0][6]] > rank[response]:
                        response, rung = up[0][6], up[0][0]
                    else:
                        down = [r for r in live if r[6] == FOLD and r[4] <= streak and count(r[5]) >= r[4]]
                        if down:
                            rung, response, folded = down[0][0], "allow", True
                            by = next((p[1] for p in reversed(prior) if not p[2] and a.us - p[0] <= down[0][5]), None)
                before.append((a.us, a.id, bool(a.silenced) or folded))
                if mine and len(before) > 4096:
                    keep = max(r[5] for r in mine)
                    before = [p for p in before if a.us - p[0] <= keep]
                out.append((a.id, streak, rung, response, by, folded))
            yield pd.DataFrame(out, columns=["id", "streak", "rung", "response", "duplicate_of", "duplicate"])

    folded = acts.groupBy("org_id", "rule", "kind", "value").applyInPandas(lambda pdf: next(climb(iter([pdf]))), "id string, streak int, rung string, response string, duplicate_of string, duplicate boolean")
    return acts.join(folded, "id")


def streaks(acts: DataFrame, within_us: int) -> DataFrame:
    """acts with streak: activations of the same rule and subject in the window that ends with this one. Ties count by tx."""
    by = ["org_id", "rule", "kind", "value"]
    w = Window.partitionBy(*by).orderBy("us").rangeBetween(-within_us, -1)
    peers = Window.partitionBy(*by, "us").orderBy("tx")
    return acts.withColumn("streak", F.count(F.lit(1)).over(w) + F.row_number().over(peers))


def rates(acts: DataFrame, since_us: int | None = None) -> DataFrame:
    """Per rule: fired, live, silenced, folded, elevated, blocked, last and distinct subjects; most fired first."""
    rows = acts if since_us is None else acts.where(F.col("us") >= since_us)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in acts.columns else F.lit(False)
    response = F.col("response") if "response" in acts.columns else F.col("action")
    quiet = flag("silenced") | flag("duplicate")
    raised = (F.col("rung").isNotNull() & ~flag("duplicate")) if "rung" in acts.columns else F.lit(False)
    return rows.groupBy("rule").agg(
        F.count("*").alias("fired"), F.count_if(~quiet).alias("live"), F.count_if(flag("silenced")).alias("silenced"), F.count_if(flag("duplicate")).alias("folded"),
        F.count_if(raised).alias("elevated"), F.count_if(response == "block").alias("blocked"), F.max("us").alias("last_us"), F.countDistinct("kind", "value").alias("subjects"),
    ).orderBy(F.desc("fired"), "rule")


def feed(acts: DataFrame, since: tuple[int, str] | None = None, limit: int = 200, most: int = 5000) -> DataFrame:
    """The next page of activations after a cursor (instant and id), in order; a row more than limit says that there are others."""
    limit = min(max(1, limit), most)
    if since:
        acts = acts.where((F.col("us") > since[0]) | ((F.col("us") == since[0]) & (F.col("id") > since[1])))
    return acts.orderBy("us", "id").limit(limit + 1)


def feed_page(acts: DataFrame, since: tuple[int, str] | None = None, limit: int = 200, most: int = 5000) -> tuple[DataFrame, bool, tuple[int, str] | None]:
    """The next page, whether it was cut, and the cursor that it reaches to (the one given if it is empty)."""
    limit = min(max(1, limit), most)
    keys = [(r["us"], r["id"]) for r in feed(acts, since, limit, most).select("us", "id").collect()]  # a page
    page = feed(acts, since, limit, most).limit(limit)
    return page, len(keys) > limit, keys[:limit][-1] if keys else since


def responses(acts: DataFrame) -> DataFrame:
    """Each transaction's response: the strongest one of its activations."""
    rank = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return acts.groupBy("org_id", "tx").agg(F.max_by("response", F.element_at(rank, F.col("response"))).alias("response"))
