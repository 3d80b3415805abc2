"""Window terms over a subject's history, as columns.

A term names a subject kind and a lookback. The frame ends with the row itself and its peers, so a result is what was
known at the time of the event. Terms of the same subject and lookback share their frame, and those of the same subject
their shuffle and sort. Rows with a blank subject have no history: they are spread over partitions of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.plans.dsl import RuleError

SUBJECTS = ("user", "account", "counterparty", "device", "address")
#: Subjects that any number of users share, so that windows hold any number of events.
SHARED = ("counterparty", "device", "address")
DIMENSIONS = ("counterparty", "account", "device", "address", "jurisdiction", "currency", "symbol")
_UNITS = {"m": 60, "h": 3600, "d": 86400}
DAY_US = 86_400_000_000


def lookback(text: str) -> int:
    """Microseconds of a positive number of m, h or d."""
    m = re.fullmatch(r"([0-9]+)([mhd])", text)
    if not m or not int(m[1]):
        raise RuleError(f"bad window {text!r}")
    return int(m[1]) * _UNITS[m[2]] * 1_000_000


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


class History:
    """Columns of one history table: org_id, tx_id, us, usd, direction, and subjects and dimensions by name."""

    def __init__(self, zone: str = "UTC", compat: bool = False, layered: bool = False):
        self.zone, self.compat, self.layered = zone, compat, layered
        #: Each distinct expression is computed once, under a name of its own.
        self.named: dict[str, Column] = {}
        #: If layered: by subject kind, what some of them are made of; see prepared().
        self.under: dict[str, dict[str, Column]] = {}

    def key(self, kind: str) -> Column:
        c = F.col(kind)
        return F.when(blank(c), F.concat(F.lit("\0"), F.col("tx_id"))).otherwise(c)

    def frame(self, kind: str, back: int, until: int = 0):
        return Window.partitionBy("org_id", self.key(kind)).orderBy("us").rangeBetween(-back, until)

    def keep(self, name: str, column: Column) -> Column:
        self.named.setdefault(name, column)
        return F.col(name)

    def count(self, kind: str, back: int) -> Column:
        return self.keep(f"_count_{kind}_{back}", F.count(F.lit(1)).over(self.frame(kind, back)))

    def sum(self, kind: str, back: int) -> Column:
        return self.keep(f"_sum_{kind}_{back}", F.sum("usd").over(self.frame(kind, back)))

    def max(self, kind: str, back: int) -> Column:
        return self.keep(f"_max_{kind}_{back}", F.greatest(F.lit(0.0), F.max("usd").over(self.frame(kind, back))))

    def distinct(self, kind: str, dimension: str, back: int) -> Column:
        if self.layered and kind in SHARED:
            return self.keep(f"_distinct_{kind}_{dimension}_{back}", self._runs(kind, dimension, back))
        return self.keep(f"_distinct_{kind}_{dimension}_{back}", F.size(F.collect_set(F.when(F.col(dimension) != "", F.col(dimension))).over(self.frame(kind, back))))

    def _runs(self, kind: str, dimension: str, back: int) -> Column:
        """Distinct values of a window without collecting them: runs that have begun, less those that ended before the window.

        A value's run goes on as long as it comes again within the lookback. Both sums only grow with time, so that a subject
        costs as much as it has events.
        """
        told = F.coalesce(F.col(dimension) != "", F.lit(False)) & F.col("us").isNotNull()
        each = Window.partitionBy("org_id", self.key(kind), dimension).orderBy("us")
        flag = lambda c: F.when(told & c, 1).otherwise(0)
        before, after = F.lag("us").over(each), F.lead("us").over(each)
        begins, ends = (f"_{n}_{kind}_{dimension}_{back}" for n in ("begins", "ends"))
        self.under.setdefault(kind, {}).update({begins: flag(before.isNull() | (before < F.col("us") - back)), ends: flag(after.isNull() | (after > F.col("us") + back))})
        all_of = Window.partitionBy("org_id", self.key(kind)).orderBy("us")
        over = F.sum(ends).over(all_of.rangeBetween(Window.unboundedPreceding, -back - 1))
        return (F.sum(begins).over(all_of.rangeBetween(Window.unboundedPreceding, 0)) - F.coalesce(over, F.lit(0))).cast("int")

    def prepared(self, tx: DataFrame) -> DataFrame:
        """tx with all columns that the terms need; what others are made of comes from the shuffle of the same subject."""
        under = []
        for kind, columns in self.under.items():
            tx = tx.repartition("org_id", self.key(kind)).select("*", *(c.alias(n) for n, c in columns.items()))
            mine = [n for n in self.named if n.startswith(f"_distinct_{kind}_")]
            tx, under = tx.select("*", *(self.named[n].alias(n) for n in mine)), [*under, *mine]
        return tx.select("*", *(c.alias(n) for n, c in self.named.items() if n not in under))

    def seen(self, kind: str, dimension: str, value: Column, back: int) -> Column:
        held = self.keep(f"_seen_{kind}_{dimension}_{back}", F.collect_set(F.lower(F.col(dimension))).over(self.frame(kind, back)))
        return F.array_contains(held, F.lower(value))

    def direction(self, kind: str, way: str, back: int) -> Column:
        return self.keep(f"_{way}_{kind}_{back}", F.sum(F.when(F.col("direction") == way, F.col("usd")).otherwise(0.0)).over(self.frame(kind, back)))

    def structured(self, kind: str, back: int, threshold: float, least: int) -> Column:
        if threshold <= 0:
            return F.lit(False)
        below = (F.col("usd") > 0) & (F.col("usd") < threshold)
        n = self.keep(f"_below_{kind}_{back}_{threshold:g}".replace(".", "p"), F.count_if(below).over(self.frame(kind, back)))
        total = self.keep(f"_belowsum_{kind}_{back}_{threshold:g}".replace(".", "p"), F.sum(F.when(below, F.col("usd")).otherwise(0.0)).over(self.frame(kind, back)))
        return (n >= least) & (total >= threshold)

    def day(self, kind: str) -> Column:
        local = F.col("ts") if self.zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(self.zone), F.col("ts"))
        w = Window.partitionBy("org_id", self.key(kind), F.to_date(local)).orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
        total = self.keep(f"_day_{kind}", F.sum("usd").over(w))
        return total + F.col("usd") if self.compat else total

    def in_out(self, kind: str, back: int, least: float, residue: float) -> Column:
        a, b = self.direction(kind, "in", back), self.direction(kind, "out", back)
        return (a >= least) & (b >= least) & (F.try_divide(F.abs(a - b), F.greatest(a, b)) <= residue)

    def dormant(self, kind: str, back: int) -> Column:
        peers = self.keep(f"_peers_{kind}", F.count(F.lit(1)).over(self.frame(kind, 0)))
        before = self.keep(f"_before_{kind}_{back}", F.max("us").over(self.frame(kind, back, -1)))
        return F.when(peers > 1, 0.0).otherwise(F.coalesce((F.col("us") - before) / F.lit(float(DAY_US)), F.lit(0.0)))

    def round(self, kind: str, back: int, unit: float) -> Column:
        if unit <= 0:
            return F.lit(0.0)
        whole = (F.col("usd") > 0) & (F.col("usd") % unit == 0)
        return self.keep(f"_round_{kind}_{back}_{unit:g}".replace(".", "p"), F.avg(F.when(whole, 1.0).otherwise(0.0)).over(self.frame(kind, back)))

    def deviation(self, kind: str, back: int, least: int) -> Column:
        """Distance from the window's median in robust standard deviations; 0 without spread or with fewer events."""
        w = self.frame(kind, back)
        held = self.keep(f"_usds_{kind}_{back}", F.sort_array(F.collect_list("usd").over(w)))
        middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
        median = middle(held)
        # through an array of one, so that the median is looked up and the distances are sorted once
        mad = F.get(F.transform(F.array(median), lambda m: F.get(F.transform(F.array(F.sort_array(F.transform(held, lambda x: F.abs(x - m)))), middle), F.lit(0))), F.lit(0))
        return F.when((F.size(held) >= max(least, 4)) & (mad > 0), 0.6745 * (F.col("usd") - median) / mad).otherwise(0.0)
