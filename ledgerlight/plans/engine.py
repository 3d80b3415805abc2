"""Rules over a table of transactions: one plan for a whole rule set."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.plans import dsl
from ledgerlight.plans.dsl import Compiler, Node, RuleError, Value
from ledgerlight.plans.library import ACTIONS, SEVERITY, Rule
from ledgerlight.plans.terms import DIMENSIONS, SUBJECTS, History, blank, lookback

_TEXTS = ("org_id", "tx_id", "user", "account", "counterparty", "device", "address", "direction", "currency", "asset_class", "jurisdiction", "symbol")
FIELDS = {("Tx", c): (F.col, c, "text") for c in _TEXTS} | {("Tx", "usd"): (F.col, "usd", "number")}
ENTITY_FIELDS = {"id": "text", "name": "text", "jurisdiction": "text", "entity_type": "text", "risk_score": "number", "pep": "flag"}
_TERMS = {"USD": 0, "Near": 2, "Count": 2, "Sum": 2, "Max": 2, "Day": 1, "Distinct": 3, "Seen": 4, "Structured": 4, "InOut": 4, "Dormant": 2, "Round": 3, "Deviation": 3, "Screened": 2, "Listed": 2, "Tier": 1}


@dataclass
class Providers:
    """What rules may ask besides the history. A term whose provider is missing is refused on admission.

    screened: for each class, a table with the column name of the names that it hits (see operators.screening).
    listed: for each list, a table with the column value of its live values, normalised.
    tiers: jurisdiction code to action or monitoring; None if there is no list.
    """

    screened: dict[str, DataFrame] = field(default_factory=dict)
    listed: dict[str, DataFrame] = field(default_factory=dict)
    tiers: dict[str, str] | None = None
    entities: bool = False
    zone: str = "UTC"
    compat: bool = False


class RuleSet:
    """Rules that were admitted, and the columns that they need."""

    def __init__(self, rules: Iterable[Rule], providers: Providers | None = None):
        self.providers = providers or Providers()
        self.rules = tuple(rules)
        self.history = History(self.providers.zone, self.providers.compat, layered=True)
        self.joins: dict[str, tuple[Column, DataFrame, str]] = {}
        if len({r.id for r in self.rules}) < len(self.rules):
            raise RuleError("two rules have one id")
        known = {k: (f(c), kind) for k, (f, c, kind) in FIELDS.items()}
        known |= {("Entity", c): (F.col(f"entity.{c}") if self.providers.entities else F.lit(None).cast({"text": "string", "number": "double", "flag": "boolean"}[kind]), kind) for c, kind in ENTITY_FIELDS.items()}
        compiler = Compiler(known, {name: self._term(name) for name in _TERMS})
        self.compiled = []
        for rule in self.rules:
            if rule.weight < 0 or rule.severity not in SEVERITY or rule.action not in ACTIONS:
                raise RuleError(f"{rule.id}: bad weight, severity or action")
            try:
                self.compiled.append(compiler.rule(dsl.parse(rule.dsl)))
            except RuleError as e:
                raise RuleError(f"{rule.id}: {e}") from None

    def _term(self, name: str):
        return lambda nodes, args: self._compile(name, nodes, args)

    def _compile(self, name: str, nodes: list[Node], args: list[Value]) -> Value:
        if len(args) != _TERMS[name]:
            raise RuleError(f"{name} takes {_TERMS[name]} arguments")
        h, usd = self.history, F.col("usd")
        if name == "USD":
            return Value(F.coalesce(usd, F.lit(0.0)), "number", F.when(usd.isNull(), F.lit("amount not convertible")))
        if name == "Near":
            top, band = (self._constant(n) for n in nodes)
            inside = (usd >= top * (1 - band)) & (usd < top) if 0 < band <= 1 else F.lit(False)
            return Value(F.coalesce(inside, F.lit(False)), "flag", F.when(usd.isNull(), F.lit("amount not convertible")))
        if name in ("Screened", "Listed"):
            return self._joined(name, nodes, args)
        if name == "Tier":
            if self.providers.tiers is None:
                raise RuleError("no list of jurisdictions")
            pairs = [F.lit(x) for k, v in self.providers.tiers.items() for x in (k.strip().upper(), v)]
            found = F.try_element_at(F.create_map(*pairs), F.upper(F.trim(args[0].column))) if pairs else F.lit(None)
            return Value(F.coalesce(found.cast("string"), F.lit("")), "text", args[0].error)
        kind = self._constant(nodes[0])
        if kind not in SUBJECTS:
            return self._failed(name, f"unknown subject {kind}")
        error = F.when(blank(F.col(kind)), F.lit(f"blank {kind}"))
        try:
            if name == "Day":
                return Value(h.day(kind), "number", error)
            spans = {"Distinct": 2, "Seen": 3}
            back = lookback(self._constant(nodes[spans.get(name, 1)]))
            if name in ("Distinct", "Seen"):
                dimension = self._constant(nodes[1])
                if dimension not in DIMENSIONS and not (dimension == "user" and not self.providers.compat):
                    return self._failed(name, f"unknown dimension {dimension}")
                if name == "Distinct":
                    return Value(h.distinct(kind, dimension, back), "number", error)
                empty = F.when(blank(args[2].column), F.lit("nothing to look for"))
                return Value(h.seen(kind, dimension, args[2].column, back), "flag", F.coalesce(error, empty))
            rest = [self._constant(n) for n in nodes[2:]]
            call = {"Count": h.count, "Sum": h.sum, "Max": h.max, "Structured": h.structured, "InOut": h.in_out, "Dormant": h.dormant, "Round": h.round, "Deviation": h.deviation}[name]
            return Value(call(kind, back, *rest), "flag" if name in ("Structured", "InOut") else "number", error)
        except RuleError as e:
            return self._failed(name, str(e))

    @staticmethod
    def _constant(node: Node):
        if node.kind not in ("number", "text"):
            raise RuleError("windows, subjects and thresholds are literals")
        return node.value

    @staticmethod
    def _failed(name: str, why: str) -> Value:
        """What cannot be evaluated for any row: an error in each."""
        kind = "flag" if name in ("Structured", "InOut", "Seen") else "number"
        return Value(F.lit(False) if kind == "flag" else F.lit(0.0), kind, F.lit(why))

    def _joined(self, name: str, nodes: list[Node], args: list[Value]) -> Value:
        which = self._constant(nodes[1] if name == "Screened" else nodes[0])
        tables = self.providers.screened if name == "Screened" else self.providers.listed
        if which not in tables:
            raise RuleError(f"no provider for {name} {which}")
        value = args[0] if name == "Screened" else args[1]
        hit = f"_{name.lower()}_{len(self.joins)}"
        for h, (column, df, w) in self.joins.items():
            if str(column) == str(value.column) and w == which:
                hit = h
        self.joins.setdefault(hit, (value.column, tables[which], which))
        return Value(F.coalesce(F.col(hit), F.lit(False)), "flag", value.error)

    def prepare(self, tx: DataFrame) -> DataFrame:
        """Transactions with the columns that the rules' terms are made of: one projection for all windows, one join for each provider."""
        for hit, (column, names, _) in self.joins.items():
            key = "name" if "name" in names.columns else "value"
            found = names.select(F.col(key).alias(hit + "_key"), F.lit(True).alias(hit)).distinct()
            # names and lists are small sides; where they are not, Spark joins by their key
            tx = tx.withColumn(hit + "_at", column).join(found, F.col(hit + "_at") == F.col(hit + "_key"), "left").drop(hit + "_key", hit + "_at")
        return self.history.prepared(tx)

    def hits_column(self) -> Column:
        """All rules that fired or failed on a row: rule_id, severity, weight, action, error."""
        each = []
        for rule, value in zip(self.rules, self.compiled):
            scope = F.lit(rule.enabled)
            if rule.jurisdictions:
                place = F.col("entity.jurisdiction") if self.providers.entities else F.col("jurisdiction")
                scope = scope & F.lower(F.coalesce(place, F.lit(""))).isin([j.lower() for j in rule.jurisdictions])
            if rule.asset_classes:
                scope = scope & F.lower(F.coalesce("asset_class", F.lit(""))).isin([a.lower() for a in rule.asset_classes])
            error = value.error if value.error is not None else F.lit(None).cast("string")
            fired = scope & (error.isNotNull() | F.coalesce(value.column, F.lit(False)))
            action = F.when(error.isNotNull(), "review").otherwise(rule.action)
            each.append(F.when(fired, F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(float(rule.weight)).alias("weight"), action.alias("action"), error.alias("error"))))
        return F.filter(F.array(*each), lambda h: h.isNotNull()) if each else F.array()

    def evaluate(self, tx: DataFrame) -> DataFrame:
        """Each transaction with its hits, score, action and the contribution of each rule."""
        carried = [c for c in ("org_id", "tx_id", "ts", "us", "user", "account", "usd") if c in tx.columns]
        out = self.prepare(tx).select(*carried, self.hits_column().alias("hits"))
        return out.select("*", score_column().alias("score"), action_column().alias("action"), breakdown_column().alias("breakdown"))

    def alerts(self, tx: DataFrame) -> DataFrame:
        """A row for each hit."""
        found = self.evaluate(tx).where(F.size("hits") > 0)
        return found.select("org_id", "tx_id", "ts", "us", "user", "account", F.col("score").alias("tx_score"), F.col("action").alias("tx_action"), F.inline("hits"))


def _part(h: Column) -> Column:
    times = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return F.when(h["error"].isNull(), h["weight"] * F.element_at(times, h["severity"])).otherwise(0.0)


def score_column() -> Column:
    """Weight of evidence between 0 and 1; failed rules add nothing, what is not a number counts as 1."""
    total = F.aggregate("hits", F.lit(0.0), lambda a, h: a + _part(h))
    return F.when(F.isnan(total), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def action_column(hits: str = "hits") -> Column:
    """The strongest action of the hits, allow without any."""
    rank = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    best = F.aggregate(hits, F.lit(0), lambda a, h: F.greatest(a, F.element_at(rank, h["action"])))
    return F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), best + 1)


def breakdown_column() -> Column:
    return F.map_from_entries(F.transform(F.filter("hits", lambda h: h["error"].isNull()), lambda h: F.struct(h["rule_id"], _part(h))))


#: Fixed value: the strongest action that a statistical judgement may ask for.
CEILING = "review"


def contain(judgement: Column) -> Column:
    """A scorer's hit (rule_id, severity, weight, action) as it may count: null if its weight is negative or no finite number, its action review at most."""
    weight = judgement["weight"]
    sound = judgement.isNotNull() & weight.isNotNull() & ~F.isnan(weight) & (weight >= 0) & (weight < float("inf"))
    rank = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    action = F.when(F.element_at(rank, judgement["action"]) > ACTIONS[CEILING], CEILING).otherwise(judgement["action"])
    return F.when(sound, F.struct(judgement["rule_id"].alias("rule_id"), judgement["severity"].alias("severity"), weight.cast("double").alias("weight"), action.alias("action"), F.lit(None).cast("string").alias("error")))


def with_scorer(decisions: DataFrame, judgements: DataFrame) -> DataFrame:
    """decisions of RuleSet.evaluate() with a scorer's judgement added to their hits, and score, action and breakdown made anew.

    judgements: org_id, tx_id, rule_id, severity, weight, action; one for a transaction at most. What a scorer may not say
    is left out, and the rules' verdict stands; so it does where there is none. Since weights aren't negative, it only grows.
    """
    told = judgements.select("org_id", "tx_id", contain(F.struct("rule_id", "severity", "weight", "action")).alias("_said")).where("_said is not null")
    out = decisions.drop("score", "action", "breakdown").join(told, ["org_id", "tx_id"], "left")
    out = out.withColumn("hits", F.when(F.col("_said").isNotNull(), F.concat("hits", F.array("_said"))).otherwise(F.col("hits"))).drop("_said")
    return out.select("*", score_column().alias("score"), action_column().alias("action"), breakdown_column().alias("breakdown"))


def with_entities(tx: DataFrame, entities: DataFrame) -> DataFrame:
    """Transactions with the struct entity of their user; without one, an entity that has the user's id and no name."""
    e = entities.select(F.col("org_id").alias("e_org"), F.col("id").alias("e_id"), F.struct(*(F.col(c) for c in ENTITY_FIELDS)).alias("found"))
    none = F.struct(F.col("user").alias("id"), F.lit("").alias("name"), F.lit("").alias("jurisdiction"), F.lit("user").alias("entity_type"), F.lit(0.0).alias("risk_score"), F.lit(False).alias("pep"))
    out = tx.join(e, (F.col("org_id") == F.col("e_org")) & (F.col("user") == F.col("e_id")), "left")
    return out.withColumn("entity", F.coalesce("found", none)).drop("found", "e_org", "e_id")
