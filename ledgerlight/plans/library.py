"""The starter rules and how their hits are weighed."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    id: str
    dsl: str
    severity: str = "medium"
    weight: float = 0.0
    action: str = "review"
    enabled: bool = True
    jurisdictions: tuple[str, ...] = ()
    asset_classes: tuple[str, ...] = ()
    typology: str = ""
    priority: int = 0


#: Identifiers, thresholds, severities, weights and actions of the starter rules.
LIBRARY = (
    Rule("currency-day", 'Day("user") > 10000', "high", 0.30, "report", typology="large currency"),
    Rule("structuring-day", 'Structured("user", "24h", 10000, 3)', "high", 0.35, "review", typology="structuring"),
    Rule("structuring-week", 'Structured("user", "7d", 10000, 5)', "medium", 0.25, "review", typology="structuring"),
    Rule("structuring-accounts", 'Distinct("user", "account", "24h") > 1 && Structured("user", "24h", 10000, 2)', "high", 0.30, "review", typology="structuring"),
    Rule("structuring-near-threshold", "Near(10000, 0.1)", "low", 0.10, "flag", typology="structuring"),
    Rule("transmittal-recordkeeping", "USD() >= 3000", "low", 0.05, "report", typology="transmittal"),
    Rule("transmittal-payment-transparency", 'USD() > 1000 && Tx.jurisdiction != "" && Tier(Tx.jurisdiction) != "domestic"', "low", 0.05, "report", typology="transmittal"),
    Rule("transmittal-crypto", 'Tx.counterparty != ""', "low", 0.05, "report", asset_classes=("crypto",), typology="transmittal"),
    Rule("sanctions-customer", 'Entity.name != "" && Screened(Entity.name, "sanctions")', "critical", 0.50, "block", typology="sanctions"),
    Rule("sanctions-counterparty", 'Tx.counterparty != "" && Screened(Tx.counterparty, "sanctions")', "critical", 0.50, "block", typology="sanctions"),
    Rule("exposure-political", 'Entity.name != "" && Screened(Entity.name, "pep") && USD() > 10000', "high", 0.25, "review", typology="political exposure"),
    Rule("geography-countermeasures", 'Tier(Tx.jurisdiction) == "action"', "critical", 0.45, "block", typology="geography"),
    Rule("geography-monitoring", 'Tier(Tx.jurisdiction) == "monitoring"', "medium", 0.20, "review", typology="geography"),
    Rule("layering-pass-through", 'InOut("user", "24h", 10000, 0.05)', "high", 0.30, "review", typology="layering"),
    Rule("velocity-count", 'Count("user", "24h") > 50', "medium", 0.15, "review", typology="velocity"),
    Rule("behaviour-deviation", 'Deviation("user", "90d", 10) > 3.5', "medium", 0.20, "review", typology="behaviour"),
    Rule("dormancy-reactivation", 'Dormant("user", "730d") > 180 && USD() > 10000', "medium", 0.20, "review", typology="dormancy"),
    Rule("concentration-counterparties", 'Distinct("user", "counterparty", "24h") > 20', "medium", 0.20, "review", typology="concentration"),
    Rule("concentration-device", 'Tx.device != "" && Distinct("device", "user", "7d") > 5', "high", 0.30, "review", typology="concentration"),
    Rule("round-amounts", 'Count("user", "30d") >= 10 && Round("user", "30d", 1000) > 0.8', "low", 0.10, "flag", typology="round amounts"),
)

#: What a hit's weight is multiplied by, and how actions rank.
SEVERITY = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}
ACTIONS = {"allow": 0, "flag": 1, "review": 2, "report": 3, "block": 4}


@dataclass(frozen=True)
class Coverage:
    """What the library covers, for a catalogue."""

    rules: tuple[Rule, ...] = field(default=LIBRARY)

    def typologies(self) -> list[str]:
        return list(dict.fromkeys(r.typology for r in self.rules if r.typology))
