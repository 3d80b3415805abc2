"""Amounts in dollars and tiers of jurisdictions."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates_from_env(name: str = "RATES") -> dict:
    """as_of, max_age (seconds) and rates by currency, from a JSON environment variable."""
    return json.loads(os.environ.get(name, '{"rates": {}}'))


def jurisdictions_from_env(name: str = "JURISDICTIONS") -> dict:
    """as_of, action and monitoring from a JSON environment variable; an absent or broken one is undated and lists nothing, which tiers() refuses."""
    try:
        found = json.loads(os.environ.get(name) or "{}")
    except ValueError:
        found = {}
    return {"as_of": found.get("as_of"), "action": list(found.get("action") or []), "monitoring": list(found.get("monitoring") or [])}


def history_jurisdiction(entity: Column, tx: Column) -> Column:
    """The jurisdiction of a history row: the customer's, or else the transaction's."""
    return F.when(F.trim(F.coalesce(entity, F.lit(""))) != "", entity).otherwise(tx)


def usd(amount: Column, currency: Column, rates: dict[str, float], fresh: bool = True) -> tuple[Column, Column]:
    """Dollar value and error. A blank currency and USD are dollars; a missing, non-positive or stale rate is an error."""
    code = F.upper(F.trim(F.coalesce(currency, F.lit(""))))
    own = code.isin("", "USD")
    pairs = [F.lit(x) for k, v in rates.items() for x in (k.strip().upper(), float(v))]
    rate = F.try_element_at(F.create_map(*pairs), code) if pairs else F.lit(None).cast("double")
    bad = ~own & (F.lit(not fresh) | rate.isNull() | (rate <= 0))
    error = F.when(bad, F.concat(F.lit("no usable rate for "), code))
    return F.when(own, amount).when(~bad, amount * rate), error


def convert(tx: DataFrame, rates: dict[str, float], as_of: datetime | None = None, max_age: float | None = None, now: datetime | None = None, amount: str = "notional") -> DataFrame:
    """tx with usd and usd_error. Rates older than max_age seconds at now count as stale."""
    fresh = max_age is None or as_of is None or now is None or (now - as_of).total_seconds() <= max_age
    value, error = usd(F.col(amount), F.col("currency"), rates, fresh)
    return tx.withColumns({"usd": value, "usd_error": error})


def tier(code: Column, action: list[str], monitoring: list[str]) -> Column:
    """action before monitoring, and an empty text for codes on neither list; without regard to case."""
    clean = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(clean.isin([c.strip().upper() for c in action]), "action").when(clean.isin([c.strip().upper() for c in monitoring]), "monitoring").otherwise("")


def tiers(action: list[str], monitoring: list[str], dated: bool = True) -> dict[str, str]:
    """For Providers.tiers. An empty or undated list is refused."""
    if not dated or not (action or monitoring):
        raise ValueError("the list of jurisdictions is empty or undated")
    return {c.strip().upper(): "monitoring" for c in monitoring} | {c.strip().upper(): "action" for c in action}
