"""Partial dates of birth and retention periods."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
BIRTH = "struct<from_s:string,to_s:string,circa:boolean>"


def loose_date(text: str) -> str | None:
    """YYYY, YYYY-MM or YYYY-MM-DD of words in any order."""
    year = month = day = 0
    for word in re.split(r"[\s,/-]+", text.lower().strip()):
        if not month and word[:3] in _MONTHS:
            month = _MONTHS[word[:3]]
        elif re.fullmatch(r"\d+", word):
            n = int(word)
            if 1000 <= n <= 9999 and not year:
                year = n
            elif 1 <= n <= 31 and not day:
                day = n
    if not year:
        return None
    return f"{year:04d}-{month:02d}-{day:02d}" if month and day else f"{year:04d}-{month:02d}" if month else f"{year:04d}"


def loose_birth(text: str | None) -> dict | None:
    """A date, or a range with "to"; with or without "circa"."""
    s = (text or "").lower().strip()
    circa = "circa" in s
    low, _, high = s.replace("circa", " ").partition(" to ")
    start = loose_date(low)
    return start and {"from_s": start, "to_s": (loose_date(high) if high else start) or start, "circa": circa}


def slash_birth(text: str | None) -> dict | None:
    """dd/mm/yyyy, where unknown parts are 00."""
    parts = (text or "").strip().split("/")
    if len(parts) != 3 or not all(p.strip().isdigit() for p in parts):
        return None
    d, m, y = (int(p) for p in parts)
    if not y:
        return None
    iso = f"{y:04d}-{m:02d}-{d:02d}" if m and d else f"{y:04d}-{m:02d}" if m else f"{y:04d}"
    return {"from_s": iso, "to_s": iso, "circa": False}


def overlap(a: Column, b: Column) -> Column:
    """Whether two partial date ranges can share a day, compared as far as both are known."""
    n = lambda x, y: F.least(F.length(x), F.length(y))
    low = F.left(a["from_s"], n(a["from_s"], b["to_s"])) <= F.left(b["to_s"], n(a["from_s"], b["to_s"]))
    high = F.left(b["from_s"], n(b["from_s"], a["to_s"])) <= F.left(a["to_s"], n(b["from_s"], a["to_s"]))
    return low & high


@F.pandas_udf(StructType([StructField("from_s", StringType()), StructField("to_s", StringType()), StructField("circa", BooleanType())]))
def parse_loose_birth(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([loose_birth(t) or {"from_s": None, "to_s": None, "circa": None} for t in text])


#: Fixed values, in years: the period, a longest extension, and the ceiling for transactions.
PERIOD, EXTENSION, CEILING = 5, 5, 10


def expiry(klass: Column, start: Column, occurred: Column, extended_days: Column) -> Column:
    """When a record may go: five years after its start, an extension of five more at most; transactions ten years after they occurred, but never before the five."""
    years = lambda c, n: F.add_months(c, 12 * n)
    floor = years(start, PERIOD)
    at = F.least(F.date_add(floor, F.coalesce(extended_days, F.lit(0))), years(start, PERIOD + EXTENSION))
    cap = years(occurred, CEILING)
    return F.when((klass == "transaction") & occurred.isNotNull() & (at > cap) & (cap >= floor), cap).otherwise(at)
