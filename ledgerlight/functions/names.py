"""Folding and comparison of names."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Latin writing of Cyrillic letters. Text is decomposed before, so letters with a mark lose it first.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ў": "w",
}
#: Legal forms, which identify nobody.
LEGAL_FORMS = frozenset("ltd limited llc inc incorporated corp corporation plc gmbh mbh ag sa sas sarl srl spa bv nv oy ab as aps kk pte pty jsc ojsc zao ooo oao pao fze fzc fzco llp lp gie kft sro dooel".split())
#: The least similarity of any part, and of a single identifying part against a longer name.
PART_FLOOR, FRAGMENT = 0.80, 0.95


def fold(name: str | None) -> str:
    """Lower case without marks, in Latin letters and digits, words apart by one space."""
    out = []
    for ch in unicodedata.normalize("NFD", name or "").lower():
        kind = unicodedata.category(ch)
        if kind == "Mn":
            continue
        out.append(CYRILLIC.get(ch, ch if kind[0] == "L" or kind == "Nd" else " "))
    return " ".join("".join(out).split())


def jaro(a: str, b: str, octets: bool = False) -> float:
    """Jaro similarity of letters; with octets as DuckDB has it, of UTF-8 bytes and with whole transpositions only."""
    if not a or not b:
        return 0.0
    if octets and not (a.isascii() and b.isascii()):
        a, b = a.encode().decode("latin-1"), b.encode().decode("latin-1")
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == ch), None)
        if j is not None:
            free[j] = False
            left.append(ch)
    if not left:
        return 0.0
    right = [ch for ch, f in zip(b, free) if not f]
    swapped = sum(x != y for x, y in zip(left, right)) / 2
    if octets:
        swapped //= 1
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@lru_cache(200_000)
def similar(a: str, b: str, octets: bool = False) -> float:
    """Jaro similarity, raised for up to four equal first letters, however low it is."""
    if a == b:
        return 1.0
    j, p = jaro(a, b, octets), 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + (p / 10 if octets else p * 0.1) * (1 - j)


def jaro_many(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, octets: bool = False) -> np.ndarray:
    """jaro() of each row of a with that of b: codes of letters (or bytes), filled up with -1 in a and -2 in b; none is empty."""
    rows = np.arange(len(b))
    reach = np.maximum(0, np.maximum(a_sizes, b_sizes) // 2 - 1)[:, None]
    at, free, met = np.arange(b.shape[1]), np.ones(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        may = free & (b == a[:, i, None]) & (np.abs(at - i) <= reach)
        j = may.argmax(1)
        met[:, i] = may[rows, j]
        free[rows, j] &= ~met[:, i]
    m = met.sum(1)
    left = np.take_along_axis(a, np.argsort(~met, axis=1, kind="stable"), 1)
    right = np.take_along_axis(b, np.argsort(free, axis=1, kind="stable"), 1)
    n = min(left.shape[1], right.shape[1])
    swapped = ((left[:, :n] != right[:, :n]) & (np.arange(n) < m[:, None])).sum(1) / 2
    if octets:
        swapped = np.floor(swapped)
    return np.where(m > 0, (m / a_sizes + m / b_sizes + (m - swapped) / np.maximum(m, 1)) / 3, 0.0)


#: For each reach and position, the places that a letter may meet, as bits.
_REACHED = np.array([[sum(1 << j for j in range(max(0, i - r), min(64, i + r + 1))) for i in range(64)] for r in range(32)], np.uint64)


def jaro_bits(places: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray, octets: bool = False) -> np.ndarray:
    """jaro() of many pairs of at most 64 letters: for each position of a, the places in b of its letter, as bits; 0 beyond a's end."""
    reach = np.maximum(0, np.maximum(a_sizes, b_sizes) // 2 - 1)
    free, lows, m, swapped = np.full(len(reach), ~np.uint64(0)), [], np.zeros(len(reach), np.int64), np.zeros(len(reach), np.int64)
    for i, p in enumerate(places):
        may = p & _REACHED[reach, i] & free
        lows.append(may & -may)
        free ^= lows[-1]
    rest = ~free
    for p, low in zip(places, lows):
        met = low != 0
        m += met
        first = np.where(met, rest & -rest, np.uint64(0))
        swapped += met & (p & first == 0)
        rest ^= first
    swapped = swapped // 2 if octets else swapped / 2
    return np.where(m > 0, (m / a_sizes + m / b_sizes + (m - swapped) / np.maximum(m, 1)) / 3, 0.0)


def identifies(part: str) -> bool:
    return part not in LEGAL_FORMS and len(part) >= 3 and any(ch.isalpha() for ch in part)


def folded_similarity(a: str, b: str) -> float:
    """How well the parts of the shorter folded name are found in the longer one; 0 unless all identifying ones are."""
    if a == b and a:
        return 1.0
    short, long = a.split(), b.split()
    if not short or not long:
        return 0.0
    if len(short) > len(long):
        short, long = long, short
    best = [max(similar(x, y) for y in long) for x in short if identifies(x)]
    if not best or min(best) < PART_FLOOR:
        return 0.0
    mean = sum(best) / len(best)
    return 0.0 if len(best) == 1 and len(long) > 1 and mean < FRAGMENT else mean


def similarity(a: str | None, b: str | None) -> float:
    return folded_similarity(fold(a), fold(b))


@F.pandas_udf(StringType())
def fold_name(name: pd.Series) -> pd.Series:
    return name.map(fold)


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype=float)
