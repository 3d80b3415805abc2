"""Names, documents and addresses against sanctions entries.

Names are compared in two steps that lose nothing. Every identifying part of the shorter name must have a partner of at
least 0.80, so a name can only match an entry with which it shares such a pair of parts, or whose folded form equals its
own. The list's vocabulary and names go to the tasks in blocks of a fixed size; a name that many queries have is searched
once. A longer list takes more passes, not more memory.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.dates import overlap
from ledgerlight.functions.names import FRAGMENT, PART_FLOOR, fold, identifies, jaro_bits, jaro_many

#: The least score of a match, and what weak names, agreement and conflict change.
THRESHOLD, WEAK, CONFLICT, AGREES = 0.85, 0.12, 0.30, 0.05
#: Names of the list in one pass.
BLOCK_NAMES = 100_000
#: Words searched at once, and the largest table of the places of letters in words.
_AT_ONCE, _PLACES = 64, 1 << 24


class ListIndex:
    """A block of distinct lists of names: for each list, its names as (full, script, strong), in order.

    Everything is worked out for distinct words first: a form scores only if words of 0.80 or more meet, so the similar words
    of a query's words are all that its score is made of.
    """

    def __init__(self, lists: list[list[tuple]], octets: bool = False):
        self.octets = octets
        at: dict[str, int] = {}
        held = [(at.setdefault(f, len(at)), k, i, bool(strong)) for k, names in enumerate(lists) for i, (full, script, strong) in enumerate(names) if full for f in dict.fromkeys((fold(full), fold(script))) if f]
        held.sort()
        self.at, self.holders = at, np.array([h[1:] for h in held], np.int64).reshape(-1, 3)
        self.holders_from = np.searchsorted(np.array([h[0] for h in held], np.int64), np.arange(len(at) + 1))
        split = [f.split() for f in at]
        self.words = sorted({w for f in split for w in f})
        self.place = place = {w: i for i, w in enumerate(self.words)}
        self.n_words = np.array([len(f) for f in split], np.int64)
        # a form's words, filled up with one that is similar to nothing
        self.form_words = np.full((len(split), max(map(len, split), default=1)), len(self.words))
        for i, f in enumerate(split):
            self.form_words[i, : len(f)] = [place[w] for w in f]
        self.identifies = np.array([*map(identifies, self.words), False])
        pairs = sorted({(place[w], i) for i, f in enumerate(split) for w in f})
        self.forms_of = np.array([i for _, i in pairs], np.int64)
        self.forms_from = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(len(self.words) + 1))
        units = [*map(self._units, self.words)]
        self.sizes = np.array([*map(len, units)], np.int64)
        self.codes = np.full((len(units), self.sizes.max(initial=1)), -2)
        for i, u in enumerate(units):
            self.codes[i, : len(u)] = u
        self.counts = np.zeros((48, len(units)), np.int32)
        np.add.at(self.counts, (self.codes[self.codes >= 0] % 48, np.repeat(np.arange(len(units)), self.sizes)), 1)
        self.counts = np.minimum(self.counts, 32_767).astype(np.int16)
        self.needs: dict[int, list[np.ndarray]] = {}
        self.letters = np.unique(self.codes[self.codes >= 0])
        # where each letter is in each word, and each word's letters by number; the last one is in none
        self.places = None
        if self.codes.shape[1] <= 64 and (len(self.letters) + 1) * len(units) <= _PLACES:
            self.numbers = np.where(self.codes >= 0, np.searchsorted(self.letters, self.codes), len(self.letters))
            self.places = self._places(self.numbers)
        self.starts = np.array([self._start(w) for w in self.words], np.int64).reshape(len(self.words), -1)
        self.near: dict[str, tuple] = {}
        self.dense = np.zeros(len(self.words) + 1)

    def _units(self, part: str) -> list[int]:
        return list(part.encode() if self.octets else map(ord, part))

    @staticmethod
    def _start(part: str) -> list[int]:
        return [*map(ord, part[:4]), -1, -1, -1, -1][:4]

    def _places(self, numbers: np.ndarray) -> np.ndarray:
        """For each letter and word the places of that letter, as bits."""
        out = np.zeros((len(self.letters) + 1, len(numbers)), np.uint64)
        for i in range(numbers.shape[1]):
            out[numbers[:, i], np.arange(len(numbers))] |= np.uint64(1 << i)
        out[-1] = 0
        return out

    def _may(self, part: str, units: list[int]) -> np.ndarray:
        """Words that have enough letters in common with this one to be similar."""
        n = len(units)
        if n not in self.needs:
            # equal first letters raise a Jaro similarity; what it must be before needs this many common letters
            least = ((PART_FLOOR - 0.1 * p) / (1 - 0.1 * p) for p in range(5))
            self.needs[n] = [np.ceil((3 * x - 1 - 1e-6) / (1 / n + 1 / np.maximum(self.sizes, 1)) - 1e-6).clip(0, 32_767).astype(np.int16) for x in least]
        need = self.needs[n][0].copy()
        low, high = 0, len(self.words)
        for p in range(1, min(4, len(part)) + 1):  # words are in order, so those with equal first letters follow each other
            low = bisect_left(self.words, part[:p], low, high)
            high = bisect_left(self.words, True, low, high, key=lambda w, s=part[:p]: not w.startswith(s))
            need[low:high] = self.needs[n][p][low:high]
        common = np.zeros(len(self.words), np.int16)
        for k, c in Counter(u % 48 for u in units).items():
            common += np.minimum(self.counts[k], min(c, 32_767))
        return np.flatnonzero(common >= need)

    def meet(self, parts: list[str]) -> None:
        """Finds the partners of all these words."""
        if len(self.near) > 20_000:
            self.near.clear()
        new = [p for p in dict.fromkeys(parts) if p not in self.near]
        for at in range(0, len(new), _AT_ONCE):
            self._meet(new[at : at + _AT_ONCE])

    def _meet(self, parts: list[str]) -> None:
        units = [*map(self._units, parts)]
        may = [*map(self._may, parts, units)]
        q, w = np.repeat(np.arange(len(parts)), [*map(len, may)]), np.concatenate(may)
        n, sizes = np.array([*map(len, units)], np.int64), self.sizes[w]
        codes = np.full((len(parts), n.max()), -1)
        for i, u in enumerate(units):
            codes[i, : len(u)] = u
        if self.places is not None and codes.shape[1] <= 64:
            at = np.searchsorted(self.letters, codes).clip(0, max(0, len(self.letters) - 1))
            numbers = np.where(self.letters[at] == codes, at, len(self.letters)) if len(self.letters) else at
            asked, longest = self._places(numbers), sizes.max(initial=0)
            there = jaro_bits([self.places[numbers[q, i], w] for i in range(codes.shape[1])], n[q], sizes, self.octets)
            back = jaro_bits([asked[self.numbers[w, i], q] for i in range(longest)], sizes, n[q], self.octets)
        else:
            mine, theirs = codes[q], self.codes[w][:, : sizes.max(initial=1)]
            there = jaro_many(mine, n[q], theirs, sizes, self.octets)
            back = jaro_many(np.where(theirs < 0, -1, theirs), sizes, np.where(mine < 0, -2, mine), n[q], self.octets)
        starts = np.array([*map(self._start, parts)], np.int64)[q]
        p = np.cumprod((self.starts[w] == starts) & (starts >= 0), axis=1).sum(1)
        more, same = p / 10 if self.octets else p * 0.1, np.array([self.place.get(x, -1) for x in parts], np.int64)[q] == w
        there, back = (np.where(same, 1.0, j + more * (1 - j)) for j in (there, back))
        ok = np.maximum(there, back) >= PART_FLOOR
        q, w, there, back = q[ok], w[ok], there[ok], back[ok]
        cuts = np.searchsorted(q, np.arange(len(parts) + 1)).tolist()
        for part, i, j in zip(parts, cuts, cuts[1:]):
            first, many = self.forms_from[w[i:j]], self.forms_from[w[i:j] + 1] - self.forms_from[w[i:j]]
            forms = np.unique(self.forms_of[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())])
            self.near[part] = w[i:j], there[i:j], back[i:j], forms

    def partners(self, part: str) -> tuple:
        """Words similar enough to this one, both ways, with the forms that they are in."""
        if part not in self.near:
            self.meet([part])
        return self.near[part]

    def forms(self, folded: str) -> tuple[np.ndarray, np.ndarray]:
        """Forms that score against a folded name, and their scores: folded_similarity() of all at once."""
        parts = folded.split()
        near = {p: self.partners(p) for p in parts}
        may = np.unique(np.concatenate([n[3] for n in near.values()])) if near else np.zeros(0, np.int64)
        # the list's name is at least as long
        long, asked = may[self.n_words[may] >= len(parts)], [p for p in parts if identifies(p)]
        total = np.zeros(len(long))
        for p in asked:
            ids, there, _, _ = near[p]
            self.dense[ids] = there
            best = self.dense[self.form_words[long]].max(1)
            self.dense[ids] = 0
            ok = best >= PART_FLOOR
            long, total = long[ok], total[ok] + best[ok]
        long, total = (long, total / len(asked)) if asked else (long[:0], total[:0])
        if len(asked) == 1:
            ok = (self.n_words[long] == 1) | (total >= FRAGMENT)
            long, total = long[ok], total[ok]
        # it is shorter
        short = may[self.n_words[may] < len(parts)]
        for ids, _, back, _ in near.values():
            self.dense[ids] = np.maximum(self.dense[ids], back)
        words = self.form_words[short]
        best, asks = self.dense[words], self.identifies[words]
        self.dense[:] = 0
        n = asks.sum(1)
        ok = (n > 0) & (~asks | (best >= PART_FLOOR)).all(1)
        mean = sum(np.where(asks[:, k], best[:, k], 0.0) for k in range(words.shape[1])) / np.maximum(n, 1)
        ok &= (n > 1) | (mean >= FRAGMENT)
        found, scores = np.concatenate([long, short[ok]]), np.concatenate([total, mean[ok]])
        if folded in self.at:
            same = self.at[folded]
            found, scores = np.append(found[found != same], same), np.append(scores[found != same], 1.0)
        return found, scores

    def search(self, folded: str, least: float) -> tuple[np.ndarray, ...]:
        """List, position, similarity and strength of the most similar name of each list that scores at least so much, the first of ties."""
        found, scores = self.forms(folded) if folded else (np.zeros(0, np.int64), np.zeros(0))
        ok = scores >= least
        found, scores = found[ok], scores[ok]
        first, n = self.holders_from[found], self.holders_from[found + 1] - self.holders_from[found]
        held = self.holders[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        scores = np.repeat(scores, n)
        order = np.lexsort((held[:, 1], -scores, held[:, 0]))
        held, scores = held[order], scores[order]
        best = np.append(True, held[1:, 0] != held[:-1, 0])[: len(held)]
        return held[best, 0], held[best, 1], scores[best], held[best, 2].astype(bool)


class NameIndex(ListIndex):
    """Names one by one: (entry, position, full, script)."""

    def __init__(self, names: list[tuple], octets: bool = False):
        super().__init__([[(full, script, True)] for _, _, full, script in names], octets)
        self.names = names

    def search(self, name: str, least: float) -> list[tuple]:
        """(entry, position, similarity) of each list name that scores at least so much, by its better form."""
        at, _, scores, _ = super().search(fold(name), least)
        return [(*self.names[i][:2], s) for i, s in zip(at.tolist(), scores.tolist())]


_FOUND = ("_names", "position", "similarity", "strong")


def _matched(queries: DataFrame, entries: DataFrame, least: float, octets: bool) -> DataFrame:
    """Rows of queries (with a name) beside each entry that they match, with position, similarity and strong.

    A distinct name is searched once, for distinct lists of names; queries and entries meet by what was found.
    """
    spark = queries.sparkSession
    entries = entries.withColumn("_key", F.md5(F.to_json(F.struct("names"))))
    lists = entries.groupBy("_key").agg(F.first("names").alias("names"))
    passes, out = max(1, math.ceil((entries.agg(F.sum(F.size("names"))).head()[0] or 0) / BLOCK_NAMES)), None
    for k in range(passes):
        block = lambda df, k=k: df.where(F.pmod(F.xxhash64("_key"), F.lit(passes)) == k)
        rows = block(lists).collect()  # the names of about BLOCK_NAMES
        if not rows:
            continue
        held = spark.sparkContext.broadcast([[(n["full"], n["script"], n["strong"]) for n in r["names"] or ()] for r in rows])
        numbers = spark.createDataFrame([(r["_key"], i) for i, r in enumerate(rows)], "_key string, _names int")
        listed = F.broadcast(block(entries).join(F.broadcast(numbers), "_key").drop("_key", "names"))  # of one block

        def match(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = ListIndex(held.value, octets)
            for pdf in frames:
                for at in range(0, len(pdf), 500):
                    names = [(name, fold(name)) for name in pdf["name"][at : at + 500]]
                    index.meet([w for _, folded in names for w in folded.split()])
                    found = [(name, *hit) for name, folded in names if len((hit := index.search(folded, least))[0])]
                    yield pd.DataFrame(found, columns=["name", *_FOUND])

        # names of the same first word go to one task, which compares that word once; a given number of tasks isn't reduced to a few by their size
        names = queries.select("name").where("name is not null").distinct()
        names = names.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.lower(F.substring_index("name", " ", 1)))
        found = names.mapInPandas(match, "name string, _names array<int>, position array<int>, similarity array<double>, strong array<boolean>")
        each = queries.join(found, "name").withColumn("_hit", F.explode(F.arrays_zip(*_FOUND))).drop(*_FOUND).select("*", "_hit.*").drop("_hit")
        each = each.join(listed, "_names").drop("_names")
        out = each if out is None else out.unionByName(each)
    if out is None:
        return queries.crossJoin(entries.drop("_key", "names").withColumns({"position": F.lit(0), "similarity": F.lit(0.0), "strong": F.lit(False)}).where("false"))
    return out


def name_matches(queries: DataFrame, entries: DataFrame, least: float = THRESHOLD - 2 * AGREES, octets: bool = False) -> DataFrame:
    """query_id, entry (list and ref_id joined by a colon), position of its best name, similarity, and whether the name is strong.

    queries: query_id and name. Of an entry's names the most similar counts, the first of ties.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "name")
    found = _matched(asked, entries.select("list", "ref_id", "names"), least, octets)
    return found.select("query_id", F.concat_ws(":", "list", "ref_id").alias("entry"), "position", "similarity", "strong")


def screen(queries: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, octets: bool = False) -> DataFrame:
    """query_id, list, ref_id, score, agree and conflict of each match.

    queries: query_id and name, and optionally kind, birth (from_s, to_s, circa) and nationality. With octets words are
    compared as DuckDB's jaro_similarity does.
    """
    for name, kind in (("kind", "string"), ("birth", "struct<from_s:string,to_s:string,circa:boolean>"), ("nationality", "string")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "name", F.col("kind").alias("q_kind"), "birth", "nationality")
    e = entries.select("list", "ref_id", "kind", "names", "births", "nationalities", "citizenships")
    both = _matched(q, e, min(threshold, 1.0) - 2 * AGREES, octets).where("coalesce(q_kind, '') = '' or q_kind = kind")
    dated = F.col("birth.from_s").isNotNull() & (F.col("birth.from_s") != "") & (F.size("births") > 0)
    same_birth = F.exists("births", lambda b: overlap(b, F.col("birth")))
    homes = F.transform(F.concat("nationalities", "citizenships"), lambda n: F.lower(F.trim(n)))
    placed = (F.coalesce("nationality", F.lit("")) != "") & (F.size(homes) > 0)
    same_home = F.array_contains(homes, F.lower(F.trim("nationality")))
    delta = F.when(dated, F.when(same_birth, AGREES).otherwise(-CONFLICT)).otherwise(0.0) + F.when(placed, F.when(same_home, AGREES).otherwise(-AGREES)).otherwise(0.0)
    score = F.col("similarity") - F.when(F.col("strong"), 0.0).otherwise(WEAK) + delta
    named = lambda *pairs: F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)))
    agree, conflict = named(("birth", dated & same_birth), ("nationality", placed & same_home)), named(("birth", dated & ~same_birth), ("nationality", placed & ~same_home))
    kept = both.withColumns({"raw": score, "agree": agree, "conflict": conflict}).where(F.col("raw") >= threshold)
    return kept.select("query_id", "list", "ref_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "raw")).alias("score"), "agree", "conflict")


def hits(found: DataFrame) -> DataFrame:
    """The best match of each query of screen(): the highest score, then the least list and reference."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "list", "ref_id")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def hit_names(names: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, octets: bool = False) -> DataFrame:
    """The distinct names that match an entry, for Providers.screened."""
    once = names.select("name").where("name != ''").distinct().withColumn("query_id", F.col("name"))
    return screen(once, entries, threshold, octets).select(F.col("query_id").alias("name")).distinct()


def address_key(address: Column) -> Column:
    """Hex and bech32 addresses are the same in either case; others aren't."""
    a = F.trim(address)
    return F.when(a.rlike("^0[xX][0-9a-fA-F]+$") | F.lower(a).rlike("^(bc1|tb1|ltc1)[02-9ac-hj-np-z]+$"), F.lower(a)).otherwise(a)


def document_key(number: Column) -> Column:
    return F.regexp_replace(F.lower(number), "[^a-z0-9]", "")


def by_document(queries: DataFrame, entries: DataFrame, column: str, chain: bool = False) -> DataFrame:
    """queries with list and ref_id of the entries that hold their document (or, with chain, their address)."""
    key = address_key if chain else document_key
    papers = entries.select("list", "ref_id", F.explode("documents").alias("d")).where(F.col("d.kind") == "address" if chain else F.col("d.kind") != "address")
    papers = papers.select("list", "ref_id", key(F.col("d.number")).alias("k")).where("k != ''").distinct()
    return queries.withColumn("k", key(F.col(column))).join(papers, "k").drop("k")


def rescreen(entities: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, high_risk: float | None = None, octets: bool = False) -> DataFrame:
    """All customers, or those above a risk and the politically exposed, against the list: best score and number of matches, with an alert id."""
    some = entities if high_risk is None else entities.where((F.col("risk_score") > high_risk) | F.col("pep"))
    asked = some.select(F.concat_ws("|", "org_id", "id").alias("query_id"), "name", F.col("jurisdiction").alias("nationality"))
    found = screen(asked, entries, threshold, octets).groupBy("query_id").agg(F.max("score").alias("score"), F.count("*").alias("matches"))
    return found.withColumn("alert_id", F.substring(F.sha2(F.concat_ws("|", F.lit("rescreen"), "query_id"), 256), 1, 32))
