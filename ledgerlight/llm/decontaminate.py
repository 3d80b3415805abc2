"""Benchmark decontamination with spaced seeds, in DataFrame functions alone.

A seed is the hash of the words that a fixed mask keeps at a place; the words it ignores may have been substituted. Seeds
of all places of the benchmark and of all documents are joined, each hit names an alignment of an item with a document,
and the words around it are compared one by one. The two masks are lossless: of any 13 words with at most two
substitutions one mask keeps none of the substituted ones at some place, so the result is that of comparing every item
with every place of every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that a mask keeps.
MASKS = ((0, 3, 7, 8, 9, 10), (0, 1, 2, 3, 5, 6))
#: Words of a leak, and how many of them must agree.
WINDOW, AGREE = 13, 11
#: Seeds of the benchmark that may be broadcast (some 30 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of characters other than ASCII white space. White space at the start leaves an empty word there."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+")


def _seeds(array: str, place: str) -> Column:
    """The seeds of all masks at a place; words beyond the end count as missing."""
    return F.array(*(F.xxhash64(F.lit(k), *(F.get(array, F.col(place) + i) for i in mask)) for k, mask in enumerate(MASKS)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id and agreeing (the most agreeing words in a window) of each item that leaked into each document.

    An item leaked if, in some alignment, at least AGREE of WINDOW consecutive words of it are those of the document. Items
    with fewer words can't leak. Null texts have no words; null ids are documents or items of their own kind; equal rows
    count once, and of rows that share an id each text is compared. Other columns aren't read.

    The documents are read once and their words never shuffled: seeds are hashed and looked up in generated code, and only
    the alignments that were hit, with the few words that they cover, are grouped. With more than BROADCAST_SEEDS seeds, the
    documents' seeds are joined by a shuffle, with a key of their row and no words; the rows that were hit are read again.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.filter(words(F.col(item_text_col)), lambda w: w != "").alias("item")).where(F.size("item") >= WINDOW).distinct()
    least = 1 + min(max(m) for m in MASKS)
    place = items.select("item_id", "item", F.explode(F.sequence(F.lit(0), F.size("item") - least)).alias("q"))
    seeds = place.select("item_id", "item", "q", F.explode(_seeds("item", "q")).alias("seed"))
    narrow = seeds.select("seed", "item_id", "q", F.size("item").alias("m"), F.xxhash64("item").alias("version"))
    few = narrow.count() <= BROADCAST_SEEDS
    if few:
        narrow, items = F.broadcast(narrow), F.broadcast(items.withColumn("version", F.xxhash64("item")))
    else:
        items = items.withColumn("version", F.xxhash64("item"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("found")).where(F.size("found") >= least)
    place = F.explode(F.sequence(F.lit(0), F.size("found") - least)).alias("p")
    if few:
        at = texts.select("doc_id", "found", place)
        hits = at.select("doc_id", "found", "p", F.explode(_seeds("found", "p")).alias("seed")).join(narrow, "seed")
    else:
        texts = texts.withColumn("row", F.xxhash64("doc_id", "found"))
        at = texts.select("row", "found", place).select("row", "p", F.explode(_seeds("found", "p")).alias("seed"))
        hits = at.join(narrow, "seed").drop("seed").distinct()
        hits = hits.join(texts.distinct(), "row")
    first = F.col("p") - F.col("q")
    start = F.greatest(first, F.lit(0))
    hits = hits.select("doc_id", "item_id", "version", first.alias("shift"), F.slice("found", start + 1, F.col("m")).alias("covered"))
    # copies of a document's id with other texts have other words there
    hits = hits.groupBy("doc_id", "item_id", "version", "shift", F.xxhash64("covered").alias("which")).agg(F.first("covered").alias("covered"))
    pairs = hits.join(items, hits["item_id"].eqNullSafe(items["item_id"]) & (hits["version"] == items["version"]))
    ahead = F.greatest(-F.col("shift"), F.lit(0))  # words of the item before the document's first
    equal = F.transform("item", lambda w, i: F.when((i >= ahead) & (F.get("covered", i - ahead) == w), 1).otherwise(0))
    pairs = pairs.select(hits["doc_id"], hits["item_id"], equal.alias("equal"))
    windows = F.transform(F.sequence(F.lit(1), F.size("equal") - WINDOW + 1), lambda s: F.aggregate(F.slice("equal", s, WINDOW), F.lit(0), lambda a, b: a + b))
    pairs = pairs.select("doc_id", "item_id", F.array_max(windows).alias("agreeing")).where(F.col("agreeing") >= AGREE)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """Every row of docs, with n_items (leaked items) and items (their ids, ascending). Columns of these names are replaced.

    Row for row; empty tables of either kind give no leaks.
    """
    found = leaks(docs, benchmark, id_col=id_col, **names).groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_list(F.coalesce("item_id", F.lit(None).cast("long")))).alias("items"), F.count("*").alias("n_items"))
    docs = docs.drop("n_items", "items")
    out = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")), "left")
    return out.select(*docs.columns, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
