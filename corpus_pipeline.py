"""Cleaning of a corpus: quality, near copies, repeated passages, benchmark leaks, then packing for training.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents, whatever else is in them: columns that are named like what an operator adds are kept. Nulls: a null text
counts as empty, a null id is kept as it is; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import decontaminate, ngram_join, packing, quality, substring
from ledgerlight.llm.store import Scratch, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from trusted good documents and unlabelled ones; documents scored below one half go."""
    good = table(spark, sf_dir, "labels").where((F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1) & (F.col("quality") == 1))
    scored = quality.score_quality(docs, quality.fit_quality(docs, good), threshold=0.5, prefix="__")
    return scored.where("__predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose five-word n-grams are similar to 0.8 or more, directly or through others, one with the least id stays.

    Rows are told apart by id and text: texts that share an id are decided one by one, null ids come before all others, and
    of rows equal in both one stays.
    """
    scratch = Scratch(spark, "near-copies")
    rows = scratch.save(ngram_join.similar_rows(docs, words=5, part=80, whole=100), "rows")
    first = scratch.save(rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")), "first")
    gone = rows.join(first, "component").where("key != first.key").select("key")
    again = rows.where("n_rows > 1").select("key")
    keyed = docs.withColumn("__key", ngram_join.row_key())
    once = keyed.join(gone.unionByName(again).withColumnRenamed("key", "__key"), "__key", "left_anti")
    more = keyed.join(again.join(gone, "key", "left_anti").withColumnRenamed("key", "__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(more).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that occurred before go; so does a document of which nothing is left. Other texts stay as they were."""
    found = substring.remove_repeats(docs, min_words=20, prefix="__").where("__n_removed = 0 or __kept_text != ''")
    cut = F.col("__n_removed") > 0
    found = found.withColumn("text", F.when(cut, F.col("__kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut, F.length("__kept_text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row that holds 13 successive words of a benchmark item, two of them changed at most, goes; others of its id stay."""
    keyed = docs.withColumn("__key", ngram_join.row_key())
    leaked = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="__key").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(leaked, "__key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048, what="pipeline-packing")


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]

#: A fitted model and tokenizers can't be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is a table, which the next one reads; the table before it is dropped then."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
