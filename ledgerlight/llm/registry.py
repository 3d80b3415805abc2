"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ledgerlight.llm import ann, decontaminate, ngram_join, packing, quality, sharding, substring, token_records, toxicity, warc
from ledgerlight.llm.store import Scratch, table


def op1_ngram_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), words=3, part=90, whole=100)


def op2_token_records(spark, sf_dir):
    path = Scratch(spark, "op2").path("records")
    token_records.write_token_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_records.read_token_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def _held_out(folds, fold):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~_held_out(4, 2)))
    scored = toxicity.score_toxicity(docs, model, threshold=0.3)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op5_decontamination(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", F.array_join("items", ",").alias("items"))


def op6_substring(spark, sf_dir):
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where(~_held_out(3, 1) & (F.col("quality") == 1))
    scored = quality.score_quality(docs, quality.fit_quality(docs, good), threshold=0.5)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op8_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 20 == 0, k=20)


#: First hex digits of the hashes of records that the audited replica holds damaged; it also lacks the ends of some files.
_DAMAGED = ("00", "3f", "a7", "c1")


def op9_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    spoil = lambda body, digest: F.when(F.substring(digest, 1, 2).isin(*_DAMAGED), F.sha2(F.overlay(body, F.lit("#"), F.lit(5)), 256)).otherwise(digest)
    both = Scratch(spark, "op9").save(warc.records(pages, more={"spoilt": spoil}), "records")
    mine = both.drop("spoilt")
    replica = both.where("not (file % 7 = 3 and ordinal >= 1000)").drop("digest").withColumnRenamed("spoilt", "digest")
    found = warc.audit(mine, replica)
    out = mine.join(found.withColumnsRenamed({"file": "f", "ordinal": "o"}), (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o")), "left")
    return out.select("page_id", "file", "ordinal", "offset", "length", "digest", F.coalesce("status", F.lit("sound")).alias("status"))


OP9_SQL = f"""
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS h, coalesce(url, '') AS u, chr(13) || chr(10) AS nl FROM pages
), records AS (
  SELECT page_id, page_id // {warc.FILE_PAGES} AS file,
         'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
         || 'WARC-Target-URI: ' || u || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(h) || nl || nl
         || h || nl || nl AS body
  FROM bodies
), hashed AS (
  SELECT page_id, file, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS digest FROM records
), placed AS (
  SELECT *, row_number() OVER w - 1 AS ordinal, CAST(sum(length) OVER w - length AS BIGINT) AS "offset"
  FROM hashed WINDOW w AS (PARTITION BY file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING)
)
SELECT page_id, file, ordinal, "offset", length, digest,
       CASE WHEN file % 7 = 3 AND ordinal >= 1000 THEN 'missing'
            WHEN substr(digest, 1, 2) IN {_DAMAGED} THEN 'damaged' ELSE 'sound' END AS status
FROM placed
"""


def op10_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_records": op2_token_records,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_substring": op6_substring,
    "op7_quality": op7_quality,
    "op8_neighbours": op8_neighbours,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
}
ORACLE: dict[str, str] = {"op9_warc": OP9_SQL}
