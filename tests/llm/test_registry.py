"""Each registered query by name, over the smallest tables with odd rows added, against brute force on its contract."""

import hashlib
import pickle
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlight.llm import quality, registry, toxicity
from tests.llm.test_llm import SMALL, _auc, hashes, linked

TABLES = ["documents", "labels", "benchmark", "embeddings", "pages"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables; documents with nulls, empty, long and repeated texts, ties, and columns named like the operators'."""
    root = str(tmp_path_factory.mktemp("tables"))
    for name in TABLES:
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if name == "documents":
            texts = [r["text"] for r in df.orderBy("doc_id").limit(12).collect()]
            odd = [None, "", " \n\t", "one", "ONE", "two words", texts[0], texts[0], texts[1] + " end", texts[2].upper(), " ".join(texts), "x" * 70_000, "İstanbul, é日本.  a b <|endoftext|> c", (texts[3] + "\n") * 40, "a b " * 3000]
            more = spark.createDataFrame([(900_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
            df = df.unionByName(more, allowMissingColumns=True)
            names = ["score", "predicted", "n_words", "kept_text", "size", "shard", "slot", "piece", "length", "start", "ids", "home", "blob", "key", "n_items"]
            df = df.withColumns({c: F.lit("own") for c in names})
        df.repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, folder, name):
    return registry.QUERIES[name](spark, folder)


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_op1(spark, folder, texts):
    assert rows(run(spark, folder, "op1_ngram_join"), "n_shingles", "component_id") == linked(list(texts.items()), 3, 90)


def encoded(name, texts, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for i, t in texts.items()}


def test_op2(spark, folder, texts):
    wanted, at = {}, 0
    for i, ids in sorted(encoded("word_bpe_49k.json", texts, 2).items()):
        wanted[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert rows(run(spark, folder, "op2_token_records"), "start", "n_tokens", "ids_crc32") == wanted


def test_op3(spark, folder, texts):
    got = run(spark, folder, "op3_packing").toPandas()
    total = 0
    for i, ids in encoded("byte_bpe_50k.json", texts, 0).items():
        mine = got[got.doc_id == i].sort_values("piece")
        total += len(ids)
        lengths = mine.length.tolist()
        assert mine.piece.tolist() == list(range(-(-len(ids) // 2048))) and sum(lengths) == len(ids) and set(lengths[1:]) <= {2048}
        assert mine.start.tolist() == [0, *np.cumsum(lengths)[:-1].tolist()]
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-total // 2048) + 2


def scored(spark, folder, name, label, folds, fold, threshold):
    """Scores by id, after checks of every row against the contract; labels of the rows held out."""
    got = {r["doc_id"]: r for r in run(spark, folder, name).collect()}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert got.keys() == {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    return {i: r["score"] for i, r in got.items()}, {i: y for i, y in labels.items() if i in got and got[i]["held_out"] and y in (0, 1)}


@pytest.mark.parametrize("name,label,folds,fold,threshold,least", [("op4_toxicity", "toxic", 4, 2, 0.3, 0.8), ("op7_quality", "quality", 3, 1, 0.5, 0.95)])
def test_held_out(spark, name, label, folds, fold, threshold, least):
    score, labels = scored(spark, "/root/testdata/sf0.01", name, label, folds, fold, threshold)
    y = np.array([labels[i] == 1 for i in labels])
    s = np.array([score[i] for i in labels])
    assert _auc(s, y) > least and np.mean((s >= threshold) == y) > 0.9


def test_op4(spark, folder, texts):
    """The noisy-or of sentences, word by word."""
    score, _ = scored(spark, folder, "op4_toxicity", "toxic", 4, 2, 0.3)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    words, weights, bias = pickle.loads(toxicity.fit_toxicity(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), labels))
    weight = dict(zip(words.tolist(), weights.tolist()))
    for i, t in texts.items():
        clean = 1.0
        for sentence in re.split(rb"[.!?\n]", (t or "").encode()):
            found = {w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)}
            clean *= 1 - 1 / (1 + np.exp(-bias - sum(weight.get(hashes(w.decode())[0], 0.0) for w in found if weight)))
        assert abs(score[i] - (1 - clean)) < 1e-6, i


def test_op7(spark, folder, texts):
    """Equal texts have equal scores, and the score is the model's for the features of a text by itself."""
    score, _ = scored(spark, folder, "op7_quality", "quality", 3, 1, 0.5)
    assert score[900_006] == score[900_007] == score[min(texts)] and score[900_000] == score[900_001]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{folder}/labels.parquet").where((F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1) & (F.col("quality") == 1))
    model = quality.Model(*pickle.loads(quality.fit_quality(docs, good)))
    for i, t in texts.items():
        data = (t or "").encode()
        x = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert abs(model.scores(x)[0] - score[i]) < 1e-9, i


def test_learning_reads_no_held_out_label(spark, folder, tmp_path):
    """Turning the labels of the rows held out changes no score."""
    for name, label, folds, fold in (("op4_toxicity", "toxic", 4, 2), ("op7_quality", "quality", 3, 1)):
        root = tmp_path / name
        for t in TABLES:
            df = spark.read.parquet(f"{folder}/{t}.parquet")
            if t == "labels":
                out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold
                df = df.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)).cast(df.schema[label].dataType))
            df.write.parquet(f"{root}/{t}.parquet")
        assert rows(run(spark, folder, name), "score") == rows(run(spark, str(root), name), "score")


def test_op5(spark, folder, texts):
    items = {r["item_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = rows(run(spark, folder, "op5_decontamination"), "contaminated", "n_items", "items")
    for i, t in texts.items():
        words, at, found = (t or "").lower().split(), {}, []
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        for item, its in items.items():
            hits = {}
            for q, w in enumerate(its):
                for k in at.get(w, ()):
                    hits.setdefault(k - q, []).append(q)
            if any(sum(s <= q < s + 13 for q in qs) >= 11 for qs in hits.values() if len(qs) >= 11 for s in range(len(its) - 12)):
                found.append(item)
        assert got[i] == (bool(found), len(found), ",".join(map(str, sorted(found)))), i


def test_op6(spark, folder, texts):
    seen, wanted = set(), {}
    for i in sorted(texts):
        words, gone = (texts[i] or "").encode().split(), set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            gone.update(range(k, k + 20) if w in seen else ())
            seen.add(w)
        wanted[i] = (len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())
    assert rows(run(spark, folder, "op6_substring"), "n_words", "n_removed", "kept_sha256") == wanted


def test_op8(spark, folder):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] is not None}
    v = {i: x for i, x in v.items() if x.ndim == 1 and np.isfinite(x).all() and x.any()}
    ids = np.array(sorted(v))
    every = np.stack([v[i] for i in ids])
    got = run(spark, folder, "op8_neighbours").toPandas()
    assert set(got.query_id) == {i for i in v if i % 20 == 0}
    hit = 0
    for q, g in got.groupby("query_id"):
        s = every @ v[q]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, min(20, len(ids) - 1) + 1)) and q not in set(g.vec_id)
        assert np.allclose(g.score, [v[i] @ v[q] for i in g.vec_id], rtol=1e-12)
        assert g.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == g.vec_id.tolist()
        hit += len(best & set(g.vec_id)) / len(best)
    assert hit / got.query_id.nunique() >= 0.9


def test_op9(spark, folder):
    got = run(spark, folder, "op9_warc").toPandas().sort_values("page_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    wanted = db.execute(registry.ORACLE["op9_warc"]).df().sort_values("page_id").reset_index(drop=True)
    assert (got[sorted(got.columns)].astype(str) == wanted[sorted(got.columns)].astype(str)).all().all()


def test_op10(spark, folder, texts):
    got = run(spark, folder, "op10_sharding").toPandas()
    assert sorted(got.doc_id) == sorted(texts) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for r in got.rename(columns={"size": "n_bytes"}).itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert (r.n_bytes, r.text_crc32, r.n_tokens) == (len(data) + 16, zlib.crc32(data), len(data.split()))
    assert got.shard.between(0, 39).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    load = got.groupby("shard")["size"].sum()
    assert load.max() <= max(1.1 * got["size"].sum() / 40, got["size"].max() + 16 * len(got))
