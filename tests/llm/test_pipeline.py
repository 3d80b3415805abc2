"""The pipeline against a brute-force version of each stage."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs)
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns and docs.count()
    pick = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before, after = map(pick, kept["quality classifier"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert np.mean([(i in after) == bool(q) for i, q in labels.items()]) > 0.9

    before, after = map(pick, kept["n-gram Jaccard join"])
    sets = {}
    for i, t in before.items():
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {i for i in sets if find(i) == i}

    before, after = map(pick, kept["substring dedup"])
    seen, wanted = set(), {}
    for i in sorted(before):
        w, gone = before[i].encode().split(), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            gone.update(range(k, k + 20) if g in seen else ())
            seen.add(g)
        left = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        if left or not gone:
            wanted[i] = left if gone else before[i]
    assert after == wanted

    before, after = map(pick, kept["benchmark decontamination"])
    bench = [r["text"].lower().split() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    gone = set()
    for i, t in before.items():
        w = t.lower().split()
        at = {}
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        for item in bench:
            hits = {}
            for q, x in enumerate(item):
                for k in at.get(x, ()):
                    hits.setdefault(k - q, []).append(q)
            if any(sum(s <= q < s + 13 for q in qs) >= 11 for qs in hits.values() if len(qs) >= 11 for s in range(len(item) - 12)):
                gone.add(i)
    assert set(after) == set(before) - gone

    packed = kept["best-fit packing"][1]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_empty_stages(spark, tmp_path):
    none = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_rows_that_share_an_id(spark):
    """Rows are kept or dropped by id and text, whatever else has their id."""
    words = lambda n, k: " ".join(f"{n}w{i}" for i in range(k))
    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    pick = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    docs = [(1, a), (5, a + " end"), (5, b), (5, b), (6, b + " end"), (None, c), (None, c), (None, a + " stop"), (7, c + " end"), (8, None), (9, "")]
    kept = [(None, a + " stop"), (5, b), (None, c), (8, None), (9, "")]
    assert pick(p.drop_near_copies(spark, make(docs), SMALL)) == sorted(kept, key=str)
    leak = max((r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()), key=len)
    docs = [(1, a), (5, leak), (5, b), (None, leak), (None, c), (None, None)]
    assert pick(p.drop_benchmark_leaks(spark, make(docs), SMALL)) == sorted([(1, a), (5, b), (None, c), (None, None)], key=str)


def test_run_cuts_lineage(spark):
    """The result comes from the last stage's table alone."""
    out = p.run(spark, SMALL)
    files = out.inputFiles()
    assert files and all("/pipeline-" in f and f"/stage-{len(p.STAGES) - 1}/" in f for f in files)
    assert out.count()


def test_other_columns(spark):
    """Columns named like an operator's are kept as they were, and n_chars may be missing."""
    text = " ".join(f"word{i}" for i in range(40))
    names = ["score", "predicted", "n_words", "n_removed", "kept_text", "factors", "n_items", "items", "key", "home", "blob", "row", "node"]
    rows = [(1, text), (2, "other words " + text), (3, None), (4, ""), (None, text), (2, "other words " + text), (6, " ".join(f"x{i}" for i in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in names})
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"{c} != 'own'" for c in names)).count() == 0
    kept = {(r["doc_id"], r["text"]) for r in p.drop_repeated_passages(spark, docs, SMALL).collect()}
    assert (1, text) not in kept and (None, text) in kept and (2, "other words") in kept and (3, None) in kept
    assert p.pack_sequences(spark, docs, SMALL).select("length").agg(F.max("length")).head()[0] <= 2048
