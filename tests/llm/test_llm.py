"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlight.llm import ann, decontaminate, graph, ngram_join, packing, quality, sharding, store, substring, text, token_records, tokens, toxicity, warc

SMALL = "/root/testdata/sf0.001"
RNG = np.random.default_rng(11)
VOCABULARY = ["w%d" % i for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


def odd_documents():
    """Copies, near copies, shared passages, and every odd case."""
    rows, base = [], prose(120)
    rows += [(i, base) for i in range(4)]
    for i in range(4, 44):
        words = base.split()
        for k in RNG.integers(0, 120, RNG.integers(1, 4)):
            words[k] = f"x{RNG.integers(0, 9)}"
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    passage = prose(30)
    rows += [(i, f"{prose(40)} {passage}\n{prose(20)}") for i in range(44, 60)]
    rows += [(i, prose(RNG.integers(1, 200))) for i in range(60, 90)]
    rows += [(90, None), (91, ""), (92, "  \n\t "), (93, "one"), (94, "ONE"), (95, "two words"), (96, "é ü 日本   z"), (97, (prose(25) + " ") * 4), (98, prose(30_000)), (99, "a" * 50_000)]
    return rows


@pytest.fixture(scope="module")
def documents():
    return odd_documents()


@pytest.fixture(scope="module")
def docs(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    return df.withColumns({"score": F.lit("clash"), "n_words": F.lit("clash"), "home": F.lit(1), "blob": F.lit(2), "row": F.lit("r"), "items": F.lit(3)}).repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def linked(rows, k, part):
    sets, root = shingle_sets(rows, k), {}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,part", [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [400, 7])
def test_ngram_join(spark, docs, documents, monkeypatch, k, part, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)  # 7: the near copies fill several blocks
    found = ngram_join.similar_documents(docs, k, part, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == linked(documents, k, part)


def test_ngram_join_edges(spark):
    assert ngram_join.similar_documents(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(rows).collect()}
    assert got == {None: None, 1: 1, 2: 2}
    with pytest.raises(ValueError):
        ngram_join.similar_documents(rows, part=40)


def test_ngram_join_shared_ids(spark):
    """Every text of an id is searched, and null ids link others."""
    a, b, c = prose(60), prose(60), prose(60)
    near = lambda t: t + " end"
    rows = spark.createDataFrame([(1, a), (5, near(a)), (5, b), (7, near(b)), (None, c), (8, near(c)), (9, c + " stop")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.similar_documents(rows).collect()}
    assert got == {(1, 1), (5, 1), (5, 5), (7, 5), (None, None), (8, 8), (9, 8)}


def test_cells_meet():
    """Any two similar sets share as many keys of a tag as either needs."""
    few = 0
    for part, whole in ((90, 100), (80, 100)):
        for _ in range(1000):
            n = int(RNG.integers(1, 300) if RNG.integers(0, 2) else RNG.integers(1, 20))
            a = RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            lost = int(RNG.integers(0, n + 1) * (1 - part / whole))
            b = np.r_[a[lost:], RNG.integers(0, 1 << 63, int(RNG.integers(0, lost + 1)), dtype=np.uint64) * np.uint64(2)]
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if whole * both >= part * (len(a) + len(b) - both):
                x, y = ({tag: (need, set(keys.tolist())) for tag, need, keys in ngram_join.cells(g, part, whole)} for g in (a, b))
                shared = {tag: (max(x[tag][0], y[tag][0]), len(x[tag][1] & y[tag][1])) for tag in x.keys() & y.keys()}
                assert any(0 < need <= k for need, k in shared.values())
                few += any(tag > 127 for tag in shared)
    assert few


@pytest.mark.parametrize("heavy,hold", [(64, 1 << 21), (2, 1 << 21), (2, 400)])
def test_meeting(monkeypatch, heavy, hold):
    """Similar sets end up joined, however keys are handed on, and most others don't."""
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "HOLD", hold)
    rows = odd_documents()
    marks, sets = {}, {}
    home = list(range(5))
    mail = []
    for k in range(3):
        texts = [(t or "").encode() for _, t in rows[k::3]]
        column = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
        for (i, _), g in zip(rows[k::3], text.shingles(*column, 5)):
            marks[i], sets[i] = ngram_join._mark(g), set(g.tolist())
        mail += ngram_join.deal([column], 5, 80, 100, home)
    for work in (ngram_join.meet, ngram_join.choose):
        every = pa.Table.from_batches(mail)
        mail = [work(every.filter(pa.compute.equal(every["home"], p)).to_batches(), home) for p in home]
    every = pa.Table.from_batches(mail)
    root = {m: m for m in marks.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in home:
        found = ngram_join.join(every.filter(pa.compute.equal(every["home"], p)).to_batches())
        for a, b in zip(*(c.to_pylist() for c in found.columns)):
            root[find(a)] = find(b)
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert find(marks[i]) == find(marks[j])
    assert len({find(m) for m in marks.values()}) > 40


def test_divide_skip():
    lists = [sorted(RNG.choice(60, RNG.integers(1, 30), replace=False).tolist()) for _ in range(12)]
    counts = collections.Counter(x for one in lists for x in one)
    for need in range(1, 9):
        assert dict(ngram_join._merge_skip(lists, need)).keys() == {x for x, c in counts.items() if c >= need}


def test_components(spark):
    edges = [(int(a), int(b)) for a, b in RNG.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    scratch = store.Scratch(spark, "test")
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*edges, (None, 5)], "a long, b long"), scratch, "c").collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


def test_words():
    rows = ["A bc\tA", "", "é bc", " x ", "\x0ba\x0c"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(r.encode()) for r in rows])]
    w = text.Words(data, offsets)
    assert w.counts().tolist() == [3, 0, 2, 1, 1] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 5
    low = text.Words(data, offsets, lower=True)
    assert low.hash[0] == low.hash[6] != w.hash[0]
    assert len(set(hashes(*thue_morse()))) == 2 and len(set(hashes("a" * 8, "a" * 16, "a" * 9, "a" * 7, "ab" * 8, "ba" * 8))) == 6


def hashes(*words):
    data = " ".join(words).encode()
    return text.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash.tolist()


def thue_morse():
    """Two words of 1,024 letters that any polynomial modulo a power of two gives one hash."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return one, one.translate({97: 98, 98: 97})


def test_words_of_one_pattern(spark):
    """Long words that differ link nothing and remove nothing."""
    one, other = thue_morse()
    rows = spark.createDataFrame([(1, " ".join([one] * 30)), (2, " ".join([other] * 30))], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.similar_documents(rows).collect()} == {1, 2}
    assert substring.remove_repeats(rows.where("doc_id = 2").union(spark.createDataFrame([(1, " ".join([one] * 20))], rows.schema)), 20).where("doc_id = 2").head()["n_removed"] == 29


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_cache(name, documents, monkeypatch):
    """The same ids as the library as it comes, special tokens and odd white space in texts included."""
    monkeypatch.setattr(tokens, "MOST", 50)
    monkeypatch.setattr(tokens, "BLOCK", 2000)
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = [t for _, t in documents] + ["a  b\n\nc ", " x", "\n", "it's 12 <|endoftext|> it'd\n", "ab \n cd", "Σίσυφος ΟΔΟΣ é ́x", "x\0y z", "Wo. wo, é. 1. İx İ, İ.", "'s 's, don't."]
    odd = ["a", "B", "é", "É", "İ", "ı", "ß", "Σ", "ς", " ", "  ", "\n", "\t", ".", ",", "'s", "'S", "1", "日", "́", "\xa0", "\u2003", "\u3000", "\u200b", "“", "<|endoftext|>", "<|", "|>", "<|startoftext|>", "\r", "\x1c", "\0", "ﬁ", "x.", "don't", "🙂", "ŉ", "Å", "ÿ."]
    texts += ["".join(RNG.choice(odd, RNG.integers(0, 12))) for _ in range(3000)]
    for text_, got in zip(texts, tokens.Coder(path, "<u2").encode(pa.array(texts))):
        assert got.tolist() == plain.encode(text_ or "", add_special_tokens=False).ids, (text_ or "")[:50]


def plain_ids(name, rows, end):
    """Ids of each document with the end id, by the library alone."""
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [end], "<u4").tobytes() for i, t in rows}


def test_token_records(spark, docs, documents, tmp_path):
    path, vocabulary = f"file://{tmp_path}/r", public_tokenizers.path("word_bpe_49k.json")
    token_records.write_token_records(docs, path, vocabulary, end_id=2)
    at, wanted, every = 0, {}, plain_ids("word_bpe_49k.json", documents, 2)
    for i in sorted(every):
        wanted[i] = (at, len(every[i]) // 4, every[i])
        at += len(every[i]) // 4
    pick = lambda df: {r["doc_id"]: (r["start"], r["n_tokens"], bytes(r["ids"])) for r in df.collect()}
    assert pick(token_records.read_token_records(spark, path)) == wanted
    order = [r["doc_id"] for r in token_records.read_shuffled(spark, path, 5).orderBy("epoch_key").collect()]
    assert sorted(order) == sorted(wanted) != order and pick(token_records.read_shuffled(spark, path, 5)) == wanted
    file = next(tmp_path.glob("r/*.rec"))
    data = bytearray(file.read_bytes())
    data[20] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        token_records.read_token_records(spark, path).count()
    token_records.write_token_records(empty(spark), f"file://{tmp_path}/e", vocabulary, 2)
    assert token_records.read_token_records(spark, f"file://{tmp_path}/e").count() == 0
    twice = spark.createDataFrame([(None, "x"), (3, "y"), (3, "y"), (3, None)], "doc_id long, text string")
    token_records.write_token_records(twice, f"file://{tmp_path}/t", vocabulary, 2)
    assert sorted((r["start"], r["doc_id"]) for r in token_records.read_token_records(spark, f"file://{tmp_path}/t").collect())[0] == (0, None)


def test_frames():
    framed = token_records.frame(b"abc")
    assert len(framed) == 8 + 4 + 3 + 4 and token_records.unframe(framed, 0) == (b"abc", 19)
    for i in range(len(framed)):
        broken = bytearray(framed)
        broken[i] ^= 4
        with pytest.raises(ValueError):
            token_records.unframe(bytes(broken), 0)


def test_packing(spark, docs, documents):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, vocabulary, 0, 256).toPandas()
    total = 0
    for i, ids in plain_ids("byte_bpe_50k.json", documents, 0).items():
        mine = got[got.doc_id == i].sort_values("piece")
        n = len(ids) // 4
        total += n
        assert mine.piece.tolist() == list(range(-(-n // 256))) and mine.length.sum() == n and (mine.length.iloc[1:] == 256).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    gaps: list[int] = []
    for n in sorted(got.length, reverse=True):  # best fit, longest first
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit or 256) - n)
    assert got.sequence_id.nunique() <= len(gaps)
    assert packing.pack_documents(empty(spark), vocabulary, 0, 256).count() == 0
    assert packing.token_pieces(docs, vocabulary, 0, 256, with_ids=True).where(F.crc32("ids") != F.col("ids_crc32")).count() == 0


def test_sum_of_squares_rule():
    lengths = RNG.integers(1, 33, 300)
    place, offset = packing.sum_of_squares(lengths, 32)
    gaps: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        open_ = [(b, g) for b, g in gaps.items() if g >= n]
        if open_:
            count = collections.Counter(g for g in gaps.values() if g)

            def after(g):
                c = count.copy()
                c[g] -= 1
                c[g - n] += g > n
                return sum(v * v for v in c.values())

            assert gaps[place[i]] >= n and after(gaps[place[i]]) == min(after(g) for _, g in open_)
        else:
            assert place[i] not in gaps
        gaps[place[i]] = gaps.get(place[i], 32) - n


@pytest.mark.parametrize("often,hold", [(256, 1 << 21), (2, 500)])
def test_substring(spark, docs, documents, monkeypatch, often, hold):
    monkeypatch.setattr(substring, "OFTEN", often)  # 2: most names are frequent ones
    monkeypatch.setattr(substring, "HOLD", hold)
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs, 10).collect()}
    seen, texts = set(), {i: (t or "").encode().split() for i, t in documents}
    for i, t in sorted(documents):
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - 9):
            w = tuple(words[k : k + 10])
            gone.update(range(k, k + 10) if w in seen else ())
            seen.add(w)
        kept = b" ".join(x for k, x in enumerate(words) if k not in gone).decode()
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(words), len(gone), kept), i
        for f in r["factors"]:
            source = texts[f["source_id"]][f["source_start"] :][: f["length"]]
            assert source == words[f["start"] :][: f["length"]] and (f["source_id"], f["source_start"]) < (i, f["start"])
    assert got[90]["home"] == 1 and got[90]["row"] == "r" and got[90]["text"] is None
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_substring_repeated_rows(spark):
    t = prose(30)
    rows = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring.remove_repeats(rows).collect())
    assert got == [(-1, 0), (5, 30), (5, 30), (7, 30)]
    alone = spark.createDataFrame([(5, t), (5, t)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.remove_repeats(alone).collect()] == [0, 0]


def test_substring_long_text(spark):
    """A text of 99,000 words in which one phrase recurs every 11 words: its windows all have one name, or nearly."""
    rows = []
    for i, phrase in enumerate(("low phrase of five words", "another phrase of six words here", "yet one more of them")):
        rows.append((i, " ".join(f"{phrase} " + " ".join(f"r{i}x{k}y{j}" for j in range(11 - len(phrase.split()))) for k in range(9000))))
    rows.append((9, " ".join(rows[1][1].split()[30_000:30_050])))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (99_000, 0), 1: (99_000, 0), 2: (99_000, 0), 9: (50, 50)}


def test_longest_and_greedy():
    make = lambda rows: np.array(rows, substring._FACTORS)
    spans = make([(1, 5, 3, 7, 5), (1, 0, 5, 7, 0), (1, 8, 2, 7, 9), (1, 2, 4, 7, 2), (2, 0, 1, 7, 0)])
    assert substring.longest(spans).tolist() == [(1, 0, 8, 7, 0), (1, 8, 2, 7, 9), (2, 0, 1, 7, 0)]
    assert substring.greedy([(1, 0, 4, 7, 0), (1, 1, 2, 7, 3), (1, 2, 6, 8, 0), (1, 3, 4, 8, 9), (1, 12, 1, 7, 0)]) == [(1, 0, 4, 7, 0), (1, 2, 6, 8, 0), (1, 12, 1, 7, 0)]
    for _ in range(200):
        some = [(0, int(a), int(n), int(s), 0) for a, n, s in zip(RNG.integers(0, 40, 12), RNG.integers(1, 9, 12), RNG.integers(0, 3, 12))]
        kept = substring.greedy(sorted(some, key=lambda x: x[1]))
        covered = lambda rows: {x for _, a, n, _, _ in rows for x in range(a, a + n)}
        assert covered(kept) == covered(some)


def test_substring_compares_whole_hashes(monkeypatch):
    """Windows of one name that differ in the high bits of their hash alone are not equal."""
    real = text.runs
    monkeypatch.setattr(text, "runs", lambda h, k: real(h, k) << np.uint64(40) if k == 20 else np.full(max(0, len(h) - k + 1), 7, np.uint64))
    mail = substring.Mail([0])
    for i in range(3):
        data = " ".join(f"{i % 2}x{k}" for k in range(24)).encode()
        ids = np.array([i])
        substring.send(mail, ids, ids, substring.parse_local(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ids, ids, 20)[1])
    sent = mail.batch()
    found = substring.parse_shared([sent.slice(0, 2)], [0]), substring.parse_shared([sent], [0])
    assert sent.num_rows == 3 and found[0].num_rows == 0
    assert np.frombuffer(found[1]["blob"][0].as_py(), substring._FACTORS)[["doc", "n", "source"]].tolist() == [(2, 5, 0)]


@pytest.mark.parametrize("seeds", [1_000_000, 10])
def test_decontaminate(spark, docs, documents, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)  # 10: seeds are joined by a shuffle
    items = [(i, prose(RNG.integers(13, 40))) for i in range(20)] + [(20, "too short to leak"), (21, None), (22, "")]
    planted = []
    for n in range(40):
        words = items[n % 20][1].split()
        cut = words[int(RNG.integers(0, len(words) - 12)) :][: int(RNG.integers(11, 20))]
        for k in RNG.integers(0, len(cut), RNG.integers(0, 4)):
            cut[k] = "zzz"
        planted.append((1000 + n, f"{prose(RNG.integers(0, 9))} {' '.join(cut).title()} {prose(RNG.integers(0, 9))}"))
    rows = documents + planted
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(1))
    every = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"items": F.lit(3), "found": F.lit(4)})
    got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(every, bench).collect()}
    for i, t in rows:
        if len((t or "").split()) > 3000:
            assert got[i] == []
            continue
        words, leaked = (t or "").lower().split(), []
        for item, it in items:
            iw = (it or "").lower().split()
            if any(sum(0 <= s + k + j < len(words) and words[s + k + j] == iw[k + j] for j in range(13)) >= 11 for s in range(-len(iw), len(words)) for k in range(len(iw) - 12)):
                leaked.append(item)
        assert got[i] == leaked, i
    assert sum(map(bool, got.values())) > 10
    assert decontaminate.leaks(empty(spark), bench).count() == 0 and decontaminate.leaks(every, bench.limit(0)).count() == 0


def test_decontaminate_is_native(spark, docs):
    bench = spark.createDataFrame([(1, prose(20))], "item_id long, text string")
    plan = decontaminate.decontaminate(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_masks_lose_nothing():
    import itertools

    for two in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not {o + p for p in m} & set(two) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - max(m)))


def _auc(score, y):
    r = pd.Series(score).rank().to_numpy()
    n = int(y.sum())
    return (r[y].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        sentences = [prose(int(rng.integers(5, 15)), rng) for _ in range(int(rng.integers(1, 9)))]
        at = int(rng.integers(0, len(sentences)))
        if bad:
            sentences[at] += " " + rng.choice(["awful", "nasty", "rotten"])
        rows.append((i, ". ".join(sentences) + ".", int(bad), at))
    df = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (9001, ""), (9002, "..!?\n")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows if i < 400] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    held = [r for r in rows if r[0] >= 400]
    assert _auc([got[r[0]]["score"] for r in held], np.array([r[2] == 1 for r in held])) > 0.97
    for i, t, y, at in held:
        if y and got[i]["predicted"]:
            spans = [t.encode()[s["start"] : s["stop"]].decode() for s in got[i]["offending"]]
            assert any(any(w in s for w in ("awful", "nasty", "rotten")) for s in spans)
    assert all(0 <= got[i]["score"] <= 1 for i in (None, 9001, 9002)) and len(got) == 603
    none = toxicity.fit_toxicity(df, labels.limit(0))
    assert toxicity.score_toxicity(df, none).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        words = prose(int(rng.integers(30, 200)), rng).split()
        rows.append((i, " | ".join(words) if bad and i % 2 else " ".join([words[0]] * 80) if bad else " ".join(words)))
    df = spark.createDataFrame([*rows, (None, None), (9001, "")], "doc_id long, text string").withColumns({"score": F.lit("clash"), "x": F.lit(1)})
    good = spark.createDataFrame([(i,) for i in range(600) if i % 3], "doc_id long")
    model = quality.fit_quality(df, good)
    got = {r["doc_id"]: r for r in quality.score_quality(df, model).collect()}
    assert np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in range(600, 900)]) > 0.95
    assert 0 <= got[None]["score"] <= 1 and got[9001]["x"] == 1 and len(got) == 902
    assert quality.score_quality(empty(spark), quality.fit_quality(empty(spark), good)).count() == 0


def test_prior():
    rng = np.random.default_rng(1)
    good, mixed = rng.normal(2, 1, 4000), np.r_[rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)]
    assert abs(quality.estimate_prior(good, mixed) - 0.7) < 0.05


def test_sharding(spark):
    hot = prose(50)
    rows = [(i, hot) for i in range(700)] + [(700 + i, prose(int(RNG.integers(1, 120)))) for i in range(1300)] + [(3000, None), (3001, ""), (3002, " "), (3003, "\na b\n"), (3004, "\t\t"), (3005, "y" * 9000), (None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit(0), "piece": F.lit(1), "bucket": F.lit(2)})
    got = sharding.shard(df, 8).toPandas()
    assert len(got) == len(rows)
    by = got.groupby("shard")
    assert all(sorted(s) == list(range(len(s))) for s in by.slot.apply(list)) and set(got.shard) == set(range(8))
    for c in ("size", "n_tokens"):
        total = by[c].sum()
        assert total.max() < 1.03 * total.mean() + got[c].max()
    texts = dict(rows)
    for r in got[got.doc_id.notna()].rename(columns={"size": "bytes_"}).itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert (r.bytes_, r.text_crc32, r.n_tokens) == (len(data) + 16, zlib.crc32(data), len(data.split()))
    assert sharding.shard(empty(spark), 8).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sharding_keeps_groups(spark, size):
    """A group that fits into a shard is in one, however small the table is."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    got = sharding.shard(docs, 40).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    by = got.groupby("text")
    groups = by.agg(shards=("shard", "nunique"), n=("shard", "size"), size=("size", "sum"), n_tokens=("n_tokens", "sum"))
    fits = (groups.n <= len(got) / 40) & (groups["size"] <= got["size"].sum() / 40) & (groups.n_tokens <= got.n_tokens.sum() / 40)
    assert (fits & (groups.n > 1)).any() and set(groups[fits].shards) == {1}


@pytest.mark.parametrize("asks", [20_000, 30])
def test_nearest(spark, monkeypatch, asks):
    monkeypatch.setattr(ann, "TASK_ASKS", asks)  # 30: a bin meets its queries in several slices
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 16))
    v = (centres[rng.integers(0, 6, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    v[100:400] = v[7]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (None, [1.0] * 16), (5004, [None] * 16), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "tree": F.lit(2)})
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 20))
    hit = 0
    for q, g in got.groupby("query_id"):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -np.inf
        top = np.lexsort((np.arange(3000), -s))[:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g.score, s[g.vec_id]) and g.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == g.vec_id.tolist()
        hit += len(set(top) & set(g.vec_id))
    assert hit / (10 * got.query_id.nunique()) >= 0.9
    assert not set(got.vec_id) & {5000, 5001, 5002, 5003, 5004}
    assert ann.nearest(df.where("vec_id in (5000, 5001, 5002, 5004)"), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id = 5003"), F.lit(True)).count() == 0
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, k=10)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2]


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{prose(3)}</p>") for i in range(700)] + [(None, None, None), (701, None, ""), (701, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit(1), "digest": F.lit(2), "place": F.lit(3)})
    mine = warc.records(pages, 64, with_body=True)
    for r in mine.where("page_id < 5").collect():
        assert hashlib.sha256(r["body"].encode()).hexdigest() == r["digest"] and len(r["body"].encode()) == r["length"] and r["body"].startswith("WARC/1.0\r\n")
    ends = mine.toPandas().sort_values(["file", "ordinal"])
    for _, g in ends.groupby("file"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert warc.audit(mine, mine).count() == 0
    spoilt = mine.withColumn("digest", F.when(F.col("page_id").isin(3, 400, 699), "x").otherwise(F.col("digest"))).where("not (file = 2 and ordinal >= 60)")
    got = sorted(tuple(r) for r in warc.audit(mine, spoilt).collect())
    assert got == sorted([(0, 3, "damaged"), (6, 16, "damaged"), (10, 59, "damaged"), *((2, k, "missing") for k in range(60, 64))])
    assert {r["status"] for r in warc.audit(spoilt, mine).collect()} == {"damaged", "extra"}
    # a record lost from the middle moves those behind it, and is the only one reported
    fewer = warc.records(pages.where("page_id is null or page_id not in (130, 500)").withColumn("html", F.when(F.col("page_id") == 140, "").otherwise(F.col("html"))), 64)
    assert sorted(tuple(r) for r in warc.audit(mine, fewer).collect()) == [(2, 2, "missing"), (2, 12, "damaged"), (7, 52, "missing")]
    assert sorted(tuple(r) for r in warc.audit(fewer, mine).collect()) == [(2, 2, "extra"), (2, 11, "damaged"), (7, 52, "extra")]
    twice = pages.union(pages.where("page_id in (5, 701)"))
    assert sorted(r["status"] for r in warc.audit(mine, warc.records(twice, 64)).collect()) == ["extra"] * 3
    assert {r["status"] for r in warc.audit(mine.limit(0), mine).collect()} == {"extra"}
    assert warc.audit(mine.limit(0), mine.limit(0)).count() == 0
