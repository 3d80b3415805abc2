"""Set-similarity join of documents on their word n-grams.

Links are decided by T-occurrence search: in a block of documents an inverted list holds, for each n-gram, the documents
that have it. A document's near copies are those that occur at least T times in the lists of its own n-grams. DivideSkip
finds them: the longest lists are set aside; the short ones are merged with a heap that skips what cannot reach the
threshold any more, and the long ones are probed for the survivors only: by binary search, or all at once for many of them.

Which documents meet in a block is decided so that no pair is missed and unrelated documents don't meet. The n-grams of
documents of like size are dealt, by hash, to half as many cells again as two similar sets may differ in n-grams, and one.
So similar sets agree entirely in a third of their cells. All cells are met by key first, which tells for each how many
sets have it; a set most of whose cells are its own has no similar one and goes no further. Of the shared cells of the
others those count that the fewest sets have, and so few of them that the rarest cell in which two similar sets agree is
left to both. Sets that agree in such a cell get into one cluster; sharing a passage doesn't suffice for that. What is found
doesn't depend on how many sets have a cell, as that orders a cell alike for all. Sets so small that they might agree in
empty cells alone have the first n-grams, by hash, of every similar set as keys in addition.

A cluster too large for a block is spread over several. A few of its documents are searched in all of its blocks first;
then only those documents that have not got into its largest component are, since any pair not yet joined has such a
document at one end. Texts with equal sets are one node throughout, named by the hash of their set, so that neither null
nor repeated ids matter for what is searched.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import text as T
from ledgerlight.llm.graph import components
from ledgerlight.llm.mail import MAIL, Mail, columns, opened
from ledgerlight.llm.store import Scratch, homes, shuffle_width

#: Documents in a block; documents of a large cluster that are searched in all its blocks at first.
BLOCK_ROWS, LEADERS = 400, 12
#: Growth of the sizes of a band, keys that a task holds before it hands them on, and sets among them that make a key a frequent one.
BAND, HOLD, HEAVY = 1.5, 1 << 21, 64
#: DivideSkip's constant: low, as probing is cheap against merging.
_MU = 0.001
#: Occurrences from which on skipping pays.
_SKIPS = 4
#: Candidates from which on the long lists are probed for all of them at once.
_MANY = 16
#: Kinds of blobs: keys and sets, frequent keys, what sets need, frequent keys of sets, shared keys of sets, edges, keys and least sets.
_LIGHT, _OFTEN, _NEEDS, _HEAVY, _SHARED, _EDGE, _STAR = range(7)
_ENDLESS = 1 << 62


@cache
def bands(part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each band, and in how many n-grams similar sets may differ whose larger one is in it. Sizes in a band are below the next one's least."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, math.ceil(least[-1] * BAND)))
    # sets of sizes below m with that similarity differ in at most (whole - part) / (whole + part) of their sizes' sum
    return np.array(least), np.array([(whole - part) * 2 * (m - 1) // (whole + part) for m in least[1:]], np.int64)


def cells(grams: np.ndarray, part: int, whole: int) -> list[tuple[int, int, np.ndarray]]:
    """Tag, need and keys of a sorted set in each of its bands; keys end in their tag.

    Sets that are similar enough share need of the keys of one tag that both have; where the need is below one, a further
    tag has keys of which they share one.
    """
    n = len(grams)
    if not n:
        return []
    least, differs = bands(part, whole)
    first = int(np.searchsorted(least, n, "right")) - 1
    last = int(np.searchsorted(least, n * whole // part, "right")) - 1
    total = np.zeros(n + 1, T.U)
    np.cumsum(T.mix(grams), out=total[1:])
    out = []
    for b in range(first, last + 1):
        differ = int(differs[b])
        k = differ + 1 + (differ + 1) // 2
        edge = np.searchsorted(grams, np.arange(1, k).astype(T.U) * T.U((1 << 64) // k)) if k > 1 else np.zeros(0, np.int64)
        edge = np.r_[0, edge, n]
        size = np.diff(edge)
        held = np.flatnonzero(size)
        keys = T.mix((total[edge[1:]] - total[edge[:-1]])[held] ^ T.mix((T.U(b << 40) + held.astype(T.U)) ^ (size[held].astype(T.U) << T.U(50))))
        # of k cells at least k - differ agree, and k - len(held) of those may be empty in both
        need = len(held) - differ
        out.append((b, need, _tagged(keys, b)))
        if need < 1:
            out.append((b | 128, 1, _tagged(T.mix(grams[: n + part * n // -whole + 1] ^ T.U(b << 40)), b | 128)))
    return out


def _tagged(keys: np.ndarray, tag: int) -> np.ndarray:
    return (keys & ~T.U(255)) | T.U(tag)


def similar_in_block(grams: list[np.ndarray], asked: list[int], part: int, whole: int) -> Iterator[tuple[int, list[int]]]:
    """For each asked set of a block, the others whose intersection with it is at least part / whole of the union."""
    sizes = [len(g) for g in grams]
    if not grams or not sum(sizes):
        return
    every, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), sizes)
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    head = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    length = np.diff(np.r_[head, len(every)])
    number = np.empty(len(every), np.int64)
    number[order] = np.repeat(np.arange(len(head)), length)
    begins = np.r_[0, np.cumsum(sizes)]
    kept: dict[int, list[int]] = {}
    long = np.zeros(len(head), bool)
    for q in asked:
        n = sizes[q]
        need = -(-part * n // whole)  # any set similar to this one has so many of its n-grams
        mine = number[begins[q] : begins[q + 1]]
        mine = mine[length[mine] > 1]
        if not n or len(mine) < need:
            continue
        mine = mine[np.argsort(length[mine], kind="stable")]
        lists = []
        for i in mine.tolist():
            if i not in kept:
                kept[i] = owner[head[i] : head[i] + length[i]].tolist()
            lists.append(kept[i])
        longest = len(lists[-1])
        apart = min(need - 1, int(need / (_MU * math.log2(max(2, longest)) + 1)))
        found, longer = [], mine[len(lists) - apart :]
        some = [(d, c) for d, c in _merge_skip(lists[: len(lists) - apart], need - apart) if d != q]
        if len(some) < _MANY:
            for d, c in some:
                wanted = -(-part * (n + sizes[d]) // (part + whole))  # the overlap that this pair needs
                for left, one in zip(range(apart - 1, -1, -1), reversed(lists)):
                    if c >= wanted or c + left + 1 < wanted:
                        break
                    at = bisect.bisect_left(one, d)
                    c += at < len(one) and one[at] == d
                if c >= wanted:
                    found.append(d)
        else:
            d, c = np.array(some).T
            size = np.diff(begins)[d]
            wanted = -(-part * (n + size) // (part + whole))
            stay = c + apart >= wanted
            d, c, size, wanted = d[stay], c[stay], size[stay], wanted[stay]
            # which of the candidates' n-grams have a long list: all probes at once
            long[longer] = True
            ends = np.cumsum(size)
            hit = np.r_[0, np.cumsum(long[number[np.repeat(begins[d] - ends + size, size) + np.arange(size.sum())]])]
            long[longer] = False
            found = d[c + hit[ends] - hit[ends - size] >= wanted].tolist()
        yield q, found


def _merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """Elements that occur in at least need of the ascending lists, and in how many.

    Where need is so low that hardly an element can be skipped, a heap would only take all of them one by one: they are counted.
    """
    need = max(1, need)
    if need < _SKIPS:
        yield from ((d, c) for d, c in Counter(chain.from_iterable(lists)).items() if c >= need)
        return
    heap = [(one[0], i, 0) for i, one in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            yield top, len(popped)
            skip_to = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            skip_to = heap[0][0]
        for _, i, at in popped:
            at = bisect.bisect_left(lists[i], skip_to, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


def _mark(grams: np.ndarray) -> int:
    """Hash of a set."""
    return int(np.add.reduce(T.mix(grams)).astype(np.int64))


def _stars(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of (key, doc): each key with its least doc, and each other doc of it with that one."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    head = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    least = docs[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(keys) else docs
    return keys[head], docs[head], docs[~head], least[~head]


def _once(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows, by the last column first."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in columns]


def deal(texts: Iterator[tuple[np.ndarray, np.ndarray]], words: int, part: int, whole: int, home: list[int]) -> Iterator[pa.RecordBatch]:
    """Every key of every set goes to the key's partition, and what a set needs to its own. Equal sets of a task go once.

    Keys that many sets of a task have are sent there once, and with each set to its partition.
    """
    mail, seen, keys, docs, needs, size = Mail(home), set(), [], [], [], 0

    def hand_on() -> pa.RecordBatch:
        every = np.concatenate([np.zeros(0, T.U), *keys])
        owner = np.repeat(np.array([d for d, _, _ in needs], np.int64), [len(k) for k in keys])
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        head = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
        many = np.diff(np.r_[head, len(every)])
        often = np.repeat(many >= HEAVY, many)
        mail.send(_LIGHT, every[~often], every[~often], owner[~often].view(T.U))
        mail.send(_OFTEN, every[head[many >= HEAVY]], every[head[many >= HEAVY]])
        mail.send(_HEAVY, owner[often], owner[often].view(T.U), every[often])
        doc, tag, need = (np.array(c, np.int64) for c in zip(*needs)) if needs else (np.zeros(0, np.int64),) * 3
        mail.send(_NEEDS, doc, doc.view(T.U), tag.view(T.U), need.view(T.U))
        return mail.batch()

    for data, offsets in texts:
        for g in T.shingles(data, offsets, words):
            mark = _mark(g)
            if mark in seen or not len(g):
                continue
            seen.add(mark)
            for tag, need, found in cells(g, part, whole):
                keys.append(found)
                needs.append((mark, tag, need))
                size += len(found)
            if size >= HOLD:
                yield hand_on()
                keys, needs, size = [], [], 0
                if len(seen) > HOLD // 4:
                    seen = set()
    yield hand_on()


def meet(batches: Iterator[pa.RecordBatch], home: list[int]) -> pa.RecordBatch:
    """Keys that several sets have go to each of them, with the number of sets."""
    mail = Mail(home)
    got = opened(batches, mail, {_LIGHT, _OFTEN})
    keys, docs = columns(got[_LIGHT], 2)
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    same = keys[1:] == keys[:-1]
    often = np.isin(keys, columns(got[_OFTEN], 1)[0])
    some = often.copy()
    some[1:] |= same
    some[:-1] |= same
    docs, keys, often = _once(docs[some], keys[some], often[some])[:3]
    order = np.argsort(keys, kind="stable")
    keys, docs, often = keys[order], docs[order], often[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    many = np.diff(np.r_[head, len(keys)])
    many = np.where(often, _ENDLESS, np.repeat(many, many))
    shared = many > 1
    mail.send(_SHARED, docs[shared].view(np.int64), docs[shared], keys[shared], many[shared].astype(T.U))
    return mail.batch()


def choose(batches: Iterator[pa.RecordBatch], home: list[int]) -> pa.RecordBatch:
    """The rarest keys of each set, and edges between sets of this partition that have one in common."""
    mail = Mail(home)
    got = opened(batches, mail, {_NEEDS, _HEAVY, _SHARED})
    need_doc, need_tag, need = columns(got[_NEEDS], 3)
    heavy_doc, heavy_key = columns(got[_HEAVY], 2)
    doc, keys, many = columns(got[_SHARED], 3)
    doc, keys = np.r_[heavy_doc, doc], np.r_[heavy_key, keys]
    many = np.r_[np.full(len(heavy_doc), _ENDLESS, np.int64), many.astype(np.int64)]
    has = np.isin(need_doc, doc)  # most sets share nothing
    need_doc, need_tag, need = need_doc[has], need_tag[has], need[has]
    # a set's need stands before its keys of that tag
    keys, many, tag, doc = _once(np.r_[need, keys], np.r_[np.full(len(need), -1), many], np.r_[need_tag, keys & T.U(255)], np.r_[need_doc, doc])
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])][: len(doc)])
    size = np.diff(np.r_[head, len(doc)]) - 1
    rank = np.arange(len(doc)) - np.repeat(head, size + 1) - 1
    stay = (rank >= 0) & (rank <= np.repeat(size - keys[head].view(np.int64), size + 1))
    key, least, other, centre = _stars(keys[stay], doc[stay].view(np.int64))
    pairs = _once(centre, other)
    mail.send(_EDGE, pairs[1], pairs[0].view(T.U), pairs[1].view(T.U))
    mail.send(_STAR, key, key, least.view(T.U))
    return mail.batch()


def join(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    """Edges between sets that have a key in common."""
    got = opened(batches, None, {_EDGE, _STAR})
    key, least = columns(got[_STAR], 2)
    _, _, other, centre = _stars(key, least.view(np.int64))
    a, b = columns(got[_EDGE], 2).view(np.int64)
    return _edges(np.r_[a, other], np.r_[b, centre])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack([a, b], 1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["a", "b"])


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows of different ids or texts apart, null ids and null texts too."""
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return F.xxhash64(ident.isNull(), ident, text.isNull(), text)


def similar_documents(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for each distinct id of docs.

    A document's set has the distinct n-grams of its lower-cased words; shorter texts have their whole sequence, texts
    without words and null texts have nothing and are linked with nothing. Documents link if whole * intersection >= part *
    union; component_id is the least id that links reach, the own one included. Of rows that share an id every text is
    searched, and the id comes back once for each of their sizes and components. Rows with a null id link others, but come
    back with a null component. No rows: no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram-join")
    rows = scratch.save(similar_rows(docs, words, part, whole, id_col, text_col, scratch), "rows")
    least = scratch.save(rows.where("doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    out = rows.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).distinct()


def similar_rows(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, key (row_key), n_rows, n_shingles and component for each distinct id and text of docs.

    Rows link as in similar_documents, and those that links join have one component, a number without further meaning. It is
    null for texts without words.
    """
    if not 0 < part <= whole or 2 * part <= whole:
        raise ValueError("the similarity must be above one half")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    parts = shuffle_width(spark)
    home = homes(parts)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, mark, check = [], [], []
            for g in T.shingles(*T.column(batch, "text"), words):
                n.append(len(g))
                mark.append(_mark(g))
                check.append(int(np.bitwise_xor.reduce(T.mix(g ^ T.U(77))).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n, mark, check))], ["doc_id", "key", "n", "mark", "check"])

    sets = rows.mapInArrow(T.tidy(outline), "doc_id long, key long, n long, mark long, check long")
    sets = sets.groupBy("doc_id", "key").agg(F.count("*").alias("n_rows"), F.min(F.struct("mark", "check", "n")).alias("s")).select("doc_id", "key", "n_rows", "s.*")
    sets = scratch.save(sets, "sets")
    # equal sets are one class, and any of its texts will do
    classes = scratch.save(sets.where("n > 0").groupBy("n", "mark", "check").agg(F.min("key").alias("key")), "classes")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return deal((T.column(batch, "text") for batch in batches), words, part, whole, home)

    def each(work, *more):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield work(batches, *more)

        return T.tidy(run)

    # copies are dealt like all others, under one name: no shuffle of texts leaves them out
    met = rows.select("text").mapInArrow(T.tidy(dealt), MAIL)
    for work in (meet, choose):
        met = met.repartition(parts, "home").mapInArrow(each(work, home), MAIL)
    met = met.repartition(parts, "home").mapInArrow(each(join), "a long, b long")
    clusters = components(met, scratch, "clusters")
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
    nodes = clusters.count()
    sizes = scratch.save(clusters.groupBy("component").agg(F.count("*").alias("many")).where("many > 1"), "sizes", nodes)
    clusters = scratch.save(clusters.join(sizes, "component"), "members", nodes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nodes = batch.column(0)
            grams = pa.array([g.tobytes() for g in T.shingles(*T.column(batch, "text"), words)], pa.binary())
            # equal rows follow each other
            new = np.r_[True, np.diff(nodes.to_numpy()) != 0][: len(nodes)]
            if len(new):
                new[0], last = nodes[0].as_py() != last, nodes[-1].as_py()
            yield pa.RecordBatch.from_arrays([nodes, grams], ["node", "grams"]).filter(pa.array(new))

    # the one shuffle of texts, and the plan that holds at any size: never a broadcast of ids, whose number grows with the input
    wanted = clusters.join(classes, F.col("node") == F.col("mark")).select("node", "key").hint("merge")
    packed = rows.select("key", "text").join(wanted, "key").select("node", "text").mapInArrow(T.tidy(pack), "node long, grams binary")
    packed = scratch.save(packed, "packed")

    # a block of small clusters has about BLOCK_ROWS documents; a larger cluster has blocks of its own
    small = clusters.where(F.col("many") <= BLOCK_ROWS)
    bins = max(1, math.ceil(small.count() / BLOCK_ROWS))
    small = small.select(F.col("node").alias("id"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("block"), F.lit(-1).alias("at"), F.lit(True).alias("asks"), F.lit(True).alias("held"))
    large = clusters.where(F.col("many") > BLOCK_ROWS)
    spread = F.ceil(F.col("many") / F.lit(BLOCK_ROWS)).cast("int")
    large = large.select(F.col("node").alias("id"), F.col("component").alias("block"), spread.alias("spread"))
    own = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("spread")).cast("int").alias("at")
    placed = large.select("id", "block", own, F.lit(False).alias("asks"), F.lit(True).alias("held"))

    def asked_everywhere(some: DataFrame) -> DataFrame:
        """Rows of large with a row for each block of their cluster."""
        return some.select("id", "block", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("at"), F.lit(True).alias("asks"), F.lit(False).alias("held"))

    def search(seats: DataFrame) -> DataFrame:
        """Links found in blocks, as edges from a document to the least one that it is joined with there."""

        def links(table: pa.Table) -> pa.Table:
            ids = table.column("node").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            asks, held = (table.column(c).to_numpy()[order] for c in ("asks", "held"))
            blobs = table.column("grams").to_pylist()
            grams = [np.frombuffer(blobs[i], T.U) for i in order.tolist()]
            # a document that asks in its own block has two rows there
            once = np.r_[True, ids[1:] != ids[:-1]]
            at = np.cumsum(once) - 1
            grams, ids = [g for g, k in zip(grams, once) if k], ids[once]
            asked = np.unique(at[asks.astype(bool)]).tolist()
            root = list(range(len(ids)))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for q, others in similar_in_block(grams, asked, part, whole):
                for d in others:
                    x, y = find(q), find(d)
                    root[max(x, y)] = min(x, y)
            top = np.array([find(i) for i in range(len(ids))], np.int64) if len(ids) else np.zeros(0, np.int64)
            return pa.Table.from_batches([_edges(ids, ids[top] if len(ids) else ids)])

        loaded = packed.join(seats.withColumnRenamed("id", "node").hint("merge"), "node")
        return loaded.groupBy("block", "at").applyInArrow(links, "a long, b long")

    if not large.isEmpty():
        few = large.groupBy("block").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64(F.lit(5), "id"), F.col("spread") * LEADERS) == 0, F.col("id")))), 1, 4 * LEADERS).alias("some"), F.min("id").alias("least"), F.min("spread").alias("spread"))
        few = few.select("block", "spread", F.explode(F.array_union("some", F.array("least"))).alias("id"))
        first = scratch.save(search(small.unionByName(placed).unionByName(asked_everywhere(few))), "links-1")
        joined = scratch.save(components(first, scratch, "first"), "first-joined")
        label = large.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
        counts = label.groupBy("block", "label").agg(F.count("*").alias("c"))
        main = scratch.save(counts.groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("main")), "main", nodes)
        rest = label.join(main, "block").where("label != main").select("id", "block", "spread")
        rest = scratch.save(rest, "rest", nodes)
        if not rest.isEmpty():
            second = scratch.save(search(placed.unionByName(asked_everywhere(rest))), "links-2")
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second), scratch, "linked")
    else:
        joined = components(scratch.save(search(small), "links"), scratch, "linked")
    joined = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    out = sets.join(joined, (F.col("n") > 0) & (F.col("mark") == F.col("node")), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "mark"))
    return out.select("doc_id", "key", "n_rows", F.col("n").alias("n_shingles"), component.alias("component"))
