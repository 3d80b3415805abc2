"""Removal of repeated passages by a join on hashes of word windows, which stands in for relative Lempel-Ziv parsing.

Every run of min_words words (a window) is looked up, and the first place of each is its source. Neighbouring windows whose
sources go along are strung together to a factor, as far as they do, and a document is parsed greedily into them: where one
factor ends, the one that reaches farthest goes on, and windows across the boundary count too. So the words that duplicate
spans cover are exact; a factor's source is the first place of its windows, not that of the longest match.

Where every document is parsed against every block, work grows with the square of the input. Here it doesn't: the
documents that a task holds form a first block and are looked up in it in place. What no earlier place in that block
explains is dealt out by content: a window goes to the block that the least of its five-word hashes names, as do all
windows equal to it wherever they are. Such a block is the whole corpus' reference for its windows, and the first places
found there are exact. A passage that a third of all documents share sends a window once from each block of a task, not from
each document. A phrase shorter than a window can name very many different windows; where a task sees such a name, all
windows of that name, from every task, are dealt by their own hashes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerlight.llm import text as T
from ledgerlight.llm.mail import MAIL, Mail, columns, opened, order_and_cuts
from ledgerlight.llm.store import homes, shuffle_width

_FACTORS = [("doc", "<i8"), ("start", "<u4"), ("n", "<u4"), ("source", "<i8"), ("at", "<u4")]
_FOUND = "n_words long, n_removed long, kept_text string, factors array<struct<start:long,length:long,source_id:long,source_start:long>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64())]))
_NO_ID = -(1 << 63)
#: Windows that a task holds before it hands them on, and windows of one name among them that make it a frequent one.
HOLD, OFTEN = 1 << 21, 256
#: Kinds of blobs: runs of windows, frequent names, windows by themselves, factors.
_RUNS, _OFTEN, _SPOTS, _KNOWN = range(4)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of width elements from each position on."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def _factors(doc: np.ndarray, start: np.ndarray, source: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Factors of duplicate windows: as long as possible with one window at each start and a source that goes along."""
    out = np.zeros(0, _FACTORS)
    if len(doc):
        order = np.lexsort((start, doc))
        doc, start, source, at = doc[order], start[order], source[order], at[order]
        jump = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(np.r_[True, jump])
        out = np.zeros(len(first), _FACTORS)
        out["doc"], out["start"], out["source"], out["at"] = doc[first], start[first], source[first], at[first]
        out["n"] = np.diff(np.r_[first, len(doc)])
    return out


def _repeats(window: np.ndarray, name: np.ndarray, ident: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows with an earlier place (by id, then start), and the index of each one's first place. Equal ones agree in hash and name."""
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = np.r_[False, ordered[1:] == ordered[:-1]][: len(order)]
    member = same.copy()
    member[:-1] |= same[1:]
    some = order[member]
    some = some[np.lexsort((start[some], ident[some], name[some], window[some]))]
    head = np.r_[True, (window[some][1:] != window[some][:-1]) | (name[some][1:] != name[some][:-1])] if len(some) else np.zeros(0, bool)
    first = some[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(some) else some
    later = (ident[some] != ident[first]) | (start[some] != start[first])
    return some[later], first[later]


def parse_local(data, offsets, ids, keys, min_words: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Parses a block of texts against itself: its factors, and the windows that are new to it.

    New windows come as runs that share a name: rows of doc (index in ids), name, start and size, and all windows in turn.
    """
    words = T.Words(data, offsets)
    first, counts = words.first, words.counts()
    window = T.runs(words.hash, min_words)
    gram = min(5, min_words)
    name = _least(T.runs(words.hash, gram), min_words - gram + 1)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    valid = np.flatnonzero(doc_of[: len(window)] == doc_of[min_words - 1 :]) if len(window) else np.zeros(0, np.int64)
    doc, window, name = doc_of[valid], window[valid], name[valid]
    start = valid - first[doc]
    ident = ids[doc]
    later, source = _repeats(window, name, ident, start)
    known = _factors(keys[doc[later]], start[later], ident[source], start[source])
    fresh = np.ones(len(window), bool)
    fresh[later] = False
    doc, window, name, start = doc[fresh], window[fresh], name[fresh], start[fresh]
    begins = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (name[1:] != name[:-1])][: len(doc)]
    head = np.flatnonzero(begins)
    return known, {"doc": doc[head], "name": name[head], "start": start[head], "size": np.diff(np.r_[head, len(doc)]), "window": window}


def _windows(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the windows of some of the runs that have such sizes, one after another."""
    begin = np.cumsum(sizes) - sizes
    many = sizes[rows]
    return np.repeat(begin[rows] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def send(mail: Mail, ids: np.ndarray, keys: np.ndarray, runs: dict[str, np.ndarray]) -> None:
    """Sends runs to the blocks of their names, and those of frequent names window by window to the blocks of their hashes."""
    names, back = np.unique(runs["name"], return_inverse=True)
    often = np.bincount(back, runs["size"], len(names)) >= OFTEN
    mail.send(_OFTEN, T.mix(names[often]), names[often])
    spread = often[back]
    send_spots(mail, ids, keys, runs, np.flatnonzero(spread))
    rest = np.flatnonzero(~spread)
    for p, rows in order_and_cuts(mail.partition(T.mix(runs["name"][rest]))):
        rows = rest[rows]
        used, which = np.unique(runs["doc"][rows], return_inverse=True)
        at = _windows(rows, runs["size"])
        mail.put(mail.home[p], _RUNS, _join(ids[used].astype("<i8"), keys[used].astype("<i8"), which.astype("<u4"), runs["name"][rows], runs["start"][rows].astype("<u4"), runs["size"][rows].astype("<u4"), runs["window"][at]))


def send_spots(mail: Mail, ids: np.ndarray, keys: np.ndarray, runs: dict[str, np.ndarray], rows: np.ndarray) -> None:
    """Sends the windows of some runs to the blocks of their own hashes."""
    many = runs["size"][rows]
    at, run = _windows(rows, runs["size"]), np.repeat(rows, many)
    start = runs["start"][run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    window, doc = runs["window"][at], runs["doc"][run]
    mail.send(_SPOTS, window, window, runs["name"][run], ids[doc].view(T.U), keys[doc].view(T.U), start.astype(T.U))


def send_factors(mail: Mail, factors: np.ndarray) -> None:
    for p, rows in order_and_cuts(np.mod(factors["doc"], len(mail.home))):
        mail.put(mail.home[p], _KNOWN, factors[rows].tobytes())


def _join(*arrays: np.ndarray) -> bytes:
    packed = [a.tobytes() for a in arrays]
    return b"".join((np.array([len(p) for p in packed], "<u8").tobytes(), *packed))


def _split(blob: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(blob, "<u8", n)) + np.uint64(8 * n)
    return [blob[int(a) : int(b)] for a, b in zip(np.r_[np.uint64(8 * n), ends[:-1]], ends)]


def parse_shared(batches: Iterator[pa.RecordBatch], home: list[int]) -> pa.RecordBatch:
    """Parses all windows of the names of one block against it, but for those of names that are frequent somewhere."""
    mail = Mail(home)
    got = opened(batches, mail, {_RUNS, _OFTEN})
    held: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in ("<i8", "<i8", "<i8", "<u8", "<u4", "<u4", "<u8")]
    base = 0
    for blob in got[_RUNS]:
        for into, part, t in zip(held, _split(blob, 7), ("<i8", "<i8", "<u4", "<u8", "<u4", "<u4", "<u8")):
            into.append(np.frombuffer(part, t))
        held[2][-1] = held[2][-1].astype(np.int64) + base
        base += len(held[0][-1])
    del got[_RUNS]
    ids, keys, doc, name, start, size, window = (np.concatenate(c) for c in held)
    del held
    runs = {"doc": doc, "name": name, "start": start.astype(np.int64), "size": size.astype(np.int64), "window": window}
    spread = np.isin(name, columns(got[_OFTEN], 1)[0])
    send_spots(mail, ids, keys, runs, np.flatnonzero(spread))
    rows = np.flatnonzero(~spread)
    at, many = _windows(rows, runs["size"]), runs["size"][rows]
    run = np.repeat(rows, many)
    start = runs["start"][run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    window, ident = window[at], ids[doc[run]]
    later, source = _repeats(window, name[run], ident, start)
    send_factors(mail, _factors(keys[doc[run[later]]], start[later], ident[source], start[source]))
    return mail.batch()


def parse_spots(batches: Iterator[pa.RecordBatch], home: list[int]) -> pa.RecordBatch:
    """Looks up windows of frequent names in the block of their hashes, and strings together the factors of this partition's documents."""
    mail = Mail(home)
    got = opened(batches, mail, {_SPOTS, _KNOWN})
    send_factors(mail, longest(np.concatenate([np.zeros(0, _FACTORS), *(np.frombuffer(b, _FACTORS) for b in got[_KNOWN])])))
    window, name, ident, key, start = columns(got[_SPOTS], 5)
    ident, key, start = ident.view(np.int64), key.view(np.int64), start.astype(np.int64)
    later, source = _repeats(window, name, ident, start)
    send_factors(mail, _factors(key[later], start[later], ident[source], start[source]))
    return mail.batch()


def longest(spans: np.ndarray) -> np.ndarray:
    """Spans that touch and whose sources go along as one; in order of doc and start."""
    if not len(spans):
        return spans
    shift = spans["at"].astype(np.int64) - spans["start"]
    order = np.lexsort((spans["start"], shift, spans["source"], spans["doc"]))
    spans, shift = spans[order], shift[order]
    other = np.r_[True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["source"][1:] != spans["source"][:-1]) | (shift[1:] != shift[:-1])]
    line = np.cumsum(other).astype(np.int64) << 33
    end = np.maximum.accumulate(line + spans["start"] + spans["n"])
    new = other.copy()
    new[1:] |= (line + spans["start"])[1:] > end[:-1]
    head = np.flatnonzero(new)
    out = spans[head]
    out["n"] = (end - line)[np.r_[head[1:] - 1, len(spans) - 1]] - out["start"]
    return out[np.lexsort((out["start"], out["doc"]))]


def greedy(spans: list[tuple]) -> list[tuple]:
    """The factors of one document: of its spans, by start, the one that reaches farthest wherever another ends."""
    out, end, i = [], 0, 0
    while i < len(spans):
        if spans[i][1] > end:
            end = spans[i][1]  # nothing goes on here
        best = None
        while i < len(spans) and spans[i][1] <= end:
            if best is None or spans[i][1] + spans[i][2] > best[1] + best[2]:
                best = spans[i]
            i += 1
        if best[1] + best[2] > end:
            out.append(best)
            end = best[1] + best[2]
    return out


def remove_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """Every row of docs with all its columns, then n_words, n_removed, kept_text and factors (columns of these names are replaced).

    prefix: put before the names of the new columns.

    Words are runs of bytes other than ASCII white space, unchanged. A word goes if a window of min_words words covers it
    that also starts earlier: in a document with a smaller id, or earlier in its own. kept_text has the others, joined by
    one space. factors: first word and length of each duplicate span, and where its source is; spans can overlap. A null text has no words; null ids come before all others; rows that share an id count as
    one document, in which only a smaller start is earlier, so that equal rows don't remove each other.

    Windows are equal if the 64 bits of their hash and those of their name are; both are shuffled whole.

    Shuffles: the windows that are new to a task's block, some 10 bytes each, and those of frequent names, 40 bytes each;
    then the texts, once, with their factors.
    """
    if not 1 <= min_words <= 1000:
        raise ValueError("min_words must be from 1 to 1000")
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    home = homes(parts)
    added = [f"{prefix}{c}" for c in ("n_words", "n_removed", "kept_text", "factors")]
    docs = docs.drop(*added)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(ident, text)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail, held, docs, size = Mail(home), [], [], 0

        def hand_on() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(i) for i, _ in docs)])
            runs = {c: np.concatenate([h[c] + n if c == "doc" else h[c] for h, n in zip(held, base)]) for c in held[0]}
            send(mail, *(np.concatenate(c) for c in zip(*docs)), runs)
            return mail.batch()

        for batch in batches:
            data, offsets = T.column(batch, "text")
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in T.blocks(offsets):
                known, runs = parse_local(data, offsets[i : j + 1], ids[i:j], keys[i:j], min_words)
                send_factors(mail, known)
                held.append(runs)
                docs.append((ids[i:j], keys[i:j]))
                size += len(runs["window"])
                if size >= HOLD:
                    yield hand_on()
                    held, docs, size = [], [], 0
        if held:
            yield hand_on()

    def each(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield work(batches, home)

        return T.tidy(run)

    found = docs.select(ident.alias("id"), key.alias("key"), text.alias("text")).mapInArrow(T.tidy(local), MAIL)
    for work in (parse_shared, parse_spots):
        found = found.repartition(parts, "home").mapInArrow(each(work), MAIL)
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    texts = docs.select(F.element_at(F.array(*map(F.lit, home)), (F.pmod(key, F.lit(parts)) + 1).cast("int")).alias("home"), F.lit(None).cast("binary").alias("blob"), key.alias("key"), row)
    spans = found.select("home", "blob", F.lit(None).cast("long").alias("key"), F.lit(None).cast(texts.schema["row"].dataType).alias("row"))
    both = spans.unionByName(texts).repartition(parts, "home").sortWithinPartitions(F.col("blob").isNull())
    at = docs.columns.index(text_col)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spans = [], None
        for batch in batches:
            blobs = batch.column(1).drop_null().to_pylist()
            held += [np.frombuffer(b, _FACTORS) for b in blobs]
            if len(blobs) == batch.num_rows:
                continue
            if spans is None:
                spans = longest(np.concatenate([np.zeros(0, _FACTORS), *held]))
                held = []
            batch = batch.slice(len(blobs))
            keys, rows = batch.column(2).to_numpy(), batch.column(3)
            low, high = np.searchsorted(spans["doc"], keys, "left"), np.searchsorted(spans["doc"], keys, "right")
            texts = rows.field(at).cast(pa.string()).cast(pa.binary()).to_pylist()
            if rows.null_count or rows.offset:
                rows = pa.concat_arrays([rows])
            columns: list[list] = [[], [], [], []]
            for text, a, b in zip(texts, low.tolist(), high.tolist()):
                words = (text or b"").split()
                mine = greedy(spans[a:b].tolist()) if b > a else []
                n, gone, end = len(words), 0, 0
                if mine:
                    kept = []
                    for _, start, many, _, _ in mine:
                        if start > end:
                            kept += words[end:start]
                            gone -= start - end
                        end = max(end, start + many + min_words - 1)
                    gone += end
                    words = kept + words[end:]
                for c, v in zip(columns, (n, gone, b" ".join(words), [{"start": s, "length": m + min_words - 1, "source_id": None if d == _NO_ID else d, "source_start": p} for _, s, m, d, p in mine])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([rows, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], _FOUND_TYPE)], ["row", "n_words", "n_removed", "kept_text", "factors"])

    done = both.mapInArrow(T.tidy(finish), StructType([StructField("row", texts.schema["row"].dataType), *StructType.fromDDL(_FOUND).fields]))
    return done.select("row.*", *(F.col(c).alias(f"{prefix}{c}") for c in ("n_words", "n_removed", "kept_text", "factors")))
