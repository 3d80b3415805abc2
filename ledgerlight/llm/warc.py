"""WARC records of web pages, and a Merkle audit of replicas.

A file's records stand one after another; a leaf of its tree hashes a record's bytes with the range of offsets that it
takes. Inner nodes hash their children's hashes and the range that these cover together. The roots of all files are the
leaves of one more tree. Two replicas are compared from the top, and only below nodes that differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.store import Scratch

#: Children of a node, and page ids in a file.
FANOUT, FILE_PAGES = 16, 1024


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.0 response record. Null urls and pages are empty."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, html, F.lit("\r\n\r\n"))


def records(pages: DataFrame, file_pages: int = FILE_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_body: bool = False, more: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """page_id, file, ordinal, offset, length and digest of each page's record, and its body on demand; file_pages successive ids share a file.

    more: columns to add, made of a record's body and digest; they are computed before records are moved, so that bodies needn't be.

    In a file, records stand by id, then by digest. A null id goes to file -1 (spread over files -1 to -256 by digest).
    Equal rows are records of their own. The window that numbers a file's records has no more rows than the file.
    """
    page = F.col(id_col).cast("long")
    body = pages.select(page.alias("page_id"), record(page, F.col(url_col), F.col(html_col)).alias("body"))
    body = body.select("page_id", F.octet_length("body").cast("long").alias("length"), F.sha2("body", 256).alias("digest"), "body")
    body = body.withColumns({name: make(F.col("body"), F.col("digest")) for name, make in (more or {}).items()})
    rest = [*(more or {}), *(["body"] if with_body else [])]
    lost = -1 - F.pmod(F.xxhash64("digest"), F.lit(256))
    body = body.withColumn("file", F.when(F.col("page_id").isNull(), lost).otherwise(F.floor(F.col("page_id") / file_pages)).cast("long"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return body.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), F.coalesce(before, F.lit(0)).alias("offset"), "length", "digest", *rest)


def leaves(found: DataFrame) -> DataFrame:
    """Leaf nodes of records: file, level 0, place, first, stop (offsets) and hash."""
    stop = F.col("offset") + F.col("length")
    return found.select("file", F.lit(0).alias("level"), F.col("ordinal").alias("place"), F.col("offset").alias("first"), stop.alias("stop"), F.sha2(F.concat_ws(":", "offset", stop, "digest"), 256).alias("hash"))


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes over a level's, each with at most FANOUT children, whatever the size of the level."""
    children = F.array_sort(F.collect_list(F.struct("place", "first", "stop", "hash")))
    up = nodes.groupBy("file", F.floor(F.col("place") / FANOUT).cast("long").alias("place")).agg(children.alias("c"))
    return up.select("file", F.lit(level).alias("level"), "place", F.array_min("c.first").alias("first"), F.array_max("c.stop").alias("stop"), F.sha2(F.concat_ws(":", F.array_join("c.place", ","), F.array_join("c.first", ","), F.array_join("c.hash", ",")), 256).alias("hash"))


def tree(found: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Levels of nodes from the leaves of all files up to one root. Each level is a table; all together have a fifteenth more rows than records.

    Files' own trees come first; then their roots, by file, are the leaves of the tree over files, in file column null.
    """
    levels = [scratch.save(leaves(found), f"{name}-0")]
    while levels[-1].agg(F.max("place")).head()[0]:
        levels.append(scratch.save(_above(levels[-1], len(levels)), f"{name}-{len(levels)}"))
    low = levels[-1].agg(F.min("file")).head()[0] or 0
    roots = levels[-1].select(F.lit(None).cast("long").alias("file"), F.lit(len(levels)).alias("level"), (F.col("file") - low).alias("place"), "first", "stop", "hash")
    levels.append(scratch.save(roots, f"{name}-{len(levels)}"))
    while (levels[-1].agg(F.max("place")).head()[0] or 0) > 0:
        levels.append(scratch.save(_above(levels[-1], len(levels)), f"{name}-{len(levels)}"))
    return levels


def audit(one: DataFrame, other: DataFrame, what: str = "warc") -> DataFrame:
    """file, ordinal and status (damaged, missing or extra in other) of every record that differs between the replicas.

    Both come from records(), or have its columns. ordinal is the record's place in one, that of extra ones in other. Leaves
    that differ are aligned: a record that another replica has, with the same id and digest, at another place of the same file
    has moved and isn't reported; of the rest, those with the same id in both are damaged. Equal roots end the audit. Otherwise each level's nodes are read only
    where their parent differs. Replicas of different heights or with other first files are compared from the level up to
    which both have nodes. No rows on either side: every record of the other is extra or missing.
    """
    scratch = Scratch(one.sparkSession, what)
    a, b = tree(one, scratch, "one"), tree(other, scratch, "other")
    heights = [next(i for i, level in enumerate(t) if i and level.where("file is not null").limit(1).count() == 0) for t in (a, b)]
    lows = [t[h].agg(F.min("place"), F.max("place")).head() for t, h in zip((a, b), heights)]
    first = [t[0].agg(F.min("file")).head()[0] for t in (a, b)]
    start = len(a) - 1 if (len(a), heights[0], first[0]) == (len(b), heights[1], first[1]) and lows[0][0] is not None and lows[1][0] is not None else min(heights) - 1
    suspects = None
    for k in range(start, -1, -1):
        x, y = (t[k].select("file", "place", F.col("hash").alias(h)) for t, h in ((a, "h1"), (b, "h2")))
        if suspects is not None:
            if k == heights[0] - 1 and k + 1 <= start:  # from the tree over files to the files' own
                up = suspects.select((F.col("place") + F.lit(first[0])).alias("sf"))
                x, y = (t.join(up, F.col("file") == F.col("sf"), "left_semi") for t in (x, y))
            else:
                up = suspects.select(F.col("file").alias("sf"), F.col("place").alias("sp"))
                x, y = (t.join(up, F.col("file").eqNullSafe(F.col("sf")) & (F.floor(F.col("place") / FANOUT) == F.col("sp")), "left_semi") for t in (x, y))
        y = y.withColumnsRenamed({"file": "f2", "place": "p2"})
        both = x.join(y, F.coalesce("file", F.lit(-999)).eqNullSafe(F.coalesce("f2", F.lit(-999))) & (F.col("place") == F.col("p2")), "full_outer").where("not (h1 <=> h2)")
        status = F.when(F.col("h2").isNull(), "missing").when(F.col("h1").isNull(), "extra").otherwise("damaged")
        suspects = scratch.save(both.select(F.coalesce("file", "f2").alias("file"), F.coalesce("place", "p2").cast("long").alias("place"), status.alias("status")), f"suspects-{k}")
        if not suspects.limit(1).count():
            break
    return _aligned(one, other, suspects.select(F.col("file").alias("sf"), F.col("place").alias("sp"), "status"), scratch)


def _aligned(one: DataFrame, other: DataFrame, suspects: DataFrame, scratch: Scratch) -> DataFrame:
    """Records at the places in question that neither have a like one in the other replica's nor are like any."""
    at = lambda df, but: df.join(suspects.where(F.col("status") != but), F.col("file").eqNullSafe(F.col("sf")) & (F.col("ordinal") == F.col("sp")), "left_semi")
    sides = at(one, "extra").select("file", "page_id", "digest", "ordinal", F.lit(1).alias("side")).unionByName(at(other, "missing").select("file", "page_id", "digest", "ordinal", F.lit(2).alias("side")))

    def pair(rows: DataFrame, *by: str) -> DataFrame:
        """rows with sides: how many of the two replicas have an n-th record of the same kind."""
        number = F.row_number().over(Window.partitionBy(*by, "side").orderBy("ordinal"))
        rows = rows.withColumn("nth", number)
        return rows.withColumn("sides", F.count("*").over(Window.partitionBy(*by, "nth")))

    apart = scratch.save(pair(sides, "file", "page_id", "digest").where("sides = 1").drop("nth", "sides"), "apart")
    apart = pair(apart, "file", "page_id").where("side = 1 or sides = 1")
    status = F.when((F.col("sides") == 2) & F.col("page_id").isNotNull(), "damaged").when(F.col("side") == 1, "missing").otherwise("extra")
    return apart.select("file", F.col("ordinal").cast("long").alias("ordinal"), status.alias("status"))
