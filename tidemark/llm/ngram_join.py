"""N-gram Jaccard self-join as a blocked, masked sparse matrix product.

The rows of the incidence matrix A are classes of documents with equal shingle sets, its
columns the shingles; an entry (a, b) of the product of A and its transpose is the overlap of a and b. Two classes link if
100 * overlap >= share * union. What this asks of sizes says which entries are formed, and ends them early:

* Columns are ordered: rare ones first, by hash, then those of many documents (a
  count sketch tells which), so that shared boilerplate comes last. Two linked rows share one of the
  first n - ceil(share * n) + 1 columns of each row of n; blocks of these columns give the mask, the entries to be formed. A pair
  of a column at positions i, j of rows of n, m shingles counts only if 1 + min(n - i - 1, m - j - 1) reaches the overlap that a link needs.
* The product is formed column block by column block. The first block are these leading columns (overlaps of short lists, in the JVM). A pair whose
  overlap so far and what sizes still allow stay below the needed overlap is discarded.
* The others go on in row blocks: a row and at most ``GROUP`` of its partners. Their whole rows are cut in COLUMNS ranges
  of hashes, overlaps are accumulated range by range, and after each one the rows that can no longer reach the needed overlap leave.
  What is left after the last has its exact overlap.

Not every pair of a column is in the mask. First each row meets the column's hub alone
(the row whose columns are the fullest: the base of a group of copies); links
give components, and only then do rows of one column that are still in different
components meet each other. A group of thousands of copies so costs a star, and no
link between components is lost: inside a component no further link can change the result.

Cases: null and empty texts have n_shingles 0 and are alone; fewer than five words are
one shingle; a null doc_id links with nothing and has component_id null; repeated rows
and ids give a row each, and rows of one id link by their texts alone; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot as hot_sketch
from .common import block_count, blocks_of, gather, shingle_set, signed, slices, split_by_block, total_bytes, written
from .components import components

SHARE, GROUP, COLUMNS, CROWD = 75, 32, 8, 256
ENTRY = np.dtype([("h", "<u8"), ("sig", "<i8"), ("pos", "<i4")])
MEMBER = "doc_id long, key long, n long, sig long, bucket long, times long"


def prefix_length(n: int, share: int = SHARE) -> int:
    return n - (share * n + 99) // 100 + 1


def _signature(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def _members(batches, width: int, k: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows (bucket, times) of how many documents hold the shingles of a bucket."""
    names = [x.split()[0] for x in MEMBER.split(", ")]
    tally = hot_sketch.Tally(width)

    def rows(*columns):
        m = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names=names)

    for batch, texts in slices(batches):
        n, sig = [], []
        for t in texts:
            s = shingle_set(t.lower().split(), k)
            n.append(len(s))
            sig.append(_signature(s))
            if len(s):
                for bucket, times in tally.add(s):
                    yield rows(None, None, None, None, bucket, times)
        yield rows(batch.column("doc_id"), batch.column("key"), n, sig, None, None)
    for bucket, times in tally.rest():
        yield rows(None, None, None, None, bucket, times)


def _entries(batches, hot: np.ndarray, n_blocks: int, k: int, share: int) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        found = []
        for t in texts:
            s = shingle_set(t.lower().split(), k)
            if len(s):
                p = prefix_length(len(s), share)
                sig = _signature(s)
                often = hot_sketch.is_hot(s, hot)
                s = np.concatenate([s[~often], s[often]])
                e = np.empty(p, ENTRY)
                e["h"], e["sig"], e["pos"] = s[:p], sig, np.arange(p)
                found.append(e)
        if found:
            e = np.concatenate(found)
            block, payload = [], []
            for b, i in split_by_block(blocks_of(e["h"], n_blocks)):
                block.append(b)
                payload.append(np.unique(e[i]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(payload, pa.binary())], names=["block", "payload"])


def _shared_columns(part):
    """The entries of a block whose column has two rows or more."""
    e = np.concatenate([np.frombuffer(p, ENTRY) for p in part.column("payload").to_pylist()])
    e = e[np.lexsort((e["sig"], e["h"]))]
    if len(e) > 1:
        e = e[np.concatenate([[True], (e["h"][1:] != e["h"][:-1]) | (e["sig"][1:] != e["sig"][:-1])])]
    starts = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]])) if len(e) else np.empty(0, int)
    size = np.diff(np.append(starts, len(e)))
    m = np.repeat(size, size)
    keep = m > 1
    e, m = e[keep], m[keep]
    return pa.table({"h": signed(np.ascontiguousarray(e["h"])), "id": np.ascontiguousarray(e["sig"]), "pos": np.ascontiguousarray(e["pos"]), "m": m.astype(np.int32)})


class Bounds:
    """What a share asks of sizes, as columns."""

    def __init__(self, share: int):
        self.share = share

    def need(self, n, m):
        """Overlap that a link of n and m shingles needs: 100 * o >= share * (n + m - o)."""
        return F.ceil(self.share * (n + m) / (100 + self.share) - 1e-9)

    def rest(self, n):
        """Columns of a row behind its leading ones: n - prefix_length(n)."""
        return F.floor((self.share * n + 99) / 100) - 1

    def possible(self, a: str, b: str):
        """Whether rows ``a`` and ``b`` of a column can link, by sizes and places."""
        n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
        return (100 * n >= self.share * m) & (100 * m >= self.share * n) & (1 + F.least(n - i - 1, m - j - 1) >= self.need(n, m))


def _leading(pairs: DataFrame, shared: DataFrame, bounds: Bounds) -> DataFrame:
    """pairs(a, b) whose overlap in the leading columns leaves a link possible."""
    rows = written(shared.groupBy("id").agg(F.sort_array(F.collect_list("h")).alias("hs"), F.first("n").alias("n")), "rows")  # leading columns of one text
    left = rows.select(F.col("id").alias("a"), F.col("hs").alias("ha"), F.col("n").alias("na"))
    right = rows.select(F.col("id").alias("b"), F.col("hs").alias("hb"), F.col("n").alias("nb"))
    overlap = F.size(F.array_intersect("ha", "hb"))
    na, nb = F.col("na"), F.col("nb")
    return pairs.join(left, "a").join(right, "b").where(overlap + F.greatest(bounds.rest(na), bounds.rest(nb)) >= bounds.need(na, nb)).select("a", "b")


def linked_rows(base: np.ndarray, rows: list[np.ndarray], share: int, columns: int = COLUMNS) -> np.ndarray:
    """Which rows link with base, all sorted hashes: overlaps accumulated over ranges of columns, rows without hope left out of the next."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat, start = np.concatenate([*rows, np.empty(0, np.uint64)]), np.cumsum(sizes) - sizes
    cuts = np.array([(j << 64) // columns for j in range(1, columns)], np.uint64)
    own = np.concatenate([[0], np.searchsorted(base, cuts), [len(base)]])
    edge = np.stack([np.concatenate([[0], np.searchsorted(r, cuts), [len(r)]]) for r in rows]) if rows else np.empty((0, columns + 1), np.int64)
    overlap, alive = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for j in range(columns):
        length = edge[alive, j + 1] - edge[alive, j]
        entries = gather(flat, start[alive] + edge[alive, j], length)
        block = base[own[j] : own[j + 1]]
        if len(block) and len(entries):
            at = np.searchsorted(block, entries)
            at[at == len(block)] = 0
            overlap[alive] += np.bincount(np.repeat(np.arange(len(alive)), length), block[at] == entries, len(alive)).astype(np.int64)
        most = overlap[alive] + np.minimum(len(base) - own[j + 1], sizes[alive] - edge[alive, j + 1])
        alive = alive[(100 + share) * most >= share * (len(base) + sizes[alive])]
    out = np.zeros(len(rows), bool)
    out[alive] = True
    return out


def _linked(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, share: int) -> DataFrame:
    """Those of pairs(a, b) that link, by whole rows. Rows ``b`` travel to blocks of at most GROUP partners of an ``a``."""
    sized = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select("a", F.ceil(F.col("c") / GROUP).cast("int").alias("salts"))
    sized = written(sized, "sized")  # of known size for the planner, and a join of its own, which can split a hub with many partners
    salted = pairs.join(sized, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    go = salted.select(F.col("b").alias("sig"), "a", "salt", F.lit(False).alias("own"))
    own = sized.select(F.col("a").alias("sig"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"))
    ways = go.unionByName(own).groupBy("sig", F.floor(F.xxhash64("a", "salt") % 64).alias("part")).agg(F.collect_list(F.struct("a", "salt", "own")).alias("to"))
    ways = ways.join(reps.select("sig", "id"), "sig").drop("part")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ways, "id")

    def rows(batches):
        for batch, texts_ in slices(batches):
            out = [[], [], [], [], []]
            for t, sig, to in zip(texts_, batch.column("sig").to_pylist(), batch.column("to").to_pylist(), strict=True):
                s = shingle_set(t.lower().split(), k)
                if _signature(s) == sig:
                    raw = s.tobytes()
                    for x in to:
                        for c, v in zip(out, (x["a"], x["salt"], sig, x["own"], raw), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["a", "salt", "b", "own", "shingles"])

    def multiply(part):
        a = part.column("a")[0].as_py()
        base, partners = None, {}
        for b, own, s in zip(part.column("b").to_pylist(), part.column("own").to_pylist(), part.column("shingles").to_pylist(), strict=True):
            if own:
                base = np.frombuffer(s, np.uint64)
            else:
                partners[b] = np.frombuffer(s, np.uint64)
        ids = np.array(list(partners), np.int64)
        good = ids[linked_rows(base, list(partners.values()), share)] if base is not None and len(ids) else ids[:0]
        return pa.table({"a": pa.array([a] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    moved = texts.mapInArrow(rows, "a long, salt int, b long, own boolean, shingles binary")
    return moved.groupBy("a", "salt").applyInArrow(multiply, "a long, b long")


def _across(placed: DataFrame, bounds: Bounds) -> DataFrame:
    """Pairs (a, b) of rows of one column in different components. A column of many rows is spread: CROWD rows to a task meet all others."""
    crowd = placed.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"))
    spread = placed.join(crowd, "h")
    left = spread.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meet = left.alias("s").join(right.alias("t"), (F.col("s.h") == F.col("t.h")) & (F.col("s.part") == F.col("t.part")))
    return meet.where((F.col("s.id") < F.col("t.id")) & (F.col("s.root") != F.col("t.root")) & bounds.possible("s", "t")).select(F.col("s.id").alias("a"), F.col("t.id").alias("b")).distinct()


def _roots(docs: DataFrame, members: DataFrame, reps: DataFrame, told: DataFrame, width: int, k: int, share: int) -> DataFrame:
    """(sig, component): the component of every class that links with another, named by one of its classes."""
    spark, bounds = docs.sparkSession, Bounds(share)
    total, = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = spark.sparkContext.broadcast(hot_sketch.bitmap(told, width, hot_sketch.threshold(total, width)))  # width / 8 bytes
    n_blocks = block_count(total // 4, 1 << 18)
    product = (
        docs.where("doc_id is not null")
        .mapInArrow(lambda it: _entries(it, hot.value, n_blocks, k, share), "block int, payload binary")
        .groupBy("block")
        .applyInArrow(_shared_columns, "h long, id long, pos int, m int")
    )
    product = written(product, "product")
    nodes = product.groupBy("id").agg(F.sum("m").alias("score")).join(reps.select(F.col("sig").alias("id"), "n"), "id")
    shared = written(product.join(nodes, "id").select("h", "id", "n", "pos", "score"), "shared")
    hubs = shared.groupBy("h").agg(F.max(F.struct("score", F.negative("id").alias("back"), "n", "pos")).alias("x")).select("h", F.negative("x.back").alias("id"), "x.n", "x.pos")
    star = shared.alias("s").join(hubs.alias("t"), "h").where((F.col("s.id") != F.col("t.id")) & bounds.possible("s", "t")).select(F.col("t.id").alias("a"), F.col("s.id").alias("b")).distinct()
    star = written(star, "star")
    links = written(_linked(docs, written(_leading(star, shared, bounds), "pairs"), reps, k, share), "links")
    found = components(links)
    placed = shared.join(found, shared["id"] == found["node"], "left").select("h", "id", "n", "pos", F.coalesce("root", "id").alias("root"))
    open_columns = placed.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("h")
    placed = written(placed.join(open_columns, "h", "left_semi"), "open")
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = written(_leading(written(_across(placed, bounds).join(done, ["a", "b"], "left_anti"), "cross"), shared, bounds), "cross_pairs")
    if cross.take(1):
        found = components(links.unionByName(written(_linked(docs, cross, reps, k, share), "links")))
    return found.select(F.col("node").alias("sig"), F.col("root").alias("component"))


def _classified(docs: DataFrame, k: int, share: int) -> DataFrame:
    """(doc_id, key, n, sig, component) of each row of docs(doc_id, key, text); component is null of rows that cannot link."""
    width = hot_sketch.width_for(total_bytes(docs))
    first = written(docs.select("doc_id", "key", "text").mapInArrow(lambda it: _members(it, width, k), MEMBER), "members")
    members = first.where("bucket is null").drop("bucket", "times")
    able = members.where("n > 0 and doc_id is not null")
    reps = written(able.groupBy("sig").agg(F.min("doc_id").alias("id"), F.first("n").alias("n")), "reps")
    found = _roots(docs, members, reps, first.where("bucket is not null"), width, k, share)
    named = reps.select(F.col("sig").alias("c_sig")).join(found, F.col("c_sig") == F.col("sig"), "left").select("c_sig", F.coalesce("component", "c_sig").alias("component"))
    can = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return members.join(named, can & (F.col("sig") == F.col("c_sig")), "left").drop("c_sig")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def classes(docs: DataFrame, k: int = 5, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    rows = written(_classified(_keyed(docs), k, share), "classified")
    least = rows.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("least"))
    out = rows.join(least, F.col("component") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, share: int = SHARE) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, of more such rows the one of the least text hash, then of the least other columns.

    Rows without an id or without words link with nothing and stay.
    """
    rows = written(_classified(_keyed(docs), k, share), "classified").where("component is not null")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("x.doc_id", "x.key")
    first = written(rows.join(first, ["doc_id", "key"]).groupBy(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key")).agg(F.count(F.lit(1)).alias("f_rows")), "first")
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_key"), F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")).alias("worded"), F.struct(*names).alias("whole_row"))
    able = F.col("k_id").isNotNull() & F.col("worded")
    same = (F.col("k_id") == F.col("f_id")) & (F.col("k_key") == F.col("f_key"))
    out = keyed.where(able).join(first.where("f_rows = 1"), same, "left_semi").unionByName(keyed.where(~able)).select("whole_row.*")
    repeated = first.where("f_rows > 1")
    if repeated.take(1):
        out = out.unionByName(keyed.where(able).join(repeated, same, "left_semi").groupBy("k_id", "k_key").agg(F.min("whole_row").alias("whole_row")).select("whole_row.*"))
    return out


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
