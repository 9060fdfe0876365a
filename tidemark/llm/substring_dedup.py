"""Substring dedup: FM-index per shard, matching statistics of documents streamed past it.

Repeated windows of ``window`` words are found whatever their place in the corpus, without
comparing every document with every shard:

1. The anchor of a window is the least of its eight-word hashes, in (hot, hash) order (see
   ``hot``). Equal windows have equal anchors. Anchors of two documents or more are found by least and greatest
   document of each, combined before the shuffle.
2. Windows that follow each other in a document and share such an anchor make a region. Regions are
   shuffled by anchor, so all places where a window may repeat are in one shard.
   Equal texts are drawn together before, so that a passage of many documents travels once a task. A window has a hot anchor only
   if all its parts are frequent, so the regions of a hot anchor are few different texts, in however many documents.
3. A shard is a run of anchors of about ``shard_words`` words. Its distinct region texts, each
   owned by the least doc_id that holds it, form an FM-index (BWT in a wavelet
   matrix). They stream past it by backward search; an interval counts while it has an owner smaller than the
   searching one. Matching statistics are evaluated where they can reach ``window``; a match of that length or more is reported.
4. The reports go back to all regions of that text: the owner's get the matches, a
   later document's region, being an equal text, is reported whole. A document's intervals are joined to it and their words removed.

Regions are compared by their words, not by hashes; texts are drawn together by 128 bits of hash. An anchor with more text than a
shard holds is indexed in several parts, and its regions stream past each.

Cases: null and empty texts have no words; documents shorter than a window keep all;
repeats within one document, or between rows of one doc_id, are no repeats; a row without
doc_id is kept whole and removes nothing from others; other columns are left out; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot as hot_sketch
from .common import gather, grams, hash_words, numpy_of, signed, slices, total_bytes, written
from .fm_index import FMIndex, matched_windows

WINDOW = 50
GRAM = 8
SHARD_WORDS, BYTES_A_WORD = 1 << 19, 6


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_anchors(h: np.ndarray, hot: np.ndarray, window: int) -> np.ndarray:
    """Anchor of each window of word hashes h."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    g = grams(h, GRAM)
    g = (g >> np.uint64(1)) | (hot_sketch.is_hot(g, hot).astype(np.uint64) << np.uint64(63))
    return _sliding_min(g, window - GRAM + 1)


def _sketch(batches, width: int) -> Iterator[pa.RecordBatch]:
    tally = hot_sketch.Tally(width)

    def row(bucket, times):
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(times)], names=["bucket", "times"])

    for _, texts in slices(batches):
        # all texts of a slice as one: repeats in a text and grams across two texts only touch the order
        for told in tally.add(grams(hash_words(b" ".join(texts).split()), GRAM)):
            yield row(*told)
    for told in tally.rest():
        yield row(*told)


def _anchors(batches, hot: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        ids, found, ends = batch.column("doc_id").to_pylist(), [np.empty(0, np.uint64)], [0]
        for t in texts:
            found.append(np.unique(window_anchors(hash_words(t.split()), hot, window)))
            ends.append(ends[-1] + len(found[-1]))
        hs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(found))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), hs], names=["doc_id", "hs"])


OPENED = "kind int, doc_id long, tid long, n_words long, kept_sha256 string, kept_text string, text string, h long, start int, content binary, chash long"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
_NAMES = [x.split()[0] for x in OPENED.split(", ")]


def _text_id(t: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(t)).astype(np.int64))


def _digest(words: list[bytes], texts: bool) -> tuple[str, str | None]:
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None


def _open(batches, hot: np.ndarray, window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Whole documents are done (kind 0); of the others the text (kind 1) and the regions (kind 2) go on."""
    for batch, slice_ in slices(batches, most=4 << 20):
        rows = []
        for doc, t, marks in zip(batch.column("doc_id").to_pylist(), slice_, batch.column("hs").to_pylist(), strict=True):
            words = t.split()
            runs = []
            if marks:
                h = hash_words(words)
                a = window_anchors(h, hot, window)
                repeated = np.isin(a, np.array(marks, np.int64).view(np.uint64))
                cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
                ends = np.append(cut[1:], len(a)) if len(a) else []
                runs = [(int(x), int(y)) for x, y in zip(cut, ends, strict=True) if repeated[x]]
            if not runs:
                sha, kept = _digest(words, texts)
                rows.append((0, doc, None, len(words), sha, kept, None, None, None, None, None))
                continue
            tid = _text_id(t)
            rows.append((1, doc, tid, len(words), None, None, t.decode("utf-8", "replace"), None, None, None, None))
            for x, y in runs:
                content = b" ".join(words[x : y + window - 1])
                rows.append((2, doc, tid, y - x + window - 1, None, None, None, int(a[x].astype(np.int64)), x, content, _text_id(content)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def match_regions(h: np.ndarray, doc: np.ndarray, content: list[bytes], window: int, shard_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window start): matches of distinct texts, in order of their anchors h, with texts of smaller owners."""
    texts = [c.split() for c in content]
    length = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(length) - length
    number: dict[bytes, int] = {}
    symbols = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(length.sum()))
    del texts, number
    _, owner = np.unique(doc, return_inverse=True)
    found = [(np.empty(0, int), np.empty(0, int))]
    for first, stop in _shards(h, length, shard_words):
        of = np.arange(first, stop)
        queries = np.flatnonzero((h >= h[first]) & (h <= h[stop - 1]))  # all of the shard's anchors, parts of which may lie in other shards
        if len(queries) < 2:
            continue
        used = np.unique(gather(symbols, offset[queries], length[queries]))
        dense = np.minimum(np.searchsorted(used, symbols) + 1, len(used))
        text = np.zeros(int(length[of].sum()) + len(of), np.int64)
        at = np.cumsum(length[of] + 1) - length[of] - 1
        inside = np.arange(int(length[of].sum())) - np.repeat(np.cumsum(length[of]) - length[of], length[of])
        text[np.repeat(at, length[of]) + inside] = gather(dense, offset[of], length[of])
        index = FMIndex(text, np.repeat(owner[of], length[of] + 1), 2 * window)
        q, w = matched_windows(index, dense, offset[queries], length[queries], owner[queries], window)
        found.append((queries[q], w))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _shards(h: np.ndarray, length: np.ndarray, shard_words: int) -> Iterator[tuple[int, int]]:
    """Index ranges of about shard_words words, cut between anchors where these fit."""
    ends = np.cumsum(length + 1)
    first = 0
    while first < len(h):
        base = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, base + shard_words, "right")))
        if stop < len(h) and h[stop] == h[stop - 1]:
            cut = int(np.searchsorted(h[first:stop], h[stop - 1], "left")) + first if h[first] != h[stop - 1] else stop
            stop = cut if cut > first else stop
        yield first, min(stop, len(h))
        first = stop


def _matched(batches, window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, chash, owner, at) of distinct texts: where their matches start."""
    names = ["h", "chash", "owner", "content"]

    def told(table: pa.Table) -> pa.RecordBatch:
        h, chash, doc = (numpy_of(table, c) for c in names[:3])
        q, w = match_regions(h, doc, table.column("content").to_pylist(), window, shard_words)
        order = np.argsort(q, kind="stable")
        ends = np.searchsorted(q[order], np.arange(len(h) + 1))
        at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(w[order], pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(chash, pa.int64()), pa.array(doc, pa.int64()), at], names=["h", "chash", "owner", "at"])

    held, size = [], 0
    for batch in batches:
        h = numpy_of(batch, "h")
        start = 0
        if size >= BYTES_A_WORD * shard_words and len(h):  # a shard ends where its last anchor does
            last = held[-1].column("h")[-1].as_py()
            start = int(np.searchsorted(h, last, "right"))
            if start < len(h):
                yield told(pa.Table.from_batches([*held, batch.slice(0, start).select(names)]))
                held, size = [], 0
            else:
                start = 0
        held.append(batch.slice(start).select(names))
        size += held[-1].column("content").nbytes
    if held:
        yield told(pa.Table.from_batches(held))


def _remove(batches, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch, slice_ in slices(batches):
        rows = []
        for doc, t, spans in zip(batch.column("doc_id").to_pylist(), slice_, batch.column("spans").to_pylist(), strict=True):
            words = t.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                gone[s["start"]] += 1
                gone[s["stop"]] -= 1
            stays = np.cumsum(gone)[:-1] == 0
            kept = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
            rows.append((doc, len(words), len(words) - len(kept), *_digest(kept, texts)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _opened(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    spark = docs.sparkSession
    size = total_bytes(docs)
    width = hot_sketch.width_for(size)
    told = docs.mapInArrow(lambda it: _sketch(it, width), "bucket long, times long")
    hot = spark.sparkContext.broadcast(hot_sketch.bitmap(told, width, hot_sketch.threshold(size // 5, width)))  # width / 8 bytes
    anchors = written(docs.where("doc_id is not null").mapInArrow(lambda it: _anchors(it, hot.value, window), "doc_id long, hs array<long>"), "anchors")
    pairs = anchors.select("doc_id", F.explode("hs").alias("h"))
    repeated = pairs.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    marked = pairs.join(repeated, "h", "left_semi").groupBy(F.col("doc_id").alias("m_id")).agg(F.collect_list("h").alias("hs"))  # one text's anchors at most
    joined = docs.join(marked, F.col("doc_id") == F.col("m_id"), "left").select("doc_id", "text", "hs")
    return written(joined.mapInArrow(lambda it: _open(it, hot.value, window, texts), OPENED), "opened", "kind")


def spans(opened: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, tid, start, stop): word intervals that a smaller document holds too."""
    regions = opened.where("kind = 2").select("h", "chash", "doc_id", "tid", "start", F.col("n_words").cast("int").alias("length"), "content")
    texts = regions.groupBy("h", "chash").agg(F.min("doc_id").alias("owner"), F.first("content").alias("content"))
    matched = texts.repartition("h").sortWithinPartitions("h", "chash").mapInArrow(lambda it: _matched(it, window, shard_words), "h long, chash long, owner long, at array<int>")
    back = regions.drop("content").join(matched, ["h", "chash"])
    span = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    whole = F.array(span(F.col("start"), F.col("start") + F.col("length")))
    parts = F.transform("at", lambda w: span(F.col("start") + w, F.col("start") + w + window))
    return back.select("doc_id", "tid", F.explode(F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(parts)).alias("span")).select("doc_id", "tid", "span.start", "span.stop")


def without_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of each row; kept_text is null unless ``texts``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    opened = _opened(docs, window, texts)
    per_text = spans(opened, window, shard_words).groupBy(F.col("doc_id").alias("s_id"), F.col("tid").alias("s_tid")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    open_ = opened.where("kind = 1").join(per_text, (F.col("doc_id") == F.col("s_id")) & (F.col("tid") == F.col("s_tid")), "left").select("doc_id", "text", "spans")
    cleaned = open_.mapInArrow(lambda it: _remove(it, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    done = opened.where("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "kept_text")
    return done.unionByName(cleaned)


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, texts=False).drop("kept_text")


SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least_id AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least_id l ON l.k = win.k AND l.m < win.doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS p FROM hit, (SELECT unnest(range(0, 50)) AS j)),
kept AS (SELECT w.doc_id, len(w.ws) AS n, u.p, w.ws[u.p] AS word FROM w, LATERAL (SELECT unnest(range(1, len(w.ws) + 1)) AS p) u
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.p = u.p))
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(k.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS c, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id) k ON k.doc_id = w.doc_id
"""
