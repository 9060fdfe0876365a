"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least ``share`` of the item's distinct five-word
shingles occur in it (words as in ``common``, A-Z lower-cased). An item of fewer words is one shingle of
its own length, and is looked for among the document's runs of as many words.

Items are partitioned by size: one index for each length of shingle and power of two of shingles. The MinHash signature of an item are
the shingles that come first under each of ``permutations`` random orders. Under each order every shingle of the item is
equally likely to be that one, so a document that holds a share c of the item holds each value of the signature with
probability c, however long the document is: values held / permutations estimates the containment of the item
(of the small set, where resemblance would compare it with the whole document). Each partition has its own least number of values, from the
least share that counts at its sizes and the odds ``miss`` at which a contained item may fall below it. A document streams past the partitions;
items that reach their partition's number are verified: their shingles, as words, are counted in the document. A contained item is thus lost with
probability ``miss``, one in a thousand million; with ``permutations`` None signatures are whole shingle sets, the exact way.

The items are taken in blocks of at most ``block_words`` words, so what is sent to the executors is
bounded; each block is one pass over the documents, and of several blocks each result is written before the next is sent. There is no shuffle.

Cases: null or empty items match nothing, null or empty documents contain nothing; an item without an id is reported with a null one; ids
may be of any type; items with equal texts are reported one by one; rows that repeat a document are reported each; other
columns are left out; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import grams, hash_words, mix, slices, written

SHINGLE, SHARE, PERMUTATIONS, MISS = 5, 0.75, 32, 1e-9


def shingles_of(words: list[bytes], k: int) -> set[bytes]:
    """Distinct runs of k words; of a shorter text none."""
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def least_hits(share: float, permutations: int, miss: float) -> int:
    """The most values that a signature can be asked for: fewer are held with probability ``miss`` at most, if ``share`` is contained."""
    below = 0.0
    for h in range(permutations + 1):
        below += math.comb(permutations, h) * share**h * (1 - share) ** (permutations - h)
        if below > miss:
            return max(1, h)
    return permutations


class Partition:
    """The index of the items of one size class: (value, item, how many orders it comes first in)."""

    def __init__(self, k: int, sets: list[tuple[int, np.ndarray]], need: dict[int, int], permutations: int | None, miss: float):
        self.k = k
        entries = []
        for item, hashes in sets:
            if permutations is None:
                value, times = hashes, np.ones(len(hashes), np.int64)
            else:
                seeds = mix(np.arange(1, permutations + 1, dtype=np.uint64))
                first = hashes[mix(hashes[None, :] ^ seeds[:, None]).argmin(1)]
                value, times = np.unique(first, return_counts=True)
            entries.append((value, np.full(len(value), item), times))
        value, item, times = (np.concatenate(c) for c in zip(*entries, strict=True))
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.times = value[order], item[order], times[order]
        share = min(need[i] / len(h) for i, h in sets)
        self.least = 1 if permutations is None else least_hits(share, permutations, miss)

    def candidates(self, own: np.ndarray) -> list[int]:
        lo, hi = np.searchsorted(self.value, own, "left"), np.searchsorted(self.value, own, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo[hit], hi[hit], strict=True)])
        items, where = np.unique(self.item[at], return_inverse=True)
        return items[np.bincount(where, self.times[at]) >= self.least].tolist()


class Index:
    """The partitions of one block of items."""

    def __init__(self, items: list[tuple], k: int, share: float, permutations: int | None = PERMUTATIONS, miss: float = MISS):
        self.items, self.need = [], {}
        classes = defaultdict(list)
        for ident, text in items:
            words = text.lower().split()
            if words:
                size = min(k, len(words))
                item, own = len(self.items), shingles_of(words, size)
                self.items.append((ident, own))
                self.need[item] = max(1, math.ceil(share * len(own) - 1e-9))
                classes[size, len(own).bit_length()].append((item, np.unique(grams(hash_words(words), size))))
        self.partitions = [Partition(size, sets, self.need, permutations, miss) for (size, _), sets in sorted(classes.items())]

    def search(self, words: list[bytes]) -> list[tuple]:
        """(item's id, its shingles, shared ones) of the items that a document contains."""
        h, runs, found = hash_words(words), {}, []
        hashed = {k: np.unique(grams(h, k)) for k in {p.k for p in self.partitions}}
        for p in self.partitions:
            for item in p.candidates(hashed[p.k]):
                if p.k not in runs:
                    runs[p.k] = shingles_of(words, p.k)
                ident, own = self.items[item]
                shared = len(own & runs[p.k])
                if shared >= self.need[item]:
                    found.append((ident, len(own), shared))
        return found


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """(item_id, text) in blocks of about block_words words."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        text = r["text"].encode()
        block.append((r["item_id"], text))
        held += len(text.split())
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def contained(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, share: float = SHARE, block_words: int = 2_000_000, permutations: int | None = PERMUTATIONS, miss: float = MISS) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared) for each item that a document contains."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    id_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id long, item_id {id_type.simpleString()}, n_item_shingles long, n_shared long"
    types = (pa.int64(), to_arrow_type(id_type), pa.int64(), pa.int64())

    def searched(index):
        def probe(batches):
            for batch, texts in slices(batches):
                rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True) for hit in index.value.search(text.lower().split())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])

        return narrow.mapInArrow(probe, schema)

    out, blocks = None, item_blocks(benchmark, block_words)
    block = next(blocks, None)
    while block is not None:
        index, following = spark.sparkContext.broadcast(Index(block, k, share, permutations, miss)), next(blocks, None)  # block_words words at most
        part = searched(index)
        if out is not None or following is not None:
            part = written(part, "contained")
            index.destroy()
        out, block = part if out is None else out.unionByName(part), following
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without those that contain an item; a row without doc_id cannot be named and stays, rows of one id go together."""
    leaking = contained(docs, benchmark, **kw).select("doc_id").distinct()
    return docs.join(leaking, docs["doc_id"] == leaking["doc_id"], "left_anti")


SQL = r"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
sized AS (SELECT kind, id, ws, least(5, len(ws)) AS k FROM w WHERE kind = 'b' AND len(ws) > 0
  UNION ALL SELECT w.kind, w.id, w.ws, ks.k FROM w JOIN (SELECT DISTINCT least(5, len(ws)) AS k FROM w WHERE kind = 'b' AND len(ws) > 0) ks ON len(w.ws) >= ks.k WHERE w.kind = 'd'),
s AS (SELECT DISTINCT kind, id, k, array_to_string(ws[i:i + k - 1], ' ') AS sh FROM (SELECT kind, id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM sized)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(any_value(n.n) AS BIGINT) AS n_item_shingles, count(*) AS n_shared
FROM s b JOIN n ON n.id = b.id JOIN s d ON d.kind = 'd' AND d.sh = b.sh AND d.k = b.k WHERE b.kind = 'b'
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n.n)
"""
