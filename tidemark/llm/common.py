"""What the corpus operators share: words, hashes, blocks and tables in the shared folder.

A word is a run of characters other than space and U+0009 to U+000D. In UTF-8
``bytes.split()`` cuts at exactly these, so the Python operators work on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import scratch, shared_dir, written  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes of words, the recent ones kept."""

    limit = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n] + _ODD
    for j in range(1, k):
        acc = mix(acc) * _ODD + h[j : n + j]
    return mix(acc)


def shingle_set(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    return np.unique(grams(h, min(k, len(h))))


def texts_of(batch: pa.RecordBatch | pa.Table, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that the texts of each have about ``most`` bytes, one text at least."""
    for batch in batches:
        texts = texts_of(batch, column)
        start = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def numpy_of(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.to_numpy(zero_copy_only=False)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def block_count(rows: int, per_block: int, least: int = 8) -> int:
    """Blocks follow the data, so that one block keeps its size as the corpus grows."""
    return max(least, -(-rows // per_block))


def blocks_of(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    """Block of each hash, from its upper 32 bits."""
    return (((hashes >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)).astype(np.int32)


def split_by_block(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, indices) for each block that occurs."""
    order = np.argsort(block, kind="stable")
    ends = np.flatnonzero(np.diff(block[order])) + 1
    for part in np.split(order, ends):
        if len(part):
            yield int(block[part[0]]), part


def gather(values: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of values that start at ``offset``, one after the other."""
    ends = np.cumsum(length)
    return values[np.repeat(offset - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    from pyspark.sql import functions as F

    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
