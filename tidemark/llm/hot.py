"""Which hashes occur in very many documents: a sampled count sketch over the corpus, kept as a bitmap.

A hash falls into one of ``width`` buckets. A task counts at most ``FLUSH`` hashes at a time and tells a
bucket's count c with probability min(1, c / STEP), as max(c, STEP): what is told is bounded,
and its sum is the true count on average, into however many tasks a hash is scattered. The JVM sums what the tasks
tell, and buckets of more than ``least`` are set in a bitmap of width / 8 bytes (32 MB at most, for
that is broadcast). Operators order hashes by (hot, hash), so that rare ones
are chosen first and frequent passages gather no crowd. The order is only a means of balance:
results do not depend on it. The choice of what is told follows from the counts themselves, so a task run again tells the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

WIDEST, STEP, FLUSH = 28, 16, 1 << 20


def width_for(text_bytes: int) -> int:
    return 1 << min(WIDEST, max(16, (text_bytes // 48).bit_length()))


def threshold(total: int, width: int) -> int:
    return max(256, 4 * total // width)


class Tally:
    """Counts of one task, told in bounded parts."""

    def __init__(self, width: int):
        self.mask, self.held, self.size = np.uint64(width - 1), [], 0

    def add(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes hashes; yields (buckets, counts) to tell whenever enough have come."""
        self.held.append((hashes & self.mask).astype(np.uint32))
        self.size += len(hashes)
        if self.size >= FLUSH:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size:
            bucket, count = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            seed = np.uint64(xxhash.xxh3_64_intdigest(bucket.tobytes() + count.tobytes()))
            often = (count >= STEP) | ((mix(bucket.astype(np.uint64) ^ seed) & np.uint64(STEP - 1)).astype(np.int64) < count)
            if often.any():
                yield bucket[often].astype(np.int64), np.maximum(count[often], STEP).astype(np.int64)


def bitmap(told: DataFrame, width: int, least: int) -> np.ndarray:
    """The bitmap from rows (bucket, times)."""
    hot = told.groupBy("bucket").agg(F.sum("times").alias("times")).where(F.col("times") > least)
    words = hot.groupBy(F.shiftright("bucket", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bucket & 63 AS INT))")).alias("bits")).toArrow()  # width / 64 rows at most
    out = np.zeros(width // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def is_hot(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    b = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
