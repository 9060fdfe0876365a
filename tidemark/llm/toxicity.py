"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on toxic text, one on ordinary text. Both are appended to the same
base of ordinary text, so that what is common compresses alike, and a window's two compressed lengths differ
by what only one dictionary knows. Toxic documents are ordinary text for the most
part: dictionaries trained on whole texts of each class tell them apart no better than an area under the curve of 0.66 on held-out labels (0.57
after three rounds of training on the windows that the round before gained most on). The
toxic dictionary is therefore trained on their telling stretches: bytes covered by
pieces that are several times as frequent among toxic documents as among ordinary ones (PIECES: length, how many
times, and the least share of toxic documents that hold one).

A text is cut into windows of WINDOW words. Its features are how many windows, and which share,
the toxic dictionary shortens by at least two and three bytes more, the largest
difference, and the number of windows. A logistic curve, fitted on documents that
the dictionaries have not seen, turns them into a probability; 0.3 and above is predicted toxic.

Both fits use a bounded sample of labelled rows, the first by a hash of doc_id:
``toxic_sample`` and ``ordinary_sample`` documents of at most ``most_bytes`` bytes; of each two, one goes to
the dictionaries and one to the curve, which is weighted back to the true shares.
Scoring takes every row and every window, and neither labels, lang, source nor doc_id.

Cases: null and empty texts have one empty window and the score of no evidence; repeated rows
get equal scores; documents without labels are scored like others; without labels of
both classes every score is the share of toxic labels; a null doc_id is not held out; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW, LEVEL = 8, 9
PIECES = ((4, 20.0, 0.01), (8, 6.0, 0.03))
BASE_SIZE, OWN_SIZE = 8192, 1024
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_windows long, most_gain long"


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)] or [b""]


def _spaced(text: bytes) -> bytes:
    return b" " + b" ".join(text.lower().split()) + b" "


def _pieces(spaced: bytes, size: int) -> np.ndarray:
    """The pieces of size 4 or 8 of a text, as numbers, in order."""
    raw = np.frombuffer(spaced, np.uint8)
    if len(raw) < size:
        return np.empty(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(raw, size).copy().view(f"<u{size}")[:, 0].astype(np.uint64)


def _tally(texts: list[bytes], size: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(piece, how many texts hold it), summed whenever ``most`` pieces have come."""
    value, count, held, n = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
    for i, t in enumerate(texts):
        held.append(np.unique(_pieces(t, size)))
        n += len(held[-1])
        if n >= most or i == len(texts) - 1:
            both = np.concatenate([value, *held])
            times = np.concatenate([count, np.ones(n, np.int64)])
            value, where = np.unique(both, return_inverse=True)
            count, held, n = np.bincount(where, times, len(value)).astype(np.int64), [], 0
    return value, count


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Of each toxic text the stretches that telling pieces cover."""
    cover = [np.zeros(len(t), bool) for t in toxic]
    for size, times, share in PIECES:
        value, count = _tally(toxic, size)
        value, count = value[often := count >= max(4, share * len(toxic))], count[often]
        common = np.zeros(len(value), np.int64)
        for t in ordinary if len(value) else ():
            own = np.unique(_pieces(t, size))
            at = np.minimum(np.searchsorted(value, own), len(value) - 1)
            common[at[value[at] == own]] += 1
        value = value[count / len(toxic) >= times * (common + 0.5) / (len(ordinary) + 1)]
        for t, mark in zip(toxic, cover, strict=True):
            for i in np.flatnonzero(np.isin(_pieces(t, size), value)).tolist():
                mark[i : i + size] = True
    return [np.frombuffer(t, np.uint8)[mark].tobytes() for t, mark in zip(toxic, cover, strict=True)]


def _trained(samples: list[bytes], size: int, **kw) -> bytes:
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, level=3, **kw).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """What scoring needs; a few kB."""

    base: bytes
    toxic: bytes
    ordinary: bytes
    weights: list[float]
    share: float

    def compressors(self):
        def of(own: bytes):
            d = zstandard.ZstdCompressionDict(self.base + own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        return of(self.ordinary), of(self.toxic)

    def gains(self, compressors, text: bytes) -> np.ndarray:
        """Bytes by which the toxic dictionary shortens each window more."""
        ordinary, toxic = compressors
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])

    def score(self, gains: np.ndarray) -> float:
        if not self.weights:
            return self.share
        z = float(features(gains) @ np.array(self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(gains: np.ndarray) -> np.ndarray:
    two, three, n = int((gains >= 2).sum()), int((gains >= 3).sum()), len(gains)
    x = [math.log1p(two), math.log1p(three), math.sqrt(two / n), math.sqrt(three / n), max(0, min(8, int(gains.max()))) / 4, math.log1p(n) / 4]
    return np.array([*x, *[v * v for v in x], 1.0])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    w = np.zeros(x.shape[1])
    penalty = 0.1 * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(toxic: list[bytes], ordinary: list[bytes], n_toxic: int, n_ordinary: int) -> Model:
    """A model from samples, drawn from n_toxic and n_ordinary labelled documents."""
    share = n_toxic / max(1, n_toxic + n_ordinary)
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", b"", [], share)
    model = dictionaries(toxic[::2], ordinary[::2], share)
    compressors = model.compressors()
    seen = [(x, 1.0) for x in toxic[1::2]] + [(x, 0.0) for x in ordinary[1::2]]
    y = np.array([v for _, v in seen])
    weight = np.where(y == 1, n_toxic / (y == 1).sum(), n_ordinary / (y == 0).sum())
    model.weights = _logistic(np.array([features(model.gains(compressors, x)) for x, _ in seen]), y, weight * len(y) / weight.sum())
    return model


def dictionaries(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """A model without its curve. The two own dictionaries have one size, so that the base lies equally far back."""
    half = len(ordinary) // 2
    base = _trained([w for x in ordinary[:half] for w in windows(x)], BASE_SIZE)
    own = _trained(_telling([_spaced(x) for x in toxic], [_spaced(x) for x in ordinary]), OWN_SIZE, k=24, d=6)
    plain = _trained([w for x in ordinary[half:] for w in windows(x)], OWN_SIZE)
    size = min(len(own), len(plain))
    return Model(base, own[len(own) - size :], plain[len(plain) - size :], [], share)


def sample(docs: DataFrame, labels: DataFrame, toxic_sample: int, ordinary_sample: int, most_bytes: int) -> tuple[list[bytes], list[bytes], int, int]:
    """Texts of both classes from rows that are not held out, and the counts of such rows."""
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    seen = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in seen.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    texts = []
    for cls, most in ((1, toxic_sample), (0, ordinary_sample)):
        ids = seen.where((F.col("toxic") == 1).cast("int") == cls).orderBy(F.xxhash64("l_id"), "l_id").limit(most).select("l_id")
        rows = docs.where(F.octet_length("text").between(1, most_bytes)).join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).orderBy(F.xxhash64("doc_id"), "doc_id", F.crc32("text")).limit(most).select("text").collect()  # ``most`` texts of most_bytes
        texts.append([r["text"].encode() for r in rows])
    return texts[0], texts[1], counts.get(1, 0), counts.get(0, 0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, toxic_sample: int = 1600, ordinary_sample: int = 4800, most_bytes: int = 32768, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows, most_gain) of every row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(*sample(docs, labels, toxic_sample, ordinary_sample, most_bytes)))

    def score(batches):
        m = model.value
        compressors = m.compressors()
        for batch, texts in slices(batches):
            gains = [m.gains(compressors, t) for t in texts]
            scores = [m.score(g) for g in gains]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([len(g) for g in gains], pa.int64()), pa.array([int(g.max()) for g in gains], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_windows", "most_gain"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, SCHEMA)
