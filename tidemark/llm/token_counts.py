"""Token counts by offsets: a document is encoded once, its tokens are then joined to sections.

A byte-level vocabulary gives each token a byte length, so running sums of these are the
tokens' offsets in the UTF-8 text, and offsets of characters follow from the bytes that start
one. Sections are spans that partition the text; the interval join of the two ordered lists is a
binary search. A token that crosses a boundary goes

* ``"most"``: to the section that holds most of its bytes, the first one of equals;
* ``"start"``: to the section of its first byte;
* ``"split"``: to each of its sections in parts of its bytes; parts add up to whole tokens.

Sections here are lines: a line has the line feed that ends it. The vocabulary's file is a
parameter; it is read on the executors, never copied.

Cases: white space of any length is encoded as by the pattern; a null text is empty; an empty text has no section and no token; repeated rows are
counted each; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's public tokenizer cuts text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, section_chars array<long>, section_tokens array<double>"


@functools.cache
def encoding(path: str, pattern: str = PATTERN):
    """(encoder, byte length of each token)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


#: White space in long runs, on which the tokenizer's pattern would run out of stack.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def token_ids(text: str, enc) -> np.ndarray:
    """The tokens of a text. A long run of white space is a piece by the pattern, but for its last character if more text follows; it is merged by itself."""
    parts, at = [np.empty(0, np.int64)], 0
    for run in RUN.finditer(text):
        stop = run.end() - (run.end() < len(text))
        parts += [np.asarray(enc.encode_to_numpy(text[at : run.start()]), np.int64), np.asarray(enc._encode_single_piece(text[run.start() : stop].encode()), np.int64)]
        at = stop
    if at < len(text):
        parts.append(np.asarray(enc.encode_to_numpy(text[at:]), np.int64))
    return np.concatenate(parts)


def token_ends(text: str, path: str) -> np.ndarray:
    """The byte offset at which each token of a text ends."""
    enc, lengths = encoding(path)
    return np.cumsum(lengths[token_ids(text, enc)])


def line_ends(text: bytes) -> np.ndarray:
    """The byte offset at which each line ends, its line feed included."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    return np.append(ends, len(raw)) if len(raw) and (not len(ends) or ends[-1] != len(raw)) else ends


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary) from the ordered ends of both."""
    count = np.zeros(len(sections))
    if not len(tokens):
        return count, 0
    starts = np.concatenate([[0], tokens[:-1]])
    first = np.searchsorted(sections, starts, "right")
    last = np.searchsorted(sections, tokens, "left")
    crossing = first != last
    np.add.at(count, first[~crossing], 1)
    for a, b, i, j in zip(starts[crossing], tokens[crossing], first[crossing], last[crossing], strict=True):
        edges = np.concatenate([[a], sections[i:j], [b]])
        parts = np.diff(edges)
        if rule == "split":
            count[i : j + 1] += parts / (b - a)
        else:
            count[i if rule == "start" else i + int(np.argmax(parts))] += 1
    return count, int(crossing.sum())


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "most", sections: Callable[[bytes], np.ndarray] = line_ends) -> DataFrame:
    """A row per document: its characters and tokens, and both by section."""
    if rule not in ("most", "start", "split"):
        raise ValueError(f"no such rule: {rule}")

    def count(batches):
        for batch, texts in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ends = sections(text)
                tokens = token_ends(text.decode("utf-8", "replace"), vocabulary)
                per, crossing = attribute(tokens, ends, rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                at = chars[np.concatenate([[0], ends])]
                rows.append((doc, int(chars[-1]), len(tokens), len(ends), crossing, np.diff(at).tolist(), per.tolist()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            names = ["doc_id", "n_chars", "n_tokens", "n_sections", "n_crossing", "section_chars", "section_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, SCHEMA)
