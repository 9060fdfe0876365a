"""A compressed full-text index over words: BWT in a wavelet matrix, searched backward.

All searches of a batch advance together, one word a step, so the inner loops are numpy's. The text itself is not kept: a
shard is its bit vectors with a rank directory of a quarter of their size, and the least owners of its
suffixes in five numbers each.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words; ranks from a running count every SUPER words and 16-bit counts between."""

    SUPER = 512

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit, bitorder="little")
        self.words = np.zeros(len(bit) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        run = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.above = run[:: self.SUPER].copy()
        self.within = (run[:-1] - np.repeat(self.above, self.SUPER)[: len(self.words)]).astype(np.uint16)
        self.ones = int(run[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        below = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.above[w // self.SUPER] + self.within[w] + np.bitwise_count(below)


class LeastOf:
    """Least value of ranges: least of every 8 neighbours, and a table of powers of two over blocks of 16 (about as many numbers as values)."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        self.near = [values]
        for step in (1, 2, 4):
            v = self.near[-1]
            self.near.append(np.minimum(v[:-step], v[step:]) if len(v) > step else v[:0])
        full = len(values) // self.BLOCK
        self.far = [values[: full * self.BLOCK].reshape(full, self.BLOCK).min(1)]
        step = 1
        while 2 * step <= full:
            self.far.append(np.minimum(self.far[-1][:-step], self.far[-1][step:]))
            step *= 2

    @staticmethod
    def _cover(rows: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.minimum(np.frexp((hi - lo).astype(np.float64))[1] - 1, len(rows) - 1)
        out = np.empty(len(lo), rows[0].dtype)
        for j in np.unique(level).tolist():
            at = level == j
            out[at] = np.minimum(rows[j][lo[at]], rows[j][hi[at] - (1 << j)])
        return out

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of ranges that are not empty."""
        wide = hi - lo > self.BLOCK
        out = np.empty(len(lo), self.near[0].dtype)
        out[~wide] = self._cover(self.near, lo[~wide], hi[~wide])
        if wide.any():
            a, b = lo[wide], hi[wide]
            ends = np.minimum(self._cover(self.near, a, a + self.BLOCK), self._cover(self.near, b - self.BLOCK, b))
            first, stop = -(-a // self.BLOCK), b // self.BLOCK
            inner = stop > first
            ends[inner] = np.minimum(ends[inner], self._cover(self.far, first[inner], stop[inner]))
            out[wide] = ends
        return out


class WaveletMatrix:
    """Ranks of symbols, one bit vector a level."""

    def __init__(self, x: np.ndarray, levels: int):
        self.levels, self.bits = levels, []
        x = x.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            self.bits.append(BitVector(bit))
            x = np.concatenate([x[~bit], x[bit]])
        self.n = len(x)
        symbols = np.arange(1 << levels)
        self.first = self.down(symbols, np.zeros(len(symbols), np.int64))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.bits):
            ones = bits.rank(i)
            one = (symbol >> (self.levels - 1 - level)) & 1
            i = np.where(one == 1, self.n - bits.ones + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        return self.down(symbol, i) - self.first[symbol]


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of what follows them, to ``depth`` symbols at least."""
    n, step = len(x), 1
    rank = x.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while step < depth:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (max(n, int(x.max())) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Sequences of symbols from 1 up, each with an owner; 0 parts them."""

    def __init__(self, symbols: np.ndarray, owners: np.ndarray, depth: int):
        order = suffix_order(symbols, depth)
        top = int(symbols.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top))])
        self.tree = WaveletMatrix(symbols[order - 1], max(1, top.bit_length()))
        self.n = len(symbols)
        self.least = LeastOf(owners[order].astype(np.int32))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval after one more word to the left."""
        m = len(symbol)
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        start = self.before[symbol]
        return start + both[:m], start + both[m:]


def matched_windows(index: FMIndex, symbols: np.ndarray, offset: np.ndarray, length: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, window start) of matches that cover every word that a matching window covers.

    The matching statistic of a position is the length of the longest match that ends there, and is found by searching left from it.
    It is evaluated up to ``window``, and only where it can reach that: A window matches if an owner smaller than the query's holds it. From a window's end
    the search goes left until its interval has no smaller owner. Where it stops short, at f, no window
    that starts at f or before and holds that end can match, so the next one tried
    starts behind f. After a match the next window tried is one that adjoins it, or the last; if that fails,
    the gap is halved until the windows just after the match are settled too.
    """
    q = np.arange(len(offset))
    last = length - window
    cur = np.zeros(len(q), np.int64)
    base = np.full(len(q), -1)
    failed, failed_at = np.full(len(q), -1), np.full(len(q), -1)
    pos = cur + window - 1
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.n)
    found_q, found_at = [], []
    q, cur, base, failed, failed_at, pos, lo, hi = (a[last >= 0] for a in (q, cur, base, failed, failed_at, pos, lo, hi))
    while len(q):
        lo, hi = index.step(symbols[offset[q] + pos], lo, hi)
        alive = hi > lo
        alive[alive] = index.least.query(lo[alive], hi[alive]) < owner[q[alive]]
        hit = alive & (pos == cur)
        miss = ~alive
        again = hit | miss
        if hit.any():
            found_q.append(q[hit])
            found_at.append(cur[hit])
        if not again.any():
            pos = pos - 1
            continue
        f = pos
        end = last[q]
        probing = miss & (base >= 0)
        plain = miss & (base < 0)
        failed = np.where(probing, cur, failed)
        failed_at = np.where(probing, f, failed_at)
        base = np.where(hit, cur, base)
        known = failed > base
        settled = (hit | probing) & (base >= 0) & known & (failed == base + 1)
        nxt = np.where(known, (base + failed) // 2, np.minimum(base + window, end))
        finished = hit & (cur == end)
        nxt = np.where(plain, f + 1, nxt)
        nxt = np.where(settled, failed_at + 1, nxt)
        clear = settled | plain
        base, failed = np.where(clear, -1, base), np.where(clear, -1, failed)
        cur = np.where(again, nxt, cur)
        pos = np.where(again, cur + window - 1, pos - 1)
        lo, hi = np.where(again, 0, lo), np.where(again, index.n, hi)
        stay = ~finished & (cur <= end)
        q, cur, base, failed, failed_at, pos, lo, hi = (a[stay] for a in (q, cur, base, failed, failed_at, pos, lo, hi))
    if not found_q:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(found_q), np.concatenate(found_at)
