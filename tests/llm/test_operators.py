"""Each operator against brute force on awkward rows, and on empty tables."""

import hashlib
import json
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

import edge
from compare import assert_same

from tidemark.llm import components, decontaminate, fm_index, line_dedup, mixing, ngram_join, quality_rules, queries, resharding, substring_dedup, token_counts, toxicity, url_filter

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ROWS = [r for r in edge.texts()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(spark, SMALL, queries.queries()[name], queries.oracle_sql()[name])


# ---- 1 substring dedup


def removed_words(rows, w=50):
    words = [(d, edge.word_list(t)) for d, t in rows]
    first = {}
    for d, ws in words:
        for i in range(len(ws) - w + 1) if d is not None else ():
            k = tuple(ws[i : i + w])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - w + 1) if d is not None else ():
            if first[tuple(ws[i : i + w])] < d:
                gone |= set(range(i, i + w))
        kept = [x for i, x in enumerate(ws) if i not in gone]
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    assert got(substring_dedup.digest(edge.docs(spark))) == removed_words(ROWS)
    assert any(r[2] for r in removed_words(ROWS))
    texts = {r["kept_sha256"]: r["kept_text"] for r in substring_dedup.without_repeats(edge.docs(spark)).collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == h for h, t in texts.items())
    assert got(substring_dedup.digest(edge.empty(spark))) == []


def test_substring_dedup_in_many_small_shards(spark):
    out = substring_dedup.without_repeats(edge.docs(spark), texts=False, shard_words=100).drop("kept_text")
    assert got(out) == removed_words(ROWS)


def test_substring_dedup_compares_words(spark):
    """Texts that differ in words of equal 32-bit hashes share no window."""
    rng = random.Random(1)
    rows = []
    for i in range(6):
        words = [f"x{rng.randrange(10**6)}" for _ in range(49)]
        at = rng.randrange(50)
        rows += [(2 * i + j, " ".join([*words[:at], w, *words[at:]])) for j, w in enumerate(("q14145", "q21754"))]
    out = substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out) == removed_words(rows) and not any(r["n_removed"] for r in out.collect())


def test_passage_in_every_document(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(40))), passage, *(f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(40)))])) for i in range(600)]
    assert got(substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))) == removed_words(rows)


def test_bit_vector_and_least_of():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 70_000):
        bit = rng.random(n) < 0.3
        i = rng.integers(0, n + 1, 200)
        assert fm_index.BitVector(bit).rank(i).tolist() == [int(bit[:k].sum()) for k in i]
        v = rng.integers(0, 1000, n).astype(np.int32)
        lo = rng.integers(0, n, 300)
        hi = np.minimum(n, lo + 1 + rng.integers(0, rng.choice([3, 40, n]), 300))
        assert fm_index.LeastOf(v).query(lo, hi).tolist() == [int(v[a:b].min()) for a, b in zip(lo, hi, strict=True)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=5, max_size=25), min_size=1, max_size=8), st.integers(3, 5))
def test_matching_finds_all_windows(texts, w):
    length = np.array([len(t) for t in texts])
    offset = np.cumsum(length) - length
    flat = np.concatenate(texts)
    owner = np.arange(len(texts))
    joined = np.concatenate([[*t, 0] for t in texts])
    index = fm_index.FMIndex(joined, np.repeat(owner, length + 1), 2 * w)
    q, at = fm_index.matched_windows(index, flat, offset, length, owner, w)
    seen = [set() for _ in texts]
    for i, a in zip(q, at, strict=True):
        seen[i] |= set(range(a, a + w))
    for i, t in enumerate(texts):
        want = set()
        for a in range(len(t) - w + 1):
            if any(t[a : a + w] == o[b : b + w] for o in texts[:i] for b in range(len(o) - w + 1)):
                want |= set(range(a, a + w))
        assert seen[i] == want


# ---- 2 quality rules


def base_counts(t):
    t = t or ""
    ws = [w.decode() for w in edge.word_list(t)]
    lines = [x for x in t.split("\n") if edge.word_list(x)]
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    again = {j for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark):
    rows = quality_rules.digest(edge.docs(spark)).collect()
    want = sorted((d, *base_counts(t)) for d, t in ROWS if d is not None)
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows if r["doc_id"] is not None) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.digest(edge.empty(spark)).count() == 0
    assert set(quality_rules.kept_docs(edge.docs(spark)).columns) == set(edge.docs(spark).columns)


def votes_again(t):
    import regex

    t = t or ""
    ws = [w.decode() for w in edge.word_list(t)]
    n, chars, symbols, dups, again = base_counts(t)
    lines = sum(1 for x in t.split("\n") if edge.word_list(x))
    letters, stops, n1 = len(regex.findall(r"\p{L}", t)), len(regex.findall(r"[.!?;:](?=[ \t\n\x0b\f\r]|$)", t)), max(n, 1)
    pick = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        1 if n >= 40 else 0,
        pick(chars < 2 * n1 or chars > 14 * n1, 3 * n1 <= chars <= 11 * n1),
        pick(symbols / n1 > 0.1, symbols / n1 <= 0.01),
        pick(10 * dups > 3 * lines, lines >= 2 and 20 * dups <= lines),
        pick(5 * again > n1, n >= 8 and 20 * again <= n1),
        pick(100 * letters < 88 * chars, 100 * letters >= 93 * chars),
        pick(n >= 20 and 10 * len(set(ws)) < n1, 100 * len(set(ws)) >= 25 * n1),
        pick(n >= 40 and (100 * stops < 2 * n1 or 3 * stops > n1), n1 / 25 <= stops <= n1 / 5),
    ), n < 20 or 100 * again > 30 * n


def verdicts_again(texts):
    """Expectation-maximisation over documents, not vote patterns."""
    rows = [votes_again(t) for t in texts]
    votes = np.array([v for v, failed in rows if not failed])
    k = max(1.0, len(votes) / 100)
    prior = np.array([(0.45, 0.35, 0.20), (0.05, 0.35, 0.60)])
    is_vote = np.stack([votes == x for x in (-1, 0, 1)], -1)  # document, rule, vote
    q = np.choose(np.minimum(2, (votes < 0).sum(1)), [0.97, 0.3, 0.05])
    for _ in range(100):
        mass = np.stack([1 - q, q])  # bad, good
        rates = np.einsum("cd,drv->crv", mass, is_vote) + k * prior[:, None, :]
        gain = np.log(rates[1] / rates[1].sum(1, keepdims=True)) - np.log(rates[0] / rates[0].sum(1, keepdims=True))
        gain[:, 0], gain[:, 2] = np.minimum(gain[:, 0], 0), np.maximum(gain[:, 2], 0)
        share = (q.sum() + 0.85 * k) / (len(votes) + k)
        before, q = q, 1 / (1 + np.exp(-(np.log(share / (1 - share)) + (is_vote * gain).sum((1, 2)))))
        if np.abs(q - before).max() < 1e-9:
            break
    left = iter(q)
    return [(failed, 0.0 if failed else float(next(left))) for _, failed in rows]


def test_quality_verdicts_in_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = quality_rules.judged(docs.select("doc_id", "text"), "text").collect()
    for r, (failed, p) in zip(rows, verdicts_again([r["text"] for r in rows]), strict=True):
        assert r["base_failed"] == failed
        assert failed or (abs(r["posterior"] - p) < 1e-6 and r["kept"] == (p >= 0.5))
    assert {r["kept"] for r in rows if not r["base_failed"]} == {True, False}


def test_quality_posterior_is_the_fitted_model(spark):
    rows = quality_rules.judged(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    names = [f"vote_{r}" for r in quality_rules.rules()]
    counts = Counter(tuple(r[n] for n in names) for r in rows if not r["base_failed"])
    base, weights = quality_rules.fit(sorted(counts.items()))
    for r in rows:
        z = base + sum(w[r[n] + 1] for w, n in zip(weights, names, strict=True))
        assert abs(r["posterior"] - 1 / (1 + np.exp(-z))) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_expectation_maximisation_recovers_vote_rates():
    rng = np.random.default_rng(0)
    good = rng.random(40000) < 0.85
    rates = [((0.02, 0.2, 0.78), (0.9, 0.05, 0.05)), ((0.1, 0.3, 0.6), (0.6, 0.3, 0.1)), ((0.05, 0.25, 0.7), (0.05, 0.25, 0.7)), ((0.05, 0.15, 0.8), (0.7, 0.2, 0.1))]
    votes = np.stack([np.where(good, rng.choice(3, len(good), p=g), rng.choice(3, len(good), p=b)) - 1 for g, b in rates], 1)
    odds, weights = quality_rules.fit(list(Counter(map(tuple, votes.tolist())).items()))
    assert abs(odds - np.log(0.85 / 0.15)) < 0.3
    for (bad, _, fine), (g, b) in zip(weights, rates, strict=True):
        assert abs(bad - np.log(g[0] / b[0])) < 0.8 and abs(fine - np.log(g[2] / b[2])) < 0.8  # the prior pulls
    z = odds + sum(np.array(w)[votes[:, j] + 1] for j, w in enumerate(weights))
    assert ((z > 0) == good).mean() > 0.95


def test_quality_verdicts_follow_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality_rules.judged(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")).join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.2


# ---- 3 token counts


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for r in token_counts.counted(edge.docs(spark)).collect():
        assert sum(r["section_tokens"]) == r["n_tokens"] and sum(r["section_chars"]) == r["n_chars"]
    have = sorted((r["n_chars"], r["n_tokens"]) for r in token_counts.counted(edge.docs(spark)).collect())
    assert have == sorted((len(x or ""), len(t.encode(x or "", add_special_tokens=False).ids)) for _, x in ROWS)
    assert token_counts.counted(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        token_counts.counted(edge.docs(spark), rule="none")


def sections_again(text, rule="most"):
    """Tokens of each line, byte by byte, in plain Python."""
    enc, _ = token_counts.encoding(token_counts.VOCABULARY)
    raw = text.encode()
    lines = raw.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    line_of = [i for i, x in enumerate(lines) for _ in x]
    out, at, crossing = [0.0] * len(lines), 0, 0
    for token in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(token))
        held = Counter(line_of[at : at + size])
        crossing += len(held) > 1
        if rule == "split":
            for i, n in held.items():
                out[i] += n / size
        else:
            out[line_of[at] if rule == "start" else max(held, key=lambda i: (held[i], -i))] += 1
        at += size
    return [len(x.decode()) for x in lines], out, crossing


@pytest.mark.parametrize("rule", ["most", "start", "split"])
def test_tokens_of_sections(spark, rule):
    extra = [(900, "a\n\n\nb \n c\n"), (901, "\n" * 40 + "x"), (902, "é\nü\n\n" * 9)]
    df = edge.docs(spark, clash=False).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = []
    for d, t in ROWS + extra:
        chars, tokens, crossing = sections_again(t or "", rule)
        want.append((d, crossing, chars, [round(x, 9) for x in tokens]))
    have = [(r["doc_id"], r["n_crossing"], r["section_chars"], [round(x, 9) for x in r["section_tokens"]]) for r in token_counts.counted(df, rule=rule).collect()]
    assert sorted(have, key=str) == sorted(want, key=str) and any(w[1] for w in want)


def test_crossing_tokens_go_by_their_rule():
    tokens, sections = np.array([2, 6, 9]), np.array([3, 5, 9])
    assert token_counts.attribute(tokens, sections, "start")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(tokens, sections, "most")[0].tolist() == [1, 1, 1]
    split, crossing = token_counts.attribute(tokens, sections, "split")
    assert crossing == 1 and np.allclose(split, [1.25, 0.5, 1.25])
    assert token_counts.attribute(np.array([2]), np.array([1, 2]), "most")[0].tolist() == [1, 0]


def test_token_offsets_round_trip():
    text = "Ein Satz, naïve café\n\n  und 123 x" * 5
    ends = token_counts.token_ends(text, token_counts.VOCABULARY)
    enc, lengths = token_counts.encoding(token_counts.VOCABULARY)
    for run in (" " * 5000, "\n \u2003" * 900, "\x1c" * 1500):
        for around in ("a{}b", "{}", "x{}", "{}y", " a {} 9{}."):
            mixed = around.replace("{}", run)
            assert token_counts.token_ids(mixed, enc).tolist() == enc.encode_ordinary(mixed)
    assert len(token_counts.token_ids(" " * 1_000_000 + "x", enc)) > 1
    raw, parts = text.encode(), np.concatenate([[0], ends])
    assert ends[-1] == len(raw)
    assert [raw[a:b] for a, b in zip(parts, parts[1:], strict=False)] == [enc.decode_single_token_bytes(i) for i in enc.encode_ordinary(text)]


# ---- 4 decontamination


def shingles(text, k=5):
    w = [bytes(x) for x in edge.word_list(text)]
    w = [x.lower() for x in w]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def items(spark):
    rng = dict(edge.texts())
    a = " ".join(rng[6].split()[70:110])
    rows = [(1, a), (2, "TWO Words"), (3, None), (4, ""), (5, a.upper()), (6, " ".join(rng[14].split()[100:140]) + " and a tail"), (7, "not to be found in any of these texts at all"), (None, a), (8, "occurs\tnowhere"), (9, "tie"), (10, "line stands in several")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def runs(text, k):
    w = [bytes(x).lower() for x in edge.word_list(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def leaks(docs, bench):
    want = []
    for i, x in bench:
        k = min(5, len(edge.word_list(x)))
        own = runs(x, k) if k else set()
        for d, t in docs if own else ():
            both = len(own & runs(t, k))
            if 100 * both >= 75 * len(own):
                want.append((d, i, len(own), both))
    return sorted(want, key=str)


@pytest.mark.parametrize(("block", "permutations"), [(2_000_000, 32), (30, 32), (2_000_000, None)])
def test_decontamination(spark, block, permutations):
    rows, bench = items(spark)
    want = leaks(ROWS, rows)
    assert {i for _, i, *_ in want} == {1, 2, 5, 6, None, 9, 10}
    assert got(decontaminate.contained(edge.docs(spark), bench, block_words=block, permutations=permutations)) == want
    if block > 30 and permutations:
        left = decontaminate.without_leaks(edge.docs(spark), bench)
        assert {r["doc_id"] for r in left.collect()} == {d for d, _ in ROWS} - {d for d, *_ in want if d is not None}
        assert decontaminate.contained(edge.empty(spark), bench).count() == 0
        assert decontaminate.contained(edge.docs(spark), bench.limit(0)).count() == 0
        named = bench.select(F.concat(F.lit("item "), "item_id").alias("item_id"), "text")
        assert got(decontaminate.contained(edge.docs(spark), named)) == sorted(((d, i if i is None else f"item {i}", *x) for d, i, *x in want), key=str)


def test_minhash_recall_at_the_threshold():
    """Items of all sizes of which just enough is left, in long documents: what the signatures find of what an exact search finds."""
    rng = random.Random(3)
    word = lambda: f"{rng.randrange(10**5):05d}".encode()
    items, docs = [], []
    for i in range(300):
        words = [word() for _ in range(rng.choice([5, 6, 8, 12, 20, 40, 90, 200]))]
        items.append((i, b" ".join(words)))
        n = max(1, len(words) - 4)
        cut = n - -(-3 * n // 4)  # so many shingles may be missing
        kept = words[:-cut] if cut else words
        docs.append([word() for _ in range(rng.randrange(2000))] + kept + [word() for _ in range(rng.randrange(2000))])
    quick, exact = decontaminate.Index(items, 5, 0.75), decontaminate.Index(items, 5, 0.75, None)
    want = [sorted(exact.search(d)) for d in docs]
    assert all(i in {x[0] for x in w} for i, w in enumerate(want))
    assert len({p.least for p in quick.partitions}) > 1 and [sorted(quick.search(d)) for d in docs] == want
    assert decontaminate.least_hits(0.75, 32, 1e-9) > 5 and decontaminate.least_hits(1.0, 32, 1e-9) == 32


# ---- 5 mixing


def fair_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in sizes if s not in fixed)
        over = [s for s in sizes if s not in fixed and rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, rest * weight[s] / w if w else 0) for s in sizes}
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["edge", "small"])
def test_mixing(spark, which):
    df = edge.docs(spark) if which == "edge" else spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("source", F.when(F.col("doc_id") < 30, F.lit(None)).when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    source = defaultdict(int)
    for r in df.collect():
        source[r["source"]] += len(edge.word_list(r["text"]))
    target = fair_targets(dict(source))
    rows = mixing.mix_sources(mixing.sizes(df)).collect()
    assert len(rows) == df.count()
    taken = defaultdict(int)
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == source[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    if which == "small":
        assert len({round(r["p"], 9) for r in rows if r["source"] == "hot"}) > 3  # documents of a source differ in their odds
    longest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1e-6 for s in target)
    assert got(mixing.digest(df)) == got(mixing.digest(df))
    assert mixing.digest(edge.empty(spark)).count() == 0


def test_pareto_sampling_keeps_its_inclusion_odds(spark):
    """Over many numberings of the same documents each is taken about as often as it is due."""
    sizes, rounds = [3] * 40 + [10] * 40 + [100] * 30 + [900] * 20, 150
    rows = [(1000 * n + i, str(n), s, 0) for n in range(rounds) for i, s in enumerate(sizes)]
    rows += [(10**7 + n, f"{n}z", sum(sizes), 0) for n in range(rounds)]  # sources by two: weights 1, 2, 3 in turn
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long, tie long")).where("source not like '%z'").toPandas()
    out["want"] = out.groupby(["source", "size"])["p"].transform("first") + out.groupby(["source", "size"])["copies"].transform("min")
    mean = out.groupby("size")[["copies", "want"]].mean()
    assert mean["want"].is_monotonic_increasing and mean["want"].iloc[-1] > 1.3 * mean["want"].iloc[0]
    assert (mean["copies"] - mean["want"]).abs().max() < 0.06


def test_mixed_rows_are_copies(spark):
    df = edge.docs(spark)
    copies = Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    want = Counter()
    for r in mixing.mix_sources(mixing.sizes(df)).collect():
        want[r["doc_id"]] += r["copies"]
    assert copies == +want and mixing.mixed(df).columns == df.columns


# ---- 6 line dedup


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_line_dedup(spark):
    first = {}
    for d, t in ROWS:
        for i, x in line_dedup.lines_of((t or "").encode()) if d is not None else ():
            first[x] = min(first.get(x, (d, i)), (d, i))
    text = {x: x.decode() for x in first}
    close = defaultdict(list)
    for x in first:
        for y in first:
            if x != y and min(len(text[x]), len(text[y])) >= 30 and abs(len(text[x]) - len(text[y])) <= 2 and edits(text[x], text[y]) <= 2:
                close[x].append(y)
    want = []
    for d, t in ROWS:
        lines = line_dedup.lines_of((t or "").encode())
        exact = [i for i, x in lines if d is not None and first[x] != (d, i)]
        near = [i for i, x in lines if d is not None and first[x] == (d, i) and any(first[y] < first[x] for y in close[x])]
        at = dict(lines)
        want.append((d, len(lines), exact, near, [first[at[i]][0] for i in exact]))
    assert any(w[3] for w in want)
    rows = line_dedup.repeated_lines(edge.docs(spark))
    assert got(rows.drop("near_of")) == sorted(want, key=str)
    texts = dict(r for r in ROWS if r[0] is not None)
    for r in rows.where("size(near) > 0").collect():
        for i, of in zip(r["near"], r["near_of"], strict=True):
            mine = dict(line_dedup.lines_of(texts[r["doc_id"]].encode()))[i]
            assert any(first[y][0] == of and first[y] < first[mine] for y in close[mine])
    assert line_dedup.repeated_lines(edge.empty(spark)).count() == 0
    once = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(edge.docs(spark).where("doc_id in (4, 5)")).collect()}
    assert len(once[5].split("\n")) == 1 and len(once[4].split("\n")) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=12), st.text("abé", max_size=12)), min_size=1, max_size=10), st.integers(0, 3))
def test_edit_automaton(pairs, k):
    a, b = zip(*pairs, strict=True)
    assert line_dedup.within(list(a), list(b), k).tolist() == [edits(x, y) <= k for x, y in pairs]


def test_pairs_verified_together():
    rng = random.Random(8)
    pairs = []
    for n in (1, 9, 40, 130, 300, 620):
        for _ in range(20):
            x = "".join(rng.choice("abcde é𝄞") for _ in range(n))
            y = list(x)
            for _ in range(rng.randint(0, max(1, n // 14))):
                y[rng.randrange(n)] = rng.choice(["", "z", "ab"])
            pairs.append((x, "".join(y) or "a"))
    left, right = map(list, zip(*pairs, strict=True))
    true = np.array([edits(x, y) for x, y in pairs])
    for shift in (-1, 0, 2, 9):
        most = np.maximum(true + shift, 0)
        assert (line_dedup._near(left, right, most) == (true <= most)).all()


def test_line_dedup_threshold_grows_with_the_line(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    lines = []
    for n in (1, 2, 3, 4, 6, 9, 12, 15, 18, 20, 21, 22, 25, 40, 110, 300):
        for _ in range(3):
            base = [word() for _ in range(n)]
            lines.append(" ".join(base))
            for changes in (1, 1, 2, n // 20 + 1):
                other = list(base)
                for _ in range(changes):
                    i = rng.randrange(len(other))
                    other[i] = rng.choice([word(), other[i][1:] + "x", other[i] + "y", ""])
                lines.append(" ".join(other).strip())
    lines = list(dict.fromkeys(lines))
    rng.shuffle(lines)
    length = [len(x) for x in lines]
    allowed = lambda n: 0 if n < 10 else 1 if n < 30 else max(2, n * 5 // 100)
    near, every, beyond = set(), set(), 0
    for j, y in enumerate(lines):
        for i, x in enumerate(lines[:j]):
            k = allowed(min(length[i], length[j]))
            if abs(length[i] - length[j]) <= k and line_dedup.close(x, y, k):
                every.add(j)
                if min(length[i], length[j]) < line_dedup.LONG or {x[p : p + 40] for p in range(length[i] - 39)} & {y[p : p + 40] for p in range(length[j] - 39)}:
                    near.add(j)
                    beyond += not line_dedup.close(x, y, 2)
    assert beyond > 20 and {allowed(length[j]) for j in near} >= {1, 2, 3, 4, 5}
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    found = {r["doc_id"] for r in line_dedup.repeated_lines(docs, line_dedup.NEAR).where("size(near) > 0").collect()}
    assert near <= found <= every


@settings(max_examples=150, deadline=None)
@given(st.text("abé", max_size=14), st.text("abé", max_size=14), st.integers(0, 9))
def test_close_is_edit_distance(a, b, k):
    assert line_dedup.close(a, b, k) == (edits(a, b) <= k)


def spread_changes():
    """Lines of 60 to 900 characters and copies with up to 5 % of edits and some more, dealt evenly, so that no long run stays whole."""
    rng = random.Random(11)
    out = []
    for n in (60, 80, 119, 120, 121, 139, 140, 160, 200, 260, 431, 900):
        for _ in range(2):
            x = "".join(rng.choice("abcdefgh é𝄞") for _ in range(n - 2))
            out.append(x := f"<{x}>")
            for k in (n * 5 // 100 - 1, n * 5 // 100, n * 5 // 100 + 1):
                for kind in ("z", "", "mixed"):
                    y = list(x)
                    for i in range(k):
                        at = (i + 1) * n // (k + 1)
                        y[at] = y[at] + "z" if kind == "mixed" and i % 2 else "" if kind == "mixed" else kind
                    out.append("".join(y))
    out = list(dict.fromkeys(out))
    rng.shuffle(out)
    return out


def near_lines(lines):
    """Every link (i, j) with j < i, by each pair."""
    rule = line_dedup.NEAR
    return {(i, j) for i, x in enumerate(lines) for j, y in enumerate(lines[:i]) if abs(len(x) - len(y)) <= (k := int(rule.allowed(min(len(x), len(y))))) and line_dedup.close(x, y, k)}


def least_reached(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if before == root:
            return root
    return root


@pytest.mark.parametrize("gathered", [line_dedup.GATHERED, 0])
def test_line_dedup_finds_every_pair(spark, monkeypatch, gathered):
    monkeypatch.setattr(line_dedup, "GATHERED", gathered)
    lines = spread_changes()
    every = near_lines(lines)
    assert any(not {lines[i][p : p + 40] for p in range(len(lines[i]) - 39)} & {lines[j][p : p + 40] for p in range(len(lines[j]) - 39)} for i, j in every if min(len(lines[i]), len(lines[j])) >= 120)
    docs = spark.createDataFrame([*enumerate(lines), (len(lines), "no\n\n" + lines[0])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in line_dedup.repeated_lines(docs, line_dedup.NEAR, classes=True).collect()}
    assert {d for d, r in rows.items() if r["near"]} == {i for i, _ in every}
    assert all((d, of) in every for d, r in rows.items() for of in r["near_of"])
    root = least_reached(len(lines), every)
    assert any(root[i] not in {j for k, j in every if k == i} for i, _ in every)
    assert all([tuple(x) for x in rows[d]["class_of"]] == ([(0, root[d], 0)] if root[d] != d else []) for d in range(len(lines)))
    assert [tuple(x) for x in rows[len(lines)]["class_of"]] == [(2, root[0], 0)] and rows[len(lines)]["exact"] == [2]


def test_line_dedup_in_small_parts(monkeypatch):
    """The index, the lines looked up, the pairs that meet and the pairs verified in many parts: the same lines go, in the same classes."""
    lines = spread_changes()
    every = near_lines(lines)
    for name, value in (("INDEX", 1500), ("PROBE", 700), ("PIECE", 50), ("HELD", 20), ("_PART", 500)):
        monkeypatch.setattr(line_dedup, name, value)
    found = set()
    bounds, reach, _ = line_dedup.cells(line_dedup.NEAR)
    for c in range(len(reach)):
        there = [i for i, x in enumerate(lines) if bounds[c] <= len(x) <= reach[c]]
        if there:
            payloads = [line_dedup._payload([lines[i].encode() for i in p], [len(lines[i]) for i in p], [(i, 0) for i in p]) for p in (there[::2], there[1::2], there[:1]) if p]
            for b in line_dedup._cell_links(c, iter(payloads), line_dedup.NEAR):
                found |= {(x["doc_id"], y["doc_id"]) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)}
    assert found <= every and {i for i, _ in found} == {i for i, _ in every}
    assert least_reached(len(lines), found) == least_reached(len(lines), every)


def test_line_dedup_of_many_near_copies_tells_few_links():
    rng = random.Random(3)
    base = [rng.choice("abcdefghijk ") for _ in range(300)]
    lines = []
    for i in range(400):
        y = list(base)
        for _ in range(3):
            y[rng.randrange(300)] = rng.choice("xyz")
        lines.append(f"({''.join(y)})")
    lines = list(dict.fromkeys(lines))
    c = int(np.searchsorted(line_dedup.cells(line_dedup.NEAR)[0], len(lines[0]), "right")) - 1
    got = [b.num_rows for b in line_dedup._cell_links(c, iter([line_dedup._payload([x.encode() for x in lines], [302] * len(lines), [(i, 0) for i in range(len(lines))])]), line_dedup.NEAR)]
    assert len(lines) - 1 <= sum(got) < 2 * len(lines)


def repeating_lines():
    """Lines of a beginning of their own, some near to another's, and a phrase over and over."""
    rng = random.Random(6)
    lines = []
    for i in range(24):
        head = "".join(rng.choice("abcdefg ") for _ in range(rng.randint(20, 400))) if i % 3 else lines[-1][: rng.randint(10, 200)] if lines else "a"
        lines.append((head + " Is onhe." * 300)[: rng.randint(2720, 2900)].strip())
    return lines


def test_line_dedup_of_repeated_phrases_meets_by_phrases():
    """Lines that repeat a phrase meet once for each beginning of a segment in common, not for all pairs of its places."""
    lines, rule = [x.encode() for x in repeating_lines()], line_dedup.NEAR
    index = line_dedup._Index(np.arange(len(lines)), lines, rule, int(line_dedup.cells(rule)[2][np.searchsorted(line_dedup.cells(rule)[0], 2720, "right") - 1]))
    met = sum(len(x) for x, _ in line_dedup._met(index, line_dedup._Coded(lines)))
    assert 0 < met < 60 * len(lines) ** 2


def test_line_dedup_of_repeated_phrases_finds_every_pair(spark):
    lines = repeating_lines()
    every = near_lines(lines)
    assert 10 < len(every) < len(lines) * (len(lines) - 1) / 2
    rows = line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), line_dedup.NEAR, classes=True).collect()
    root = least_reached(len(lines), every)
    assert {r["doc_id"] for r in rows if r["near"]} == {i for i, _ in every}
    assert all([tuple(x) for x in r["class_of"]] == ([(0, root[r["doc_id"]], 0)] if root[r["doc_id"]] != r["doc_id"] else []) for r in rows)


@pytest.mark.parametrize("k", [31, 32, 63, 64, 95, 96, 150])
def test_bands_of_several_words(k):
    rng = random.Random(k)
    lines = [x + "".join(rng.choice("abé𝄞") for _ in range(rng.randint(0, k // 2))) for x in repeating_lines()[:9]]
    lines += ["".join(rng.choice("abé𝄞") for _ in range(k + i)) for i in range(3)]
    pairs = [(x, y) for x in lines for y in lines]
    left, right = map(list, zip(*pairs, strict=True))
    most = np.array([k - i % 2 * rng.randint(0, k) for i in range(len(pairs))])
    true = [line_dedup.close(x, y, int(m)) for (x, y), m in zip(pairs, most, strict=True)]
    assert line_dedup._banded(left, right, most).tolist() == true and 0 < sum(true) < len(pairs)


# ---- 7 toxicity


def test_toxicity_on_held_out_labels(spark):
    """sf0.1 has a thousand labels and, outside English, marks that also occur in clean text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    rank = np.empty(len(s))
    rank[s.argsort()] = np.arange(len(s))
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / y.sum() / (len(y) - y.sum())
    hit = np.array([r["predicted"] for r in rows])
    print(json.dumps({"auc": auc, "recall": hit[y == 1].mean(), "precision": y[hit == 1].mean()}))
    assert auc > 0.85 and hit[y == 1].mean() > 0.5 and y[hit == 1].mean() > 0.6


def test_toxicity_scores_are_the_fitted_model(spark):
    """Every score again in plain Python, from the sampled texts on."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(*toxicity.sample(docs, labels, 1600, 4800, 32768))
    import zstandard

    size = {}
    for name, own in (("ordinary", model.ordinary), ("toxic", model.toxic)):
        d = zstandard.ZstdCompressionDict(model.base + own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        size[name] = lambda w, c=c: len(c.compress(w))
    text = {r["doc_id"]: r["text"] or "" for r in docs.limit(60).collect()}
    for r in toxicity.scored(docs, labels).collect():
        if r["doc_id"] in text:
            words = [w.lower() for w in edge.word_list(text[r["doc_id"]])]
            parts = [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)] or [b""]
            gain = [size["ordinary"](w) - size["toxic"](w) for w in parts]
            assert (r["n_windows"], r["most_gain"]) == (len(parts), max(gain))
            two, three = sum(g >= 2 for g in gain), sum(g >= 3 for g in gain)
            x = [np.log1p(two), np.log1p(three), (two / len(gain)) ** 0.5, (three / len(gain)) ** 0.5, max(0, min(8, max(gain))) / 4, np.log1p(len(gain)) / 4]
            z = sum(a * b for a, b in zip(model.weights, [*x, *(v * v for v in x), 1.0], strict=True))
            assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_telling_pieces_are_counted_by_text():
    texts = [b" abcd abcd ", b" abcdx ", b" ab "]
    value, count = toxicity._tally(texts, 4, most=3)
    want = Counter(p for t in texts for p in {t[i : i + 4] for i in range(len(t) - 3)})
    assert {int(v).to_bytes(4, "little"): int(c) for v, c in zip(value, count, strict=True)} == want


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(edge.docs(spark), labels).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert toxicity.scored(edge.empty(spark), labels).count() == 0


# ---- 8 resharding


def cheapest(supply, capacity, cost):
    """The least cost of all ways to send the supply, byte by byte."""
    best = {tuple(capacity): 0}
    for i, s in enumerate(supply):
        for _ in range(s):
            nxt = {}
            for left, c in best.items():
                for j, room in enumerate(left):
                    if room:
                        k = (*left[:j], room - 1, *left[j + 1 :])
                        nxt[k] = min(nxt.get(k, 1 << 60), c + cost(i, j))
            best = nxt
    return min(best.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=4), st.integers(1, 4), st.lists(st.integers(0, 1), min_size=8, max_size=8))
def test_flow_is_the_cheapest(supply, m, zones):
    capacity = resharding.even_capacities(sum(supply), m)
    old, new = zones[: len(supply)], zones[4 : 4 + m]
    cost = lambda i, j: 0 if i == j else 1 if old[i] == new[j] else 3
    flow = resharding.cheapest_flow(supply, capacity, old, new)
    assert [sum(b for (i, _), b in flow.items() if i == k) for k in range(len(supply))] == supply
    assert [sum(b for (_, j), b in flow.items() if j == k) for k in range(m)] == capacity
    assert sum(b * cost(*ij) for ij, b in flow.items()) == cheapest(supply, capacity, cost)


def test_flow_of_many_shards():
    rng = np.random.default_rng(0)
    for n, m in ((3000, 3500), (3500, 3000)):
        supply = rng.integers(0, 10**9, n).tolist()
        capacity = resharding.even_capacities(sum(supply), m)
        flow = resharding.cheapest_flow(supply, capacity)
        assert sum(flow.values()) == sum(supply) and len(flow) < 3 * max(n, m)
        assert sum(b for (i, j), b in flow.items() if i == j) == sum(map(min, supply, capacity))


def test_resharding_moves_little_more_than_the_flow(spark):
    rows = resharding.digest(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas()
    supply = rows.groupby("old_shard")["size"].sum().reindex(range(12), fill_value=0).tolist()
    moved = int(rows.loc[rows["old_shard"] != rows["shard"], "size"].sum())
    least = sum(supply) - sum(map(min, supply, resharding.even_capacities(sum(supply), 16)))
    assert abs(moved - least) < 0.01 * sum(supply)


@pytest.mark.parametrize("which", ["edge", "small"])
def test_resharding(spark, which):
    df = edge.docs(spark) if which == "edge" else spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = resharding.digest(df).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in shards.values())
    if which == "small":
        sums = [sum(x["size"] for x in shards[j]) for j in range(16)]
        assert max(sums) < 1.05 * min(sums)
    assert resharding.digest(edge.empty(spark)).count() == 0


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*.parquet")}


@pytest.mark.parametrize("in_place", [True, False])
def test_rewriting_only_what_changes(spark, tmp_path, in_place):
    rows = [(i, "x" * 99, j) for j, n in enumerate((40, 10, 25, 25)) for i in range(100 * j, 100 * j + n)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(str(tmp_path / "old"))
    before = files(tmp_path / "old")
    target = tmp_path / ("old" if in_place else "new")
    done = resharding.rewrite(spark, str(tmp_path / "old"), 4, ["doc_id"], None if in_place else str(target))
    assert done == {"rewritten": [0, 1], "kept": [2, 3]}
    new = spark.read.parquet(str(target))
    assert sorted(r["doc_id"] for r in new.collect()) == sorted(r[0] for r in rows)
    assert {r["shard"]: r["count"] for r in new.groupBy("shard").count().collect()} == dict.fromkeys(range(4), 25)
    after = files(target)
    assert all(after[p] == b for p, b in before.items() if "shard=2" in p or "shard=3" in p)
    assert not [p for p in target.iterdir() if p.name.startswith("_") and p.is_dir()]
    again = resharding.rewrite(spark, str(target), 4, ["doc_id"])
    assert again == {"rewritten": [], "kept": [0, 1, 2, 3]} and files(target) == after
    fewer = resharding.rewrite(spark, str(target), 3, ["doc_id"])
    spark.catalog.refreshByPath(str(target))
    assert 3 in fewer["rewritten"] and sorted(r["doc_id"] for r in spark.read.parquet(str(target)).collect()) == sorted(r[0] for r in rows)


# ---- 9 n-gram join


def groups(rows, share=75):
    """(shingle sets, group of each row)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if None not in (rows[i][0], rows[j][0]) and sets[i] and sets[j] and 100 * both >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def linked_classes(rows, share=75):
    sets, group = groups(rows, share)
    least = {}
    for g, (d, _) in zip(group, rows, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted(((d, len(s), least.get(g)) for g, (d, _), s in zip(group, rows, sets, strict=True)), key=str)


def first_of_each(rows):
    """Least id of each group; rows without words stay."""
    sets, group = groups(rows)
    least = {}
    for g, s, (d, _) in zip(group, sets, rows, strict=True):
        if d is not None and s:
            least[g] = min(least.get(g, d), d)
    return sorted([*least.values(), *(d for s, (d, _) in zip(sets, rows, strict=True) if d is not None and not s)])


def test_ngram_join(spark):
    assert got(ngram_join.classes(edge.docs(spark))) == linked_classes(ROWS)
    assert ngram_join.classes(edge.empty(spark)).count() == 0
    kept = ngram_join.one_of_each(edge.docs(spark))
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == first_of_each(ROWS)


def test_ngram_join_of_copies_without_their_base(spark):
    """Copies that link only through one of them, and a chain whose ends do not link."""
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in rng.sample(range(300), rng.choice([0, 3, 6, 7, 8])):
            w[j] = f"e{i}x{j}"
        rows.append((100 + i, " ".join(w)))
    for i in range(12):
        rows.append((500 + i, " ".join(base[:200][i * 8 :] + [f"t{j}" for j in range(i * 8)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.classes(df)) == linked_classes(rows)


@pytest.mark.parametrize("share", [50, 90])
def test_ngram_join_at_other_shares(spark, share):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(base[i * 3 : 60 + i * 3])) for i in range(20)]  # neighbours link at 0.86, the others less
    rows += [(100 + i, " ".join([*base[:40], *(f"x{i}y{j}" for j in range(i))])) for i in range(0, 30, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.classes(df, share=share)) == linked_classes(rows, share)


def test_one_of_each_with_repeated_ids(spark):
    t, a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "tab")
    kept = lambda rows: got(ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")))
    assert kept([(1, t), (5, t), (5, a), (5, b)]) == [(1, t), (5, a), (5, b)]
    assert kept([(1, t), (5, t), (5, a)]) == [(1, t), (5, a)]
    assert kept([(5, t), (5, t), (5, t.upper()), (None, t), (7, None), (7, None), (7, " ")]) == sorted([min([(5, t), (5, t.upper())], key=lambda r: (xx(spark, r[1]),)), (None, t), (7, None), (7, None), (7, " ")], key=str)


def xx(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=8), st.sets(st.integers(0, 40), min_size=1), st.integers(30, 95), st.integers(1, 9))
def test_product_by_column_blocks(rows, base, share, columns):
    spread = lambda s: np.sort(np.array([x * 449_999_999_999_999_983 for x in s], np.uint64))
    want = [100 * len(base & r) >= share * len(base | r) for r in rows]
    assert ngram_join.linked_rows(spread(base), [spread(r) for r in rows], share, columns).tolist() == want


def test_hot_sketch_finds_what_is_scattered(spark):
    """A hash of 2,000 documents in 200 tasks is hot, although no task holds it often."""
    from tidemark.llm import hot

    width = 1 << 16
    told = []
    rng = np.random.default_rng(0)
    for _ in range(200):
        tally = hot.Tally(width)
        list(tally.add(np.concatenate([np.full(10, 77, np.uint64), rng.integers(0, 1 << 63, 300).astype(np.uint64)])))
        told += [(int(b), int(c)) for bucket, count in tally.rest() for b, c in zip(bucket, count, strict=True)]
    bits = hot.bitmap(spark.createDataFrame(told, "bucket long, times long"), width, 256)
    found = hot.is_hot(np.arange(width, dtype=np.uint64), bits)
    assert found[77] and found.sum() < 5


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: out.get(n, n) for n in range(1, 10)} == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(4, 10), 4)}


# ---- 10 url filter


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7x?q#f", "https://x.com/en/1", "net/de/1", None, "", "ftp://sub.example.net/de/81", "http://a.net/de/8", "http://org", "http://b.org/es/", "http://notcom/en/", "http://com/en/5", "x://h?/en/", "http://h\u00c4.ORG/es/\u00fc"] + [f"http://s.net/p/{i}" for i in range(30)] + ["http://s.net/p/1"] * 2
    pages = spark.createDataFrame([(i if i != 5 else None, u, "<p>", "z") for i, u in enumerate(urls)], "page_id long, url string, html string, template string")
    bad = spark.createDataFrame([(i, i % 30 != 0) for i in range(13, 43)], "page_id long, bad boolean")
    rows = url_filter.judged(pages, bad).collect()
    assert len(rows) == len(urls)

    def parse(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        path = rest[cut:]
        end = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]

    want = []
    for i, u in enumerate(urls):
        host, path = parse(u)
        fits = [(h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        want.append((i if i != 5 else None, host, path, *best))
    have = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in rows}
    assert have == {w[:4] for w in want}
    actions = {w[0]: w[4] for w in want}
    assert all(r["verdict"] == actions[r["page_id"]] for r in rows if r["rule"])
    spam = [r for r in rows if r["host"] == "s.net"]
    assert {r["template"] for r in spam} == {"/p/*"} and {r["verdict"] for r in spam} == {"block"}
    assert url_filter.judged(pages.limit(0), bad).count() == 0


def test_templates_of_deep_paths(spark):
    """Branches that differ at the tenth segment only are told apart; short paths and the empty one keep theirs."""
    stem = "/a/b/c/d/e/f/g/h/i"
    urls = [f"http://h.net{stem}/{x}/{i}" for x in ("good", "bad") for i in range(20)] + ["http://h.net/a", "http://h.net", "http://h.net/a/b", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([(i, i >= 20) for i in range(40)], "page_id long, bad boolean")
    rows = {r["page_id"]: (r["template"], r["verdict"]) for r in url_filter.judged(pages, marks).collect()}
    assert {rows[i] for i in range(20)} == {(f"{stem}/good/*", "allow")} and {rows[i] for i in range(20, 40)} == {(f"{stem}/bad/*", "block")}
    assert [rows[i][0] for i in range(40, 44)] == ["/a", "", "/a/b", ""]
