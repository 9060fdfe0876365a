"""Quality rules by weak supervision, on DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) from a text's counts. Whether a
document is good is never seen: expectation-maximisation over the vote patterns estimates
how many documents are good and, for good and for bad documents apart, how often each rule votes how. A
document is kept if its posterior probability of being good reaches ``keep_at``. A bad vote of a
rule that often errs is thus outvoted, unlike with filters that all must pass, and good votes that
bad documents get as well count for nothing.

There are at most 3^len(RULES) vote patterns, however many documents; their counts are all that
the driver sees, and the fitted model goes back as a linear expression of the votes.
The rates have a prior of a hundredth of the documents. The model is a monotone one: in each round, the log odds that a good vote adds are cut
off at 0 from below and those of a bad vote from above, before documents are judged with them, so a good vote never counts against a document nor a bad
one for it. The posterior is that of the model so constrained, not of free rates.

The counts follow the contract of op2: n_words, word_chars, n_symbols, n_dup_lines (lines with a word
equal to an earlier one), n_repeat_words (words in 8-word windows found at least twice). ``base_failed``
documents are never kept, and the fit leaves them out: it is to judge the others.

Cases: a null or empty text has counts 0 and fails; ties and repeated rows are judged
each on its own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, written

WINDOW = 8


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """docs' ids (and ``keep``) with the counts that the rules use."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    df = docs.select("doc_id", *keep, text.alias("t"))
    df = df.select("doc_id", *keep, "t", words.alias("words"), lines.alias("lines"))
    df = df.select(
        "doc_id", *keep,
        n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("t", F.lit(r"[.!?;:](?=\s|$)")).cast("long").alias("n_stops"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    windows = F.when(F.size("hashed") >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size("hashed") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("hashed", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("n_distinct", F.size(F.array_distinct("hashed")).cast("long")).withColumn("windows", windows).drop("hashed")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.withColumn("ordered", ordered).drop("windows")
    same = lambda s, j: F.coalesce(F.get(F.col("ordered"), j)["x"] == s["x"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(F.transform("ordered", lambda s, j: F.when(same(s, j - 1) | same(s, j + 1), s["i"])), lambda i: i.isNotNull()), lambda i: i))
    df = df.withColumn("starts", starts).drop("ordered")
    gap = lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), j + 1) - i, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("starts", gap), F.lit(0).cast("long"), lambda a, g: a + g)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes; each column is one rule."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    return {
        "length": F.when(c("n_words") >= 40, 1).otherwise(0),  # too short a text has failed before
        "word_length": _vote((c("word_chars") < 2 * n) | (c("word_chars") > 14 * n), c("word_chars").between(3 * n, 11 * n)),
        "symbols": _vote(c("n_symbols") * 10 > n, c("n_symbols") * 100 <= n),
        "lines": _vote(c("n_dup_lines") * 10 > 3 * c("n_lines"), (c("n_lines") >= 2) & (c("n_dup_lines") * 20 <= c("n_lines"))),
        "repeats": _vote(c("n_repeat_words") * 5 > n, (c("n_words") >= WINDOW) & (c("n_repeat_words") * 20 <= n)),
        "letters": _vote(c("n_letters") * 100 < 88 * c("word_chars"), c("n_letters") * 100 >= 93 * c("word_chars")),
        "variety": _vote((c("n_words") >= 20) & (c("n_distinct") * 10 < n), c("n_distinct") * 100 >= 25 * n),
        "sentences": _vote((c("n_words") >= 40) & ((c("n_stops") * 100 < 2 * n) | (c("n_stops") * 3 > n)), c("n_stops").between(n / 25, n / 5)),
    }


#: Prior shares of bad, no and good votes among good and among bad documents.
PRIOR = {True: (0.05, 0.35, 0.60), False: (0.45, 0.35, 0.20)}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[tuple[float, float, float]]]:
    """(log odds of good, for each rule the log odds that a bad vote, none and a good vote add) from vote patterns and counts."""
    k = len(patterns[0][0]) if patterns else 0
    total = sum(c for _, c in patterns)
    if not total:
        return 0.0, []
    strength = max(1.0, total / 100)
    odds, weights = 0.0, [(0.0, 0.0, 0.0)] * k
    posterior = [(0.97, 0.3, 0.05)[min(2, sum(x < 0 for x in v))] for v, _ in patterns]
    for _ in range(rounds):
        held = {True: [[strength * p for p in PRIOR[True]] for _ in range(k)], False: [[strength * p for p in PRIOR[False]] for _ in range(k)]}
        good = 0.0
        for (v, count), q in zip(patterns, posterior, strict=True):
            good += q * count
            for j, x in enumerate(v):
                held[True][j][x + 1] += q * count
                held[False][j][x + 1] += (1 - q) * count
        share = (good + 0.85 * strength) / (total + strength)
        odds, weights = math.log(share / (1 - share)), []
        for g, b in zip(held[True], held[False], strict=True):
            bad, none, fine = (math.log(x / sum(g)) - math.log(y / sum(b)) for x, y in zip(g, b, strict=True))
            weights.append((min(bad, 0.0), none, max(fine, 0.0)))
        before = posterior
        posterior = []
        for v, _ in patterns:
            z = odds + sum(w[x + 1] for w, x in zip(weights, v, strict=True))
            posterior.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        if max(abs(x - y) for x, y in zip(before, posterior, strict=True)) < 1e-9:
            break
    return odds, weights


def judged(docs: DataFrame, *keep: str, keep_at: float = 0.5, min_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """Counts, votes, ``base_failed``, ``posterior`` and ``kept``."""
    votes = rules()
    names = [f"vote_{r}" for r in votes]
    df = measured(docs, *keep).select("*", *[v.alias(f"vote_{r}") for r, v in votes.items()])
    df = written(df, "votes")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    seen = df.where(~failed).groupBy(*names).count().collect()  # 3^len(rules) rows at most
    log_good, weights = fit([(tuple(r[x] for x in names), r["count"]) for r in sorted(seen)])
    z = F.lit(log_good)
    for x, (bad, none, fine) in zip(names, weights or [(0.0, 0.0, 0.0)] * len(names), strict=True):
        z = z + F.when(F.col(x) < 0, bad).when(F.col(x) > 0, fine).otherwise(none)
    return df.withColumn("posterior", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= keep_at))


def kept_docs(docs: DataFrame, **kw) -> DataFrame:
    """docs that are kept, with all their columns; these travel as one, so no name can clash."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    return judged(rows, "whole_row", **kw).where("kept").select("whole_row.*")


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
