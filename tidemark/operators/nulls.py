"""Null distributions of window effect sizes, on prefix sums and equi-joins.

``finite(z)`` drops rows without a score and renumbers each series from 0 to M - 1; a window is
(lo, len) on these numbers. Sums over any window, wrapped ones too, are differences of two rows of the
running sums of the doubled series, so all M - 1 shifts of a series cost two joins of M rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats

#: What names a series: every operator here works on many at once.
SERIES = ("series_id", "channel")


def unique(*names: str) -> list[str]:
    return list(dict.fromkeys(names))


def finite(z: DataFrame, keys: Sequence[str] = SERIES, value: str = "z") -> DataFrame:
    """Rows with a score, renumbered as ``m``, with the series' length ``total``."""
    w = Window.partitionBy(*keys)
    f = z.where(F.col(value).isNotNull())
    return f.withColumn("m", (F.row_number().over(w.orderBy("pos")) - 1).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))


def aligned_panel(z: DataFrame, crises: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows of a per-crisis panel whose score is present for every crisis."""
    w = Window.partitionBy(*keys, "pos")
    return z.withColumn("present", F.count("z").over(w)).where(F.col("present") == crises).drop("present")


def lost_windows(fin: DataFrame, win: DataFrame, spans: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, crisis) of the windows that no row is left of in some series; alignment should lose none."""
    every = fin.select(*keys).distinct()
    every = every if "crisis" in keys else every.join(spans.select("series_id", "crisis"), "series_id")
    return every.join(win.select(*unique(*keys, "crisis")), unique(*keys, "crisis"), "left_anti")


def windows(fin: DataFrame, spans: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, crisis, lo, hi, len) of each span (series_id, crisis, lo, hi) on the renumbered rows."""
    hit = fin.select(*keys, "pos", "m", "total").join(spans.select("series_id", "crisis", F.col("lo").alias("from_pos"), F.col("hi").alias("to_pos")), unique("series_id", *(["crisis"] if "crisis" in keys else [])))
    hit = hit.where(F.col("pos").between(F.col("from_pos"), F.col("to_pos")))
    return hit.groupBy(*unique(*keys, "crisis")).agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count(F.lit(1)).alias("len"), F.first("total").alias("total"))


def prefix_sums(fin: DataFrame, keys: Sequence[str] = SERIES, value: str = "z") -> DataFrame:
    """(keys, i, c1, c2): sums of value and its square over the first i rows of the doubled series, i from 0 to 2M."""
    doubled = fin.select(*keys, "m", value).unionByName(fin.select(*keys, (F.col("m") + F.col("total")).alias("m"), value))
    w = Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    run = doubled.select(*keys, (F.col("m") + 1).alias("i"), F.sum(value).over(w).alias("c1"), F.sum(F.col(value) * F.col(value)).over(w).alias("c2"))
    return run.unionByName(fin.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("c1"), F.lit(0.0).alias("c2")))


def abs_d(s1: Column, s2: Column, t1: Column, t2: Column, n: Column, total: Column) -> Column:
    """|effect size| of n rows with sums s1, s2 against the rest of ``total`` rows with sums t1, t2."""
    rest, r1, r2 = total - n, t1 - s1, t2 - s2
    zero = F.lit(0.0)
    inner, outer = F.greatest(s2 - s1 * s1 / n, zero), F.greatest(r2 - r1 * r1 / rest, zero)
    sp = F.sqrt((inner + outer) / (total - 2))
    return F.when((n >= 1) & (rest >= 1) & (total > 2), F.when(sp > 0, F.abs((s1 / n - r1 / rest) / sp)).otherwise(0.0))


def placed(starts: DataFrame, sums: DataFrame, keys: Sequence[str] = SERIES, gap: bool = False) -> DataFrame:
    """starts(keys, start, len, total, ...) with ``d`` (and ``gap``, the mean inside less that outside): equi-joins on the running sums."""
    at = lambda n: sums.select(*keys, F.col("i").alias(f"{n}_i"), F.col("c1").alias(f"{n}1"), F.col("c2").alias(f"{n}2"))
    cols = starts.columns
    ends = starts.withColumn("a_i", F.col("start").cast("long")).withColumn("b_i", (F.col("start") + F.col("len")).cast("long")).withColumn("t_i", F.col("total").cast("long"))
    j = ends.join(at("a"), [*keys, "a_i"]).join(at("b"), [*keys, "b_i"]).join(at("t"), [*keys, "t_i"])
    c = F.col
    one = c("b1") - c("a1")
    d = abs_d(one, c("b2") - c("a2"), c("t1"), c("t2"), c("len"), c("total"))
    return j.select(*cols, d.alias("d"), *([F.try_subtract(one / c("len"), F.try_divide(c("t1") - one, c("total") - c("len"))).alias("gap")] if gap else []))


def real_windows(win: DataFrame, sums: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return placed(win.withColumn("start", F.col("lo")), sums, keys).withColumnRenamed("d", "real")


def shift_draws(win: DataFrame, sums: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """One draw for each circular shift 1..M - 1 of the series under the fixed window; draw_id is the shift."""
    shifts = win.where("total > 1").withColumn("draw_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total") - 1)))
    return placed(shifts.withColumn("start", F.pmod(F.col("lo") - F.col("draw_id"), F.col("total"))), sums, keys)


def window_candidates(win: DataFrame) -> DataFrame:
    """Every start of a window as long as the event's and free of it; draw_id is the start."""
    starts = win.where("total >= len").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - F.col("len"))))
    return starts.where((F.col("start") + F.col("len") - 1 < F.col("lo")) | (F.col("start") > F.col("hi"))).withColumn("draw_id", F.col("start"))


def window_draws(win: DataFrame, sums: DataFrame, keys: Sequence[str] = SERIES, draws: int | None = None, seed: int = 42) -> DataFrame:
    """Effect sizes of the candidates: all of them, or ``draws`` with replacement, from a hash of (keys, crisis, draw, seed)."""
    every = placed(window_candidates(win), sums, keys)
    if draws is None:
        return every
    names = unique(*keys, "crisis")
    w = Window.partitionBy(*names)
    numbered = every.withColumn("nth", F.row_number().over(w.orderBy("start")) - 1).withColumn("pool", F.count(F.lit(1)).over(w))
    pools = numbered.groupBy(*names).agg(F.first("pool").alias("pool"))
    picks = pools.withColumn("pick_id", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select(*names, "pick_id", F.pmod(hashed(*names, "pick_id", F.lit(seed)), F.col("pool")).alias("nth"))
    return picks.join(numbered.drop("draw_id"), [*names, "nth"]).withColumnRenamed("pick_id", "draw_id").drop("nth", "pool")


def hashed(*parts) -> Column:
    """A number of 48 bits from the text of parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("long")


def summary(draws: DataFrame, real: DataFrame, keys: Sequence[str] = (*SERIES, "crisis")) -> DataFrame:
    """Median, 2.5 and 97.5 percentile of the draws, p-value and percentile of the real value."""
    both = draws.select(*keys, "d").join(real.select(*keys, "real"), list(keys))
    return both.groupBy(*keys).agg(
        F.first("real").alias("real"), F.count("d").alias("draws"), F.percentile("d", F.lit(0.5)).alias("med"), F.percentile("d", F.lit(0.025)).alias("lo95"), F.percentile("d", F.lit(0.975)).alias("hi95"),
        *stats.empirical(F.col("d"), F.col("real")),
    )


def floored(summed: DataFrame, tau: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p-values no smaller than the effective size resolves."""
    return summed.join(tau, list(keys)).withColumn("p", F.greatest("p_raw", 1 / (F.col("n_eff") + 1)))


def panel_statistics(draws: DataFrame, real: DataFrame, statistic: str = "median", keys: Sequence[str] = SERIES) -> DataFrame:
    """A statistic over crises of the real values against the same of each draw."""
    f = {"median": F.median, "mean": F.avg, "max": F.max}[statistic]
    truth = real.groupBy(*keys).agg(f("real").alias("real"))
    null = draws.groupBy(*keys, "draw_id").agg(f("d").alias("d"))
    return summary(null, truth, keys).withColumn("statistic", F.lit(statistic))


def count_statistic(draws: DataFrame, real: DataFrame, pct: float = 95.0, keys: Sequence[str] = SERIES) -> DataFrame:
    """How many crises exceed their own null percentile, against how many each draw does."""
    thresholds = draws.groupBy(*unique(*keys, "crisis")).agg(F.percentile("d", F.lit(pct / 100)).alias("threshold"))
    truth = real.join(thresholds, [*keys, "crisis"]).groupBy(*keys).agg(F.sum((F.col("real") > F.col("threshold")).cast("int")).alias("real"), F.sort_array(F.collect_list(F.when(F.col("real") > F.col("threshold"), F.col("crisis")))).alias("which"))
    null = draws.join(thresholds, [*keys, "crisis"]).groupBy(*keys, "draw_id").agg(F.sum((F.col("d") > F.col("threshold")).cast("int")).alias("d"))
    out = null.join(truth, list(keys)).groupBy(*keys).agg(F.first("real").alias("count"), F.first("which").alias("which"), F.avg("d").alias("null_mean"), F.percentile("d", F.lit(0.95)).alias("null_95"), *stats.empirical(F.col("d"), F.col("real")))
    return out.withColumnRenamed("p_raw", "p").drop("pct")


def trend_matched(win: DataFrame, sums: DataFrame, moves: DataFrame, share: float = 0.10, keys: Sequence[str] = SERIES) -> DataFrame:
    """Draws from the candidates whose summed return is closest to the event's: the nearest ``share``, ties by start.

    ``moves``: running sums (keys, i, c1, c2) of the returns on the same rows.
    """
    at = lambda n: moves.select(*keys, F.col("i").alias(f"{n}_i"), F.col("c1").alias(f"{n}_c"))

    def moved(df: DataFrame, start: Column, name: str) -> DataFrame:
        e = df.withColumn("a_i", start.cast("long")).withColumn("b_i", (start + F.col("len")).cast("long"))
        return e.join(at("a"), [*keys, "a_i"]).join(at("b"), [*keys, "b_i"]).withColumn(name, -(F.col("b_c") - F.col("a_c"))).drop("a_i", "b_i", "a_c", "b_c")

    own = moved(win, F.col("lo"), "own_move").select(*keys, "crisis", "own_move")
    cand = moved(placed(window_candidates(win), sums, keys), F.col("start"), "move").join(own, [*keys, "crisis"])
    w = Window.partitionBy(*keys, "crisis")
    near = cand.withColumn("nth", F.row_number().over(w.orderBy(F.round(F.abs(F.col("move") - F.col("own_move")), 12), "start"))).withColumn("pool", F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * F.lit(share))))
    return near.where("nth <= pool").drop("nth")


def shifted_mask_curve(fin: DataFrame, win: DataFrame, sums: DataFrame, grid: Sequence[int] = tuple(range(-60, 61, 10)), keys: Sequence[str] = SERIES) -> DataFrame:
    """|effect size| of each event's window moved by each step of the grid, around the series' ends."""
    moved = win.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in grid]))).withColumn("start", F.pmod(F.col("lo") + F.col("shift"), F.col("total")))
    return placed(moved, sums, keys)


def block_starts(blocks: DataFrame, reps: int, keys: Sequence[str] = SERIES, seed: int = 42) -> DataFrame:
    """blocks(keys, block, total) -> (keys, rep, start, len): circular block starts from a hash, the last block cut to the series' length."""
    n = F.ceil(F.col("total") / F.col("block"))
    every = blocks.select(*keys, "block", "total", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), n.alias("n")).withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    size = F.when(F.col("block_no") == F.col("n") - 1, F.col("total") - F.col("block_no") * F.col("block")).otherwise(F.col("block")).cast("long")
    return every.select(*keys, "rep", F.pmod(hashed("rep", "block_no", F.lit(seed)), F.col("total")).alias("start"), size.alias("len"))


def block_bootstrap(win: DataFrame, sums: DataFrame, starts: DataFrame, keys: Sequence[str] = SERIES, by: Sequence[str] = SERIES, least_days: int = 10) -> DataFrame:
    """(keys, crisis, rep, d): one resample of a series' rows for all its crises at once; thin crises of a resample are left out.

    A block holds of a window what their intervals share on the doubled series, so sums inside and over all are differences of running sums. ``by``:
    the part of keys that blocks are drawn for.
    """
    names = unique(*keys, "crisis")
    b = starts.select(*by, "rep", F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e"))
    met = win.select(*names, "lo", "hi", "total").join(b, list(by))
    parts = F.array(F.struct(F.lit(0).alias("kind"), F.col("s").alias("a"), F.col("e").alias("b")), *[F.struct(F.lit(1).alias("kind"), F.greatest(F.col("s"), F.col("lo") + o).alias("a"), F.least(F.col("e"), F.col("hi") + 1 + o).alias("b")) for o in (F.lit(0).cast("long"), F.col("total"))])
    cut = met.select(*names, "rep", "total", F.explode(parts).alias("x")).select(*names, "rep", "total", "x.kind", F.col("x.a").alias("a_i"), F.col("x.b").alias("b_i")).where("b_i > a_i")
    at = lambda n: sums.select(*keys, F.col("i").alias(f"{n}_i"), F.col("c1").alias(f"{n}1"), F.col("c2").alias(f"{n}2"))
    j = cut.join(at("a"), [*keys, "a_i"]).join(at("b"), [*keys, "b_i"])
    one, two = F.col("b1") - F.col("a1"), F.col("b2") - F.col("a2")
    pick = lambda kind, v: F.sum(F.when(F.col("kind") == kind, v).otherwise(0))
    acc = j.groupBy(*names, "rep", "total").agg(pick(1, one).alias("s1"), pick(1, two).alias("s2"), pick(0, one).alias("t1"), pick(0, two).alias("t2"), pick(1, F.col("b_i") - F.col("a_i")).alias("k"))
    c = F.col
    return acc.where((c("k") >= least_days) & (c("total") - c("k") >= 2)).select(*names, "rep", abs_d(c("s1"), c("s2"), c("t1"), c("t2"), c("k"), c("total")).alias("d"))


def bootstrap_interval(resampled: DataFrame, crises: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """95 % interval of the panel median, and how often crises had to be left out."""
    med = resampled.groupBy(*keys, "rep").agg(F.median("d").alias("med"), F.count("d").alias("kept"))
    return med.groupBy(*keys).agg(F.percentile("med", F.lit(0.025)).alias("lo"), F.percentile("med", F.lit(0.975)).alias("hi"), F.avg("kept").alias("kept_mean"), F.min("kept").alias("kept_min"), F.avg((F.col("kept") < crises).cast("double")).alias("dropped_share"))


def verdicts(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p(series_id, channel, family, p) with q over the whole family, and what each channel clears."""
    q = stats.benjamini_hochberg(p, "p", ties=("channel", "family", "series_id"))
    wide = q.groupBy("series_id", "channel").pivot("family", ["a", "b"]).agg(F.first("p").alias("p"), F.first("q").alias("q"))
    clear = lambda x: F.coalesce(F.col(f"{x}_p") < alpha, F.lit(False))
    return wide.withColumn("verdict", F.when(clear("a") & clear("b"), "CLEARS BOTH").when(clear("a"), "(a) only").when(clear("b"), "(b) only").otherwise("neither"))
