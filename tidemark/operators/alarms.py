"""Frozen-threshold alarms: upcrossings, calibration, detection, chance floors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
SERIES = ("series_id", "channel")


def upcrossings(z: DataFrame, tau: Column | str, keys: Sequence[str] = SERIES) -> DataFrame:
    """z with ``firing`` (above tau; no score does not fire) and ``upcross`` (firing and not so the row before)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    firing = F.coalesce(F.col("z") > (F.col(tau) if isinstance(tau, str) else tau), F.lit(False))
    return z.withColumn("firing", firing).withColumn("upcross", F.col("firing") & ~F.coalesce(F.lag("firing").over(w), F.lit(False)))


def threshold_sweep(block: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, tau, upcrossings) for every score of the block.

    A row is an upcrossing of tau if its predecessor is at most tau and it is above; so it
    adds one from its predecessor's score on and takes it off from its own: a running sum over scores.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    steps = block.withColumn("before", F.coalesce(F.lag("z").over(w), F.lit(float("-inf")))).where("z is not null and z > before")
    marks = steps.select(*keys, F.col("before").alias("at"), F.lit(1).alias("step")).unionByName(steps.select(*keys, F.col("z").alias("at"), F.lit(-1).alias("step")))
    marks = marks.unionByName(block.where("z is not null").select(*keys, F.col("z").alias("at"), F.lit(0).alias("step")))
    at = marks.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    run = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return at.select(*keys, F.col("at").alias("tau"), F.sum("step").over(run).alias("upcrossings")).where(F.col("tau") > float("-inf"))


def calibrated(block: DataFrame, target: float = 1.0, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, tau, block_far, target_count): the score whose yearly alarm count is closest to the target, the higher of ties."""
    size = block.groupBy(*keys).agg((F.count("z") / YEAR).alias("years"))
    goal = size.withColumn("target_count", F.greatest(F.lit(1), F.bround(F.lit(float(target)) * F.col("years")).cast("int")))
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col("upcrossings") - F.col("target_count")), F.col("tau").desc())
    best = threshold_sweep(block, keys).join(goal, list(keys)).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return best.select(*keys, "tau", F.try_divide("upcrossings", "years").alias("block_far"), "target_count")


def yearly_rate(fired: DataFrame, calm: Column, keys: Sequence[str] = SERIES) -> DataFrame:
    """Alarms that start on calm rows per year of calm rows."""
    return fired.where(calm).groupBy(*keys).agg(F.sum(F.col("upcross").cast("int")).alias("alarms"), F.count(F.lit(1)).alias("calm_rows")).withColumn("far", F.col("alarms") / (F.col("calm_rows") / YEAR))


def within_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows(series_id, pos, ...) of each span (series_id, crisis, lo, hi), with its crisis."""
    return rows.join(spans.select("series_id", "crisis", "lo", "hi"), "series_id").where(F.col("pos").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def detection(fired: DataFrame, spans: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Per event: whether it fires inside, how many rows after the start, and whether at once."""
    inside = within_spans(fired.select(*keys, "pos", "firing"), spans)
    out = inside.groupBy(*keys, "crisis").agg(F.min("pos").alias("start"), F.min(F.when(F.col("firing"), F.col("pos"))).alias("first_hit"))
    return out.select(*keys, "crisis", F.col("first_hit").isNotNull().alias("detected"), (F.col("first_hit") - F.col("start")).alias("delay"), F.coalesce(F.col("first_hit") == F.col("start"), F.lit(False)).alias("early"))


def chance_counts(fired: DataFrame, spans: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, shift, hits): events that fire under each circular shift 1..M - 1 of the alarm rows.

    A firing row f and an event's row p meet under shift (p - f) mod M. A run of firing rows f0..f1 thus meets an event p0..p1 under
    the shifts p0 - f1 to p1 - f0: one interval for each run and event. Intervals of an event are merged, and a running count of
    their starts and ends gives the hits.
    """
    w = Window.partitionBy(*keys)
    rows = fired.select(*keys, "pos", "firing").withColumn("m", (F.row_number().over(w.orderBy("pos")) - 1).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))
    event = within_spans(rows, spans).groupBy(*keys, "crisis").agg(F.min("m").alias("p0"), F.max("m").alias("p1"))
    run = rows.where("firing").withColumn("run", F.col("m") - F.row_number().over(w.orderBy("m")))
    run = run.groupBy(*keys, "run", "total").agg(F.min("m").alias("f0"), F.max("m").alias("f1"))
    length = F.least(F.col("total"), F.col("p1") - F.col("p0") + F.col("f1") - F.col("f0") + 1)
    met = event.join(run, list(keys)).select(*keys, "crisis", "total", F.pmod(F.col("p0") - F.col("f1"), F.col("total")).alias("a"), length.alias("n"))
    pieces = F.array(F.struct(F.col("a"), F.least("total", F.col("a") + F.col("n")).alias("b")), F.struct(F.lit(0).cast("long").alias("a"), (F.col("a") + F.col("n") - F.col("total")).alias("b")))
    pieces = met.select(*keys, "crisis", F.explode(pieces).alias("x")).select(*keys, "crisis", "x.a", "x.b").where("b > a")
    by = Window.partitionBy(*keys, "crisis").orderBy("a", "b")
    open_ = F.coalesce(F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = pieces.withColumn("island", (F.col("a") > open_).cast("int")).withColumn("island", F.sum("island").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*keys, "crisis", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    marks = merged.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("shift"), F.lit(1).alias("step")), F.struct(F.col("b").alias("shift"), F.lit(-1).alias("step")))).alias("x")).select(*keys, "x.*")
    marks = marks.groupBy(*keys, "shift").agg(F.sum("step").alias("step"))
    every = rows.groupBy(*keys).agg(F.first("total").alias("total")).where("total > 1").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("shift"))
    hits = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy(*keys).orderBy("shift").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(marks, [*keys, "shift"], "left").withColumn("hits", hits).where("shift > 0").select(*keys, "shift", "hits")


def chance_floor(counts: DataFrame, detected: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    real = detected.groupBy(*keys).agg(F.sum(F.col("detected").cast("int")).alias("detections"))
    return counts.join(real, list(keys)).groupBy(*keys).agg(
        F.first("detections").alias("detections"), F.avg("hits").alias("floor_mean"), F.percentile("hits", F.lit(0.95)).alias("floor_95"),
        ((1 + F.sum((F.col("hits") >= F.col("detections")).cast("int"))) / (1 + F.count(F.lit(1)))).alias("p"),
    )


def exceedance(fired: DataFrame, event: Column, calm: Column, keys: Sequence[str] = SERIES) -> DataFrame:
    """Share of firing rows inside events and on calm ones, in percent, and their ratio (infinite without calm ones)."""
    share = lambda where: 100.0 * F.avg(F.when(where, F.col("firing").cast("int")))
    out = fired.groupBy(*keys).agg(share(event).alias("event_pct"), share(calm).alias("calm_pct"))
    return out.withColumn("ratio", F.when(F.col("calm_pct") > 0, F.col("event_pct") / F.col("calm_pct")).otherwise(F.lit(float("inf"))))


def causality_audit(calendar: DataFrame) -> DataFrame:
    """PASS or FAIL of what a frozen fit must not see. calendar: (pos, block, forward, in_any)."""
    c = calendar.agg(F.sum((F.col("block") & F.col("in_any")).cast("int")).alias("leak"), F.max(F.when(F.col("block"), F.col("pos"))).alias("last"), F.min(F.when(F.col("forward"), F.col("pos"))).alias("first"), F.sum((F.col("block") & F.col("forward")).cast("int")).alias("both"))
    say = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    checks = [("no event row in the block", F.col("leak") == 0), ("block precedes deployment", F.col("last") < F.col("first")), ("block and deployment are apart", F.col("both") == 0)]
    return c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), say(ok).alias("result")) for n, ok in checks])).alias("x")).select("x.*")
