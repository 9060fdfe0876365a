"""Event windows on a calendar of rows: spans, contexts, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.registry import BUFFER_DAYS, EXTEND_ROWS, LEAST_HISTORY


def month_bounds(registry: DataFrame) -> DataFrame:
    return registry.select("crisis", F.to_date(F.concat("start_month", F.lit("-01"))).alias("first_day"), F.last_day(F.to_date(F.concat("end_month", F.lit("-01")))).alias("last_day"))


def business_days_before(day: Column, n: int) -> Column:
    """The n-th weekday strictly before a day, without holidays."""
    index = F.least(F.weekday(day), F.lit(5)) - n
    weeks = F.floor(index / 5)
    return F.date_add(day, (7 * weeks + index - 5 * weeks - F.weekday(day)).cast("int"))


def spans(calendar: DataFrame, registry: DataFrame, extend: int = EXTEND_ROWS) -> DataFrame:
    """(crisis, series_id, lo, hi, total): rows of each window, widened by ``extend`` rows and cut to the data.

    The registry is small by nature and is broadcast; windows without a row are absent.
    """
    bounds = F.broadcast(month_bounds(registry))
    size = calendar.groupBy("series_id").agg((F.max("pos") + 1).alias("total"))
    core = calendar.join(bounds, F.col("ts").between(F.col("first_day"), F.col("last_day"))).groupBy("crisis", "series_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return core.join(size, "series_id").select("crisis", "series_id", F.greatest(F.lit(0), F.col("a") - extend).alias("lo"), F.least(F.col("total") - 1, F.col("b") + extend).alias("hi"), "total")


def masks(calendar: DataFrame, spanned: DataFrame) -> DataFrame:
    """(crisis, series_id, ts, pos) of the rows inside each window."""
    return calendar.join(F.broadcast(spanned), "series_id").where(F.col("pos").between(F.col("lo"), F.col("hi"))).select("crisis", "series_id", "ts", "pos")


def contexts(calendar: DataFrame, registry: DataFrame, extend: int = EXTEND_ROWS, buffer: int = BUFFER_DAYS, least_history: int = LEAST_HISTORY) -> DataFrame:
    """One row per window with a row: its span, dates, fitting cutoff, history, and whether that is long enough."""
    s = spans(calendar, registry, extend)
    dated = masks(calendar, s).groupBy("crisis", "series_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_window"))
    dated = dated.join(s, ["crisis", "series_id"]).withColumn("cutoff", business_days_before(F.col("start"), buffer))
    history = calendar.select("series_id", "ts").join(F.broadcast(dated.select("crisis", "series_id", "cutoff")), "series_id").where("ts < cutoff").groupBy("crisis", "series_id").agg(F.count(F.lit(1)).alias("n_pre"))
    out = dated.join(history, ["crisis", "series_id"], "left").withColumn("n_pre", F.coalesce("n_pre", F.lit(0)))
    return out.select("crisis", "series_id", "start", "end", "cutoff", "n_window", "n_pre", "lo", "hi", "total", (F.col("n_pre") >= least_history).alias("usable"))


def any_event(calendar: DataFrame, spanned: DataFrame) -> DataFrame:
    """calendar with ``in_any``: whether a row lies in some window."""
    inside = masks(calendar, spanned).select("series_id", "pos").distinct().withColumn("hit", F.lit(True))
    return calendar.join(inside, ["series_id", "pos"], "left").withColumn("in_any", F.coalesce("hit", F.lit(False))).drop("hit")


def clean_lookback(marked: DataFrame, window: int = 60) -> DataFrame:
    """marked with ``clean``: none of the last ``window`` rows lies in an event, and there are as many."""
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(-(window - 1), 0)
    return marked.withColumn("clean", (F.sum(F.col("in_any").cast("int")).over(w) == 0) & (F.count("in_any").over(w) == window))


def membership(index: DataFrame, dates: DataFrame, name: str = "member") -> DataFrame:
    """index with whether its day is among ``dates``."""
    hit = dates.select("ts").distinct().withColumn(name, F.lit(True))
    return index.join(hit, "ts", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def eras(df: DataFrame, edges: list[int], column: str = "ts") -> DataFrame:
    """df with ``era``: the bucket of its year, named first-last."""
    label = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        label = F.when((F.year(column) >= lo) & (F.year(column) < hi), F.lit(f"{lo}-{hi - 1}")).otherwise(label)
    return df.withColumn("era", label)


def fractional_year(day: Column) -> Column:
    return F.year(day) + F.dayofyear(day) / F.lit(365.0)
