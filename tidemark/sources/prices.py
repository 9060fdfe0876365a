"""Price panels: loaders, snapshot sink, adapters of the sample tables, and generators.

A panel is (series_id, ts, one column per asset), complete rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values: (volatility, correlation, drift) of daily log returns outside and inside an event.
CALM, STRESSED = (0.008, 0.30, 0.0003), (0.030, 0.85, -0.0020)
#: Sign of each asset's risk direction.
SIGNS = {"SPY": 1, "GLD": 1, "TLT": 1, "UUP": -1}


def clean(df: DataFrame, assets: Sequence[str]) -> DataFrame:
    """NaN becomes NULL; rows with any missing asset go."""
    return df.select(*[c for c in df.columns if c not in assets], *[F.nanvl(F.col(a), F.lit(None).cast("double")).alias(a) for a in assets]).na.drop("any", subset=list(assets))


def load_prices(
    spark: SparkSession,
    path: str,
    assets: Sequence[str],
    start: str | None = None,
    end: str | None = None,
    fetch: Callable[[], DataFrame] | None = None,
    refresh: bool = False,
    series_id: str = "prices",
) -> DataFrame:
    """A CSV (or parquet) snapshot with a Date column, filtered to [start, end).

    Without a snapshot, or with ``refresh``, ``fetch`` provides the rows and the snapshot
    is written first. A missing asset raises KeyError.
    """
    if fetch is not None and (refresh or not _exists(spark, path)):
        save_snapshot(fetch(), path)
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        header = spark.read.option("header", True).csv(path).columns
        raw = spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.DateType() if c == "Date" else T.DoubleType()) for c in header])).csv(path)
    missing = [c for c in ("Date", *assets) if c not in raw.columns]
    if missing:
        raise KeyError(f"snapshot {path} lacks {missing}")
    df = raw.select(F.lit(series_id).alias("series_id"), F.col("Date").cast("date").alias("ts"), *assets)
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("ts") < F.lit(end).cast("date"))
    return clean(df, assets)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_snapshot(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite")
    writer.parquet(path) if path.endswith(".parquet") else writer.option("header", True).csv(path)


def snapshot_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file of a snapshot."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _average_prices(spark: SparkSession, sf_dir: str, by: str, values: dict[str, str], series_id: str) -> DataFrame:
    """Day by asset: revenue over quantity; one shuffle, partial sums before it."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", by, "l_extendedprice", "l_quantity")
    sums = [F.sum(F.when(F.col(by) == v, F.col(c))).alias(f"{a}_{c}") for v, a in values.items() for c in ("l_extendedprice", "l_quantity")]
    daily = items.groupBy(F.col("l_shipdate").cast("date").alias("ts")).agg(*sums)
    price = [F.try_divide(f"{a}_l_extendedprice", f"{a}_l_quantity").alias(a) for a in values.values()]
    return clean(daily.select(F.lit(series_id).alias("series_id"), "ts", *price), list(values.values()))


def two_asset_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _average_prices(spark, sf_dir, "l_linestatus", {"F": "f", "O": "o"}, "px2")


def three_asset_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _average_prices(spark, sf_dir, "l_returnflag", {"A": "a", "N": "n", "R": "r"}, "px3")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean value of each event type, long: (series_id, ts, value)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as feature rows: (series_id, pos, x)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("embeddings").alias("series_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("x"))


def _frame(spark: SparkSession, days: np.ndarray, prices: np.ndarray, names: Sequence[str], series_id: str, **more) -> DataFrame:
    rows = [(series_id, d.item(), *map(float, p), *x) for d, p, *x in zip(days, prices, *more.values(), strict=True)]
    fields = [T.StructField("series_id", T.StringType()), T.StructField("ts", T.DateType()), *[T.StructField(n, T.DoubleType()) for n in names], *[T.StructField(n, T.BooleanType()) for n in more]]
    return spark.createDataFrame(rows, T.StructType(fields))


def business_days(start: str, n: int) -> np.ndarray:
    return np.busday_offset(np.datetime64(start, "D"), np.arange(n), roll="forward")


def synthetic_returns(stressed: np.ndarray, seed: int) -> np.ndarray:
    """Two correlated daily returns a row, by the regime of the row."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(stressed), 2))
    for t, s in enumerate(stressed):
        vol, corr, drift = STRESSED if s else CALM
        out[t] = rng.multivariate_normal([drift, drift], vol * vol * np.array([[1, corr], [corr, 1]]))
    return out


def synthetic_prices(spark: SparkSession, rows: int = 2000, event: tuple[int, int] = (1000, 1120), seed: int = 1) -> DataFrame:
    """A two-asset panel of business days with one stressed stretch; ``in_event`` marks it."""
    inside = (np.arange(rows) >= event[0]) & (np.arange(rows) < event[1])
    prices = 100 * np.exp(np.cumsum(synthetic_returns(inside, seed), 0))
    return _frame(spark, business_days("2015-01-01", rows), prices, ("SPY", "DIA"), "synthetic", in_event=inside.tolist())


def synthetic_on_calendar(spark: SparkSession, days: np.ndarray, mask: np.ndarray, seed: int = 11, drift_only: bool = False, drift: float = STRESSED[2]) -> DataFrame:
    """The same regimes on any days, stressed where the mask is set; ``drift_only`` changes nothing but the drift."""
    z = np.random.default_rng(seed).standard_normal((len(days), 2))
    vol = np.where(mask & ~np.bool_(drift_only), STRESSED[0], CALM[0])
    corr = np.where(mask & ~np.bool_(drift_only), STRESSED[1], CALM[1])
    trend = np.where(mask, drift if drift_only else STRESSED[2], CALM[2])
    second = corr * z[:, 0] + np.sqrt(np.maximum(1 - corr**2, 0)) * z[:, 1]
    returns = trend[:, None] + vol[:, None] * np.stack([z[:, 0], second], 1)
    return _frame(spark, days, 100 * np.exp(np.cumsum(returns, 0)), ("SPY", "DIA"), "calendar", in_event=mask.tolist())


def distributed_synthetic(spark: SparkSession, rows: int, series: int = 1, seed: int = 1) -> DataFrame:
    """Calm two-asset paths for many series at once, drawn on the executors."""
    from pyspark.sql import Window

    vol, corr, drift = CALM
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    base = spark.range(rows * series).select(F.concat(F.lit("s"), (F.col("id") / rows).cast("long")).alias("series_id"), F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") % rows).cast("int")).alias("ts"), F.randn(seed).alias("u"), F.randn(seed + 1).alias("v"))
    second = corr * F.col("u") + float(np.sqrt(1 - corr**2)) * F.col("v")
    return base.select("series_id", "ts", (100 * F.exp(F.sum(drift + vol * F.col("u")).over(w))).alias("SPY"), (100 * F.exp(F.sum(drift + vol * second).over(w))).alias("DIA"))
