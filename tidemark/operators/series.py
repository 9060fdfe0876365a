"""Window features of ordered series. Every frame is partitioned by series_id and ordered by pos (or ts)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels


def ordered(*keys: str, by: str = "ts"):
    return Window.partitionBy(*(keys or ("series_id",))).orderBy(by)


def positioned(df: DataFrame, *keys: str, by: str = "ts", name: str = "pos") -> DataFrame:
    """Rows numbered from 0 within each series."""
    return df.withColumn(name, (F.row_number().over(ordered(*keys, by=by)) - 1).cast("long"))


def full(value: Column, counted: Column | str, rows: int, over) -> Column:
    """A rolling value where the frame has all its rows, else null."""
    return F.when(F.count(counted).over(over) == rows, value.over(over))


def log_returns(prices: DataFrame, assets: Sequence[str]) -> DataFrame:
    w = ordered()
    return prices.select("series_id", "ts", *[(F.ln(a) - F.lag(F.ln(a)).over(w)).alias(f"{a}_ret") for a in assets])


def safe_corr(a: str, b: str, rows: int, over) -> Column:
    """Rolling correlation; null for short frames and constant sides."""
    varies = (F.stddev_pop(a).over(over) > 0) & (F.stddev_pop(b).over(over) > 0)
    whole = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(over) == rows
    return F.when(whole & varies, F.corr(a, b).over(over))


def two_asset_features(prices: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Return, volatility and momentum over 5 and 20 rows of both assets, and their correlation over 20; complete rows, numbered."""
    if len(assets) != 2:
        raise ValueError(f"two assets are needed, got {list(assets)}")
    w = {n: ordered().rowsBetween(-(n - 1), 0) for n in (5, 20)}
    out = []
    for a in assets:
        r = f"{a}_ret"
        out += [F.col(r)] + [full(F.stddev_samp(r), r, n, w[n]).alias(f"{a}_vol{n}") for n in w] + [full(F.avg(r), r, n, w[n]).alias(f"{a}_mom{n}") for n in w]
    out.append(safe_corr(f"{assets[0]}_ret", f"{assets[1]}_ret", 20, w[20]).alias("xcorr20"))
    return positioned(log_returns(prices, assets).select("series_id", "ts", *out).na.drop("any"))


TWO_ASSET = tuple(f"{{{i}}}_{k}" for i in (0, 1) for k in ("ret", "vol5", "vol20", "mom5", "mom20")) + ("xcorr20",)


def feature_names(assets: Sequence[str]) -> list[str]:
    return [t.format(*assets) for t in TWO_ASSET]


def pair_correlations(returns: DataFrame, assets: Sequence[str], window: int = 60) -> DataFrame:
    """returns with one rolling correlation column for each pair; null unless the window is complete for all assets."""
    w = ordered().rowsBetween(-(window - 1), 0)
    complete = F.count(F.when(F.greatest(*[F.col(f"{a}_ret").isNull() for a in assets]), None).otherwise(1)).over(w) == window
    pairs = [(a, b) for i, a in enumerate(assets) for b in assets[i + 1 :]]
    return returns.select("*", *[F.when(complete, safe_corr(f"{a}_ret", f"{b}_ret", window, w)).alias(f"corr_{a}_{b}") for a, b in pairs])


def aligned_mean_correlation(correlated: DataFrame, assets: Sequence[str], signs: dict[str, int]) -> DataFrame:
    """Mean signed pair correlation; an asset without a sign raises KeyError."""
    missing = [a for a in assets if a not in signs]
    if missing:
        raise KeyError(f"no sign for {missing}")
    terms = [signs[a] * signs[b] * F.col(f"corr_{a}_{b}") for i, a in enumerate(assets) for b in assets[i + 1 :]]
    return correlated.withColumn("risk_aligned_mean_corr", sum(terms[1:], terms[0]) / len(terms))


def spectral_aggregates(correlated: DataFrame, assets: Sequence[str], loading_of: str | None = None) -> DataFrame:
    """Absorption ratio of the rolling correlation matrices, and the squared leading loading of one asset."""
    k = len(assets)
    cols = [f"corr_{a}_{b}" for i, a in enumerate(assets) for b in assets[i + 1 :]]
    upper = np.triu_indices(k, 1)
    at = list(assets).index(loading_of or assets[0])

    @F.pandas_udf("absorption_ratio double, leading_loading double")
    def spectrum(c: pd.Series) -> pd.DataFrame:
        m = np.array([[np.nan] * len(cols) if x is None else list(x) for x in c], float).reshape(-1, len(cols))
        ok = ~np.isnan(m).any(1)
        full_ = np.zeros((int(ok.sum()), k, k)) + np.eye(k)
        full_[:, upper[0], upper[1]] = full_[:, upper[1], upper[0]] = m[ok]
        out = np.full((len(m), 2), np.nan)
        if ok.any():
            out[ok, 0], out[ok, 1] = kernels.absorption_ratio(full_), kernels.leading_loading(full_, at)
        return pd.DataFrame({"absorption_ratio": out[:, 0], "leading_loading": out[:, 1]})

    return correlated.withColumn("spectrum", spectrum(F.array(*cols))).select("*", "spectrum.absorption_ratio", "spectrum.leading_loading").drop("spectrum")


def absorption_ratio_closed(a: str, b: str, c: str) -> Column:
    """The absorption ratio of three assets from their correlations, without an eigensolver."""
    q = F.pow(a, F.lit(2)) + F.pow(b, F.lit(2)) + F.pow(c, F.lit(2))
    arg = F.col(a) * F.col(b) * F.col(c) / F.pow(q / 3, F.lit(1.5))
    return F.when(q > 0, (1 + 2 * F.sqrt(q / 3) * F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), arg))) / 3)) / 3).when(q == 0, F.lit(1.0) / 3)


def multi_asset_features(prices: DataFrame, assets: Sequence[str], aggregate: str = "absorption_ratio", window: int = 60, signs: dict[str, int] | None = None) -> DataFrame:
    """Return and volatility of each asset and one co-movement aggregate; complete rows, numbered."""
    if len(assets) < 2 or aggregate not in ("absorption_ratio", "risk_aligned_mean_corr"):
        raise ValueError("two assets or more, and a known aggregate, are needed")
    c = pair_correlations(log_returns(prices, assets), assets, window)
    c = spectral_aggregates(c, assets) if aggregate == "absorption_ratio" else aligned_mean_correlation(c, assets, signs or dict.fromkeys(assets, 1))
    w20 = ordered().rowsBetween(-19, 0)
    cols = [x for a in assets for x in (F.col(f"{a}_ret"), full(F.stddev_samp(f"{a}_ret"), f"{a}_ret", 20, w20).alias(f"{a}_vol20"))]
    return positioned(c.select("series_id", "ts", *cols, aggregate).na.drop("any"))


def controls(prices: DataFrame, asset: str, vol: int = 20, peak: int = 252, back: int = 126) -> DataFrame:
    """Realized volatility, drawdown from the trailing peak (short frames allowed) and minus the trailing log return."""
    w, lp = ordered(), F.ln(asset)
    wide = prices.select("series_id", "ts", asset, (lp - F.lag(lp).over(w)).alias("ret"), (F.lag(lp, back).over(w) - lp).alias("trailing_return"))
    return wide.select(
        "series_id", "ts", "ret",
        full(F.stddev_samp("ret"), "ret", vol, w.rowsBetween(-(vol - 1), 0)).alias("realized_vol"),
        (1 - F.col(asset) / F.max(asset).over(w.rowsBetween(-(peak - 1), 0))).alias("drawdown"),
        "trailing_return",
    )


def long_form(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("series_id", "ts", "pos")) -> DataFrame:
    """(keys, channel, value) of wide channels, NaN as null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in channels])
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.channel", "x.value")


def causal_zscore(values: DataFrame, keys: Sequence[str] = ("series_id", "channel"), smooth: int = 20, warm_up: int = 60, name: str = "z") -> DataFrame:
    """Trailing mean against mean and deviation of all its earlier values; null in the first rows and without spread."""
    w = Window.partitionBy(*keys).orderBy("pos")
    s = values.withColumn("s", F.avg("value").over(w.rowsBetween(-(smooth - 1), 0)))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("past_mean", F.avg("s").over(past)).withColumn("past_sd", F.stddev_pop("s").over(past))
    z = F.when((F.col("pos") >= warm_up) & (F.col("past_sd") > 0), (F.col("s") - F.col("past_mean")) / F.col("past_sd"))
    return s.withColumn(name, z).drop("s", "past_mean", "past_sd")


def step_change(df: DataFrame, column: str, name: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("pos")
    return df.withColumn(name, F.abs(F.col(column) - F.lag(column).over(w)))


def rolling_mmd(rows: DataFrame, gamma: float, window: int = 20) -> DataFrame:
    """MMD of adjacent windows of x: only the row that enters and the one that leaves differ."""
    w = Window.partitionBy("series_id").orderBy("pos")
    d2 = F.aggregate(F.zip_with("x", "old", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("old", F.lag("x", window).over(w)).withColumn("mmd", F.when(F.col("old").isNotNull(), 2 * (1 - F.exp(-gamma * d2)) / float(window**2))).drop("old")
