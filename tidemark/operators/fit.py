"""Standardisation and principal components, fitted on a subset of rows and applied to all.

Moments are one aggregation for all fits at once, a fit being a series up to a cutoff; the eigenproblems are solved on
the executors, a row for each fit, and rows meet the fits of their own series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in names], *[F.covar_pop(a, b).alias(f"cov_{i}") for i, (a, b) in enumerate(pairs)])


def scaler(rows: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, mean, scale): population deviation."""
    agg = rows.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for a in names for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    items = F.array(*[F.struct(F.lit(a).alias("feature"), F.col(f"m_{a}").alias("mean"), F.col(f"s_{a}").alias("scale")) for a in names])
    return agg.select(*keys, F.explode(items).alias("x")).select(*keys, "x.*")


def standardised(rows: DataFrame, names: Sequence[str], params: DataFrame) -> DataFrame:
    """Long (ts, pos, feature, value) of standardised features."""
    items = F.array(*[F.struct(F.lit(a).alias("feature"), F.col(a).alias("v")) for a in names])
    long = rows.select("ts", "pos", F.explode(items).alias("x")).select("ts", "pos", "x.*")
    return long.join(F.broadcast(params), "feature").select("ts", "pos", "feature", F.when(F.col("scale") > 0, (F.col("v") - F.col("mean")) / F.col("scale")).otherwise(F.col("v") - F.col("mean")).alias("value"))


def principal_axes(cov: np.ndarray, p: int) -> np.ndarray:
    """Leading axes in rows; of each, the largest loading (the first of equal ones) is positive."""
    e, u = np.linalg.eigh(cov)
    axes = u[:, ::-1].T[:p]
    lead = np.abs(axes).round(9).argmax(1)
    return axes * np.sign(axes[np.arange(len(axes)), lead])[:, None]


def fitted(rows: DataFrame, names: Sequence[str], keys: Sequence[str] = ("crisis", "series_id"), p: int = 8) -> DataFrame:
    """(keys, mean, scale, axes) of each fit; the eigenproblems are solved where the moments are."""
    f = len(names)
    upper = np.triu_indices(f)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                mean = np.array([r[f"mean_{a}"] for a in names])
                cov = np.zeros((f, f))
                cov[upper] = [r[f"cov_{i}"] for i in range(len(upper[0]))]
                cov = cov + np.triu(cov, 1).T
                scale = np.sqrt(np.diag(cov))
                scale[scale == 0] = 1.0
                out.append((*[r[k] for k in keys], mean.tolist(), scale.tolist(), principal_axes(cov / np.outer(scale, scale), min(p, f)).tolist()))
            yield pd.DataFrame(out, columns=[*keys, "mean", "scale", "axes"])

    types = dict(rows.select(*keys).dtypes)
    return moments(rows, names, keys).mapInPandas(solve, ", ".join([*[f"{k} {types[k]}" for k in keys], "mean array<double>", "scale array<double>", "axes array<array<double>>"]))


def embedded(features: DataFrame, names: Sequence[str], params: DataFrame, keep: Sequence[str] = ("series_id", "ts", "pos")) -> DataFrame:
    """Rows under every fit of their series, as unit vectors x of principal scores."""
    rows = features.select(*keep, F.array(*names).alias("v")).join(params, "series_id")
    z = F.zip_with(F.zip_with("v", "mean", lambda a, b: a - b), "scale", lambda a, b: a / b)
    dot = lambda u, w: F.aggregate(F.zip_with(u, w, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    rows = rows.withColumn("z", z).withColumn("y", F.transform("axes", lambda a: dot(F.col("z"), a)))
    rows = rows.withColumn("norm", F.sqrt(dot(F.col("y"), F.col("y"))))
    return rows.withColumn("x", F.when(F.col("norm") > 0, F.transform("y", lambda t: t / F.col("norm"))).otherwise(F.col("y"))).drop("v", "mean", "scale", "axes", "z", "y", "norm")


def divergence(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """How far two fits of one series differ: per feature relative mean and scale gaps, per axis |cosine|."""
    j = left.select("series_id", *[F.col(c).alias(f"l_{c}") for c in ("mean", "scale", "axes")]).join(right.select("series_id", "mean", "scale", "axes"), "series_id")
    rel = lambda a, b: F.abs(b - a) / F.greatest(F.abs(a), F.lit(1e-12))
    dot = lambda u, w: F.aggregate(F.zip_with(u, w, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    parts = {"mean_rel": F.zip_with("l_mean", "mean", rel), "scale_rel": F.zip_with("l_scale", "scale", rel), "axis_cos": F.zip_with("l_axes", "axes", lambda a, b: F.abs(dot(a, b)) / F.sqrt(dot(a, a) * dot(b, b)))}
    rows = [j.select("series_id", F.lit(n).alias("measure"), F.posexplode(c).alias("i", "value")) for n, c in parts.items()]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    label = F.when(F.col("measure") == "axis_cos", F.concat(F.lit("axis "), F.col("i").cast("string"))).otherwise(F.get(F.array(*[F.lit(n) for n in names]), F.col("i")))
    return out.select("series_id", "measure", label.alias("item"), "value")


def divergence_summary(gaps: DataFrame, above: float = 0.10) -> DataFrame:
    """Largest, middle and mean value of each measure, and how many of its items differ by more than ``above``."""
    gap = F.when(F.col("measure") == "axis_cos", 1 - F.col("value")).otherwise(F.col("value"))
    return gaps.groupBy("series_id", "measure").agg(F.max("value").alias("largest"), F.median("value").alias("middle"), F.avg("value").alias("mean"), F.sum((gap > above).cast("int")).alias("over"))


def row_cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean, least and share under 0.99 of the cosines of two embeddings of the same rows."""
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    j = left.select("series_id", "pos", "x").join(right.select("series_id", "pos", F.col("x").alias("y")), ["series_id", "pos"]).select(dot.alias("cosine"))
    return j.agg(F.avg("cosine").alias("mean_cosine"), F.min("cosine").alias("least_cosine"), F.avg((F.col("cosine") < 0.99).cast("double")).alias("share_below_99"))
