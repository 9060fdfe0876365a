"""Effect sizes, correlations, multiplicity control and other statistics of long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels


def cohens_d(df: DataFrame, keys: Sequence[str], value: str = "z", inside: str = "inside") -> DataFrame:
    """Pooled effect size of rows inside against the rest, in one pass: null under two rows a side, 0 without spread."""
    a, b = F.when(F.col(inside), F.col(value)), F.when(~F.col(inside), F.col(value))
    agg = df.groupBy(*keys).agg(*[f(x).alias(f"{n}_{s}") for s, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    d = F.when(enough, F.when(pooled > 0, (F.col("m_a") - F.col("m_b")) / pooled).otherwise(0.0))
    return agg.select(*keys, F.col("n_a").alias("n_inside"), F.col("n_b").alias("n_outside"), d.alias("d"))


def _pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, x, y) for each pair of columns with both values present; a row is read once."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x is not null and y is not null")


def _correlated(pairs: DataFrame, name: str) -> DataFrame:
    varies = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    moment = (F.avg(F.col("x") * F.col("y")) - F.avg("x") * F.avg("y")) / (F.stddev_pop("x") * F.stddev_pop("y"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.when(varies, moment).alias(name))


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _correlated(_pairs(df, columns), "pearson")


def average_rank(column: str, keys: Sequence[str]) -> Column:
    """Rank with ties at their mean."""
    by = Window.partitionBy(*keys).orderBy(column)
    ties = Window.partitionBy(*keys, column)
    return F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / 2


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    p = _pairs(df, columns)
    return _correlated(p.select("a", "b", average_rank("x", ("a", "b")).alias("x"), average_rank("y", ("a", "b")).alias("y")), "spearman")


def correlation_divergence(df: DataFrame, columns: Sequence[str], flag_above: float = 0.10) -> DataFrame:
    """Both correlations of each pair, and whether they differ by more than ``flag_above``."""
    both = pearson(df, columns).join(spearman(df, columns).drop("n"), ["a", "b"])
    gap = F.abs(F.col("pearson") - F.col("spearman"))
    return both.withColumn("gap", gap).withColumn("flagged", gap > flag_above)


def benjamini_hochberg(df: DataFrame, p: str = "p", keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """df with ``q``: adjusted p-values, monotone and at most 1, over all rows or within ``keys``."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    up = w.orderBy(p, *ties)
    q = df.withColumn("rank", F.row_number().over(up)).withColumn("m", F.count(p).over(w)).withColumn("scaled", F.col(p) * F.col("m") / F.col("rank"))
    down = w.orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return q.withColumn("q", F.least(F.lit(1.0), F.min("scaled").over(down))).drop("rank", "m", "scaled")


def empirical(draws: Column, real: Column) -> list[Column]:
    """p-value with one added to both counts, and the percentile of the real value among its draws."""
    n = F.count(draws)
    return [((1 + F.sum((draws >= real).cast("int"))) / (1 + n)).alias("p_raw"), (100.0 * F.sum((draws < real).cast("int")) / n).alias("pct")]


def autocorrelation(values: DataFrame, keys: Sequence[str], value: str = "z", order: str = "pos") -> DataFrame:
    """(keys, tau, n_eff) of each series: one group of rows to one kernel call."""
    schema = values.select(*keys).schema

    def tau(group, pdf):
        import pandas as pd

        t, n = kernels.autocorrelation_time(pdf.sort_values(order)[value].to_numpy(float))
        return pd.DataFrame([(*group, t, n)], columns=[*keys, "tau", "n_eff"])

    return values.select(*keys, order, value).groupBy(*keys).applyInPandas(tau, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", tau double, n_eff double")


def block_lengths(values: DataFrame, keys: Sequence[str], value: str = "z", order: str = "pos") -> DataFrame:
    schema = values.select(*keys).schema

    def length(group, pdf):
        import pandas as pd

        b, out = kernels.block_length(pdf.sort_values(order)[value].to_numpy(float))
        return pd.DataFrame([(*group, b, out)], columns=[*keys, "block", "saturated"])

    return values.select(*keys, order, value).groupBy(*keys).applyInPandas(length, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", block int, saturated boolean")


def trend(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """(keys, rho, p, slope): rank correlation with its p-value, and the least-squares slope."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", average_rank(x, keys)).withColumn("ry", average_rank(y, keys))
    varies = (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    rho = (F.avg(F.col("rx") * F.col("ry")) - F.avg("rx") * F.avg("ry")) / (F.stddev_pop("rx") * F.stddev_pop("ry"))
    slope = F.when(F.stddev_pop(x) > 0, F.covar_pop(y, x) / F.var_pop(x))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(varies, rho).alias("rho"), slope.alias("slope"))

    @F.pandas_udf("double")
    def p_value(r, n):
        import numpy as np
        import pandas as pd

        t = [np.nan if m < 3 or x is None or x != x else 0.0 if abs(x) >= 1 else kernels.student_two_sided(abs(x) * ((m - 2) / (1 - x * x)) ** 0.5, int(m - 2)) for x, m in zip(r, n, strict=True)]
        return pd.Series(t)

    return out.withColumn("p", p_value("rho", "n"))


def band(value: Column, safe: float, hard: float) -> Column:
    return F.when(value < safe, "AR-safe").when(value < hard, "AMBIGUOUS").otherwise("MC")
