"""State-based and classical channels of embedded rows.

Row-local quantities run in mapInPandas on whole Arrow batches. Those that look back at a window run by stretches of a
(fit, series) group, and share one eigendecomposition with all others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.tables import written

STATE = ("spectral_entropy", "reduced_purity", "ground_energy", "berry_rate", "qfi_logdet")
MIXED = ("sld_qfi", "frobenius_rho", "population_fisher")
CLASSICAL = ("bures", "mmd", "hmm_high_var")
BASELINES = ("frobenius_rho", "population_fisher", "bures", "mmd")
ALL = STATE + MIXED + CLASSICAL


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in x]) if len(x) else np.empty((0, 0))


def state_rows(rows: DataFrame, ops: np.ndarray, dim_a: int = 2, rcond: float = 1e-10) -> DataFrame:
    """rows(series_id, pos, x) with spectrum, ground state and every row-local quantity."""
    family = kernels.Family(ops)
    p, n = family.p, family.n

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["x"])
            e, v = family.solve(x)
            g = kernels.quantum_metric(family, e, v)
            psi = v[:, :, 0]
            yield pd.DataFrame({
                "series_id": pdf["series_id"], "pos": pdf["pos"], "evals": list(e), "psi_re": list(psi.real), "psi_im": list(psi.imag),
                "spectral_entropy": kernels.spectral_entropy(e), "reduced_purity": kernels.reduced_purity(psi, dim_a), "ground_energy": e[:, 0],
                "curvature": kernels.berry_curvature(family, x, at=psi), "curvature_bound": kernels.curvature_bound(family, x, e),
                "qfi_logdet": kernels.log_pseudo_determinant(4 * g, rcond), "metric_trace": np.einsum("tii->t", g), "cramer_rao": list(kernels.cramer_rao(g, rcond)),
            })

    schema = "series_id string, pos long, evals array<double>, psi_re array<double>, psi_im array<double>, spectral_entropy double, reduced_purity double, ground_energy double, curvature double, curvature_bound double, qfi_logdet double, metric_trace double, cramer_rao array<double>"
    return rows.select("series_id", "pos", "x").mapInPandas(solve, schema)


def metric_check(rows: DataFrame, ops: np.ndarray) -> DataFrame:
    """Both metrics of each row: largest relative gap, their correlation, and the pure-state Fisher information against four times the metric."""
    family = kernels.Family(ops)

    def compare(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["x"])
            g = kernels.quantum_metric(family, *family.solve(x))
            fd = kernels.quantum_metric_fd(family, x)
            scale = np.abs(g).max((1, 2))
            pure = kernels.fisher_pure(family, x, 0)
            yield pd.DataFrame({"series_id": pdf["series_id"], "pos": pdf["pos"], "metric_gap": np.abs(g - fd).max((1, 2)) / scale, "metric_corr": [np.corrcoef(a.ravel(), b.ravel())[0, 1] for a, b in zip(g, fd, strict=True)], "pure_gap": np.abs(pure - 4 * g[:, 0, 0]) / np.maximum(4 * g[:, 0, 0], 1e-12), "least_eigenvalue": np.linalg.eigvalsh(g)[:, 0]})

    return rows.select("series_id", "pos", "x").mapInPandas(compare, "series_id string, pos long, metric_gap double, metric_corr double, pure_gap double, least_eigenvalue double")


WINDOWED = ("spectral_entropy", "reduced_purity", "ground_energy", "berry_rate", "qfi_logdet", "sld_qfi", "frobenius_rho", "population_fisher", "bures", "mmd")


def kernel_widths(embedded: DataFrame, keys: Sequence[str], most: int = 400, seed: int = 0) -> DataFrame:
    """(keys, gamma) from at most ``most`` drawn rows of each fit; a fit without rows of its own takes all."""
    w = Window.partitionBy(*keys)
    rows = embedded.withColumn("any_fit", F.max("fit").over(w)).where("fit or not any_fit").select(*keys, "x", (F.row_number().over(w.orderBy("pos")) - 1).alias("nth"), F.count(F.lit(1)).over(w).alias("n"))
    sizes = rows.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("again"))

    @F.pandas_udf("array<int>")
    def drawn(n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(seed).choice(int(k), min(most, int(k)), replace=False).tolist() for k in n])

    picks = sizes.select(*keys, F.explode(drawn("n")).alias("nth"))
    types = dict(embedded.select(*keys).dtypes)

    def width(group, pdf):
        return pd.DataFrame([(*group, kernels.width_of(_matrix(pdf["x"])))], columns=[*keys, "gamma"])

    return rows.join(picks, [*keys, "nth"]).select(*keys, "x").groupBy(*keys).applyInPandas(width, ", ".join([*[f"{k} {types[k]}" for k in keys], "gamma double"]))


def raw_channels(embedded: DataFrame, ops: np.ndarray, window: int = 20, dim_a: int = 2, keys: tuple[str, ...] = ("crisis", "series_id"), filtered: bool = False, chunk: int = 1024) -> DataFrame:
    """embedded(keys, ts, pos, x, ret, fit) with all channels; ``fit`` marks the rows that models may learn from.

    Channels that look back at most ``window`` rows are computed by stretches of ``chunk`` rows, each with the rows before it that it looks back at; only
    the regime model takes a series as a whole, and of it nothing but the returns.
    """
    family = kernels.Family(ops)
    names = [*keys, "ts", "pos"]
    embedded = written(embedded, "embedded")  # read by the widths, the stretches and the regime model
    part = F.floor(F.col("pos") / chunk)
    rows = embedded.join(kernel_widths(embedded, keys), list(keys)).select(*names, "x", "gamma", part.alias("part"))
    lead = rows.where(F.col("pos") % chunk >= chunk - window).withColumn("part", F.col("part") + 1)

    def run(group, pdf):
        pdf = pdf.sort_values("pos")
        x = _matrix(pdf["x"])
        e, v = family.solve(x)
        psi = v[:, :, 0]
        out = {
            "spectral_entropy": kernels.spectral_entropy(e), "reduced_purity": kernels.reduced_purity(psi, dim_a), "ground_energy": e[:, 0],
            "berry_rate": np.concatenate([[np.nan], np.abs(np.diff(kernels.berry_curvature(family, x, at=psi)))]), "qfi_logdet": kernels.log_pseudo_determinant(4 * kernels.quantum_metric(family, e, v)),
            "sld_qfi": kernels.fisher_series(psi, window), "frobenius_rho": kernels.frobenius_series(psi, window), "population_fisher": kernels.population_series(psi, window),
            "bures": kernels.bures_series(x, window), "mmd": kernels.mmd_series(x, float(pdf["gamma"].iloc[0]), window),
        }
        whole = pd.DataFrame({**{k: pdf[k] for k in names}, **{k: np.asarray(c, float) for k, c in out.items()}})
        return whole[whole["pos"] >= group[-1] * chunk]

    schema = ", ".join([*[f"{k} string" for k in keys], "ts date", "pos long"])
    local = rows.unionByName(lead).groupBy(*keys, "part").applyInPandas(run, ", ".join([schema, *[f"{c} double" for c in WINDOWED]]))

    def regimes(group, pdf):
        pdf = pdf.sort_values("pos")
        fit = pdf["fit"].to_numpy(bool)
        return pd.DataFrame({**{k: pdf[k] for k in (*keys, "pos")}, "hmm_high_var": kernels.high_variance_posterior(pdf["ret"].to_numpy(float), fit if fit.any() else None, filtered)[0]})

    model = embedded.select(*keys, "pos", "ret", "fit").groupBy(*keys).applyInPandas(regimes, ", ".join([*[f"{k} string" for k in keys], "pos long", "hmm_high_var double"]))
    return local.join(model, [*keys, "pos"]).select(*names, *ALL)


def regime_posterior(returns: DataFrame, filtered: bool = False, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """returns(keys, pos, ret, fit) with the posterior of the wider state and how the fit went."""

    def run(group, pdf):
        pdf = pdf.sort_values("pos")
        fit = pdf["fit"].to_numpy(bool)
        post, m = kernels.high_variance_posterior(pdf["ret"].to_numpy(float), fit if fit.any() and not fit.all() else None, filtered)
        sure = float(np.mean((post < 0.01) | (post > 0.99)))
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "pos": pdf["pos"], "posterior": post, "converged": m.converged, "rounds": m.rounds, "last_gain": m.last_gain, "sure_share": sure})

    return returns.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", pos long, posterior double, converged boolean, rounds int, last_gain double, sure_share double")


def ground_energy_two_levels(a, b, re, im):
    """Lowest eigenvalue of a 2 x 2 Hermitian matrix with diagonal a, b and off-diagonal re + i im."""
    return (a + b) / 2 - F.sqrt((a - b) * (a - b) / 4 + re * re + im * im)
