"""The ready-made studies. Each returns DataFrames; ``show`` prints them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import alarms, channels, events, fit, nulls, series, stats
from ..sources import prices as sources
from ..sources import registry as registries
from ..sources.tables import written

ERAS = [1995, 1997, 1999, 2001, 2003]
CONTROLS = ("realized_vol", "drawdown", "trailing_return")


@dataclass
class Study:
    """A panel of prices, its features and event windows, with the parameters of a run."""

    prices: DataFrame
    assets: Sequence[str]
    registry: Sequence[registries.Window] = field(default_factory=lambda: registries.DEFAULT)
    p: int = 8
    n: int = 8
    seed: int = 42
    family: Sequence[str] = tuple(c for c in channels.ALL if c not in channels.BASELINES)
    given: DataFrame | None = None  # features that have been computed before

    def __post_init__(self):
        self.spark: SparkSession = self.prices.sparkSession
        two = len(self.assets) == 2
        self.features = self.given if self.given is not None else series.two_asset_features(self.prices, self.assets) if two else series.multi_asset_features(self.prices, self.assets)
        self.names = [c for c in self.features.columns if c not in ("series_id", "ts", "pos")]
        self.calendar = self.features.select("series_id", "ts", "pos")
        self.windows = registries.frame(self.spark, self.registry)
        self.ops = kernels.hermitian_family(min(self.p, len(self.names)), self.n, self.seed)

    @cached_property
    def contexts(self) -> DataFrame:
        return written(events.contexts(self.calendar, self.windows), "contexts")

    def controls(self, asset: str | None = None) -> DataFrame:
        """Long control channels on the calendar of the features."""
        wide = self.calendar.join(series.controls(self.prices, asset or self.assets[0]), ["series_id", "ts"], "left")
        return series.long_form(wide, CONTROLS)

    def embedded(self, causal: bool = True) -> DataFrame:
        """Rows under one fit per usable window (past rows only), or under a single fit of all rows of a series."""
        keep = ("series_id", "ts", "pos", "ret")
        rows = self.features.withColumn("ret", F.col(f"{self.assets[0]}_ret"))
        if causal:
            cut = self.contexts.where("usable").select("crisis", "series_id", "cutoff")
            params = fit.fitted(self.features.join(cut, "series_id").where("ts < cutoff"), self.names, p=self.p)
            return fit.embedded(rows, self.names, params, keep).join(cut, ["crisis", "series_id"]).withColumn("fit", F.col("ts") < F.col("cutoff")).drop("cutoff")
        params = fit.fitted(self.features.withColumn("crisis", F.lit("all")), self.names, p=self.p)
        return fit.embedded(rows, self.names, params, keep).withColumn("fit", F.lit(True))

    def panel(self, causal: bool = True, smooth: int = 20) -> DataFrame:
        """(crisis, series_id, channel, pos, ts, value, z) of all channels and controls under each fit."""
        raw = channels.raw_channels(self.embedded(causal), self.ops)
        long = series.long_form(raw, channels.ALL, ("crisis", "series_id", "ts", "pos"))
        both = long.unionByName(self.for_each_fit(self.controls(), causal).select(*long.columns))
        return series.causal_zscore(both, ("crisis", "series_id", "channel"), smooth)

    def for_each_fit(self, rows: DataFrame, causal: bool = True) -> DataFrame:
        """rows(series_id, ...) that need no fit, once for each fit of their series."""
        return rows.join(self.contexts.where("usable").select("crisis", "series_id"), "series_id") if causal else rows.withColumn("crisis", F.lit("all"))

    def spans(self) -> DataFrame:
        return events.spans(self.calendar, self.windows)


def study(spark: SparkSession, sf_dir: str, registry=registries.SAMPLE) -> Study:
    return Study(sources.two_asset_panel(spark, sf_dir), ("f", "o"), registry)


def effect_sizes(s: Study, z: DataFrame) -> DataFrame:
    """|effect size| of every channel in each event, under the fit of that event (or the single fit)."""
    spans, columns = s.spans().select("series_id", "crisis", "lo", "hi"), ["series_id", "event", "channel", "pos", "z", "lo", "hi"]
    z = written(z, "scored")
    own = z.where("crisis <> 'all'").join(spans, ["series_id", "crisis"]).withColumn("event", F.col("crisis")).select(*columns)
    single = z.where("crisis = 'all'").join(spans.withColumnRenamed("crisis", "event"), "series_id").select(*columns)
    rows = own.unionByName(single).withColumn("inside", F.col("pos").between(F.col("lo"), F.col("hi")))
    return stats.cohens_d(rows, ("series_id", "event", "channel")).withColumn("abs_d", F.abs("d"))


#: The orders in which results are reported.
ORDERS = {
    "effect": ("-abs_d", "event", "channel"), "verdict": ("q", "p", "channel", "crisis"), "threshold": ("channel",), "date": ("start", "crisis"),
}


def ordered(df: DataFrame, by: str) -> DataFrame:
    """df in one of ORDERS, by those of its columns that df has; nulls last."""
    names = [(n.lstrip("-"), n.startswith("-")) for n in ORDERS[by]]
    return df.orderBy(*[F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_last() for n, down in names if n in df.columns])


def offline_event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in the fit: effect sizes of the row-local channels. The flagship query."""
    s = study(spark, sf_dir)
    rows = s.embedded(causal=False)
    states = channels.state_rows(rows, s.ops).join(rows.select("series_id", "pos", "ts"), ["series_id", "pos"])
    z = series.causal_zscore(series.long_form(states, ("spectral_entropy", "reduced_purity", "ground_energy"))).withColumn("crisis", F.lit("all"))
    return ordered(effect_sizes(s, z).drop("series_id"), "effect")


def synthetic_demo(spark: SparkSession, rows: int = 2000, event: tuple[int, int] = (1000, 1120)) -> DataFrame:
    """The same on a generated panel with one stressed stretch, against the regime model."""
    p = sources.synthetic_prices(spark, rows, event)
    s = Study(p.drop("in_event"), ("SPY", "DIA"), [])
    raw = channels.raw_channels(s.embedded(causal=False), s.ops)
    z = series.causal_zscore(series.long_form(raw, ("spectral_entropy", "reduced_purity", "hmm_high_var"), ("crisis", "series_id", "ts", "pos")), ("crisis", "series_id", "channel"))
    marked = events.membership(z, p.where("in_event"), "inside")
    return stats.cohens_d(marked, ("channel",)).withColumn("abs_d", F.abs("d")).orderBy(F.col("abs_d").desc())


def channel_correlations(s: Study) -> DataFrame:
    """Pearson and Spearman correlation of z-scored channels under a single fit, and where they part."""
    z = s.panel(causal=False).where(F.col("channel").isin(*channels.STATE, "sld_qfi", "hmm_high_var"))
    names = [*channels.STATE, "sld_qfi", "hmm_high_var"]
    wide = z.groupBy("series_id", "pos").pivot("channel", names).agg(F.first("z"))
    return stats.correlation_divergence(wide, names)


def causal_comparison(s: Study) -> dict[str, DataFrame]:
    """Single fit against past-only fits: effect sizes, parameters and rows."""
    past, whole = s.embedded(True), s.embedded(False)
    latest = s.contexts.where("usable").groupBy("series_id").agg(F.max_by("crisis", "start").alias("crisis"), F.max("start").alias("start"))
    a, b = (effect_sizes(s, s.panel(c)).select("series_id", "event", "channel", F.col("abs_d").alias(n)) for c, n in ((True, "past_fit"), (False, "single_fit")))
    cut = s.contexts.where("usable").select("crisis", "series_id", "cutoff").join(latest.select("series_id", "crisis"), ["series_id", "crisis"])
    params = [fit.fitted(rows.withColumn("crisis", F.lit("all")), s.names, p=s.p) for rows in (s.features, s.features.join(cut, "series_id").where("ts < cutoff").select(s.features.columns))]
    gaps = fit.divergence(*params, s.names)
    return {
        "effect_sizes": a.join(b, ["series_id", "event", "channel"]), "series_correlation": series_correlation(s), "row_cosines": fit.row_cosines(whole, past.join(latest.drop("start"), ["series_id", "crisis"])),
        "fit_divergence": gaps, "fit_divergence_summary": fit.divergence_summary(gaps),
    }


def series_correlation(s: Study) -> DataFrame:
    """Correlation of each channel's scores under past-only fits with those under a single fit, where both are present."""
    a = s.panel(True).where("z is not null").select("crisis", "series_id", "channel", "pos", F.col("z").alias("x"))
    b = s.panel(False).where("z is not null").select("series_id", "channel", "pos", F.col("z").alias("y"))
    varies = (F.count(F.lit(1)) > 2) & (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    r = F.covar_pop("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))
    return a.join(b, ["series_id", "channel", "pos"]).groupBy("crisis", "series_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.when(varies, r).alias("r"))


def panel_study(s: Study, z: DataFrame | None = None, draws: int = 5000, reps: int = 2000) -> dict[str, DataFrame]:
    """The multi-event panel: effect sizes, both nulls, count statistic, multiplicity, bootstrap intervals. z: scores under each event's fit, all of ``s.panel()`` by default.

    A window of which alignment leaves nothing raises ValueError.
    """
    keys = ("crisis", *nulls.SERIES)
    z = written(s.panel() if z is None else z, "panel")
    spans = s.contexts.where("usable").select("crisis", "series_id", "lo", "hi")
    k = spans.select("crisis").distinct().count()
    aligned = written(nulls.finite(nulls.aligned_panel(z, k), keys), "aligned")
    win, sums = written(nulls.windows(aligned, spans, keys), "windows"), written(nulls.prefix_sums(aligned, keys), "sums")
    lost = nulls.lost_windows(aligned, win, spans, keys).take(1)
    if lost:
        raise ValueError(f"alignment leaves no row of {lost[0].asDict()}")
    real = written(nulls.real_windows(win, sums, keys), "real")
    a = written(nulls.window_draws(win, sums, keys, draws, s.seed), "draws_a")
    b = written(nulls.shift_draws(win, sums, keys), "draws_b")
    tau = stats.autocorrelation(aligned, keys, order="m").groupBy(*nulls.SERIES).agg(F.max("tau").alias("tau"), F.min("n_eff").alias("n_eff"))
    panel_a = nulls.panel_statistics(a, real).withColumn("family", F.lit("a")).withColumn("p", F.col("p_raw"))
    panel_b = nulls.floored(nulls.panel_statistics(b, real), tau, nulls.SERIES).withColumn("family", F.lit("b"))
    both = panel_a.unionByName(panel_b.drop("tau", "n_eff"))
    lengths = stats.block_lengths(aligned, keys, order="m").groupBy(*nulls.SERIES).agg(F.max("block").alias("block"), F.max("saturated").alias("saturated"))
    blocks = lengths.join(aligned.groupBy(*nulls.SERIES).agg(F.max("total").alias("total")), list(nulls.SERIES))
    resampled = nulls.block_bootstrap(win, sums, nulls.block_starts(blocks, reps, seed=s.seed), keys)
    return {
        "effect_sizes": real.select(*keys, F.col("real").alias("abs_d")),
        "panel_nulls": both,
        "counts_a": nulls.count_statistic(a, real), "counts_b": nulls.count_statistic(b, real),
        "verdicts": nulls.verdicts(both.where(F.col("channel").isin(*s.family)).select(*nulls.SERIES, "family", "p")),
        "block_lengths": blocks, "intervals": nulls.bootstrap_interval(resampled, k),
        "visible": visible(real),
    }


def visible(real: DataFrame, least: float = 0.2) -> DataFrame:
    """Whether some control shows an event: |effect size| of ``least`` or more."""
    return real.where(F.col("channel").isin(*CONTROLS)).groupBy("series_id", "crisis").agg(F.max(F.col("real") >= least).alias("visible"))


def null_model(z: DataFrame, spans: DataFrame, family: Sequence[str], draws: int = 5000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Both nulls of every event and channel, shift p-values floored by what the effective size resolves, q over ``family``, and which way the event moves the channel.

    z: scores (series_id, channel, pos, z), or with a column crisis one series for each event's fit. In order of q.
    """
    keys = ("crisis", *nulls.SERIES) if "crisis" in z.columns else nulls.SERIES
    names = nulls.unique(*keys, "crisis")
    fin = written(nulls.finite(z, keys), "finite")
    win, sums = written(nulls.windows(fin, spans, keys), "windows"), written(nulls.prefix_sums(fin, keys), "sums")
    real = written(nulls.placed(win.withColumn("start", F.col("lo")), sums, keys, gap=True).withColumnRenamed("d", "real"), "real")
    way = real.select(*names, F.when(F.col("gap") > 0, "up").when(F.col("gap") < 0, "down").otherwise("flat").alias("direction"))
    a = nulls.summary(nulls.window_draws(win, sums, keys, draws, seed), real, names).withColumn("p", F.col("p_raw")).withColumn("family", F.lit("a"))
    tau = stats.autocorrelation(fin, keys, order="m")
    b = nulls.floored(nulls.summary(nulls.shift_draws(win, sums, keys), real, names), tau, keys).drop("tau", "n_eff").withColumn("family", F.lit("b"))
    q = stats.benjamini_hochberg(a.unionByName(b).where(F.col("channel").isin(*family)), "p", ties=("channel", "crisis", "family", "series_id"))
    return ordered(q.join(way, names).withColumn("clears", F.col("q") < alpha), "verdict")


def regime_audit(s: Study) -> DataFrame:
    """How the regime model's fit went before each event: convergence, rounds, last gain, and the share of rows that it is sure of."""
    rows = s.embedded(True).select("crisis", "series_id", "pos", "ret", "fit")
    out = channels.regime_posterior(rows, keys=("crisis", "series_id"))
    return out.groupBy("crisis", "series_id").agg(F.first("converged").alias("converged"), F.first("rounds").alias("rounds"), F.first("last_gain").alias("last_gain"), F.first("sure_share").alias("sure_share"))


def alarm_rows(s: Study, z: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calendar with its block (before the first event's cutoff) and what follows, and the scores z(series_id, channel, pos, ts, z) on it."""
    first = s.contexts.groupBy("series_id").agg(F.min_by("cutoff", "start").alias("cutoff"))
    cal = events.any_event(s.calendar, s.spans()).join(first, "series_id").withColumn("block", F.col("ts") < F.col("cutoff")).withColumn("forward", F.col("ts") >= F.col("cutoff"))
    cal = written(cal, "calendar")
    return cal, written(z.select("series_id", "channel", "pos", "ts", "z").join(cal.select("series_id", "pos", "block", "forward", "in_any"), ["series_id", "pos"]), "rows")


def frozen_alarms(rows: DataFrame, target: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(thresholds, rows with firing and upcross)."""
    tau = alarms.calibrated(rows.where("block"), target)
    return tau, written(alarms.upcrossings(rows.join(tau, list(nulls.SERIES)), "tau"), "fired")


def block_maximum(rows: DataFrame) -> DataFrame:
    """Largest scores of the block and of what follows, and the yearly rate of calm alarms with the block's largest score as threshold."""
    top = rows.groupBy(*nulls.SERIES).agg(F.max(F.when(F.col("block"), F.col("z"))).alias("block_max"), F.max(F.when(F.col("forward"), F.col("z"))).alias("forward_max"))
    rate = alarms.yearly_rate(alarms.upcrossings(rows.join(top, list(nulls.SERIES)), "block_max"), F.col("forward") & ~F.col("in_any"))
    return top.join(rate.select(*nulls.SERIES, F.col("far").alias("far_at_block_max")), list(nulls.SERIES), "left")


def alarm_study(s: Study, z: DataFrame, target: float = 1.0, prepared: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """One fit before the first event, thresholds frozen there, and what follows. z: (series_id, channel, pos, ts, z)."""
    cal, rows = prepared or alarm_rows(s, z)
    tau, fired = frozen_alarms(rows, target)
    spans = s.spans()
    found = alarms.detection(fired.where("forward"), spans)
    calm = F.col("forward") & ~F.col("in_any")
    return {
        "audit": alarms.causality_audit(cal), "thresholds": tau, "rates": alarms.yearly_rate(fired, calm), "detections": found,
        "chance": alarms.chance_floor(alarms.chance_counts(fired.where("forward"), spans), found),
        "exceedance": alarms.exceedance(fired, F.col("forward") & F.col("in_any"), calm),
        "eras": alarms.yearly_rate(events.eras(fired, ERAS), calm, (*nulls.SERIES, "era")).groupBy(*nulls.SERIES).pivot("era", [f"{a}-{b - 1}" for a, b in zip(ERAS, ERAS[1:], strict=False)]).agg(F.first("far")),
        "range": block_maximum(rows),
    }


def target_sweep(s: Study, z: DataFrame, targets: Sequence[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Detections, chance and calm rate for several target rates."""
    out, prepared = None, alarm_rows(s, z)
    for t in targets:
        r = alarm_study(s, z, t, prepared)
        one = r["chance"].join(r["rates"], list(nulls.SERIES)).withColumn("target", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    return out


def smoothing_ablation(values: DataFrame, keys: Sequence[str], smooths: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """z-scores for several smoothing lengths; a frame is a literal, so each length is one branch of a union."""
    out = None
    for w in smooths:
        one = series.causal_zscore(values, keys, w).withColumn("smooth", F.lit(w))
        out = one if out is None else out.unionByName(one)
    return out


def magnitude_sweep(spark: SparkSession, days: np.ndarray, mask: np.ndarray, decline: float, multiples: Sequence[float] = (0.5, 1, 2, 3, 5, 8), seed: int = 17) -> DataFrame:
    """Drift-only panels whose window falls by multiples of a decline: realized volatility's and the other controls' |d|."""
    out = None
    for k in multiples:
        p = sources.synthetic_on_calendar(spark, days, mask, seed, True, -abs(decline) * k / max(1, int(mask.sum())))
        c = series.positioned(series.controls(p.drop("in_event"), "SPY"))
        z = series.causal_zscore(series.long_form(c, CONTROLS))
        one = stats.cohens_d(events.membership(z, p.where("in_event"), "inside"), ("channel",)).withColumn("multiple", F.lit(float(k)))
        out = one if out is None else out.unionByName(one)
    return out


def visibility(s: Study, z: DataFrame) -> dict[str, DataFrame]:
    """Which events each asset's control clears by the count statistic, their union, and what more assets add. z: (series_id, channel=asset, pos, z)."""
    fin = written(nulls.finite(z), "finite")
    win, sums = written(nulls.windows(fin, s.spans()), "windows"), written(nulls.prefix_sums(fin), "sums")
    real = nulls.real_windows(win, sums)
    clears = written(nulls.count_statistic(nulls.window_draws(win, sums), real), "clears")
    seen = clears.select("series_id", "channel", F.explode("which").alias("crisis"))
    base = seen.where(F.col("channel") == s.assets[0]).select("series_id", "crisis")
    union = seen.groupBy("series_id", "crisis").agg(F.sort_array(F.collect_set("channel")).alias("assets"))
    return {"by_asset": clears, "union": union, "added": union.join(base, ["series_id", "crisis"], "left_anti")}


def asset_volatility(s: Study) -> DataFrame:
    """Scores of each asset's realized volatility, channel by asset."""
    long = None
    for a in s.assets:
        one = s.calendar.join(series.controls(s.prices, a).select("series_id", "ts", "realized_vol"), ["series_id", "ts"], "left").select("series_id", "ts", "pos", F.lit(a).alias("channel"), F.col("realized_vol").alias("value"))
        long = one if long is None else long.unionByName(one)
    return series.causal_zscore(long)


def aggregate_choice(prices: DataFrame, assets: Sequence[str], windows: DataFrame, year: int, signs: dict[str, int], axes: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """Whether the absorption ratio is safe to use on a calm year, or the signed mean correlation is to be taken."""
    c = series.pair_correlations(series.log_returns(prices, assets), assets)
    both = series.positioned(series.aligned_mean_correlation(series.spectral_aggregates(c, assets), assets, signs))
    marked = events.clean_lookback(events.any_event(both, events.spans(both.select("series_id", "ts", "pos"), windows)))
    rows = marked.where((F.year("ts") == year) & F.col("clean") & F.col("absorption_ratio").isNotNull() & F.col("risk_aligned_mean_corr").isNotNull())
    varies = (F.stddev_pop("absorption_ratio") > 0) & (F.stddev_pop("risk_aligned_mean_corr") > 0)
    m = rows.agg(F.count(F.lit(1)).alias("days"), F.median("absorption_ratio").alias("med_ar"), F.abs(F.when(varies, F.covar_pop("absorption_ratio", "risk_aligned_mean_corr") / (F.stddev_pop("absorption_ratio") * F.stddev_pop("risk_aligned_mean_corr")))).alias("abs_corr"), F.median("leading_loading").alias("med_loading"))
    m = m.withColumn("band_1", stats.band(F.col("med_ar"), *axes[0])).withColumn("band_2", stats.band(F.col("abs_corr"), *axes[1]))
    return m.withColumn("choice", F.when((F.col("band_1") == "AR-safe") & (F.col("band_2") == "AR-safe"), "AR").otherwise("MC"))


def show(tables: dict[str, DataFrame] | DataFrame, rows: int = 40) -> None:
    for name, df in (tables if isinstance(tables, dict) else {"result": tables}).items():
        print(name)
        df.show(rows, truncate=False)
