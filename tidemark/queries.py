"""One query per operator, with SQL where SQL can express it. Doubles are rounded, so that both engines agree."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .functions import kernels
from .operators import alarms, channels, events, fit, nulls, series, stats
from .plans import reports
from .sources import prices, registry
from .sources.tables import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = nulls.SERIES
FEATURES = series.feature_names(("f", "o"))


_shared: ContextVar[dict | None] = ContextVar("shared", default=None)


def query(name: str, sql: str | None = None, **steps: str):
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            token = _shared.set({})
            try:
                return f(spark, sf_dir)
            finally:
                _shared.reset(token)

        QUERIES[name] = run
        if sql:
            SQL[name] = oracle.build(sql, **steps)
        return run

    return register


def once(f: Query) -> Query:
    """f's result is written, and read wherever one query needs it: the base table is scanned once a query."""

    @functools.wraps(f)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = _shared.get()
        if held is None:
            return f(spark, sf_dir)
        if f.__name__ not in held:
            held[f.__name__] = written(f(spark, sf_dir), f.__name__)
        return held[f.__name__]

    return get


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Doubles rounded; the sample tables have one series, so its name is left out."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != "series_id"])


def _round(*columns: str, digits: int = 7) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def px2(s, d):
    return prices.two_asset_panel(s, d)


def feature_rows(s, d):
    return series.two_asset_features(px2(s, d), ("f", "o"))


@once
def panel(s, d):
    return px2(s, d)


@once
def features(s, d):
    return series.two_asset_features(panel(s, d), ("f", "o"))


def calendar(s, d):
    return features(s, d).select("series_id", "ts", "pos")


def control_values(s, d):
    wide = calendar(s, d).join(series.controls(panel(s, d), "f"), ["series_id", "ts"], "left")
    return series.long_form(wide, reports.CONTROLS)


@once
def scores(s, d):
    return series.causal_zscore(control_values(s, d))


def windows_frame(s):
    return registry.frame(s, registry.SAMPLE)


@once
def spans(s, d):
    return events.spans(calendar(s, d), windows_frame(s))


def members(s, d):
    return events.masks(calendar(s, d), spans(s, d))


def study(s, d):
    """The sample study on the shared panel."""
    return reports.Study(panel(s, d), ("f", "o"), registry.SAMPLE, given=features(s, d))


def null_parts(s, d):
    fin = written(nulls.finite(scores(s, d)), "finite")
    win = written(nulls.windows(fin, spans(s, d)), "windows")
    sums = written(nulls.prefix_sums(fin), "sums")
    return fin, win, sums


def alarm_rows(s, d):
    return reports.alarm_rows(study(s, d), scores(s, d))


def fired_rows(s, d):
    return reports.frozen_alarms(alarm_rows(s, d)[1])[1]


@query("price_panel", f"SELECT ts, {_round('f', 'o')} FROM px2")
def _(s, d):
    return rounded(px2(s, d).drop("series_id"))


@query("price_panel_3", f"SELECT ts, {_round('a', 'n', 'r')} FROM px3")
def _(s, d):
    return rounded(prices.three_asset_panel(s, d).drop("series_id"))


@query("price_range_filter", f"SELECT ts, {_round('f', 'o')} FROM px2 WHERE ts >= DATE '1997-01-01' AND ts < DATE '1999-01-01'")
def _(s, d):
    p = px2(s, d).where((F.col("ts") >= F.lit("1997-01-01").cast("date")) & (F.col("ts") < F.lit("1999-01-01").cast("date")))
    return rounded(p.drop("series_id"))


@query("event_bars", "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def _(s, d):
    return prices.event_bars(s, d).withColumn("value", F.round("value", 6))


@query("log_returns", f"SELECT ts, {_round('f_ret', 'o_ret')} FROM lr2")
def _(s, d):
    return rounded(series.log_returns(px2(s, d), ("f", "o")).drop("series_id"))


def _feature_query(name: str, columns: list[str]) -> None:
    query(name, f"SELECT ts, pos, {_round(*columns)} FROM feat")(lambda s, d: rounded(feature_rows(s, d).select("ts", "pos", *columns)))


_feature_query("features_two_asset", FEATURES)
_feature_query("rolling_vol", ["f_vol5", "f_vol20", "o_vol5", "o_vol20"])
_feature_query("momentum", ["f_mom5", "f_mom20", "o_mom5", "o_mom20"])
_feature_query("xcorr20", ["xcorr20"])

for _name in reports.CONTROLS:
    query(_name, f"SELECT ts, {_round(_name)} FROM ctl")(lambda s, d, c=_name: rounded(series.controls(px2(s, d), "f").select("ts", c)))


@query(
    "features_multi_mc",
    "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, " + _round("a_ret", "a_vol20", "n_ret", "n_vol20", "r_ret", "r_vol20", "risk_aligned_mean_corr") + " FROM mf WHERE a_vol20 IS NOT NULL AND risk_aligned_mean_corr IS NOT NULL",
    mf="SELECT lr3.ts, a_ret, n_ret, r_ret, " + ", ".join(f"CASE WHEN count({a}_ret) OVER w20 = 20 THEN stddev_samp({a}_ret) OVER w20 END AS {a}_vol20" for a in "anr") + ", ar3.mc AS risk_aligned_mean_corr FROM lr3 JOIN ar3 ON ar3.ts = lr3.ts WINDOW w20 AS (ORDER BY lr3.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
)
def _(s, d):
    return rounded(series.multi_asset_features(prices.three_asset_panel(s, d), "anr", "risk_aligned_mean_corr", signs={"a": 1, "n": 1, "r": -1}).drop("series_id"))


@query(
    "features_multi_ar",
    "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, " + _round("a_ret", "a_vol20", "n_ret", "n_vol20", "r_ret", "r_vol20", "absorption_ratio", digits=6) + " FROM mf WHERE a_vol20 IS NOT NULL AND absorption_ratio IS NOT NULL",
    mf="SELECT lr3.ts, a_ret, n_ret, r_ret, " + ", ".join(f"CASE WHEN count({a}_ret) OVER w20 = 20 THEN stddev_samp({a}_ret) OVER w20 END AS {a}_vol20" for a in "anr") + ", ar3.ar AS absorption_ratio FROM lr3 JOIN ar3 ON ar3.ts = lr3.ts WINDOW w20 AS (ORDER BY lr3.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
)
def _(s, d):
    return rounded(series.multi_asset_features(prices.three_asset_panel(s, d), "anr"), 6)


def _three(s, d):
    return series.pair_correlations(series.log_returns(prices.three_asset_panel(s, d), "anr"), "anr")


@query("rolling_correlations", f"SELECT ts, {_round('c_an', 'c_ar', 'c_nr')} FROM xc3")
def _(s, d):
    return rounded(_three(s, d).select("ts", F.col("corr_a_n").alias("c_an"), F.col("corr_a_r").alias("c_ar"), F.col("corr_n_r").alias("c_nr")))


@query("absorption_ratio_k3", "SELECT ts, round(ar, 6) AS ar FROM ar3")
def _(s, d):
    """The eigensolver's result, against the closed form in SQL."""
    return rounded(series.spectral_aggregates(_three(s, d), "anr").select("ts", F.col("absorption_ratio").alias("ar")), 6)


@query("absorption_ratio_closed_form", "SELECT ts, round(ar, 6) AS ar FROM ar3")
def _(s, d):
    return rounded(_three(s, d).select("ts", series.absorption_ratio_closed("corr_a_n", "corr_a_r", "corr_n_r").alias("ar")), 6)


@query("risk_aligned_mc", "SELECT ts, round(mc, 7) AS mc FROM ar3")
def _(s, d):
    return rounded(series.aligned_mean_correlation(_three(s, d), "anr", {"a": 1, "n": 1, "r": -1}).select("ts", F.col("risk_aligned_mean_corr").alias("mc")))


@query(
    "top_eigvec_loading",
    "SELECT ts, round(un / (ua + un + ur), 5) AS leading_loading FROM lod",
    lod="SELECT ts, pow(3 * ar - 1, 2) - c_nr * c_nr AS ua, pow(3 * ar - 1, 2) - c_ar * c_ar AS un, pow(3 * ar - 1, 2) - c_an * c_an AS ur FROM ar3",
)
def _(s, d):
    """The eigenvector's component, against minors of the matrix in SQL."""
    return rounded(series.spectral_aggregates(_three(s, d), "anr", "n").select("ts", "leading_loading"), 5)


@query("month_bounds", "SELECT * FROM bounds")
def _(s, d):
    return events.month_bounds(windows_frame(s))


@query("crisis_mask", "SELECT crisis, ts, pos FROM mem")
def _(s, d):
    return members(s, d).select("crisis", "ts", "pos")


@query("crisis_context", 'SELECT ctx.crisis, "start", "end", cutoff, n_window, (SELECT count(*) FROM feat WHERE feat.ts < ctx.cutoff) AS n_pre, (SELECT count(*) FROM feat WHERE feat.ts < ctx.cutoff) >= 200 AS usable FROM ctx')
def _(s, d):
    return events.contexts(calendar(s, d), windows_frame(s)).select("crisis", "start", "end", "cutoff", "n_window", "n_pre", "usable")


@query("any_crisis_union", "SELECT pos, ts, in_any FROM anyc")
def _(s, d):
    c = calendar(s, d)
    return events.any_event(c, spans(s, d)).select("pos", "ts", "in_any")


@query("lookback_clean", "SELECT pos, coalesce(sum(CAST(in_any AS INT)) OVER w = 0 AND count(*) OVER w = 60, false) AS clean FROM anyc WINDOW w AS (ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def _(s, d):
    c = calendar(s, d)
    return events.clean_lookback(events.any_event(c, spans(s, d))).select("pos", "clean")


@query("default_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{b}')" for n, a, b in registry.DEFAULT) + ") t(crisis, start_month, end_month)")
def _(s, d):
    return registry.frame(s)


@query("fractional_year", "SELECT ts, round(year(ts) + dayofyear(ts) / 365.0, 6) AS fy FROM feat")
def _(s, d):
    return calendar(s, d).select("ts", F.round(events.fractional_year(F.col("ts")), 6).alias("fy"))


@query("era_buckets", "SELECT era, count(*) AS n FROM (SELECT CASE WHEN year(ts) < 1997 THEN '1995-1996' WHEN year(ts) < 1999 THEN '1997-1998' WHEN year(ts) < 2001 THEN '1999-2000' ELSE '2001-2002' END AS era FROM feat) GROUP BY era")
def _(s, d):
    return events.eras(calendar(s, d), reports.ERAS).groupBy("era").agg(F.count(F.lit(1)).alias("n"))


@query("scaler_params", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS scale FROM feat WHERE ts < DATE '1998-01-01'" for c in FEATURES))
def _(s, d):
    return rounded(fit.scaler(features(s, d).where("ts < date '1998-01-01'"), FEATURES), 9)


@query("standardised", " UNION ALL ".join(f"SELECT pos, '{c}' AS feature, round(({c} - (SELECT avg({c}) FROM feat WHERE ts < DATE '1998-01-01')) / (SELECT stddev_pop({c}) FROM feat WHERE ts < DATE '1998-01-01'), 6) AS value FROM feat" for c in FEATURES))
def _(s, d):
    f = features(s, d)
    return rounded(fit.standardised(f, FEATURES, fit.scaler(f.where("ts < date '1998-01-01'"), FEATURES)).drop("ts"), 6)


@query("covariance_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 10) AS cov FROM feat" for i, a in enumerate(FEATURES) for b in FEATURES[i:]))
def _(s, d):
    m = fit.moments(features(s, d).withColumn("all", F.lit(1)), FEATURES, ("all",))
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    return m.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"cov_{i}", 10).alias("cov")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


@query("zscore_causal", f"SELECT channel, pos, {_round('z', digits=6)} FROM zs")
def _(s, d):
    return rounded(scores(s, d).select("channel", "pos", "z"), 6)


@query(
    "zscore_ablation_w",
    " UNION ALL ".join(f"SELECT {w} AS smooth, channel, round(avg(CASE WHEN pos >= 60 AND sd > 0 THEN (s - mu) / sd END), 6) AS mean_z, count(CASE WHEN pos >= 60 AND sd > 0 THEN 1 END) AS n FROM (SELECT *, avg(s) OVER p AS mu, stddev_pop(s) OVER p AS sd FROM (SELECT *, avg(value) OVER (PARTITION BY channel ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS s FROM cv) WINDOW p AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE s IS NOT NULL GROUP BY channel" for w in (1, 5, 10, 20)),
)
def _(s, d):
    z = reports.smoothing_ablation(control_values(s, d), ("series_id", "channel"))
    return rounded(z.groupBy("smooth", "channel").agg(F.avg("z").alias("mean_z"), F.count("z").alias("n")), 6)


@query(
    "cohens_d",
    "SELECT crisis, channel, n_a AS n_inside, n_b AS n_outside, round(CASE WHEN n_a >= 2 AND n_b >= 2 THEN CASE WHEN ((n_a - 1) * v_a + (n_b - 1) * v_b) > 0 THEN (m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) ELSE 0 END END, 6) AS d FROM (SELECT b.crisis, channel, count(z) FILTER (i) AS n_a, count(z) FILTER (NOT i) AS n_b, avg(z) FILTER (i) AS m_a, avg(z) FILTER (NOT i) AS m_b, var_samp(z) FILTER (i) AS v_a, var_samp(z) FILTER (NOT i) AS v_b FROM (SELECT zs.*, span.crisis, pos BETWEEN lo AND hi AS i FROM zs, span) b GROUP BY ALL)",
)
def _(s, d):
    z = scores(s, d).join(spans(s, d).select("series_id", "crisis", "lo", "hi"), "series_id").withColumn("inside", F.col("pos").between(F.col("lo"), F.col("hi")))
    return rounded(stats.cohens_d(z, ("crisis", "channel")), 6)


def _wide_scores(s, d):
    return scores(s, d).groupBy("pos").pivot("channel", list(reports.CONTROLS)).agg(F.first("z"))


_PAIRS = [(a, b) for i, a in enumerate(reports.CONTROLS) for b in reports.CONTROLS[i + 1 :]]
_PAIR_STEP = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, x.z AS x, y.z AS y FROM zs x JOIN zs y ON y.pos = x.pos WHERE x.channel = '{a}' AND y.channel = '{b}' AND x.z IS NOT NULL AND y.z IS NOT NULL" for a, b in _PAIRS)
_RANK_STEP = "SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS y FROM prs"


@query("pearson_matrix", "SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS pearson FROM prs GROUP BY a, b", prs=_PAIR_STEP)
def _(s, d):
    return rounded(stats.pearson(_wide_scores(s, d), reports.CONTROLS), 6)


@query("spearman_matrix", "SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS spearman FROM rks GROUP BY a, b", prs=_PAIR_STEP, rks=_RANK_STEP)
def _(s, d):
    return rounded(stats.spearman(_wide_scores(s, d), reports.CONTROLS), 6)


@query("corr_divergence", "SELECT p.a, p.b, p.n, round(p.r, 6) AS pearson, round(s.r, 6) AS spearman, round(abs(p.r - s.r), 6) AS gap, abs(p.r - s.r) > 0.1 AS flagged FROM (SELECT a, b, count(*) AS n, corr(x, y) AS r FROM prs GROUP BY a, b) p JOIN (SELECT a, b, corr(x, y) AS r FROM rks GROUP BY a, b) s ON s.a = p.a AND s.b = p.b", prs=_PAIR_STEP, rks=_RANK_STEP)
def _(s, d):
    return rounded(stats.correlation_divergence(_wide_scores(s, d), reports.CONTROLS), 6)


_EMPIRICAL = "any_value(real) AS real, count(*) AS draws, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.025) AS lo95, quantile_cont(d, 0.975) AS hi95, (1 + count(*) FILTER (d >= real)) / (1 + count(*)) AS p_raw, 100.0 * count(*) FILTER (d < real) / count(*) AS pct"
_SUMMED = _round("real", "med", "lo95", "hi95", "p_raw", "pct", digits=6)


def _draws(step: str) -> str:
    return f"SELECT q.channel, q.crisis, q.d, r.d AS real FROM {step} q JOIN real r ON r.channel = q.channel AND r.crisis = q.crisis"


@query("shift_null", f"SELECT channel, crisis, draws, {_SUMMED} FROM (SELECT channel, crisis, {_EMPIRICAL} FROM dr GROUP BY channel, crisis)", dr=_draws("shd"))
def _(s, d):
    _, win, sums = null_parts(s, d)
    return rounded(nulls.summary(nulls.shift_draws(win, sums), nulls.real_windows(win, sums)), 6)


@query("window_null_exhaustive", f"SELECT channel, crisis, draws, {_SUMMED} FROM (SELECT channel, crisis, {_EMPIRICAL} FROM dr GROUP BY channel, crisis)", dr=_draws("wad"))
def _(s, d):
    _, win, sums = null_parts(s, d)
    return rounded(nulls.summary(nulls.window_draws(win, sums), nulls.real_windows(win, sums)), 6)


def _sampled(draws: int, source: str = "wad", key: str = "concat_ws(':', 'px2', channel, crisis, pick, 42)") -> dict[str, str]:
    return {
        "num": f"SELECT *, row_number() OVER (PARTITION BY channel, crisis ORDER BY start) - 1 AS nth, count(*) OVER (PARTITION BY channel, crisis) AS pool FROM {source}",
        "pck": "SELECT channel, crisis, pick, CAST('0x' || substr(md5(" + key + f"), 1, 12) AS BIGINT) % pool AS nth FROM (SELECT *, unnest(range(1, {draws + 1})) AS pick FROM (SELECT DISTINCT channel, crisis, pool FROM num))",
        "smp": "SELECT n.channel, n.crisis, n.d, p.pick AS draw_id FROM pck p JOIN num n ON n.channel = p.channel AND n.crisis = p.crisis AND n.nth = p.nth",
    }


@query("window_null_sampled", f"SELECT channel, crisis, draws, {_SUMMED} FROM (SELECT channel, crisis, {_EMPIRICAL} FROM dr GROUP BY channel, crisis)", **_sampled(5000), dr=_draws("smp"))
def _(s, d):
    _, win, sums = null_parts(s, d)
    return rounded(nulls.summary(nulls.window_draws(win, sums, draws=5000), nulls.real_windows(win, sums)), 6)


_TAU_STEPS = {
    "cen": "SELECT channel, m, total, z - avg(z) OVER (PARTITION BY channel) AS x FROM fin",
    "rho": "SELECT a.channel, b.m - a.m AS lag, sum(a.x * b.x) / any_value(v.v) AS rho FROM cen a JOIN cen b ON b.channel = a.channel AND b.m > a.m AND b.m - a.m <= 2000 JOIN (SELECT channel, sum(x * x) AS v FROM cen GROUP BY channel) v ON v.channel = a.channel GROUP BY a.channel, b.m - a.m",
    "acf": "SELECT channel, greatest(1, 1 + 2 * coalesce(sum(rho) FILTER (lag < stop), 0)) AS tau FROM (SELECT *, min(CASE WHEN rho <= 0 THEN lag ELSE 100000 END) OVER (PARTITION BY channel) AS stop FROM rho) GROUP BY channel",
}


@query("autocorr_tau", "SELECT acf.channel, round(tau, 5) AS tau, round(n / tau, 4) AS n_eff FROM acf JOIN (SELECT channel, count(*) AS n FROM fin GROUP BY channel) c ON c.channel = acf.channel", **_TAU_STEPS)
def _(s, d):
    t = stats.autocorrelation(nulls.finite(scores(s, d)), K, order="m")
    return t.select("channel", F.round("tau", 5).alias("tau"), F.round("n_eff", 4).alias("n_eff"))


@query("panel_median", f"SELECT channel, draws, {_SUMMED} FROM (SELECT channel, {_EMPIRICAL} FROM (SELECT n.channel, n.d, r.real FROM (SELECT channel, draw_id, median(d) AS d FROM shd GROUP BY channel, draw_id) n JOIN (SELECT channel, median(d) AS real FROM real GROUP BY channel) r ON r.channel = n.channel) GROUP BY channel)")
def _(s, d):
    _, win, sums = null_parts(s, d)
    return rounded(nulls.panel_statistics(nulls.shift_draws(win, sums), nulls.real_windows(win, sums)).drop("statistic"), 6)


@query("panel_mean_max", " UNION ALL ".join(f"SELECT '{n}' AS statistic, channel, draws, {_SUMMED} FROM (SELECT channel, {_EMPIRICAL} FROM (SELECT n.channel, n.d, r.real FROM (SELECT channel, draw_id, {f}(d) AS d FROM shd GROUP BY channel, draw_id) n JOIN (SELECT channel, {f}(d) AS real FROM real GROUP BY channel) r ON r.channel = n.channel) GROUP BY channel)" for n, f in (("mean", "avg"), ("max", "max"))))
def _(s, d):
    _, win, sums = null_parts(s, d)
    b, real = nulls.shift_draws(win, sums), nulls.real_windows(win, sums)
    return rounded(nulls.panel_statistics(b, real, "mean").unionByName(nulls.panel_statistics(b, real, "max")), 6)


@query(
    "panel_count_stat",
    "SELECT channel, real AS count, round(avg(d), 6) AS null_mean, round(quantile_cont(CAST(d AS DOUBLE), 0.95), 6) AS null_95, round((1 + count(*) FILTER (d >= real)) / (1 + count(*)), 6) AS p FROM (SELECT n.channel, n.d, r.real FROM cnt n JOIN rcn r ON r.channel = n.channel) GROUP BY channel, real",
    thr="SELECT channel, crisis, quantile_cont(d, 0.95) AS t FROM shd GROUP BY channel, crisis",
    cnt="SELECT q.channel, q.draw_id, count(*) FILTER (q.d > t.t) AS d FROM shd q JOIN thr t ON t.channel = q.channel AND t.crisis = q.crisis GROUP BY q.channel, q.draw_id",
    rcn="SELECT r.channel, count(*) FILTER (r.d > t.t) AS real FROM real r JOIN thr t ON t.channel = r.channel AND t.crisis = r.crisis GROUP BY r.channel",
)
def _(s, d):
    _, win, sums = null_parts(s, d)
    c = nulls.count_statistic(nulls.shift_draws(win, sums), nulls.real_windows(win, sums))
    return rounded(c.select("channel", "count", "null_mean", "null_95", "p"), 6)


@query("bh_fdr", "SELECT channel, crisis, round(p, 7) AS p, round(least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 7) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, channel, crisis) AS rk, count(*) OVER () AS n FROM pv)", dr=_draws("shd"), pv="SELECT channel, crisis, (1 + count(*) FILTER (d >= real)) / (1 + count(*)) AS p FROM dr GROUP BY channel, crisis")
def _(s, d):
    _, win, sums = null_parts(s, d)
    p = nulls.summary(nulls.shift_draws(win, sums), nulls.real_windows(win, sums)).select("channel", "crisis", F.col("p_raw").alias("p"))
    return rounded(stats.benjamini_hochberg(p, ties=("channel", "crisis")))


_PANELS = {
    "panr": "SELECT channel, median(d) AS real FROM real GROUP BY channel",
    "panp": " UNION ALL ".join(f"SELECT n.channel, '{f}' AS family, (1 + count(*) FILTER (n.d >= r.real)) / (1 + count(*)) AS p FROM (SELECT channel, draw_id, median(d) AS d FROM {step} GROUP BY channel, draw_id) n JOIN panr r ON r.channel = n.channel GROUP BY n.channel" for f, step in (("a", "smp"), ("b", "shd"))),
    "panq": "SELECT *, least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, channel, family) AS rk, count(*) OVER () AS n FROM panp)",
}


@query(
    "verdicts",
    "SELECT channel, round(a_p, 7) AS a_p, round(a_q, 7) AS a_q, round(b_p, 7) AS b_p, round(b_q, 7) AS b_q, CASE WHEN a_p < 0.05 AND b_p < 0.05 THEN 'CLEARS BOTH' WHEN a_p < 0.05 THEN '(a) only' WHEN b_p < 0.05 THEN '(b) only' ELSE 'neither' END AS verdict FROM (SELECT channel, "
    + ", ".join(f"any_value({c}) FILTER (family = '{f}') AS {f}_{c}" for f in "ab" for c in "pq") + " FROM panq GROUP BY channel)",
    **_sampled(5000), **_PANELS,
)
def _(s, d):
    _, win, sums = null_parts(s, d)
    real = nulls.real_windows(win, sums)
    a = nulls.panel_statistics(nulls.window_draws(win, sums, draws=5000), real).select(*K, F.lit("a").alias("family"), F.col("p_raw").alias("p"))
    b = nulls.panel_statistics(nulls.shift_draws(win, sums), real).select(*K, F.lit("b").alias("family"), F.col("p_raw").alias("p"))
    return rounded(nulls.verdicts(a.unionByName(b)))


@query(
    "null_model",
    "SELECT q.channel, q.crisis, family, round(real, 6) AS real, draws, round(p_raw, 7) AS p_raw, round(p, 7) AS p, round(q, 7) AS q, CASE WHEN gap > 0 THEN 'up' WHEN gap < 0 THEN 'down' ELSE 'flat' END AS direction, q < 0.05 AS clears FROM nmq q JOIN nmw w ON w.channel = q.channel AND w.crisis = q.crisis",
    **_sampled(5000), **_TAU_STEPS,
    nma=_draws("smp"), nmb=_draws("shd"),
    nmp="SELECT channel, crisis, 'a' AS family, any_value(real) AS real, count(*) AS draws, (1 + count(*) FILTER (d >= real)) / (1 + count(*)) AS p_raw, (1 + count(*) FILTER (d >= real)) / (1 + count(*)) AS p FROM nma GROUP BY channel, crisis UNION ALL "
    "SELECT b.channel, b.crisis, 'b', any_value(real), count(*), (1 + count(*) FILTER (d >= real)) / (1 + count(*)), greatest((1 + count(*) FILTER (d >= real)) / (1 + count(*)), any_value(1 / (c.n / acf.tau + 1))) FROM nmb b JOIN acf ON acf.channel = b.channel JOIN (SELECT channel, count(*) AS n FROM fin GROUP BY channel) c ON c.channel = b.channel GROUP BY b.channel, b.crisis",
    nmq="SELECT *, least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, channel, crisis, family) AS rk, count(*) OVER () AS n FROM nmp)",
    nmw="SELECT w.channel, w.crisis, avg(f.z) FILTER (f.m BETWEEN w.lo AND w.hi) - avg(f.z) FILTER (f.m NOT BETWEEN w.lo AND w.hi) AS gap FROM win w JOIN fin f ON f.channel = w.channel GROUP BY w.channel, w.crisis",
)
def _(s, d):
    """Events and channels one by one: both nulls, floors, false discoveries, directions."""
    out = reports.null_model(scores(s, d), spans(s, d), reports.CONTROLS)
    return rounded(out.select("channel", "crisis", "family", F.round("real", 6).alias("real"), "draws", "p_raw", "p", "q", "direction", "clears"))


@query(
    "panel_controls",
    f"SELECT channel, family, draws, {_SUMMED.replace('round(p_raw, 6) AS p_raw', 'round(p_raw, 7) AS p_raw')}, round(p, 7) AS p FROM pcx",
    usable="SELECT crisis FROM ctx WHERE (SELECT count(*) FROM feat WHERE feat.ts < ctx.cutoff) >= 200",
    uwad="SELECT * FROM wad WHERE crisis IN (SELECT crisis FROM usable)", ushd="SELECT * FROM shd WHERE crisis IN (SELECT crisis FROM usable)",
    **_sampled(5000, "uwad", "concat_ws(':', crisis, 'px2', channel, pick, 42)"), **_TAU_STEPS,
    preal="SELECT channel, median(d) AS real FROM real WHERE crisis IN (SELECT crisis FROM usable) GROUP BY channel",
    pca="SELECT n.channel, n.d, r.real FROM (SELECT channel, draw_id, median(d) AS d FROM smp GROUP BY channel, draw_id) n JOIN preal r ON r.channel = n.channel",
    pcb="SELECT n.channel, n.d, r.real FROM (SELECT channel, draw_id, median(d) AS d FROM ushd GROUP BY channel, draw_id) n JOIN preal r ON r.channel = n.channel",
    pcx=f"SELECT channel, 'a' AS family, *, p_raw AS p FROM (SELECT channel, {_EMPIRICAL} FROM pca GROUP BY channel) UNION ALL SELECT x.channel, 'b', x.*, greatest(p_raw, 1 / (c.n / acf.tau + 1)) FROM (SELECT channel, {_EMPIRICAL} FROM pcb GROUP BY channel) x JOIN acf ON acf.channel = x.channel JOIN (SELECT channel, count(*) AS n FROM fin GROUP BY channel) c ON c.channel = x.channel",
)
def _(s, d):
    """The panel study on the controls, whose scores are alike under every fit."""
    st = study(s, d)
    out = reports.panel_study(st, st.for_each_fit(scores(s, d)))["panel_nulls"]
    return rounded(out.select("channel", "family", "draws", *[F.round(c, 6).alias(c) for c in ("real", "med", "lo95", "hi95", "pct")], F.round("p_raw", 7).alias("p_raw"), F.round("p", 7).alias("p")))


def _moves(fin, s, d):
    ret = series.controls(panel(s, d), "f").select("series_id", "ts", F.coalesce("ret", F.lit(0.0)).alias("r"))
    return nulls.prefix_sums(fin.join(ret, ["series_id", "ts"]), K, "r")


@query(
    "trend_matched_pool",
    "SELECT channel, crisis, count(*) AS pool, round(median(d), 6) AS med, round(quantile_cont(d, 0.95), 6) AS p95, sum(start) AS start_sum FROM nr WHERE nth <= greatest(1, round_even(tot * 0.1, 0)) GROUP BY channel, crisis",
    mv="SELECT fin.channel, fin.m, coalesce(ctl.ret, 0.0) AS r FROM fin JOIN ctl ON ctl.ts = fin.ts",
    mvp="SELECT channel, m + 1 AS i, sum(r) OVER (PARTITION BY channel ORDER BY m ROWS UNBOUNDED PRECEDING) AS c FROM mv UNION ALL SELECT DISTINCT channel, 0, 0.0 FROM mv",
    mva="SELECT w.*, a.c AS ca FROM wad w JOIN mvp a ON a.channel = w.channel AND a.i = w.start",
    mvb="SELECT w.*, b.c - w.ca AS move FROM mva w JOIN mvp b ON b.channel = w.channel AND b.i = w.start + w.len",
    owa="SELECT w.channel, w.crisis, w.hi, a.c AS ca FROM win w JOIN mvp a ON a.channel = w.channel AND a.i = w.lo",
    owb="SELECT w.channel, w.crisis, b.c - w.ca AS own FROM owa w JOIN mvp b ON b.channel = w.channel AND b.i = w.hi + 1",
    nr="SELECT w.*, count(*) OVER (PARTITION BY w.channel, w.crisis) AS tot, row_number() OVER (PARTITION BY w.channel, w.crisis ORDER BY round(abs(w.move - o.own), 12), w.start) AS nth FROM mvb w JOIN owb o ON o.channel = w.channel AND o.crisis = w.crisis",
)
def _(s, d):
    fin, win, sums = null_parts(s, d)
    pool = nulls.trend_matched(win, sums, _moves(fin, s, d))
    return rounded(pool.groupBy("channel", "crisis").agg(F.count(F.lit(1)).alias("pool"), F.median("d").alias("med"), F.percentile("d", F.lit(0.95)).alias("p95"), F.sum("start").alias("start_sum")), 6)


_CURVE = f"SELECT q.channel, q.crisis, q.shift, {oracle.abs_d('b.c1 - a.c1', 'b.c2 - a.c2', 't.c1', 't.c2', 'q.len', 'q.total')} AS d FROM (SELECT *, (lo + shift + total) % total AS start FROM (SELECT *, unnest(range(-60, 61, 10)) AS shift FROM win)) q JOIN pre a ON a.channel = q.channel AND a.i = q.start JOIN pre b ON b.channel = q.channel AND b.i = q.start + q.len JOIN pre t ON t.channel = q.channel AND t.i = q.total"


@query("mask_shift_curve", "SELECT channel, shift, round(median(d), 6) AS med FROM crv GROUP BY channel, shift", crv=_CURVE)
def _(s, d):
    fin, win, sums = null_parts(s, d)
    c = nulls.shifted_mask_curve(fin, win, sums)
    return rounded(c.groupBy("channel", F.col("shift").cast("long").alias("shift")).agg(F.median("d").alias("med")), 6)


@query("mask_shift_peak_top4", "SELECT crisis, shift AS peak, round(d, 6) AS peak_d FROM (SELECT *, row_number() OVER (PARTITION BY crisis ORDER BY d DESC, shift) AS nth FROM crv WHERE channel = 'realized_vol' AND crisis IN (SELECT crisis FROM real WHERE channel = 'realized_vol' ORDER BY d DESC, crisis LIMIT 4)) WHERE nth = 1", crv=_CURVE)
def _(s, d):
    """Where the curve of each of the four largest effects peaks, the first of equal peaks."""
    fin, win, sums = null_parts(s, d)
    win = win.where("channel = 'realized_vol'")
    top = nulls.real_windows(win, sums).orderBy(F.col("real").desc(), "crisis").limit(4).select("crisis")
    c = nulls.shifted_mask_curve(fin, win, sums).join(top, "crisis", "left_semi")
    best = F.max(F.struct(F.col("d"), F.negative(F.col("shift").cast("long")).alias("back")))
    return rounded(c.groupBy("crisis").agg(best.alias("x")).select("crisis", F.negative("x.back").alias("peak"), F.col("x.d").alias("peak_d")), 6)


@query("upcross", "SELECT channel, pos, firing, upcross FROM upx")
def _(s, d):
    return fired_rows(s, d).select("channel", "pos", "firing", "upcross")


@query("tau_calibration", f"SELECT channel, {_round('tau', 'block_far', digits=6)}, target_count FROM tau")
def _(s, d):
    return rounded(alarms.calibrated(alarm_rows(s, d)[1].where("block")), 6)


@query("threshold_sweep", "SELECT channel, round(tau, 9) AS tau, upcrossings FROM swp")
def _(s, d):
    return rounded(alarms.threshold_sweep(alarm_rows(s, d)[1].where("block")), 9)


@query("far_calm", "SELECT channel, count(*) FILTER (upcross) AS alarms, count(*) AS calm_rows, round(count(*) FILTER (upcross) / (count(*) / 252.0), 6) AS far FROM upx WHERE forward AND NOT in_any GROUP BY channel")
def _(s, d):
    return rounded(alarms.yearly_rate(fired_rows(s, d), F.col("forward") & ~F.col("in_any")), 6)


@query("far_by_era", "SELECT channel, CASE WHEN year(ts) < 1997 THEN '1995-1996' WHEN year(ts) < 1999 THEN '1997-1998' WHEN year(ts) < 2001 THEN '1999-2000' ELSE '2001-2002' END AS era, count(*) FILTER (upcross) AS alarms, count(*) AS calm_rows, round(count(*) FILTER (upcross) / (count(*) / 252.0), 6) AS far FROM upx WHERE forward AND NOT in_any GROUP BY ALL")
def _(s, d):
    return rounded(alarms.yearly_rate(events.eras(fired_rows(s, d), reports.ERAS), F.col("forward") & ~F.col("in_any"), (*K, "era")), 6)


@query("detect_delay", "SELECT channel, crisis, hit IS NOT NULL AS detected, hit - st AS delay, coalesce(hit = st, false) AS early FROM det")
def _(s, d):
    return rounded(alarms.detection(fired_rows(s, d).where("forward"), spans(s, d)))


@query("chance_floor", "SELECT c.channel, any_value(n.k) AS detections, round(avg(hits), 6) AS floor_mean, round(quantile_cont(CAST(hits AS DOUBLE), 0.95), 6) AS floor_95, round((1 + count(*) FILTER (hits >= n.k)) / (1 + count(*)), 6) AS p FROM chn c JOIN (SELECT channel, count(hit) AS k FROM det GROUP BY channel) n ON n.channel = c.channel GROUP BY c.channel")
def _(s, d):
    rows = fired_rows(s, d).where("forward")
    return rounded(alarms.chance_floor(alarms.chance_counts(rows, spans(s, d)), alarms.detection(rows, spans(s, d))), 6)


@query("exceedance_ratio", "SELECT channel, round(e, 6) AS event_pct, round(c, 6) AS calm_pct, CASE WHEN c > 0 THEN round(e / c, 6) ELSE CAST('infinity' AS DOUBLE) END AS ratio FROM (SELECT channel, 100.0 * avg(CAST(firing AS INT)) FILTER (forward AND in_any) AS e, 100.0 * avg(CAST(firing AS INT)) FILTER (forward AND NOT in_any) AS c FROM upx GROUP BY channel)")
def _(s, d):
    return rounded(alarms.exceedance(fired_rows(s, d), F.col("forward") & F.col("in_any"), F.col("forward") & ~F.col("in_any")), 6)


@query(
    "block_forward_max",
    "SELECT t.channel, round(block_max, 6) AS block_max, round(forward_max, 6) AS forward_max, round(far, 6) AS far_at_block_max FROM top t LEFT JOIN (SELECT channel, count(*) FILTER (f AND NOT coalesce(b, false)) / (count(*) / 252.0) AS far FROM bfm WHERE forward AND NOT in_any GROUP BY channel) x ON x.channel = t.channel",
    top="SELECT channel, max(z) FILTER (block) AS block_max, max(z) FILTER (forward) AS forward_max FROM zc GROUP BY channel",
    bfm="SELECT *, lag(f) OVER (PARTITION BY channel ORDER BY pos) AS b FROM (SELECT zc.*, coalesce(z > block_max, false) AS f FROM zc JOIN top ON top.channel = zc.channel)",
)
def _(s, d):
    return rounded(reports.block_maximum(alarm_rows(s, d)[1]), 6)


@query("causality_audit", "SELECT 'no event row in the block' AS \"check\", CASE WHEN count(*) FILTER (block AND in_any) = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM cal UNION ALL SELECT 'block precedes deployment', CASE WHEN max(pos) FILTER (block) < min(pos) FILTER (forward) THEN 'PASS' ELSE 'FAIL' END FROM cal UNION ALL SELECT 'block and deployment are apart', CASE WHEN count(*) FILTER (block AND forward) = 0 THEN 'PASS' ELSE 'FAIL' END FROM cal")
def _(s, d):
    return alarms.causality_audit(alarm_rows(s, d)[0])


@query(
    "target_sweep",
    "SELECT c.target, c.channel, any_value(n.k) AS detections, round(avg(hits), 6) AS floor_mean, round(quantile_cont(CAST(hits AS DOUBLE), 0.95), 6) AS floor_95, round((1 + count(*) FILTER (hits >= n.k)) / (1 + count(*)), 6) AS p, any_value(r.alarms) AS alarms, any_value(r.calm_rows) AS calm_rows, round(any_value(r.far), 6) AS far FROM tch c JOIN tde n ON n.channel = c.channel AND n.target = c.target JOIN tra r ON r.channel = c.channel AND r.target = c.target GROUP BY c.target, c.channel",
    tgt="SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS target",
    tgo="SELECT target, channel, greatest(1, round_even(target * count(z) / 252.0, 0)) AS goal FROM blk, tgt GROUP BY target, channel",
    tta="SELECT target, channel, tau FROM (SELECT g.target, s.channel, s.tau, row_number() OVER (PARTITION BY g.target, s.channel ORDER BY abs(upcrossings - goal), tau DESC) AS nth FROM swp s JOIN tgo g ON g.channel = s.channel) WHERE nth = 1",
    tfi="SELECT zc.*, target, coalesce(z > tau, false) AS firing FROM zc JOIN tta ON tta.channel = zc.channel",
    tup="SELECT *, firing AND NOT coalesce(lag(firing) OVER (PARTITION BY target, channel ORDER BY pos), false) AS upcross FROM tfi",
    tra="SELECT target, channel, count(*) FILTER (upcross) AS alarms, count(*) AS calm_rows, count(*) FILTER (upcross) / (count(*) / 252.0) AS far FROM tup WHERE forward AND NOT in_any GROUP BY target, channel",
    tde="SELECT target, channel, count(*) FILTER (hit) AS k FROM (SELECT target, channel, crisis, bool_or(firing) AS hit FROM tup u JOIN fmem ON fmem.pos = u.pos WHERE forward GROUP BY target, channel, crisis) GROUP BY target, channel",
    tfw="SELECT target, channel, pos, firing, row_number() OVER (PARTITION BY target, channel ORDER BY pos) - 1 AS m, count(*) OVER (PARTITION BY target, channel) AS total FROM tup WHERE forward",
    thi="SELECT DISTINCT f.target, f.channel, e.crisis, (p.m - f.m + f.total) % f.total AS shift FROM tfw f JOIN tfw p ON p.channel = f.channel AND p.target = f.target JOIN fmem e ON e.pos = p.pos WHERE f.firing",
    tch="SELECT s.target, s.channel, s.shift, count(h.crisis) AS hits FROM (SELECT DISTINCT target, channel, unnest(range(1, total)) AS shift FROM tfw) s LEFT JOIN thi h ON h.target = s.target AND h.channel = s.channel AND h.shift = s.shift GROUP BY s.target, s.channel, s.shift",
)
def _(s, d):
    return rounded(reports.target_sweep(study(s, d), scores(s, d)), 6)


_GAMMA = 0.05


@query("mmd_series", f"SELECT pos, round(CASE WHEN pos >= 20 THEN 2 * (1 - exp(-{_GAMMA} * d2)) / 400.0 END, 9) AS mmd FROM (SELECT pos, " + " + ".join(f"pow(1000 * ({c} - lag({c}, 20) OVER (ORDER BY pos)), 2)" for c in ("f_ret", "o_ret", "xcorr20")) + " AS d2 FROM feat)")
def _(s, d):
    rows = features(s, d).select("series_id", "pos", F.array(*[1000 * F.col(c) for c in ("f_ret", "o_ret", "xcorr20")]).alias("x"))
    return rounded(series.rolling_mmd(rows, _GAMMA).select("pos", "mmd"), 9)


_OPS2 = kernels.hermitian_family(2, 2, 7)


def _two_level(x: list[str], lit: Callable[[float], str] = repr) -> str:
    const = (_OPS2[0] @ _OPS2[0] + _OPS2[1] @ _OPS2[1]) / 2
    half = f"({x[0]} * {x[0]} + {x[1]} * {x[1]}) / 2"

    def entry(i, j, part):
        get = lambda m: lit(float(getattr(m[i, j], part)))
        return f"({get(const)} - {x[0]} * ({get(_OPS2[0])}) - {x[1]} * ({get(_OPS2[1])})" + (f" + {half}" if i == j else "") + ")"

    a, b, re, im = entry(0, 0, "real"), entry(1, 1, "real"), entry(0, 1, "real"), entry(0, 1, "imag")
    return f"({a} + {b}) / 2 - sqrt(({a} - {b}) * ({a} - {b}) / 4 + {re} * {re} + {im} * {im})"


@query("ground_energy_n2", f"SELECT pos, round({_two_level(['(10 * f_ret)', '(10 * o_ret)'])}, 8) AS e0 FROM feat")
def _(s, d):
    """The eigensolver's lowest level, against the closed form in SQL."""
    rows = features(s, d).select("series_id", "pos", F.array(10 * F.col("f_ret"), 10 * F.col("o_ret")).alias("x"))
    return rounded(channels.state_rows(rows, _OPS2).select("pos", F.col("ground_energy").alias("e0")), 8)


@query(
    "aggregate_banding",
    "SELECT count(*) AS days, round(median(ar), 6) AS med_ar, round(abs(corr(ar, mc)), 6) AS abs_corr, CASE WHEN median(ar) < 0.4 THEN 'AR-safe' WHEN median(ar) < 0.5 THEN 'AMBIGUOUS' ELSE 'MC' END AS band_1, CASE WHEN abs(corr(ar, mc)) < 0.5 THEN 'AR-safe' WHEN abs(corr(ar, mc)) < 0.8 THEN 'AMBIGUOUS' ELSE 'MC' END AS band_2, CASE WHEN median(ar) < 0.4 AND abs(corr(ar, mc)) < 0.5 THEN 'AR' ELSE 'MC' END AS choice FROM cl WHERE clean AND year(ts) = 1999 AND ar IS NOT NULL AND mc IS NOT NULL",
    sp3="SELECT crisis, greatest(0, min(ppos) - 10) AS lo, max(ppos) + 10 AS hi FROM ar3 JOIN bounds ON ts BETWEEN first_day AND last_day GROUP BY crisis",
    in3="SELECT DISTINCT ppos FROM ar3 JOIN sp3 ON ppos BETWEEN lo AND hi",
    cl="SELECT *, sum(CAST(hit AS INT)) OVER w = 0 AND count(*) OVER w = 60 AS clean FROM (SELECT ar3.*, ar3.ppos IN (SELECT ppos FROM in3) AS hit FROM ar3) WINDOW w AS (ORDER BY ppos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
)
def _(s, d):
    p = prices.three_asset_panel(s, d)
    out = reports.aggregate_choice(p, "anr", windows_frame(s), 1999, {"a": 1, "n": 1, "r": -1}, ((0.4, 0.5), (0.5, 0.8)))
    return rounded(out.drop("med_loading"), 6)


@query("nan_audit", "SELECT mem.crisis, zs.channel, count(*) AS rows_in, count(z) AS finite FROM zs JOIN mem ON mem.pos = zs.pos GROUP BY ALL")
def _(s, d):
    j = alarms.within_spans(scores(s, d), spans(s, d))
    return j.groupBy("crisis", "channel").agg(F.count(F.lit(1)).alias("rows_in"), F.count("z").alias("finite"))


@query("expanding_sd", "SELECT sm.channel, g.crisis, round(stddev_pop(sm.s), 8) AS sd FROM sm, (SELECT crisis, CAST(floor(avg(pos)) AS BIGINT) AS mid FROM mem GROUP BY crisis) g WHERE sm.pos < g.mid GROUP BY ALL")
def _(s, d):
    w = Window.partitionBy(*K).orderBy("pos").rowsBetween(-19, 0)
    smooth = control_values(s, d).withColumn("s", F.avg("value").over(w))
    mid = spans(s, d).select("series_id", "crisis", F.floor((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    return rounded(smooth.join(mid, "series_id").where("pos < mid").groupBy("channel", "crisis").agg(F.stddev_pop("s").alias("sd")), 8)


def _drift(s, d):
    _, win, sums = null_parts(s, d)
    when = events.contexts(calendar(s, d), windows_frame(s)).select("series_id", "crisis", events.fractional_year(F.col("start")).alias("fy"))
    return stats.trend(nulls.real_windows(win, sums).join(when, ["series_id", "crisis"]), "fy", "real", K)


_WHEN = "SELECT r.channel, r.d, c.fy FROM real r JOIN (SELECT crisis, year(\"start\") + dayofyear(\"start\") / 365.0 AS fy FROM ctx) c ON c.crisis = r.crisis"


@query("ols_drift", "SELECT channel, count(*) AS n, round(regr_slope(d, fy), 6) AS slope FROM whn GROUP BY channel", whn=_WHEN)
def _(s, d):
    return rounded(_drift(s, d).select("channel", "n", "slope"), 6)


@query(
    "drift_rank_correlation",
    "SELECT channel, n, round(rho, 6) AS rho, CASE WHEN n = 6 THEN round(1 - abs(rho) * (1 + (1 - rho * rho) / 2), 6) END AS p FROM (SELECT channel, count(*) AS n, corr(rank_d, rank_y) AS rho FROM whr GROUP BY channel)",
    whn=_WHEN, whr="SELECT channel, rank() OVER (PARTITION BY channel ORDER BY d) AS rank_d, rank() OVER (PARTITION BY channel ORDER BY fy) AS rank_y FROM whn",
)
def _(s, d):
    """Six events leave four degrees of freedom, for which SQL has the p-value in closed form."""
    return rounded(_drift(s, d).select("channel", "n", "rho", "p"), 6)


_POLITIS = {
    "cen": _TAU_STEPS["cen"],
    "pwp": "SELECT channel, max(total) AS n, greatest(5, CAST(ceil(2 * sqrt(log10(max(total)))) AS BIGINT)) AS run FROM fin GROUP BY channel",
    "pwr": "SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) + run AS reach FROM pwp",
    "pwc": "SELECT a.channel, b.m - a.m AS k, sum(a.x * b.x) / any_value(p.n) AS cov FROM cen a JOIN pwr p ON p.channel = a.channel JOIN cen b ON b.channel = a.channel AND b.m >= a.m AND b.m <= a.m + p.reach GROUP BY a.channel, b.m - a.m",
    "pws": "SELECT c.*, p.n, p.run, p.reach, z.cov AS c0, abs(c.cov) < 2 * sqrt(log10(p.n) / p.n) * z.cov AS small FROM pwc c JOIN pwr p ON p.channel = c.channel JOIN pwc z ON z.channel = c.channel AND z.k = 0",
    "pwq": "SELECT channel, min(k) AS quiet FROM (SELECT a.channel, a.k FROM pws a JOIN pws b ON b.channel = a.channel AND b.k > a.k AND b.k <= a.k + a.run WHERE a.k >= 1 AND a.k <= a.reach - a.run GROUP BY a.channel, a.k HAVING bool_and(b.small)) GROUP BY channel",
    "pww": "SELECT p.channel, n, quiet IS NULL AS saturated, least(2 * coalesce(quiet, reach), reach) AS width FROM pwr p LEFT JOIN pwq q ON q.channel = p.channel",
    "pwg": "SELECT s.channel, any_value(w.n) AS n, bool_or(w.saturated) AS saturated, 2 * sum(s.k * s.cov * greatest(0, least(1, 2 - 2 * s.k / w.width))) AS slope, any_value(c0) + 2 * sum(s.cov * greatest(0, least(1, 2 - 2 * s.k / w.width))) AS level FROM pws s JOIN pww w ON w.channel = s.channel WHERE s.k BETWEEN 1 AND w.width GROUP BY s.channel",
    "pwb": "SELECT channel, n, saturated, CAST(CASE WHEN slope <= 0 OR level = 0 THEN 1 ELSE least(greatest(1, round_even(pow(1.5 * n * pow(slope / level, 2), 1 / 3.0), 0)), ceil(least(3 * sqrt(n), n / 3.0))) END AS BIGINT) AS block FROM pwg",
}
_BOOTSTRAP = _POLITIS | {
    "bst": "SELECT channel, rep, CAST('0x' || substr(md5(concat_ws(':', rep, b, 42)), 1, 12) AS BIGINT) % n AS s, CASE WHEN b = CAST(ceil(n / block) AS BIGINT) - 1 THEN n - b * block ELSE block END AS len, n FROM (SELECT *, unnest(range(0, CAST(ceil(n / block) AS BIGINT))) AS b FROM (SELECT *, unnest(range(0, 2000)) AS rep FROM pwb))",
    "bto": "SELECT t.channel, rep, sum(y.c1 - x.c1) AS t1, sum(y.c2 - x.c2) AS t2 FROM bst t JOIN pre x ON x.channel = t.channel AND x.i = t.s JOIN pre y ON y.channel = t.channel AND y.i = t.s + t.len GROUP BY t.channel, rep",
    "bin": "SELECT w.channel, w.crisis, t.rep, greatest(t.s, w.lo + o) AS a, least(t.s + t.len, w.hi + 1 + o) AS b FROM (SELECT *, unnest([0, total]) AS o FROM win) w JOIN bst t ON t.channel = w.channel AND t.s + t.len > w.lo + o AND t.s < w.hi + 1 + o",
    "bsu": "SELECT q.channel, q.crisis, q.rep, sum(q.b - q.a) AS k, sum(y.c1 - x.c1) AS s1, sum(y.c2 - x.c2) AS s2 FROM bin q JOIN pre x ON x.channel = q.channel AND x.i = q.a JOIN pre y ON y.channel = q.channel AND y.i = q.b GROUP BY q.channel, q.crisis, q.rep",
    "bsx": "SELECT u.channel, u.crisis, u.rep, u.k, p.n AS total, u.s1, u.s2, t.t1, t.t2 FROM bsu u JOIN bto t ON t.channel = u.channel AND t.rep = u.rep JOIN pwp p ON p.channel = u.channel WHERE u.k >= 10 AND p.n - u.k >= 2",
    "bsd": f"SELECT channel, crisis, rep, {oracle.abs_d('s1', 's2', 't1', 't2', 'k', 'total')} AS d FROM bsx",
}


@query("politis_white", "SELECT channel, CAST(block AS INTEGER) AS block, saturated FROM pwb", **_POLITIS)
def _(s, d):
    return rounded(stats.block_lengths(nulls.finite(scores(s, d)), K, order="m"))


def _resampled(s, d):
    fin, win, sums = null_parts(s, d)
    blocks = stats.block_lengths(fin, K, order="m").join(fin.groupBy(*K).agg(F.max("total").alias("total")), list(K))
    return nulls.block_bootstrap(win, sums, nulls.block_starts(blocks, 2000))


@query("block_bootstrap", "SELECT channel, crisis, CAST(rep AS INTEGER) AS rep, round(d, 6) AS d FROM bsd", **_BOOTSTRAP)
def _(s, d):
    """All channels, each with its own block length."""
    return rounded(_resampled(s, d), 6)


@query(
    "bootstrap_interval",
    "SELECT channel, round(quantile_cont(med, 0.025), 6) AS lo, round(quantile_cont(med, 0.975), 6) AS hi, round(avg(kept), 6) AS kept_mean, min(kept) AS kept_min, round(avg(CAST(kept < 6 AS INT)), 6) AS dropped_share FROM (SELECT channel, rep, median(d) AS med, count(d) AS kept FROM bsd GROUP BY channel, rep) GROUP BY channel",
    **_BOOTSTRAP,
)
def _(s, d):
    return rounded(nulls.bootstrap_interval(_resampled(s, d), len(registry.SAMPLE)), 6)


def _embedded(s, d):
    return study(s, d).embedded(causal=False)


@query("pca_embedding")
def _(s, d):
    return _embedded(s, d).select("ts", "pos", "x")


def _state_query(name: str, *columns: str) -> None:
    def run(s, d):
        return channels.state_rows(_embedded(s, d), study(s, d).ops).select("pos", *columns)

    query(name)(run)


for _n, _c in (("spectral_entropy", ("spectral_entropy",)), ("reduced_purity", ("reduced_purity",)), ("ground_energy", ("ground_energy",)), ("qfi_logdet", ("qfi_logdet",)), ("qcrb", ("cramer_rao",)), ("curvature_bound", ("curvature", "curvature_bound"))):
    _state_query(_n, *_c)


@query("berry_rate")
def _(s, d):
    st = channels.state_rows(_embedded(s, d), study(s, d).ops)
    return series.step_change(st, "curvature", "berry_rate").select("pos", "berry_rate")


@query("metric_identity")
def _(s, d):
    return channels.metric_check(_embedded(s, d), study(s, d).ops)


def _raw(s, d):
    st = study(s, d)
    return channels.raw_channels(st.embedded(causal=False), st.ops)


for _n in ("sld_qfi", "frobenius_rho", "population_fisher", "bures", "mmd"):
    query(f"channel_{_n}")(lambda s, d, c=_n: _raw(s, d).select("pos", c))


@query("hmm_posterior")
def _(s, d):
    return channels.regime_posterior(features(s, d).select("series_id", "pos", F.col("f_ret").alias("ret"), (F.col("ts") < F.lit("1998-01-01").cast("date")).alias("fit")))


@query("embedding_states")
def _(s, d):
    """All components of the embeddings, with a matrix for each."""
    return channels.state_rows(prices.embedding_rows(s, d), kernels.hermitian_family(64, 8)).select("pos", "spectral_entropy", "reduced_purity", "ground_energy")


@query("fit_divergence")
def _(s, d):
    return _two_fits(s, d, study(s, d).names).drop("series_id")


def _two_fits(s, d, names):
    f = features(s, d).withColumn("crisis", F.lit("all"))
    return fit.divergence(fit.fitted(f, names), fit.fitted(f.where("ts < date '2000-01-01'"), names), names)


_PAIR = ("f_vol20", "o_vol20")
_FIT2 = {
    f"ft{n}": "SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_PAIR)) + f", corr({_PAIR[0]}, {_PAIR[1]}) AS r FROM feat{where}"
    for n, where in (("w", ""), ("p", " WHERE ts < DATE '2000-01-01'"))
}
for _n in "wp":
    _FIT2[f"y{_n}"] = f"SELECT pos, (z0 + z1) / sqrt(2) AS plus, (z0 - z1) / sqrt(2) AS minus, r FROM (SELECT pos, ({_PAIR[0]} - m0) / s0 AS z0, ({_PAIR[1]} - m1) / s1 AS z1, r FROM feat, ft{_n})"
    _FIT2[f"x{_n}"] = f"SELECT pos, CASE WHEN r > 0 THEN plus ELSE minus END / sqrt(plus * plus + minus * minus) AS x0, CASE WHEN r > 0 THEN minus ELSE plus END / sqrt(plus * plus + minus * minus) AS x1 FROM y{_n}"


@query("principal_scores_two", "SELECT pos, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM xw", **_FIT2)
def _(s, d):
    """Unit vectors of the principal scores of two features, whose axes SQL knows beforehand."""
    f = features(s, d)
    x = fit.embedded(f, _PAIR, fit.fitted(f.withColumn("crisis", F.lit("all")), _PAIR))
    return rounded(x.select("pos", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1")), 6)


@query(
    "fit_divergence_two",
    " UNION ALL ".join([f"SELECT 'mean_rel' AS measure, '{c}' AS item, round(abs(p.m{i} - w.m{i}) / abs(w.m{i}), 6) AS value FROM ftw w, ftp p UNION ALL SELECT 'scale_rel', '{c}', round(abs(p.s{i} - w.s{i}) / w.s{i}, 6) FROM ftw w, ftp p" for i, c in enumerate(_PAIR)])
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 'axis_cos', 'axis {i}', CASE WHEN sign(w.r) = sign(p.r) THEN 1.0::DOUBLE ELSE 0.0 END FROM ftw w, ftp p" for i in (0, 1)),
    **_FIT2,
)
def _(s, d):
    return rounded(_two_fits(s, d, _PAIR), 6)


@query(
    "fit_divergence_summary",
    "SELECT measure, round(max(value), 6) AS largest, round(median(value), 6) AS middle, round(avg(value), 6) AS mean, CAST(count(*) FILTER (CASE WHEN measure = 'axis_cos' THEN 1 - value ELSE value END > 0.1) AS BIGINT) AS over FROM dvg GROUP BY measure",
    dvg=" UNION ALL ".join([f"SELECT 'mean_rel' AS measure, abs(p.m{i} - w.m{i}) / abs(w.m{i}) AS value FROM ftw w, ftp p UNION ALL SELECT 'scale_rel', abs(p.s{i} - w.s{i}) / w.s{i} FROM ftw w, ftp p UNION ALL SELECT 'axis_cos', CASE WHEN sign(w.r) = sign(p.r) THEN 1.0 ELSE 0.0 END FROM ftw w, ftp p" for i in (0, 1)]),
    **_FIT2,
)
def _(s, d):
    return rounded(fit.divergence_summary(_two_fits(s, d, _PAIR)), 6)


@query("row_cosines_two", "SELECT round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS least_cosine, round(avg(CAST(c < 0.99 AS INT)), 6) AS share_below_99 FROM cos2", **_FIT2, cos2="SELECT a.x0 * b.x0 + a.x1 * b.x1 AS c FROM xw a JOIN xp b ON b.pos = a.pos")
def _(s, d):
    f = features(s, d)
    both = [fit.embedded(f, _PAIR, fit.fitted(rows.withColumn("crisis", F.lit("all")), _PAIR)) for rows in (f, f.where("ts < date '2000-01-01'"))]
    return rounded(fit.row_cosines(*both), 6)


#: Two Pauli matrices: H(x) = (1 + |x|^2 / 2) - x1 X - x2 Z, whose ground state points along x.
_PAULI = np.array([[[0, 1], [1, 0]], [[1, 0], [0, -1]]], complex)


def _pauli_rows(s, d):
    return features(s, d).select(F.lit("all").alias("crisis"), "series_id", "ts", "pos", F.array(100 * F.col("f_ret") + 0.1, 100 * F.col("o_ret") - 0.2).alias("x"), F.col("f_ret").alias("ret"), F.lit(True).alias("fit"))


_LEVELS = {
    "lx": "SELECT pos, 100 * f_ret + 0.1 AS a, 100 * o_ret - 0.2 AS b FROM feat",
    "ln2": "SELECT *, sqrt(a * a + b * b) AS r, a / sqrt(a * a + b * b) AS na, b / sqrt(a * a + b * b) AS nb FROM lx",
    "lm": "SELECT *, avg(na) OVER w AS ra, avg(nb) OVER w AS rb, lag(na, 20) OVER o AS oa, lag(nb, 20) OVER o AS ob FROM ln2 WINDOW o AS (ORDER BY pos), w AS (ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "lp": "SELECT *, lag(ra) OVER (ORDER BY pos) AS qa, lag(rb) OVER (ORDER BY pos) AS qb, sqrt(ra * ra + rb * rb) AS len, sqrt(pow(lag(ra) OVER (ORDER BY pos), 2) + pow(lag(rb) OVER (ORDER BY pos), 2)) AS old FROM lm",
    "lw": "SELECT t.pos, w.a, w.b, avg(w.a) OVER p AS ma, avg(w.b) OVER p AS mb FROM lx t JOIN lx w ON w.pos BETWEEN t.pos - 19 AND t.pos WHERE t.pos >= 19 WINDOW p AS (PARTITION BY t.pos)",
    "lc": "SELECT pos, any_value(ma) AS ma, any_value(mb) AS mb, avg((a - ma) * (a - ma)) AS saa, avg((b - mb) * (b - mb)) AS sbb, avg((a - ma) * (b - mb)) AS sab, avg(pow((a - ma) * (a - ma) + (b - mb) * (b - mb), 2)) AS fourth FROM lw GROUP BY pos",
    "ls": "SELECT *, (saa + sbb) / 2 AS mu, saa * saa + sbb * sbb + 2 * sab * sab AS norm FROM lc",
    "lk": "SELECT *, CASE WHEN norm - 2 * mu * mu > 0 THEN least(greatest((fourth - norm) / 20, 0), norm - 2 * mu * mu) / (norm - 2 * mu * mu) ELSE 0 END AS k FROM ls",
    "lg": "SELECT pos, ma, mb, (1 - k) * saa + k * mu AS saa, (1 - k) * sbb + k * mu AS sbb, (1 - k) * sab AS sab FROM lk",
    "lb": "SELECT x.pos, sqrt(greatest(pow(x.ma - y.ma, 2) + pow(x.mb - y.mb, 2) + x.saa + x.sbb + y.saa + y.sbb - 2 * sqrt(x.saa * y.saa + x.sbb * y.sbb + 2 * x.sab * y.sab + 2 * sqrt(greatest(x.saa * x.sbb - x.sab * x.sab, 0) * greatest(y.saa * y.sbb - y.sab * y.sab, 0))), 0)) AS bures FROM lg x JOIN lg y ON y.pos = x.pos - 1",
}
_SAME = "ra * qa + rb * qb >= 0"


@query(
    "two_level_channels",
    "SELECT lp.pos, round(0.0::DOUBLE, 6) AS spectral_entropy, round(1.0::DOUBLE, 6) AS reduced_purity, round(1 + r * r / 2 - r, 6) AS ground_energy, round(-2 * ln(r), 6) AS qfi_logdet, "
    "CASE WHEN lp.pos >= 20 THEN round(sqrt(greatest(1 - na * oa - nb * ob, 0)) / 20, 6) END AS frobenius_rho, "
    "CASE WHEN lp.pos >= 20 THEN round(pow((na - oa) / 20, 2) + pow((nb - ob) / 20, 2) + pow(ra * (na - oa) / 20 + rb * (nb - ob) / 20, 2) / (1 - len * len), 6) END AS sld_qfi, "
    f"CASE WHEN lp.pos >= 20 THEN round(pow(CASE WHEN {_SAME} THEN len ELSE -len END - old, 2) * (2 / (2 + CASE WHEN {_SAME} THEN len ELSE -len END + old) + 2 / (2 - CASE WHEN {_SAME} THEN len ELSE -len END - old)), 6) END AS population_fisher, "
    "round(bures, 6) AS bures FROM lp LEFT JOIN lb ON lb.pos = lp.pos",
    **_LEVELS,
)
def _(s, d):
    """The channels of a two-level system, against the geometry of its sphere in SQL."""
    raw = channels.raw_channels(_pauli_rows(s, d), _PAULI)
    names = ("spectral_entropy", "reduced_purity", "ground_energy", "qfi_logdet", "frobenius_rho", "sld_qfi", "population_fisher", "bures")
    return rounded(raw.select("pos", *[(F.nanvl(F.col(c), F.lit(None).cast("double")) + F.lit(0.0)).alias(c) for c in names]), 6)


@query("two_level_states", "SELECT pos, round(0.25 / (r * r), 5) AS metric_trace, round(2 * (1 + abs(a)) * (1 + abs(b)) / (4 * r * r), 5) AS curvature_bound, round(b * b, 6) AS bound_1, round(a * a, 6) AS bound_2 FROM ln2", **_LEVELS)
def _(s, d):
    """Metric, curvature bound and least variances of the same system."""
    rows = channels.state_rows(_pauli_rows(s, d), _PAULI)
    return rounded(rows.select("pos", F.round("metric_trace", 5).alias("metric_trace"), F.round("curvature_bound", 5).alias("curvature_bound"), F.get("cramer_rao", F.lit(0)).alias("bound_1"), F.get("cramer_rao", F.lit(1)).alias("bound_2")), 6)


@query("causal_panel")
def _(s, d):
    """All channels under every past-only fit, scored."""
    return study(s, d).panel().select("crisis", "channel", "pos", "z")


@query("causal_effect_sizes")
def _(s, d):
    st = study(s, d)
    return reports.effect_sizes(st, st.panel())


@query("row_cosines")
def _(s, d):
    st = study(s, d)
    return fit.row_cosines(st.embedded(False), st.embedded(True).where("crisis = '2000 Spring'"))


@query("series_correlation")
def _(s, d):
    return reports.series_correlation(study(s, d))


@query("panel_nulls")
def _(s, d):
    return reports.panel_study(study(s, d))["panel_nulls"]


@query("panel_intervals")
def _(s, d):
    return reports.panel_study(study(s, d))["intervals"]


@query("regime_audit")
def _(s, d):
    return reports.regime_audit(study(s, d))


_ERA = "CASE WHEN year(ts) < 1997 THEN '1995-1996' WHEN year(ts) < 1999 THEN '1997-1998' WHEN year(ts) < 2001 THEN '1999-2000' ELSE '2001-2002' END"


@query("era_alarm_table", "SELECT channel, " + ", ".join(f"round(count(*) FILTER (upcross AND {_ERA} = '{e}') / nullif(count(*) FILTER ({_ERA} = '{e}') / 252.0, 0), 6) AS \"{e}\"" for e in ("1995-1996", "1997-1998", "1999-2000", "2001-2002")) + " FROM upx WHERE forward AND NOT in_any GROUP BY channel")
def _(s, d):
    return rounded(reports.alarm_study(study(s, d), scores(s, d))["eras"], 6)


@query("effect_size_table", "SELECT crisis AS event, channel, count(z) FILTER (i) AS n_inside, count(z) FILTER (NOT i) AS n_outside, round((avg(z) FILTER (i) - avg(z) FILTER (NOT i)) / sqrt((var_samp(z) FILTER (i) * (count(z) FILTER (i) - 1) + var_samp(z) FILTER (NOT i) * (count(z) FILTER (NOT i) - 1)) / (count(z) - 2)), 6) AS d, round(abs((avg(z) FILTER (i) - avg(z) FILTER (NOT i)) / sqrt((var_samp(z) FILTER (i) * (count(z) FILTER (i) - 1) + var_samp(z) FILTER (NOT i) * (count(z) FILTER (NOT i) - 1)) / (count(z) - 2))), 6) AS abs_d FROM (SELECT zs.*, span.crisis, pos BETWEEN lo AND hi AS i FROM zs, span) GROUP BY crisis, channel HAVING count(z) FILTER (i) >= 2")
def _(s, d):
    """The table of effects of the controls, under a single fit and under each event's own; both are alike, so one of each is kept."""
    st, z = study(s, d), scores(s, d)
    own = reports.effect_sizes(st, z.join(spans(s, d).select("series_id", "crisis"), "series_id").select(*z.columns, "crisis"))
    return rounded(reports.effect_sizes(st, z.withColumn("crisis", F.lit("all"))).where("d is not null").unionByName(own.where("d is not null")).select("event", "channel", "n_inside", "n_outside", F.round("d", 6).alias("d"), F.round("abs_d", 6).alias("abs_d")).distinct(), 6)


@query("visible_events", "SELECT crisis, max(coalesce(d, 0)) >= 0.2 AS visible FROM real GROUP BY crisis")
def _(s, d):
    _, win, sums = null_parts(s, d)
    return rounded(reports.visible(nulls.real_windows(win, sums)))


@query("date_mask", "SELECT ts, ts IN (SELECT ts FROM mem WHERE crisis LIKE '1998%') AS inside FROM feat")
def _(s, d):
    return rounded(events.membership(calendar(s, d), members(s, d).where("crisis like '1998%'"), "inside").select("ts", "inside"))


@query("step_change", "SELECT pos, round(abs(xcorr20 - lag(xcorr20) OVER (ORDER BY pos)), 7) AS step FROM feat")
def _(s, d):
    return rounded(series.step_change(feature_rows(s, d), "xcorr20", "step").select("pos", "step"))


@query("snapshot_round_trip", f"SELECT ts, {_round('f', 'o')} FROM px2 WHERE ts >= DATE '1997-01-01' AND ts < DATE '1999-01-01'")
def _(s, d):
    """The panel saved as a CSV snapshot and loaded again between two days, the second left out."""
    path = f"{shared_dir(s)}/tables/snapshot-{uuid.uuid4().hex}.csv"
    load = lambda: prices.load_prices(s, path, ["f", "o"], "1997-01-01", "1999-01-01", fetch=lambda: px2(s, d).select(F.col("ts").alias("Date"), "f", "o"))
    return rounded(load())


@query("channel_correlations")
def _(s, d):
    return reports.channel_correlations(study(s, d))


@query("offline_event_study")
def _(s, d):
    return reports.offline_event_study(s, d)


_VOL = lambda a, lr: f"CASE WHEN count({a}_ret) OVER w20 = 20 THEN stddev_samp({a}_ret) OVER w20 END AS {a}_v"
_SEEN = {
    "thr": "SELECT channel, crisis, quantile_cont(d, 0.95) AS t FROM wad GROUP BY channel, crisis",
    "cnt": "SELECT q.channel, q.draw_id, count(*) FILTER (q.d > t.t) AS d FROM wad q JOIN thr t ON t.channel = q.channel AND t.crisis = q.crisis GROUP BY q.channel, q.draw_id",
    "see": "SELECT r.channel, r.crisis FROM real r JOIN thr t ON t.channel = r.channel AND t.crisis = r.crisis WHERE r.d > t.t",
}


@query(
    "panel_visibility",
    "SELECT channel, real AS count, which, round(avg(d), 6) AS null_mean, round(quantile_cont(CAST(d AS DOUBLE), 0.95), 6) AS null_95, round((1 + count(*) FILTER (d >= real)) / (1 + count(*)), 6) AS p FROM (SELECT n.channel, n.d, r.real, r.which FROM cnt n JOIN rcn r ON r.channel = n.channel) GROUP BY channel, real, which",
    vol2=f"SELECT ts, {_VOL('f', 2)}, {_VOL('o', 2)} FROM lr2 {oracle.frames(20)}",
    cv=" UNION ALL ".join(f"SELECT '{a}' AS channel, feat.pos, feat.ts, {a}_v AS value FROM feat JOIN vol2 ON vol2.ts = feat.ts" for a in "fo"),
    **_SEEN, rcn="SELECT c.channel, count(s.crisis) AS real, coalesce(string_agg(s.crisis, ',' ORDER BY s.crisis), '') AS which FROM (SELECT DISTINCT channel FROM cnt) c LEFT JOIN see s ON s.channel = c.channel GROUP BY c.channel",
)
def _(s, d):
    st = study(s, d)
    return rounded(reports.visibility(st, reports.asset_volatility(st))["by_asset"].withColumn("which", F.array_join("which", ",")), 6)


_MULTI = {
    "mf": "SELECT lr3.ts, " + ", ".join(_VOL(a, 3) for a in "anr") + ", ar3.ar FROM lr3 JOIN ar3 ON ar3.ts = lr3.ts WINDOW w20 AS (ORDER BY lr3.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "feat": "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM mf WHERE a_v IS NOT NULL AND ar IS NOT NULL",
    "cv": " UNION ALL ".join(f"SELECT '{a}' AS channel, feat.pos, feat.ts, {a}_v AS value FROM feat JOIN mf ON mf.ts = feat.ts" for a in "anr"),
}


@query("multi_asset_visibility", "SELECT crisis, string_agg(channel, ',' ORDER BY channel) AS assets, bool_and(channel <> 'a') AS added FROM see GROUP BY crisis", **_MULTI, **_SEEN)
def _(s, d):
    """Events that some of three assets shows, and whether the first does not."""
    st = reports.Study(written(prices.three_asset_panel(s, d), "panel"), "anr", registry.SAMPLE)
    out = reports.visibility(st, reports.asset_volatility(st))
    return rounded(out["union"].join(out["added"].select("series_id", "crisis", F.lit(True).alias("added")), ["series_id", "crisis"], "left").select("crisis", F.array_join("assets", ",").alias("assets"), F.coalesce("added", F.lit(False)).alias("added")))


@query("synthetic_prices")
def _(s, d):
    return prices.synthetic_prices(s)


@query("synthetic_on_calendar")
def _(s, d):
    days = np.arange("1995-01-02", "1997-01-02", dtype="datetime64[D]")
    return prices.synthetic_on_calendar(s, days, (days >= np.datetime64("1996-03-01")) & (days < np.datetime64("1996-05-01")))


@query("synthetic_demo")
def _(s, d):
    return reports.synthetic_demo(s)


@query("magnitude_sweep")
def _(s, d):
    days = np.arange("1995-01-02", "1998-01-02", dtype="datetime64[D]")
    mask = (np.arange(len(days)) >= 600) & (np.arange(len(days)) < 660)
    return reports.magnitude_sweep(s, days, mask, 0.10)
