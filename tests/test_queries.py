"""Every query against its SQL, and what the others must satisfy."""

import hashlib

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tidemark import queries as q
from tidemark.functions import kernels
from tidemark.operators import alarms, channels, events, fit, nulls, series, stats
from tidemark.plans import reports
from tidemark.sources import prices, registry

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, name):
    assert_same(spark, TINY, q.QUERIES[name], q.SQL[name])


@pytest.mark.parametrize("name", ["chance_floor", "trend_matched_pool", "null_model"])
def test_against_sql_larger(spark, name):
    assert_same(spark, SMALL, q.QUERIES[name], q.SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and all(r["abs_d"] is None or r["abs_d"] >= 0 for r in rows)


def test_synthetic_panel_and_demo(spark):
    p = prices.synthetic_prices(spark, 400, (200, 260)).toPandas()
    assert list(p.columns) == ["series_id", "ts", "SPY", "DIA", "in_event"] and p["in_event"].sum() == 60
    assert p[["SPY", "DIA"]].gt(0).all().all()
    r = np.log(p["SPY"]).diff()
    assert r[200:260].std() > 2 * r[:200].std()
    d = {x["channel"]: x["abs_d"] for x in reports.synthetic_demo(spark, 600, (300, 380)).collect()}
    assert d["hmm_high_var"] > 0.5 and set(d) == {"spectral_entropy", "reduced_purity", "hmm_high_var"}
    assert prices.distributed_synthetic(spark, 50, 3).groupBy("series_id").count().count() == 3


def test_short_history_is_not_usable(spark):
    c = q.QUERIES["crisis_context"](spark, TINY).toPandas().set_index("crisis")
    assert not c.loc["1996 Spring", "usable"] and c["usable"].sum() == 5
    assert (c["cutoff"] < c["start"]).all()


def test_business_days(spark):
    days = [("2020-01-17", 1), ("2020-01-18", 1), ("2020-01-19", 1), ("2020-01-20", 1), ("2020-01-22", 10), ("2020-01-18", 10)]
    df = spark.createDataFrame([(d,) for d, _ in days], "d string").select(F.to_date("d").alias("d"))
    for n in (1, 3, 10):
        for r in df.select("d", events.business_days_before(F.col("d"), n).alias("b")).collect():
            assert r["b"] == np.busday_offset(np.datetime64(r["d"]), -n, roll="forward").item()


def test_registry():
    assert registry.get("2020 COVID")[1] == "2020-02" and registry.first(registry.DEFAULT)[0] == "2007 Quant Meltdown"
    with pytest.raises(KeyError):
        registry.get("no such")


def test_loader(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,A,B\n2020-01-01,1.0,2.0\n2020-01-02,,3.0\n2020-01-03,2.0,4.0\n")
    p = prices.load_prices(spark, str(tmp_path / "p.csv"), ["A", "B"], end="2020-01-03")
    assert [(r["A"], r["B"]) for r in p.collect()] == [(1.0, 2.0)]
    with pytest.raises(KeyError):
        prices.load_prices(spark, str(tmp_path / "p.csv"), ["A", "C"])
    made = []

    def fetch():
        made.append(1)
        return spark.createDataFrame([("2020-01-01", 5.0)], "Date string, A double").withColumn("Date", F.to_date("Date"))

    for refresh, calls in ((False, 1), (False, 1), (True, 2)):
        assert prices.load_prices(spark, str(tmp_path / "s.parquet"), ["A"], fetch=fetch, refresh=refresh).count() == 1 and len(made) == calls
    assert len(prices.snapshot_digest(spark, str(tmp_path / "p.csv")).first()["sha256"]) == 64


def test_feature_checks(spark):
    with pytest.raises(ValueError):
        series.two_asset_features(prices.three_asset_panel(spark, TINY), "anr")
    with pytest.raises(KeyError):
        series.aligned_mean_correlation(q._three(spark, TINY), "anr", {"a": 1})
    with pytest.raises(ValueError):
        series.multi_asset_features(prices.three_asset_panel(spark, TINY), "anr", "median")


def test_effect_size_edges(spark):
    rows = [("a", 1.0, True), ("a", 1.0, True), ("a", 1.0, False), ("a", 1.0, False), ("b", 1.0, True), ("b", 2.0, False), ("b", 3.0, False), ("c", None, True)]
    d = {r["k"]: r["d"] for r in stats.cohens_d(spark.createDataFrame(rows, "k string, z double, inside boolean"), ("k",)).collect()}
    assert d == {"a": 0.0, "b": None, "c": None}


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    got = stats.benjamini_hochberg(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")).orderBy("i").toPandas()["q"]
    assert np.allclose(got, [0.02, 0.04, 0.04, 0.02])


def test_fit_matches_numpy(spark):
    f = q.features(spark, SMALL)
    names = q.FEATURES
    got = fit.fitted(f.withColumn("crisis", F.lit("all")), names).first()
    x = f.select(*names).toPandas().to_numpy()
    assert np.allclose(got["mean"], x.mean(0)) and np.allclose(got["scale"], x.std(0))
    axes = np.array(got["axes"])
    assert np.allclose(axes @ axes.T, np.eye(8), atol=1e-8) and (axes[np.arange(8), np.abs(axes).argmax(1)] > 0).all()
    rows = fit.embedded(f, names, fit.fitted(f.withColumn("crisis", F.lit("all")), names)).select("x").limit(20).collect()
    assert np.allclose([np.linalg.norm(r["x"]) for r in rows], 1)


def test_channels_and_identities(spark):
    m = q.QUERIES["metric_identity"](spark, TINY).toPandas()
    assert (m["metric_gap"] < 1e-3).all() and (m["pure_gap"] < 1e-3).all() and (m["least_eigenvalue"] > -1e-10).all()
    c = q.QUERIES["curvature_bound"](spark, TINY).toPandas()
    assert (c["curvature"].abs() <= 1.05 * c["curvature_bound"]).all()
    raw = q._raw(spark, TINY).toPandas().sort_values("pos")
    assert raw["sld_qfi"][:20].isna().all() and raw["sld_qfi"][20:].notna().all()
    assert set(channels.ALL) <= set(raw.columns)


def test_sampled_windows_are_candidates(spark):
    _, win, sums = q.null_parts(spark, TINY)
    some = nulls.window_draws(win, sums, draws=50).toPandas()
    assert (some.groupby(["channel", "crisis"]).size() == 50).all()
    assert ((some["start"] + some["len"] - 1 < some["lo"]) | (some["start"] > some["hi"])).all()


def test_audit_can_fail(spark):
    rows = [(0, True, False, True), (1, True, True, False)]
    got = {r["check"]: r["result"] for r in alarms.causality_audit(spark.createDataFrame(rows, "pos long, block boolean, forward boolean, in_any boolean")).collect()}
    assert set(got.values()) == {"FAIL"}


def test_studies_run(spark):
    s = reports.study(spark, SMALL)
    out = reports.panel_study(s, draws=100)
    assert out["panel_nulls"].count() == 2 * 14
    i = out["intervals"].toPandas()
    assert len(i) == 14 and (i["lo"] <= i["hi"]).all() and (i["kept_min"] <= 5).all()
    v = out["verdicts"].toPandas()
    assert set(v["channel"]) == set(s.family)
    both = reports.causal_comparison(s)
    assert both["row_cosines"].first()["mean_cosine"] <= 1 + 1e-9


def test_series_correlation_and_eras(spark):
    r = q.QUERIES["series_correlation"](spark, TINY).toPandas()
    same = r[r["channel"].isin(reports.CONTROLS)]
    assert len(same) == 15 and np.allclose(same["r"].astype(float), 1)  # controls need no fit
    assert r["r"].dropna().abs().le(1 + 1e-9).all()
    assert set(q.QUERIES["era_alarm_table"](spark, SMALL).columns) == {"channel", "1995-1996", "1997-1998", "1999-2000", "2001-2002"}
    s = q.QUERIES["synthetic_on_calendar"](spark, TINY).toPandas()
    assert s["in_event"].sum() == 61 and s[["SPY", "DIA"]].gt(0).all().all()


def test_absorption_ratio_of_generated_returns(spark):
    rng = np.random.default_rng(1)
    common = rng.normal(size=200)
    rows = [("s", d.item(), *[float(common[t] * 0.01 + 1e-5 * rng.normal()) for _ in range(4)]) for t, d in enumerate(prices.business_days("2020-01-01", 200))]
    df = spark.createDataFrame(rows, "series_id string, ts date, a_ret double, b_ret double, c_ret double, d_ret double")
    c = series.spectral_aggregates(series.pair_correlations(df, "abcd"), "abcd").toPandas().sort_values("ts")
    assert c["absorption_ratio"][:59].isna().all() and (c["absorption_ratio"][59:] > 0.99).all()


def test_kernel_bandwidth():
    x = np.random.default_rng(0).normal(size=(50, 3))
    assert kernels.bandwidth(x) > 0 and kernels.bandwidth(np.zeros((5, 3))) == 1.0


def row_level_bootstrap(z, masks, block, reps):
    """Panel medians of resampled rows, one row at a time."""
    n, medians = len(z), []
    for rep in range(reps):
        blocks = -(-n // block)
        starts = [int(hashlib.md5(f"{rep}:{b}:42".encode()).hexdigest()[:12], 16) % n for b in range(blocks)]
        pick = np.concatenate([(s + np.arange(block if b < blocks - 1 else n - b * block)) % n for b, s in enumerate(starts)])
        d = []
        for m in masks:
            x, y = z[pick][m[pick]], z[pick][~m[pick]]
            if len(x) >= 10 and len(y) >= 2:
                d.append(abs(x.mean() - y.mean()) / np.sqrt((x.var() * len(x) + y.var() * len(y)) / (n - 2)))
        if d:
            medians.append(np.median(d))
    return np.percentile(medians, [2.5, 97.5])


def test_bootstrap_interval_by_rows(spark):
    got = q.QUERIES["bootstrap_interval"](spark, SMALL).toPandas().set_index("channel")
    assert set(got.index) == set(reports.CONTROLS)
    fin = nulls.finite(q.scores(spark, SMALL)).toPandas()
    inside = q.members(spark, SMALL).toPandas().groupby("crisis")["pos"].apply(set)
    rows = fin[fin["channel"] == "drawdown"].sort_values("m")
    z = rows["z"].to_numpy()
    want = row_level_bootstrap(z, [rows["pos"].isin(p).to_numpy() for p in inside], kernels.block_length(z)[0], 2000)
    assert np.allclose(got.loc["drawdown", ["lo", "hi"]].astype(float), want, atol=1e-6)


def two_series(spark):
    """Two series of 50 rows with different scores; an event on rows 10 to 14 of the first and 20 to 23 of the second."""
    rng = np.random.default_rng(4)
    z = {s: rng.normal(size=50) for s in ("one", "two")}
    rows = [(s, "c", i, float(v)) for s, x in z.items() for i, v in enumerate(x)]
    spans = [("one", "e", 10, 14), ("two", "e", 20, 23)]
    return z, spark.createDataFrame(rows, "series_id string, channel string, pos long, z double"), spark.createDataFrame(spans, "series_id string, crisis string, lo long, hi long")


def plain_d(z, inside):
    x, y = z[inside], z[~inside]
    return abs(x.mean() - y.mean()) / np.sqrt((x.var() * len(x) + y.var() * len(y)) / (len(z) - 2))


def test_series_are_kept_apart_in_nulls(spark):
    z, rows, spans = two_series(spark)
    fin = nulls.finite(rows)
    win, sums = nulls.windows(fin, spans), nulls.prefix_sums(fin)
    got = {(r["series_id"], r["lo"], r["hi"], r["len"], r["total"]) for r in win.collect()}
    assert got == {("one", 10, 14, 5, 50), ("two", 20, 23, 4, 50)}
    masks = {"one": (np.arange(50) >= 10) & (np.arange(50) <= 14), "two": (np.arange(50) >= 20) & (np.arange(50) <= 23)}
    for r in nulls.real_windows(win, sums).collect():
        assert abs(r["real"] - plain_d(z[r["series_id"]], masks[r["series_id"]])) < 1e-9
    shifts = nulls.shift_draws(win, sums).collect()
    assert len(shifts) == 98
    for r in shifts:
        assert abs(r["d"] - plain_d(np.roll(z[r["series_id"]], r["draw_id"]), masks[r["series_id"]])) < 1e-9
    summed = nulls.summary(nulls.window_draws(win, sums, draws=30), nulls.real_windows(win, sums)).collect()
    assert {(r["series_id"], r["draws"]) for r in summed} == {("one", 30), ("two", 30)}
    counts = nulls.count_statistic(nulls.shift_draws(win, sums), nulls.real_windows(win, sums)).collect()
    assert len(counts) == 2
    lost = nulls.lost_windows(fin, win, spans.unionByName(spark.createDataFrame([("two", "gone", 90, 95)], spans.schema))).collect()
    assert [tuple(r) for r in lost] == [("two", "c", "gone")]
    starts = nulls.block_starts(win.select("series_id", "channel", "total").withColumn("block", F.lit(7)), 5)
    boot = nulls.block_bootstrap(win, sums, starts, least_days=1)
    assert {r["series_id"] for r in boot.collect()} == {"one", "two"}


def test_series_are_kept_apart_in_alarms(spark):
    z, rows, spans = two_series(spark)
    taus = {r["series_id"]: r["tau"] for r in alarms.calibrated(rows).collect()}
    assert len(taus) == 2
    fired = alarms.upcrossings(rows, F.lit(0.8))
    found = {r["series_id"]: r for r in alarms.detection(fired, spans).collect()}
    event = {"one": range(10, 15), "two": range(20, 24)}
    counts = {}
    for r in alarms.chance_counts(fired, spans).collect():
        counts.setdefault(r["series_id"], {})[r["shift"]] = r["hits"]
    for s, x in z.items():
        hit = [i for i in event[s] if x[i] > 0.8]
        assert found[s]["detected"] == bool(hit) and found[s]["delay"] == (hit[0] - event[s][0] if hit else None)
        assert counts[s] == {k: int(any(x[(i - k) % 50] > 0.8 for i in event[s])) for k in range(1, 50)}
        crossings = [i for i in range(50) if x[i] > 0.8 and (i == 0 or x[i - 1] <= 0.8)]
        assert sorted(r["pos"] for r in fired.where(F.col("series_id") == s).where("upcross").collect()) == crossings


def test_series_are_kept_apart_in_fits(spark):
    rng = np.random.default_rng(6)
    x = {s: rng.normal(size=(40, 3)) * (1 + i) + i for i, s in enumerate(("one", "two"))}
    df = spark.createDataFrame([("all", s, i, *map(float, v)) for s, m in x.items() for i, v in enumerate(m)], "crisis string, series_id string, pos long, a double, b double, c double")
    params = fit.fitted(df, ["a", "b", "c"])
    for r in params.collect():
        assert np.allclose(r["mean"], x[r["series_id"]].mean(0)) and np.allclose(r["scale"], x[r["series_id"]].std(0))
    rows = fit.embedded(df.drop("crisis"), ["a", "b", "c"], params, ("series_id", "pos"))
    assert rows.count() == 80


def test_channels_do_not_depend_on_the_stretches(spark):
    st = reports.study(spark, TINY)
    rows = st.embedded(False).where("pos < 300")
    whole, parts = (channels.raw_channels(rows, st.ops, chunk=c).toPandas().sort_values("pos") for c in (1024, 64))
    for c in channels.ALL:
        assert np.allclose(whole[c].astype(float), parts[c].astype(float), equal_nan=True, atol=1e-8), c


def test_panel_reads_its_base_table_once(spark):
    rows = q.QUERIES["upcross"](spark, TINY)
    assert "lineitem" not in rows._jdf.queryExecution().toString()


def test_report_orders(spark):
    df = spark.createDataFrame([("x", 0.2, 0.3), ("y", None, 0.1), ("z", 0.1, 0.2)], "channel string, q double, abs_d double")
    assert [r["channel"] for r in reports.ordered(df, "verdict").collect()] == ["z", "x", "y"]
    assert [r["channel"] for r in reports.ordered(df, "effect").collect()] == ["x", "z", "y"]
