"""Splits, scores, models and backtests by their properties."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe.functions.special import beta_i, chi2_sf, kolmogorov_sf, t_two_sided
from tidalframe.operators import backtest, eda, gam, scores, splits, volatility
from tidalframe.operators.distribution import fit_johnson_su
from tidalframe.sources import config, readers, sinks


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(i))


def labelled(spark, n=100, horizon=1):
    return spark.createDataFrame([(i, day(i), day(i + horizon)) for i in range(n)], "row_pos long, date date, t1 date")


def test_target_shift(spark):
    df = spark.createDataFrame([("a", day(i), float(i + 1)) for i in range(20)], "key string, date date, p double")
    got = splits.forward_target(df, ["key"], "date", "p", 3).orderBy("row_pos").collect()
    assert len(got) == 17 and got[0]["y"] == 4.0 and got[0]["t1"] == day(3)
    assert splits.forward_target(df, ["key"], "date", "p", 0).count() == 20
    with pytest.raises(ValueError):
        splits.forward_target(df, ["key"], "date", "p", 1, "sqrt")


def test_purged_folds_leak_nothing(spark):
    horizon, n = 5, 100
    got = splits.purged_kfold(labelled(spark, n, horizon), n, 4, 0.03).toPandas()
    for fold, g in got.groupby("fold"):
        test, train = set(g.row_pos[g.role == "test"]), set(g.row_pos[g.role == "train"])
        assert len(test) == 25 and not test & train
        first, last = min(test), max(test)
        assert all(r + horizon < first or r > last + 3 for r in train), fold


def test_cpcv_combinations_and_paths(spark):
    got = splits.cpcv_splits(labelled(spark, 120), 120, 6, 2, 0.01)
    assert got.select("fold").distinct().count() == 15
    roles = {(r["fold"], r["role"]) for r in got.select("fold", "role").distinct().collect()}
    assert (4, "train") not in roles and (4, "test") in roles  # groups 0 and 5: one span purges all
    open_ = splits.cpcv_splits(labelled(spark, 120), 120, 6, 2, 0.01, per_span=True)
    assert open_.where("fold = 4 and role = 'train'").count() > 0
    paths = splits.cpcv_paths(spark, 6, 2).toPandas()
    assert splits.paths_count(6, 2) == 5 and (paths.groupby("path").grp.nunique() == 6).all() and paths.path.nunique() == 5


def test_plans_and_bootstrap():
    assert splits.fold_bounds(10, 3) == [(0, 3), (4, 6), (7, 9)]
    assert splits.walk_forward_plan(300, 0.6, 21, 21)[0] == (0, 252, 273)
    idx = splits.stationary_bootstrap(50, 5.0)
    assert len(idx) == 50 and idx.min() >= 0 and idx.max() < 50 and (np.diff(idx) == 1).mean() > 0.6


def test_special_functions():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert chi2_sf(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert beta_i(2, 3, 0.4) == pytest.approx(0.5248)
    assert kolmogorov_sf(1.3581) == pytest.approx(0.05, abs=1e-3)


def test_diebold_mariano_sign_and_null(spark):
    r = np.random.default_rng(0)
    a, b = np.abs(r.normal(0, 1, 400)), np.abs(r.normal(0, 2, 400))
    df = spark.createDataFrame([("k", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "k string, i int, a double, b double")
    got = scores.diebold_mariano(df, ["k"], "i", "a", "b").first()
    assert got["dm"] < -5 and scores.dm_p_value(got["dm"], got["n"]) < 1e-4
    assert scores.diebold_mariano(df, ["k"], "i", "a", "a").first()["dm"] is None
    assert scores.diebold_mariano(df.limit(5), ["k"], "i", "a", "b").first()["dm"] is None


def test_berkowitz_accepts_normal_and_rejects_shift(spark):
    z = np.random.default_rng(7).normal(size=400)
    z = (z - z.mean()) / z.std()
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(z)], "i int, z double")
    lr, p = scores.berkowitz_moments(df, "i", "z")
    assert p > 0.01 and lr == pytest.approx(scores.berkowitz(z)[0], abs=1e-3)
    assert scores.berkowitz(z * 1.5 + 1)[1] < 1e-6


def test_pbo_of_noise_and_skill(spark):
    r = np.random.default_rng(11)
    m = r.normal(size=(480, 8))
    rows = lambda x: spark.createDataFrame([(j, i, float(x[i, j])) for i in range(480) for j in range(8)], "s int, row int, r double")
    m[:, 3] += 0.5
    assert scores.pbo_cscv(rows(m), "s", "row", "r", 480, 8).first()["pbo"] < 0.2


def test_losses_and_strategies_are_whole(spark, monkeypatch):
    from tidalframe.plans import model_queries

    series = spark.range(6000).select(F.lit("ALL").alias("key"), F.expr("date_add(date '1990-01-01', int(id))").alias("date"), F.lit(0.0).alias("y"), *[F.col("id").cast("double").alias(c) for c in ("anchor", "fast", "slow")])
    monkeypatch.setattr(model_queries, "forecasts", lambda *_: series)
    losses = model_queries._losses(spark, "").orderBy("at").collect()
    assert len(losses) == 6000 and tuple(losses[-1]) == (5999, 5999.0, 5999.0, 5999.0)
    # the last of 1,100 strategies is the best in and out of every sample
    made = spark.range(1100 * 12).select(F.format_string("k%04d", F.floor(F.col("id") / 12)).alias("key"), F.expr("date_add(date '2020-01-01', int(id % 12))").alias("date"), (F.sin("id") + F.when(F.col("id") >= 1099 * 12, 50.0).otherwise(0.0)).alias("r"))
    monkeypatch.setattr(model_queries, "trades", lambda *_: made)
    got = model_queries.pbo_cscv(spark, "").first()
    assert got["pbo"] == 0 and got["mean_logit"] == pytest.approx(math.log(1100)) and got["splits"] == 20


def test_confidence_set_and_spa():
    r = np.random.default_rng(13)
    good, bad = np.abs(r.normal(0, 1, 400)), np.abs(r.normal(0, 2.5, 400))
    kept, _ = scores.model_confidence_set(np.stack([good, bad], 1), reps=200)
    assert kept == [0]
    assert scores.superior_predictive_ability(bad, good[:, None], 200)["consistent"] < 0.05
    assert scores.superior_predictive_ability(good, bad[:, None], 200)["consistent"] > 0.5


def test_calibration_and_conformal(spark):
    z = np.random.default_rng(0).normal(size=4000)
    df = spark.createDataFrame([("k", float(x), 0.0, 0.5) for x in z], "k string, y double, mu double, s double")
    assert scores.sigma_scale(df, ["k"], "y", "mu", "s").first()["scale"] == pytest.approx(2.0, abs=0.1)
    assert scores.conformal_quantile(df, ["k"], "y", "mu", "s").first()["q"] == pytest.approx(3.92, abs=0.2)


def test_ewma_is_causal_and_garch_tracks(spark):
    r = np.random.default_rng(3)
    v, x = 1.0, []
    true = []
    for _ in range(1500):
        true.append(math.sqrt(v))
        e = r.normal() * math.sqrt(v)
        x.append(e / 100)
        v = 0.05 + 0.10 * e * e + 0.85 * v
    df = spark.createDataFrame([("k", i, float(e)) for i, e in enumerate(x)], "k string, i int, r double")
    g = volatility.conditional_sigma(df, ["k"], "i", "r", "garch").toPandas().sort_values("i")
    assert np.corrcoef(g["sigma_garch"][100:], true[100:])[0, 1] > 0.4
    a = volatility.conditional_sigma(df, ["k"], "i", "r").toPandas().sort_values("i")["sigma_ewma"]
    changed = df.withColumn("r", F.when(F.col("i") == 1499, 5.0).otherwise(F.col("r")))
    b = volatility.conditional_sigma(changed, ["k"], "i", "r").toPandas().sort_values("i")["sigma_ewma"]
    assert a.tolist() == b.tolist()
    assert volatility.fit_garch(np.array(x[:50])) is None


def test_har_recovers_a_line(spark):
    r = np.random.default_rng(0)
    rv = [1.0] * 22
    for _ in range(400):
        rv.append(0.1 + 0.4 * rv[-1] + 0.3 * np.mean(rv[-5:]) + 0.2 * np.mean(rv[-22:]) + 0.01 * r.normal())
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(rv)], "k string, i int, rv double")
    assert np.allclose(volatility.har_fit(df, ["k"], "i", "rv").first()["beta"], [0.1, 0.4, 0.3, 0.2], atol=0.2)


def test_johnson_su_fit_covers():
    z = np.random.default_rng(0).normal(size=3000)
    nu, tau, loc, scale = fit_johnson_su(z)
    assert tau <= 0.8 and abs(nu) < 5 and scale > 0


def gam_rows(spark, n=1500):
    r = np.random.default_rng(0)
    a, b, c = r.uniform(-2, 2, n), r.normal(size=n), r.normal(size=n)
    y = np.sin(2 * a) + 0.5 * b + 0.1 * r.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"a": a, "usd_index": b, "noise_cpi": c, "y": y, "row_pos": np.arange(n)}))


def test_gam_fits_selects_and_serialises(spark, tmp_path):
    df = gam_rows(spark)
    m = gam.gram(df, gam.terms_for(df, ["a", "usd_index", "noise_cpi"], 10), "y")
    found = gam.fit(m)
    assert found.r2 > 0.95 and 3 < found.edof < 13 and found.bic > found.aic
    assert found.gcv == min(gam.solve(m, lam).gcv for lam in np.logspace(-3, 3, 11))
    small, keep = gam.stepwise(m, [0.1, 1, 10], "bic")
    assert 0 in keep and 1 in keep and len(keep) <= 3
    effect = gam.partial_dependence(small, "a", 50)
    assert np.corrcoef([e[1] for e in effect], np.sin(2 * np.array([e[0] for e in effect])))[0, 1] > 0.98
    sinks.write_model(spark, small, str(tmp_path / "model"))
    again = sinks.read_model(spark, str(tmp_path / "model"))
    assert np.allclose(again.beta, small.beta) and again.terms == small.terms
    low, high = (gam.predict(df, gam.expectile(df, m.terms, "y", q, 1.0), "mu").agg(F.avg((F.col("y") < F.col("mu")).cast("double"))).first()[0] for q in (0.1, 0.9))
    assert low < 0.4 < 0.6 < high
    assert gam.bagged_interval([0.0, 0.2], [1.0, 1.2], [0.5, 0.7])[0] < 0.1


def test_tensor_and_cyclic_terms():
    x = pd.DataFrame({"a": np.linspace(0, 1, 7), "b": np.linspace(0, 1, 7)})
    t = gam.Term("a", "spline", 6, other=gam.Term("b", "spline", 6))
    assert t.basis(x).shape == (7, 36) and np.allclose(t.basis(x).sum(1), 1)
    c = gam.Term("a", "cyclic", 8).basis(x)
    assert np.allclose(c[0], c[-1]) and np.allclose(c.sum(1), 1)
    assert [gam.classify(n) for n in ("is_month_end", "corr_usd_index_30", "p_sma_14", "p_lag_1", "p_log_return", "other")] == ["cyclic", "linear", "rolling", "lag", "return", "spline"]


def test_walk_forward_and_cpcv_run(spark):
    r = np.random.default_rng(0)
    n = 420
    p = 50 * np.exp(np.cumsum(r.normal(0, 0.02, n + 1)))
    rows = [(i, day(i), day(i + 1), float(math.log(p[i + 1] / p[i])), float(p[i + 1]), float(p[i]), float(r.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "row_pos long, date date, t1 date, y double, y_level double, anchor double, x double")
    path = backtest.walk_forward(df, n, [gam.Term("x", "linear", 1, -3, 3)], backtest.WalkForward(refit=63, test=63)).toPandas()
    assert len(path) == n - 252 and ((path.y_true >= path.lower_90) & (path.y_true <= path.upper_90)).mean() > 0.8
    out = backtest.cpcv_backtest(df, n, backtest.ridge_factory(), ["x"], 4, 2)
    assert out.path_metrics.count() == 3 and out.summary.first()["paths"] == 3


def heavy_path(spark, n=900):
    r = np.random.default_rng(3)
    p = 50 * np.exp(np.cumsum(0.012 * r.standard_t(4, n + 1)))
    rows = [("k", i, day(i), day(i + 1), float(math.log(p[i + 1] / p[i])), float(p[i + 1]), float(p[i]), float(r.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "key string, row_pos long, date date, t1 date, y double, y_level double, anchor double, x double")


@pytest.mark.parametrize("source", ["gam", "garch", "blend"])
def test_walk_forward_bands_cover(spark, source):
    df = heavy_path(spark)
    path = backtest.walk_forward(df, 900, [gam.Term("x", "linear", 1, -3, 3)], backtest.WalkForward(0.4, 100, 100, sigma_source=source))
    got = path.toPandas()
    assert len(got) == 900 - 360 and got.model_version.nunique() == 6
    late = got[got.model_version >= 2]  # shapes from out-of-sample residuals
    for level in (50, 80, 90, 95):
        share = ((late.y_true >= late[f"lower_{level}"]) & (late.y_true <= late[f"upper_{level}"])).mean()
        assert abs(share - level / 100) < 0.1, (source, level, share)
    found = backtest.path_scores(path)
    assert 0.9 < found["mspe_ratio"] < 1.1 and found["crps_model"] > 0 and 0 <= found["berkowitz_pvalue_model"] <= 1
    weights = backtest.weights_from_path(path)
    assert weights["rmse_combined"] <= min(weights["rmse_model"], weights["rmse_naive"]) + 1e-9
    with pytest.raises(ValueError):
        backtest.walk_forward(df, 900, [], backtest.WalkForward(sigma_source="x"))


def test_walk_forward_equals_models_fitted_one_by_one(spark):
    df = heavy_path(spark, 500)
    terms = [gam.Term("x", "spline", 8, -3, 3)]
    got = backtest.walk_forward(df, 500, terms, backtest.WalkForward(0.6, 100, 100)).toPandas().set_index("date")
    for version, start in enumerate((300, 400)):
        found = gam.fit(gam.gram(df.where(F.col("row_pos") < start), terms, "y"), [0.1, 1.0, 10.0, 100.0])
        want = gam.predict(df.where(F.col("row_pos").between(start, start + 99)), found, "mu", "sigma").toPandas().set_index("date")
        own = got[got.model_version == version].loc[want.index]
        assert np.allclose(own.y_pred_model, want.mu) and np.allclose(own.sigma_model, want.sigma)


def test_term_builder_follows_the_names(spark):
    names = ["day_of_week", "month", "day_of_year", "USD_INDEX", "p_SMA_14", "p_lag_1", "p_log_return", "crude_stocks", "other"]
    df = spark.createDataFrame([tuple(float(i + k) for k in range(len(names))) for i in range(20)], names)
    by = {t.name: t for t in gam.terms_for(df, names, monotone=True, pairs=True) if t.other is None}
    assert [(by[n].kind, by[n].size) for n in names] == [("cyclic", 7), ("cyclic", 12), ("cyclic", 30), ("linear", 1), ("spline", 25), ("spline", 20), ("spline", 15), ("spline", 20), ("spline", 20)]
    assert by["crude_stocks"].way == -1 and by["other"].way == 0 and by["USD_INDEX"].way == 0
    (pair,) = [t for t in gam.terms_for(df, names, pairs=True) if t.other]
    assert (pair.name, pair.other.name, pair.lam, pair.width) == ("USD_INDEX", "crude_stocks", 10.0, 36)
    assert gam.interactions(["vix_close", "ovx", "ovx_lag"]) == [] and gam.chosen(["a", "ovx_b"], gam.SHAPE_PARTS) == ["ovx_b"] and gam.chosen(["a"], gam.SHAPE_PARTS) == ["a"]


def test_monotone_terms_never_turn(spark):
    r = np.random.default_rng(5)
    x = r.uniform(0, 1, 800)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -x + 0.4 * np.sin(12 * x) + 0.05 * r.normal(size=800)}))
    free, held = (gam.solve(gam.gram(df, [gam.Term("x", "spline", 15, 0, 1, way=way)], "y"), 0.01) for way in (0, -1))
    effect = lambda f: np.diff([e[1] for e in gam.partial_dependence(f, "x", 200)])
    assert (effect(free) > 1e-3).any() and (effect(held) <= 1e-4).all() and held.rss < 3 * 800 * 0.3**2 and held.aicc > held.aic


def test_bags_of_one_pass_equal_separate_fits(spark):
    df = gam_rows(spark, 300)
    terms = gam.terms_for(df, ["a", "usd_index"], 8)
    ones = gam.gram_many(df.withColumn("_w", F.lit(2.0)), terms, "y", ["_w", "_w"])
    alone = gam.gram(df.withColumn("_w", F.lit(2.0)), terms, "y", "_w")
    assert all(np.allclose(m.g, alone.g) and np.allclose(m.b, alone.b) for m in ones)
    fits = gam.bagged(df, terms, "y", "row_pos", 3, 1.0)
    got = gam.bagged_predict(df, fits).toPandas()
    assert ((got.mu_low < got.mu) & (got.mu < got.mu_high)).all() and len({f.rss for f in fits}) == 3


def test_ranked_features_are_even(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"p_log_return": np.append(r.standard_t(2, 999), 1e9), "other": r.normal(size=1000)}))
    knots = gam.rank_knots(df, ["p_log_return", "other"])
    got = gam.ranked(df, knots).toPandas()
    assert list(knots) == ["p_log_return"] and got.p_log_return.between(0, 1).all() and abs(got.p_log_return.std() - 12**-0.5) < 0.01


def test_series_lags_and_overrides(spark):
    rows = [("unemployment", dt.date(2026, 4, 1), 3.9), ("fed_funds", dt.date(2026, 4, 1), 5.25), ("of_our_own", dt.date(2026, 4, 1), 1.0)]
    from tidalframe.operators import asof

    df = spark.createDataFrame(rows, "series string, ref_date date, value double")
    at = lambda d: {r["series"]: r["avail_date"] for r in d.collect()}
    assert at(asof.published_series(df)) == {"unemployment": dt.date(2026, 5, 9), "fed_funds": dt.date(2026, 4, 1), "of_our_own": dt.date(2026, 4, 1)}
    assert set(at(asof.published_series(df, {"of_our_own": 0})).values()) == {dt.date(2026, 4, 1)}


def test_runner_writes_every_artefact(spark, tmp_path):
    from tidalframe import runner

    r = np.random.default_rng(2)
    n = 520
    p = 60 * np.exp(np.cumsum(r.normal(0, 0.015, n)))
    df = spark.createDataFrame(pd.DataFrame({"key": "k", "date": [day(i) for i in range(n)], "close": p, "a": r.normal(size=n), "b_log_return": r.normal(size=n), "month": (np.arange(n) // 30 % 12 + 1).astype(float)}).assign(twin=lambda f: f.a * 2))
    found = runner.train_and_save(spark, df, ["a", "twin", "b_log_return", "month"], str(tmp_path), settings={"max_terms": 2, "n_splines": 8, "bags": 2, "refits": 1, "quantile_knots": True, "nu_tau_window": 30, "initial_frac": 0.5})
    assert "twin" not in found.names and len(found.models.mu.terms) <= 2 and list(found.knots) == ["b_log_return"]
    for name in ("mu", "sigma", "nu", "tau"):
        again = sinks.read_model(spark, f"{tmp_path}/models/{name}")
        assert np.allclose(again.beta, getattr(found.models, name).beta) and again.terms == getattr(found.models, name).terms
    forecast = sinks.read_record(spark, f"{tmp_path}/forecast.json")
    assert forecast["low"] < forecast["price"] < forecast["high"] and forecast["pi_multiplier"] == pytest.approx(found.q)
    assert sinks.read_record(spark, f"{tmp_path}/combination_weights.json")["w_model"] == found.weights["w_model"]
    assert sinks.read_record(spark, f"{tmp_path}/scores.json").keys() >= {"mae", "mspe_ratio", "coverage_90", "log_score_model"}
    assert spark.read.parquet(f"{tmp_path}/backtest_path").count() == found.path.count() > 200
    tensor = gam.solve(gam.gram(df, [gam.Term("a", "spline", 6, -3, 3, gam.Term("b_log_return", "spline", 6, -3, 3), lam=10.0)], "close"), 1.0)
    sinks.write_model(spark, tensor, f"{tmp_path}/tensor")
    back = sinks.read_model(spark, f"{tmp_path}/tensor")
    assert back.terms == tensor.terms and gam.predict(df, back, "mu").where("mu is null").count() == 0


def test_eda(spark):
    r = np.random.default_rng(0)
    noise, walk = r.normal(size=400), np.cumsum(r.normal(size=400))
    df = spark.createDataFrame([(k, i, float(x)) for k, s in (("noise", noise), ("walk", walk), ("flat", np.ones(400)), ("short", noise[:20])) for i, x in enumerate(s)], "k string, i int, x double")
    got = {r["k"]: r["verdict"] for r in eda.stationarity(df, ["k"], "i", "x").collect()}
    assert got == {"noise": "stationary", "walk": "non_stationary_I1", "flat": "insufficient_data", "short": "insufficient_data"}
    assert eda.histogram(df, ["k"], "x", 10).groupBy("k").sum("n").where("k = 'walk'").first()[1] == 400
    assert eda.partial_autocorrelation([0.5, 0.25, 0.125])[1:] == pytest.approx([0, 0])


def test_sources_and_config(spark, tmp_path, monkeypatch):
    (tmp_path / "g.csv").write_text("date,GPRD,event\n2023-01-01,101.5,a\n,1,b\n")
    assert readers.csv_index(spark, str(tmp_path / "g.csv"), ["gprd", "gpr"], "gpr").collect()[0]["gpr"] == 101.5
    (tmp_path / "e.json").write_text('{"response": {"data": [{"period": "2023-01-06", "value": "4.5"}, {"period": "2023-01", "value": "x"}]}}')
    got = readers.json_period_series(spark, str(tmp_path / "e.json")).orderBy("ref_date").collect()
    assert [r["value"] for r in got] == [None, 4.5]
    both = readers.aligned({"a": readers.json_period_series(spark, str(tmp_path / "e.json"))})
    assert both.count() == 2
    def fails():
        raise OSError("gone")
    with pytest.raises(ValueError):
        readers.each_or_skip({"a": fails})
    assert readers.with_cache(fails, spark, str(tmp_path / "none"), required=False) is None
    readers.with_cache(lambda: both, spark, str(tmp_path / "cache"))
    assert readers.with_cache(fails, spark, str(tmp_path / "cache")).count() == 2
    monkeypatch.setenv("EIA_API_KEY", "k")
    c = config.load_config()
    assert config.secret(c, "EIA_API_KEY") == "k"
    with pytest.raises(ValueError):
        config.secret(c, "FRED_API_KEY")
    presets = {"model": {"presets": {"fast": {"max_terms": 5}}, "shared": {"bags": 2, "max_terms": 9}}}
    assert config.model_config(presets)["max_terms"] == 5 and config.model_config(presets)["bags"] == 2
    with pytest.raises(ValueError):
        config.model_config(presets, "slow")


def test_streaming_bars_close_with_the_watermark(spark, tmp_path):
    from tidalframe.streaming.bars import windowed_bars

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * i), "k", float(i)) for i in range(30)]
    schema = "id long, ts timestamp, key string, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", "ts", "id", "v")
    q = stream.writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = spark.table("bars").toPandas().sort_values("start")
    batch = windowed_bars(spark.createDataFrame(rows, schema), "key", "ts", "id", "v").toPandas().sort_values("start")
    assert 0 < len(got) < len(batch) and got["close"].tolist() == batch["close"].tolist()[: len(got)]


def test_model_rows_read_their_tables_once(spark):
    from tidalframe.plans import model_queries

    rows, names = model_queries.model_rows(spark, "/root/testdata/sf0.001")
    lazy, _ = model_queries.feature_rows(spark, "/root/testdata/sf0.001")
    reads = [f._jdf.queryExecution().executedPlan().toString().count("FileScan") for f in (rows, lazy)]
    assert reads[0] == 0 < reads[1]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, lazy.collect())) and set(names) < set(rows.columns)
