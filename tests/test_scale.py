"""Operators that cut one long key, many columns or many replicates into tasks, against their plain forms."""

import datetime as dt
import http.server
import json
import threading
import urllib.parse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import asof, backtest, eda, features, moments, scores, splits, volatility
from tidalframe.operators.scan import Ewm, EwmaSigma
from tidalframe.sources import acquire, paged, readers, versions


# --- moments ----------------------------------------------------------------------------------------------------------


def messy(rows=300, columns=23, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(rows, columns))
    x[:, 3] = 2 * x[:, 1] + 1
    x[:, 4] = 7.0
    x[:, 5] = 1e6 + 1e-3 * x[:, 5]
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 6] = np.nan
    x[2:, 7] = np.nan
    return pd.DataFrame(x, columns=[f"x{i}" for i in range(columns)])


@pytest.mark.parametrize("block", [256, 5])
def test_correlations_equal_pandas_at_any_block(spark, block):
    x = messy()
    names = list(x.columns)
    df = spark.createDataFrame(x).repartition(7)
    want = x.corr(min_periods=1).to_numpy()
    got = moments.correlation_matrix(df, names, block)
    np.testing.assert_allclose(got, want, atol=3e-7)
    table = moments.pair_table(moments.column_moments(df, names, block), names, block).collect()
    assert len(table) == len(names) ** 2
    for r in table:
        i, j = names.index(r["a"]), names.index(r["b"])
        assert r["n"] == int((x[r["a"]].notna() & x[r["b"]].notna()).sum())
        assert (r["rho"] is None) == bool(np.isnan(want[i, j])) and (r["rho"] is None or r["rho"] == pytest.approx(got[i, j]))


def test_prune_of_hundreds_of_columns(spark):
    x = messy(740, 290, 1).assign(date=range(740))
    names = [c for c in x.columns if c != "date"]
    rho = x[names].corr(min_periods=1).abs().to_numpy()
    kept = []
    for i in range(len(names)):
        if not np.isnan(rho[i, i]) and not any(rho[i, k] > 0.97 for k in kept):
            kept.append(i)
    assert eda.collinearity_prune(spark.createDataFrame(x), names, "date") == [names[i] for i in kept]
    assert eda.collinearity_prune(spark.createDataFrame(x).limit(0), names[:3], "date") == []


# --- acquisition ------------------------------------------------------------------------------------------------------


class Server(http.server.BaseHTTPRequestHandler):
    """Two series of 25 and 7 records in pages of `limit`; every first request of a page is refused; /broken never answers well."""

    refused: set = set()
    rows = {"a": 25, "b": 7}

    def do_GET(self):  # noqa: N802
        at = urllib.parse.urlsplit(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(at.query).items()}
        key = (at.path, q.get("offset"))
        if at.path.startswith("/broken") or key not in self.refused:
            self.refused.add(key)
            self.send_response(503)
            self.end_headers()
            return
        offset, limit = int(q["offset"]), int(q["length"])
        name = at.path.rsplit("/", 1)[1]
        records = [{"period": (dt.date(2023, 1, 1) + dt.timedelta(i)).isoformat(), "value": str(i) if i % 5 else "n/a"} for i in range(self.rows[name])][offset : offset + limit]
        body = json.dumps({"response": {"data": records}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def address():
    Server.refused = set()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("tasks", [1, 3])
def test_pages_are_read_to_the_short_one_with_back_off(spark, address, tasks):
    url = address + "/seriesid/{series}?offset={offset}&length={limit}"
    got = paged.paged_json(spark, url, ["a", "b"], limit=4, records="response.data", wait=0.01, tasks_per_series=tasks)
    rows = paged.period_pages(got).orderBy("series", "ref_date").collect()
    assert [r["series"] for r in rows] == ["a"] * 25 + ["b"] * 7
    assert [r["value"] for r in rows[:7]] == [None, 1, 2, 3, 4, None, 6] and rows[24]["ref_date"] == dt.date(2023, 1, 25)


def test_a_failed_refresh_leaves_the_old_version(spark, address, tmp_path):
    folder = str(tmp_path / "raw")
    good = acquire.energy_sources(spark, address, "k", {"crude": "a", "gas": "b"}, limit=10, wait=0.01)
    first = acquire.acquire_all(spark, good, folder)
    assert {n: s for n, (s, _) in first.state.items()} == {"eia_crude": "fresh", "eia_gas": "fresh"} and first.tables["eia_crude"].count() == 25
    broken = acquire.energy_sources(spark, address + "/broken", "k", {"crude": "a"}, attempts=2, wait=0.01)
    fails_late = acquire.Source("eia_gas", lambda: spark.range(10).select(F.raise_error(F.lit("late")).alias("value")))
    optional = acquire.Source("gpr", lambda: 1 / 0, required=False)
    again = acquire.acquire_all(spark, [*broken, fails_late, optional], folder)
    assert {n: s for n, (s, _) in again.state.items()} == {"eia_crude": "cached", "eia_gas": "cached", "gpr": "missing"}
    assert again.tables["eia_crude"].count() == 25 and again.tables["eia_gas"].count() == 7 and "gpr" not in again.tables
    with pytest.raises(RuntimeError, match="never before"):
        acquire.acquire_all(spark, [acquire.Source("new", lambda: 1 / 0)], folder)
    with pytest.raises(ValueError):
        acquire.acquire_all(spark, [optional, optional], folder)


def test_versions_replace_one_another_and_old_ones_go(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read_version(spark, path) is None
    for n in (3, 4, 5):
        versions.publish(spark.range(n), path)
        held = versions.read_version(spark, path)
        assert held.count() == n
    old = spark.read.parquet(sorted(str(p) for p in (tmp_path / "t").iterdir() if p.name.startswith("v"))[0])
    assert old.count() == 4 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2
    both = readers.with_cache(lambda: versions.read_version(spark, path), spark, path)  # a table may refresh itself
    assert both.count() == 5


def test_positions_of_a_weekly_report(spark):
    records = [{"report_date_as_yyyy_mm_dd": "2023-01-03T00:00:00.000", "open_interest_all": "100", "m_money_positions_long_all": "30", "m_money_positions_short_all": "10", "prod_merc_positions_long": "x"}, {"other": 1}]
    pages = spark.createDataFrame([("cot", 0, json.dumps(r)) for r in records], "series string, page int, record string")
    (r,) = paged.position_pages(pages).collect()
    assert (r["date"], r["cot_mm_net"], r["cot_mm_long_pct"], r["cot_commercial_net"], r["cot_commercial_long"]) == (dt.date(2023, 1, 3), 20.0, 0.3, None, None)


# --- scans in blocks --------------------------------------------------------------------------------------------------


def moments_of_time(n, seed=0):
    r = np.random.default_rng(seed)
    x = pd.Series(r.normal(size=n).cumsum() + 50)
    x[r.random(n) < 0.2] = np.nan
    x[40:140] = np.nan
    x[:5] = np.nan
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(r.integers(0, 20 * 86400, n)), unit="s")
    return pd.DataFrame({"k": "a", "id": range(n), "ts": ts + pd.to_timedelta(np.arange(n), unit="us"), "x": x, "r": r.normal(size=n) / 50})


def test_scans_in_blocks_equal_scans_of_whole_keys(spark):
    a = pd.concat([moments_of_time(1500), moments_of_time(30, 1).assign(k="b"), moments_of_time(9, 2).assign(k="c", x=np.nan, r=0.0)])
    df = spark.createDataFrame(a).replace(float("nan"), None).repartition(5)
    for one, cut in (
        (features.smoothed(df, ["k"], "ts", "x", [3, 20, 200]), features.smoothed(df, ["k"], "ts", "x", [3, 20, 200], "day")),
        (volatility.conditional_sigma(df, ["k"], "ts", "r"), volatility.conditional_sigma(df, ["k"], "ts", "r", block="hour")),
        (features.rsi(df, ["k"], "ts", "x"), features.rsi(df, ["k"], "ts", "x", block="day")),
    ):
        p, q = (d.orderBy("k", "id").toPandas() for d in (one, cut))
        assert list(p.columns) == list(q.columns)
        for c in p.columns[5:]:
            np.testing.assert_allclose(q[c].to_numpy(float), p[c].to_numpy(float), rtol=1e-11, atol=1e-12, err_msg=c)


def test_blocks_of_any_cut_join_to_the_same_state():
    r = np.random.default_rng(3)
    f = moments_of_time(400)
    for run in (Ewm("x", 12), EwmaSigma("r"), EwmaSigma("x")):
        cuts = [0, *sorted(r.choice(np.arange(1, 400), 23, replace=False)), 400]
        parts = [f.iloc[a:b].reset_index(drop=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        states = run.states([run.summary(p) for p in parts])
        got = np.concatenate([run.replay(p, s).to_numpy() for p, s in zip(parts, states, strict=True)])
        np.testing.assert_allclose(got, run(f).to_numpy(), rtol=1e-11, atol=1e-12)


def test_asof_and_fill_in_blocks_equal_those_of_whole_keys(spark):
    r = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    facts = [("a" if i % 7 else None, start + dt.timedelta(minutes=int(r.integers(0, 30 * 1440))), float(i) if i % 3 else None, f"s{i}" if i % 4 == 0 else None) for i in range(200)]
    facts += [("a", facts[3][1], 9.0, None), ("a", facts[3][1], None, "z")]
    probes = [("a" if i % 3 else None, start + dt.timedelta(minutes=int(r.integers(-1440, 40 * 1440))), i) for i in range(300)] + [("b", start, 999)]
    facts, probes = spark.createDataFrame(facts, "k string, at timestamp, v double, s string"), spark.createDataFrame(probes, "k string, ts timestamp, id long")
    plain, cut = (asof.asof(probes, facts, ["k"], "ts", "at", ["v", "s"], b) for b in (None, "day"))
    assert plain.columns == cut.columns and sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    rows = facts.withColumn("n", F.monotonically_increasing_id()).where("at is not null")
    plain, cut = (asof.forward_filled(rows.dropDuplicates(["k", "at"]).where("k is not null"), ["k"], "at", ["v", "s"], ["v"], b) for b in (None, "day"))
    assert plain.columns == cut.columns and sorted((r["at"], r["v"], r["s"]) for r in plain.collect() if r["s"]) == sorted((r["at"], r["v"], r["s"]) for r in cut.collect() if r["s"])
    assert plain.count() == cut.count()


# --- ranks, samples, combinations -------------------------------------------------------------------------------------


def test_uniform_distance_with_ties_and_edges(spark):
    p = np.round(np.random.default_rng(5).beta(2, 2, 3000), 3)
    p[:50] = 0.5
    p[50:60], p[60:70] = 0.0, 1.0
    n, x = len(p), np.sort(p)
    want = max((np.arange(1, n + 1) / n - x).max(), (x - np.arange(n) / n).max())
    df = spark.createDataFrame([(float(v),) for v in p] + [(None,)], "p double").repartition(6)
    got = scores.ks_uniform(df, "p").first()
    assert got["n"] == n and got["d"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("rows_per_block", [1 << 16, 17])
def test_bootstrap_by_prefix_sums_equals_the_array_version(spark, rows_per_block):
    r = np.random.default_rng(13)
    x = np.abs(r.normal(0, [1.0, 1.05, 2.0], (400, 3)))
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "at int, a double, b double, c double").repartition(5)
    n, mean, draws = scores.bootstrap_table(df, "at", ["a", "b", "c"], 300)
    np.testing.assert_allclose(draws, scores._sampled(x, 300, 0), rtol=1e-12)
    got = scores.bootstrap_means(df, "at", ["a", "b", "c"], 400, 40, 0, rows_per_block).orderBy("rep").toPandas()[["a", "b", "c"]].to_numpy()
    np.testing.assert_allclose(got, draws[:40], rtol=1e-12)
    assert scores.confidence_set(mean, draws) == scores.model_confidence_set(x, reps=300)
    gains = df.select("at", (F.col("a") - F.col("b")).alias("b"), (F.col("a") - F.col("c")).alias("c"))
    assert scores.spa_p_values(*scores.bootstrap_table(gains, "at", ["b", "c"], 300)) == scores.superior_predictive_ability(x[:, 0], x[:, 1:], 300)


def test_bootstrap_blocks_cover_the_rows():
    for n in (1, 2, 7, 500):
        for rep in range(20):
            start, length = splits.bootstrap_blocks(n, 3, rep)
            assert length.sum() == n and (length > 0).all() and ((start >= 0) & (start < n)).all()
    lengths = np.concatenate([splits.bootstrap_blocks(100_000, 1, rep, 10.0)[1] for rep in range(5)])
    assert lengths.mean() == pytest.approx(10, rel=0.05)


@pytest.mark.parametrize(("groups", "k"), [(6, 2), (5, 1), (4, 3)])
def test_combinations_from_sums_equal_the_task_for_each(spark, groups, k):
    r = np.random.default_rng(20)
    n = 260
    x = r.normal(size=(n, 3)) + [0, 5, -100]
    price = 50 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    days = pd.bdate_range("2018-01-01", periods=n + 5)
    rows = [(i, days[i].date(), days[i + (i % 3) + 1].date(), float(0.3 * x[i, 0] + r.normal()) if i % 40 else None, float(price[min(i + 1, n - 1)]), float(price[i]), *map(float, x[i])) for i in range(n)]
    rows[7] = (*rows[7][:7], None, rows[7][8])
    df = spark.createDataFrame(rows, "row_pos long, date date, t1 date, y double, y_level double, anchor double, x0 double, x1 double, x2 double").repartition(4)
    model = backtest.ridge_factory(2.0)
    fast = backtest.cpcv_backtest(df, n, model, ["x0", "x1", "x2"], groups, k)
    slow = backtest.cpcv_backtest(df, n, lambda f, y: model(f, y), ["x0", "x1", "x2"], groups, k)
    a, b = (d.path_returns.orderBy("path", "date").toPandas() for d in (fast, slow))
    pd.testing.assert_frame_equal(a, b)
    assert len(a) >= n - n // groups and fast.summary.first()["mean_sharpe"] == pytest.approx(slow.summary.first()["mean_sharpe"])


# --- panels -----------------------------------------------------------------------------------------------------------


def test_panel_fits_equal_single_ones_for_many_keys(spark):
    from tidalframe.operators import gam, panel

    r = np.random.default_rng(30)
    rows = [(f"k{k}" if k else None, k % 3, float(x), float(z), float(np.sin(3 * x) * k / 100 + z + 0.1 * r.normal())) for k in range(200) for x, z in r.random((40, 2))]
    rows += [("k1", 1, None, 0.5, 1.0), ("k2", 2, 0.5, 0.5, None), ("lonely", 0, 0.2, 0.3, 1.0), ("none", 0, None, None, None)]
    df = spark.createDataFrame(rows, "key string, part int, x double, z double, y double").repartition(6)
    terms = [gam.Term("x", "spline", 7, 0.0, 1.0), gam.Term("z", "linear", 1, 0.0, 1.0)]
    fits = {(r["key"], r["part"]): r for r in panel.panel_fits(df, ["key", "part"], terms, "y", [0.1, 1.0, 10.0]).collect()}
    assert len(fits) == 201 and fits["lonely", 0]["n"] == 1
    for key, part in ((None, 0), ("k1", 1), ("k7", 1), ("k199", 1)):
        one = df.where(F.col("key").eqNullSafe(key) & (F.col("part") == part)) if key else df.where("key is null")
        want = gam.fit(gam.gram(one, terms, "y"), [0.1, 1.0, 10.0])
        got = panel.fit_of(fits[key, part], terms)
        assert (got.n, got.lam) == (want.n, want.lam) and got.edof == pytest.approx(want.edof) and got.rss == pytest.approx(want.rss)
        x = gam.design_row(terms, pd.DataFrame(r.random((50, 2)), columns=["x", "z"]))  # the splines add up to the intercept, so only scores are sure
        np.testing.assert_allclose(x @ got.beta, x @ want.beta, rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose(((x @ got.cov) * x).sum(1), ((x @ want.cov) * x).sum(1), rtol=1e-5)



def test_panel_scores_equal_single_ones(spark, monkeypatch):
    from tidalframe.operators import gam, panel

    r = np.random.default_rng(31)
    rows = [(f"k{k}", float(x), float(x * k + 0.1 * r.normal()), i) for k in range(5) for i, x in enumerate(r.random(30))]
    df = spark.createDataFrame([*rows, ("k1", None, 1.0, 99), ("new", 0.5, 1.0, 0)], "key string, x double, y double, i int").repartition(3)
    terms = [gam.Term("x", "spline", 6, 0.0, 1.0)]
    fits = panel.panel_fits(df.where("key <> 'new'"), ["key"], terms, "y")
    for numbers in (1 << 22, 1):  # broadcast, and met by key
        monkeypatch.setattr(panel, "BROADCAST_NUMBERS", numbers)
        got = {(r["key"], r["i"]): (r["mu"], r["s"]) for r in panel.panel_predict(df, fits, ["key"], terms, "mu", "s").collect()}
        assert len(got) == 152 and got["k1", 99] == (None, None) and got["new", 0] == (None, None)
        one = gam.fit(gam.gram(df.where("key = 'k3'"), terms, "y"))
        for r in gam.predict(df.where("key = 'k3'"), one, "mu", "s").collect():
            assert got["k3", r["i"]] == pytest.approx((r["mu"], r["s"]), rel=1e-5)


def test_distances_from_uniform_by_key(spark):
    from tidalframe.functions.special import kolmogorov_sf

    r = np.random.default_rng(32)
    sets = {"even": r.random(900), "bent": r.beta(2, 3, 500), None: r.random(40), "one": np.array([0.3])}
    df = spark.createDataFrame([(k, float(v)) for k, x in sets.items() for v in x], "k string, p double")
    got = {row["k"]: row for row in scores.ks_by_key(df, ["k"], "p").collect()}
    for k, x in sets.items():
        x, n = np.sort(x), len(x)
        d = max((np.arange(1, n + 1) / n - x).max(), (x - np.arange(n) / n).max())
        root = np.sqrt(n)
        assert got[k]["n"] == n and got[k]["d"] == pytest.approx(d) and got[k]["pit_p"] == pytest.approx(kolmogorov_sf((root + 0.12 + 0.11 / root) * d), abs=1e-7)
    assert got["even"]["pit_p"] > 0.01 > got["bent"]["pit_p"]


def test_unit_root_statistics_from_sums_equal_those_from_rows(spark):
    from tidalframe.operators import panel

    r = np.random.default_rng(33)
    series = {f"k{k}": (r.normal(size=n).cumsum() if k % 2 else 5 + 0.5 * r.normal(size=n)) for k, n in enumerate((400, 400, 90, 31, 12, 260))}
    series |= {"flat": np.full(60, 3.0), "short": r.normal(size=4), None: 1e4 + r.normal(size=150).cumsum()}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("k0", 9999, None)], "k string, i int, x double").repartition(5)
    got = {row["k"]: row for row in panel.unit_root_tests(df, ["k"], "i", "x").collect()}
    assert len(got) == len(series) and got["short"]["adf"] is None and got["flat"]["adf"] is None
    for k, x in series.items():
        if k not in ("flat", "short"):
            t, p = eda.adf(x)
            assert got[k]["n"] == len(x) and got[k]["lags"] == p and got[k]["adf"] == pytest.approx(t, rel=1e-6), k
    one = {row["k"]: row for row in panel.unit_root_tests(df, ["k"], "i", "x", 2).collect()}
    assert one["k1"]["adf"] == pytest.approx(eda.adf(series["k1"], 2)[0], rel=1e-6)
    assert panel.unit_root_tests(df.limit(0), ["k"], "i", "x").count() == 0
