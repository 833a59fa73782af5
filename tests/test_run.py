"""A run in stages on small made tables: files of every stage, skipped stages, and the merged table by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidalframe import run as staged
from tidalframe.operators.build import Roles, Windows
from tidalframe.sources import sinks
from tidalframe.sources.acquire import Source
from tidalframe.sources.merge import merged_table


def made(n=950, seed=3):
    r = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=n).date
    close = 50 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    oil = pd.DataFrame({"date": days, "open": close * np.exp(r.normal(0, 0.005, n)), "close": close, "volume": r.integers(1000, 5000, n).astype(float)})
    oil["high"], oil["low"] = oil[["open", "close"]].max(axis=1) * 1.01, oil[["open", "close"]].min(axis=1) * 0.99
    market = pd.DataFrame({"date": days, "gold_close": 1000 + r.normal(0, 5, n).cumsum()})
    market.loc[10, "gold_close"] = np.nan
    weeks = pd.date_range("2019-12-06", periods=205, freq="7D").date
    stocks = pd.DataFrame({"ref_date": weeks, "value": 400 + r.normal(0, 2, 205).cumsum()})
    fred = pd.DataFrame({"date": pd.date_range("2019-06-01", periods=60, freq="MS").date, "unemployment": 4 + r.random(60), "fed_funds": 2 + r.random(60)})
    return oil, market, stocks, fred


def tables(spark):
    oil, market, stocks, fred = (spark.createDataFrame(t) for t in made())
    return {"oil": oil, "market": market.replace(float("nan"), None), "eia_crude_stocks": stocks, "fred": fred}


def test_merged_table_knows_only_what_was_published(spark):
    oil, market, stocks, fred = made()
    got = merged_table(tables(spark)).orderBy("date").toPandas()
    assert len(got) == len(oil) and got["gold_close"].notna().all() and got["gold_close"][10] == market["gold_close"][9]
    for row in got.iloc[::37].itertuples():
        known = stocks[[d + dt.timedelta(days=5) <= row.date for d in stocks["ref_date"]]]
        assert row.crude_stocks == known["value"].iloc[-1]
        late = fred[[d + dt.timedelta(days=38) <= row.date for d in fred["date"]]]
        assert row.unemployment == late["unemployment"].iloc[-1] and row.fed_funds == fred[[d <= row.date for d in fred["date"]]]["fed_funds"].iloc[-1]
    moved = merged_table(tables(spark), lags={}, series_lags={}, required=("unemployment",), block="month").orderBy("date").toPandas()
    assert moved["unemployment"][0] == fred[[d <= moved["date"][0] for d in fred["date"]]]["unemployment"].iloc[-1]


@pytest.fixture(scope="module")
def plan(spark):
    own = tables(spark)
    sources = [Source(name, lambda t=t: t) for name, t in own.items()]
    roles = Roles("close", "open", "high", "low", "volume", macro=("unemployment", "fed_funds"), market=("gold_close",), lagged_market=("gold_close",), stocks=("crude_stocks",), correlated={"gold": "gold_close"})
    windows = Windows(rolling=(5, 14), volatility=(5,), correlation=(10,), momentum=(5,), lags=(1, 3))
    return staged.Plan(roles, sources, windows, model={"max_terms": 2, "n_splines": 6, "bags": 1, "cv_splits": 2, "lams": [1.0, 10.0], "collinearity": 0.3, "refit_rows": 60}, groups=4)


def test_run_in_stages(spark, plan, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    done = staged.run(spark, plan, raw, out, skip=("train",))
    assert set(done) == {"acquire", "features", "describe", "combinations"} and {s for s, _ in done["acquire"].values()} == {"fresh"}
    features = spark.read.parquet(f"{out}/features")
    assert 100 < features.count() < 950 and {"close_rsi_14", "crude_stocks_seasonal_z", "corr_gold_10", "close_yang_zhang_5", "unemployment_lag_7"} <= set(features.columns)
    assert features.where(" or ".join(f"`{c}` is null" for c in features.columns)).count() == 0
    n = len([c for c in features.columns if c not in ("key", "date")])
    assert spark.read.parquet(f"{out}/eda/correlations").count() == n * n
    assert set(spark.read.parquet(f"{out}/eda/stationarity").toPandas()["verdict"]) <= {"stationary", "non_stationary_I1", "trend_or_break", "inconclusive", "insufficient_data"}
    assert spark.read.parquet(f"{out}/cpcv/path_metrics").count() == 3 and sinks.read_record(spark, f"{out}/cpcv/summary.json")["paths"] == 3
    again = staged.run(spark, plan, raw, out, skip=("acquire", "features", "describe", "combinations"), with_backtest=False)
    assert set(again) == {"train"} and again["train"].path is None and again["train"].q == 1.96
    assert sinks.read_record(spark, f"{out}/forecast.json")["pi_multiplier"] == 1.96
    with pytest.raises(ValueError, match="unknown stages"):
        staged.run(spark, plan, raw, out, skip=("figures",))


def test_plan_of_a_configuration(spark, tmp_path):
    for name, t in tables(spark).items():
        t.write.parquet(str(tmp_path / name))
    plan = staged.plan_of({"files": {n: str(tmp_path / n) for n in ("oil", "fred")}, "roles": {"price": "close", "macro": ["fed_funds"]}, "windows": {"lags": [1]}, "cpcv": {"n_splits": 4}, "model": {"max_terms": 3}}, spark)
    assert plan.roles == Roles("close", macro=("fed_funds",)) and plan.windows.lags == (1,) and plan.groups == 4 and plan.model["max_terms"] == 3
    assert [s.name for s in plan.sources] == ["oil", "fred"] and plan.sources[0].load().count() == 950
