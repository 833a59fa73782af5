"""Properties of windowed features, merges and calendars on small frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe.functions.calendar import next_business_day, seasonal_flags
from tidalframe.functions.columns import Over, johnson_su_cdf, johnson_su_ppf, norm_cdf
from tidalframe.operators import features as feat
from tidalframe.operators.asof import asof, daily_calendar, merge_series, nearest_date, published, shift_publication

START = dt.date(2023, 1, 2)
OV = Over(["key"], "date")


def frame(spark, closes, high=None, low=None, volume=None, keys=("a",)):
    n = len(closes)
    rows = []
    for k in keys:
        for i, c in enumerate(closes):
            c = None if c is None else float(c)
            rows.append((k, START + dt.timedelta(days=i), c, float(high[i]) if high is not None else c, float(low[i]) if low is not None else c, float(volume[i]) if volume is not None else float(n)))
    return spark.createDataFrame(rows, "key string, date date, close double, high double, low double, volume double")


@pytest.fixture(scope="module")
def walk():
    r = np.random.default_rng(42)
    c = 70 + np.cumsum(r.normal(0, 1, 120))
    return c, c + r.uniform(0.5, 2, 120), c - r.uniform(0.5, 2, 120)


def pandas_of(df):
    return df.toPandas().sort_values(["key", "date"]).reset_index(drop=True)


def test_lags_shift_exactly_and_stay_inside_keys(spark):
    out = pandas_of(feat.add(frame(spark, range(5), keys=("a", "b")), feat.lags(OV, ["close"], [1, 3])))
    for _, g in out.groupby("key"):
        assert g["close_lag_1"].isna().sum() == 1 and g["close_lag_3"].tolist()[3:] == [0.0, 1.0]


def test_rolling_waits_for_full_windows_and_nulls(spark):
    out = pandas_of(feat.add(frame(spark, [1, 2, None, 4, 5, 6]), feat.rolling_mean_std(OV, "close", [2])))
    assert out["close_sma_2"].isna().tolist() == [True, False, True, True, False, False]
    assert out["close_std_2"].iloc[1] == pytest.approx(math.sqrt(0.5))


def test_oscillators_match_pandas(spark, walk):
    c, h, lo = walk
    df = frame(spark, c, h, lo)
    s = pd.Series(c)
    got = pandas_of(feat.smoothed(df, ["key"], "date", "close", [14]))["close_ema_14"]
    assert np.allclose(got[13:], s.ewm(span=14, adjust=False).mean()[13:]) and got[:13].isna().all()
    rsi = pandas_of(feat.rsi(df, ["key"], "date", "close"))["close_rsi_14"].dropna()
    assert ((rsi >= 0) & (rsi <= 100)).all()
    m = pandas_of(feat.macd(df, ["key"], "date", "close"))
    assert m["close_macd"].first_valid_index() == 25 and m["close_macd_signal"].first_valid_index() == 33
    assert np.allclose(m["close_macd_hist"].dropna(), (m["close_macd"] - m["close_macd_signal"]).dropna())
    a = pandas_of(feat.atr(df, ["key"], "date", "high", "low", "close"))["close_atr_14"].dropna()
    assert (a > 0).all()


def test_flat_prices_give_null_not_errors(spark):
    df = frame(spark, [70] * 50, volume=[0] * 50)
    out = feat.add(df, feat.williams_r(OV, "close", "high", "low"), feat.bollinger(OV, "close"), feat.price_level(OV, "close", [14], 20))
    out = feat.money_flow(feat.stochastic(out, OV, "close", "high", "low"), OV, "close", "high", "low", "volume")
    got = pandas_of(feat.rsi(out, ["key"], "date", "close"))
    for c in ("close_williams_r_14", "close_stoch_k_14", "close_bb_pct_20", "close_cmf_20", "close_52w_pct_range", "close_rsi_14"):
        assert got[c].isna().all(), c


def test_non_positive_prices_have_no_log(spark):
    got = pandas_of(feat.add(frame(spark, [1, -2, 3, 0, 5]), feat.returns(OV, ["close"])))
    assert got["close_log_return"].isna().all() and math.isnan(got["close_pct_change"].iloc[4])


def test_parkinson_closed_form(spark):
    n = 30
    df = frame(spark, [70] * n, [72] * n, [68] * n).withColumn("open", F.col("close"))
    got = pandas_of(feat.range_volatility(df, OV, "open", "high", "low", "close", [5]))
    assert got["close_parkinson_5"].iloc[-1] == pytest.approx(math.log(72 / 68) / math.sqrt(4 * math.log(2)), abs=1e-9)
    assert got["close_yang_zhang_5"].isna().sum() == 5


def test_correlation_of_a_constant_is_null(spark):
    df = frame(spark, range(40)).withColumn("flat", F.lit(1.0)).withColumn("twin", F.col("close") * 2)
    got = pandas_of(feat.add(df, feat.rolling_correlations(OV, "close", {"flat": "flat", "twin": "twin"}, [30])))
    assert got["corr_flat_30"].isna().all() and got["corr_twin_30"].dropna().round(9).eq(1).all()


def test_sample_moments_match_pandas(spark, walk):
    df = frame(spark, walk[0])
    s, k = OV.skew_kurt("close", 30)
    got = pandas_of(feat.add(df, {"s": s, "k": k}))
    c = pd.Series(walk[0])
    assert np.allclose(got["s"][29:], c.rolling(30).skew()[29:]) and np.allclose(got["k"][29:], c.rolling(30).kurt()[29:])


def test_seasonal_stock_sees_only_the_past(spark):
    days = [dt.date(2016, 1, 4) + dt.timedelta(days=i) for i in range(5 * 365 - 20)]
    rows = [("a", d, 400 + 20 * math.sin(2 * math.pi * d.isocalendar()[1] / 52)) for d in days]
    base = spark.createDataFrame(rows, "key string, date date, close double")
    bumped = base.withColumn("close", F.col("close") + F.when(F.col("date") > F.lit(days[-4]), 60).otherwise(0))
    a, b = (pandas_of(feat.seasonal_stock(x, ["key"], "date", "close")) for x in (base, bumped))
    assert a["close_seasonal_dev"][:-3].equals(b["close_seasonal_dev"][:-3]) and b["close_seasonal_dev"].iloc[-1] > 50
    assert (a["close_surprise"] != 0).sum() <= a["date"].nunique() / 7 + 1


def test_publication_lag_hides_values(spark):
    s = spark.createDataFrame([("u", dt.date(2023, 4, 1), 3.9), ("u", dt.date(2023, 5, 1), 4.0), ("x", dt.date(2023, 5, 1), 5.0)], "series string, ref_date date, value double")
    lags = spark.createDataFrame([("u", 38)], "series string, lag_days int")
    base = spark.createDataFrame([(dt.date(2023, 5, 15),), (dt.date(2023, 6, 19),)], "date date")
    got = merge_series(base, published(s, lags), ["u", "x"]).orderBy("date").collect()
    assert [(r["u"], r["x"]) for r in got] == [(3.9, 5.0), (4.0, 5.0)]
    assert shift_publication(s, "ref_date", 0) is s and shift_publication(s, "ref_date", None) is s


def test_asof_takes_the_latest_value_and_skips_nulls(spark):
    p = spark.createDataFrame([("k", 1, "p1"), ("k", 5, "p5"), ("j", 5, "q")], "k string, t long, name string")
    f = spark.createDataFrame([("k", 2, 10.0), ("k", 5, 20.0), ("k", 4, None)], "k string, t long, v double")
    got = {r["name"]: r["v"] for r in asof(p, f, ["k"], "t", "t", ["v"]).collect()}
    assert got == {"p1": None, "p5": 20.0, "q": None}


def test_calendar_densifies_and_empty_frames_pass(spark):
    s = spark.createDataFrame([("k", dt.date(2023, 1, 6), 1.0), ("k", dt.date(2023, 1, 13), 2.0)], "k string, d date, v double")
    assert [r["v"] for r in daily_calendar(s, ["k"], "d", "v").orderBy("d").collect()] == [1.0] * 7 + [2.0]
    assert daily_calendar(s.where("v > 9"), ["k"], "d", "v").count() == 0
    assert feat.add(frame(spark, []), feat.returns(OV, ["close"])).count() == 0
    assert nearest_date(s, "d", "2023-01-07").first()["d"] == dt.date(2023, 1, 13)
    assert nearest_date(s, "d", "2024-01-07").first()["d"] == dt.date(2023, 1, 13)


def test_season_flags(spark):
    days = spark.createDataFrame([(dt.date(2023, 1, 1) + dt.timedelta(days=i),) for i in range(365)], "date date")
    got = feat.add(days, seasonal_flags(F.col("date"))).toPandas().set_index("date")
    driving = got.index[got["driving_season"] == 1]
    assert (driving.min(), driving.max()) == (dt.date(2023, 5, 29), dt.date(2023, 9, 4))
    holidays = set(got.index[got["us_holiday"] == 1])
    assert {dt.date(2023, 7, 4), dt.date(2023, 1, 2), dt.date(2023, 11, 10), dt.date(2023, 11, 23), dt.date(2023, 6, 19)} <= holidays
    fri = spark.createDataFrame([(dt.date(2023, 6, 2),), (dt.date(2023, 6, 3),), (dt.date(2023, 6, 5),)], "d date")
    assert [r[0].day for r in fri.select(next_business_day(F.col("d"))).collect()] == [5, 5, 6]


def test_distribution_functions(spark):
    xs = [-40.0, -9.0, -3.0, -0.5, 0.0, 1.2, 4.0, 8.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(norm_cdf("x")).collect()]
    assert all(a == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-7, abs=1e-300) for a, x in zip(got, xs, strict=True))
    su = [F.lit(v) for v in (0.2, 1.3, 1.0, 2.0)]
    assert spark.range(1).select(johnson_su_cdf(johnson_su_ppf(0.8, *su), *su)).first()[0] == pytest.approx(0.8, abs=1e-9)
