"""Queries of bars, merges, windowed features and the calendar."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from ..functions.calendar import calendar_fields, next_business_day, seasonal_flags
from ..functions.columns import Over, missing_as_null
from ..operators import features as feat
from ..operators.asof import asof, daily_calendar, forward_filled, merge_series, nearest_date, published
from ..operators.build import Roles, Windows, build_features
from ..operators.volatility import conditional_sigma
from ..sources.tables import density
from ..streaming.bars import sessions, windowed_bars
from .catalog import ORACLES, query, table
from .frames import BARS, MONTHLY, PANEL, ROLES, WEEKLY, W, bars, ema, full, monthly_macro, panel, rows, weekly_stock

KEY = ["key", "date"]
OV = Over(["key"], "date")


@query(KEY, {"open": 2, "high": 2, "low": 2, "close": 2}, ["volume"], f"WITH {BARS} SELECT * FROM bars")
def daily_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d)


@query(["date"], {c: 2 for c in ROLES.values()}, sql=f"WITH {BARS}, {PANEL} SELECT * FROM panel")
def pivot_close_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d)


@query(["column_name", "sparse"], {"share": 6}, sql=f"WITH {BARS}, {PANEL} SELECT c AS column_name, v AS share, v < 0.5 AS sparse FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) / count(*)::DOUBLE AS v FROM panel" for c in ROLES.values()) + ")")
def source_density(spark: SparkSession, d: str) -> DataFrame:
    return density(panel(spark, d), list(ROLES.values()))


LAGS = "SELECT * FROM (VALUES ('R', 3), ('A', 5)) AS l(series, lag_days)"
SERIES = "s AS (SELECT l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS ref_date, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def flag_series(spark: SparkSession, d: str) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series"), month.alias("ref_date")).agg(F.sum("l_quantity").alias("value"))


def flag_lags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("R", 3), ("A", 5)], "series string, lag_days int")


@query(["series", "ref_date", "avail_date"], {"value": 2}, sql=f"WITH {SERIES} SELECT s.series, ref_date, ref_date + coalesce(lag_days, 0)::INT AS avail_date, value FROM s LEFT JOIN ({LAGS}) l USING (series)")
def publication_lag_shift(spark: SparkSession, d: str) -> DataFrame:
    return published(flag_series(spark, d), flag_lags(spark))


@query(KEY, {"close": 2, "value": 2}, sql=f"WITH {BARS}, {WEEKLY} SELECT b.key, b.date, b.close, w.value FROM bars b ASOF LEFT JOIN weekly w ON b.date >= w.avail_date")
def asof_merge_weekly(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    facts = weekly_stock(spark, d).select("avail_date", "value")
    days = asof(b.select("date").distinct().withColumn("k", F.lit(1)), facts.withColumn("k", F.lit(1)), ["k"], "date", "avail_date", ["value"])
    return b.join(days.select("date", "value"), "date")


@query(["date"], {"R": 2, "A": 2, "N": 2}, sql=f"""WITH {BARS}, {SERIES}, p AS (SELECT s.series, ref_date + coalesce(lag_days, 0)::INT AS avail_date, value FROM s LEFT JOIN ({LAGS}) l USING (series)),
 c AS (SELECT DISTINCT date FROM bars)
 SELECT c.date, r.value AS "R", a.value AS "A", n.value AS "N" FROM c ASOF LEFT JOIN (SELECT * FROM p WHERE series = 'R') r ON c.date >= r.avail_date
 ASOF LEFT JOIN (SELECT * FROM p WHERE series = 'A') a ON c.date >= a.avail_date ASOF LEFT JOIN (SELECT * FROM p WHERE series = 'N') n ON c.date >= n.avail_date""")
def asof_merge_multi(spark: SparkSession, d: str) -> DataFrame:
    return merge_series(bars(spark, d).select("date").distinct(), published(flag_series(spark, d), flag_lags(spark)), ["R", "A", "N"])


@query(["ref_date"], {"value": 2}, sql=f"""WITH {WEEKLY}, days AS (SELECT CAST(unnest(generate_series(min(ref_date), max(ref_date), INTERVAL 1 DAY)) AS DATE) AS day FROM weekly)
 SELECT days.day AS ref_date, w.value FROM days ASOF LEFT JOIN weekly w ON days.day >= w.ref_date""")
def calendar_ffill(spark: SparkSession, d: str) -> DataFrame:
    return daily_calendar(weekly_stock(spark, d), ["key"], "ref_date", "value")


@query(["date"], {c: 2 for c in ROLES.values()}, sql=f"WITH {BARS}, {PANEL}, f AS (SELECT date, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c}" for c in ROLES.values()) + " FROM panel) SELECT * FROM f WHERE crude IS NOT NULL AND brent IS NOT NULL")
def forward_fill_panel(spark: SparkSession, d: str) -> DataFrame:
    return forward_filled(panel(spark, d), ["key"], "date", list(ROLES.values()), ["crude", "brent"])


@query(["date"], {"close": 2}, sql=f"WITH {BARS} SELECT date, close FROM bars WHERE key = 'ALL' AND date >= DATE '1996-06-15' ORDER BY date LIMIT 1")
def nearest_trading_day(spark: SparkSession, d: str) -> DataFrame:
    return nearest_date(bars(spark, d).where("key = 'ALL'"), "date", "1996-06-15")


@query(KEY, {f"close_lag_{k}": 2 for k in (1, 3, 7, 30)}, sql=f"WITH {BARS} SELECT key, date, " + ", ".join(f"lag(close, {k}) OVER ({W}) AS close_lag_{k}" for k in (1, 3, 7, 30)) + " FROM bars")
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), feat.lags(OV, ["close"], [1, 3, 7, 30]))


@query(["date"], {f"{c}_lag_{k}": 2 for c in ("brent", "gasoline") for k in (7, 14)}, sql=f"WITH {BARS}, {PANEL} SELECT date, " + ", ".join(f"lag({c}, {k}) OVER (ORDER BY date) AS {c}_lag_{k}" for c in ("brent", "gasoline") for k in (7, 14)) + " FROM panel")
def exog_lags(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(panel(spark, d), feat.lags(OV, ["brent", "gasoline"], [7, 14]))


@query(KEY, {"close_pct_change": 6, "close_log_return": 6}, sql=f"WITH {BARS} SELECT key, date, close / lag(close) OVER ({W}) - 1 AS close_pct_change, ln(close / lag(close) OVER ({W})) AS close_log_return FROM bars")
def returns(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), feat.returns(OV, ["close"]))


@query(KEY, {f"close_momentum_{n}": 6 for n in (21, 63, 126)}, sql=f"WITH {BARS} SELECT key, date, " + ", ".join(f"(close - lag(close, {n}) OVER ({W})) / lag(close, {n}) OVER ({W}) AS close_momentum_{n}" for n in (21, 63, 126)) + " FROM bars")
def momentum_windows(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), feat.momentum(OV, "close", [21, 63, 126]))


@query(KEY, {"close_sma_14": 4, "close_sma_50": 4, "close_sma_200": 5, "close_std_14": 2, "close_std_50": 2, "close_std_200": 2}, sql=f"WITH {BARS} SELECT key, date, " + ", ".join(f"{full(fn, 'close', n)} AS close_{f}_{n}" for f, fn in (("sma", "avg"), ("std", "stddev_samp")) for n in (14, 50, 200)) + " FROM bars")
def rolling_sma_std(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), feat.rolling_mean_std(OV, "close", [14, 50, 200]))


@query(KEY, {"close_bb_upper_20": 2, "close_bb_lower_20": 2, "close_bb_pct_20": 6, "close_bb_width_20": 6}, sql=f"""WITH {BARS}, m AS (SELECT key, date, close, {full("avg", "close", 20)} AS a, {full("stddev_samp", "close", 20)} AS s FROM bars)
 SELECT key, date, a + 2 * s AS close_bb_upper_20, a - 2 * s AS close_bb_lower_20, (close - (a - 2 * s)) / nullif((a + 2 * s) - (a - 2 * s), 0) AS close_bb_pct_20, ((a + 2 * s) - (a - 2 * s)) / nullif(a, 0) AS close_bb_width_20 FROM m""")
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), feat.bollinger(OV, "close"))


@query(KEY, {"close_dist_sma_14": 6, "close_dist_sma_50": 6, "close_dist_sma_200": 6, "close_52w_high": 2, "close_52w_low": 2, "close_52w_pct_range": 6}, sql=f"WITH {BARS}, m AS (SELECT key, date, close, " + ", ".join(f"{full('avg', 'close', n)} AS a{n}" for n in (14, 50, 200)) + f""", {full("max", "close", 252)} AS hi, {full("min", "close", 252)} AS lo FROM bars)
 SELECT key, date, (close - a14) / a14 AS close_dist_sma_14, (close - a50) / a50 AS close_dist_sma_50, (close - a200) / a200 AS close_dist_sma_200, hi AS close_52w_high, lo AS close_52w_low, (close - lo) / nullif(hi - lo, 0) AS close_52w_pct_range FROM m""")
def price_level(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), feat.price_level(OV, "close"))


HL = f"{BARS}, m AS (SELECT *, {full('max', 'high', 14)} AS hh, {full('min', 'low', 14)} AS ll FROM bars)"


@query(KEY, {"close_williams_r_14": 6}, sql=f"WITH {HL} SELECT key, date, (hh - close) / nullif(hh - ll, 0) * -100 AS close_williams_r_14 FROM m")
def williams_r(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), feat.williams_r(OV, "close", "high", "low"))


@query(KEY, {"close_stoch_k_14": 6, "close_stoch_d_14": 6}, sql=f"WITH {HL}, k AS (SELECT key, date, (close - ll) / nullif(hh - ll, 0) * 100 AS k FROM m) SELECT key, date, k AS close_stoch_k_14, {full('avg', 'k', 3)} AS close_stoch_d_14 FROM k")
def stochastic(spark: SparkSession, d: str) -> DataFrame:
    return feat.stochastic(bars(spark, d), OV, "close", "high", "low")


@query(KEY, {"close_cmf_5": 6}, sql=f"WITH {BARS}, f AS (SELECT *, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS flow FROM bars) SELECT key, date, ({full('sum', 'flow', 5)}) / ({full('sum', 'volume', 5)}) AS close_cmf_5 FROM f")
def cmf(spark: SparkSession, d: str) -> DataFrame:
    return feat.money_flow(bars(spark, d), OV, "close", "high", "low", "volume", 5)


def _yang(n: int) -> str:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    return f"({full('var_samp', 'night', n)}) + {k!r}::DOUBLE * ({full('var_samp', 'day', n)}) + {1 - k!r}::DOUBLE * ({full('avg', 'rs', n)})"


@query(KEY, {f"close_{m}_{n}": 6 for n in (5, 20) for m in ("parkinson", "garman_klass", "rogers_satchell", "yang_zhang")}, sql=f"""WITH {BARS}, p AS (SELECT key, date, ln(high / low) ** 2 / (4 * ln(2)) AS park, ln(high / low) ** 2 / 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS gk,
 ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(open / lag(close) OVER ({W})) AS night, ln(close / open) AS day FROM bars),
 q AS (SELECT key, date, """ + ", ".join(f"{full('avg', c, n)} AS v_{m}_{n}" for n in (5, 20) for m, c in (("parkinson", "park"), ("garman_klass", "gk"), ("rogers_satchell", "rs"))) + ", " + ", ".join(f"{_yang(n)} AS v_yang_zhang_{n}" for n in (5, 20)) + " FROM p) SELECT key, date, " + ", ".join(f"CASE WHEN v_{m}_{n} IS NOT NULL THEN sqrt(greatest(v_{m}_{n}, 0)) END AS close_{m}_{n}" for n in (5, 20) for m in ("parkinson", "garman_klass", "rogers_satchell", "yang_zhang")) + " FROM q")
def range_vol(spark: SparkSession, d: str) -> DataFrame:
    return feat.range_volatility(bars(spark, d), OV, "open", "high", "low", "close", [5, 20])


N = f"row_number() OVER ({W}) AS n"


@query(KEY, {"close_ema_14": 2, "close_ema_50": 2}, sql=f"WITH {BARS}, b AS (SELECT *, {N} FROM bars) SELECT key, date, {ema('close', 14, 'n')} AS close_ema_14, {ema('close', 50, 'n')} AS close_ema_50 FROM b")
def ema_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return feat.smoothed(bars(spark, d).select("key", "date", "close"), ["key"], "date", "close", [14, 50])


@query(KEY, {"close_rsi_14": 4}, sql=f"""WITH {BARS}, c AS (SELECT key, date, close - lag(close) OVER ({W}) AS x, row_number() OVER ({W}) - 1 AS n FROM bars), g AS (SELECT key, date, n, greatest(x, 0) AS up, greatest(-x, 0) AS dn FROM c WHERE n >= 1),
 e AS (SELECT key, date, {ema("up", 14, "n")} AS u, {ema("dn", 14, "n")} AS l FROM g) SELECT b.key, b.date, 100 - 100 / (1 + u / nullif(l, 0)) AS close_rsi_14 FROM bars b LEFT JOIN e USING (key, date)""")
def rsi(spark: SparkSession, d: str) -> DataFrame:
    return feat.rsi(bars(spark, d).select("key", "date", "close"), ["key"], "date", "close")


@query(KEY, {"close_macd": 2, "close_macd_signal": 2, "close_macd_hist": 2}, sql=f"""WITH {BARS}, b AS (SELECT *, {N} FROM bars), m AS (SELECT key, date, n, ({ema("close", 12, "n")}) - ({ema("close", 26, "n")}) AS macd FROM b),
 s AS (SELECT key, date, macd, n - 25 AS k FROM m WHERE n >= 26), t AS (SELECT key, date, {ema("macd", 9, "k")} AS sig FROM s)
 SELECT m.key, m.date, macd AS close_macd, sig AS close_macd_signal, macd - sig AS close_macd_hist FROM m LEFT JOIN t USING (key, date)""")
def macd(spark: SparkSession, d: str) -> DataFrame:
    return feat.macd(bars(spark, d).select("key", "date", "close"), ["key"], "date", "close")


@query(KEY, {"close_atr_14": 2, "close_atr_pct_14": 6}, sql=f"""WITH {BARS}, t AS (SELECT key, date, close, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr, {N} FROM bars),
 a AS (SELECT key, date, close, {ema("tr", 14, "n")} AS atr FROM t) SELECT key, date, atr AS close_atr_14, atr / close AS close_atr_pct_14 FROM a""")
def atr(spark: SparkSession, d: str) -> DataFrame:
    return feat.atr(bars(spark, d).select("key", "date", "high", "low", "close"), ["key"], "date", "high", "low", "close")


@query(KEY, {"sigma_ewma": 6}, sql=f"""WITH {BARS}, r0 AS (SELECT key, date, ln(close / lag(close) OVER ({W})) AS r, row_number() OVER ({W}) - 1 AS n FROM bars), r AS (SELECT * FROM r0 WHERE n >= 1),
 s AS (SELECT key, var_pop(r) AS v0 FROM r WHERE n <= 20 GROUP BY key),
 v AS (SELECT r.key, r.date, r.n, v0, coalesce(sum(0.06::DOUBLE * r * r * pow(0.94::DOUBLE, -n)) OVER (PARTITION BY r.key ORDER BY r.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc FROM r JOIN s USING (key))
 SELECT key, date, sqrt(greatest(pow(0.94::DOUBLE, n - 1) * v0 + pow(0.94::DOUBLE, n - 1) * acc, 1e-12)) AS sigma_ewma FROM v""")
def ewma_sigma(spark: SparkSession, d: str) -> DataFrame:
    r = feat.add(bars(spark, d).select("key", "date", "close"), feat.returns(OV, ["close"])).where("close_log_return is not null")
    return conditional_sigma(r.select("key", "date", "close_log_return"), ["key"], "date", "close_log_return")


PD = "OVER (ORDER BY date)"
PR = "ORDER BY date"


@query(["date"], {"bc_spread": 2, "bc_spread_pct": 6, "bc_ratio": 6, "bc_spread_sma_14": 2, "bc_spread_std_14": 2}, sql=f"""WITH {BARS}, {PANEL}, s AS (SELECT date, brent - crude AS bc_spread, (brent - crude) / crude AS bc_spread_pct, brent / crude AS bc_ratio FROM panel)
 SELECT *, {full("avg", "bc_spread", 14, None, PR)} AS bc_spread_sma_14, {full("stddev_samp", "bc_spread", 14, None, PR)} AS bc_spread_std_14 FROM s""")
def spread(spark: SparkSession, d: str) -> DataFrame:
    return feat.spread(panel(spark, d), OV, "crude", "brent", "bc")


@query(["date"], {c + s: 2 for c in ("crack_gasoline", "crack_heating_oil", "crack_3_2_1") for s in ("", "_sma_14")}, sql=f"""WITH {BARS}, {PANEL}, s AS (SELECT date, gasoline * 42 - crude AS crack_gasoline, heating * 42 - crude AS crack_heating_oil, (gasoline * 42 * 2 + heating * 42) / 3 - crude AS crack_3_2_1 FROM panel)
 SELECT *, """ + ", ".join(f"{full('avg', c, 14, None, PR)} AS {c}_sma_14" for c in ("crack_gasoline", "crack_heating_oil", "crack_3_2_1")) + " FROM s")
def crack_spread(spark: SparkSession, d: str) -> DataFrame:
    return feat.crack_spreads(panel(spark, d), OV, "crude", "gasoline", "heating")


@query(["date"], {"m1_m2_spread": 2, "m1_m2_spread_pct": 6, "m1_m2_spread_sma_14": 2, "m1_m2_spread_std_14": 2, "m1_m2_spread_chg": 2, "m1_m3_spread": 2}, ["contango_flag"], f"""WITH {BARS}, {PANEL}, s AS (SELECT date, crude - m2 AS g, (crude - m2) / m2 AS p, coalesce((crude - m2 < 0)::INT, 0) AS contango_flag, crude - heating AS m3 FROM panel)
 SELECT date, g AS m1_m2_spread, p AS m1_m2_spread_pct, contango_flag, {full("avg", "g", 14, None, PR)} AS m1_m2_spread_sma_14, {full("stddev_samp", "g", 14, None, PR)} AS m1_m2_spread_std_14, g - lag(g) {PD} AS m1_m2_spread_chg, m3 AS m1_m3_spread FROM s""")
def term_structure(spark: SparkSession, d: str) -> DataFrame:
    return feat.term_structure(panel(spark, d), OV, "crude", "m2", {"m3": "heating"})


@query(KEY, {"close_chg": 2, "close_chg_pct": 6}, sql=f"WITH {BARS} SELECT key, date, close - lag(close, 7) OVER ({W}) AS close_chg, (close - lag(close, 7) OVER ({W})) / lag(close, 7) OVER ({W}) AS close_chg_pct FROM bars")
def inventory_change(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), feat.row_change(OV, ["close"]))


COT = "w AS (SELECT 'ALL' AS key, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS long, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS short, sum(l_quantity) AS interest FROM lineitem GROUP BY 2)"


@query(["date"], {"net": 2, "long_pct": 6, "net_chg_4w": 2, "net_chg_13w": 2}, sql=f"WITH {COT}, n AS (SELECT date, long - short AS net, long / nullif(interest, 0) AS long_pct FROM w) SELECT *, net - lag(net, 20) {PD} AS net_chg_4w, net - lag(net, 65) {PD} AS net_chg_13w FROM n")
def cot_flow(spark: SparkSession, d: str) -> DataFrame:
    of = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    w = table(spark, d, "lineitem").groupBy(F.lit("ALL").alias("key"), week.alias("date")).agg(of("R").alias("long"), of("A").alias("short"), F.sum("l_quantity").alias("interest"))
    return feat.positioning(w, OV, "long", "short", "interest", {"4w": 20, "13w": 65})


@query(KEY, {"close_chg_3m": 2}, sql=f"WITH {BARS} SELECT key, date, close - lag(close, 63) OVER ({W}) AS close_chg_3m FROM bars")
def gecon_change(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(bars(spark, d), {"close_chg_3m": OV.change("close", 63)})


PAST = "(PARTITION BY key, yw % 100 ORDER BY yw ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(KEY, {"close_seasonal_dev": 4, "close_seasonal_z": 4, "close_z_pos": 4, "close_z_neg": 4, "close_surprise": 4}, sql=f"""WITH {BARS}, r AS (SELECT key, date, close, isoyear(date) * 100 + week(date) AS yw FROM bars),
 w0 AS (SELECT key, yw, arg_max(close, date) AS v, min(date) AS first FROM r GROUP BY 1, 2), w1 AS (SELECT *, v - lag(v) OVER (PARTITION BY key ORDER BY yw) AS chg FROM w0),
 w2 AS (SELECT *, CASE WHEN count(v) OVER {PAST} >= 2 THEN avg(v) OVER {PAST} END AS m, CASE WHEN count(v) OVER {PAST} >= 2 THEN stddev_samp(v) OVER {PAST} END AS s, CASE WHEN count(chg) OVER {PAST} >= 2 THEN avg(chg) OVER {PAST} END AS cm FROM w1),
 j AS (SELECT r.key, r.date, close - m AS dev, (close - m) / nullif(s, 0) AS z, CASE WHEN r.date = first THEN coalesce(chg - cm, 0) ELSE 0 END AS sur FROM r JOIN w2 USING (key, yw))
 SELECT key, date, dev AS close_seasonal_dev, z AS close_seasonal_z, CASE WHEN z IS NOT NULL THEN greatest(z, 0) END AS close_z_pos, CASE WHEN z IS NOT NULL THEN least(z, 0) END AS close_z_neg, sur AS close_surprise FROM j""")
def inventory_seasonal(spark: SparkSession, d: str) -> DataFrame:
    return feat.seasonal_stock(bars(spark, d).select("key", "date", "close"), ["key"], "date", "close")


@query(KEY, {"close_log": 6, "close_trend_30": 4, "close_spike": 1}, sql=f"WITH {BARS} SELECT key, date, ln(greatest(close, 1e-6)) AS close_log, {full('avg', 'close', 30)} AS close_trend_30, CASE WHEN count(close) OVER {rows(252)} >= 60 AND close > quantile_cont(close, 0.9) OVER {rows(252)} THEN 1.0 ELSE 0.0 END AS close_spike FROM bars WHERE key = 'ALL'")
def gpr_features(spark: SparkSession, d: str) -> DataFrame:
    return feat.risk_index(bars(spark, d).where("key = 'ALL'"), OV, "close")


def _corr(x: str, y: str, n: int) -> str:
    o = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    both = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN"
    return f"CASE WHEN count({both} 1 END) {o} >= {n} THEN covar_pop({both} {x} END, {both} {y} END) {o} / nullif(stddev_pop({both} {x} END) {o} * stddev_pop({both} {y} END) {o}, 0) END"


@query(["date"], {f"corr_{c}_{n}": 5 for c in ("brent", "gasoline") for n in (30, 90)}, sql=f"WITH {BARS}, {PANEL}, f AS (SELECT date, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("crude", "brent", "gasoline")) + " FROM panel) SELECT date, " + ", ".join(f"{_corr('crude', c, n)} AS corr_{c}_{n}" for c in ("brent", "gasoline") for n in (30, 90)) + " FROM f")
def rolling_corr(spark: SparkSession, d: str) -> DataFrame:
    filled = panel(spark, d).na.fill(0.0)
    return feat.add(filled, feat.rolling_correlations(OV, "crude", {"brent": "brent", "gasoline": "gasoline"}, [30, 90]))


@query(KEY, {"nu_roll": 4, "tau_roll": 4}, sql=f"WITH {BARS}, r AS (SELECT key, date, ln(close / lag(close) OVER ({W})) AS r FROM bars) SELECT key, date, {full('skewness', 'r', 60)} AS nu_roll, 1 / (1 + greatest({full('kurtosis', 'r', 60)}, CASE WHEN count(r) OVER {rows(60)} >= 60 THEN 0 END)) AS tau_roll FROM r WHERE key <> '' ")
def rolling_skew_kurt(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.distribution import rolling_shape

    r = feat.add(bars(spark, d).select("key", "date", "close"), feat.returns(OV, ["close"]))
    return rolling_shape(r, ["key"], "date", "close_log_return")


DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"


def days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


@query(["date"], longs=["day_of_week", "month", "day_of_year", "quarter", "is_month_end", "is_quarter_end"], sql=f"WITH {DAYS} SELECT date, isodow(date) - 1 AS day_of_week, month(date) AS month, dayofyear(date) AS day_of_year, quarter(date) AS quarter, (date = last_day(date))::INT AS is_month_end, (date = last_day(date) AND month(date) % 3 = 0)::INT AS is_quarter_end FROM days")
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(days(spark, d), calendar_fields(F.col("date")))


NTH = lambda m, k, dow: f"(SELECT max(x) FROM (SELECT unnest(generate_series(make_date(year(date), {m}, {k}), make_date(year(date), {m}, {k}) + 6, INTERVAL 1 DAY))::DATE AS x) WHERE isodow(x) = {dow})"


@query(["date"], longs=["driving_season", "heating_season"], sql=f"WITH {DAYS} SELECT date, (date >= {NTH(5, 25, 1)} AND date <= {NTH(9, 1, 1)})::INT AS driving_season, (month(date) IN (10, 11, 12, 1, 2, 3))::INT AS heating_season FROM days")
def seasonal_flag_days(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(days(spark, d), seasonal_flags(F.col("date")))


FIXED = " UNION ALL ".join(f"SELECT make_date(y, {m}, {k}) AS h FROM years" + (f" WHERE y >= {s}" if s > 1900 else "") for m, k, s in ((1, 1, 1870), (6, 19, 2021), (7, 4, 1870), (11, 11, 1938), (12, 25, 1870)))
MOVING = " UNION ALL ".join(f"SELECT max(x) FROM (SELECT y, unnest(generate_series(make_date(y, {m}, {k}), make_date(y, {m}, {k}) + 6, INTERVAL 1 DAY))::DATE AS x FROM years) WHERE isodow(x) = {w} GROUP BY y" for m, k, w in ((1, 15, 1), (2, 15, 1), (5, 25, 1), (9, 1, 1), (10, 8, 1), (11, 22, 4)))


@query(["date"], longs=["us_holiday"], sql=f"""WITH {DAYS}, years AS (SELECT unnest(generate_series(1994, 2003))::INT AS y), fixed AS ({FIXED}), hol AS (SELECT h FROM fixed UNION SELECT h + 1 FROM fixed WHERE isodow(h) = 7 UNION SELECT h - 1 FROM fixed WHERE isodow(h) = 6 UNION {MOVING})
 SELECT date, (date IN (SELECT h FROM hol))::INT AS us_holiday FROM days""")
def us_holidays(spark: SparkSession, d: str) -> DataFrame:
    return feat.add(days(spark, d), seasonal_flags(F.col("date")))


@query(["date", "next_day"], sql=f"WITH {DAYS} SELECT date, date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next_day FROM days")
def next_business_days(spark: SparkSession, d: str) -> DataFrame:
    return days(spark, d).withColumn("next_day", next_business_day(F.col("date")))


@query(["key", "start"], {"open": 4, "high": 4, "low": 4, "close": 4}, ["n"], "SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def event_window_bars(spark: SparkSession, d: str) -> DataFrame:
    return windowed_bars(missing_as_null(table(spark, d, "events")), "event_type", "ts", "event_id", "value")


@query(["key", "start", "end"], {"total": 2}, ["n"], """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "user_id", "ts", "value", "6 hours")


@query(KEY, {"close": 2, "close_lag_1": 2, "close_sma_14": 4, "close_std_14": 2, "close_pct_change": 6, "weekly_stock": 2}, sql=f"""WITH {BARS}, {WEEKLY}, f AS (SELECT key, date, close, lag(close) OVER ({W}) AS close_lag_1, {full("avg", "close", 14)} AS close_sma_14, {full("stddev_samp", "close", 14)} AS close_std_14, close / lag(close) OVER ({W}) - 1 AS close_pct_change FROM bars)
 SELECT f.*, w.value AS weekly_stock FROM f ASOF LEFT JOIN weekly w ON f.date >= w.avail_date""")
def flagship_daily_features(spark: SparkSession, d: str) -> DataFrame:
    f = feat.add(bars(spark, d), feat.lags(OV, ["close"], [1]), feat.rolling_mean_std(OV, "close", [14]), feat.returns(OV, ["close"]))
    stock = weekly_stock(spark, d).select(F.lit("weekly_stock").alias("series"), "avail_date", "value")
    return merge_series(f, stock, ["weekly_stock"])


@query(["date"], {"value": 6}, sql=f"WITH {BARS}, {MONTHLY}, c AS (SELECT DISTINCT date FROM bars) SELECT c.date, m.value FROM c ASOF LEFT JOIN monthly m ON c.date >= m.avail_date")
def asof_merge_monthly(spark: SparkSession, d: str) -> DataFrame:
    macro = monthly_macro(spark, d).select(F.lit("value").alias("series"), "avail_date", "value")
    return merge_series(bars(spark, d).select("date").distinct(), macro, ["value"])


@query(["key"], {"close": 2, "change": 2, "change_pct": 6, "std": 2}, sql=f"WITH {BARS}, f AS (SELECT key, date, close, close - lag(close, 30) OVER ({W}) AS change, (close - lag(close, 30) OVER ({W})) / lag(close, 30) OVER ({W}) AS change_pct, {full('stddev_samp', 'close', 30)} AS std FROM bars) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY date DESC) = 1")
def latest_kpis(spark: SparkSession, d: str) -> DataFrame:
    return feat.latest_figures(bars(spark, d), ["key"], "date", "close")


#: Columns of the whole table by the query that has each alone, over all orders' bars beside the panel.
_PARTS = {
    "lag_features": [f"close_lag_{k}" for k in (1, 3, 7, 30)], "exog_lags": [f"{c}_lag_{k}" for c in ("brent", "gasoline") for k in (7, 14)], "returns": ["close_pct_change", "close_log_return"],
    "momentum_windows": [f"close_momentum_{n}" for n in (21, 63, 126)], "rolling_sma_std": [f"close_{f}_{n}" for f in ("sma", "std") for n in (14, 50, 200)], "bollinger": [f"close_bb_{f}_20" for f in ("upper", "lower", "pct", "width")],
    "price_level": ["close_dist_sma_14", "close_dist_sma_50", "close_dist_sma_200", "close_52w_high", "close_52w_low", "close_52w_pct_range"], "williams_r": ["close_williams_r_14"], "stochastic": ["close_stoch_k_14", "close_stoch_d_14"],
    "cmf": ["close_cmf_5"], "range_vol": [f"close_{m}_{n}" for n in (5, 20) for m in ("parkinson", "garman_klass", "rogers_satchell", "yang_zhang")], "ema_smoothing": ["close_ema_14", "close_ema_50"], "rsi": ["close_rsi_14"],
    "macd": ["close_macd", "close_macd_signal", "close_macd_hist"], "atr": ["close_atr_14", "close_atr_pct_14"], "inventory_change": ["close_chg", "close_chg_pct"], "gecon_change": ["close_chg_3m"],
    "inventory_seasonal": ["close_seasonal_dev", "close_seasonal_z", "close_z_pos", "close_z_neg", "close_surprise"], "gpr_features": ["close_log", "close_trend_30", "close_spike"],
    "calendar_features": ["day_of_week", "month", "day_of_year", "quarter", "is_month_end", "is_quarter_end"], "seasonal_flag_days": ["driving_season", "heating_season"], "us_holidays": ["us_holiday"],
}
_OF_DATE = ("exog_lags", "calendar_features", "seasonal_flag_days", "us_holidays")
_LONGS = [c for n in ("calendar_features", "seasonal_flag_days", "us_holidays") for c in _PARTS[n]]


def _places(name: str) -> dict[str, int]:
    """Decimals of a query's doubles, as its SQL rounds them."""
    return {c: int(re.search(rf'round\(CAST\("{c}" AS DOUBLE\), (\d+)\)', ORACLES[name]).group(1)) for c in _PARTS[name] if c not in _LONGS}


@query(["date"], {c: n for q in _PARTS for c, n in _places(q).items()}, _LONGS, f"WITH {BARS}, base AS (SELECT date FROM bars WHERE key = 'ALL') SELECT base.date, " + ", ".join(f'{q}."{c}"' for q, own in _PARTS.items() for c in own) + " FROM base " + " ".join(
    f"LEFT JOIN ({ORACLES[q]}) AS {q} ON base.date = {q}.date" + ("" if q in _OF_DATE else f" AND {q}.key = 'ALL'") for q in _PARTS))
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """All builders at once on one merged table."""
    prices = bars(spark, d).where("key = 'ALL'")
    merged = prices.join(panel(spark, d).select("date", "brent", "gasoline", "heating", "m2"), "date", "left")
    roles = Roles("close", "open", "high", "low", "volume", "brent", "gasoline", "heating", "close", {"m2": "m2", "m3": "heating"}, macro=("brent", "gasoline"), stocks=("close",), risk="close", activity="close", correlated={"brent": "brent", "gasoline": "gasoline"})
    return build_features(merged, ["key"], "date", roles, Windows(money_flow=5, volatility=(5, 20)), complete=False)
