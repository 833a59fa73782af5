"""Queries of splits, statistics, scores and models."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import Over, norm_ppf
from ..functions.special import chi2_sf
from .. import runner
from ..operators import asof, backtest, eda, gam, panel as panels, scores, splits, volatility
from ..operators.distribution import johnson_su_fits
from ..operators.distributional import distributional
from ..operators.features import add, drawdown, drift_monitor as watched, error_drift, interpolated, lags, returns, rolling_mean_std
from ..session import computed_once
from .catalog import ORACLES, query
from .frames import BARS, FORECASTS, MONTHLY, PANEL, ROLES, W, bars, forecasts, full, monthly_macro, panel

KEY = ["key", "date"]
OV = Over(["key"], "date")
ALL = "key = 'ALL'"


def one_series(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).where(ALL).select("key", "date", "close")


# ---- supervised matrix and splits

T = f"t AS (SELECT date, close, lead(close) OVER (ORDER BY date) AS y, close AS anchor, lead(date) OVER (ORDER BY date) AS t1, row_number() OVER (ORDER BY date) - 1 AS row_pos FROM bars WHERE {ALL}), r AS (SELECT * FROM t WHERE t1 IS NOT NULL)"


def targets(spark: SparkSession, d: str) -> DataFrame:
    return splits.forward_target(one_series(spark, d), ["key"], "date", "close")


def _split_rows(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    r = targets(spark, d).select("row_pos", "date", "t1")
    return r, r.count()


@query(["date", "t1"], {"y": 2, "anchor": 2}, ["row_pos"], f"WITH {BARS}, {T} SELECT * FROM r")
def forward_target(spark: SparkSession, d: str) -> DataFrame:
    return targets(spark, d)


def feature_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Features of the single series with a log-return target, complete rows only."""
    f = add(one_series(spark, d), returns(OV, ["close"]), rolling_mean_std(OV, "close", [5, 20]), lags(OV, ["close"], [1]))
    f = f.select("key", "date", "close", F.col("close_log_return").alias("x_return"), F.try_divide("close", "close_sma_5").alias("x_fast"), F.try_divide("close", "close_sma_20").alias("x_slow"), F.try_divide("close_std_20", "close_sma_20").alias("x_vol"), F.month("date").cast("double").alias("month"))
    names = ["x_return", "x_fast", "x_slow", "x_vol", "month"]
    return splits.forward_target(f.na.drop(), ["key"], "date", "close", 1, "log_return"), names


def model_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The same as a table of a row a day, for models and backtests that run many jobs over it."""
    rows, names = feature_rows(spark, d)
    return computed_once(rows), names


@query(["date", "t1"], {"y": 6, "x_return": 6, "x_fast": 6, "x_slow": 6, "x_vol": 6}, ["row_pos"], f"""WITH {BARS}, f AS (SELECT date, close, ln(close / lag(close) OVER ({W})) AS x_return, close / ({full("avg", "close", 5)}) AS x_fast, close / ({full("avg", "close", 20)}) AS x_slow,
 ({full("stddev_samp", "close", 20)}) / ({full("avg", "close", 20)}) AS x_vol FROM bars WHERE {ALL}), g AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS row_pos, lead(date) OVER (ORDER BY date) AS t1, ln(lead(close) OVER (ORDER BY date) / close) AS y FROM f WHERE x_return IS NOT NULL AND x_slow IS NOT NULL)
 SELECT * FROM g WHERE t1 IS NOT NULL""")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return feature_rows(spark, d)[0]


def _bounds(k: str) -> str:
    return f"(SELECT f, f * (n // {k}) + least(f, n % {k}) AS a, (f + 1) * (n // {k}) + least(f + 1, n % {k}) - 1 AS b FROM (SELECT count(*) AS n FROM r), (SELECT unnest(range(0, {k})) AS f))"


@query(["fold", "role"], longs=["row_pos"], sql=f"""WITH {BARS}, {T}, s AS (SELECT s.*, r.date AS d0 FROM {_bounds("5")} s JOIN r ON r.row_pos = s.a), e AS (SELECT floor(count(*) * 0.02::DOUBLE)::BIGINT AS emb FROM r)
 SELECT CAST(f AS INTEGER) AS fold, row_pos, CASE WHEN row_pos BETWEEN a AND b THEN 'test' ELSE 'train' END AS role FROM r, s, e WHERE row_pos BETWEEN a AND b OR t1 < d0 OR row_pos >= b + 1 + emb""")
def purged_kfold(spark: SparkSession, d: str) -> DataFrame:
    r, n = _split_rows(spark, d)
    return splits.purged_kfold(r, n, 5, 0.02)


COMBOS = "(VALUES " + ", ".join(f"({i}, {min(c)}, {max(c)}, {c[0]}, {c[1]})" for i, c in enumerate(itertools.combinations(range(6), 2))) + ") AS c(fold, lo, hi, g1, g2)"


@query(["fold", "role"], longs=["row_pos"], sql=f"""WITH {BARS}, {T}, s AS (SELECT s.*, r.date AS d0 FROM {_bounds("6")} s JOIN r ON r.row_pos = s.a), e AS (SELECT floor(count(*) * 0.01::DOUBLE)::BIGINT AS emb FROM r)
 SELECT CAST(fold AS INTEGER) AS fold, row_pos, CASE WHEN row_pos BETWEEN s1.a AND s1.b OR row_pos BETWEEN s2.a AND s2.b THEN 'test' ELSE 'train' END AS role
 FROM {COMBOS} JOIN s s1 ON s1.f = g1 JOIN s s2 ON s2.f = g2, r, e WHERE row_pos BETWEEN s1.a AND s1.b OR row_pos BETWEEN s2.a AND s2.b OR t1 < s1.d0 OR row_pos >= s2.b + 1 + emb""")
def cpcv_splits(spark: SparkSession, d: str) -> DataFrame:
    r, n = _split_rows(spark, d)
    return splits.cpcv_splits(r, n, 6, 2, 0.01)


@query(["path", "grp", "fold"], sql=f"SELECT CAST(row_number() OVER (PARTITION BY g ORDER BY fold) - 1 AS INTEGER) AS path, CAST(g AS INTEGER) AS grp, CAST(fold AS INTEGER) AS fold FROM (SELECT fold, unnest([g1, g2]) AS g FROM {COMBOS})")
def cpcv_paths(spark: SparkSession, d: str) -> DataFrame:
    return splits.cpcv_paths(spark, 6, 2)


@query(["fold", "role"], longs=["row_pos"], sql=f"""WITH {BARS}, {T}, n AS (SELECT count(*) AS n FROM r), s AS (SELECT f, n - (4 - f) * (n // 5) AS a, n // 5 AS z FROM n, (SELECT unnest(range(0, 4)) AS f))
 SELECT CAST(f AS INTEGER) AS fold, row_pos, CASE WHEN row_pos < a THEN 'train' ELSE 'test' END AS role FROM r, s WHERE row_pos < a OR (row_pos >= a + 10 AND row_pos < a + z)""")
def embargoed_split(spark: SparkSession, d: str) -> DataFrame:
    r, n = _split_rows(spark, d)
    return splits.embargoed_split(r, n, 4, 10, purged=False)


@query([], longs=["model", "train_rows", "test_end"], sql=f"""WITH {BARS}, n AS (SELECT count(*) AS n FROM bars WHERE {ALL}), s AS (SELECT n, unnest(range(greatest(floor(n * 0.6::DOUBLE)::BIGINT, 252), n, 63)) AS st FROM n)
 SELECT row_number() OVER (ORDER BY st) - 1 AS model, st AS train_rows, least(st + 63, n) AS test_end FROM s""")
def walk_forward_plan(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(splits.walk_forward_plan(one_series(spark, d).count(), 0.6, 63, 63), "model long, train_rows long, test_end long")


# ---- descriptive statistics

@query(["a", "b"], {"rho": 5}, sql=f"WITH {BARS}, {PANEL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / (stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL)) AS rho FROM panel" for a in ROLES.values() for b in ROLES.values()))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return eda.correlations(panel(spark, d), list(ROLES.values()))


PRUNED = ["twin", "open", "high", "low", "volume", "flat"]


def _pruned_sql(threshold: float = 0.97) -> str:
    """The greedy rule from left to right, a column per step."""
    name = lambda i: f'"{PRUNED[i]}"'
    rho = [f"covar_pop({name(j)}, {name(i)}) / nullif(stddev_pop({name(j)}) * stddev_pop({name(i)}), 0) AS r{j}_{i}" for i in range(len(PRUNED)) for j in range(i)]
    steps = [f"s AS (SELECT {', '.join([*rho, *(f'stddev_pop({name(i)}) > 0 AS v{i}' for i in range(len(PRUNED)))])} FROM x)"]
    for i in range(len(PRUNED)):
        near = " OR ".join(f"(k{j} AND abs(coalesce(r{j}_{i}, 0)) > {threshold})" for j in range(i)) or "false"
        steps.append(f"s{i} AS (SELECT *, v{i} AND NOT ({near}) AS k{i} FROM {f's{i - 1}' if i else 's'})")
    last = f"s{len(PRUNED) - 1}"
    return f"WITH {BARS}, x AS (SELECT CAST(open AS DOUBLE) AS open, high, low, CAST(volume AS DOUBLE) AS volume, 1.0::DOUBLE AS flat, high * 2 + 1 AS twin FROM bars WHERE {ALL}), " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT '{c}' AS kept FROM {last} WHERE k{i}" for i, c in enumerate(PRUNED))


@query(["kept"], sql=_pruned_sql())
def collinearity_prune(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).where(ALL).select("date", "open", "high", "low", "volume", F.lit(1.0).alias("flat"), (F.col("high") * 2 + 1).alias("twin"))
    kept = eda.collinearity_prune(b, PRUNED, "date")
    return spark.createDataFrame([(c,) for c in kept], "kept string")


@query(["key", "bin"], {"low": 4, "high": 4}, ["n"], f"""WITH {BARS}, s AS (SELECT key, min(close) AS a, max(close) AS b FROM bars GROUP BY key)
 SELECT key, CAST(least(floor((close - a) / ((b - a) / 50)), 49) AS INTEGER) AS bin, min(a + least(floor((close - a) / ((b - a) / 50)), 49) * ((b - a) / 50)) AS low, min(a + (least(floor((close - a) / ((b - a) / 50)), 49) + 1) * ((b - a) / 50)) AS high, count(*) AS n FROM bars JOIN s USING (key) GROUP BY 1, 2""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.histogram(bars(spark, d), ["key"], "close", 50)


QUANTS = ", ".join(repr(i / 20) + "::DOUBLE" for i in range(21))


@query(KEY, {"close_rank": 6}, sql=f"""WITH {BARS}, k AS (SELECT key, quantile_cont(close, [{QUANTS}]) AS q FROM bars GROUP BY key), j AS (SELECT key, date, close AS x, q, len(list_filter(q, lambda v: v < close)) AS lo, len(list_filter(q, lambda v: v <= close)) AS up FROM bars JOIN k USING (key))
 SELECT key, date, CASE WHEN up > lo THEN (lo + up - 1) / 2.0::DOUBLE / 20 WHEN lo = 0 THEN 0 WHEN lo = 21 THEN 1 ELSE (lo - 1 + (x - q[lo]) / (q[lo + 1] - q[lo])) / 20 END AS close_rank FROM j""")
def quantile_transform(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).select("key", "date", "close")
    return eda.quantile_rank(b, eda.quantile_knots(b, ["key"], "close", 21), ["key"], "close", "close_rank")


LN = f"lr AS (SELECT key, date, ln(close / lag(close) OVER ({W})) AS r FROM bars), lx AS (SELECT key, date, r - avg(r) OVER (PARTITION BY key) AS e FROM lr WHERE r IS NOT NULL)"


def log_returns(spark: SparkSession, d: str) -> DataFrame:
    return add(bars(spark, d).select("key", "date", "close"), returns(OV, ["close"])).where("close_log_return is not null").select("key", "date", F.col("close_log_return").alias("r"))


ACF = f"""{BARS}, {LN}, c AS (SELECT key, lag, count(*) + lag AS n, sum(e * p) AS c FROM (SELECT key, e, lag, lead(e, lag) OVER (PARTITION BY key, lag ORDER BY date) AS p FROM lx, (SELECT unnest(range(1, 11)) AS lag)) WHERE p IS NOT NULL GROUP BY 1, 2),
 z AS (SELECT key, sum(e * e) AS c0 FROM lx GROUP BY key), a AS (SELECT key, lag, n, c / c0 AS acf FROM c JOIN z USING (key))"""


@query(["key"], {"acf": 6, "q": 4}, ["lag", "n"], f"WITH {ACF} SELECT key, lag, n, acf, sum(acf * acf / (n - lag)) OVER (PARTITION BY key ORDER BY lag) * n * (n + 2) AS q FROM a")
def acf_ljung_box(spark: SparkSession, d: str) -> DataFrame:
    return eda.autocorrelation(log_returns(spark, d), ["key"], "date", "r", 10)


def hart(x: str) -> str:
    """SQL of the normal distribution function."""
    from functools import reduce

    from ..functions.columns import HART_BOTTOM, HART_TOP

    a = f"abs({x})"
    poly = lambda cs: reduce(lambda s, c: f"({s} * {a} + {c!r}::DOUBLE)", cs[1:], f"{cs[0]!r}::DOUBLE")
    far = f"({a} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k}.0::DOUBLE / {far})"
    tail = f"exp(-{a} * {a} / 2) * CASE WHEN {a} < 7.07106781186547 THEN {poly(HART_TOP)} / {poly(HART_BOTTOM)} ELSE 1.0::DOUBLE / ({far} * 2.506628274631::DOUBLE) END"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


def _chi2_sql(x: str, dof: int) -> str:
    """SQL of the upper tail of the chi-squared distribution, by its finite sums."""
    if dof % 2 == 0:
        return f"exp(-{x} / 2) * (" + " + ".join(f"pow({x} / 2, {i}) / {math.factorial(i)}.0::DOUBLE" for i in range(dof // 2)) + ")"
    terms = " + ".join(f"pow({x} / 2, {i - 0.5!r}::DOUBLE) / {math.gamma(i + 0.5)!r}::DOUBLE" for i in range(1, (dof - 1) // 2 + 1)) or "0"
    return f"2 * (1 - ({hart(f'sqrt({x})')})) + exp(-{x} / 2) * ({terms})"


def _acf_tests_sql(lags: int = 10) -> str:
    """Partial autocorrelations by the recursion over the order, a step per common table expression."""
    w = f"w AS (SELECT key, {', '.join(f'max(CASE WHEN lag = {k} THEN acf END) AS r{k}, max(CASE WHEN lag = {k} THEN q END) AS q{k}' for k in range(1, lags + 1))} FROM b GROUP BY key)"
    steps = ["d1 AS (SELECT *, r1 AS f1_1 FROM w)"]
    for k in range(2, lags + 1):
        top = " - ".join([f"r{k}", *(f"f{k - 1}_{j} * r{k - j}" for j in range(1, k))])
        bottom = " - ".join(["1", *(f"f{k - 1}_{j} * r{j}" for j in range(1, k))])
        steps.append(f"e{k} AS (SELECT *, ({top}) / ({bottom}) AS f{k}_{k} FROM d{k - 1})")
        steps.append(f"d{k} AS (SELECT *, {', '.join(f'f{k - 1}_{j} - f{k}_{k} * f{k - 1}_{k - j} AS f{k}_{j}' for j in range(1, k))} FROM e{k})")
    rows = " UNION ALL ".join(f"SELECT key, {k} AS lag, r{k} AS acf, f{k}_{k} AS pacf, q{k} AS q, {_chi2_sql(f'q{k}', k)} AS p FROM d{lags}" for k in range(1, lags + 1))
    return f"WITH {ACF}, b AS (SELECT key, lag, n, acf, sum(acf * acf / (n - lag)) OVER (PARTITION BY key ORDER BY lag) * n * (n + 2) AS q FROM a), {w}, {', '.join(steps)} {rows}"


@query(["key"], {"acf": 6, "pacf": 6, "q": 4, "p": 6}, ["lag"], _acf_tests_sql())
def acf_tests(spark: SparkSession, d: str) -> DataFrame:
    found = eda.autocorrelation(log_returns(spark, d), ["key"], "date", "r", 10)

    def run(f):
        f = f.sort_values("lag")
        return f.assign(pacf=eda.partial_autocorrelation(f["acf"].tolist()), p=[chi2_sf(q, k) for q, k in zip(f["q"], f["lag"], strict=True)])

    return found.groupBy("key").applyInPandas(run, "key string, lag int, n long, acf double, q double, pacf double, p double")


@query(["date"], {"trend": 6, "seasonal": 3, "residual": 3}, sql=f"""WITH {BARS}, b AS (SELECT date, close, row_number() OVER (ORDER BY date) - 1 AS n FROM bars WHERE {ALL}),
 t AS (SELECT *, CASE WHEN count(close) OVER x = 20 AND count(close) OVER y = 20 THEN (avg(close) OVER x + avg(close) OVER y) / 2 END AS trend FROM b WINDOW x AS (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), y AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING)),
 p AS (SELECT n % 20 AS k, avg(close - trend) AS m FROM t GROUP BY 1), q AS (SELECT k, m - avg(m) OVER () AS seasonal FROM p)
 SELECT date, trend, seasonal, close - trend - seasonal AS residual FROM t JOIN q ON k = n % 20""")
def decompose(spark: SparkSession, d: str) -> DataFrame:
    return eda.decompose(one_series(spark, d), ["key"], "date", "close", 20)


@query(["key"], {"kpss": 6}, ["n"], f"""WITH {BARS}, {LN}, s AS (SELECT key, e, sum(e) OVER ({W} ROWS UNBOUNDED PRECEDING) AS s, lag(e) OVER ({W}) AS e1, lag(e, 2) OVER ({W}) AS e2, lag(e, 3) OVER ({W}) AS e3 FROM lx)
 SELECT key, count(*) AS n, sum(s * s) / ((sum(e * e) + 2 * 0.75 * sum(e * e1) + 2 * 0.5 * sum(e * e2) + 2 * 0.25 * sum(e * e3)) * count(*)) AS kpss FROM s GROUP BY key""")
def kpss_stat(spark: SparkSession, d: str) -> DataFrame:
    return eda.kpss_statistic(log_returns(spark, d), ["key"], "date", "r", 3)


@query(["key", "adf_reject", "kpss_reject", "verdict"], {"adf": 4, "kpss": 4}, ["n"])
def adf_stationarity(spark: SparkSession, d: str) -> DataFrame:
    return eda.stationarity(log_returns(spark, d), ["key"], "date", "r")


@query(KEY, {"close_filled": 4}, sql=f"""WITH {BARS}, g AS (SELECT key, date, CASE WHEN day(date) % 3 <> 0 THEN close END AS x, row_number() OVER ({W}) AS n FROM bars WHERE {ALL}),
 f AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER b AS n0, last_value(x IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER a AS n1, first_value(x IGNORE NULLS) OVER a AS y1 FROM g
  WINDOW b AS ({W} ROWS UNBOUNDED PRECEDING), a AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT key, date, CASE WHEN n0 = n1 THEN y0 ELSE y0 + (y1 - y0) * ((n - n0)::DOUBLE / (n1 - n0)) END AS close_filled FROM f""")
def interpolate_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = one_series(spark, d).withColumn("close", F.when(F.dayofmonth("date") % 3 != 0, F.col("close")))
    return interpolated(g, ["key"], "date", "close")


# ---- scores and inference

def _metrics(f: str) -> str:
    return f"avg(abs(y - {f})) AS mae, sqrt(avg((y - {f}) * (y - {f}))) AS rmse, avg(abs((y - {f}) / y)) * 100 AS mape"


@query(["key", "model"], {"mae": 3, "rmse": 3, "mape": 4}, sql=f"WITH {FORECASTS}, n AS (SELECT *, lag(y) OVER ({W}) AS naive FROM fc) " + " UNION ALL ".join(f"SELECT key, '{m}' AS model, {_metrics(m)} FROM n WHERE {m} IS NOT NULL GROUP BY key" for m in ("fast", "slow", "naive")))
def metrics_table(spark: SparkSession, d: str) -> DataFrame:
    return eda.naive_table(forecasts(spark, d), ["key"], "date", "y", ["fast", "slow"])


@query(["key"], {"hit": 6}, sql=f"WITH {FORECASTS} SELECT key, avg((sign(y - anchor) = sign(fast - anchor))::INT) AS hit FROM fc GROUP BY key")
def directional(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).groupBy("key").agg(scores.directional_accuracy("y", "fast", "anchor").alias("hit"))


PIN = {"q05": 0.05, "q50": 0.5, "q95": 0.95}


@query(["key"], {q: 3 for q in PIN}, sql=f"WITH {FORECASTS} SELECT key, " + ", ".join(f"avg(greatest((y - (slow + sigma * {norm_ppf(p)!r}::DOUBLE)) * {p}, (y - (slow + sigma * {norm_ppf(p)!r}::DOUBLE)) * ({p} - 1))) AS {q}" for q, p in PIN.items()) + " FROM fc GROUP BY key")
def pinball(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.columns import pinball as loss

    return forecasts(spark, d).groupBy("key").agg(*[F.avg(loss("y", F.col("slow") + F.col("sigma") * norm_ppf(p), p)).alias(q) for q, p in PIN.items()])


Z90 = norm_ppf(0.95)


@query(["key"], {"cover": 6}, sql=f"WITH {FORECASTS} SELECT key, avg((y BETWEEN slow - sigma * {Z90!r}::DOUBLE AND slow + sigma * {Z90!r}::DOUBLE)::INT) AS cover FROM fc GROUP BY key")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).select("key", "y", (F.col("slow") - F.col("sigma") * Z90).alias("lo"), (F.col("slow") + F.col("sigma") * Z90).alias("hi"))
    return f.groupBy("key").agg(scores.coverage("y", "lo", "hi").alias("cover"))


@query(["key"], {"dm": 5, "mspe": 6}, ["n"], f"""WITH {FORECASTS}, x AS (SELECT key, date, abs(y - fast) - abs(y - slow) AS d, (y - fast) ** 2 AS a, (y - slow) ** 2 AS b FROM fc), e AS (SELECT *, d - avg(d) OVER (PARTITION BY key) AS e FROM x),
 l AS (SELECT *, lag(e) OVER ({W}) AS e1, lag(e, 2) OVER ({W}) AS e2 FROM e), s AS (SELECT key, count(*) AS n, avg(d) AS m, avg(e * e) + 2 * avg(e * e1) + 2 * avg(e * e2) AS v, avg(a) / avg(b) AS mspe FROM l GROUP BY key)
 SELECT key, n, mspe, CASE WHEN n >= 8 AND v > 0 THEN m / sqrt(v / n) * sqrt((n + 1 - 6 + 6.0::DOUBLE / n) / n) END AS dm FROM s""")
def mspe_dm(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).select("key", "date", "y", "fast", "slow", F.abs(F.col("y") - F.col("fast")).alias("la"), F.abs(F.col("y") - F.col("slow")).alias("lb"))
    return scores.diebold_mariano(f, ["key"], "date", "la", "lb", 3).join(f.groupBy("key").agg(scores.mspe_ratio("y", "fast", "slow").alias("mspe")), "key")


@query(["key"], {"pt": 5, "p": 6}, ["n"], f"""WITH {FORECASTS}, s AS (SELECT key, count(*) AS n, avg(((y - anchor > 0) = (fast - anchor > 0))::INT) AS h, avg((y - anchor > 0)::INT) AS a, avg((fast - anchor > 0)::INT) AS b FROM fc GROUP BY key),
 t AS (SELECT *, a * b + (1 - a) * (1 - b) AS st FROM s), u AS (SELECT key, n, h, st, st * (1 - st) / n - (((2 * a - 1) ** 2 * b * (1 - b) + (2 * b - 1) ** 2 * a * (1 - a)) / n + 4 * a * b * (1 - a) * (1 - b) / (n::DOUBLE * n)) AS v FROM t), w AS (SELECT key, n, CASE WHEN v > 0 THEN (h - st) / sqrt(v) END AS pt FROM u)
 SELECT key, n, pt, 1 - ({hart("pt")}) AS p FROM w""")
def pt_test(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).select("key", (F.col("y") - F.col("anchor")).alias("dy"), (F.col("fast") - F.col("anchor")).alias("df"))
    return scores.pesaran_timmermann(f, ["key"], "dy", "df")


@query(["key"], {"weight": 2, "rmse": 3}, sql=f"""WITH {FORECASTS}, g AS (SELECT key, i / 100.0::DOUBLE AS weight, avg((y - (i / 100.0::DOUBLE * fast + (1 - i / 100.0::DOUBLE) * slow)) ** 2) AS mse FROM fc, (SELECT unnest(range(0, 101)) AS i) GROUP BY 1, 2)
 SELECT key, weight, sqrt(mse) AS rmse FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY mse, weight) = 1""")
def bates_granger(spark: SparkSession, d: str) -> DataFrame:
    return scores.bates_granger(forecasts(spark, d), ["key"], "y", "fast", "slow")


@query(["key"], {"q": 6}, sql=f"""WITH {FORECASTS}, r AS (SELECT key, abs(y - slow) / greatest(sigma, 1e-8) AS r FROM fc), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r) AS k, count(*) OVER (PARTITION BY key) AS n FROM r)
 SELECT key, r AS q FROM k WHERE k = least(n, ceil((n + 1) * (1 - 0.05::DOUBLE)))""")
def conformal_q(spark: SparkSession, d: str) -> DataFrame:
    return scores.conformal_quantile(forecasts(spark, d), ["key"], "y", "slow", "sigma")


@query(KEY, {"rolling_mae": 2}, sql=f"WITH {FORECASTS}, e AS (SELECT key, date, abs(y - fast) AS e FROM fc) SELECT key, date, {full('avg', 'e', 63)} AS rolling_mae FROM e")
def drift_mae(spark: SparkSession, d: str) -> DataFrame:
    return error_drift(forecasts(spark, d), OV, "y", "fast")


NU, TAU, LOC, SCALE = 0.1, 1.4, 0.05, 1.2


def su() -> tuple[Column, ...]:
    return tuple(F.lit(v) for v in (NU, TAU, LOC, SCALE))


AT, WIDTH = f"(slow + sigma * {LOC}::DOUBLE)", f"(sigma * {SCALE}::DOUBLE)"


@query(KEY, {f"{s}_{round(100 * v)}": 3 for v in scores.LEVELS for s in ("lower", "upper")}, sql=f"WITH {FORECASTS} SELECT key, date, " + ", ".join(f"{AT} + {WIDTH} * sinh(({norm_ppf(p)!r}::DOUBLE - {NU}) / {TAU}) AS {s}_{round(100 * v)}" for v in scores.LEVELS for s, p in (("lower", (1 - v) / 2), ("upper", (1 + v) / 2))) + " FROM fc")
def johnson_su_intervals(spark: SparkSession, d: str) -> DataFrame:
    return scores.with_intervals(forecasts(spark, d), "slow", "sigma", *su())


U = f"({NU} + {TAU} * asinh((y - {AT}) / {WIDTH}))"


@query(KEY, {"pit": 6}, sql=f"WITH {FORECASTS}, u AS (SELECT key, date, {U} AS u FROM fc WHERE sigma > 0) SELECT key, date, {hart('u')} AS pit FROM u")
def johnson_su_pit(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where("sigma > 0")
    return f.select("key", "date", scores.pit("y", "slow", "sigma", *su()).alias("pit"))


@query(KEY, {"log_score": 6}, sql=f"WITH {FORECASTS} SELECT key, date, -(ln({TAU} / ({WIDTH} * sqrt(1 + ((y - {AT}) / {WIDTH}) ** 2))) - {U} ** 2 / 2 - ln(sqrt(2 * pi()))) AS log_score FROM fc WHERE sigma > 0")
def log_score(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).where("sigma > 0").select("key", "date", scores.log_score("y", "slow", "sigma", *su()).alias("log_score"))


CRPS = ", ".join(f"({(k + 0.5) / 99!r}::DOUBLE, {norm_ppf((k + 0.5) / 99)!r}::DOUBLE)" for k in range(99))


@query(KEY, {"crps": 2}, sql=f"WITH {FORECASTS}, z(p, z) AS (VALUES {CRPS}), t AS (SELECT key, date, y - ({AT} + {WIDTH} * sinh((z - {NU}) / {TAU})) AS m, p FROM fc, z) SELECT key, date, sum(greatest(m * p, m * (p - 1))) * (2.0::DOUBLE / 99) AS crps FROM t GROUP BY 1, 2")
def crps_quadrature(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).select("key", "date", scores.crps_quadrature("y", "slow", "sigma", *su()).alias("crps"))


@query(["key"], {"scale": 6}, sql=f"""WITH {FORECASTS}, g AS (SELECT i, 0.5::DOUBLE + 4.5::DOUBLE * i / 99 AS s FROM (SELECT unnest(range(0, 100)) AS i)), c AS (SELECT key, s, avg((abs(y - slow) <= sigma * s * {Z90!r}::DOUBLE * (1 + 1e-12))::INT) AS c FROM fc, g GROUP BY 1, 2)
 SELECT key, coalesce(min(CASE WHEN c >= 0.9 THEN s END), 5.0::DOUBLE) AS scale FROM c GROUP BY key""")
def sigma_scale_calibration(spark: SparkSession, d: str) -> DataFrame:
    return scores.sigma_scale(forecasts(spark, d), ["key"], "y", "slow", "sigma")


TRADE = f"{FORECASTS}, tr AS (SELECT key, date, sign(fast - anchor) * ln(y / anchor) AS r FROM fc)"


def trades(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).select("key", "date", (F.signum(F.col("fast") - F.col("anchor")) * F.ln(F.col("y") / F.col("anchor"))).alias("r"))


DD = f"{TRADE}, eq AS (SELECT *, sum(r) OVER ({W} ROWS UNBOUNDED PRECEDING) AS equity FROM tr), dd AS (SELECT *, equity - max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) AS drawdown FROM eq)"


@query(KEY, {"equity": 6, "drawdown": 6}, sql=f"WITH {DD} SELECT * FROM dd")
def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return drawdown(trades(spark, d), OV, "r")


@query(["key"], {"sharpe": 5, "annualised_return": 4, "annualised_vol": 5, "max_drawdown": 5, "hit_rate": 6}, ["n_obs"], f"WITH {DD} SELECT key, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe, avg(r) * 252 AS annualised_return, stddev_samp(r) * sqrt(252) AS annualised_vol, min(drawdown) AS max_drawdown, avg((r > 0)::INT) AS hit_rate, count(r) AS n_obs FROM dd GROUP BY key")
def path_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scores.path_metrics(trades(spark, d), ["key"], "date", "r")


HALVES = list(itertools.combinations(range(6), 3))


@query([], {"pbo": 6, "mean_logit": 6}, ["splits"], f"""WITH {TRADE}, k AS (SELECT key, date, r, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS row FROM tr), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM k GROUP BY key)),
 b AS (SELECT key, row // (n // 6) AS b, count(*) AS n, sum(r) AS s1, sum(r * r) AS s2 FROM k, n WHERE row < n // 6 * 6 GROUP BY 1, 2), h(split, b, inside) AS (VALUES {", ".join(f"({i}, {x}, {x in c})" for i, c in enumerate(HALVES) for x in range(6))}),
 s AS (SELECT split, key, inside, coalesce((sum(s1) / sum(n)) / nullif(sqrt(greatest((sum(s2) - sum(s1) * sum(s1) / sum(n)) / (sum(n) - 1), 0)), 0), 0) AS sr FROM b JOIN h USING (b) GROUP BY 1, 2, 3),
 o AS (SELECT split, key, row_number() OVER (PARTITION BY split ORDER BY sr, key) AS rk, count(*) OVER (PARTITION BY split) AS c FROM s WHERE NOT inside), i AS (SELECT split, key FROM s WHERE inside QUALIFY row_number() OVER (PARTITION BY split ORDER BY sr DESC, key) = 1),
 l AS (SELECT ln((rk / (c + 1.0::DOUBLE)) / (1 - rk / (c + 1.0::DOUBLE))) AS lg FROM i JOIN o USING (split, key)) SELECT avg((lg < 0)::INT) AS pbo, avg(lg) AS mean_logit, count(*) AS splits FROM l""")
def pbo_cscv(spark: SparkSession, d: str) -> DataFrame:
    r = trades(spark, d).withColumn("row", F.row_number().over(OV.spec) - 1)
    n = r.groupBy("key").count().agg(F.min("count")).first()[0]
    rank = F.dense_rank().over(Window.orderBy("key"))  # one row a strategy
    names = r.select("key").distinct().select("key", rank.cast("int").alias("s"))
    return scores.pbo_cscv(r.join(names, "key"), "s", "row", "r", n, 6)


@query(["key"], {"dsr": 6}, sql=f"""WITH {TRADE}, m AS (SELECT key, avg(r) / stddev_samp(r) AS sr, count(*) AS n, (avg(r ** 3) - 3 * avg(r) * avg(r ** 2) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3 AS sk, (avg(r ** 4) - 4 * avg(r) * avg(r ** 3) + 6 * avg(r) ** 2 * avg(r ** 2) - 3 * avg(r) ** 4) / stddev_pop(r) ** 4 AS ku FROM tr GROUP BY key),
 x AS (SELECT *, (sr - stddev_samp(sr) OVER () * {(1 - scores.EULER) * norm_ppf(1 - 1 / 6) + scores.EULER * norm_ppf(1 - 1 / (6 * 2.718281828459045))!r}::DOUBLE) * sqrt(greatest(n - 1, 1)) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12)) AS z FROM m) SELECT key, {hart("z")} AS dsr FROM x""")
def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    m = trades(spark, d).groupBy("key").agg((F.avg("r") / F.stddev_samp("r")).alias("sr"), F.count("*").alias("n"), F.skewness("r").alias("sk"), (F.kurtosis("r") + 3).alias("ku"))
    m = m.withColumn("sd", F.stddev_samp("sr").over(Window.partitionBy(F.lit(0))))
    return m.select("key", scores.deflated_sharpe(F.col("sr"), F.col("sd"), 6, F.col("n"), F.col("sk"), F.col("ku")).alias("dsr"))


@query([], {"d": 6}, ["n"], f"WITH {FORECASTS}, u AS (SELECT {U} AS u FROM fc WHERE sigma > 0 AND {ALL}), p AS (SELECT {hart('u')} AS p FROM u), k AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p) SELECT max(n) AS n, max(greatest(k::DOUBLE / n - p, p - (k - 1)::DOUBLE / n)) AS d FROM k")
def pit_ks(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where(f"sigma > 0 and {ALL}")
    return scores.ks_uniform(f.select(scores.pit("y", "slow", "sigma", *su()).alias("p")), "p")


HAR = f"{BARS}, rv AS (SELECT key, date, abs(ln(close / lag(close) OVER ({W}))) AS rv FROM bars), h1 AS (SELECT *, lag(rv) OVER ({W}) AS har_1 FROM rv), h AS (SELECT key, date, rv, har_1, {full('avg', 'har_1', 5)} AS har_5, {full('avg', 'har_1', 22)} AS har_22 FROM h1)"


def realised(spark: SparkSession, d: str) -> DataFrame:
    return log_returns(spark, d).select("key", "date", F.abs("r").alias("rv"))


@query(KEY, {"har_1": 6, "har_5": 6, "har_22": 6}, sql=f"WITH {HAR} SELECT key, date, har_1, har_5, har_22 FROM h WHERE rv IS NOT NULL")
def har_features(spark: SparkSession, d: str) -> DataFrame:
    return volatility.har_rows(realised(spark, d), ["key"], "date", "rv")


@query(["key"], {f"b{i}": 5 for i in range(4)}, ["n"], f"""WITH {HAR}, s AS (SELECT key, count(*) AS n, avg(rv) AS my, avg(har_1) AS m1, avg(har_5) AS m2, avg(har_22) AS m3, var_pop(har_1) AS a, covar_pop(har_1, har_5) AS b, covar_pop(har_1, har_22) AS c, var_pop(har_5) AS d,
  covar_pop(har_5, har_22) AS e, var_pop(har_22) AS f, covar_pop(har_1, rv) AS p, covar_pop(har_5, rv) AS q, covar_pop(har_22, rv) AS r FROM h WHERE har_22 IS NOT NULL AND rv IS NOT NULL GROUP BY key),
 t AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s),
 u AS (SELECT *, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS b1, (a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - q * c)) / det AS b2, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - c * d)) / det AS b3 FROM t)
 SELECT key, n, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, b1, b2, b3 FROM u""")
def har_ols(spark: SparkSession, d: str) -> DataFrame:
    found = volatility.har_fit(realised(spark, d), ["key"], "date", "rv")
    return found.select("key", "n", *[F.element_at("beta", i + 1).alias(f"b{i}") for i in range(4)])


# ---- fitted models: rows only here, held to their properties in tests

@query(KEY, {"sigma_garch": 6})
def garch_sigma(spark: SparkSession, d: str) -> DataFrame:
    return volatility.conditional_sigma(log_returns(spark, d), ["key"], "date", "r", "garch")


@query(["key"], {"nu": 4, "tau": 4, "loc": 4, "scale": 4}, ["n"])
def johnson_su_fit(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where("sigma > 0").select("key", ((F.col("y") - F.col("slow")) / F.col("sigma")).alias("z"))
    return johnson_su_fits(f, ["key"], "z")


def _gram(spark: SparkSession, d: str) -> tuple[DataFrame, gam.Gram]:
    r, names = model_rows(spark, d)
    return r, gam.gram(r, gam.terms_for(r, names), "y")


@query(["term"], {"p": 4, "edof": 3, "lam": 4, "gcv": 6, "r2": 5})
def gam_fit(spark: SparkSession, d: str) -> DataFrame:
    found = gam.fit(_gram(spark, d)[1])
    return spark.createDataFrame([(t.name, p, found.edof, found.lam, found.gcv, float(found.r2)) for t, p in zip(found.terms, found.p_values, strict=True)], "term string, p double, edof double, lam double, gcv double, r2 double")


@query(["term"], {"aic": 3, "bic": 3})
def gam_stepwise(spark: SparkSession, d: str) -> DataFrame:
    found, _ = gam.stepwise(_gram(spark, d)[1], [0.1, 1.0, 10.0, 100.0], "bic")
    return spark.createDataFrame([(t.name, found.aic, found.bic) for t in found.terms], "term string, aic double, bic double")


@query(["bag"], {"intercept": 6, "rss": 6})
def bagged_gam(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    fits = gam.bagged(r, gam.terms_for(r, names), "y", "row_pos", 3, 10.0)
    return spark.createDataFrame([(i, float(f.beta[0]), f.rss) for i, f in enumerate(fits)], "bag int, intercept double, rss double")


@query(["level"], {"below": 3})
def expectile_gam(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    terms, out = gam.terms_for(r, names), []
    for level in (0.1, 0.9):
        scored = gam.predict(r, gam.expectile(r, terms, "y", level, 10.0), "mu")
        out.append((level, float(scored.agg(F.avg((F.col("y") <= F.col("mu")).cast("double"))).first()[0])))
    return spark.createDataFrame(out, "level double, below double")


@query(["date", "model_version"], {c: 2 for c in ("y_true", "y_pred", "y_anchor", "lower_90", "upper_90")} | {"sigma_model": 5})
def walk_forward_backtest(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    return backtest.walk_forward(r, r.count(), gam.terms_for(r, names), backtest.WalkForward(refit=126, test=126))


@query(["path"], {"sharpe": 4, "max_drawdown": 4, "hit_rate": 4}, ["n_obs"])
def cpcv_backtest(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    return backtest.cpcv_backtest(r, r.count(), backtest.ridge_factory(), names, 6, 2).path_metrics


@query(["date", "target_date"], {"price": 2, "low": 2, "high": 2})
def next_day_forecast(spark: SparkSession, d: str) -> DataFrame:
    r, m = _gram(spark, d)
    return backtest.next_day_forecast(r.orderBy(F.col("date").desc()).limit(1), gam.fit(m))


@query([], {"x": 4, "mu": 6})
def what_if(spark: SparkSession, d: str) -> DataFrame:
    r, m = _gram(spark, d)
    term = next(t for t in m.terms if t.name == "x_fast")
    return backtest.what_if(r.orderBy(F.col("date").desc()).limit(1), gam.fit(m), "x_fast", term.low, term.high)


@query([], {"x": 4, "effect": 6, "low": 6, "high": 6})
def partial_dependence(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(gam.partial_dependence(gam.fit(_gram(spark, d)[1]), "x_fast"), "x double, effect double, low double, high double")


def _losses(spark: SparkSession, d: str) -> DataFrame:
    """(at, anchor, fast, slow): absolute errors of the whole series, rows numbered in order of date."""
    f = forecasts(spark, d).where(ALL)
    return f.select((F.row_number().over(Window.partitionBy("key").orderBy("date")) - 1).alias("at"), *[F.abs(F.col("y") - F.col(c)).alias(c) for c in ("anchor", "fast", "slow")])


@query(["model", "kept"], {"p": 3})
def mcs(spark: SparkSession, d: str) -> DataFrame:
    names = ["anchor", "fast", "slow"]
    _, mean, draws = scores.bootstrap_table(_losses(spark, d), "at", names)
    kept, p = scores.confidence_set(mean, draws)
    return spark.createDataFrame([(name, i in kept, float(p[i])) for i, name in enumerate(names)], "model string, kept boolean, p double")


@query(["kind"], {"p": 3})
def spa(spark: SparkSession, d: str) -> DataFrame:
    gains = _losses(spark, d).select("at", *[(F.col("anchor") - F.col(c)).alias(c) for c in ("fast", "slow")])
    return spark.createDataFrame(list(scores.spa_p_values(*scores.bootstrap_table(gains, "at", ["fast", "slow"])).items()), "kind string, p double")


@query([], {"lr": 3, "p": 6})
def berkowitz(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where(f"sigma > 0 and {ALL}").select("date", (F.lit(NU) + TAU * F.asinh((F.col("y") - F.col("slow")) / F.col("sigma"))).alias("z"))
    lr, p = scores.berkowitz_moments(f, "date", "z")
    return spark.createDataFrame([(lr, p)], "lr double, p double")



QS = (0.05, 0.1, 0.5, 0.9, 0.95)


def _su(p: float) -> str:
    return f"({AT} + {WIDTH} * sinh(({norm_ppf(p)!r}::DOUBLE - {NU}) / {TAU}))"


@query(["key"], {f"pinball_q{round(p * 100):02d}": 2 for p in QS} | {f"coverage_{round(100 * v)}": 6 for v in scores.LEVELS} | {"log_score": 6, "directional_accuracy": 6}, sql=f"WITH {FORECASTS} SELECT key, " + ", ".join(f"avg(greatest((y - {_su(p)}) * {p}, (y - {_su(p)}) * ({p} - 1))) AS pinball_q{round(p * 100):02d}" for p in QS) + ", " + ", ".join(f"avg((y >= {_su((1 - v) / 2)} AND y <= {_su((1 + v) / 2)})::INT) AS coverage_{round(100 * v)}" for v in scores.LEVELS) + f", avg(-(ln({TAU} / ({WIDTH} * sqrt(1 + ((y - {AT}) / {WIDTH}) ** 2))) - {U} ** 2 / 2 - ln(sqrt(2 * pi())))) AS log_score, avg((sign(y - anchor) = sign(slow - anchor))::INT) AS directional_accuracy FROM fc WHERE sigma > 0 GROUP BY key")
def probabilistic_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.probabilistic_scores(forecasts(spark, d), ["key"], "y", "slow", "sigma", "anchor", *su())


@query(["i"], {"x": 2, "density": 9}, sql=f"WITH {FORECASTS}, l AS (SELECT * FROM fc WHERE {ALL} AND sigma > 0 ORDER BY date DESC LIMIT 1), g AS (SELECT CAST(i AS INTEGER) AS i, slow, sigma, slow + sigma * (i * 0.1::DOUBLE - 4) AS x FROM l, (SELECT unnest(range(0, 81)) AS i)) SELECT i, x, exp(ln({TAU} / ({WIDTH} * sqrt(1 + ((x - {AT}) / {WIDTH}) ** 2))) - ({NU} + {TAU} * asinh((x - {AT}) / {WIDTH})) ** 2 / 2 - ln(sqrt(2 * pi()))) AS density FROM g")
def predictive_density(spark: SparkSession, d: str) -> DataFrame:
    last = forecasts(spark, d).where(f"{ALL} and sigma > 0").orderBy(F.col("date").desc()).limit(1)
    return scores.predictive_density(last, "slow", "sigma", *su())


@query(["fold"], {"rmse": 6, "mae": 6, "r2": 5, "lam": 4})
def gam_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    found = backtest.cross_validate(r, r.count(), gam.terms_for(r, names), "y")
    return spark.createDataFrame([(f["fold"], f["rmse"], f["mae"], f["r2"], f["lam"]) for f in found], "fold int, rmse double, mae double, r2 double, lam double")


@query(["term"], {"p": 4, "edof": 3})
def sigma_gam(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    terms = gam.terms_for(r, names)
    found = backtest.sigma_fit(r, terms, "y", gam.fit(gam.gram(r, terms, "y")), ["x_vol", "x_return"])
    return spark.createDataFrame([(t.name, float(p), float(found.edof)) for t, p in zip(found.terms, found.p_values, strict=True)], "term string, p double, edof double")


@query([], {c: 4 for c in ("mae", "rmse", "mae_naive", "skill_mae", "skill_rmse", "coverage_90", "directional_accuracy")})
def walk_forward_scores(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    return scores.backtest_scores(backtest.walk_forward(r, r.count(), gam.terms_for(r, names), backtest.WalkForward(refit=252, test=252)))


@query(["key"], {"mspe_ratio": 6, "dm_stat": 5, "pt_stat": 5, "pt_pvalue": 6}, ["n"], f"""WITH {FORECASTS}, x AS (SELECT key, (y - slow) ** 2 AS a, (y - anchor) ** 2 AS b FROM fc), e AS (SELECT *, a - b AS d, a - b - avg(a - b) OVER (PARTITION BY key) AS e FROM x),
 dm AS (SELECT key, count(*) AS n, avg(a) / avg(b) AS mspe_ratio, CASE WHEN count(*) >= 8 AND avg(e * e) > 0 THEN avg(d) / sqrt(avg(e * e) / count(*)) * sqrt((count(*) - 1.0::DOUBLE) / count(*)) END AS dm_stat FROM e GROUP BY key),
 s AS (SELECT key, count(*) AS n, avg(((y - anchor > 0) = (slow - anchor > 0))::INT) AS h, avg((y - anchor > 0)::INT) AS a, avg((slow - anchor > 0)::INT) AS b FROM fc GROUP BY key), t AS (SELECT *, a * b + (1 - a) * (1 - b) AS st FROM s),
 u AS (SELECT key, n, h, st, st * (1 - st) / n - (((2 * a - 1) ** 2 * b * (1 - b) + (2 * b - 1) ** 2 * a * (1 - a)) / n + 4 * a * b * (1 - a) * (1 - b) / (n::DOUBLE * n)) AS v FROM t), w AS (SELECT key, CASE WHEN v > 0 THEN (h - st) / sqrt(v) END AS pt_stat FROM u)
 SELECT key, n, mspe_ratio, dm_stat, pt_stat, 1 - ({hart("pt_stat")}) AS pt_pvalue FROM dm JOIN w USING (key)""")
def benchmark_tests(spark: SparkSession, d: str) -> DataFrame:
    return scores.benchmark_tests(forecasts(spark, d), ["key"], "date", "y", "slow", "anchor", "anchor")


@query([], {"w_model": 2, "w_naive": 2, "rmse_combined": 3, "rmse_model": 3, "rmse_naive": 3, "skill_vs_model": 6, "skill_vs_naive": 6}, sql=f"""WITH {FORECASTS}, g AS (SELECT i / 100.0::DOUBLE AS w, avg((y - (i / 100.0::DOUBLE * slow + (1 - i / 100.0::DOUBLE) * anchor)) ** 2) AS mse FROM fc, (SELECT unnest(range(0, 101)) AS i) WHERE {ALL} GROUP BY 1),
 b AS (SELECT w, sqrt(mse) AS r FROM g ORDER BY mse, w LIMIT 1), o AS (SELECT sqrt(avg((y - slow) ** 2)) AS m, sqrt(avg((y - anchor) ** 2)) AS n FROM fc WHERE {ALL})
 SELECT w AS w_model, 1 - w AS w_naive, r AS rmse_combined, m AS rmse_model, n AS rmse_naive, 1 - r / m AS skill_vs_model, 1 - r / n AS skill_vs_naive FROM b, o""")
def combination_weights(spark: SparkSession, d: str) -> DataFrame:
    path = forecasts(spark, d).where(ALL).select("date", F.col("y").alias("y_true"), F.col("slow").alias("y_pred"), F.col("anchor").alias("y_anchor"))
    found = backtest.weights_from_path(path)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


QQ = ", ".join(f"({i}, {(i + 0.5) / 99!r}::DOUBLE, {norm_ppf((i + 0.5) / 99)!r}::DOUBLE)" for i in range(99))


@query(["key", "i"], {"p": 9, "normal": 2, "residual": 2}, sql=f"WITH {FORECASTS}, e AS (SELECT key, y - slow AS e FROM fc), m AS (SELECT key, avg(e) AS m, stddev_samp(e) AS s, quantile_cont(e, [{', '.join(f'{(i + 0.5) / 99!r}::DOUBLE' for i in range(99))}]) AS q FROM e GROUP BY key), z(i, p, z) AS (VALUES {QQ}) SELECT key, CAST(i AS INTEGER) AS i, p, m + s * z AS normal, q[i + 1] AS residual FROM m, z")
def residual_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return scores.residual_quantiles(forecasts(spark, d), ["key"], "y", "slow")


@query(["key", "bin"], {"low": 3, "high": 3, "density": 12, "normal": 12}, sql=f"""WITH {FORECASTS}, e AS (SELECT key, y - slow AS e FROM fc), s AS (SELECT key, min(e) AS a, max(e) AS b, avg(e) AS m, stddev_samp(e) AS d, count(*) AS c FROM e GROUP BY key),
 h AS (SELECT key, CAST(least(floor((e - a) / ((b - a) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM e JOIN s USING (key) GROUP BY 1, 2), r AS (SELECT *, a + bin * ((b - a) / 50) AS low, a + (bin + 1) * ((b - a) / 50) AS high FROM h JOIN s USING (key))
 SELECT key, bin, low, high, n / (c * (high - low)) AS density, exp(0 - ((low + high) / 2 - m) ** 2 / (2 * d * d)) / (d * sqrt(2 * pi())) AS normal FROM r""")
def residual_density(spark: SparkSession, d: str) -> DataFrame:
    return scores.residual_density(forecasts(spark, d), ["key"], "y", "slow")


@query(["series", "ref_date", "avail_date"], {"value": 9}, sql=f"WITH {MONTHLY}, l(series, days) AS (VALUES ('unemployment', 38), ('igrea', 45), ('nfci', 7), ('usd_index', 0), ('of_our_own', 0)) SELECT series, ref_date, ref_date + CAST(days AS INTEGER) AS avail_date, value FROM monthly, l")
def macro_publication(spark: SparkSession, d: str) -> DataFrame:
    names = F.explode(F.array(*[F.lit(n) for n in ("unemployment", "igrea", "nfci", "usd_index", "of_our_own")])).alias("series")
    return asof.published_series(monthly_macro(spark, d).select(names, "ref_date", "value"))


@query(KEY, {"close": 2}, sql=f"WITH {BARS}, r AS (SELECT key, date, close, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS k FROM bars WHERE date >= DATE '1995-06-01' AND date <= DATE '2000-12-31') SELECT key, date, close FROM r WHERE k <= 20")
def recent_rows(spark: SparkSession, d: str) -> DataFrame:
    return asof.last_rows(asof.date_range(bars(spark, d).select("key", "date", "close"), "date", "1995-06-01", "2000-12-31"), ["key"], "date", 20)


@query(["source"], {k: 4 for k in ("mspe_ratio", "directional_accuracy", "crps_model", "log_score_model", "coverage_95", "skill_rmse")})
def sigma_gate(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    found = backtest.sigma_gate(r, r.count(), gam.terms_for(r, names, 8), backtest.WalkForward(refit=252, test=252))
    kept = ("mspe_ratio", "directional_accuracy", "crps_model", "log_score_model", "coverage_95", "skill_rmse")
    return spark.createDataFrame([(s, *(v[k] for k in kept)) for s, v in found.items()], "source string, " + ", ".join(f"{k} double" for k in kept))


@query(["model", "term"], {"p": 4, "edof": 3})
def distributional_models(spark: SparkSession, d: str) -> DataFrame:
    r, names = model_rows(spark, d)
    terms = gam.terms_for(r, names, 8)
    found = distributional(r, ["key"], "date", terms, "y", gam.fit(gam.gram(r, terms, "y")), [0.1, 1.0, 10.0, 100.0], refits=1)
    rows = [(name, t.name, float(p), float(getattr(found, name).edof)) for name in ("mu", "sigma", "nu", "tau") for t, p in zip(getattr(found, name).terms, getattr(found, name).p_values, strict=True)]
    return spark.createDataFrame(rows, "model string, term string, p double, edof double")


@query([], {"share": 2, "x": 4, "mu": 6})
def what_if_scenarios(spark: SparkSession, d: str) -> DataFrame:
    r, m = _gram(spark, d)
    return backtest.what_if_scenarios(r.orderBy(F.col("date").desc()).limit(1), gam.fit(m), "x_fast")


@query(["date", "target_date"], {"price": 2, "low": 2, "high": 2, "pi_multiplier": 4, "weight": 2, "combined": 2})
def trained_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The whole run from features to the next forecast."""
    r, names = model_rows(spark, d)
    return runner.train(r.select("key", "date", "close", *names), names, "close", {"max_terms": 4, "n_splines": 10, "bags": 3, "refit_rows": 252, "sigma_source": "blend", "refits": 1}).forecast


@query(["key", "date"], {"rolling_mae": 2, "rolling_mae_naive": 2, "threshold": 2}, ["drifted"], f"""WITH {FORECASTS}, r AS (SELECT key, date, {full("avg", "abs(y - fast)", 63)} AS m, {full("avg", "abs(y - anchor)", 63)} AS n FROM fc),
 t AS (SELECT key, quantile_cont(m, 0.95) AS threshold FROM r GROUP BY key) SELECT r.key, r.date, m AS rolling_mae, n AS rolling_mae_naive, threshold, coalesce((m > threshold)::INT, 0) AS drifted FROM r JOIN t USING (key)""")
def drift_monitor(spark: SparkSession, d: str) -> DataFrame:
    return watched(forecasts(spark, d), Over(["key"], "date"), "y", "fast", "anchor").withColumn("drifted", F.coalesce(F.col("drifted").cast("int"), F.lit(0)))


_SMALL = " + ".join(f"exp({-k * k * math.pi**2 / 8!r}::DOUBLE / (x * x))" for k in (1, 3, 5, 7))
_LARGE = " + ".join(f"{2.0 * (-1) ** (k - 1)!r}::DOUBLE * exp({-2.0 * k * k!r}::DOUBLE * x * x)" for k in range(1, 6))


@query(["key"], {"d": 6, "pit_p": 6}, ["n"], f"""WITH {FORECASTS}, u AS (SELECT key, {U} AS u FROM fc WHERE sigma > 0), p AS (SELECT key, {hart("u")} AS p FROM u),
 k AS (SELECT key, p, row_number() OVER (PARTITION BY key ORDER BY p) AS k, count(*) OVER (PARTITION BY key) AS n FROM p),
 s AS (SELECT key, max(n) AS n, max(greatest(k::DOUBLE / n - p, p - (k - 1)::DOUBLE / n)) AS d FROM k GROUP BY key), t AS (SELECT *, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * d AS x FROM s)
 SELECT key, n, d, CASE WHEN x <= 0.04 THEN 1.0 ELSE least(greatest(CASE WHEN x < 1 THEN 1 - {math.sqrt(2 * math.pi)!r}::DOUBLE / x * ({_SMALL}) ELSE {_LARGE} END, 0), 1) END AS pit_p FROM t""")
def pit_tests(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where("sigma > 0")
    return scores.ks_by_key(f.select("key", scores.pit("y", "slow", "sigma", *su()).alias("p")), ["key"], "p")


@query(["key", "i"], {"x": 6, "price": 2, "price_density": 9}, sql=f"""WITH {FORECASTS}, l AS (SELECT key, anchor, ln(slow / anchor) AS mu, sigma / anchor AS s FROM fc WHERE sigma > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY date DESC) = 1),
 g AS (SELECT *, unnest(range(0, 81))::INT AS i FROM l), x AS (SELECT *, mu + s * (i * {8.0 / 80!r}::DOUBLE - 4.0::DOUBLE) AS x FROM g), z AS (SELECT *, (x - (mu + s * {LOC!r}::DOUBLE)) / (s * {SCALE!r}::DOUBLE) AS z FROM x)
 SELECT key, i, x, anchor * exp(x) AS price, exp(ln({TAU} / (s * {SCALE!r}::DOUBLE * sqrt(1 + z * z))) - ({NU} + {TAU} * asinh(z)) ** 2 / 2 - ln(sqrt(2 * pi()))) / (anchor * exp(x)) AS price_density FROM z""")
def price_densities(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d).where("sigma > 0")
    last = f.groupBy("key").agg(F.max_by(F.struct("anchor", "slow", "sigma"), "date").alias("r")).select("key", "r.*")
    last = last.select("key", "anchor", F.ln(F.col("slow") / F.col("anchor")).alias("mu"), (F.col("sigma") / F.col("anchor")).alias("s"))
    return scores.price_density(scores.predictive_density(last, "mu", "s", *su()), "anchor")


@query(["key"], {f"coverage_{n}": 6 for n in (50, 80, 90, 95)}, sql=f"""WITH {FORECASTS}, c AS (SELECT * FROM ({ORACLES["sigma_scale_calibration"]})) SELECT fc.key, """ + ", ".join(f"avg((abs(y - slow) <= {norm_ppf((1 + n / 100) / 2)!r}::DOUBLE * sigma * scale)::INT) AS coverage_{n}" for n in (50, 80, 90, 95)) + " FROM fc JOIN c USING (key) GROUP BY fc.key")
def scaled_coverage(spark: SparkSession, d: str) -> DataFrame:
    f = forecasts(spark, d)
    scales = scores.sigma_scale(f, ["key"], "y", "slow", "sigma").withColumn("scale", F.round("scale", 6))
    wide = scores.scaled_intervals(f, ["key"], "slow", "sigma", scales)
    return wide.groupBy("key").agg(*[scores.coverage("y", f"lower_{n}", f"upper_{n}").alias(f"coverage_{n}") for n in (50, 80, 90, 95)])


@query(["key", "term"], {"edof": 3, "lam": 4, "r2": 5}, ["n"])
def panel_gam(spark: SparkSession, d: str) -> DataFrame:
    """A model for each series, all in one pass."""
    b = bars(spark, d)
    w = Over(["key"], "date")
    rows = add(b, {"y": F.ln(w.lead("close") / F.col("close")), "x_fast": F.col("close") / w.mean("close", 5) - 1, "x_slow": F.col("close") / w.mean("close", 20) - 1}).where("y is not null and x_slow is not null")
    terms = gam.terms_for(rows, ["x_fast", "x_slow"])
    fits = panels.panel_fits(rows, ["key"], terms, "y")
    return fits.select("key", F.explode(F.array(*[F.lit(t.name) for t in terms])).alias("term"), "edof", "lam", "r2", "n")


@query(["key"], {"adf": 5}, ["n", "lags"], f"""WITH {BARS}, d AS (SELECT key, close - lag(close) OVER ({W}) AS y, lag(close) OVER ({W}) AS x FROM bars),
 s AS (SELECT key, count(*) AS m, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d WHERE y IS NOT NULL GROUP BY key)
 SELECT key, m + 1 AS n, 0 AS lags, b / sqrt((syy - b * sxy) / (m - 2) / sxx) AS adf FROM s""")
def dickey_fuller(spark: SparkSession, d: str) -> DataFrame:
    """The unit-root statistic without lags, of every series at once."""
    return panels.unit_root_tests(bars(spark, d), ["key"], "date", "close", 0)


@query(["key"], {"adf": 4}, ["n", "lags"])
def unit_roots(spark: SparkSession, d: str) -> DataFrame:
    """The same with lags chosen by AIC."""
    return panels.unit_root_tests(bars(spark, d), ["key"], "date", "close")
