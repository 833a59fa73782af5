"""Descriptive statistics: correlations, histograms, quantile transforms, autocorrelation, decomposition, unit roots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Over, ratio
from .moments import column_moments, correlation_matrix, pair_table


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) of every pair of columns, over the rows that have both; null for a constant.  One pass, whatever the number of columns."""
    return pair_table(column_moments(df, columns), columns).select("a", "b", "rho")


def collinearity_prune(df: DataFrame, columns: list[str], order: str, threshold: float = 0.97, last: int | None = None) -> list[str]:
    """Columns kept from left to right: not constant, and not correlated beyond the threshold with one kept before.

    Correlations are of all rows, or of the last ones by `order` (Pearson), from one pass.
    """
    recent = df.orderBy(F.col(order).desc()).limit(last) if last else df
    rho = np.abs(correlation_matrix(recent, columns))
    kept: list[int] = []
    for i in range(len(columns)):
        if not np.isnan(rho[i, i]) and not (rho[i, kept] > threshold).any():
            kept.append(i)
    return [columns[i] for i in kept]


def histogram(df: DataFrame, keys: list[str], c: str, bins: int) -> DataFrame:
    """(keys, bin, low, high, n): equal-width bins from minimum to maximum, the last closed; empty bins are absent."""
    span = df.where(F.col(c).isNotNull()).groupBy(*keys).agg(F.min(c).alias("_a"), F.max(c).alias("_b"))
    rows = df.where(F.col(c).isNotNull()).select(*keys, c).join(span, keys)
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col("_a"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    out = rows.groupBy(*keys, at.alias("bin"), "_a", "_b").agg(F.count("*").alias("n"))
    return out.select(*keys, "bin", (F.col("_a") + F.col("bin") * width).alias("low"), (F.col("_a") + (F.col("bin") + 1) * width).alias("high"), "n")


def quantile_knots(df: DataFrame, keys: list[str], c: str, n_quantiles: int) -> DataFrame:
    """(keys, knots): exact quantiles of a column at even levels."""
    levels = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    return df.groupBy(*keys).agg(F.percentile(c, F.array(*[F.lit(q) for q in levels])).alias("knots"))


def quantile_rank(df: DataFrame, knots: DataFrame, keys: list[str], c: str, out: str) -> DataFrame:
    """df with the column's place among the knots in [0, 1]: linear between knots, in the middle of equal ones."""
    rows = df.join(F.broadcast(knots) if not keys else knots, keys) if keys else df.crossJoin(F.broadcast(knots))  # one row without keys
    x, n = F.col(c), F.size("knots")
    below = F.size(F.filter("knots", lambda k: k < x))
    upto = F.size(F.filter("knots", lambda k: k <= x))
    get = lambda i: F.element_at("knots", i)
    inner = (below - 1 + ratio(x - get(F.greatest(below, F.lit(1))), get(F.least(below + 1, n)) - get(F.greatest(below, F.lit(1))))) / (n - 1)
    value = F.when(x.isNull(), None).when(upto > below, (below + upto - 1) / F.lit(2.0) / (n - 1)).when(below == 0, 0.0).when(below == n, 1.0).otherwise(inner)
    return rows.withColumn(out, value).drop("knots")


def autocorrelation(df: DataFrame, keys: list[str], order: str, c: str, lags: int) -> DataFrame:
    """(keys, lag, n, acf, q): autocorrelation and the Ljung-Box statistic up to each lag."""
    w, whole = Over(keys, order), Window.partitionBy(*keys)
    rows = df.where(F.col(c).isNotNull()).select(*keys, order, (F.col(c) - F.avg(c).over(whole)).alias("e"))
    rows = rows.select(*keys, "e", *[w.lag("e", k).alias(f"e{k}") for k in range(1, lags + 1)])
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("c0"), *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    listed = sums.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), ratio(f"c{k}", "c0").alias("acf")) for k in range(1, lags + 1)])).alias("x"))
    part = F.col("x.acf") * F.col("x.acf") / (F.col("n") - F.col("x.lag"))
    q = F.sum(part).over(Window.partitionBy(*keys).orderBy("x.lag")) * F.col("n") * (F.col("n") + 2)
    return listed.select(*keys, F.col("x.lag").alias("lag"), "n", F.col("x.acf").alias("acf"), q.alias("q"))


def partial_autocorrelation(acf: list[float]) -> list[float]:
    """Partial autocorrelations from those at lags 1, 2, ... by the Durbin-Levinson recursion."""
    phi, out = np.zeros(0), []
    for k in range(len(acf)):
        r = np.array(acf[:k])
        bottom = 1 - float(phi @ r)
        last = (acf[k] - float(phi @ r[::-1])) / bottom if abs(bottom) > 1e-15 else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return out


def decompose(df: DataFrame, keys: list[str], order: str, c: str, period: int = 252) -> DataFrame:
    """df with trend (centred mean over a period), seasonal (mean deviation by phase, centred) and residual."""
    w = Window.partitionBy(*keys).orderBy(order)
    half = period // 2
    rows = df.withColumn("_n", F.row_number().over(w) - 1)
    if period % 2:
        frame = w.rowsBetween(-half, half)
        trend = F.when(F.count(c).over(frame) == period, F.avg(c).over(frame))
    else:
        a, b = w.rowsBetween(-half, half - 1), w.rowsBetween(1 - half, half)
        full = (F.count(c).over(a) == period) & (F.count(c).over(b) == period)
        trend = F.when(full, (F.avg(c).over(a) + F.avg(c).over(b)) / 2)
    rows = rows.withColumn("trend", trend).withColumn("_phase", F.col("_n") % period)
    phase = rows.groupBy(*keys, "_phase").agg(F.avg(F.col(c) - F.col("trend")).alias("_m"))
    phase = phase.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(*keys))).drop("_m")
    out = rows.join(phase, [*keys, "_phase"], "left")
    return out.withColumn("residual", F.col(c) - F.col("trend") - F.col("seasonal")).drop("_n", "_phase")


def kpss_statistic(df: DataFrame, keys: list[str], order: str, c: str, lags: int) -> DataFrame:
    """(keys, n, kpss): the level-stationarity statistic with a Bartlett long-run variance of fixed lag."""
    w, whole = Over(keys, order), Window.partitionBy(*keys)
    rows = df.where(F.col(c).isNotNull()).select(*keys, order, (F.col(c) - F.avg(c).over(whole)).alias("e"))
    rows = rows.select(*keys, "e", w.running(F.sum, "e").alias("s"), *[w.lag("e", k).alias(f"e{k}") for k in range(1, lags + 1)])
    lrv = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        lrv = lrv + 2 * (1 - k / (lags + 1)) * F.sum(F.col("e") * F.col(f"e{k}"))
    n = F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n"), ratio(F.sum(F.col("s") * F.col("s")), lrv * n).alias("kpss"))


#: MacKinnon's 1 %, 5 % and 10 % points of the unit-root test with a constant, and KPSS's 10 %, 5 %, 2.5 % and 1 % points.
ADF_POINTS = {0.01: (-3.43035, -6.5393, -16.786), 0.05: (-2.86154, -2.8903, -4.234), 0.10: (-2.56677, -1.5384, -2.809)}
KPSS_POINTS = {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}


def adf(x: np.ndarray, max_lag: int | None = None) -> tuple[float, int]:
    """The t statistic of the level in a regression of changes on a constant, the level and lagged changes; lags by AIC."""
    n, x = len(x), x - x.mean()  # a level far from 0 would leave the products no digits; the statistic doesn't depend on it
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)) if max_lag is None else max_lag, n // 2 - 3)
    dx = np.diff(x)
    best: tuple[float, float, int] | None = None

    def run(p: int, skip: int) -> tuple[float, float]:
        y = dx[skip:]
        m = np.column_stack([np.ones(len(y)), x[skip:-1], *[dx[skip - j : len(dx) - j] for j in range(1, p + 1)]])
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        e = y - m @ beta
        s2 = float(e @ e) / max(len(y) - m.shape[1], 1)
        t = beta[1] / np.sqrt(s2 * np.linalg.pinv(m.T @ m)[1, 1])
        return float(t), len(y) * np.log(float(e @ e) / len(y) + 1e-300) + 2 * m.shape[1]

    for p in range(most + 1):
        t, aic = run(p, most)
        if best is None or aic < best[0]:
            best = (aic, t, p)
    return run(best[2], best[2])[0], best[2]


def stationarity(df: DataFrame, keys: list[str], order: str, c: str, least: int = 50, last: int | None = None) -> DataFrame:
    """(keys, n, adf, adf_reject, kpss, kpss_reject, verdict) at 5 %, on each key's rows, or its last ones.

    Verdicts: stationary, non_stationary_I1, trend_or_break, inconclusive, insufficient_data.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values(order)[c].dropna().to_numpy(float)[-last if last else 0 :]
        head = f[keys].iloc[:1].reset_index(drop=True)
        if len(x) < least or x.std() == 0:
            return head.assign(n=len(x), adf=None, adf_reject=None, kpss=None, kpss_reject=None, verdict="insufficient_data")
        t, _ = adf(x)
        a, b, d = ADF_POINTS[0.05]
        rejects = bool(t < a + b / len(x) + d / len(x) ** 2)
        e = x - x.mean()
        lags = int(np.ceil(12 * (len(x) / 100) ** 0.25))
        lrv = float(e @ e) + 2 * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) for k in range(1, lags + 1))
        stat = float((np.cumsum(e) ** 2).sum() / (lrv * len(x))) if lrv > 0 else float("inf")
        breaks = stat > KPSS_POINTS[0.05]
        verdict = {(True, False): "stationary", (False, True): "non_stationary_I1", (True, True): "trend_or_break", (False, False): "inconclusive"}[rejects, breaks]
        return head.assign(n=len(x), adf=t, adf_reject=rejects, kpss=stat, kpss_reject=breaks, verdict=verdict)

    kinds = dict(df.dtypes)
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, adf double, adf_reject boolean, kpss double, kpss_reject boolean, verdict string"
    return df.groupBy(*keys).applyInPandas(run, shape)


def naive_table(df: DataFrame, keys: list[str], order: str, y: str, forecasts: list[str]) -> DataFrame:
    """(keys, model, mae, rmse, mape) of forecasts and of yesterday's value."""
    from .scores import point_metrics

    rows = df.withColumn("naive", Over(keys, order).lag(y))
    long = rows.select(*keys, y, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("f")) for m in [*forecasts, "naive"]])).alias("x"))
    long = long.select(*keys, y, "x.model", "x.f")
    return long.groupBy(*keys, "model").agg(*[c.alias(n) for n, c in point_metrics(y, "f").items()])
