"""Conditional volatility: EWMA, GARCH(1,1) and heterogeneous autoregression, one key per task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Over
from ..functions.special import nelder_mead
from .features import add
from .scan import Scan, ewma_sigma, ordered_scan


def garch_filter(r: np.ndarray, omega: float, alpha: float, beta: float) -> tuple[np.ndarray, float]:
    """Variances before each row, and the next one."""
    v = np.concatenate([[r.var() or 1e-12], omega + alpha * r * r])
    step, keep = 1, beta
    while step < len(v) and keep > 1e-300:  # v[t] = beta * v[t - 1] + ..., its terms summed in spans that double
        v[step:] = v[step:] + keep * v[:-step]
        step, keep = 2 * step, keep * keep
    return v[:-1], float(v[-1])


def fit_garch(r: np.ndarray) -> tuple[float, float, float] | None:
    """(omega, alpha, beta) of a zero-mean GARCH(1,1) by Gaussian likelihood; None under 100 finite rows or without a fit."""
    r = r[np.isfinite(r)]
    if len(r) < 100 or r.std() <= 0:
        return None
    target = r.var()

    def unpack(p: np.ndarray) -> tuple[float, float, float]:
        persistence = 0.9999 / (1 + np.exp(-p[0]))
        share = 1 / (1 + np.exp(-p[1]))
        return target * np.exp(p[2]) * (1 - persistence), persistence * share, persistence * (1 - share)

    def miss(p: np.ndarray) -> float:
        v, _ = garch_filter(r, *unpack(np.clip(p, -12, 12)))
        v = np.maximum(v, 1e-12)
        return float(0.5 * (np.log(v) + r * r / v).mean())

    found = unpack(np.clip(nelder_mead(miss, np.array([3.0, -2.2, 0.0]), 0.3, 400, 1e-8), -12, 12))
    return tuple(float(x) for x in found) if np.all(np.isfinite(found)) else None


def garch_scan(column: str):
    """Conditional volatility of 100 times the column, scaled back; EWMA where GARCH can't be fitted."""

    def run(f: pd.DataFrame) -> pd.Series:
        r = f[column].astype(float).fillna(0.0).to_numpy() * 100
        fitted = fit_garch(r)
        if fitted is not None:
            v, after = garch_filter(r, *fitted)
            if np.all(np.isfinite(v)) and after > 0:
                return pd.Series(np.sqrt(v) / 100, f.index)
        return ewma_sigma(column)(f)

    return run


def next_sigma(r: np.ndarray, decay: float = 0.94, seed_rows: int = 20) -> float:
    """The deviation after a series of residuals: GARCH's, or an exponential mean of squares where that can't be fitted."""
    r = np.asarray(r, float) * 100
    fitted = fit_garch(r)
    if fitted is not None:
        _, after = garch_filter(r, *fitted)
        if np.isfinite(after) and after > 0:
            return float(np.sqrt(after) / 100)
    v = float(np.mean(r[:seed_rows] ** 2)) if len(r) else 0.0
    for x in r:
        v = decay * v + (1 - decay) * x * x
    return float(np.sqrt(v) / 100)


def conditional_sigma(df: DataFrame, keys: list[str], order: str, r: str, source: str = "ewma", block: str | None = None) -> DataFrame:
    """df with sigma_ewma or sigma_garch before each row; a block (unit of time) cuts keys too long for one task, for ewma."""
    scans = {"ewma": Scan("sigma_ewma", ewma_sigma(r)), "garch": Scan("sigma_garch", garch_scan(r))}
    if source not in scans:
        raise ValueError(f"unknown source {source!r}")
    return ordered_scan(df, keys, order, [scans[source]], block)


def blended(a: str, b: str) -> Column:
    """The root of the mean of two variances."""
    return F.sqrt((F.col(a) * F.col(a) + F.col(b) * F.col(b)) / 2)


def har_rows(df: DataFrame, keys: list[str], order: str, rv: str) -> DataFrame:
    """rv with its lag, and its means of the 5 and 22 rows before."""
    w = Over(keys, order)
    base = add(df, {"har_1": w.lag(rv)})
    return add(base, {"har_5": w.mean("har_1", 5), "har_22": w.mean("har_1", 22)})


def har_fit(df: DataFrame, keys: list[str], order: str, rv: str, least: int = 30) -> DataFrame:
    """(keys, n, beta): least squares of rv on 1, har_1, har_5, har_22 from one aggregate of products; the mean alone under `least` rows."""
    x = ["_one", "har_1", "har_5", "har_22"]
    rows = har_rows(df, keys, order, rv).where("har_22 is not null").withColumn("_one", F.lit(1.0))
    pairs = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *pairs, *[F.sum(F.col(a) * F.col(rv)).alias(f"b{i}") for i, a in enumerate(x)])

    def solve(batches):
        for f in batches:
            out = []
            for row in f.to_dict("records"):
                g = np.array([[row[f"g{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
                b = np.array([row[f"b{i}"] for i in range(4)])
                out.append(np.linalg.lstsq(g, b, rcond=None)[0].tolist() if row["n"] >= least else [b[0] / max(row["n"], 1), 0.0, 0.0, 0.0])
            yield f[[*keys, "n"]].assign(beta=out)

    return sums.mapInPandas(solve, ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", n long, beta array<double>")


def har_predict(beta: str, one: str, five: str, month: str) -> Column:
    get = lambda i: F.element_at(F.col(beta), i)
    return F.greatest(get(1) + get(2) * F.col(one) + get(3) * F.col(five) + get(4) * F.col(month), F.lit(0.0))
