"""Johnson SU fits and rolling shape parameters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Over
from ..functions.special import nelder_mead

#: The tail parameter is capped: by default after the fit, so that location and scale stay those of the uncapped fit.
MOST_TAU = 0.8


def fit_johnson_su(z: np.ndarray, inside: bool = False) -> tuple[float, float, float, float]:
    """(nu, tau, loc, scale) by maximum likelihood on standardised residuals, started from the quartiles.

    inside: the cap holds during the fit, so the other parameters belong to the capped tail and bands keep their
    coverage where the residuals are near normal.
    """
    z = z[np.isfinite(z)]
    if len(z) < 8 or z.std() <= 0:
        return 0.0, 1.0, float(z.mean()) if len(z) else 0.0, float(z.std()) or 1.0

    def miss(p: np.ndarray) -> float:
        tau, scale = math.exp(min(p[1], 20)), math.exp(min(p[3], 20))
        tau = min(tau, MOST_TAU) if inside else tau
        u = (z - p[2]) / scale
        w = p[0] + tau * np.arcsinh(u)
        return float(-(np.log(tau / scale) - 0.5 * np.log1p(u * u) - 0.5 * w * w).mean())

    q = np.quantile(z, [0.25, 0.5, 0.75])
    p = nelder_mead(miss, np.array([0.0, 0.3, q[1], math.log(max(q[2] - q[0], 1e-6))]), 0.2)
    return float(p[0]), min(math.exp(p[1]), MOST_TAU), float(p[2]), math.exp(p[3])


def johnson_su_fits(df: DataFrame, keys: list[str], z: str, inside: bool = False) -> DataFrame:
    """(keys, n, nu, tau, loc, scale) per key."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        nu, tau, loc, scale = fit_johnson_su(f[z].dropna().to_numpy(float), inside)
        return f[keys].iloc[:1].assign(n=int(f[z].notna().sum()), nu=nu, tau=tau, loc=loc, scale=scale)

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, nu double, tau double, loc double, scale double")


def rolling_shape(df: DataFrame, keys: list[str], order: str, r: str, size: int = 60) -> DataFrame:
    """df with rolling nu (sample skewness) and tau (1 / (1 + positive excess kurtosis))."""
    skew, kurt = Over(keys, order).skew_kurt(r, size)
    return df.select("*", skew.alias("nu_roll"), F.when(kurt.isNotNull(), 1 / (1 + F.greatest(kurt, F.lit(0.0)))).alias("tau_roll"))
