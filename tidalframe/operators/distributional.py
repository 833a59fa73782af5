"""Models of all four parameters of a forecast: mean, deviation, skewness and tail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distribution import rolling_shape
from .gam import SHAPE_PARTS, SIGMA_PARTS, Fit, Term, chosen, gram, precision_weights, predict, sigma_of, sigma_target, solve, stepwise
from .volatility import blended, conditional_sigma


@dataclass
class Distributional:
    mu: Fit
    sigma: Fit
    nu: Fit
    tau: Fit


def _subset(terms: list[Term], names: list[str]) -> list[Term]:
    return [t for t in terms if t.name in names and t.other is None]


def distributional(rows: DataFrame, keys: list[str], order: str, terms: list[Term], y: str, mu: Fit, lams: list[float], refits: int = 0, sigma_source: str = "gam", window: int = 60, most: int = 8, criterion: str = "bic") -> Distributional:
    """Models beside a fitted mean, on rows (keys, order, y, features).

    The log absolute residual is regressed on volatility features; each of `refits` rounds fits the mean again with
    weights 1 / sigma squared and then the deviation.  Rolling skewness and tail of the standardised
    residuals are regressed on risk features, at most `most` of them by backward selection.  sigma_source
    garch or blend puts a filter over the residuals in the place of the modelled deviation, or beside it.
    """
    names = [t.name for t in terms if t.other is None]
    sigma_terms, shape_terms = _subset(terms, chosen(names, SIGMA_PARTS)), _subset(terms, chosen(names, SHAPE_PARTS, SIGMA_PARTS))
    log_error = lambda m: predict(rows, m, "_mu").withColumn("_s", sigma_target(y, "_mu"))
    sigma, _ = stepwise(gram(log_error(mu), sigma_terms, "_s"), lams, criterion, most)
    for _ in range(refits):
        weighted = precision_weights(sigma_of(rows, sigma, "_sigma"), "_sigma", "_w")
        mu = solve(gram(weighted, mu.terms, y, "_w"), mu.lam)
        sigma = solve(gram(log_error(mu), sigma.terms, "_s"), sigma.lam)
    scored = sigma_of(predict(rows, mu, "_mu"), sigma, "_sigma").withColumn("_e", F.col(y) - F.col("_mu"))
    if sigma_source != "gam":
        scored = conditional_sigma(scored, keys, order, "_e", "garch")
        scored = scored.withColumn("_sigma", F.col("sigma_garch") if sigma_source == "garch" else blended("_sigma", "sigma_garch"))
    shaped = rolling_shape(scored.withColumn("_z", F.col("_e") / F.greatest(F.col("_sigma"), F.lit(1e-8))), keys, order, "_z", window)
    nu, tau = (stepwise(gram(shaped.where(F.col(c).isNotNull()), shape_terms, c), lams, criterion, most)[0] for c in ("nu_roll", "tau_roll"))
    return Distributional(mu, sigma, nu, tau)
