"""Tail probabilities and a simplex minimiser for the small steps on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_sf(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(500):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, dof: float) -> float:
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))


def kolmogorov_sf(x: float) -> float:
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, scale: float = 0.1, steps: int = 2000, tol: float = 1e-9) -> np.ndarray:
    """A minimum of f by the simplex method."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + scale * (abs(start[i]) + 1.0) * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tol * (abs(values[0]) + tol):
            break
        middle = np.mean(points[:-1], axis=0)
        along = lambda k: middle + k * (points[-1] - middle)  # noqa: B023, E731
        r = along(-1.0)
        fr = f(r)
        if fr < values[0]:
            e = along(-2.0)
            fe = f(e)
            points[-1], values[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = r, fr
        else:
            c = along(0.5 if fr >= values[-1] else -0.5)
            fc = f(c)
            if fc < min(fr, values[-1]):
                points[-1], values[-1] = c, fc
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]
