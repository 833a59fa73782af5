"""Column builders: guarded windows and divisions, sample moments, distribution functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: NULL is the only missing value elsewhere."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def safe_ln(x: Column | str) -> Column:
    """ln(x), null for x <= 0."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


class Over:
    """Window expressions of one partitioning and order, so that a stage needs a single sort."""

    def __init__(self, keys: list[str], order: str):
        self.keys, self.order = keys, order

    @property
    def spec(self) -> WindowSpec:
        """Made when asked for: a window needs a session, an Over doesn't."""
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def lag(self, x: Column | str, k: int = 1) -> Column:
        return F.lag(col(x), k).over(self.spec)

    def lead(self, x: Column | str, k: int = 1) -> Column:
        return F.lead(col(x), k).over(self.spec)

    def frame(self, size: int) -> WindowSpec:
        return self.spec.rowsBetween(1 - size, 0)

    def rolling(self, fn: Callable[[Column], Column], x: Column | str, size: int, least: int | None = None) -> Column:
        """fn over the last `size` rows, null until `least` (size) values were there."""
        x, frame = col(x), self.frame(size)
        return F.when(F.count(x).over(frame) >= (size if least is None else least), fn(x).over(frame))

    def mean(self, x: Column | str, size: int, least: int | None = None) -> Column:
        return self.rolling(F.avg, x, size, least)

    def std(self, x: Column | str, size: int, least: int | None = None) -> Column:
        return self.rolling(F.stddev_samp, x, size, least)

    def change(self, x: Column | str, k: int = 1) -> Column:
        return col(x) - self.lag(x, k)

    def running(self, fn: Callable[[Column], Column], x: Column | str) -> Column:
        return fn(col(x)).over(self.spec.rowsBetween(Window.unboundedPreceding, 0))

    def filled(self, x: Column | str) -> Column:
        """The last value that isn't null, the current row's first."""
        return F.last(col(x), ignorenulls=True).over(self.spec.rowsBetween(Window.unboundedPreceding, 0))

    def correlation(self, x: Column | str, y: Column | str, size: int) -> Column:
        """Pearson correlation of the complete pairs; null while there are fewer than `size`, or for a constant."""
        x, y, frame = col(x), col(y), self.frame(size)
        both = x.isNotNull() & y.isNotNull()
        px, py = F.when(both, x), F.when(both, y)
        spread = F.stddev_pop(px).over(frame) * F.stddev_pop(py).over(frame)
        return F.when(F.count(px).over(frame) >= size, F.try_divide(F.covar_pop(px, py).over(frame), spread))

    def skew_kurt(self, x: Column | str, size: int) -> tuple[Column, Column]:
        """Bias-corrected rolling skewness and excess kurtosis."""
        x, frame = col(x), self.frame(size)
        n = F.count(x).over(frame).cast("double")
        flat = F.stddev_pop(x).over(frame) <= 0
        g1, g2 = F.skewness(x).over(frame), F.kurtosis(x).over(frame)
        skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        full = (n >= size) & ~flat
        return F.when(full & (n > 2), skew), F.when(full & (n > 3), kurt)


def _horner(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda a, c: a * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


#: The coefficients of Hart's rational approximation to the normal tail.
HART_TOP = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BOTTOM = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def norm_cdf(x: Column | str) -> Column:
    """The normal distribution function, to about 1e-14; its far tail by a continued fraction."""
    x = col(x)
    a = F.abs(x)
    near = _horner(a, HART_TOP) / _horner(a, HART_BOTTOM)
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + F.lit(float(k)) / far
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, near).otherwise(F.lit(1.0) / (far * 2.506628274631))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def johnson_su_cdf(x: Column, nu: Column, tau: Column, loc: Column, scale: Column) -> Column:
    return norm_cdf(nu + tau * F.asinh((x - loc) / scale))


def johnson_su_ppf(p: float, nu: Column, tau: Column, loc: Column, scale: Column) -> Column:
    return loc + scale * F.sinh((F.lit(norm_ppf(p)) - nu) / tau)


def johnson_su_logpdf(x: Column, nu: Column, tau: Column, loc: Column, scale: Column) -> Column:
    z = (x - loc) / scale
    w = nu + tau * F.asinh(z)
    return F.ln(tau / (scale * F.sqrt(1 + z * z))) - w * w / 2 - math.log(math.sqrt(2 * math.pi))


def pinball(y: Column | str, q: Column | str, p: float) -> Column:
    miss = col(y) - col(q)
    return F.greatest(miss * p, miss * (p - 1))
