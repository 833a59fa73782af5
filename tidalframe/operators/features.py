"""Windowed features over (keys, order): every builder returns columns by name, made in one projection.

`w` is an Over; rows are trading days, so a window of 7 is 7 rows, not 7 days.  A window gives null
until it is full, and divisions by zero give null.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import iso_week
from ..functions.columns import Over, col, ratio, safe_ln
from .scan import Scan, ewm, ordered_scan

Columns = dict[str, Column]


def add(df: DataFrame, *groups: Columns) -> DataFrame:
    """df with all columns of the groups, in one projection."""
    merged = reduce(lambda a, b: a | b, groups)
    return df.select(*[F.col(c) for c in df.columns if c not in merged], *[c.alias(n) for n, c in merged.items()])


class Steps(NamedTuple):
    """Columns of a builder that needs two projections: those of the first, those over them, and which of the first go."""

    first: Columns
    then: Columns
    scratch: tuple[str, ...] = ()


def add_steps(df: DataFrame, *steps: Steps) -> DataFrame:
    """df with the columns of all steps, in two projections whatever their number."""
    out = add(add(df, *[s.first for s in steps]), *[s.then for s in steps])
    return out.drop(*[c for s in steps for c in s.scratch])


def lags(w: Over, columns: list[str], ks: list[int]) -> Columns:
    return {f"{c}_lag_{k}": w.lag(c, k) for c in columns for k in ks}


def rolling_mean_std(w: Over, c: str, sizes: list[int]) -> Columns:
    return {f"{c}_sma_{n}": w.mean(c, n) for n in sizes} | {f"{c}_std_{n}": w.std(c, n) for n in sizes}


def returns(w: Over, columns: list[str]) -> Columns:
    out: Columns = {}
    for c in columns:
        out[f"{c}_pct_change"] = ratio(F.col(c), w.lag(c)) - 1
        out[f"{c}_log_return"] = safe_ln(ratio(F.col(c), w.lag(c)))
    return out


def momentum(w: Over, c: str, sizes: list[int]) -> Columns:
    return {f"{c}_momentum_{n}": ratio(w.change(c, n), w.lag(c, n)) for n in sizes}


def bollinger(w: Over, c: str, size: int = 20, n_std: float = 2.0) -> Columns:
    mid, std = w.mean(c, size), w.std(c, size)
    low, high = mid - n_std * std, mid + n_std * std
    return {f"{c}_bb_upper_{size}": high, f"{c}_bb_lower_{size}": low, f"{c}_bb_pct_{size}": ratio(F.col(c) - low, high - low), f"{c}_bb_width_{size}": ratio(high - low, mid)}


def price_level(w: Over, c: str, sizes: list[int] = [14, 50, 200], year: int = 252) -> Columns:
    low, high = w.rolling(F.min, c, year), w.rolling(F.max, c, year)
    out = {f"{c}_dist_sma_{n}": ratio(F.col(c) - w.mean(c, n), w.mean(c, n)) for n in sizes}
    return out | {f"{c}_52w_high": high, f"{c}_52w_low": low, f"{c}_52w_pct_range": ratio(F.col(c) - low, high - low)}


def williams_r(w: Over, close: str, high: str, low: str, size: int = 14) -> Columns:
    top, bottom = w.rolling(F.max, high, size), w.rolling(F.min, low, size)
    return {f"{close}_williams_r_{size}": ratio(top - F.col(close), top - bottom) * -100}


def stochastic_steps(w: Over, close: str, high: str, low: str, k: int = 14, d: int = 3) -> Steps:
    """%K and its mean %D; both carry k in their name."""
    top, bottom = w.rolling(F.max, high, k), w.rolling(F.min, low, k)
    return Steps({f"{close}_stoch_k_{k}": ratio(F.col(close) - bottom, top - bottom) * 100}, {f"{close}_stoch_d_{k}": w.mean(f"{close}_stoch_k_{k}", d)})


def stochastic(df: DataFrame, w: Over, *args, **kwargs) -> DataFrame:
    return add_steps(df, stochastic_steps(w, *args, **kwargs))


def money_flow_steps(w: Over, close: str, high: str, low: str, volume: str, size: int = 20) -> Steps:
    """Chaikin money flow; a day without range has no flow, which empties the windows that hold it."""
    part = ratio((F.col(close) - F.col(low)) - (F.col(high) - F.col(close)), F.col(high) - F.col(low)) * F.col(volume)
    return Steps({"_flow": part}, {f"{close}_cmf_{size}": ratio(w.rolling(F.sum, "_flow", size), w.rolling(F.sum, volume, size))}, ("_flow",))


def money_flow(df: DataFrame, w: Over, *args, **kwargs) -> DataFrame:
    return add_steps(df, money_flow_steps(w, *args, **kwargs))


def range_volatility_steps(w: Over, o: str, h: str, l: str, c: str, sizes: list[int] = [5, 20, 60]) -> Steps:  # noqa: E741
    """Parkinson, Garman-Klass, Rogers-Satchell and Yang-Zhang volatility."""
    ln = lambda a, b: safe_ln(ratio(a, b))
    parts = {
        "_park": ln(h, l) * ln(h, l) / (4 * math.log(2)),
        "_gk": ln(h, l) * ln(h, l) / 2 - (2 * math.log(2) - 1) * ln(c, o) * ln(c, o),
        "_rs": ln(h, c) * ln(h, o) + ln(l, c) * ln(l, o),
        "_night": ln(F.col(o), w.lag(c)),
        "_day": ln(c, o),
    }
    out: Columns = {}
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    for n in sizes:
        k = 0.34 / (1.34 + (n + 1) / (n - 1)) if n > 1 else 0.34
        var = lambda x, n=n: w.rolling(F.var_samp, x, n)
        yang = var("_night") + k * var("_day") + (1 - k) * w.mean("_rs", n)
        for name, v in (("parkinson", w.mean("_park", n)), ("garman_klass", w.mean("_gk", n)), ("rogers_satchell", w.mean("_rs", n)), ("yang_zhang", yang)):
            out[f"{c}_{name}_{n}"] = F.when(v.isNotNull(), root(v))
    return Steps(parts, out, tuple(parts))


def range_volatility(df: DataFrame, w: Over, *args, **kwargs) -> DataFrame:
    return add_steps(df, range_volatility_steps(w, *args, **kwargs))


def spread_steps(w: Over, a: str, b: str, prefix: str, size: int = 14) -> Steps:
    """b - a, its share of a, b / a, and the spread's rolling mean and deviation."""
    name = f"{prefix}_spread"
    base = {name: F.col(b) - F.col(a), f"{name}_pct": ratio(F.col(b) - F.col(a), a), f"{prefix}_ratio": ratio(b, a)}
    return Steps(base, {f"{name}_sma_{size}": w.mean(name, size), f"{name}_std_{size}": w.std(name, size)})


def spread(df: DataFrame, w: Over, *args, **kwargs) -> DataFrame:
    return add_steps(df, spread_steps(w, *args, **kwargs))


def crack_steps(w: Over, crude: str, gasoline: str | None, heating: str | None, gallons: float = 42.0, size: int = 14) -> Steps:
    """Refining margins against one or both products."""
    base: Columns = {}
    if gasoline:
        base["crack_gasoline"] = F.col(gasoline) * gallons - F.col(crude)
    if heating:
        base["crack_heating_oil"] = F.col(heating) * gallons - F.col(crude)
    if gasoline and heating:
        base["crack_3_2_1"] = (F.col(gasoline) * gallons * 2 + F.col(heating) * gallons) / 3 - F.col(crude)
    return Steps(base, {f"{c}_sma_{size}": w.mean(c, size) for c in base})


def crack_spreads(df: DataFrame, w: Over, *args, **kwargs) -> DataFrame:
    return add_steps(df, crack_steps(w, *args, **kwargs))


def term_structure_steps(w: Over, m1: str, m2: str, later: dict[str, str] | None = None, size: int = 14) -> Steps:
    """Front spread, contango flag (0 where unknown), rolling figures and change; spreads against later months."""
    gap = F.col(m1) - F.col(m2)
    base = {"m1_m2_spread": gap, "m1_m2_spread_pct": ratio(gap, m2), "contango_flag": F.coalesce((gap < 0).cast("int"), F.lit(0))}
    out = {f"m1_m2_spread_sma_{size}": w.mean("m1_m2_spread", size), f"m1_m2_spread_std_{size}": w.std("m1_m2_spread", size), "m1_m2_spread_chg": w.change("m1_m2_spread")}
    return Steps(base, out | {f"m1_{n}_spread": F.col(m1) - F.col(c) for n, c in (later or {}).items()})


def term_structure(df: DataFrame, w: Over, *args, **kwargs) -> DataFrame:
    return add_steps(df, term_structure_steps(w, *args, **kwargs))


def row_change(w: Over, columns: list[str], k: int = 7) -> Columns:
    out: Columns = {}
    for c in columns:
        out |= {f"{c}_chg": w.change(c, k), f"{c}_chg_pct": ratio(w.change(c, k), w.lag(c, k))}
    return out


def rolling_correlations(w: Over, target: str, pairs: dict[str, str], sizes: list[int]) -> Columns:
    return {f"corr_{n}_{s}": w.correlation(target, c, s) for n, c in pairs.items() for s in sizes}


def risk_index_steps(w: Over, c: str, trend: int = 30, year: int = 252, least: int = 60, q: float = 0.9) -> Steps:
    """Log level, log deviation from the trend, and 1.0 on rows above the rolling quantile."""
    level = F.ln(F.greatest(F.col(c), F.lit(1e-6)))
    bar = w.rolling(lambda x: F.percentile(x, F.lit(q)), c, year, least)
    return Steps({f"{c}_log": level, f"{c}_trend_{trend}": w.mean(c, trend)}, {f"{c}_spike": F.coalesce((F.col(c) > bar).cast("double"), F.lit(0.0))})


def risk_index(df: DataFrame, w: Over, *args, **kwargs) -> DataFrame:
    return add_steps(df, risk_index_steps(w, *args, **kwargs))


def seasonal_stocks(df: DataFrame, keys: list[str], date: str, columns: list[str], years: int = 5, least: int = 2) -> DataFrame:
    """Deviation of each column from the same ISO week of the years before.

    Weekly value: the last non-null of an ISO week.  The norm is the mean and deviation of up to `years` earlier values
    of that week number.  {c}_surprise, the week's change less its norm, stands on a week's first row, else 0.  One aggregate and one
    join for all columns.
    """
    if not columns:
        return df
    d = F.col(date)
    rows = df.withColumn("_yw", iso_week(d))
    weekly = rows.groupBy(*keys, "_yw").agg(F.min(date).alias("_first"), *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), d)).alias(f"_v_{c}") for c in columns])
    order = Over(keys, "_yw")
    weekly = weekly.select("*", (F.col("_yw") % 100).alias("_woy"), *[order.change(f"_v_{c}").alias(f"_chg_{c}") for c in columns])
    past = Window.partitionBy(*keys, "_woy").orderBy("_yw").rowsBetween(-years, -1)
    norm = lambda f, x: F.when(F.count(x).over(past) >= least, f(x).over(past))
    weekly = add(weekly, {k: v for c in columns for k, v in {f"_m_{c}": norm(F.avg, f"_v_{c}"), f"_s_{c}": norm(F.stddev_samp, f"_v_{c}"), f"_cm_{c}": norm(F.avg, f"_chg_{c}")}.items()})
    out = rows.join(weekly.select(*keys, "_yw", "_first", *[f"_{k}_{c}" for c in columns for k in ("m", "s", "cm", "chg")]), [*keys, "_yw"], "left")
    new: Columns = {}
    for c in columns:
        dev = F.col(c) - F.col(f"_m_{c}")
        z = ratio(dev, f"_s_{c}")
        new |= {f"{c}_seasonal_dev": dev, f"{c}_seasonal_z": z, f"{c}_z_pos": F.when(z.isNotNull(), F.greatest(z, F.lit(0.0))), f"{c}_z_neg": F.when(z.isNotNull(), F.least(z, F.lit(0.0)))}
        new[f"{c}_surprise"] = F.when(d == F.col("_first"), F.coalesce(F.col(f"_chg_{c}") - F.col(f"_cm_{c}"), F.lit(0.0))).otherwise(F.lit(0.0))
    return add(out, new).select(*df.columns, *new)


def seasonal_stock(df: DataFrame, keys: list[str], date: str, c: str, years: int = 5, least: int = 2) -> DataFrame:
    return seasonal_stocks(df, keys, date, [c], years, least)


def smoothed(df: DataFrame, keys: list[str], order: str, close: str, spans: list[int], block: str | None = None) -> DataFrame:
    """Exponential means; a block (unit of time) cuts keys too long for one task, here and in rsi and atr."""
    return ordered_scan(df, keys, order, [Scan(f"{close}_ema_{n}", ewm(close, n)) for n in spans], block)


def rsi(df: DataFrame, keys: list[str], order: str, close: str, size: int = 14, block: str | None = None) -> DataFrame:
    """Relative strength on exponential means of gains and losses of span `size`; null while there is no loss."""
    w = Over(keys, order)
    change = w.change(close)
    base = add(df, {"_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))})
    scanned = ordered_scan(base, keys, order, [Scan("_up", ewm("_gain", size)), Scan("_down", ewm("_loss", size))], block)
    return add(scanned, {f"{close}_rsi_{size}": 100 - ratio(F.lit(100.0), 1 + ratio("_up", "_down"))}).drop("_gain", "_loss", "_up", "_down")


def macd(df: DataFrame, keys: list[str], order: str, close: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two exponential means, its own mean from its first value on, and what is between them."""
    line = Scan(f"{close}_macd", lambda f: ewm(close, fast)(f) - ewm(close, slow)(f))
    out = ordered_scan(df, keys, order, [line, Scan(f"{close}_macd_signal", ewm(f"{close}_macd", signal))])
    return add(out, {f"{close}_macd_hist": F.col(f"{close}_macd") - F.col(f"{close}_macd_signal")})


def true_range(w: Over, high: str, low: str, close: str) -> Column:
    before = w.lag(close)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def atr(df: DataFrame, keys: list[str], order: str, high: str, low: str, close: str, size: int = 14, block: str | None = None) -> DataFrame:
    base = add(df, {"_tr": true_range(Over(keys, order), high, low, close)})
    out = ordered_scan(base, keys, order, [Scan(f"{close}_atr_{size}", ewm("_tr", size))], block)
    return add(out, {f"{close}_atr_pct_{size}": ratio(f"{close}_atr_{size}", close)}).drop("_tr")


def positioning(df: DataFrame, w: Over, long: str, short: str, interest: str, steps: dict[str, int]) -> DataFrame:
    """Net position, longs' share of open interest, and the net position's changes over rows."""
    base = add(df, {"net": F.col(long) - F.col(short), "long_pct": ratio(long, interest)})
    return add(base, {f"net_chg_{n}": w.change("net", k) for n, k in steps.items()})


def drawdown(df: DataFrame, w: Over, r: str) -> DataFrame:
    """Running equity (sum of r) and its distance from the running maximum."""
    base = add(df, {"equity": w.running(F.sum, r)})
    return add(base, {"drawdown": F.col("equity") - w.running(F.max, "equity")})


def latest_figures(df: DataFrame, keys: list[str], order: str, c: str, size: int = 30) -> DataFrame:
    """Per key on its last row: value, change and relative change over `size` rows, deviation of the last `size`."""
    w = Over(keys, order)
    figures = add(df.select(*keys, order, c), {"change": w.change(c, size), "change_pct": ratio(w.change(c, size), w.lag(c, size)), "std": w.std(c, size)})
    return figures.groupBy(*keys).agg(F.max_by(F.struct(order, c, "change", "change_pct", "std"), order).alias("x")).select(*keys, "x.*")


def error_drift(df: DataFrame, w: Over, y: str, forecast: str, size: int = 63) -> DataFrame:
    """Rolling mean absolute error."""
    return add(df, {"rolling_mae": w.mean(F.abs(F.col(y) - F.col(forecast)), size)})


def drift_monitor(df: DataFrame, w: Over, y: str, forecast: str, naive: str, size: int = 63, share: float = 0.95) -> DataFrame:
    """df with the rolling errors of a forecast and of a naive one, the forecast's threshold (that quantile of its rolling errors, by key) and whether it is passed."""
    error = lambda c: F.abs(F.col(y) - F.col(c))
    rolled = add(df, {"rolling_mae": w.mean(error(forecast), size), "rolling_mae_naive": w.mean(error(naive), size)})
    bars = rolled.groupBy(*w.keys).agg(F.percentile("rolling_mae", F.lit(share)).alias("threshold"))
    return rolled.join(bars, w.keys).withColumn("drifted", F.col("rolling_mae") > F.col("threshold"))


def interpolated(df: DataFrame, keys: list[str], order: str, c: str) -> DataFrame:
    """Gaps inside a series filled on a straight line by row number; ends stay null."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    base = df.withColumn("_n", F.row_number().over(w))
    at = F.when(F.col(c).isNotNull(), F.col("_n"))
    x0, x1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    y0, y1 = F.last(col(c), True).over(back), F.first(col(c), True).over(ahead)
    value = F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * ratio(F.col("_n") - x0, x1 - x0))
    return base.withColumn(f"{c}_filled", value).drop("_n")
