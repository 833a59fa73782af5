"""Forecast scores and inference: one aggregate over the rows, then scalar steps."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Over, col, johnson_su_cdf, johnson_su_logpdf, johnson_su_ppf, norm_cdf, norm_ppf, ratio
from ..functions.special import chi2_sf, kolmogorov_sf, nelder_mead, t_two_sided
from .splits import bootstrap_blocks, stationary_bootstrap

LEVELS = (0.50, 0.80, 0.90, 0.95)


def point_metrics(y: str, forecast: str) -> dict[str, Column]:
    """MAE, RMSE and MAPE in percent over rows that have both; a zero actual has no percentage."""
    both = F.col(y).isNotNull() & F.col(forecast).isNotNull()
    e = F.when(both, F.col(y) - F.col(forecast))
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mape": F.avg(F.abs(ratio(e, y))) * 100}


def directional_accuracy(y: str, forecast: str, anchor: str) -> Column:
    """The share of rows whose forecast and actual lie on the same side of the anchor; no change on both sides agrees."""
    a, b = F.signum(F.col(y) - F.col(anchor)), F.signum(F.col(forecast) - F.col(anchor))
    return F.avg((a == b).cast("double"))


def coverage(y: str, low: str, high: str) -> Column:
    return F.avg(((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))).cast("double"))


def conformal_quantile(df: DataFrame, keys: list[str], y: str, forecast: str, sigma: str, alpha: float = 0.05) -> DataFrame:
    """(keys, q): the ceil((n + 1)(1 - alpha))-th smallest scaled absolute residual, or the largest."""
    r = df.select(*keys, (F.abs(F.col(y) - F.col(forecast)) / F.greatest(F.col(sigma), F.lit(1e-8))).alias("q")).where("q is not null")
    n = F.count("*").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("q"))
    ranked = r.select(*keys, "q", n.alias("_n"), rank.alias("_rank"))
    return ranked.where(F.col("_rank") == F.least(F.col("_n"), F.ceil((F.col("_n") + 1) * (1 - alpha)))).select(*keys, "q")


def mspe_ratio(y: str, a: str, b: str) -> Column:
    """Mean squared error of a over b's."""
    sq = lambda f: F.avg((F.col(y) - F.col(f)) * (F.col(y) - F.col(f)))
    return ratio(sq(a), sq(b))


def diebold_mariano(df: DataFrame, keys: list[str], order: str, loss_a: str, loss_b: str, h: int = 1, harvey: bool = True) -> DataFrame:
    """(keys, n, dm): the statistic with the rectangular long-run variance to lag h - 1; null under 8 rows or without variance."""
    w = Over(keys, order)
    d = df.select(*keys, order, (F.col(loss_a) - F.col(loss_b)).alias("d")).where("d is not null")
    d = d.withColumn("m", F.avg("d").over(Window.partitionBy(*keys))).withColumn("e", F.col("d") - F.col("m"))
    d = d.select(*keys, "d", "e", *[w.lag("e", k).alias(f"e{k}") for k in range(1, h)])
    lrv = F.avg(F.col("e") * F.col("e"))
    for k in range(1, h):
        lrv = lrv + 2 * F.avg(F.col("e") * F.col(f"e{k}"))
    stats = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), lrv.alias("lrv"))
    n = F.col("n").cast("double")
    dm = F.col("mean") / F.sqrt(F.col("lrv") / n) * (F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) if harvey else 1)
    return stats.select(*keys, "n", F.when((F.col("n") >= 8) & (F.col("lrv") > 0), dm).alias("dm"))


def dm_p_value(dm: float, n: int) -> float:
    return t_two_sided(dm, n - 1)


def benchmark_tests(df: DataFrame, keys: list[str], order: str, y: str, forecast: str, naive: str, anchor: str, h: int = 1) -> DataFrame:
    """(keys, n, mspe_ratio, dm_stat, pt_stat, pt_pvalue) of a forecast against a naive one: squared errors and changes from the anchor."""
    sq = lambda f: (F.col(y) - F.col(f)) * (F.col(y) - F.col(f))
    rows = df.where(F.col(y).isNotNull() & F.col(forecast).isNotNull() & F.col(naive).isNotNull())
    rows = rows.select(*keys, order, y, forecast, naive, sq(forecast).alias("_a"), sq(naive).alias("_b"), (F.col(y) - F.col(anchor)).alias("_dy"), (F.col(forecast) - F.col(anchor)).alias("_df"))
    dm = diebold_mariano(rows, keys, order, "_a", "_b", h).withColumnRenamed("dm", "dm_stat")
    pt = pesaran_timmermann(rows, keys, "_dy", "_df").select(*keys, F.col("pt").alias("pt_stat"), F.col("p").alias("pt_pvalue"))
    return dm.join(rows.groupBy(*keys).agg(mspe_ratio(y, forecast, naive).alias("mspe_ratio")), keys).join(pt, keys)


def pesaran_timmermann(df: DataFrame, keys: list[str], y: str, forecast: str) -> DataFrame:
    """(keys, n, pt, p): the test of sign agreement of changes (above 0 is up); p is one-sided."""
    up_y, up_f = (F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double")) for c in (y, forecast))
    s = df.where(F.col(y).isNotNull() & F.col(forecast).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg((up_y == up_f).cast("double")).alias("hit"), F.avg(up_y).alias("a"), F.avg(up_f).alias("b"))
    n, a, b, star = F.col("n").cast("double"), F.col("a"), F.col("b"), F.col("star")
    s = s.withColumn("star", a * b + (1 - a) * (1 - b))
    v1 = star * (1 - star) / n
    v2 = ((2 * a - 1) * (2 * a - 1) * b * (1 - b) + (2 * b - 1) * (2 * b - 1) * a * (1 - a)) / n + 4 * a * b * (1 - a) * (1 - b) / (n * n)
    s = s.withColumn("v", v1 - v2).withColumn("pt", F.when(F.col("v") > 0, (F.col("hit") - star) / F.sqrt(F.col("v"))))
    return s.select(*keys, "n", "pt", (1 - norm_cdf("pt")).alias("p"))


def with_intervals(df: DataFrame, mu: str, sigma: str, nu: Column, tau: Column, loc: Column, scale: Column) -> DataFrame:
    """df with lower_/upper_ bounds of the Johnson SU distribution at 50, 80, 90 and 95 percent."""
    at, width = F.col(mu) + F.col(sigma) * loc, F.col(sigma) * scale
    out = {}
    for level in LEVELS:
        name = round(level * 100)
        out[f"lower_{name}"] = johnson_su_ppf((1 - level) / 2, nu, tau, at, width)
        out[f"upper_{name}"] = johnson_su_ppf((1 + level) / 2, nu, tau, at, width)
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def pit(y: str, mu: str, sigma: str, nu: Column, tau: Column, loc: Column, scale: Column) -> Column:
    return johnson_su_cdf(F.col(y), nu, tau, F.col(mu) + F.col(sigma) * loc, F.col(sigma) * scale)


def log_score(y: str, mu: str, sigma: str, nu: Column, tau: Column, loc: Column, scale: Column) -> Column:
    return -johnson_su_logpdf(F.col(y), nu, tau, F.col(mu) + F.col(sigma) * loc, F.col(sigma) * scale)


def crps_quadrature(y: str, mu: str, sigma: str, nu: Column, tau: Column, loc: Column, scale: Column, points: int = 99) -> Column:
    """CRPS as twice the mean pinball loss at evenly spaced levels: without random draws."""
    at, width = F.col(mu) + F.col(sigma) * loc, F.col(sigma) * scale
    zs = F.array(*[F.struct(F.lit((k + 0.5) / points).alias("p"), F.lit(norm_ppf((k + 0.5) / points)).alias("z")) for k in range(points)])
    loss = F.aggregate(zs, F.lit(0.0), lambda a, x: a + F.greatest((F.col(y) - (at + width * F.sinh((x["z"] - nu) / tau))) * x["p"], (F.col(y) - (at + width * F.sinh((x["z"] - nu) / tau))) * (x["p"] - 1)))
    return loss * (2.0 / points)


def crps_samples(y: Column, first: Column, second: Column) -> Column:
    """CRPS from two arrays of draws: mean distance to y less half the mean distance between the pairs."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return mean(F.transform(first, lambda x: F.abs(x - y))) - mean(F.zip_with(first, second, lambda a, b: F.abs(a - b))) / 2


def sigma_scale(df: DataFrame, keys: list[str], y: str, mu: str, sigma: str, level: float = 0.9, target: float = 0.9, low: float = 0.5, high: float = 5.0, steps: int = 100) -> DataFrame:
    """(keys, scale): the first of a grid of sigma factors whose normal interval covers the target share; the last if none does.

    Coverage grows with the factor, so it is read off the distribution of the factor that each row
    needs: one count per key and grid point, no product of rows and grid.
    """
    z = norm_ppf((1 + level) / 2)
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    need = F.abs(F.col(y) - F.col(mu)) / (F.col(sigma) * z)
    step = F.when(need <= low, 0).otherwise(F.least(F.ceil((need - low) * ((steps - 1) / (high - low)) - 1e-9), F.lit(steps)))
    n = df.where(need.isNotNull()).groupBy(*keys, step.cast("int").alias("step")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    n = n.select(*keys, "step", (F.sum("n").over(w.orderBy("step")) / F.sum("n").over(w)).alias("covered"))
    hit = n.groupBy(*keys).agg(F.min(F.when(F.col("covered") >= target, F.col("step"))).alias("step"))
    return hit.select(*keys, F.element_at(F.array(*[F.lit(g) for g in grid]), F.least(F.coalesce("step", F.lit(steps - 1)), F.lit(steps - 1)) + 1).alias("scale"))


def path_metrics(df: DataFrame, keys: list[str], order: str, r: str, year: int = 252) -> DataFrame:
    """Per path: Sharpe ratio (0 without variance or under 2 rows), annual return and volatility, drawdown, hit rate, rows."""
    w = Over(keys, order)
    eq = df.where(F.col(r).isNotNull()).select(*keys, order, r, w.running(F.sum, r).alias("eq"))
    eq = eq.withColumn("dd", F.col("eq") - F.max("eq").over(w.spec.rowsBetween(Window.unboundedPreceding, 0)))
    sharpe = F.coalesce(ratio(F.avg(r), F.stddev_samp(r)) * math.sqrt(year), F.lit(0.0))
    return eq.groupBy(*keys).agg(
        sharpe.alias("sharpe"), (F.avg(r) * year).alias("annualised_return"), (F.coalesce(F.stddev_samp(r), F.lit(0.0)) * math.sqrt(year)).alias("annualised_vol"),
        F.min("dd").alias("max_drawdown"), F.avg((F.col(r) > 0).cast("double")).alias("hit_rate"), F.count(r).alias("n_obs"),
    )


def pbo_proxy(paths: DataFrame, sharpe: str = "sharpe") -> DataFrame:
    return paths.agg(F.avg((F.col(sharpe) <= 0).cast("double")).alias("pbo"))


def pbo_cscv(df: DataFrame, strategy: str, row: str, r: str, n: int, blocks: int = 16) -> DataFrame:
    """(pbo, mean_logit, splits): the probability that the best strategy in sample is below the median out of sample.

    Rows fall into equal blocks; their counts and power sums per strategy (blocks times strategies
    rows) serve every choice of half the blocks, so returns are read once.
    """
    blocks = min(blocks - blocks % 2, n - n % 2)
    size = n // blocks
    inside = df.where(F.col(row) < size * blocks)
    sums = inside.groupBy(F.col(strategy).alias("s"), F.floor(F.col(row) / size).cast("int").alias("b")).agg(F.count(r).alias("n"), F.sum(r).alias("s1"), F.sum(F.col(r) * F.col(r)).alias("s2"))
    picks = [(i, b, b in half) for i, half in enumerate(map(set, itertools.combinations(range(blocks), blocks // 2))) for b in range(blocks)]
    splits = df.sparkSession.createDataFrame(picks, "split int, b int, inside boolean")
    both = sums.join(F.broadcast(splits), "b").groupBy("split", "s", "inside").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("n")
    var = (F.col("s2") - F.col("s1") * mean) / (F.col("n") - 1)
    both = both.select("split", "s", "inside", F.coalesce(ratio(mean, F.sqrt(F.greatest(var, F.lit(0.0)))), F.lit(0.0)).alias("sharpe"))
    ranked = both.where("not inside").select("split", "s", F.row_number().over(Window.partitionBy("split").orderBy("sharpe", "s")).alias("rank"), F.count("*").over(Window.partitionBy("split")).alias("k"))
    best = both.where("inside").groupBy("split").agg(F.max_by("s", F.struct("sharpe", -F.col("s"))).alias("s"))
    omega = F.col("rank") / (F.col("k") + 1)
    out = best.join(ranked, ["split", "s"]).select(F.ln(omega / (1 - omega)).alias("logit"))
    return out.agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"), F.count("*").alias("splits"))


#: Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329


def expected_max_sharpe(deviation: Column, trials: int) -> Column:
    if trials < 2:
        return F.lit(0.0)
    return deviation * ((1 - EULER) * norm_ppf(1 - 1 / trials) + EULER * norm_ppf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: Column, deviation: Column, trials: int, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that a per-period Sharpe ratio exceeds the best of `trials` without skill; kurt isn't in excess."""
    bottom = F.sqrt(F.greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, F.lit(1e-12)))
    return norm_cdf((sharpe - expected_max_sharpe(deviation, trials)) * F.sqrt(F.greatest(n - 1, F.lit(1))) / bottom)


def bates_granger(df: DataFrame, keys: list[str], y: str, a: str, b: str, steps: int = 101) -> DataFrame:
    """(keys, weight, rmse): the first weight of a on an even grid with the least squared error.

    The squared error is a parabola in the weight, so three moments serve the whole grid.
    """
    u, v = F.col(y) - F.col(b), F.col(a) - F.col(b)
    m = df.where((u * v).isNotNull()).groupBy(*keys).agg(F.avg(u * u).alias("m0"), F.avg(u * v).alias("m1"), F.avg(v * v).alias("m2"))
    grid = m.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i")).withColumn("weight", F.col("i") / F.lit(float(steps - 1)))
    mse = F.col("m0") - 2 * F.col("weight") * F.col("m1") + F.col("weight") * F.col("weight") * F.col("m2")
    best = grid.groupBy(*keys).agg(F.min(F.struct(mse.alias("mse"), "weight")).alias("x"))
    return best.select(*keys, "x.weight", F.sqrt(F.greatest("x.mse", F.lit(0.0))).alias("rmse"))


def combined(weight: Column | float, a: str, b: str) -> Column:
    weight = F.lit(weight) if isinstance(weight, float) else col(weight)
    return weight * F.col(a) + (1 - weight) * F.col(b)


def berkowitz(z: np.ndarray) -> tuple[float, float]:
    """Likelihood ratio and p of normal scores against a Gaussian AR(1)."""
    z = np.asarray(z, float)

    def miss(p: np.ndarray) -> float:
        mu, s, rho = p[0], math.exp(p[1]), math.tanh(p[2])
        first = s * s / (1 - rho * rho)
        e = z[1:] - mu - rho * (z[:-1] - mu)
        return 0.5 * (math.log(2 * math.pi * first) + (z[0] - mu) ** 2 / first + (len(z) - 1) * math.log(2 * math.pi * s * s) + float(e @ e) / (s * s))

    best = nelder_mead(miss, np.array([z.mean(), math.log(z.std() + 1e-9), 0.0]))
    null = 0.5 * float((math.log(2 * math.pi) + z * z).sum())
    lr = max(0.0, 2 * (null - miss(best)))
    return float(lr), float(chi2_sf(lr, 3))


def berkowitz_moments(df: DataFrame, order: str, z: str) -> tuple[float, float]:
    """The same from seven sums over an ordered series, so that the series never reaches the driver."""
    spec = Window.partitionBy(F.lit(0)).orderBy(order)
    rows = df.select(F.col(z).alias("z"), F.lag(z).over(spec).alias("p"))
    s = rows.agg(F.count("z").alias("n"), F.sum("z").alias("a"), F.sum(F.col("z") * F.col("z")).alias("aa"), F.sum(F.when(F.col("p").isNull(), F.col("z"))).alias("z0"), F.sum("p").alias("b"), F.sum(F.col("p") * F.col("p")).alias("bb"), F.sum(F.col("p") * F.col("z")).alias("ab")).first()
    n, z0 = s["n"], s["z0"]
    m, a, aa = n - 1, s["a"] - z0, s["aa"] - z0 * z0

    def miss(p: np.ndarray) -> float:
        mu, v, rho = p[0], math.exp(2 * p[1]), math.tanh(p[2])
        c = mu * (1 - rho)
        sse = aa + m * c * c + rho * rho * s["bb"] - 2 * c * a - 2 * rho * s["ab"] + 2 * c * rho * s["b"]
        first = v / (1 - rho * rho)
        return 0.5 * (math.log(2 * math.pi * first) + (z0 - mu) ** 2 / first + m * math.log(2 * math.pi * v) + sse / v)

    mean = s["a"] / n
    best = nelder_mead(miss, np.array([mean, 0.5 * math.log(max(s["aa"] / n - mean * mean, 1e-12)), 0.0]))
    lr = max(0.0, 2 * (0.5 * (n * math.log(2 * math.pi) + s["aa"]) - miss(best)))
    return float(lr), float(chi2_sf(lr, 3))


#: Buckets of values that ranks are counted in.
RANK_BUCKETS = 1024


def ks_by_key(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """(keys, n, d, pit_p): by key the Kolmogorov-Smirnov distance of a column from the uniform distribution, and its p value.

    Ranks take two passes: counts per bucket of the unit interval, then ranks within buckets; equal values are one row first.
    """
    value = F.col(p).cast("double")
    tied = df.where(value.isNotNull()).groupBy(*keys, value.alias("p")).agg(F.count("*").alias("c"))
    tied = tied.withColumn("bucket", F.least(F.greatest(F.floor(F.col("p") * RANK_BUCKETS), F.lit(0)), F.lit(RANK_BUCKETS - 1)).cast("int"))
    sizes = tied.groupBy(*keys, "bucket").agg(F.sum("c").alias("size"))  # RANK_BUCKETS rows a key at most
    past = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "bucket"])}
    before = sizes.select(*[F.col(k).alias(n) for k, n in names.items()], F.coalesce(F.sum("size").over(past), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(*keys)).alias("n"))
    inside = F.sum("c").over(Window.partitionBy(*keys, "bucket").orderBy("p"))
    ranked = tied.withColumn("inside", inside).join(before, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    upto = F.col("before") + F.col("inside")
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.greatest(upto / F.col("n") - F.col("p"), F.col("p") - (upto - F.col("c")) / F.col("n"))).alias("d"))
    root = F.sqrt(F.col("n").cast("double"))
    return found.withColumn("pit_p", kolmogorov_column((root + 0.12 + 0.11 / root) * F.col("d")))


def kolmogorov_column(x: Column) -> Column:
    """The tail of Kolmogorov's distribution: the series that converges fast on either side of 1."""
    small = F.lit(0.0)
    for k in (1, 3, 5, 7):
        small = small + F.exp(-F.lit(k * k * math.pi**2 / 8) / (x * x))
    large = F.lit(0.0)
    for k in range(1, 6):
        large = large + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x)
    value = F.when(x < 1.0, 1 - F.lit(math.sqrt(2 * math.pi)) / x * small).otherwise(large)
    return F.when(x <= 0.04, 1.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def ks_uniform(df: DataFrame, p: str) -> DataFrame:
    """(n, d) of all rows; see ks_by_key."""
    return ks_by_key(df, [], p).select("n", "d")


def ks_p_value(d: float, n: int) -> float:
    root = math.sqrt(n)
    return kolmogorov_sf((root + 0.12 + 0.11 / root) * d)


def bootstrap_means(df: DataFrame, position: str, columns: list[str], n: int, reps: int, seed: int = 0, rows_per_block: int = 1 << 16) -> DataFrame:
    """(rep, columns): means of `reps` stationary bootstrap samples of rows numbered from 0 by position, n in all.

    A drawn block of rows is a difference of two prefix sums, so a sample is a few signed places for each block instead of n rows: places are drawn by
    replicate on executors, meet the prefix sums by position and are added up.  Sums are of differences from the columns' means.
    """
    block = F.floor(F.col(position) / rows_per_block)
    mean = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    rows = df.select(F.col(position).cast("long").alias("at"), block.alias("block"), *[(F.col(c) - F.lit(mean[c])).alias(c) for c in columns])
    sizes = rows.groupBy("block").agg(*[F.sum(c).alias(f"all_{c}") for c in columns])  # a row for rows_per_block
    past = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("block").alias("of"), *[F.coalesce(F.sum(f"all_{c}").over(past), F.lit(0.0)).alias(f"all_{c}") for c in columns])
    w = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.select("block", F.col("at") + 1, *[F.sum(c).over(w).alias(c) for c in columns]).toDF("block", "at", *columns)
    upto = upto.join(sizes, F.col("block") == F.col("of")).select("at", *[(F.col(c) + F.col(f"all_{c}")).alias(c) for c in columns])  # none before row 0

    def draw(frames):
        for f in frames:
            for rep in f["id"].tolist():
                start, length = bootstrap_blocks(n, seed, rep)
                end = start + length
                wraps = end > n
                places = np.concatenate([start, np.where(wraps, end - n, end), np.full(int(wraps.sum()), n)])
                signs = np.concatenate([np.full(len(start), -1), np.ones(len(start), int), np.ones(int(wraps.sum()), int)])
                kept, of = np.unique(places, return_inverse=True)
                total = np.bincount(of, weights=signs)
                used = (kept > 0) & (total != 0)
                yield pd.DataFrame({"rep": np.int32(rep), "place": kept[used], "sign": total[used]})

    spark = df.sparkSession
    tasks = max(1, min(reps, spark.sparkContext.defaultParallelism * 2))
    places = spark.range(0, reps, 1, tasks).mapInPandas(draw, "rep int, place long, sign double")
    sums = places.join(upto, F.col("place") == F.col("at"), "left").groupBy("rep").agg(*[F.coalesce(F.sum(F.col("sign") * F.col(c)), F.lit(0.0)).alias(c) for c in columns])
    whole = spark.range(0, reps, 1, tasks).select(F.col("id").cast("int").alias("rep")).join(sums, "rep", "left")
    return whole.select("rep", *[(F.coalesce(F.col(c), F.lit(0.0)) / n + F.lit(mean[c])).alias(c) for c in columns])


def bootstrap_table(df: DataFrame, position: str, columns: list[str], reps: int = 1000, seed: int = 0) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, means of the samples): what the tests need on the driver, reps x columns numbers whatever the rows."""
    whole = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n = whole["n"]
    draws = bootstrap_means(df, position, columns, n, reps, seed).orderBy("rep").toPandas()[columns].to_numpy(float)
    return n, np.array([whole[f"m{i}"] for i in range(len(columns))], float), draws


def _sampled(x: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Means of the same samples of an array."""
    n = len(x)
    out = np.empty((reps, x.shape[1]))
    for rep in range(reps):
        out[rep] = x[stationary_bootstrap(n, max(1.0, n ** (1 / 3)), seed, rep)].mean(0)
    return out


def spa_p_values(n: int, mean: np.ndarray, draws: np.ndarray) -> dict[str, float]:
    """p values (lower, consistent, upper) that no model gains on the base, from the mean gains and those of bootstrap samples."""
    omega = np.maximum(np.sqrt(n) * draws.std(0), 1e-12)
    stat = max(0.0, float((np.sqrt(n) * mean / omega).max()))
    out = {}
    limit = -omega * math.sqrt(2 * math.log(math.log(max(n, 3)))) / math.sqrt(n)
    for name, centre in (("lower", np.maximum(mean, 0)), ("consistent", np.where(mean >= limit, mean, 0)), ("upper", mean)):
        boot = np.maximum(0, (np.sqrt(n) * (draws - centre) / omega).max(1))
        out[name] = float((boot >= stat).mean())
    return out


def superior_predictive_ability(base: np.ndarray, models: np.ndarray, reps: int = 1000, seed: int = 0) -> dict[str, float]:
    """p values (lower, consistent, upper) that no model of losses (rows, models) beats the base losses."""
    gain = base[:, None] - models
    return spa_p_values(len(gain), gain.mean(0), _sampled(gain, reps, seed))


def confidence_set(mean: np.ndarray, draws: np.ndarray, size: float = 0.1) -> tuple[list[int], dict[int, float]]:
    """Models that stay in the confidence set under the range statistic, and every model's p, from mean losses and those of bootstrap samples."""
    left, p_of, so_far = list(range(len(mean))), {}, 0.0
    while len(left) > 1:
        gap = mean[left][:, None] - mean[left][None, :]
        boot = draws[:, left][:, :, None] - draws[:, left][:, None, :] - gap[None]
        sd = np.maximum(np.sqrt((boot**2).mean(0)), 1e-12)
        stat = float(np.abs(gap / sd).max())
        p = float((np.abs(boot / sd).max((1, 2)) >= stat).mean())
        so_far = max(so_far, p)
        worst = left[int((gap / sd).max(1).argmax())]
        p_of[worst] = so_far
        left.remove(worst)
    p_of[left[0]] = 1.0
    return sorted(i for i, p in p_of.items() if p >= size), p_of


def model_confidence_set(losses: np.ndarray, size: float = 0.1, reps: int = 1000, seed: int = 0) -> tuple[list[int], dict[int, float]]:
    """confidence_set of an array of losses."""
    return confidence_set(losses.mean(0), _sampled(losses, reps, seed), size)


def probabilistic_scores(df: DataFrame, keys: list[str], y: str, mu: str, sigma: str, anchor: str, nu: Column, tau: Column, loc: Column, scale: Column, points: int = 99) -> DataFrame:
    """One row per key with crps, log score, pinball losses, coverages and direction of a Johnson SU forecast: one aggregate."""
    from ..functions.columns import pinball

    at, width = F.col(mu) + F.col(sigma) * loc, F.col(sigma) * scale
    rows = with_intervals(df.where(F.col(sigma) > 0), mu, sigma, nu, tau, loc, scale)
    out = [F.avg(crps_quadrature(y, mu, sigma, nu, tau, loc, scale, points)).alias("crps"), F.avg(log_score(y, mu, sigma, nu, tau, loc, scale)).alias("log_score")]
    out += [F.avg(pinball(y, johnson_su_ppf(p, nu, tau, at, width), p)).alias(f"pinball_q{round(p * 100):02d}") for p in (0.05, 0.1, 0.5, 0.9, 0.95)]
    out += [coverage(y, f"lower_{n}", f"upper_{n}").alias(f"coverage_{n}") for n in (50, 80, 90, 95)]
    found = rows.groupBy(*keys).agg(*out, directional_accuracy(y, mu, anchor).alias("directional_accuracy"))
    uniform = ks_by_key(rows.select(*keys, pit(y, mu, sigma, nu, tau, loc, scale).alias("_pit")), keys, "_pit")
    return found.join(uniform.select(*keys, F.col("d").alias("pit_ks"), "pit_p"), keys, "left")


def predictive_density(df: DataFrame, mu: str, sigma: str, nu: Column, tau: Column, loc: Column, scale: Column, reach: float = 4.0, points: int = 81) -> DataFrame:
    """df's rows times an even grid of `points` within `reach` sigma of mu: x and density."""
    step = 2 * reach / (points - 1)
    grid = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.withColumn("x", F.col(mu) + F.col(sigma) * (F.col("i") * step - reach))
    return grid.withColumn("density", F.exp(johnson_su_logpdf(F.col("x"), nu, tau, F.col(mu) + F.col(sigma) * loc, F.col(sigma) * scale)))


def price_density(density: DataFrame, anchor: str) -> DataFrame:
    """A predictive density of log returns with the prices they mean and the density there: that of the return over the price."""
    price = F.col(anchor) * F.exp("x")
    return density.withColumn("price", price).withColumn("price_density", ratio(F.col("density"), price))


def scaled_intervals(df: DataFrame, keys: list[str], mu: str, sigma: str, scales: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """df with normal intervals lower_ and upper_ at each level, sigma being multiplied by its key's scale of scales (keys, scale)."""
    out = df.join(scales.select(*keys, "scale"), keys, "left")
    width = F.col(sigma) * F.coalesce("scale", F.lit(1.0))
    bounds = {f"{name}_{round(level * 100)}": F.col(mu) + side * norm_ppf((1 + level) / 2) * width for level in levels for side, name in ((-1, "lower"), (1, "upper"))}
    return out.withColumns(bounds)


def residual_quantiles(df: DataFrame, keys: list[str], y: str, forecast: str, points: int = 99) -> DataFrame:
    """(keys, i, p, normal, residual): quantiles of the residuals beside those of a normal distribution of their mean and deviation."""
    levels = [(i + 0.5) / points for i in range(points)]
    e = F.col(y) - F.col(forecast)
    found = df.groupBy(*keys).agg(F.percentile(e, F.array(*[F.lit(p) for p in levels])).alias("q"), F.avg(e).alias("m"), F.stddev_samp(e).alias("s"))
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(norm_ppf(p)).alias("z")) for p in levels])
    listed = found.select(*keys, "m", "s", F.posexplode(F.arrays_zip("q", table.alias("t"))).alias("i", "x"))
    return listed.select(*keys, "i", F.col("x.t.p").alias("p"), (F.col("m") + F.col("s") * F.col("x.t.z")).alias("normal"), F.col("x.q").alias("residual"))


def residual_density(df: DataFrame, keys: list[str], y: str, forecast: str, bins: int = 50) -> DataFrame:
    """(keys, bin, low, high, density, normal): a histogram of the residuals and the normal density in the middle of each bin."""
    from .eda import histogram

    e = df.select(*keys, (F.col(y) - F.col(forecast)).alias("e"))
    moments = e.groupBy(*keys).agg(F.avg("e").alias("m"), F.stddev_samp("e").alias("s"), F.count("e").alias("all"))
    h = histogram(e, keys, "e", bins).join(moments, keys)
    z = ((F.col("low") + F.col("high")) / 2 - F.col("m")) / F.col("s")
    return h.select(*keys, "bin", "low", "high", ratio(F.col("n"), F.col("all") * (F.col("high") - F.col("low"))).alias("density"), ratio(F.exp(-z * z / 2), F.col("s") * math.sqrt(2 * math.pi)).alias("normal"))


def backtest_scores(path: DataFrame) -> DataFrame:
    """One row of a walk-forward path: errors, those of the anchor as forecast, skills and coverages."""
    m, n = point_metrics("y_true", "y_pred"), point_metrics("y_true", "y_anchor")
    out = [c.alias(k) for k, c in m.items()] + [c.alias(f"{k}_naive") for k, c in n.items()]
    out += [coverage("y_true", f"lower_{k}", f"upper_{k}").alias(f"coverage_{k}") for k in (50, 80, 90, 95)]
    s = path.agg(*out, directional_accuracy("y_true", "y_pred", "y_anchor").alias("directional_accuracy"))
    return s.withColumn("skill_mae", 1 - ratio("mae", "mae_naive")).withColumn("skill_rmse", 1 - ratio("rmse", "rmse_naive"))
