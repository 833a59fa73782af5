"""Walk-forward and combinatorial backtests.

All refits of a plan need Gram matrices of row ranges only, so the rows are read once: each block of
rows between plan boundaries gives its matrix, and a model's is the sum of its blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import johnson_su_ppf
from ..session import computed_once
from .distribution import fit_johnson_su, johnson_su_fits
from .gam import Fit, Gram, Term, design_row, fit, predict, stepwise
from .scores import LEVELS, backtest_scores, bates_granger, benchmark_tests, berkowitz_moments, deflated_sharpe, dm_p_value, path_metrics, point_metrics, probabilistic_scores
from .splits import cpcv_combos, cpcv_paths, cpcv_splits, fold_bounds, walk_forward_plan
from .volatility import next_sigma


def block_grams(df: DataFrame, terms: list[Term], y: str, block: str) -> dict[int, Gram]:
    """Gram matrices per value of the int column `block` (some dozens), in one pass."""
    names = list(dict.fromkeys([*[t.name for t in terms], *[t.other.name for t in terms if t.other], y, block]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for f in frames:
            for key, part in f.dropna().groupby(block):
                x = np.column_stack([np.ones(len(part)), *[t.basis(part) for t in terms]])
                v = part[y].to_numpy(float)
                new = [x.T @ x, x.T @ v, float(v @ v), float(len(v))]
                sums[int(key)] = [a + b for a, b in zip(sums[int(key)], new, strict=True)] if int(key) in sums else new
        for key, (g, b, yy, n) in sums.items():
            yield pd.DataFrame({"block": [key], "g": [g.tobytes()], "b": [b.tobytes()], "yy": [yy], "n": [n]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        g, b = (sum(np.frombuffer(x) for x in f[c]).tobytes() for c in ("g", "b"))
        return pd.DataFrame({"block": [f["block"].iloc[0]], "g": [g], "b": [b], "yy": [f["yy"].sum()], "n": [f["n"].sum()]})

    shape = "block int, g binary, b binary, yy double, n double"
    rows = df.select(*names).mapInPandas(run, shape).groupBy("block").applyInPandas(add, shape).collect()
    width = 1 + sum(t.width for t in terms)
    return {r["block"]: Gram(terms, np.frombuffer(r["g"]).reshape(width, width), np.frombuffer(r["b"]), r["yy"], r["n"]) for r in rows}


def summed(grams: list[Gram]) -> Gram:
    return Gram(grams[0].terms, sum(m.g for m in grams), sum(m.b for m in grams), sum(m.yy for m in grams), sum(m.n for m in grams))


@dataclass(frozen=True)
class WalkForward:
    """A plan and how its models are made.

    sigma_source: gam (the model's own deviation), garch (the next deviation of a GARCH or EWMA filter over
    the out-of-sample residuals so far, once there are vol_rows) or blend (the root of both variances'
    mean).  criterion: aic or bic for a backward selection inside each fold, down to `most` terms at least where given.
    The bands' shape is fitted to the last shape_tail out-of-sample residuals once there are shape_rows, else to the
    residuals of the training rows.
    """

    initial_frac: float = 0.6
    refit: int = 63
    test: int = 63
    embargo: int = 0
    lams: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)
    sigma_source: str = "gam"
    criterion: str | None = None
    most: int | None = None
    shape_rows: int = 200
    shape_tail: int = 1000
    vol_rows: int = 150


def scored_by(rows: DataFrame, fits: list[Fit], spans: list[tuple[int, int, int, int]], keep: list[str]) -> DataFrame:
    """(version, kind, keep, mu, sigma): rows scored by each span's fit, in one pass; spans are (version, kind, first, end) of row_pos."""
    shared = rows.sparkSession.sparkContext.broadcast(([(f.terms, f.beta, f.cov, f.scale) for f in fits], spans))
    needed = list(dict.fromkeys([n for f in fits for t in f.terms for n in (t.name, *([t.other.name] if t.other else []))]))
    wanted = list(dict.fromkeys([*keep, *needed]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, listed = shared.value
        for batch in batches:
            at = batch.column(wanted.index("row_pos")).to_numpy()
            kept = batch.select(range(len(keep)))
            frame = pa.Table.from_batches([batch]).select(needed).to_pandas().astype(float)
            gone = frame.isna().any(axis=1).to_numpy()
            frame = frame.fillna(0.0)
            for version, kind, first, end in listed:
                mine = np.flatnonzero((at >= first) & (at < end))
                if not len(mine):
                    continue
                terms, beta, cov, scale = models[version]
                x = design_row(terms, frame.iloc[mine])
                mu, sigma = x @ beta, np.sqrt(np.maximum(((x @ cov) * x).sum(1) + scale, 0.0))
                own = kept.take(pa.array(mine))
                columns = [pa.array(np.full(len(mine), v, np.int32)) for v in (version, kind)]
                yield pa.RecordBatch.from_arrays([*columns, *own.columns, pa.array(mu, mask=gone[mine]), pa.array(sigma, mask=gone[mine])], names=["version", "kind", *keep, "mu", "sigma"])

    kinds = dict(rows.dtypes)
    return rows.select(*wanted).mapInArrow(run, "version int, kind int, " + ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", mu double, sigma double")


def _shapes(versions: int, settings: WalkForward) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per model the shape of its bands, and the filtered deviation, each from residuals known at its start."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=["y", "mu", "sigma"])
        test, train = f[f.kind == 1].sort_values(["version", "row_pos"]), f[f.kind == 0]
        version, e, sigma = test["version"].to_numpy(), (test["y"] - test["mu"]).to_numpy(), test["sigma"].to_numpy().copy()
        out = []
        for v in range(versions):
            past, own = int(np.searchsorted(version, v)), slice(*np.searchsorted(version, [v, v + 1]))
            if past >= settings.shape_rows:
                lo = max(past - settings.shape_tail, 0)
                z = e[lo:past] / np.maximum(sigma[lo:past], 1e-8)
            else:
                t = train[train.version == v]
                z = ((t["y"] - t["mu"]) / np.maximum(t["sigma"], 1e-8)).to_numpy()
            vol = next_sigma(e[:past]) if settings.sigma_source != "gam" and past >= settings.vol_rows else None
            vol = vol if vol is not None and np.isfinite(vol) and vol > 0 else None
            if vol is not None:
                sigma[own] = vol if settings.sigma_source == "garch" else np.sqrt((sigma[own] ** 2 + vol**2) / 2)
            out.append((v, *fit_johnson_su(z, True), vol))
        return pd.DataFrame(out, columns=["version", "nu", "tau", "loc", "scale", "vol"]).astype({"version": "int32", "vol": float})

    return run


def walk_forward(rows: DataFrame, n: int, terms: list[Term], settings: WalkForward = WalkForward(), log_return: bool = True) -> DataFrame:
    """The out-of-sample path of rows (row_pos, date, t1, y, y_level, anchor, features) of one series.

    (date, y_true, y_pred, y_pred_model, sigma_model, y_anchor, model_version, lower_/upper_ at four
    levels).  Models are fitted on all rows before their start, from Gram matrices of one pass, and all
    score the rows up to their end in one more.  Bands are those of a Johnson SU distribution (see
    WalkForward); its shapes follow the series in time, so one task fits them.
    """
    if settings.sigma_source not in ("gam", "garch", "blend"):
        raise ValueError(f"unknown sigma source {settings.sigma_source!r}")
    plan = walk_forward_plan(n, settings.initial_frac, settings.refit, settings.test, settings.embargo)
    if not plan:
        raise ValueError("too few rows for the plan")
    blocks = F.lit(0)
    for i, (_, start, _) in enumerate(plan):
        blocks = F.when(F.col("row_pos") >= start, i + 1).otherwise(blocks)
    grams = block_grams(rows.withColumn("_block", blocks), terms, "y", "_block")
    fits, spans, seen = [], [], 0
    for version, start, end in plan:
        known = summed([grams[b] for b in range(version + 1) if b in grams])
        fits.append(stepwise(known, list(settings.lams), settings.criterion, settings.most)[0] if settings.criterion else fit(known, list(settings.lams)))
        spans += [(version, 1, start, end)] + ([(version, 0, 0, start)] if seen < settings.shape_rows else [])
        seen += end - start
    scored = scored_by(rows, fits, spans, ["row_pos", "date", "y", "y_level", "anchor"])
    shapes = scored.select("version", "kind", "row_pos", "y", "mu", "sigma", F.lit(0).alias("series")).groupBy("series").applyInPandas(_shapes(len(plan), settings), "version int, nu double, tau double, loc double, scale double, vol double")
    path = scored.where("kind = 1").join(F.broadcast(shapes), "version")  # one row a model
    own = {"garch": F.coalesce("vol", "sigma"), "blend": F.coalesce(F.sqrt((F.col("sigma") * F.col("sigma") + F.col("vol") * F.col("vol")) / 2), F.col("sigma"))}.get(settings.sigma_source, F.col("sigma"))
    path = path.withColumn("sigma", own)
    price = lambda v: F.col("anchor") * F.exp(v) if log_return else v
    at, width = F.col("mu") + F.col("sigma") * F.col("loc"), F.col("sigma") * F.col("scale")
    bands = [price(johnson_su_ppf((1 + side * level) / 2, F.col("nu"), F.col("tau"), at, width)).alias(f"{name}_{round(level * 100)}") for level in LEVELS for side, name in ((-1, "lower"), (1, "upper"))]
    return path.select("date", F.col("y_level").alias("y_true"), price(F.col("mu")).alias("y_pred"), F.col("mu").alias("y_pred_model"), F.col("sigma").alias("sigma_model"), F.col("anchor").alias("y_anchor"), F.col("version").alias("model_version"), *bands)


def path_scores(path: DataFrame, log_return: bool = True) -> dict[str, float]:
    """All scores of a walk-forward path: errors against the anchor's, coverages, benchmark tests, and those of one Johnson SU fit in model space."""
    actual = F.ln(F.col("y_true") / F.greatest(F.col("y_anchor"), F.lit(1e-12))) if log_return else F.col("y_true")
    model = path.where("sigma_model > 0").select("date", actual.alias("y"), "y_pred_model", "sigma_model", (F.lit(0.0) if log_return else F.col("y_anchor")).alias("anchor"), ((actual - F.col("y_pred_model")) / F.col("sigma_model")).alias("z"), F.lit("path").alias("series"))
    shape = johnson_su_fits(model, ["series"], "z", True).first()
    su = [F.lit(shape[c]) for c in ("nu", "tau", "loc", "scale")]
    found = backtest_scores(path).first().asDict() | benchmark_tests(path.withColumn("series", F.lit("path")), ["series"], "date", "y_true", "y_pred", "y_anchor", "y_anchor").drop("series").first().asDict()
    prob = probabilistic_scores(model, ["series"], "y", "y_pred_model", "sigma_model", "anchor", *su).drop("series").first().asDict()
    normal = su[0] + su[1] * F.asinh((F.col("z") - su[2]) / su[3])
    lr, p = berkowitz_moments(model.withColumn("w", normal), "date", "w")
    found |= {f"{k}_model": v for k, v in prob.items()} | {"berkowitz_lr_model": lr, "berkowitz_pvalue_model": p, "dm_pvalue": dm_p_value(found["dm_stat"], found["n"]) if found["dm_stat"] is not None else None}
    return {k: None if v is None else float(v) for k, v in found.items()}


#: What sources of the deviation are compared by.
GATE = ("mspe_ratio", "dm_pvalue", "directional_accuracy", "pt_pvalue", "crps_model", "log_score_model", "berkowitz_pvalue_model", "coverage_95", "skill_rmse")


def sigma_gate(rows: DataFrame, n: int, terms: list[Term], settings: WalkForward = WalkForward()) -> dict[str, dict[str, float]]:
    """The scores of GATE under each source of the deviation."""
    out = {}
    for source in ("gam", "garch", "blend"):
        found = path_scores(computed_once(walk_forward(rows, n, terms, replace(settings, sigma_source=source))))
        out[source] = {k: found[k] for k in GATE}
    return out


def weights_from_path(path: DataFrame) -> dict[str, float]:
    """The weight of the forecast against the anchor that has the least squared error on a path, and what it gains."""
    rows = path.withColumn("series", F.lit("path"))
    best = bates_granger(rows, ["series"], "y_true", "y_pred", "y_anchor").first()
    own = rows.agg(*[c.alias(f"{k}_{which}") for which, f in (("model", "y_pred"), ("naive", "y_anchor")) for k, c in point_metrics("y_true", f).items() if k == "rmse"]).first()
    gain = lambda other: 1 - best["rmse"] / other if other else None
    return {"w_model": best["weight"], "w_naive": 1 - best["weight"], "rmse_combined": best["rmse"], "rmse_model": own["rmse_model"], "rmse_naive": own["rmse_naive"], "skill_vs_model": gain(own["rmse_model"]), "skill_vs_naive": gain(own["rmse_naive"])}


@dataclass
class CpcvResult:
    path_returns: DataFrame
    path_metrics: DataFrame
    summary: DataFrame


def cpcv_backtest(rows: DataFrame, n: int, factory: SumsModel | Callable[[pd.DataFrame, np.ndarray], Callable[[pd.DataFrame], np.ndarray]], features: list[str], groups: int = 6, k: int = 2, pct_embargo: float = 0.01, log_return: bool = True) -> CpcvResult:
    """Returns of trading the sign of the forecast along every path of combinatorial purged cross-validation.

    A factory that is a SumsModel is fitted from sums: rows are read once for the products of every cell between purge bounds, each
    combination adds its cells, and one more pass scores.  Any other factory(features, y) gives a predictor; one task
    then fits one combination on all its training rows.  A combination without training rows leaves its cells of the paths out.
    """
    spark = rows.sparkSession
    bounds = spark.createDataFrame([(g, a, b) for g, (a, b) in enumerate(fold_bounds(n, groups))], "grp int, first long, last long")
    if isinstance(factory, SumsModel):
        on_path = _cpcv_from_sums(rows, n, factory, features, groups, k, pct_embargo)
    else:
        splits = cpcv_splits(rows, n, groups, k, pct_embargo)
        joined = splits.join(rows.select("row_pos", "y", *features), "row_pos")

        def run(f: pd.DataFrame) -> pd.DataFrame:
            train, test = f[f.role == "train"].dropna(), f[f.role == "test"]
            if not len(train):
                return pd.DataFrame({"fold": [], "row_pos": [], "forecast": []})
            model = factory(train[features], train["y"].to_numpy(float))
            return pd.DataFrame({"fold": test["fold"], "row_pos": test["row_pos"], "forecast": model(test[features])})

        forecasts = joined.groupBy("fold").applyInPandas(run, "fold int, row_pos long, forecast double")
        cells = cpcv_paths(spark, groups, k).join(bounds, "grp")
        base = rows.select("row_pos", "date", "anchor", "y_level")
        on_path = forecasts.join(F.broadcast(cells), "fold").where(F.col("row_pos").between(F.col("first"), F.col("last"))).join(base, "row_pos")
    change = F.ln(F.greatest("y_level", F.lit(1e-12)) / F.greatest("anchor", F.lit(1e-12)))
    side = F.signum(F.col("forecast")) if log_return else F.signum(F.col("forecast") - F.col("anchor"))
    returns = on_path.select("path", "date", (side * change).alias("r"))
    metrics = path_metrics(returns, ["path"], "date", "r")
    shape = returns.groupBy("path").agg(F.count("r").alias("n"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))
    per = metrics.join(shape, "path").withColumn("per_period", F.col("sharpe") / np.sqrt(252.0))
    figures = per.agg(
        F.avg("sharpe").alias("mean_sharpe"), F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"), F.stddev_samp("sharpe").alias("std_sharpe"), F.percentile("sharpe", F.lit(0.05)).alias("p5_sharpe"), F.percentile("sharpe", F.lit(0.95)).alias("p95_sharpe"),
        F.max("sharpe").alias("max_sharpe"), F.avg((F.col("sharpe") <= 0).cast("double")).alias("pbo"), F.count("*").alias("paths"), F.stddev_samp("per_period").alias("_sd"), F.avg("per_period").alias("_sr"), F.avg("skew").alias("_sk"), F.avg("kurt").alias("_ku"), F.avg("n").alias("_n"),
    )
    trials = max(2, k * len(cpcv_combos(groups, k)) // groups)
    summary = figures.withColumn("deflated_sharpe", deflated_sharpe(F.col("_sr"), F.coalesce("_sd", F.lit(0.0)), trials, F.col("_n"), F.col("_sk"), F.col("_ku"))).drop("_sd", "_sr", "_sk", "_ku", "_n")
    return CpcvResult(returns, metrics, summary)


@dataclass(frozen=True)
class SumsModel:
    """A plug-in model linear in columns made from a row: design(frame of features) has a first column of ones; solve(g, b, yy, n) gives the
    coefficients from sums of products g of the columns, b of columns and y, yy of y's squares, and the rows n."""

    design: Callable[[pd.DataFrame], np.ndarray]
    solve: Callable[[np.ndarray, np.ndarray, float, float], np.ndarray]

    def __call__(self, x: pd.DataFrame, y: np.ndarray) -> Callable[[pd.DataFrame], np.ndarray]:
        d = self.design(x)
        beta = self.solve(d.T @ d, d.T @ y, float(y @ y), float(len(y)))
        return lambda f: self.design(f.fillna(0.0)) @ beta


def _with_ones(f: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), f.to_numpy(float)])


def ridge_factory(lam: float = 1.0) -> SumsModel:
    """A ridge regression on standardised features as plug-in model."""

    def solve(g: np.ndarray, b: np.ndarray, yy: float, n: float) -> np.ndarray:
        mean, top = g[0, 1:] / n, b[0] / n
        products = g[1:, 1:] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(products) / n, 0.0))
        sd = np.where(sd > 1e-12 * np.maximum(np.abs(mean), 1e-300), sd, 1.0)
        slope = np.linalg.solve(products / np.outer(sd, sd) + lam * np.eye(len(sd)), (b[1:] - mean * b[0]) / sd) / sd
        return np.concatenate([[top - float(mean @ slope)], slope])

    return SumsModel(_with_ones, solve)


def gam_factory(terms: list[Term], lams: list[float] | None = None) -> SumsModel:
    """An additive model of terms as plug-in model."""
    return SumsModel(lambda f: design_row(terms, f), lambda g, b, yy, n: fit(Gram(terms, g, b, yy, n), lams).beta)


def _cell_sums(rows: DataFrame, model: SumsModel, features: list[str], cell: Column) -> dict[int, tuple]:
    """g, b, yy and n of the complete rows of each cell, in one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for f in frames:
            for key, part in f.dropna().groupby("cell"):
                x, y = model.design(part[features]), part["y"].to_numpy(float)
                new = [x.T @ x, x.T @ y, float(y @ y), float(len(y))]
                sums[int(key)] = [p + q for p, q in zip(sums[int(key)], new, strict=True)] if int(key) in sums else new
        for key, (g, b, yy, n) in sums.items():
            yield pd.DataFrame({"cell": [np.int32(key)], "part": [np.int32(TaskContext.get().partitionId())], "g": [g.tobytes()], "b": [b.tobytes()], "yy": [yy], "n": [n]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        g, b = (sum(np.frombuffer(x) for x in f[c]).tobytes() for c in ("g", "b"))
        return pd.DataFrame({"cell": [f["cell"].iloc[0]], "part": [np.int32(f["part"].iloc[0] // 64)], "g": [g], "b": [b], "yy": [f["yy"].sum()], "n": [f["n"].sum()]})

    shape = "cell int, part int, g binary, b binary, yy double, n double"
    sent = rows.select("y", *features, cell.alias("cell")).mapInPandas(run, shape)
    once = sent.groupBy("cell", F.floor(F.col("part") / 64)).applyInPandas(add, shape)  # 64 partitions' rows a task, then one row a task
    out = {}
    for r in once.groupBy("cell").applyInPandas(add, shape).collect():  # (groups + 1) squared rows at most
        b = np.frombuffer(r["b"])
        out[r["cell"]] = (np.frombuffer(r["g"]).reshape(len(b), len(b)), b, r["yy"], r["n"])
    return out


def _cpcv_from_sums(rows: DataFrame, n: int, model: SumsModel, features: list[str], groups: int, k: int, pct_embargo: float) -> DataFrame:
    """(path, date, anchor, y_level, forecast): see cpcv_backtest."""
    spans, combos, embargo = fold_bounds(n, groups), cpcv_combos(groups, k), int(n * pct_embargo)
    starts = {r["row_pos"]: r["date"] for r in rows.where(F.col("row_pos").isin([a for a, _ in spans])).select("row_pos", "date").collect()}  # groups rows
    opens = [F.lit(starts[a]) for a, _ in spans]
    # a row is clear of tests that start with group f if fewer than f + 1 groups open by its end, and of those that end with group l if more than l embargoes are over
    before = functools.reduce(lambda x, y: x + y, [F.when(F.col("t1") >= d, 1).otherwise(0) for d in opens])
    after = functools.reduce(lambda x, y: x + y, [F.when(F.col("row_pos") >= b + 1 + embargo, 1).otherwise(0) for _, b in spans])
    sums = _cell_sums(rows, model, features, (before * (groups + 1) + after).cast("int"))
    fits: dict[int, np.ndarray] = {}
    for fold, combo in enumerate(combos):
        own = [v for c, v in sums.items() if c // (groups + 1) <= min(combo) or c % (groups + 1) > max(combo)]
        if own:
            fits[fold] = model.solve(*(sum(x) for x in zip(*own, strict=True)))
    seen, places = [0] * groups, {g: [] for g in range(groups)}
    for fold, combo in enumerate(combos):
        for g in combo:
            if fold in fits:
                places[g].append((seen[g], fold))
            seen[g] += 1
    shared = rows.sparkSession.sparkContext.broadcast((fits, places))
    last_of = np.array([b for _, b in spans])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        betas, listed = shared.value
        for f in frames:
            group = np.searchsorted(last_of, f["row_pos"].to_numpy())
            x = model.design(f[features].fillna(0.0))
            for g in np.unique(group):
                own = group == g
                for path, fold in listed[int(g)]:
                    yield f.loc[own, ["date", "anchor", "y_level"]].assign(path=np.int32(path), forecast=x[own] @ betas[fold])

    kinds = dict(rows.dtypes)
    shape = f"date {kinds['date']}, anchor {kinds['anchor']}, y_level {kinds['y_level']}, path int, forecast double"
    return rows.select("row_pos", "date", "anchor", "y_level", *features).mapInPandas(score, shape)


def next_day_forecast(last: DataFrame, found: Fit, q: float = 1.96) -> DataFrame:
    """(date, target_date, price, low, high) of the last rows (date, anchor, features): the conformal band in price space."""
    from ..functions.calendar import next_business_day

    scored = predict(last, found, "mu", "sigma")
    price = lambda v: F.col("anchor") * F.exp(v)
    return scored.select("date", next_business_day(F.col("date")).alias("target_date"), price(F.col("mu")).alias("price"), price(F.col("mu") - q * F.col("sigma")).alias("low"), price(F.col("mu") + q * F.col("sigma")).alias("high"))


def what_if_scenarios(last: DataFrame, found: Fit, feature: str, shares: tuple[float, ...] = (-0.05, 0.0, 0.05)) -> DataFrame:
    """(share, x, mu): forecasts of one row with a feature moved by shares of its value."""
    table = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    moved = last.select("*", table).withColumn(feature, F.col(feature) * (1 + F.col("share")))
    return predict(moved, found, "mu").select("share", F.col(feature).alias("x"), "mu")


def what_if(last: DataFrame, found: Fit, feature: str, low: float, high: float, points: int = 100) -> DataFrame:
    """Forecasts of one row with a feature swept evenly from low - 10 % to high + 10 % of its range."""
    pad = 0.1 * (high - low)
    grid = last.crossJoin(last.sparkSession.range(points).withColumnRenamed("id", "_i"))
    grid = grid.withColumn(feature, F.lit(low - pad) + F.col("_i") * ((high - low + 2 * pad) / (points - 1)))
    return predict(grid, found, "mu").select(F.col(feature).alias("x"), "mu")


def cross_validate(rows: DataFrame, n: int, terms: list[Term], y: str, k: int = 5, lams: list[float] | None = None) -> list[dict[str, float]]:
    """Per contiguous fold the errors of a model fitted on the other folds.

    One pass gives all Gram matrices, from which squared errors follow; one more scores every fold's rows for
    the absolute ones.
    """
    bounds = fold_bounds(n, k)
    block = F.lit(0)
    for f, (a, _) in enumerate(bounds):
        block = F.when(F.col("row_pos") >= a, f).otherwise(block)
    grams = block_grams(rows.withColumn("_block", block), terms, y, "_block")
    fits = {f: fit(summed([m for g, m in grams.items() if g != f]), lams) for f in sorted(grams)}
    spans = [(i, 1, bounds[f][0], bounds[f][1] + 1) for i, f in enumerate(fits)]
    scored = scored_by(rows, list(fits.values()), spans, ["row_pos", y]).groupBy("version").agg(*[c.alias(name) for name, c in point_metrics(y, "mu").items()])
    absolute = {r["version"]: r for r in scored.collect()}
    out = []
    for i, (f, found) in enumerate(fits.items()):
        own = grams[f]
        sse = own.yy - 2 * float(found.beta @ own.b) + float(found.beta @ own.g @ found.beta)
        mean = own.b[0] / own.n
        out.append({"fold": f, "n": own.n, "rmse": float(np.sqrt(max(sse, 0.0) / own.n)), "mae": absolute[i]["mae"], "mape": absolute[i]["mape"], "r2": float(1 - sse / max(own.yy - own.n * mean * mean, 1e-300)), "lam": float(found.lam)})
    return out


def cross_validation_means(folds: list[dict[str, float]]) -> dict[str, float]:
    return {k: float(np.mean([f[k] for f in folds if f[k] is not None])) for k in ("rmse", "mae", "mape", "r2")}


def sigma_fit(rows: DataFrame, terms: list[Term], y: str, mu: Fit, names: list[str] | None = None, lams: list[float] | None = None) -> Fit:
    """A model of the log absolute residual on the terms named (all, if none of them is there)."""
    from .gam import gram, sigma_target

    chosen = [t for t in terms if names and t.name in names] or terms
    scored = predict(rows, mu, "_mu").withColumn("_s", sigma_target(y, "_mu"))
    return fit(gram(scored, chosen, "_s"), lams)
