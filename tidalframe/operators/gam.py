"""Additive models from distributed sufficient statistics.

A pass over the rows expands features to their basis and sums the Gram matrix in each partition; every
penalty, subset of terms and information criterion is then solved on the driver from that one
matrix, whose size depends on the terms alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import norm_cdf

#: Parts of names that mark the classes of features, in order of their test.
CYCLIC = ("day_of_week", "month", "day_of_year", "quarter")
LINEAR = (
    "usd_index", "cpi", "fed_funds", "t10y2y", "t3m_yield", "t5y_yield", "t10y_yield", "t30y_yield", "eur_usd", "gbp_usd", "usd_cad", "usd_nok", "usd_rub", "usd_cny", "aud_usd", "nzd_usd", "usd_chf",
    "nfci", "stlfsi", "epu_us", "epu_global", "pmi_mfg", "retail_gas", "miles_driven", "fed_balance", "rrp", "ig_spread", "ted_spread", "driving_season", "heating_season", "us_holiday", "gpr_spike",
)
ROLLING = ("_sma_", "_ema_", "_std_", "_bb_", "macd", "_rsi_", "crack_", "_atr_", "_williams_r_", "_stoch_", "_cmf_", "corr_", "_momentum_", "_parkinson_", "_garman_klass_", "_rogers_satchell_", "_yang_zhang_")
LAG, RETURN = ("_lag_",), ("_pct_change", "_log_return")
#: Parts of names of the features that models of the deviation, and of skewness and tail, are built on.
SIGMA_PARTS = ("ovx", "vix", "_std_", "_bb_width", "hy_spread", "_log_return", "t5yie", "t10yie", "_atr_", "_atr_pct", "_stoch_", "_williams_r_", "nfci", "stlfsi", "_parkinson_", "_garman_klass_", "_rogers_satchell_", "_yang_zhang_")
SHAPE_PARTS = ("ovx", "vix", "hy_spread", "t5yie", "t10yie", "nfci", "stlfsi", "epu_us")
#: The direction in which a feature may act, by the first part in its name.
DIRECTIONS = {"crude_stocks": -1, "cushing_stocks": -1, "gasoline_stocks": -1, "distillate_stocks": -1, "usd_index": -1, "refinery_utilization": 1, "crude_exports": 1}
#: Parts of names of skewed features, and of pairs whose joint effect is modelled.
SKEWED = ("_pct_change", "_log_return", "_rsi_", "_williams_r_", "_stoch_", "_bb_pct_", "_spread", "_momentum_", "_dist_sma_", "_pct_range")
PAIRS = (("usd_index", "crude_stocks"), ("vix_close", "ovx"), ("CL=F_close_rsi_14", "CL=F_close_atr_14"), ("brent_wti_spread", "usd_index"), ("wti_m1_m2_spread", "crude_stocks_chg"))
#: Basis functions by class, of rolling statistics by default, and of each side and the penalty of an interaction.
SIZES = {"day_of_week": 7, "month": 12, "cyclic": 30, "lag": 20, "return": 15, "spline": 20}
ROLLING_SIZE, PAIR_SIZE, PAIR_LAM = 25, 6, 10.0
#: GCV's inflation of the effective degrees of freedom.
GAMMA = 1.4


def classify(name: str) -> str:
    """cyclic, linear, rolling, lag, return or spline: the first group whose part is in the name, in any case."""
    for kind, parts in (("cyclic", CYCLIC), ("linear", LINEAR), ("rolling", ROLLING), ("lag", LAG), ("return", RETURN)):
        if named_by(name, parts):
            return kind
    return "spline"


def named_by(name: str, parts: tuple[str, ...]) -> bool:
    return any(p in name.lower() for p in parts)


def basis_size(name: str, rolling: int = ROLLING_SIZE) -> int:
    """Basis functions of a feature's term by its class; a linear term has one."""
    kind = classify(name)
    if kind == "cyclic":
        return next((SIZES[p] for p in ("day_of_week", "month") if p in name.lower()), SIZES["cyclic"])
    return {"linear": 1, "rolling": rolling}.get(kind) or SIZES[kind]


def direction(name: str) -> int:
    """1 or -1 where a feature may only raise or lower the target, else 0."""
    return next((way for part, way in DIRECTIONS.items() if part in name.lower()), 0)


def interactions(names: list[str], pairs: tuple[tuple[str, str], ...] = PAIRS) -> list[tuple[str, str]]:
    """The pairs of features of which exactly one name each has the part asked for."""
    out = []
    for pair in pairs:
        found = [[n for n in names if part.lower() in n.lower()] for part in pair]
        if len(found) == 2 and len(found[0]) == len(found[1]) == 1 and found[0] != found[1]:
            out.append((found[0][0], found[1][0]))
    return out


def chosen(names: list[str], *preferences: tuple[str, ...]) -> list[str]:
    """The names that the first preference with any names; all, if none has."""
    for parts in preferences:
        if kept := [n for n in names if named_by(n, parts)]:
            return kept
    return names


@dataclass(frozen=True)
class Term:
    """One additive term: `kind` linear, spline or cyclic over [low, high]; tensor terms carry a second feature.

    way: 1 or -1 for an effect that may only rise or fall; lam: a penalty of its own.
    """

    name: str
    kind: str = "linear"
    size: int = 8
    low: float = 0.0
    high: float = 1.0
    other: "Term | None" = None
    way: int = 0
    lam: float | None = None

    @property
    def width(self) -> int:
        own = 1 if self.kind == "linear" else self.size
        return own * (self.other.width if self.other else 1)

    def basis(self, frame: pd.DataFrame) -> np.ndarray:
        x = frame[self.name].to_numpy(float)
        own = self._own(x)
        if self.other is None:
            return own
        second = self.other.basis(frame)
        return (own[:, :, None] * second[:, None, :]).reshape(len(x), -1)

    def _own(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "linear":
            return ((x - self.low) / ((self.high - self.low) or 1.0))[:, None]
        u = (np.clip(x, self.low, self.high) - self.low) / ((self.high - self.low) or 1.0)
        if self.kind == "cyclic":
            return _cubic(u * self.size, self.size, True)
        return _cubic(u * (self.size - 3), self.size, False)

    def penalty(self) -> np.ndarray:
        """Squared second differences of the coefficients (a tiny ridge for a linear term); tensors add both sides'."""
        if self.kind == "linear":
            own = np.eye(1) * 1e-3
        else:
            d = np.diff(np.eye(self.size), 2, axis=0)
            if self.kind == "cyclic":
                d = np.stack([np.eye(self.size)[i] - 2 * np.eye(self.size)[(i + 1) % self.size] + np.eye(self.size)[(i + 2) % self.size] for i in range(self.size)])
            own = d.T @ d
        if self.other is None:
            return own
        return np.kron(own, np.eye(self.other.width)) + np.kron(np.eye(len(own)), self.other.penalty())


def _cubic(t: np.ndarray, size: int, wraps: bool) -> np.ndarray:
    """Uniform cubic B-splines at t in knot steps; each row sums to 1."""
    segment = np.minimum(np.floor(t), (size if wraps else size - 3) - 1).astype(int)
    v = t - segment
    weights = np.stack([(1 - v) ** 3, 3 * v**3 - 6 * v**2 + 4, -3 * v**3 + 3 * v**2 + 3 * v + 1, v**3], 1) / 6
    out = np.zeros((len(t), size))
    for k in range(4):
        at = (segment + k) % size if wraps else segment + k
        np.add.at(out, (np.arange(len(t)), at), weights[:, k])
    return out


@dataclass
class Gram:
    """Sums of basis products: intercept first, then terms in order."""

    terms: list[Term]
    g: np.ndarray
    b: np.ndarray
    yy: float
    n: float

    def columns(self, keep: list[int]) -> np.ndarray:
        at, out = 1, [0]
        for i, t in enumerate(self.terms):
            if i in keep:
                out += range(at, at + t.width)
            at += t.width
        return np.array(out)


@dataclass
class Fit:
    terms: list[Term]
    beta: np.ndarray
    cov: np.ndarray
    lam: float
    edof: float
    rss: float
    n: float
    scale: float
    gcv: float
    aic: float
    bic: float
    r2: float
    p_values: list[float] = field(default_factory=list)

    @property
    def aicc(self) -> float:
        """AIC corrected for few rows."""
        k = self.edof + 1
        return self.aic + 2 * k * (k + 1) / max(self.n - k - 1, 1e-9)


#: Weight of a broken direction among the penalties, and rounds in which the broken ones are looked for.
BREACH, BREACH_ROUNDS = 1e6, 30


def _sums(terms: list[Term], y: str, weight: str | None, around: tuple[np.ndarray, float] | None = None) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, b, yy, n = None, None, 0.0, 0.0
        for f in frames:
            f = f.dropna()
            if not len(f):
                continue
            x = np.column_stack([np.ones(len(f)), *[t.basis(f) for t in terms]])
            target = f[y].to_numpy(float)
            w = f[weight].to_numpy(float) if weight else np.ones(len(f))
            if around is not None:
                w = w * np.where(target > x @ around[0], around[1], 1 - around[1])
            xw = x * w[:, None]
            g = xw.T @ x if g is None else g + xw.T @ x
            b = xw.T @ target if b is None else b + xw.T @ target
            yy += float((w * target * target).sum())
            n += float(w.sum())
        if g is not None:
            yield pd.DataFrame({"g": [g.astype("<f8").tobytes()], "b": [b.astype("<f8").tobytes()], "yy": [yy], "n": [n]})

    return run


def gram(df: DataFrame, terms: list[Term], y: str, weight: str | None = None, fan_in: int = 16, around: tuple[np.ndarray, float] | None = None) -> Gram:
    """One pass over df; around (coefficients, level) weighs rows above their fit by the level and others by the rest; partitions' matrices are added in a tree of `fan_in`, so the driver adds few."""
    names = list(dict.fromkeys([*[t.name for t in terms], *[t.other.name for t in terms if t.other], y, *([weight] if weight else [])]))
    parts = df.select(*names).mapInPandas(_sums(terms, y, weight, around), "g binary, b binary, yy double, n double")
    width = 1 + sum(t.width for t in terms)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for r in f.itertuples():
                now = [np.frombuffer(r.g), np.frombuffer(r.b), r.yy, r.n]
                total = now if total is None else [a + c for a, c in zip(total, now, strict=True)]
        if total is not None:
            yield pd.DataFrame({"g": [total[0].tobytes()], "b": [total[1].tobytes()], "yy": [total[2]], "n": [total[3]]})

    rows = parts.repartition(fan_in).mapInPandas(add, parts.schema).collect()
    if not rows:
        raise ValueError("no complete rows")
    g = sum(np.frombuffer(r["g"]) for r in rows).reshape(width, width)
    return Gram(terms, g, sum(np.frombuffer(r["b"]) for r in rows), float(sum(r["yy"] for r in rows)), float(sum(r["n"] for r in rows)))


def solve(m: Gram, lam: float, keep: list[int] | None = None) -> Fit:
    """The penalised fit of a subset of terms, with its criteria and a Wald p value per term."""
    keep = list(range(len(m.terms))) if keep is None else keep
    at = m.columns(keep)
    terms = [m.terms[i] for i in keep]
    g, b = m.g[np.ix_(at, at)], m.b[at]
    p = np.zeros_like(g)
    i = 1
    spans = []
    for t in terms:
        p[i : i + t.width, i : i + t.width] = t.penalty() * (1.0 if t.lam is None else t.lam / max(lam, 1e-12))
        spans.append((i, i + t.width))
        i += t.width
    ridge = np.eye(len(g)) * 1e-7 * max(float(np.trace(g)) / len(g), 1e-12)
    base = g + lam * p + ridge
    inverse = np.linalg.pinv(base, hermitian=True)
    beta = inverse @ b
    ways = [(span, t.way) for span, t in zip(spans, terms, strict=True) if t.way and t.other is None]
    held = np.zeros(0, int)
    for _ in range(BREACH_ROUNDS if ways else 0):  # steps against a term's direction are penalised until none is left
        steps = np.zeros((0, len(g)))
        for (lo, hi), way in ways:
            d = np.zeros((max(hi - lo - 1, 1), len(g)))
            if hi - lo == 1:
                d[0, lo] = way
            else:
                d[np.arange(hi - lo - 1), np.arange(lo, hi - 1)], d[np.arange(hi - lo - 1), np.arange(lo + 1, hi)] = -way, way
            steps = np.concatenate([steps, d])
        broken = np.union1d(held, np.flatnonzero(steps @ beta < -1e-9 * max(float(np.abs(beta).max()), 1e-12)))
        if len(broken) == len(held):
            break
        held = broken
        inverse = np.linalg.pinv(base + BREACH * max(float(np.trace(g)) / len(g), 1e-12) * steps[held].T @ steps[held], hermitian=True)
        beta = inverse @ b
    edof = float(np.trace(inverse @ g))
    rss = max(m.yy - 2 * float(beta @ b) + float(beta @ g @ beta), 1e-300)
    scale = rss / max(m.n - edof, 1e-9)
    cov = inverse @ g @ inverse * scale
    gcv = m.n * rss / max(m.n - GAMMA * edof, 1e-9) ** 2
    aic = m.n * (math.log(2 * math.pi * rss / m.n) + 1) + 2 * (edof + 1)
    mean = m.b[0] / m.n
    ps = []
    for lo, hi in spans:
        # a spline's level is the intercept's: both are taken without it, and directions without variance don't count
        c, centred = cov[lo:hi, lo:hi], beta[lo:hi]
        if hi - lo > 1:
            apart = np.eye(hi - lo) - 1 / (hi - lo)
            c, centred = apart @ c @ apart, apart @ centred
        values, vectors = np.linalg.eigh((c + c.T) / 2)
        real = values > 1e-9 * max(float(values.max()), 1e-300)
        wald = float(((vectors[:, real].T @ centred) ** 2 / values[real]).sum())
        k = max(float(np.trace(inverse[lo:hi, lo:hi] @ g[lo:hi, lo:hi])), 0.5)
        z = ((wald / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))  # Wilson-Hilferty
        ps.append(1 - norm_cdf(z))
    return Fit(terms, beta, cov, lam, edof, rss, m.n, scale, gcv, aic, aic + edof * (math.log(m.n) - 2), 1 - rss / max(m.yy - m.n * mean * mean, 1e-300), ps)


def fit(m: Gram, lams: list[float] | None = None, keep: list[int] | None = None) -> Fit:
    """The fit of least GCV over a grid of one penalty for all terms."""
    return min((solve(m, lam, keep) for lam in (lams or np.logspace(-3, 3, 11).tolist())), key=lambda f: f.gcv)


def stepwise(m: Gram, lams: list[float], criterion: str = "aic", most: int | None = None) -> tuple[Fit, list[int]]:
    """Backward selection: the least significant term goes while the criterion doesn't worsen, or there are more than `most`.

    Trials use the grid's middle penalty and sub-blocks of one Gram matrix: no pass over data.
    """
    middle = sorted(lams)[len(lams) // 2]
    keep = list(range(len(m.terms)))
    now = solve(m, middle, keep)
    while len(keep) > 1:
        worst = int(np.argmax(now.p_values))
        fewer = keep[:worst] + keep[worst + 1 :]
        trial = solve(m, middle, fewer)
        if getattr(trial, criterion) > getattr(now, criterion) and not (most and len(keep) > most):
            break
        keep, now = fewer, trial
    return fit(m, lams, keep), keep


def design_row(terms: list[Term], frame: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(frame)), *[t.basis(frame) for t in terms]])


def predict(df: DataFrame, found: Fit, out: str = "mu", sigma: str | None = None) -> DataFrame:
    """df with the fit's mean, and with `sigma` the predictive deviation; rows with missing features get null."""
    shared = df.sparkSession.sparkContext.broadcast((found.terms, found.beta, found.cov, found.scale))
    needed = list(dict.fromkeys([*[t.name for t in found.terms], *[t.other.name for t in found.terms if t.other]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, beta, cov, scale = shared.value
        for batch in batches:
            f = pa.Table.from_batches([batch]).select(needed).to_pandas().astype(float)
            x = design_row(terms, f.fillna(0.0))
            gone = f.isna().any(axis=1).to_numpy()
            columns = [*batch.columns, pa.array(x @ beta, mask=gone)]
            if sigma:
                columns.append(pa.array(np.sqrt(np.maximum(((x @ cov) * x).sum(1) + scale, 0.0)), mask=gone))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out, *([sigma] if sigma else [])])

    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` double" + (f", `{sigma}` double" if sigma else "")
    return df.mapInArrow(run, shape)


def terms_for(df: DataFrame, names: list[str], size: int | None = None, rolling: int = ROLLING_SIZE, monotone: bool = False, pairs: bool = False, pair_size: int = PAIR_SIZE, pair_lam: float = PAIR_LAM) -> list[Term]:
    """Terms by the names' classes, over each feature's range (one aggregate).

    size: basis functions of every spline and cyclic term, instead of each class's own.  monotone: known directions
    hold.  pairs: tensor terms of the known pairs follow.
    """
    r = df.agg(*[F.min(n).cast("double").alias(f"a{i}") for i, n in enumerate(names)], *[F.max(n).cast("double").alias(f"b{i}") for i, n in enumerate(names)]).first()
    out = []
    for i, n in enumerate(names):
        kind = classify(n)
        kind = kind if kind in ("linear", "cyclic") else "spline"
        way = direction(n) if monotone and kind == "spline" else 0
        out.append(Term(n, kind, size or max(basis_size(n, rolling), 1), r[f"a{i}"] or 0.0, r[f"b{i}"] if r[f"b{i}"] is not None else 1.0, way=way))
    by = {t.name: t for t in out}
    for a, b in interactions(names) if pairs else []:
        one, two = (Term(n, "spline", pair_size, by[n].low, by[n].high) for n in (a, b))
        out.append(Term(a, "spline", pair_size, one.low, one.high, other=two, lam=pair_lam))
    return out


def rank_knots(df: DataFrame, names: list[str], n_quantiles: int = 200) -> dict[str, list[float]]:
    """Even quantiles of each skewed feature among the names, from one aggregate."""
    skewed = [n for n in names if named_by(n, SKEWED)]
    if not skewed:
        return {}
    levels = F.array(*[F.lit(i / (n_quantiles - 1)) for i in range(n_quantiles)])
    r = df.agg(*[F.percentile(n, levels).alias(f"q{i}") for i, n in enumerate(skewed)]).first()
    return {n: [float(x) for x in r[f"q{i}"]] for i, n in enumerate(skewed) if r[f"q{i}"]}


def ranked(df: DataFrame, knots: dict[str, list[float]]) -> DataFrame:
    """df with each feature that has knots in its place among them: 0 to 1, linear between knots."""

    def place(name: str, at: list[float]) -> Column:
        x, listed, n = F.col(name), F.array(*[F.lit(v) for v in at]), len(at)
        below, upto = F.size(F.filter(listed, lambda k: k < x)), F.size(F.filter(listed, lambda k: k <= x))
        low, high = F.element_at(listed, F.greatest(below, F.lit(1))), F.element_at(listed, F.least(below + 1, F.lit(n)))
        inner = (below - 1 + F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))) / (n - 1)
        return F.when(x.isNull(), None).when(upto > below, (below + upto - 1) / F.lit(2.0) / (n - 1)).when(below == 0, 0.0).when(below == n, 1.0).otherwise(inner)

    return df.withColumns({name: place(name, at) for name, at in knots.items()})


def gram_many(df: DataFrame, terms: list[Term], y: str, weights: list[str]) -> list[Gram]:
    """The Gram matrix under each weight column, all from one pass."""
    names = list(dict.fromkeys([*[t.name for t in terms], *[t.other.name for t in terms if t.other], y, *weights]))
    width = 1 + sum(t.width for t in terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [[np.zeros((width, width)), np.zeros(width), 0.0, 0.0] for _ in weights]
        for f in frames:
            f = f.dropna()
            x = np.column_stack([np.ones(len(f)), *[t.basis(f) for t in terms]])
            target = f[y].to_numpy(float)
            for own, name in zip(sums, weights, strict=True):
                w = f[name].to_numpy(float)
                xw = x * w[:, None]
                own[0] += xw.T @ x
                own[1] += xw.T @ target
                own[2] += float((w * target * target).sum())
                own[3] += float(w.sum())
        for i, own in enumerate(sums):
            yield pd.DataFrame({"which": [i], "g": [own[0].tobytes()], "b": [own[1].tobytes()], "yy": [own[2]], "n": [own[3]]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        g, b = (sum(np.frombuffer(x) for x in f[c]).tobytes() for c in ("g", "b"))
        return pd.DataFrame({"which": [f["which"].iloc[0]], "g": [g], "b": [b], "yy": [f["yy"].sum()], "n": [f["n"].sum()]})

    shape = "which int, g binary, b binary, yy double, n double"
    rows = {r["which"]: r for r in df.select(*names).mapInPandas(run, shape).groupBy("which").applyInPandas(add, shape).collect()}
    return [Gram(terms, np.frombuffer(rows[i]["g"]).reshape(width, width), np.frombuffer(rows[i]["b"]), rows[i]["yy"], rows[i]["n"]) for i in range(len(weights))]


def bagged(df: DataFrame, terms: list[Term], y: str, row: str, bags: int, lam: float, block: int = 21, seed: int = 0) -> list[Fit]:
    """Fits on block-bootstrap weights: each block of rows counts as often as a seeded Poisson draw says; one pass serves all bags."""
    weights = {}
    for bag in range(bags):
        u = (F.pmod(F.xxhash64(F.floor(F.col(row) / block), F.lit(seed), F.lit(bag)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        weight, p, total = F.lit(0.0), math.exp(-1.0), 0.0
        for k in range(6):
            total += p
            weight = weight + (u > total).cast("double")
            p /= k + 1
        weights[f"_w{bag}"] = weight
    return [solve(m, lam) for m in gram_many(df.withColumns(weights), terms, y, list(weights))]


def bagged_predict(df: DataFrame, fits: list[Fit], out: str = "mu") -> DataFrame:
    """df with the bags' mean forecast and the 95 % band: the mean of the bags' bounds, widened by 1.96 deviations between the bags.

    All bags score a batch in one pass, over one basis where their terms are the same; rows with missing features get null.
    """
    shared = df.sparkSession.sparkContext.broadcast([(f.terms, f.beta, f.cov, f.scale) for f in fits])
    needed = list(dict.fromkeys([n for f in fits for t in f.terms for n in (t.name, *([t.other.name] if t.other else []))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            f = pa.Table.from_batches([batch]).select(needed).to_pandas().astype(float)
            gone = f.isna().any(axis=1).to_numpy()
            f = f.fillna(0.0)
            known: dict[tuple, np.ndarray] = {}
            means, widths = [], []
            for terms, beta, cov, scale in models:
                x = known.get(tuple(terms))
                if x is None:
                    x = known[tuple(terms)] = design_row(terms, f)
                means.append(x @ beta)
                widths.append(1.96 * np.sqrt(np.maximum(((x @ cov) * x).sum(1) + scale, 0.0)))
            centre, half = np.mean(means, 0), np.mean(widths, 0)
            half = half + (1.96 * np.std(means, 0, ddof=1) if len(means) > 1 else 0.0)
            columns = [pa.array(v, mask=gone) for v in (centre, centre - half, centre + half)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, out, f"{out}_low", f"{out}_high"])

    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + "".join(f", `{out}{end}` double" for end in ("", "_low", "_high"))
    return df.mapInArrow(run, shape)


def bagged_interval(lower: list[float], upper: list[float], means: list[float]) -> tuple[float, float]:
    """Mean bounds widened by 1.96 deviations between the bags."""
    spread = 1.96 * float(np.std(means, ddof=1)) if len(means) > 1 else 0.0
    return float(np.mean(lower)) - spread, float(np.mean(upper)) + spread


def expectile(df: DataFrame, terms: list[Term], y: str, level: float, lam: float, rounds: int = 6) -> Fit:
    """Asymmetric least squares by reweighting: rows above the fit weigh `level`, others 1 - level. One pass a round scores, weighs and sums."""
    found = solve(gram(df, terms, y), lam)
    for _ in range(rounds):
        new = solve(gram(df, terms, y, around=(found.beta, level)), lam)
        done = np.allclose(new.beta, found.beta, atol=1e-8)
        found = new
        if done:
            break
    return found


def sigma_of(df: DataFrame, found: Fit, out: str = "sigma") -> DataFrame:
    """df with the deviation that a model of the log absolute residual means, 1e-6 at least."""
    return predict(df, found, out).withColumn(out, F.greatest(F.exp(F.col(out)), F.lit(1e-6)))


def sigma_target(y: str, mu: str) -> Column:
    """What a model of the deviation is fitted to."""
    return F.ln(F.abs(F.col(y) - F.col(mu)) + 1e-6)


def precision_weights(df: DataFrame, sigma: str, out: str) -> DataFrame:
    """Weights 1 / sigma squared, of mean 1."""
    w = df.withColumn(out, 1 / F.greatest(F.col(sigma) * F.col(sigma), F.lit(1e-8)))
    return w.crossJoin(F.broadcast(w.agg(F.avg(out).alias("_m")))).withColumn(out, F.col(out) / F.col("_m")).drop("_m")  # one row


def partial_dependence(found: Fit, name: str, points: int = 100) -> list[tuple[float, float, float, float]]:
    """(x, effect, low, high) of a term on an even grid over its range, with 95 % bands."""
    at = 1
    for t in found.terms:
        if t.name == name and t.other is None:
            x = np.linspace(t.low, t.high, points)
            b = t.basis(pd.DataFrame({name: x}))
            effect = b @ found.beta[at : at + t.width]
            sd = np.sqrt(np.maximum(((b @ found.cov[at : at + t.width, at : at + t.width]) * b).sum(1), 0.0))
            return [(float(p), float(e), float(e - 1.96 * s), float(e + 1.96 * s)) for p, e, s in zip(x, effect, sd, strict=True)]
        at += t.width
    raise KeyError(name)
