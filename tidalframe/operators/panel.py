"""Additive models for panels: one model a key, from packed sums of basis products, solved in batches of keys on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Over
from .features import add
from .gam import Fit, Gram, Term, design_row, fit

#: Keys whose sums a task holds before it sends them on; fits of keys up to this many numbers are broadcast to score rows.
HELD_KEYS, BROADCAST_NUMBERS = 512, 1 << 22

_FIGURES = ("n", "lam", "edof", "rss", "scale", "gcv", "aic", "bic", "r2")
_FITTED = ", ".join(f"{c} double" for c in _FIGURES) + ", beta array<double>, cov array<double>, p_values array<double>"


def _needed(terms: list[Term]) -> list[str]:
    return list(dict.fromkeys([*[t.name for t in terms], *[t.other.name for t in terms if t.other]]))


def _unpacked(total: np.ndarray, terms: list[Term]) -> Gram:
    width = 1 + sum(t.width for t in terms)
    upper = np.triu_indices(width)
    n = len(upper[0])
    g = np.zeros((width, width))
    g[upper] = total[:n]
    return Gram(terms, g + np.triu(g, 1).T, total[n:-2], float(total[-2]), float(total[-1]))


def panel_sums(df: DataFrame, keys: list[str], terms: list[Term], y: str) -> DataFrame:
    """(keys, blob): the packed sums of basis products of each key's complete rows, one row a key.

    One pass sums in tasks, whose packed sums meet by key; neither a key's rows nor the keys meet on one machine.
    """
    names = _needed(terms)
    kinds = dict(df.dtypes)
    listed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    upper = np.triu_indices(1 + sum(t.width for t in terms))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def sent() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=keys)
            return out.assign(blob=[v.tobytes() for v in held.values()])

        for f in frames:
            f = f.dropna(subset=[*names, y])
            if not len(f):
                continue
            x, target = design_row(terms, f[names].astype(float)), f[y].to_numpy(float)
            code, of = pd.factorize(pd.MultiIndex.from_frame(f[keys]) if len(keys) > 1 else f[keys[0]], use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.diff(code[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                own = order[a:b]
                key = of[code[own[0]]]
                key = tuple(key) if len(keys) > 1 else (key,)
                z, t = x[own], target[own]
                now = np.concatenate([(z.T @ z)[upper], z.T @ t, [t @ t, len(t)]])
                held[key] = held[key] + now if key in held else now
            if len(held) >= HELD_KEYS:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        one = lambda: pd.DataFrame([now], columns=keys).assign(blob=[total.tobytes()])
        for f in frames:
            for *key, blob in f[[*keys, "blob"]].itertuples(index=False, name=None):
                if now is None or not all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(key, now, strict=True)):
                    if now is not None:
                        yield one()
                    now, total = key, 0.0
                total = total + np.frombuffer(blob)
        if now is not None:
            yield one()

    sent = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names], F.col(y).cast("double").alias(y)).mapInPandas(sums, f"{listed}, blob binary")
    return sent.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInPandas(added, f"{listed}, blob binary")


def panel_fits(df: DataFrame, keys: list[str], terms: list[Term], y: str, lams: list[float] | None = None) -> DataFrame:
    """(keys, n, lam, edof, rss, scale, gcv, aic, bic, r2, beta, cov, p_values): the fit of every key with a complete row, solved in batches of keys.

    Terms, with their ranges, are those of all keys.
    """
    kinds = dict(df.dtypes)
    listed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [fit(_unpacked(np.frombuffer(b), terms), lams) for b in f["blob"]]
            figures = {c: [float(getattr(x, c)) for x in found] for c in _FIGURES}
            yield f[keys].assign(**figures, beta=[x.beta.tolist() for x in found], cov=[np.asarray(x.cov).ravel().tolist() for x in found], p_values=[[float(p) for p in x.p_values] for x in found])

    return panel_sums(df, keys, terms, y).mapInPandas(solved, f"{listed}, {_FITTED}")


def unit_root_tests(df: DataFrame, keys: list[str], order: str, c: str, max_lag: int | None = None) -> DataFrame:
    """(keys, n, lags, adf): the augmented Dickey-Fuller statistic of every key, however long, with lags chosen by AIC.

    All lag orders are solved from one matrix of products of the level and the lagged changes; the first rows of a key, as many as the longest lag, join it
    order by order, for orders differ in the rows they leave out.  adf is null where a series is too short or constant.
    """
    w = Over(keys, order)
    rows = df.where(F.col(c).isNotNull()).select(*keys, order, F.col(c).cast("double").alias("_x"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("_mean"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    cap = min(_lags_for(longest) if max_lag is None else max_lag, max(longest // 2 - 3, 0))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    named = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "_mean")
    base = rows.join(named, same).select(*keys, order, (F.col("_x") - F.col("_mean")).alias("_x"))
    base = add(base, {"_pos": F.row_number().over(w.spec) - 1, "_dx": w.change("_x"), "_level": w.lag("_x")})
    lagged = add(base, {f"_d{j}": w.lag("_dx", j) for j in range(1, cap + 1)})
    terms = [Term(name, "linear", 1, 0.0, 1.0) for name in ("_level", *[f"_d{j}" for j in range(1, cap + 1)])]
    whole = panel_sums(lagged.where(F.col("_pos") > cap), keys, terms, "_dx")
    heads = lagged.where(F.col("_pos").between(1, cap)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_dx", F.array(*[F.coalesce(t.name, F.lit(0.0)) for t in terms]).alias("x")))).alias("heads"))
    both = named
    for part in (whole, heads):
        renamed = part.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], *[x for x in part.columns if x not in keys])
        both = both.join(renamed, [F.col(f"_k{i}").eqNullSafe(F.col(f"_p{i}")) for i in range(len(keys))], "left").drop(*[f"_p{i}" for i in range(len(keys))])
    kinds = dict(df.dtypes)
    width = 2 + cap

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [_adf_of(n, blob, heads, width, terms, max_lag) for n, blob, heads in f[["n", "blob", "heads"]].itertuples(index=False, name=None)]
            yield f[[f"_k{i}" for i in range(len(keys))]].set_axis(keys, axis=1).assign(n=f["n"].to_numpy(), lags=pd.array([x[1] for x in out], "Int32"), adf=[x[0] for x in out])

    listed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return both.select(*[f"_k{i}" for i in range(len(keys))], "n", "blob", *(["heads"] if cap else [F.lit(None).cast("array<struct<_pos: int, _dx: double, x: array<double>>>").alias("heads")])).mapInPandas(solve, f"{listed}, n long, lags int, adf double")


def _lags_for(n: int) -> int:
    return int(np.ceil(12 * (n / 100) ** 0.25))


def _adf_of(n: int, blob: bytes | None, heads, width: int, terms: list[Term], max_lag: int | None) -> tuple[float | None, int | None]:
    most = min(_lags_for(n) if max_lag is None else max_lag, n // 2 - 3)
    if most < 0:
        return None, None
    m = _unpacked(np.frombuffer(blob), terms) if blob is not None else Gram(terms, np.zeros((width, width)), np.zeros(width), 0.0, 0.0)
    first = [(r["_pos"], r["_dx"], np.concatenate([[1.0], r["x"]])) for r in (heads if heads is not None else [])]

    def run(p: int, skip: int) -> tuple[float, float]:
        own = slice(0, p + 2)
        g, b, yy, rows = m.g[own, own].copy(), m.b[own].copy(), m.yy, m.n
        for pos, dx, x in first:
            if pos > skip:
                g += np.outer(x[own], x[own])
                b += x[own] * dx
                yy, rows = yy + dx * dx, rows + 1
        inverse = np.linalg.pinv(g)
        beta = inverse @ b
        sse = max(yy - 2 * beta @ b + beta @ g @ beta, 0.0)
        s2 = sse / max(rows - (p + 2), 1)
        spread = s2 * inverse[1, 1]
        return (float(beta[1] / np.sqrt(spread)) if spread > 0 else np.nan), rows * np.log(sse / max(rows, 1) + 1e-300) + 2 * (p + 2)

    best = min(range(most + 1), key=lambda p: (run(p, most)[1], p))
    t = run(best, best)[0]
    return (t if np.isfinite(t) else None), best


def panel_predict(df: DataFrame, fits: DataFrame, keys: list[str], terms: list[Term], out: str = "mu", sigma: str | None = None) -> DataFrame:
    """df with each row's mean by the fit of its key, and with sigma the predictive deviation; rows without a fit or with missing features get null."""
    names, width = _needed(terms), 1 + sum(t.width for t in terms)
    small = fits.select(*keys, F.col("beta").alias("_beta"), F.col("scale").alias("_scale"), *([F.col("cov").alias("_cov")] if sigma else []))
    per_key = width * (width if sigma else 1)
    most = max(1, BROADCAST_NUMBERS // per_key)
    if small.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    on = [df[k].eqNullSafe(small[k]) for k in keys]
    joined = df.join(small, on, "left").select(*[df[c] for c in df.columns], "_beta", "_scale", *(["_cov"] if sigma else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table.drop_columns(["_beta", "_scale", *(["_cov"] if sigma else [])])
            frame = table.select(names).to_pandas().astype(float)
            beta = table["_beta"].combine_chunks()
            has = beta.is_valid().to_numpy(zero_copy_only=False)
            there = has & ~frame.isna().any(axis=1).to_numpy()
            x = design_row(terms, frame.fillna(0.0))
            values = np.zeros((len(x), width))
            values[has] = beta.flatten().to_numpy().reshape(-1, width)
            columns = {out: pa.array((x * values).sum(1), mask=~there)}
            if sigma:
                var = np.zeros(len(x))
                cov = table["_cov"].combine_chunks().flatten().to_numpy().reshape(-1, width, width)
                var[has] = np.einsum("ni,nij,nj->n", x[has], cov, x[has]) + table["_scale"].combine_chunks().drop_null().to_numpy()
                columns[sigma] = pa.array(np.sqrt(np.maximum(var, 0.0)), mask=~there)
            for name, column in columns.items():
                kept = kept.append_column(name, column)
            yield from kept.combine_chunks().to_batches()

    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` double" + (f", `{sigma}` double" if sigma else "")
    return joined.mapInArrow(run, shape)


def fit_of(row, terms: list[Term]) -> Fit:
    """The Fit of one key's row."""
    width = len(row["beta"])
    return Fit(terms, np.array(row["beta"]), np.array(row["cov"]).reshape(width, width), *[row[c] for c in ("lam", "edof", "rss", "n", "scale", "gcv", "aic", "bic", "r2")], list(row["p_values"]))
