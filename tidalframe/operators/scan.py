"""Ordered scans: recursions along a key's rows.

By default all scans of a stage are one pass of one Arrow worker per key.  A key too long for one task is cut
into time blocks: each block reduces to a few numbers (what its rows do to any state before them), these are
joined in order, and every block is replayed with the state before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    """A new double column `output`, made from the frame of one key in time order.

    run may also have summary(frame), states(summaries in order) and replay(frame, state), and can then be scanned in blocks.
    """

    output: str
    run: Callable[[pd.DataFrame], pd.Series]


@dataclass(frozen=True)
class Ewm:
    """Exponential mean with weight 2 / (span + 1) that starts at the first value; null until `span` values were there."""

    column: str
    span: int

    def _mean(self, x: np.ndarray, least: int = 0) -> np.ndarray:
        return pd.Series(x).ewm(span=self.span, adjust=False, min_periods=least).mean().to_numpy()

    def __call__(self, f: pd.DataFrame) -> pd.Series:
        return f[self.column].astype(float).ewm(span=self.span, adjust=False, min_periods=self.span).mean()

    def summary(self, f: pd.DataFrame) -> tuple:
        """Rows, values, nulls before the first value, that value, what the rest does to the mean after it (times, plus), nulls at the end."""
        x = f[self.column].to_numpy(float)
        there = np.flatnonzero(~np.isnan(x))
        if not len(there):
            return len(x), 0, len(x), 0.0, 1.0, 0.0, len(x)
        rest = x[there[0] + 1 :]
        plus = self._mean(np.concatenate([[0.0], rest]))[-1]
        times = self._mean(np.concatenate([[1.0], np.where(np.isnan(rest), np.nan, 0.0)]))[-1]
        return len(x), len(there), int(there[0]), float(x[there[0]]), float(times), float(plus), len(x) - 1 - int(there[-1])

    def states(self, summaries: list[tuple]) -> list[tuple]:
        """Before each block: the mean (None before any value), rows since the last value, values so far."""
        keep = 1 - 2 / (self.span + 1)
        now, out = (None, 0, 0), []
        for rows, seen, before, value, times, plus, after in summaries:
            out.append(now)
            mean, gap, count = now
            if not seen:
                now = (mean, gap + rows if mean is not None else 0, count)
                continue
            if mean is not None:
                old = keep ** (gap + before + 1)
                value = (old * mean + (1 - keep) * value) / (old + 1 - keep)
            now = (times * value + plus, after, count + seen)
        return out

    def replay(self, f: pd.DataFrame, state: tuple) -> pd.Series:
        mean, gap, count = state
        if mean is None:
            return self(f)
        x = f[self.column].to_numpy(float)
        gap = min(gap, int(750 * (self.span + 1)))  # beyond that the mean before weighs nothing
        out = self._mean(np.concatenate([[mean], np.full(gap, np.nan), x]))[gap + 1 :]
        return pd.Series(np.where(count + np.cumsum(~np.isnan(x)) >= self.span, out, np.nan), f.index)


def ewm(column: str, span: int) -> Ewm:
    return Ewm(column, span)


@dataclass(frozen=True)
class EwmaSigma:
    """Conditional volatility before each row: seeded with the variance of the first rows, then decayed squares."""

    column: str
    decay: float = 0.94
    seed_rows: int = 20

    def _path(self, start: float, r: np.ndarray) -> np.ndarray:
        """The variance before each row, and the next one."""
        return pd.Series(np.concatenate([[start], r * r])).ewm(alpha=1 - self.decay, adjust=False).mean().to_numpy()

    def _values(self, f: pd.DataFrame) -> np.ndarray:
        return np.nan_to_num(f[self.column].to_numpy(float), nan=0.0)

    def __call__(self, f: pd.DataFrame) -> pd.Series:
        return self.replay(f, self.states([self.summary(f)])[0])

    def summary(self, f: pd.DataFrame) -> tuple:
        """Rows, the first ones' values, mean, centred squares, and what the rows do to a variance (times, plus)."""
        r = self._values(f)
        return len(r), r[: self.seed_rows].tolist(), float(r.mean()), float(((r - r.mean()) ** 2).sum()), self.decay ** len(r), float(self._path(0.0, r)[-1])

    def states(self, summaries: list[tuple]) -> list[float]:
        head = np.array([x for s in summaries for x in s[1]][: self.seed_rows])
        rows, mean, squares = 0, 0.0, 0.0
        for n, _, m, q, _, _ in summaries:
            squares += q + (m - mean) ** 2 * rows * n / (rows + n)
            mean += (m - mean) * n / (rows + n)
            rows += n
        v, out = float(head.var()) or squares / rows or 1e-6, []
        for *_, times, plus in summaries:
            out.append(v)
            v = times * v + plus
        return out

    def replay(self, f: pd.DataFrame, state: float) -> pd.Series:
        return pd.Series(np.sqrt(np.maximum(self._path(state, self._values(f))[:-1], 1e-12)), f.index)


def ewma_sigma(column: str, decay: float = 0.94, seed_rows: int = 20) -> EwmaSigma:
    return EwmaSigma(column, decay, seed_rows)


def ordered_scan(df: DataFrame, keys: list[str], order: str, scans: list[Scan], block: str | Column | None = None) -> DataFrame:
    """df with the scans' columns.

    Without a block, later scans see the columns of earlier ones, in one shuffle by key and one Arrow round trip; a key's rows are one
    task's.  With a block (a unit of date_trunc on order, or a column that never falls along it) a key's rows are many tasks'
    and each scan sees the columns of df only.  The results are the same but for rounding.
    """
    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in {s.output for s in scans})
    shape += "".join(f", `{s.output}` double" for s in scans)
    in_order = lambda f: f.sort_values(order, kind="stable").reset_index(drop=True)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = in_order(f)
        for s in scans:
            f[s.output] = s.run(f)
        return f

    if block is None:
        return df.groupBy(*keys).applyInPandas(run, shape)
    if any(not hasattr(s.run, "replay") for s in scans):
        raise ValueError("a scan without summary, states and replay can't be cut into blocks")
    if {s.output for s in scans} & {s.run.column for s in scans}:
        raise ValueError("in blocks no scan sees another's column")
    rows = df.withColumn("_block", F.date_trunc(block, order) if isinstance(block, str) else block)
    kinds = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "_block"])

    def reduced(f: pd.DataFrame) -> pd.DataFrame:
        f = in_order(f)
        return f[[*keys, "_block"]].iloc[:1].assign(blob=[pickle.dumps([s.run.summary(f) for s in scans])])

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_block")
        columns = list(zip(*[pickle.loads(b) for b in f["blob"]], strict=True))  # noqa: S301
        states = zip(*[s.run.states(list(c)) for s, c in zip(scans, columns, strict=True)], strict=True)
        return f.assign(blob=[pickle.dumps(x) for x in states])

    def replayed(f: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        f = in_order(f.drop(columns="_block"))
        for s, x in zip(scans, pickle.loads(state["blob"].iloc[0]), strict=True):  # noqa: S301
            f[s.output] = s.run.replay(f, x)
        return f

    parts = rows.groupBy(*keys, "_block").applyInPandas(reduced, f"{named}, blob binary")
    states = parts.groupBy(*keys).applyInPandas(joined, f"{named}, blob binary")  # a row a block
    return rows.groupBy(*keys, "_block").cogroup(states.groupBy(*keys, "_block")).applyInPandas(replayed, shape)
