"""Supervised targets and leakage-safe splits.

Folds are a table of at most some thousand rows (fold, test spans, purge bounds); the roles of rows
come from a join with it, so no index array is ever made.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Over
from .features import add


def forward_target(df: DataFrame, keys: list[str], date: str, price: str, horizon: int = 1, transform: str = "level") -> DataFrame:
    """df with y, y_level, anchor, t1 (when y is known) and row_pos (from 0); the last `horizon` rows go.

    transform: level (the later price) or log_return (its log ratio to today's, prices clipped at 1e-12).
    """
    if transform not in ("level", "log_return"):
        raise ValueError(f"unknown transform {transform!r}")
    w = Over(keys, date)
    level = w.lead(price, horizon) if horizon else F.col(price)
    y = level if transform == "level" else F.ln(F.greatest(level, F.lit(1e-12)) / F.greatest(F.col(price), F.lit(1e-12)))
    t1 = w.lead(date, horizon) if horizon else F.col(date)
    out = add(df, {"y": y, "y_level": level, "anchor": F.col(price), "t1": t1})
    out = out.where("t1 is not null")
    return out.withColumn("row_pos", (F.row_number().over(w.spec) - 1).cast("long"))


def reconstructed_price(anchor: str, forecast: str):
    """The price that a forecast log return means."""
    return F.col(anchor) * F.exp(F.col(forecast))


def model_columns(columns: list[str], target: str, transform: str = "level") -> list[str]:
    """Columns usable as features: not the target, other closes, raw bar fields, nor the target's lags under log returns."""
    ends = ("_open", "_high", "_low", "_volume")
    kept = [c for c in columns if c != target and not (c.endswith("_close") and c != target) and not c.endswith(ends)]
    return [c for c in kept if not (transform == "log_return" and c.startswith(f"{target}_lag_"))]


def fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """First and last row of k folds in order; the first n mod k have one row more."""
    size, more = divmod(n, k)
    starts = [f * size + min(f, more) for f in range(k + 1)]
    return [(starts[f], starts[f + 1] - 1) for f in range(k)]


def _roles(rows: DataFrame, spans: list[tuple[int, int, int]], embargo: int, per_span: bool = False) -> DataFrame:
    """(fold, row_pos, role) from test spans (fold, first, last) of rows (row_pos, date, t1).

    Test rows are in a span; a train row ends (t1) before the first test row's date or comes after the
    last test row and the embargo.  By default a fold's spans are purged as one from the first to the
    last; per_span purges around each.  Rows between are in neither.
    """
    spark = rows.sparkSession
    folds = spark.createDataFrame(spans, "fold int, first long, last long")  # folds times spans, made here
    dates = rows.select(F.col("row_pos").alias("first"), F.col("date").alias("d0"))
    folds = folds.join(dates, "first")
    table = folds.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("first", "last", "d0"))).alias("spans"))
    crossed = rows.select("row_pos", "t1").crossJoin(F.broadcast(table))  # every row has a role in every fold
    in_test = F.exists("spans", lambda s: F.col("row_pos").between(s["first"], s["last"]))
    whole = F.struct(F.element_at("spans", 1)["first"].alias("first"), F.element_at("spans", -1)["last"].alias("last"), F.element_at("spans", 1)["d0"].alias("d0"))
    clear = lambda s: (F.col("t1") < s["d0"]) | (F.col("row_pos") >= s["last"] + 1 + embargo)
    in_train = F.forall("spans", clear) if per_span else clear(whole)
    role = F.when(in_test, "test").when(in_train, "train")
    return crossed.select("fold", "row_pos", role.alias("role")).where("role is not null")


def purged_kfold(rows: DataFrame, n: int, k: int, pct_embargo: float) -> DataFrame:
    """(fold, row_pos, role) of k contiguous folds of n rows (row_pos, date, t1)."""
    if k < 2 or n < k:
        raise ValueError("needs at least two folds and a row in each")
    return _roles(rows, [(f, a, b) for f, (a, b) in enumerate(fold_bounds(n, k))], int(n * pct_embargo))


def cpcv_combos(groups: int, k: int) -> list[tuple[int, ...]]:
    if not 0 < k < groups:
        raise ValueError("needs 0 < k < groups")
    return list(itertools.combinations(range(groups), k))


def cpcv_splits(rows: DataFrame, n: int, groups: int, k: int, pct_embargo: float, per_span: bool = False) -> DataFrame:
    """(fold, row_pos, role) of every combination of k test groups; a combination left without training rows has no train role."""
    bounds = fold_bounds(n, groups)
    spans = [(i, *bounds[g]) for i, combo in enumerate(cpcv_combos(groups, k)) for g in combo]
    return _roles(rows, spans, int(n * pct_embargo), per_span)


def cpcv_paths(spark: SparkSession, groups: int, k: int) -> DataFrame:
    """(path, grp, fold): which combination gives each path its group; k * C(groups, k) / groups paths."""
    seen = [0] * groups
    rows = []
    for i, combo in enumerate(cpcv_combos(groups, k)):
        for g in combo:
            rows.append((seen[g], g, i))
            seen[g] += 1
    return spark.createDataFrame(rows, "path int, grp int, fold int")


def embargoed_split(rows: DataFrame, n: int, k: int, embargo: int, purged: bool = True) -> DataFrame:
    """With labels' ends a purged k-fold; else an expanding split whose tests start `embargo` rows after the training rows."""
    if purged:
        return purged_kfold(rows, n, k, embargo / n)
    size = n // (k + 1)
    spans = [(f, n - (k - f) * size, n - (k - f) * size + size - 1) for f in range(k)]
    rows_of = rows.sparkSession.createDataFrame([s for s in spans if s[1] + embargo <= s[2]], "fold int, first long, last long")
    role = F.when(F.col("row_pos") < F.col("first"), "train").when(F.col("row_pos").between(F.col("first") + embargo, F.col("last")), "test")
    return rows.select("row_pos").crossJoin(F.broadcast(rows_of)).select("fold", "row_pos", role.alias("role")).where("role is not null")


def walk_forward_plan(n: int, initial_frac: float = 0.6, refit: int = 21, test: int = 21, embargo: int = 0, max_models: int | None = None) -> list[tuple[int, int, int]]:
    """(model, training rows, end of its test rows) of each refit."""
    initial = max(int(n * initial_frac), max(252, embargo + 50))
    starts = list(range(initial, n, refit))[:max_models]
    return [(i, s, min(s + test, n)) for i, s in enumerate(starts)]


def bootstrap_blocks(n: int, seed: int, rep: int, mean_block: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the blocks of one stationary bootstrap sample of n rows: geometric lengths of that mean, n ** (1/3) if not given, n together.

    Blocks wrap at the end.  Draws depend on (seed, rep) alone, wherever they are made.
    """
    rng = np.random.default_rng([seed, rep])
    fresh = min(1.0, 1.0 / max(1.0, n ** (1 / 3) if mean_block is None else mean_block))
    length, total = [], 0
    while total < n:
        more = rng.geometric(fresh, max(16, int(1.1 * (n - total) * fresh) + 1))
        length.append(more)
        total += int(more.sum())
    length = np.concatenate(length)
    upto = np.cumsum(length)
    last = int(np.searchsorted(upto, n))
    length = length[: last + 1].copy()
    length[last] -= upto[last] - n
    return rng.integers(0, n, len(length)), np.minimum(length, n)


def stationary_bootstrap(n: int, mean_block: float, seed: int = 0, rep: int = 0) -> np.ndarray:
    """n row numbers of one sample, block by block."""
    start, length = bootstrap_blocks(n, seed, rep, mean_block)
    return (np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(n)) % n


def paths_count(groups: int, k: int) -> int:
    return k * math.comb(groups, k) // groups


