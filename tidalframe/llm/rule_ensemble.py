"""Quality classifier: a sparse ensemble of rules over text statistics, as one Spark expression.

Small trees are boosted on a bounded sample of labelled rows; every path to a node becomes a
conjunctive rule; a lasso logistic regression keeps few of them; and those are compiled into a column
expression that scores all documents without leaving the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import SHARES, share, with_statistics
from .toxicity import held_out, training_rows, usable_labels

#: Labelled rows that the rules are fitted on at most, half of each label at most.
SAMPLE_ROWS = 8000
#: Bytes of their texts at most.
SAMPLE_BYTES = 64 << 20
TREES, DEPTH, LEAST_LEAF, CUTS = 24, 3, 10, 24
#: Lasso penalty per row, and proximal steps.
PENALTY, STEPS = 0.004, 600
FEATURES = ("n_words", *SHARES)

Condition = tuple[int, bool, float]  # feature, whether above, cut
Rule = tuple[Condition, ...]


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The probability of label 1 as an expression over FEATURES."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for feature, above, cut in rule:
                value = F.col(FEATURES[feature])
                holds &= value > F.lit(cut) if above else value <= F.lit(cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: Rule, out: list[Rule], value: np.ndarray) -> None:
    """Split rows by the cut that lowers the weighted squared error most; add each node's path to out."""
    value[rows] = target[rows].sum() / (weight[rows].sum() + 1.0)
    if len(path) == DEPTH or len(rows) < 2 * LEAST_LEAF:
        return
    best: tuple[float, int, float] | None = None
    base = target[rows].sum() ** 2 / (weight[rows].sum() + 1.0)
    for f in range(x.shape[1]):
        v = x[rows, f]
        for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS))):
            left = v <= cut
            n = int(left.sum())
            if min(n, len(rows) - n) < LEAST_LEAF:
                continue
            gain = target[rows][left].sum() ** 2 / (weight[rows][left].sum() + 1.0) + target[rows][~left].sum() ** 2 / (weight[rows][~left].sum() + 1.0) - base
            if best is None or gain > best[0]:
                best = (gain, f, float(cut))
    if best is None or best[0] <= 1e-9:
        return
    _, f, cut = best
    for above in (False, True):
        node = (*path, (f, above, cut))
        out.append(tuple(sorted(node)))
        _grow(x, target, weight, rows[(x[rows, f] > cut) == above], node, out, value)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, cut in rule:
        ok &= (x[:, f] > cut) == above
    return ok


def fit(x: np.ndarray, y: np.ndarray, prior: float | None = None) -> Ensemble:
    """Rules and weights from features x and labels y; `prior` is the share of label 1 to calibrate to."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Ensemble([], [], float(np.log(p / (1 - p))))
    score, found = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        value = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), np.arange(len(y)), (), found, value)
        score += 0.3 * value
    rules = list(dict.fromkeys(found))
    design = np.stack([_holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(design, axis=1, return_index=True)  # rules that hold on the same rows count once
    rules = [rules[i] for i in sorted(first)]
    design = design[:, sorted(first)]
    step = 4.0 / (np.linalg.norm(design, 2) ** 2 / len(y) + 1.0)
    w, b = np.zeros(design.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-(design @ w + b))) - y
        w -= step * (design.T @ miss) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0.0)
        b -= step * miss.mean()
    if prior is not None and 0 < prior < 1:
        b += float(np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean())))
    kept = np.flatnonzero(w)
    return Ensemble([rules[i] for i in kept], [float(w[i]) for i in kept], b)


def features(df: DataFrame) -> DataFrame:
    """df with FEATURES in place of its text."""
    keep = [c for c in df.columns if c != "text"]
    return with_statistics(df).select(*keep, F.col("n_words").cast("double").alias("n_words"), *[share(*of).alias(n) for n, of in SHARES.items()])


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    rows = features(training_rows(docs, labels, "quality", sample_rows, SAMPLE_BYTES)).toPandas().sort_values([*FEATURES, "label"])
    usable = usable_labels(labels, "quality").agg(F.avg("label")).first()[0]
    return fit(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float), usable)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    labels (doc_id, quality) is used only for rows whose crc32(doc_id as text) mod 5 isn't 0, at most
    sample_rows of them; a doc_id with labels of both kinds counts as 1.  Null and empty texts are scored by their statistics, which are 0; without
    labels of both kinds all scores are equal.  A null doc_id is not held out.  Repeated rows score
    alike.  Other columns are ignored.
    """
    scored = features(docs.select("doc_id", held_out().alias("held_out"), "text"))
    return scored.select("doc_id", "held_out", trained(docs, labels, sample_rows).column().alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
