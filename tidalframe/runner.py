"""From a feature table to models, backtest, weights and the next forecast, and the files that hold them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import backtest, eda, gam
from .operators.distributional import Distributional, distributional
from .operators.scores import combined, conformal_quantile
from .operators.splits import forward_target
from .sources import sinks
from .sources.config import MODEL_DEFAULTS


@dataclass
class Trained:
    models: Distributional
    bags: list[gam.Fit]
    names: list[str]
    knots: dict[str, list[float]]
    folds: list[dict[str, float]]
    path: DataFrame | None
    scores: dict[str, float]
    weights: dict[str, float]
    q: float
    forecast: DataFrame
    settings: dict[str, Any] = field(default_factory=dict)


def train(features: DataFrame, names: list[str], price: str = "close", settings: dict[str, Any] | None = None, log_return: bool = True, with_backtest: bool = True) -> Trained:
    """Prune, transform, select, validate, fit, backtest and forecast one series (key, date, price, names).

    settings override MODEL_DEFAULTS; also: quantile_knots, monotone, interactions (off unless true), refits, initial_frac and refit_rows.
    Rows with a missing feature are left out.  The forecast is for the last row, with the conformal band of the backtest's
    residuals (1.96 deviations under 50 of them, or without a backtest) and the combination with the last price.
    """
    s = MODEL_DEFAULTS | {"quantile_knots": False, "monotone": False, "interactions": False, "refits": 0, "initial_frac": 0.6, "refit_rows": 63} | (settings or {})
    complete = features.select("key", "date", price, *names).na.drop()
    rows = forward_target(complete, ["key"], "date", price, 1, "log_return" if log_return else "level")
    names = eda.collinearity_prune(rows, names, "date", s["collinearity"])
    n = rows.count()
    knots = gam.rank_knots(rows.where(F.col("row_pos") < int(n * s["initial_frac"])), names) if s["quantile_knots"] else {}  # known before any backtest
    rows, complete = gam.ranked(rows, knots), gam.ranked(complete, knots)
    terms = gam.terms_for(rows, names, rolling=s["n_splines"], monotone=s["monotone"], pairs=s["interactions"])
    mu, _ = gam.stepwise(gam.gram(rows, terms, "y"), s["lams"], s["criterion"], s["max_terms"])
    folds = backtest.cross_validate(rows, n, mu.terms, "y", s["cv_splits"], s["lams"])
    models = distributional(rows, ["key"], "date", terms, "y", mu, s["lams"], s["refits"], s["sigma_source"], s["nu_tau_window"])
    bags = gam.bagged(rows, models.mu.terms, "y", "row_pos", s["bags"], models.mu.lam, s["bag_block"]) if s["bags"] > 1 else []
    path, found, weights, q = None, {}, {}, 1.96
    if with_backtest:
        plan = backtest.WalkForward(s["initial_frac"], s["refit_rows"], s["refit_rows"], lams=tuple(s["lams"]), sigma_source=s["sigma_source"])
        path = backtest.walk_forward(rows, n, models.mu.terms, plan, log_return)
        found = backtest.path_scores(path, log_return)
        weights = backtest.weights_from_path(path)
        residuals = path.select(F.lit("path").alias("series"), (F.ln(F.col("y_true") / F.col("y_anchor")) if log_return else F.col("y_true")).alias("y"), "y_pred_model", "sigma_model")
        own = conformal_quantile(residuals, ["series"], "y", "y_pred_model", "sigma_model").first()
        q = own["q"] if own and found["n"] > 50 else 1.96
    last = complete.withColumn("anchor", F.col(price)).orderBy(F.col("date").desc()).limit(1)
    forecast = backtest.next_day_forecast(last, models.mu, q).join(last.select("date", "anchor"), "date").withColumn("pi_multiplier", F.lit(float(q)))
    if weights:
        forecast = forecast.withColumn("weight", F.lit(float(weights["w_model"]))).withColumn("combined", combined(float(weights["w_model"]), "price", "anchor"))
    return Trained(models, bags, names, knots, folds, path, found, weights, q, forecast, s)


def save(spark: SparkSession, found: Trained, out: str) -> None:
    """Models, their metadata, the path, scores, weights, the forecast and the report, each under its own name in `out`."""
    for name in ("mu", "sigma", "nu", "tau"):
        sinks.write_model(spark, getattr(found.models, name), f"{out}/models/{name}")
    for i, bag in enumerate(found.bags):
        sinks.write_model(spark, bag, f"{out}/models/bag_{i}")
    sinks.write_record(spark, {"selected": [t.name for t in found.models.mu.terms], "pruned_to": found.names, "knots": found.knots, "settings": found.settings, "folds": found.folds, "means": backtest.cross_validation_means(found.folds)}, f"{out}/models/metadata")
    if found.path is not None:
        sinks.write_table(found.path, f"{out}/backtest_path")
        sinks.write_record(spark, found.scores, f"{out}/scores.json")
        sinks.write_record(spark, found.weights, f"{out}/combination_weights.json")
    sinks.write_record(spark, {k: str(v) if hasattr(v, "year") else v for k, v in found.forecast.first().asDict().items()}, f"{out}/forecast.json")
    sinks.write_report(sinks.top_features(found.models.mu, spark), f"{out}/report")


def train_and_save(spark: SparkSession, features: DataFrame, names: list[str], out: str, price: str = "close", settings: dict[str, Any] | None = None, with_backtest: bool = True) -> Trained:
    found = train(features, names, price, settings, with_backtest=with_backtest)
    sinks.write_table(features, f"{out}/features")
    save(spark, found, out)
    return found
