"""Sinks: tables as Parquet, reports as CSV, small results as JSON, models as coefficient tables."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gam import Fit


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON object, through Spark's writer, so that any store works."""
    spark.createDataFrame([(json.dumps(record, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=False).first()[0])


def write_model(spark: SparkSession, found: Fit, path: str) -> None:
    """Coefficients as a table and the fit's figures as JSON."""
    spark.createDataFrame([(i, float(b)) for i, b in enumerate(found.beta)], "position int, beta double").write.mode("overwrite").parquet(f"{path}/coefficients")
    spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(found.cov)], "position int, row array<double>").write.mode("overwrite").parquet(f"{path}/covariance")
    write_record(spark, {"terms": [asdict(t) for t in found.terms], "lam": found.lam, "edof": found.edof, "rss": found.rss, "n": found.n, "scale": found.scale, "gcv": found.gcv, "aic": found.aic, "bic": found.bic, "r2": found.r2, "p_values": found.p_values}, f"{path}/figures")


def read_model(spark: SparkSession, path: str) -> Fit:
    import numpy as np

    from ..operators.gam import Term

    term = lambda t: Term(**{**t, "other": term(t["other"]) if t["other"] else None})
    r = read_record(spark, f"{path}/figures")
    beta = np.array([x["beta"] for x in spark.read.parquet(f"{path}/coefficients").orderBy("position").collect()])
    cov = np.array([x["row"] for x in spark.read.parquet(f"{path}/covariance").orderBy("position").collect()])
    return Fit([term(t) for t in r["terms"]], beta, cov, r["lam"], r["edof"], r["rss"], r["n"], r["scale"], r["gcv"], r["aic"], r["bic"], r["r2"], r["p_values"])


def top_features(found: Fit, spark: SparkSession, most: int = 15) -> DataFrame:
    """(feature, p, edof_share) of the most significant terms."""
    rows = [(t.name, float(p), float(t.width)) for t, p in zip(found.terms, found.p_values, strict=True)]
    return spark.createDataFrame(rows, "feature string, p double, width double").orderBy(F.col("p"), F.col("width").desc(), "feature").limit(most)
