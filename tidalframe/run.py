"""A whole run in stages: acquire, features, describe, train, combinatorial backtest; each stage's tables are written and read by the next."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runner
from .operators import backtest, eda, gam
from .operators.build import Roles, Windows, build_features
from .operators.splits import forward_target, model_columns
from .sources import sinks
from .sources.acquire import Source, acquire_all
from .sources.merge import merged_table
from .sources.versions import read_version

log = logging.getLogger(__name__)
STAGES = ("acquire", "features", "describe", "train", "combinations")


@dataclass
class Plan:
    """What a run does: sources to load, roles of the merged columns, and settings of each stage."""

    roles: Roles
    sources: list[Source] = field(default_factory=list)
    windows: Windows = Windows()
    merge: dict[str, Any] = field(default_factory=dict)
    model: dict[str, Any] = field(default_factory=dict)
    groups: int = 6
    test_groups: int = 2
    embargo: float = 0.01
    describe_rows: int = 1500
    block: str | None = None


def load_tables(spark: SparkSession, raw: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The last version of each source that has one."""
    found = {n: read_version(spark, f"{raw}/{n}") for n in names}
    return {n: t for n, t in found.items() if t is not None}


def features_stage(spark: SparkSession, plan: Plan, tables: dict[str, DataFrame], out: str) -> DataFrame:
    """The feature table of all complete rows, under {out}/features."""
    merged = merged_table(tables, block=plan.block, **plan.merge).withColumn("key", F.lit("series"))
    sinks.write_table(build_features(merged, ["key"], "date", plan.roles, plan.windows), f"{out}/features")
    return spark.read.parquet(f"{out}/features")


def describe_stage(spark: SparkSession, plan: Plan, features: DataFrame, out: str) -> None:
    """Correlations, histograms, unit-root tests of every column and the price's autocorrelation and decomposition, as tables under {out}/eda."""
    names = [c for c, t in features.dtypes if t in ("double", "int", "bigint") and c not in ("key", "date")]
    sinks.write_table(eda.correlations(features, names), f"{out}/eda/correlations")
    long = features.select("key", "date", F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in names])).alias("v")).select("date", "v.series", "v.x")
    sinks.write_table(eda.histogram(long, ["series"], "x", 50), f"{out}/eda/histograms")
    sinks.write_table(eda.stationarity(long, ["series"], "date", "x", last=plan.describe_rows), f"{out}/eda/stationarity")
    price = plan.roles.price
    sinks.write_table(eda.autocorrelation(features, ["key"], "date", price, 40), f"{out}/eda/autocorrelation")
    sinks.write_table(eda.decompose(features.select("key", "date", price), ["key"], "date", price), f"{out}/eda/decomposition")


def combinations_stage(spark: SparkSession, plan: Plan, features: DataFrame, names: list[str], out: str) -> backtest.CpcvResult:
    """Combinatorial purged cross-validation of the additive model: path_metrics, path_returns and summary under {out}/cpcv."""
    price = plan.roles.price
    complete = features.select("key", "date", price, *names).na.drop()
    rows = forward_target(complete, ["key"], "date", price, 1, "log_return")
    terms = gam.terms_for(rows, names, rolling=plan.model.get("n_splines", gam.ROLLING_SIZE))
    found = backtest.cpcv_backtest(rows, rows.count(), backtest.gam_factory(terms, plan.model.get("lams")), names, plan.groups, plan.test_groups, plan.embargo)
    for name in ("path_metrics", "path_returns"):
        sinks.write_table(getattr(found, name), f"{out}/cpcv/{name}")
    sinks.write_record(spark, found.summary.first().asDict(), f"{out}/cpcv/summary.json")
    return found


def run(spark: SparkSession, plan: Plan, raw: str, out: str, skip: Iterable[str] = (), with_backtest: bool = True) -> dict[str, Any]:
    """All stages but those skipped, in order; what each made, by stage.

    acquire loads the plan's sources into versions under raw, of which the last good ones are read whether it is skipped or not; features skipped
    reads the feature table of an earlier run.  Figures are tables here; nothing is drawn.
    """
    skip = set(skip)
    if unknown := skip - set(STAGES):
        raise ValueError(f"unknown stages {sorted(unknown)}")
    done: dict[str, Any] = {}
    if "acquire" not in skip:
        log.info("acquire: %s", [s.name for s in plan.sources])
        done["acquire"] = acquire_all(spark, plan.sources, raw).state
    if "features" not in skip:
        done["features"] = features_stage(spark, plan, load_tables(spark, raw, [s.name for s in plan.sources]), out)
    features = spark.read.parquet(f"{out}/features")
    price = plan.roles.price
    names = [c for c in model_columns([c for c in features.columns if c not in ("key", "date")], price, "log_return") if c != price]
    if "describe" not in skip:
        describe_stage(spark, plan, features, out)
        done["describe"] = f"{out}/eda"
    selected = names
    if "train" not in skip:
        trained = runner.train(features, names, price, plan.model, with_backtest=with_backtest)
        runner.save(spark, trained, out)
        done["train"], selected = trained, [t.name for t in trained.models.mu.terms if t.other is None]
    if "combinations" not in skip:
        done["combinations"] = combinations_stage(spark, plan, features, selected, out)
    return done


def plan_of(config: dict[str, Any], spark: SparkSession) -> Plan:
    """A plan from a configuration's blocks roles, windows, merge, model, cpcv and files (Parquet tables by source name, loaded as they are)."""
    from .sources.config import model_config

    files = config.get("files", {})
    sources = [Source(name, (lambda path: lambda: spark.read.parquet(path))(path), name not in config.get("optional", [])) for name, path in files.items()]
    roles = {k: tuple(v) if isinstance(v, list) else v for k, v in config.get("roles", {"price": config.get("features", {}).get("target", "close")}).items()}
    windows = {k: tuple(v) if isinstance(v, list) else v for k, v in config.get("windows", {}).items()}
    cpcv = config.get("cpcv", {})
    return Plan(Roles(**roles), sources, Windows(**windows), config.get("merge", {}), model_config(config), cpcv.get("n_splits", 6), cpcv.get("n_test_splits", 2), cpcv.get("pct_embargo", 0.01))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", help="YAML file; its block files names Parquet tables by source")
    parser.add_argument("--raw", required=True, help="folder of the sources' versions")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--skip-download", action="store_true", help="use the versions that are there")
    parser.add_argument("--skip-eda", action="store_true")
    parser.add_argument("--skip-backtest", action="store_true", help="no walk-forward path: intervals of 1.96 deviations, no combination")
    parser.add_argument("--cpcv", action="store_true", help="also the combinatorial backtest; the configuration's cpcv.enabled does the same")
    own = parser.parse_args(arguments)
    from .sources.config import load_config

    spark = SparkSession.builder.getOrCreate()
    config = load_config(own.config)
    skip = {name for name, flag in (("acquire", own.skip_download), ("describe", own.skip_eda), ("combinations", not (own.cpcv or config.get("cpcv", {}).get("enabled", False)))) if flag}
    run(spark, plan_of(config, spark), own.raw, own.out, skip, not own.skip_backtest)


if __name__ == "__main__":
    main()
