"""Landed source files as normalised tables: fetching is someone else's task, reading and shaping are ours."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def ohlcv(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) from Parquet or, by its ending, CSV; no rows raise."""
    raw = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    out = raw.select("ticker", F.to_date("date").alias("date"), *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")], F.col("volume").try_cast("long").alias("volume"))
    if not out.head(1):
        raise ValueError(f"no prices in {path}")
    return out


def wide_ohlcv(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """One row per date with {ticker}_{field} columns."""
    fields = ("open", "high", "low", "close", "volume")
    return bars.groupBy("date").pivot("ticker", tickers).agg(*[F.first(f).alias(f) for f in fields])


def json_period_series(spark: SparkSession, path: str) -> DataFrame:
    """(ref_date, value) from responses of the form {"response": {"data": [{"period", "value"}]}}; unreadable values are null."""
    raw = spark.read.schema("response struct<data: array<struct<period: string, value: string>>>").json(path, multiLine=True)
    rows = raw.select(F.explode("response.data").alias("r"))
    padded = F.when(F.length("r.period") == 4, F.concat("r.period", F.lit("-01-01"))).when(F.length("r.period") == 7, F.concat("r.period", F.lit("-01"))).otherwise(F.col("r.period"))
    return rows.select(padded.try_cast("date").alias("ref_date"), F.col("r.value").try_cast("double").alias("value")).where("ref_date is not null")


def json_data_series(spark: SparkSession, path: str) -> DataFrame:
    """(ref_date, value) from responses of the form {"data": [{"date", "value"}]}."""
    raw = spark.read.schema("data array<struct<date: string, value: string>>").json(path, multiLine=True)
    rows = raw.select(F.explode("data").alias("r"))
    return rows.select(F.col("r.date").try_cast("date").alias("ref_date"), F.col("r.value").try_cast("double").alias("value")).where("ref_date is not null")


def aligned(series: dict[str, DataFrame]) -> DataFrame:
    """Series (ref_date, value) side by side by date: one union and one pivot, not a chain of outer joins."""
    if not series:
        raise ValueError("no series")
    long = None
    for name, df in series.items():
        part = df.select(F.col("ref_date").alias("date"), F.lit(name).alias("series"), "value")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("date").pivot("series", list(series)).agg(F.max("value"))


def each_or_skip(loaders: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The series that load; those that fail are logged and left out; none raises."""
    out = {}
    for name, load in loaders.items():
        try:
            out[name] = load()
        except Exception as error:  # noqa: BLE001
            log.warning("%s was skipped: %s", name, error)
    if loaders and not out:
        raise ValueError("no series could be loaded")
    return out


def positioning_report(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """A weekly report of positions as (date, renamed numeric columns) with net and share columns derived.

    names maps source columns to mm_long, mm_short, commercial_long, commercial_short and open_interest.
    """
    raw = spark.read.option("multiLine", True).json(path)
    out = raw.select(F.to_date(F.substring("report_date", 1, 10)).alias("date"), *[F.col(a).try_cast("double").alias(b) for a, b in names.items()])
    return out.select("*", (F.col("mm_long") - F.col("mm_short")).alias("mm_net"), F.try_divide("mm_long", "open_interest").alias("mm_long_pct"), (F.col("commercial_long") - F.col("commercial_short")).alias("commercial_net"))


def csv_index(spark: SparkSession, path: str, wanted: list[str], out: str, contains: bool = False) -> DataFrame:
    """(date, out) from a CSV: the first wanted column by lower-cased name (or part of it), else the first numeric one."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    lower = {c.lower(): c for c in raw.columns}
    date = next((lower[c] for c in lower if c in ("date", "month", "ds")), raw.columns[0])
    found = next((lower[c] for w in wanted for c in lower if (w in c if contains else w == c)), None)
    if found is None:
        found = next((c for c, t in raw.dtypes if c != date and t in ("double", "int", "bigint", "float")), None)
    if found is None:
        raise ValueError(f"no value column in {path}")
    return raw.select(F.to_date(F.col(date).cast("string")).alias("date"), F.col(found).cast("double").alias(out)).where("date is not null")


def with_cache(load: Callable[[], DataFrame], spark: SparkSession, cache: str, required: bool = True) -> DataFrame | None:
    """What load gives, published as the cache's new version; if it fails the last version; without one, required raises and optional gives None."""
    from .acquire import Source, acquire

    folder, name = cache.rstrip("/").rsplit("/", 1)
    return acquire(spark, Source(name, load, required), folder)[0]
