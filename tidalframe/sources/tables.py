"""Derived frames: daily bars, weekly and monthly series with publication dates, close panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame, key: str, ts: str, seq: str, price: str, overall: str | None = None) -> DataFrame:
    """(key, date, open, high, low, close, volume) per key and day; with `overall`, bars of all keys under that name too.

    Ticks are read and shuffled once; the overall bars are rolled up from the keys' bars.
    """
    tick = lambda f: f(F.struct(F.col(seq).alias("s"), F.col(price).alias("p")))
    parts = ticks.groupBy(F.col(key).alias("key"), F.to_date(ts).alias("date")).agg(
        tick(F.min).alias("first"), F.max(price).alias("high"), F.min(price).alias("low"), tick(F.max).alias("last"), F.count("*").alias("volume")
    )
    if overall is not None:
        both = parts.withColumn("key", F.explode(F.array(F.col("key"), F.lit(overall))))
        parts = both.groupBy("key", "date").agg(F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("volume").alias("volume"))
    return parts.select("key", "date", F.col("first.p").alias("open"), "high", "low", F.col("last.p").alias("close"), "volume")


def close_panel(bars: DataFrame, names: dict[str, str]) -> DataFrame:
    """(date, one close column per key): names maps keys to column names; given names make one shuffle of it."""
    wide = bars.groupBy("date").pivot("key", list(names)).agg(F.first("close"))
    return wide.select("date", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def density(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """(column_name, share, sparse): the share of rows with a value, and whether it is under `least`."""
    shares = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.count(c) / F.count(F.lit(1))).alias("share")) for c in columns])
    return df.agg(shares.alias("s")).select(F.explode("s").alias("s")).select("s.column_name", "s.share", (F.col("s.share") < least).alias("sparse"))


def period_series(df: DataFrame, ts: str, unit: str, agg, lag_days: int, key: str | None = None) -> DataFrame:
    """(key, ref_date, avail_date, value): one value per week or month, published lag_days after its reference date.

    ref_date is a week's Sunday, or a month's first day.
    """
    start = F.to_date(F.date_trunc(unit, F.col(ts)))
    ref = F.date_add(start, 6) if unit == "week" else start
    out = df.groupBy((F.col(key) if key else F.lit("ALL")).alias("key"), ref.alias("ref_date")).agg(agg.alias("value"))
    return out.select("key", "ref_date", F.date_add("ref_date", lag_days).alias("avail_date"), "value")
