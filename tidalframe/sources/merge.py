"""Acquired tables side by side: daily ones by date, published ones as of each date from the day they were known."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import SERIES_LAGS, SOURCE_LAGS, forward_filled, merge_series, shift_publication


def long_series(wide: DataFrame, date: str, prefix: str = "") -> DataFrame:
    """(series, avail_date, value) of every column of a table but its date, nulls left out."""
    names = [c for c in wide.columns if c != date]
    values = F.explode(F.array(*[F.struct(F.lit(f"{prefix}{c}").alias("series"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")
    return wide.select(F.col(date).alias("avail_date"), values).select("x.series", "avail_date", "x.value").where("value is not null")


def merged_table(tables: dict[str, DataFrame], base: str = "oil", daily: tuple[str, ...] = ("market",), required: tuple[str, ...] = (), lags: dict[str, int] | None = None, series_lags: dict[str, int] | None = None, block: str | None = None) -> DataFrame:
    """The base table's days with the columns of all others.

    Tables named in daily join by date and are filled forward; an eia_{name} table (ref_date or date, value) gives the column name; any other
    (date, columns) gives its columns.  These count from their publication on: lags days after their date by source (the part before _ for
    eia_), series_lags by column for the table fred; {} moves nothing.  Rows before all required columns are known go.
    """
    lags, series_lags = SOURCE_LAGS if lags is None else lags, SERIES_LAGS if series_lags is None else series_lags
    out, parts = tables[base], []
    filled: list[str] = []
    for name, table in tables.items():
        if name == base:
            continue
        if name in daily:
            filled += [c for c in table.columns if c != "date"]
            out = out.join(table, "date", "left")
            continue
        date = "ref_date" if "ref_date" in table.columns else "date"
        if name.startswith("eia_"):
            table = table.select(date, F.col("value").alias(name[4:]))
        part = long_series(shift_publication(table, date, lags.get("eia" if name.startswith("eia_") else name)), date)
        if name == "fred":
            days = F.coalesce(*[F.when(F.col("series") == s, F.lit(d)) for s, d in series_lags.items()], F.lit(0)) if series_lags else F.lit(0)
            part = part.withColumn("avail_date", F.date_add("avail_date", days))
        parts.append(part)
    keyed = out.withColumn("_k", F.lit(0))
    out = forward_filled(keyed, ["_k"], "date", filled, [], block).drop("_k") if filled else out
    if parts:
        series = functools.reduce(DataFrame.unionByName, parts)
        names = [r["series"] for r in series.select("series").distinct().orderBy("series").collect()]  # columns, not rows
        out = merge_series(out, series, names, "date", block)
    return out.na.drop(subset=list(required)) if required else out
