"""Publication lags, calendars and as-of merges."""

from __future__ import annotations

import functools
import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days between reference and publication by source.
SOURCE_LAGS = {"eia": 5, "cot": 3, "alpha_vantage": 30, "gpr": 1, "gecon": 30}
#: The same by macro series.
SERIES_LAGS = {
    "unemployment": 38, "cpi": 45, "indpro": 48, "oil_prod_ip": 48, "cap_util": 48, "pmi_mfg": 32, "miles_driven": 75, "epu_global": 38, "igrea": 45, "nfci": 7, "stlfsi": 7, "fed_balance": 7,
    "retail_gas": 7, "usd_index": 0, "fed_funds": 0, "t10y2y": 0, "t5yie": 0, "t10yie": 0, "ovx": 0, "hy_spread": 0, "epu_us": 30, "ig_spread": 0, "ted_spread": 0, "rrp": 0,
}

log = logging.getLogger(__name__)


def shift_publication(df: DataFrame, date: str, days: int | None) -> DataFrame:
    """Dates moved to when the values were published; no lag, or one below 1, changes nothing."""
    return df if not days or days <= 0 else df.withColumn(date, F.date_add(date, days))


def published(series: DataFrame, lags: DataFrame) -> DataFrame:
    """(series, ref_date, avail_date, value) from a long table and (series, lag_days); unknown series have no lag."""
    known = lags.select(F.col("series").alias("_s"), "lag_days")
    out = series.join(known, F.col("series") == F.col("_s"), "left")
    return out.select("series", "ref_date", F.date_add("ref_date", F.coalesce("lag_days", F.lit(0)).cast("int")).alias("avail_date"), "value")


def published_series(series: DataFrame, overrides: dict[str, int] | None = None) -> DataFrame:
    """published() by SERIES_LAGS, or by the overrides alone if any are given ({}: nothing is moved); series without a lag are logged."""
    lags = SERIES_LAGS if overrides is None else overrides
    table = series.sparkSession.createDataFrame(sorted(lags.items()), "series string, lag_days int")
    if overrides is None:
        for r in unknown_series(series, table).orderBy("series").limit(100).collect():  # names for the log
            log.warning("%s has no publication lag: taken as known on its date", r["series"])
    return published(series, F.broadcast(table))  # as many rows as there are entries


def unknown_series(series: DataFrame, lags: DataFrame) -> DataFrame:
    """Series that have no entry among the lags."""
    return series.select("series").distinct().join(lags, "series", "left_anti")


def daily_calendar(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """One row per calendar day from a key's first to its last date, with the last value so far."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return days.join(df.select(*keys, date, value), [*keys, date], "left").withColumn(value, F.last(value, True).over(w))


def _blocks_before(rows: DataFrame, keys: list[str], columns: dict[str, Column], order: Column) -> DataFrame:
    """(keys, _block, _before_{name}): each column's last value, by order, in the blocks before; one row a block."""
    ends = rows.groupBy(*keys, "_block").agg(*[F.max_by(c, F.when(c.isNotNull(), order)).alias(f"_end_{n}") for n, c in columns.items()])
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "_block", *[F.last(f"_end_{n}", True).over(w).alias(f"_before_{n}") for n in columns])


def _with_blocks_before(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "_block"])}
    renamed = before.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in before.columns if c not in names])
    return rows.join(renamed, functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])).drop(*names.values())


def asof(probes: DataFrame, facts: DataFrame, keys: list[str], probe_ts: str, fact_ts: str, columns: list[str], block: str | None = None) -> DataFrame:
    """probes, each with the facts' columns of the latest row not after it.

    Both sides meet in one sort by key and time instead of an inequality join: one shuffle, no
    product.  A column's null is passed over for its last value.  Facts at the same time as a probe
    count; of facts at one time the last by the columns' order counts.  A block (unit of date_trunc) cuts keys too long for
    one task: blocks are sorted apart, and each takes what the blocks before it ended with.
    """
    names = [c for c in probes.columns if c not in (*keys, probe_ts)]
    left = probes.select(*keys, F.col(probe_ts).alias("_ts"), F.lit(1).alias("_probe"), F.struct(*names).alias("_row") if names else F.lit(None).cast("int").alias("_row"), *[F.lit(None).cast(facts.schema[c].dataType).alias(f"_f_{c}") for c in columns])
    right = facts.select(*keys, F.col(fact_ts).alias("_ts"), F.lit(0).alias("_probe"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *[F.col(c).alias(f"_f_{c}") for c in columns])
    both = left.unionByName(right)
    if block is not None:
        both = both.withColumn("_block", F.date_trunc(block, "_ts"))
    within = keys if block is None else [*keys, "_block"]
    w = Window.partitionBy(*within).orderBy("_ts", "_probe", *[f"_f_{c}" for c in columns]).rowsBetween(Window.unboundedPreceding, 0)
    out = both.select(*within, "_ts", "_probe", "_row", *[F.last(f"_f_{c}", True).over(w).alias(f"_v_{c}") for c in columns]).where("_probe = 1")
    value = {c: F.col(f"_v_{c}") for c in columns}
    if block is not None:
        before = _blocks_before(both, keys, {c: F.col(f"_f_{c}") for c in columns}, F.struct("_ts", *[f"_f_{c}" for c in columns]))
        out = _with_blocks_before(out, before, keys)
        value = {c: F.coalesce(f"_v_{c}", f"_before_{c}") for c in columns}
    return out.select(*keys, F.col("_ts").alias(probe_ts), *([F.col(f"_row.{c}").alias(c) for c in names]), *[v.alias(c) for c, v in value.items()])


def merge_series(base: DataFrame, series: DataFrame, names: list[str], date: str = "date", block: str | None = None) -> DataFrame:
    """base (date, ...) with one column per series of (series, avail_date, value), each as of the date.

    The distinct dates, not the rows, meet the series, all in one union and one window; rows then join by
    date.  Without a block all dates are one task's, which fits days; moments within days ask for one, such as month.
    """
    wide = series.where(F.col("series").isin(names)).groupBy(F.lit(0).alias("_k"), "avail_date").pivot("series", names).agg(F.max("value"))
    days = base.select(F.lit(0).alias("_k"), date).distinct()
    return base.join(asof(days, wide, ["_k"], date, "avail_date", names, block).drop("_k"), date, "left")


def forward_filled(df: DataFrame, keys: list[str], order: str, columns: list[str], required: list[str], block: str | None = None) -> DataFrame:
    """Columns filled forward, then rows without one of the required dropped; a block (unit of date_trunc) cuts keys too long for one task."""
    rows = df if block is None else df.withColumn("_block", F.date_trunc(block, order))
    w = Window.partitionBy(*(keys if block is None else [*keys, "_block"])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select(*[F.last(c, True).over(w).alias(c) if c in columns else F.col(c) for c in rows.columns])
    if block is not None:
        filled = _with_blocks_before(filled, _blocks_before(rows, keys, {c: F.col(c) for c in columns}, F.col(order)), keys)
        filled = filled.select(*[F.coalesce(c, f"_before_{c}").alias(c) if c in columns else c for c in df.columns])
    return filled.na.drop(subset=required) if required else filled


def date_range(df: DataFrame, date: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from the first to the last date, both included; an open end is None."""
    for bound, keep in ((first, lambda b: F.col(date) >= b), (last, lambda b: F.col(date) <= b)):
        df = df if bound is None else df.where(keep(F.lit(bound).cast("date")))
    return df


def last_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Each key's n last rows by an order without ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def nearest_date(df: DataFrame, date: str, wanted: str) -> DataFrame:
    """The row of the first date from `wanted` on, or of the last date."""
    key = F.struct((F.col(date) < F.lit(wanted).cast("date")).alias("past"), F.when(F.col(date) >= F.lit(wanted).cast("date"), F.datediff(date, F.lit(wanted).cast("date"))).otherwise(F.datediff(F.lit(wanted).cast("date"), date)).alias("far"))
    return df.select(F.struct(*df.columns).alias("r"), key.alias("k")).agg(F.min_by("r", "k").alias("r")).select("r.*")
