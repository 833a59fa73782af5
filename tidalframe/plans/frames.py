"""The frames that queries start from, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Over
from ..sources.tables import close_panel, daily_bars, period_series
from .catalog import table

#: Priorities of orders in the roles of instruments.
ROLES = {"1-URGENT": "crude", "2-HIGH": "brent", "3-MEDIUM": "gasoline", "4-NOT SPECIFIED": "heating", "5-LOW": "m2"}


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices by priority, and of all orders under ALL."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    return daily_bars(orders, "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", "ALL")


BARS = """bars AS (
  SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2
  UNION ALL
  SELECT 'ALL', CAST(o_orderdate AS DATE), arg_min(o_totalprice, o_orderkey), max(o_totalprice), min(o_totalprice), arg_max(o_totalprice, o_orderkey), count(*)
  FROM orders GROUP BY 2)"""

#: Expressions over a partition by key in date order.
W = "PARTITION BY key ORDER BY date"


def rows(size: int, spec: str = W) -> str:
    return f"({spec} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, x: str, size: int, least: int | None = None, spec: str = W) -> str:
    """SQL of a rolling aggregate that is null until it has `least` values."""
    return f"CASE WHEN count({x}) OVER {rows(size, spec)} >= {least or size} THEN {fn}({x}) OVER {rows(size, spec)} END"


def ema(x: str, span: int, n: str, spec: str = W) -> str:
    """SQL of an exponential mean of a column without nulls whose row numbers (from 1) are n: its closed form."""
    keep = 1 - 2 / (span + 1)
    terms = f"sum({x} * CASE WHEN {n} = 1 THEN 1.0::DOUBLE ELSE {1 - keep!r}::DOUBLE END * pow({keep!r}::DOUBLE, 1 - {n})) OVER ({spec} ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN {n} >= {span} THEN {terms} * pow({keep!r}::DOUBLE, {n} - 1) END"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One close column per role, dates of all; key names the single series."""
    return close_panel(bars(spark, sf_dir).where("key <> 'ALL'"), ROLES).withColumn("key", F.lit("panel"))


PANEL = "panel AS (SELECT 'panel' AS key, date, " + ", ".join(f"max(CASE WHEN key = '{k}' THEN close END) AS {v}" for k, v in ROLES.items()) + " FROM bars WHERE key <> 'ALL' GROUP BY date)"


def weekly_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped by ISO week, published 5 days after the week's Sunday."""
    return period_series(table(spark, sf_dir, "lineitem"), "l_shipdate", "week", F.sum("l_quantity"), 5)


WEEKLY = """weekly AS (SELECT 'ALL' AS key, CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS ref_date, CAST(date_trunc('week', l_shipdate) AS DATE) + 11 AS avail_date,
  sum(l_quantity) AS value FROM lineitem GROUP BY 2, 3)"""


def monthly_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount by month, published 38 days after the month's first."""
    return period_series(table(spark, sf_dir, "lineitem"), "l_shipdate", "month", F.avg("l_discount"), 38)


MONTHLY = """monthly AS (SELECT 'ALL' AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS ref_date, CAST(date_trunc('month', l_shipdate) AS DATE) + 38 AS avail_date,
  avg(l_discount) AS value FROM lineitem GROUP BY 2, 3)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next close y against today's (anchor), forecasts by 5- and 20-row means, and a rolling deviation."""
    b = bars(spark, sf_dir)
    w = Over(["key"], "date")
    out = b.select("key", "date", w.lead("close").alias("y"), F.col("close").alias("anchor"), w.mean("close", 5).alias("fast"), w.mean("close", 20).alias("slow"), w.std("close", 20).alias("sigma"))
    return out.where("y is not null and slow is not null")


FORECASTS = f"""{BARS}, fc0 AS (SELECT key, date, lead(close) OVER ({W}) AS y, close AS anchor, {full("avg", "close", 5)} AS fast,
  {full("avg", "close", 20)} AS slow, {full("stddev_samp", "close", 20)} AS sigma FROM bars),
fc AS (SELECT * FROM fc0 WHERE y IS NOT NULL AND slow IS NOT NULL)"""
