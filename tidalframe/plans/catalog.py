"""The registered queries, and the SQL that each is held against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(keys: list[str], doubles: dict[str, int] | None = None, longs: list[str] | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query that returns keys as they are, doubles rounded to so many places and longs.

    The SQL is wrapped the same way, so both sides have one schema; rounding never gives -0.0.
    """
    doubles, longs = doubles or {}, longs or []

    def wrap(make: Query) -> Query:
        @functools.wraps(make)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(spark, sf_dir)
            return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in longs], *[(F.round(F.col(c).cast("double"), d) + F.lit(0.0)).alias(c) for c, d in doubles.items()])

        QUERIES[make.__name__] = run
        if sql is not None:
            shown = [*[f'"{k}"' for k in keys], *[f'CAST("{c}" AS BIGINT) AS "{c}"' for c in longs], *[f'round(CAST("{c}" AS DOUBLE), {d}) + 0 AS "{c}"' for c, d in doubles.items()]]
            ORACLES[make.__name__] = f"SELECT {', '.join(shown)} FROM ({sql.strip()}) AS answer"
        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
