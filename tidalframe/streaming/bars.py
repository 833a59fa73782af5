"""Streaming counterparts: windowed bars with late data bounded by a watermark, and keyed volatility state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_bars(events: DataFrame, key: str, ts: str, seq: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(key, start, open, high, low, close, n) per window, of a batch or a stream.

    On a stream, rows later than the watermark are dropped and windows close when it has passed.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    at = F.struct(F.col(ts), F.col(seq), F.col(value).alias("v"))
    out = rows.groupBy(F.col(key).alias("key"), w.alias("w")).agg(F.min(at).alias("a"), F.max(value).alias("high"), F.min(value).alias("low"), F.max(at).alias("b"), F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("a.v").alias("open"), "high", "low", F.col("b.v").alias("close"), "n")


def sessions(events: DataFrame, key: str, ts: str, value: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n, total) of sessions that a pause of `gap` ends."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.col(key).alias("key"), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def ewma_state(returns: DataFrame, key: str, ts: str, r: str, decay: float = 0.94) -> DataFrame:
    """(key, ts, sigma) for every return of a stream: the volatility forecast before it, from two numbers of state per key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v, seen = state.get if state.exists else (0.0, 0)
        for f in frames:
            out = []
            for x in f.sort_values(ts)[r]:
                out.append(v**0.5 if seen else None)
                v = x * x if not seen else decay * v + (1 - decay) * x * x
                seen += 1
            yield pd.DataFrame({"key": k[0], "ts": f.sort_values(ts)[ts].values, "sigma": out})
        state.update((v, seen))

    return returns.groupBy(key).applyInPandasWithState(step, "key string, ts timestamp, sigma double", "v double, seen long", "append", GroupStateTimeout.NoTimeout)
