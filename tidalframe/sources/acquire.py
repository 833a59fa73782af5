"""All sources of a run: each loads, or its last good version stands in; required ones without either stop the run."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .paged import paged_json, period_pages, position_pages
from .versions import publish, read_version

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Source:
    """A named source: load gives its rows anew; required says whether a run can do without."""

    name: str
    load: Callable[[], DataFrame]
    required: bool = True


@dataclass(frozen=True)
class Acquired:
    """tables by source, those left out without one; state is fresh, cached or missing, with the error of a failed load."""

    tables: dict[str, DataFrame]
    state: dict[str, tuple[str, str | None]]


def acquire(spark: SparkSession, source: Source, folder: str) -> tuple[DataFrame | None, str, str | None]:
    """(table, state, error) of one source: a fresh version if loading works, else the last one."""
    error = None
    try:
        publish(source.load(), f"{folder}/{source.name}")
    except Exception as reason:  # noqa: BLE001
        error = str(reason).split("\n", 1)[0]
    kept = read_version(spark, f"{folder}/{source.name}")
    if error is None:
        return kept, "fresh", None
    if kept is not None:
        log.warning("%s: %s; its last version stands in", source.name, error)
        return kept, "cached", error
    if source.required:
        raise RuntimeError(f"{source.name} could not be loaded and was never before: {error}")
    log.warning("%s was left out: %s", source.name, error)
    return None, "missing", error


def acquire_all(spark: SparkSession, sources: list[Source], folder: str, at_once: int = 4) -> Acquired:
    """Every source into its versions under folder, at_once loading side by side; the first required one without any version raises."""
    names = [s.name for s in sources]
    if len(set(names)) < len(names):
        raise ValueError("two sources share a name")
    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(lambda s: acquire(spark, s, folder), sources))
    tables = {n: t for n, (t, _, _) in zip(names, found, strict=True) if t is not None}
    return Acquired(tables, {n: (state, error) for n, (_, state, error) in zip(names, found, strict=True)})


def energy_sources(spark: SparkSession, base_url: str, api_key: str, series: dict[str, str], **options: object) -> list[Source]:
    """One required source for each energy series (name: identifier), read by pages."""
    url = f"{base_url}/seriesid/{{series}}?api_key={api_key}&out=json&offset={{offset}}&length={{limit}}"
    load = lambda code: lambda: period_pages(paged_json(spark, url, [code], records="response.data", **options)).select("ref_date", "value")
    return [Source(f"eia_{name}", load(code)) for name, code in series.items()]


def position_source(spark: SparkSession, url: str, market: str, **options: object) -> Source:
    """The weekly report of positions of one market."""
    from urllib.parse import quote

    where = quote(f"market_and_exchange_names='{market}'")
    full = f"{url}?$where={where}&$limit={{limit}}&$offset={{offset}}&$order=report_date_as_yyyy_mm_dd%20ASC"
    return Source("cot", lambda: position_pages(paged_json(spark, full, ["cot"], **({"limit": 50000} | options))))


def indicator_source(spark: SparkSession, base_url: str, api_key: str, functions: dict[str, str], **options: object) -> Source:
    """Economic indicators (name: function) side by side by date; optional. All series are one query, a task each."""
    from .readers import aligned

    url = f"{base_url}?function={{series}}&apikey={api_key}"

    def load() -> DataFrame:
        rows = period_pages(paged_json(spark, url, list(functions.values()), records="data", limit=1 << 30, **options))
        return aligned({name: rows.where(rows.series == code).select("ref_date", "value") for name, code in functions.items()})

    return Source("alpha_vantage", load, required=False)
