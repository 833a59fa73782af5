"""HTTP sources read page by page: a Spark data source whose partitions fetch pages, with back-off inside the reader."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers that are worth another attempt.
BUSY = (429, 500, 502, 503, 504)


class Pages(InputPartition):
    """The pages first, first + step, first + 2 step, ... of one series, until one is short."""

    def __init__(self, series: str, first: int, step: int) -> None:
        self.series, self.first, self.step = series, first, step


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"]
        self.series = json.loads(options.get("series", '[""]'))
        self.limit = int(options.get("limit", "5000"))
        self.step = int(options.get("tasks_per_series", "1"))
        self.path = [p for p in options.get("records", "").split(".") if p]
        self.attempts, self.wait, self.timeout = int(options.get("attempts", "3")), float(options.get("wait", "10")), float(options.get("timeout", "60"))

    def partitions(self) -> list[InputPartition]:
        return [Pages(s, k, self.step) for s in self.series for k in range(self.step)]

    def read(self, partition: Pages) -> Iterator[tuple[str, int, str]]:
        page = partition.first
        while True:
            where = {"series": urllib.parse.quote(partition.series, safe=""), "offset": page * self.limit, "limit": self.limit, "page": page}
            records = self._records(self._fetched(self.url.format(**where)), partition.series)
            for record in records:
                yield partition.series, page, json.dumps(record)
            if len(records) < self.limit:
                return
            page += partition.step

    def _records(self, body: str, series: str) -> list:
        found = json.loads(body)
        for key in self.path:
            if not isinstance(found, dict) or key not in found:
                raise ValueError(f"the answer for {series!r} has no {'.'.join(self.path)}")
            found = found[key]
        if not isinstance(found, list):
            raise ValueError(f"the answer for {series!r} is no list of records")
        return found

    def _fetched(self, url: str) -> str:
        for attempt in range(1, self.attempts + 1):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:  # noqa: S310
                    return answer.read().decode()
            except urllib.error.HTTPError as error:
                if error.code not in BUSY or attempt == self.attempts:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.attempts:
                    raise
            time.sleep(self.wait * attempt)
        raise RuntimeError("no attempt was made")


class PagedJson(DataSource):
    """(series, page, record): records of JSON answers as text.

    Options: url with {series} and {offset} or {page}, and {limit}; series, a JSON list of names; records, the dotted
    path of the list in an answer; limit, records of a full page; tasks_per_series, how many tasks share a series' pages;
    attempts, wait (seconds, times the number of the attempt), timeout.  A page with fewer records than limit is a task's last.
    Pages are fetched when Spark runs the query, by executors; a lost task fetches its pages again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "series string, page int, record string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def paged_json(spark: SparkSession, url: str, series: list[str], **options: object) -> DataFrame:
    """The records of PagedJson."""
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(url=url, series=json.dumps(series), **{k: str(v) for k, v in options.items()}).load()


def period_pages(pages: DataFrame) -> DataFrame:
    """(series, ref_date, value) from records with period (or date) and value; short periods are their first day, unreadable values null."""
    r = pages.select("series", F.from_json("record", "period string, date string, value string").alias("r"))
    period = F.coalesce("r.period", "r.date")
    padded = F.when(F.length(period) == 4, F.concat(period, F.lit("-01-01"))).when(F.length(period) == 7, F.concat(period, F.lit("-01"))).otherwise(F.substring(period, 1, 10))
    return r.select("series", padded.try_cast("date").alias("ref_date"), F.col("r.value").try_cast("double").alias("value")).where("ref_date is not null")


#: Columns of the weekly report of positions, by name in the source.
POSITIONS = {
    "open_interest_all": "cot_open_interest", "prod_merc_positions_long": "cot_commercial_long", "prod_merc_positions_short": "cot_commercial_short",
    "m_money_positions_long_all": "cot_mm_long", "m_money_positions_short_all": "cot_mm_short",
}


def position_pages(pages: DataFrame, date: str = "report_date_as_yyyy_mm_dd", columns: dict[str, str] = POSITIONS) -> DataFrame:
    """(date, the renamed columns, cot_mm_net, cot_mm_long_pct, cot_commercial_net) of a weekly report; columns that no record has are null."""
    fields = ", ".join(f"`{c}` string" for c in [date, *columns])
    r = pages.select(F.from_json("record", fields).alias("r"))
    out = r.select(F.substring(f"r.{date}", 1, 10).try_cast("date").alias("date"), *[F.col(f"r.{a}").try_cast("double").alias(b) for a, b in columns.items()]).where("date is not null")
    return out.select(
        "*", (F.col("cot_mm_long") - F.col("cot_mm_short")).alias("cot_mm_net"), F.try_divide("cot_mm_long", "cot_open_interest").alias("cot_mm_long_pct"),
        (F.col("cot_commercial_long") - F.col("cot_commercial_short")).alias("cot_commercial_net"),
    )
