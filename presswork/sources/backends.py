"""Backends that answer one small question at a time, as Python data sources: a warehouse by windows of time, a feed by pages.

What a backend is, is a function of the caller's; it goes to the tasks with the source's class. A failing question is a
row with its error, not a failed job: what else was asked is kept, and ``complete_days`` and ``feed_items`` say what counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Hours of a window, and those of the least one that is still halved no more. Fixed values.
WINDOW_HOURS, LEAST_HOURS = 6, 1
#: Items of a page, and pages of a source at most. Fixed values.
PAGE, MOST_PAGES = 500, 100
WINDOWS = "stat_date date, start timestamp, stop timestamp, name string, n bigint, error string"
PAGES = "source string, page int, item string, total bigint, error string"

Ask = Callable[[datetime, datetime], Iterable[tuple[str, int]]]
Fetch = Callable[[str, int, int], dict]


class Window(InputPartition):
    def __init__(self, start: datetime, stop: datetime):
        self.start, self.stop = start, stop


def answered(ask: Ask, start: datetime, stop: datetime) -> list[tuple[datetime, datetime, list[tuple[str, int]]]]:
    """The answers of a window, or of its halves (whole hours) where it fails; the error of an hour that fails is raised."""
    try:
        return [(start, stop, [(name, int(n)) for name, n in ask(start, stop) if name and name.strip()])]
    except Exception:
        hours = int((stop - start).total_seconds() // 3600)
        if hours <= LEAST_HOURS:
            raise
        middle = start + timedelta(hours=max(1, hours // 2))
        return answered(ask, start, middle) + answered(ask, middle, stop)


def window_source(ask: Ask, name: str = "windows") -> type[DataSource]:
    """A source to register: ``spark.read.format(name).option("first", day).option("last", day)``; a task for each window.

    Rows: the counts of each name, one without a name for each window that was answered, one with the error for a window
    in which an hour failed.
    """

    class Reader(DataSourceReader):
        def __init__(self, first: date, last: date, hours: int):
            self.first, self.last, self.hours = first, last, hours

        def partitions(self) -> list[InputPartition]:
            out, at = [], datetime.combine(self.first, datetime.min.time())
            end = datetime.combine(self.last + timedelta(days=1), datetime.min.time())
            while at < end:
                midnight = datetime.combine(at.date() + timedelta(days=1), datetime.min.time())
                stop = min(at + timedelta(hours=self.hours), midnight)
                out.append(Window(at, stop))
                at = stop
            return out

        def read(self, partition: Window) -> Iterator[tuple]:
            day = partition.start.date()
            try:
                found = answered(ask, partition.start, partition.stop)
            except Exception as error:  # the day fails, the others don't
                yield day, partition.start, partition.stop, None, None, f"{type(error).__name__}: {error}"[:500]
                return
            for start, stop, counts in found:
                yield day, start, stop, None, len(counts), None
                for league, n in counts:
                    yield day, start, stop, league, n, None

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return WINDOWS

        def reader(self, schema) -> DataSourceReader:
            of = lambda key: date.fromisoformat(self.options[key])
            return Reader(of("first"), of("last"), int(self.options.get("hours", WINDOW_HOURS)))

    return Source


def windows(spark: SparkSession, ask: Ask, first: date, last: date, hours: int = WINDOW_HOURS) -> DataFrame:
    """The answers of all windows of the days from first to last."""
    spark.dataSource.register(window_source(ask))
    return spark.read.format("windows").options(first=first.isoformat(), last=last.isoformat(), hours=str(hours)).load()


def day_ledger(found: DataFrame) -> DataFrame:
    """stat_date, status, row_count, total_cnt, error: a day succeeds if none of its windows failed.

    A day that succeeded with nothing has a row, so that its partition can be emptied.
    """
    failed = F.count(F.when(F.col("error").isNotNull(), 1)) > 0
    total = F.coalesce(F.sum(F.when(F.col("name").isNotNull(), F.col("n"))), F.lit(0))
    names = F.count_distinct(F.when(F.col("name").isNotNull(), F.col("name")))
    return found.groupBy("stat_date").agg(
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"), F.when(failed, 0).otherwise(names).cast("long").alias("row_count"),
        F.when(failed, 0).otherwise(total).cast("long").alias("total_cnt"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("start"))).alias("error"),
    )


def complete_days(found: DataFrame) -> DataFrame:
    """stat_date, league_name, switch_cnt of the days that succeeded; nothing of a day of which an hour failed."""
    failed = found.filter("error is not null").select("stat_date").distinct()
    counts = found.filter("name is not null").groupBy("stat_date", F.col("name").alias("league_name")).agg(F.sum("n").alias("switch_cnt"))
    return counts.join(failed, "stat_date", "left_anti")


class Feed(InputPartition):
    def __init__(self, source: str):
        self.source = source


def feed_source(fetch: Fetch, name: str = "feed") -> type[DataSource]:
    """A source over pages ``fetch(source, offset, limit)``: {code, msg, data: {items, total, has_more}}; a task for each source.

    It asks on until a page is empty, or says that there is no more and the offset has reached the largest total. A code
    that isn't zero and items that are no list are errors of that source; what came before them stays.
    """
    import json

    class Reader(DataSourceReader):
        def __init__(self, sources: list[str], limit: int, most: int):
            self.sources, self.limit, self.most = sources, limit, most

        def partitions(self) -> list[InputPartition]:
            return [Feed(s) for s in self.sources]

        def read(self, partition: Feed) -> Iterator[tuple]:
            offset = total = 0
            for page in range(self.most):
                try:
                    answer = fetch(partition.source, offset, self.limit)
                    if answer.get("code") not in (None, 0):
                        raise ValueError(f"code {answer['code']}: {answer.get('msg') or ''}")
                    data = answer.get("data") or {}
                    items = data.get("items")
                    if not isinstance(items, list):
                        raise TypeError("items must be a list")
                except Exception as error:
                    yield partition.source, page, None, None, f"{type(error).__name__}: {error}"[:500]
                    return
                total = max(total, int(data.get("total") or 0))
                offset += len(items)
                for item in items:
                    yield partition.source, page, json.dumps(item, ensure_ascii=False), total, None
                if not items or (not data.get("has_more") and offset >= total):
                    return

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["sources"].split(","), int(self.options.get("limit", PAGE)), int(self.options.get("most", MOST_PAGES)))

    return Source


def feed(spark: SparkSession, fetch: Fetch, sources: list[str], limit: int = PAGE, most: int = MOST_PAGES) -> DataFrame:
    """All pages of the sources: PAGES, an item in JSON in each row, or an error."""
    spark.dataSource.register(feed_source(fetch))
    return spark.read.format("feed").options(sources=",".join(sources), limit=str(limit), most=str(most)).load()


def feed_items(found: DataFrame, schema: str) -> DataFrame:
    """source, page and the fields of the items of pages without an error."""
    return found.filter("error is null").select("source", "page", F.from_json("item", schema).alias("i")).select("source", "page", "i.*")
