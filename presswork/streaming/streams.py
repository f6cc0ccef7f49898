"""Time-based operators, each for batch and stream tables, and helpers to run a stream over landed files."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: 19:00 in Beijing is 11:00 UTC.
BOUNDARY = "11 hours"


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events of each business day (19:00 to 19:00 Beijing) and type; in a stream with a watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    day = F.window("ts", "1 day", "1 day", BOUNDARY)
    return rows.groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"), "event_type", "n")


def error_bursts(events: DataFrame, least: int = 3, late: str = "1 hour") -> DataFrame:
    """Sliding windows of 15 minutes, every 5, with at least so many errors."""
    rows = events.filter("event_type = 'error'")
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def alerts(bursts: DataFrame, cool_down: int = 1800) -> DataFrame:
    """Bursts that alert: none within the cool-down of the alert before, over midnight too.

    A burst whose forerunner is older than the cool-down always alerts, so the bursts fall into runs that don't depend
    on each other, and each run is folded in order. There is a burst for a time slide at most, however many events
    there are, so the window over all of them is small.
    """
    pause = F.expr(f"INTERVAL {cool_down} SECONDS")
    order = W.orderBy("end")
    begins = F.coalesce(F.col("end") - F.lag("end").over(order) >= pause, F.lit(True))
    runs = bursts.select("end", "n", begins.cast("int").alias("begins")).withColumn("run", F.sum("begins").over(order))
    held = runs.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("end", "n"))).alias("b"))
    none = F.array_compact(F.array(F.when(F.lit(False), F.get("b", 0))))
    kept = F.aggregate("b", none, lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).when(x["end"] - F.get(kept, F.size(kept) - 1)["end"] < pause, kept).otherwise(F.concat(kept, F.array(x))))
    return held.select(F.explode(kept).alias("k")).select(F.col("k.end").alias("alert_at"), F.col("k.n").alias("n"))


#: Failures within the lookback that alert, its seconds, and those of the cool-down. Fixed values.
ALERT_LEAST, LOOKBACK, COOL_DOWN = 3, 900, 1800
ALERTS = "key string, alert_at timestamp, n int"


class _Recent:
    """The failures of a key within the lookback, and its last alert: what both forms of alerts keep."""

    def __init__(self, times: list[int], last: int | None, least: int, lookback: int, cool_down: int):
        self.times, self.last = deque(times), last
        self.least, self.lookback, self.cool_down = least, lookback * 1_000_000, cool_down * 1_000_000

    def add(self, at: int) -> int | None:
        """Takes the next failure (in microseconds, in order) and gives the count if it alerts."""
        self.times.append(at)
        while self.times[0] <= at - self.lookback:
            self.times.popleft()
        if len(self.times) < self.least or (self.last is not None and at - self.last < self.cool_down):
            return None
        self.last = at
        return len(self.times)


def keyed_alerts(failures: DataFrame, least: int = ALERT_LEAST, lookback: int = LOOKBACK, cool_down: int = COOL_DOWN) -> DataFrame:
    """failures (key, ts): key, alert_at, n. A failure alerts if the lookback up to it has enough failures of its key and
    none of the key's alerts is within the cool-down.

    Each key's failures come in order to one task, which keeps those of one lookback: a key that never pauses is read as a
    stream too, and isn't gathered.
    """
    ordered = failures.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null").repartition("key").sortWithinPartitions("key", "ts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            out = []
            for k, at in zip(batch.column("key").to_pylist(), batch.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), strict=True):
                if held is None or k != key:
                    key, held = k, _Recent([], None, least, lookback, cool_down)
                if n := held.add(at):
                    out.append((k, at, n))
            k, at, n = zip(*out, strict=True) if out else ((), (), ())
            times = pa.array(at, pa.int64()).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), times, pa.array(n, pa.int32())], ["key", "alert_at", "n"])

    return ordered.mapInArrow(fold, ALERTS)


def keyed_alerts_stream(failures: DataFrame, least: int = ALERT_LEAST, lookback: int = LOOKBACK, cool_down: int = COOL_DOWN, late: str = "10 minutes") -> DataFrame:
    """The same as a stateful stream: failures wait until the watermark has passed them, so that they are counted in order.

    A key's state is its waiting failures, those of the last lookback, and its last alert as a value; a timer at the first
    waiting failure wakes it, and one at the end of lookback and cool-down clears it, so quiet keys cost nothing.
    """

    class Alerting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at bigint")
            self.recent = handle.getListState("recent", "at bigint")
            self.last = handle.getValueState("last", "at bigint")

        def _timer(self, at: int) -> None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

        def handleInputRows(self, key, rows, timerValues):
            times = [int(t.value // 1000) for frame in rows for t in frame["ts"]]
            self.waiting.appendList([(t,) for t in times])
            self._timer(min(t for (t,) in self.waiting.get()) // 1000 + 1)
            yield from self._passed(key, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if not self.waiting.exists():
                for state in (self.recent, self.last):
                    state.clear()
                return
            yield from self._passed(key, timerValues.getCurrentWatermarkInMs())

        def _passed(self, key, watermark: int):
            """Counts the failures that the watermark has passed; what is still to come waits on."""
            every = sorted(t for (t,) in self.waiting.get())
            ready = [t for t in every if t < watermark * 1000]
            if not ready:
                return
            held = _Recent([t for (t,) in self.recent.get()], self.last.get()[0] if self.last.exists() else None, least, lookback, cool_down)
            found = [(t, n) for t in ready if (n := held.add(t))]
            left = every[len(ready) :]
            self.waiting.put([(t,) for t in left]) if left else self.waiting.clear()
            self.recent.put([(t,) for t in held.times])
            if held.last is not None:
                self.last.update((held.last,))
            self._timer((left[0] if left else ready[-1] + (lookback + cool_down) * 1_000_000) // 1000 + 1)
            if found:
                yield pd.DataFrame({"key": [key[0]] * len(found), "alert_at": pd.to_datetime([t for t, _ in found], unit="us"), "n": pd.array([n for _, n in found], "int32")})

        def close(self) -> None:
            pass

    failures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = failures.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Alerting(), ALERTS, "append", "EventTime")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each identity once: within the watermark in a stream."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def states(events: DataFrame, lease: int = 900) -> DataFrame:
    """The last state of each article, and when its lease runs out; the batch form of :func:`folded`."""
    last = events.groupBy("article_id").agg(F.max_by(F.struct("to_status", "created_at"), F.struct("created_at", "id")).alias("e"), F.count("*").alias("n_events"))
    leased = F.col("e.to_status") == "QUALITY_CHECKING"
    return last.select("article_id", F.col("e.to_status").alias("status"), "n_events", F.when(leased, F.col("e.created_at") + F.expr(f"INTERVAL {lease} SECONDS")).alias("expires_at"))


def folded(events: DataFrame, lease: int = 900, late: str = "0 seconds") -> DataFrame:
    """The state machine over a stream of article events: state for each article, kept between batches.

    Of equal times the higher event id is later. A check holds its article for ``lease`` seconds of event time: a timer
    is set, and when the watermark passes it without a later event, the article is given out as expired.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, status, n = state.get if state.exists else (-(1 << 62), -1, "", 0)
        expired = state.hasTimedOut
        for rows in () if expired else batches:
            n += len(rows)
            top = rows.sort_values(["created_at", "id"]).iloc[-1]
            when = int(pd.Timestamp(top["created_at"]).value // 1000)
            if (when, int(top["id"])) > (at, last):
                at, last, status = when, int(top["id"]), top["to_status"]
        state.update((at, last, status, n))
        expires = at + lease * 1_000_000 if status == "QUALITY_CHECKING" else None
        if expires is not None and not expired:
            if expires // 1000 > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(expires // 1000)
            else:
                expired = True
        yield pd.DataFrame({"article_id": [key[0]], "status": [status], "n_events": [n], "expires_at": [pd.Timestamp(expires * 1000) if expires is not None else pd.NaT], "expired": [expired]})

    return events.withWatermark("created_at", late).groupBy("article_id").applyInPandasWithState(
        fold, "article_id bigint, status string, n_events bigint, expires_at timestamp, expired boolean", "at bigint, last bigint, status string, n bigint", "update", GroupStateTimeout.EventTimeTimeout
    )


def pending_dates(ledger: DataFrame, first: date, last: date, now: datetime, settle_days: int = 2, retry_minutes: int = 30, most: int = 5) -> DataFrame:
    """Days to fetch, oldest first: never fetched, failed a while ago, or fetched too soon after the day.

    ledger: stat_date, status, fetched_at. All times are UTC.
    """
    days = ledger.sparkSession.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS stat_date")
    joined = days.join(ledger, "stat_date", "left")
    early = F.date_diff(F.to_date("fetched_at"), "stat_date") < settle_days
    later = F.to_date(F.lit(now)) > F.to_date("fetched_at")
    why = (
        F.when(F.col("status").isNull(), "missing").when((F.col("status") == "FAILED") & (F.col("fetched_at") <= F.lit(now) - F.expr(f"INTERVAL {retry_minutes} MINUTES")), "failed")
        .when((F.col("status") == "SUCCESS") & early & later, "early")
    )
    return joined.withColumn("why", why).filter("why is not null").orderBy("stat_date").limit(most).select("stat_date", "why")


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the Parquet files that lie in a folder, or over the one file at the path."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", name if single(spark, path) else "*.parquet").parquet(folder if single(spark, path) else path)


def single(spark: SparkSession, path: str) -> bool:
    """Is there a file at the path, in whatever store it lies?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def run_once(stream: DataFrame, out: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Processes what there is, once, to Parquet files; later calls with the same checkpoint go on from there."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint or f"{out}/_state").trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_once(stream: DataFrame, apply, checkpoint: str, mode: str = "update") -> None:
    """Processes what there is, each micro-batch by ``apply(batch, id)``."""
    stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_of(updates: DataFrame, key: str, version: str) -> DataFrame:
    """The last update of each key among all micro-batches."""
    w = W.partitionBy(key).orderBy(F.desc(version))
    return updates.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
