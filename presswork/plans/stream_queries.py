"""Time-based operators: business days, bursts, alerts, state, late data; and real streams over landed files."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from ..sources.sinks import shared_folder
from ..streaming import streams as Z
from .registry import query


def shared(v, name: str) -> str:
    return f"{shared_folder(v._spark)}/presswork/{name}-{uuid.uuid4().hex}"


_DAY = "(time_bucket(INTERVAL 1 DAY, ts - INTERVAL 11 HOUR) + INTERVAL 11 HOUR)"


@query(f"SELECT {_DAY} AS day_start, {_DAY} + INTERVAL 1 DAY AS day_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def st1_business_days(v):
    return Z.daily_counts(v.table("events"))


_BURSTS = "SELECT s AS start, s + INTERVAL 15 MINUTE AS \"end\", count(*) AS n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(k * 5) AS s FROM events, range(3) AS r(k) WHERE event_type = 'error') GROUP BY s HAVING count(*) >= {}"


@query(_BURSTS.format(2))
def st6_error_bursts(v):
    return Z.error_bursts(v.table("events"), 2)


@query("WITH RECURSIVE b AS (" + _BURSTS.format(2) + '), nxt AS (SELECT x."end" AS e, min(y."end") AS f FROM b x JOIN b y ON y."end" >= x."end" + INTERVAL 30 MINUTE GROUP BY x."end"), '
       'a AS (SELECT min("end") AS e FROM b UNION ALL SELECT f FROM a JOIN nxt USING (e)) SELECT b."end" AS alert_at, b.n FROM a JOIN b ON b."end" = a.e')
def st6_alerts(v):
    return Z.alerts(Z.error_bursts(v.table("events"), 2))


@query("SELECT DISTINCT event_id FROM events")
def st3_distinct_events(v):
    return Z.distinct_events(v.table("events")).select("event_id")


@query("l AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY article_id) AS n_events FROM article_events) SELECT article_id, to_status AS status, n_events, CASE WHEN to_status = 'QUALITY_CHECKING' THEN created_at + INTERVAL 900 SECOND END AS expires_at FROM l WHERE k = 1", "article_events")
def st5_article_states(v):
    return Z.states(v.article_events)


@query("d AS (SELECT proc_time::DATE AS stat_date, count(*) AS n FROM click_events GROUP BY 1), c AS (SELECT x::DATE AS stat_date FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) AS r(x)), l AS (SELECT stat_date, CASE WHEN n % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, stat_date::TIMESTAMP + to_hours(30 + 24 * (n % 2)) AS fetched_at FROM d WHERE n % 7 <> 0) "
       "SELECT stat_date, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'FAILED' THEN 'failed' ELSE 'early' END AS why FROM c LEFT JOIN l USING (stat_date) WHERE status IS NULL OR status = 'FAILED' OR date_diff('day', stat_date, fetched_at::DATE) < 2 ORDER BY stat_date LIMIT 5", "click_events")
def st4_pending_dates(v):
    days = v.click_events.groupBy(F.to_date("proc_time").alias("stat_date")).agg(F.count("*").alias("n")).filter("n % 7 <> 0")
    ledger = days.select("stat_date", F.when(F.col("n") % 3 == 0, "FAILED").otherwise("SUCCESS").alias("status"), F.expr("CAST(stat_date AS TIMESTAMP_NTZ) + make_dt_interval(0, 30 + 24 * (n % 2))").alias("fetched_at"))
    return Z.pending_dates(ledger, date(2024, 1, 1), date(2024, 1, 31), datetime(2024, 3, 1))


@query(f"SELECT * FROM (SELECT {_DAY} AS day_start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE day_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def st1_business_days_stream(v):
    """Structured Streaming over the landed events: only windows that the watermark has closed are out."""
    path = f"{v._dir}/events.parquet"
    schema = v.table("events").schema
    stream = Z.landed(v._spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = shared(v, "days")
    Z.run_once(Z.daily_counts(stream), f"{out}/out", checkpoint=f"{out}/state")
    found = v._spark.read.schema("day_start timestamp, day_end timestamp, event_type string, n bigint").parquet(f"{out}/out")
    return found.select(F.col("day_start").cast("timestamp_ntz").alias("day_start"), "event_type", "n")


@query("l AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY article_id) AS n_events FROM article_events) SELECT article_id, to_status AS status, n_events, to_status = 'QUALITY_CHECKING' AND created_at + INTERVAL 900 SECOND < (SELECT max(created_at) FROM article_events) AS expired FROM l WHERE k = 1", "article_events")
def st5_article_states_stream(v):
    """The same fold as a stateful stream over the landed events."""
    rows = Z.landed(v._spark, f"{v._dir}/events.parquet", v.table("events").schema)
    kind = F.col("event_type")
    status = F.when(kind == "signup", "RECEIVED").when(kind == "view", "QUALITY_CHECKING").when(kind == "click", "READY_TO_PUBLISH").when(kind == "purchase", "PUBLISHED").otherwise("PUBLISH_FAILED")
    stream = rows.select(F.col("event_id").alias("id"), (F.col("user_id") + 1).alias("article_id"), F.col("ts").cast("timestamp").alias("created_at"), status.alias("to_status"))
    out = shared(v, "states")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/out")

    Z.upsert_once(Z.folded(stream), keep, f"{out}/state")
    updates = v._spark.read.schema("article_id bigint, status string, n_events bigint, expires_at timestamp, expired boolean, batch bigint").parquet(f"{out}/out")
    return Z.latest_of(updates.withColumn("version", F.struct("n_events", "expired")), "article_id", "version").select("article_id", "status", "n_events", "expired")


@query("SELECT DISTINCT event_id FROM events")
def st3_distinct_events_stream(v):
    """Each identity once, as a stream with a watermark over the landed events; every event is landed twice."""
    schema = v.table("events").schema
    stream = Z.landed(v._spark, f"{v._dir}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = shared(v, "distinct")
    Z.run_once(Z.distinct_events(twice).select("event_id"), f"{out}/out", checkpoint=f"{out}/state")
    return v._spark.read.schema("event_id bigint").parquet(f"{out}/out")


#: Failures of each of five groups of users; an alert is one of three within six hours, and none follows it for twelve.
_FAILED = "f AS (SELECT (user_id % 5)::VARCHAR AS key, ts FROM events WHERE event_type = 'error'), c AS (SELECT key, ts, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL '5 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)::INTEGER AS n FROM f)"
_KEYED = (
    f"WITH RECURSIVE {_FAILED}, b AS (SELECT key, ts, max(n) AS n FROM c WHERE n >= 3 GROUP BY ALL), nxt AS (SELECT x.key, x.ts, min(y.ts) AS f FROM b x JOIN b y ON y.key = x.key AND y.ts >= x.ts + INTERVAL 12 HOUR GROUP BY ALL), "
    "a AS (SELECT key, min(ts) AS ts FROM b GROUP BY key UNION ALL SELECT a.key, n.f FROM a JOIN nxt n USING (key, ts)) SELECT a.key, a.ts AS alert_at, b.n FROM a JOIN b USING (key, ts)"
)


def failed(rows):
    return rows.filter("event_type = 'error'").select((F.col("user_id") % 5).alias("key"), F.col("ts").cast("timestamp").alias("ts"))


@query(_KEYED)
def st6_keyed_alerts(v):
    """Alerts of each group of failures, with lookback and cool-down."""
    return Z.keyed_alerts(failed(v.table("events")), lookback=6 * 3600, cool_down=12 * 3600).select("key", F.col("alert_at").cast("timestamp_ntz").alias("alert_at"), "n")


@query(_KEYED + " WHERE a.ts < (SELECT max(ts) - INTERVAL 10 MINUTE FROM f)")
def st6_keyed_alerts_stream(v):
    """The same as a stateful stream over the landed events: alerts that the watermark has passed."""
    rows = Z.landed(v._spark, f"{v._dir}/events.parquet", v.table("events").schema)
    out = shared(v, "alerts")
    Z.run_once(Z.keyed_alerts_stream(failed(rows), lookback=6 * 3600, cool_down=12 * 3600), f"{out}/out", checkpoint=f"{out}/state")
    found = v._spark.read.schema(Z.ALERTS).parquet(f"{out}/out")
    return found.select("key", F.col("alert_at").cast("timestamp_ntz").alias("alert_at"), "n")
