"""Keyed alerts: the fold over a table, and as a stream over several micro-batches and a restart."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswork.streaming import streams as Z

START = datetime(2024, 3, 1)


def plainly(rows, least, lookback, cool_down):
    out = []
    for key in {k for k, _ in rows}:
        times, last = sorted(t for k, t in rows if k == key), None
        for i, t in enumerate(times):
            n = sum(1 for u in times[: i + 1] if u > t - timedelta(seconds=lookback))
            if n >= least and (last is None or t - last >= timedelta(seconds=cool_down)):
                out.append((key, t, n))
                last = t
    return sorted(out)


def failures():
    draw = random.Random(9)
    rows, at = [], START
    for _ in range(300):
        at += timedelta(seconds=draw.choice([1, 60, 200, 900, 4000]))
        rows.append((draw.choice("abc"), at))
    rows += [("d", START + timedelta(seconds=30 * i)) for i in range(500)]  # a key that never pauses
    return rows


def found(table):
    return sorted((r["key"], r["alert_at"], r["n"]) for r in table.select("key", F.col("alert_at").cast("timestamp_ntz").alias("alert_at"), "n").collect())


def test_keyed_alerts(spark):
    rows = failures()
    table = spark.createDataFrame(rows, "key string, ts timestamp_ntz")
    assert found(Z.keyed_alerts(table)) == plainly(rows, 3, 900, 1800)
    assert found(Z.keyed_alerts(table, 5, 300, 60)) == plainly(rows, 5, 300, 60)
    assert Z.keyed_alerts(table.limit(0)).count() == 0 and Z.keyed_alerts(spark.createDataFrame([(None, None)], "key string, ts timestamp_ntz")).count() == 0


def test_the_stream_equals_the_fold(spark, tmp_path):
    rows = sorted(failures(), key=lambda r: r[1])
    parts = [rows[i : i + 200] for i in range(0, len(rows), 200)] + [[("z", rows[-1][1] + timedelta(days=3))], [("z", rows[-1][1] + timedelta(days=4))]]
    random.Random(1).shuffle(parts[1])  # within a micro-batch in any order
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "key string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if i in (1, 2, len(parts) - 1):  # goes on from its checkpoint each time
            stream = spark.readStream.schema("key string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
            Z.run_once(Z.keyed_alerts_stream(stream, late="20 minutes"), f"file://{tmp_path}/out", checkpoint=f"file://{tmp_path}/state")
    assert found(spark.read.schema(Z.ALERTS).parquet(f"file://{tmp_path}/out")) == plainly(rows, 3, 900, 1800)
