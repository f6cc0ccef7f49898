"""Sinks and ledgers: replacing days, periods and competitions; appends; exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that the rows have; others stay.

    A partition without new rows isn't touched, so a key that fell to nothing needs :func:`without_empty`.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def without_empty(table: DataFrame, ledger: DataFrame, by: str) -> DataFrame:
    """The table without partitions whose last successful run found nothing: the ledger has ``by`` and ``row_count``."""
    return table.join(ledger.filter("row_count = 0").select(by), by, "left_anti")


def append_events(rows: DataFrame, path: str) -> None:
    """Adds to the history, a folder for each day."""
    rows.withColumn("event_date", F.to_date("created_at")).write.mode("append").partitionBy("event_date").parquet(path)


def export_csv(matrix: DataFrame, path: str) -> None:
    """A report as one CSV file with a header; reports are small."""
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def feed_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed feed pages, one JSON object in a line."""
    return spark.read.schema(schema).json(path)


def warehouse(spark: SparkSession, url: str, table: str, column: str, bounds: list[str], properties: dict[str, str]) -> DataFrame:
    """A JDBC table in half-open windows of a column, a partition for each: retried one by one if they fail."""
    windows = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return spark.read.jdbc(url, table, predicates=windows, properties=properties)


def replace_periods(rows: DataFrame, path: str, key: str = "period") -> None:
    """Replaces the periods that the rows have; rows of a blank source are skipped."""
    replace_partitions(rows.filter(F.trim("source_code") != ""), path, key)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table written to the shared folder: it cuts the lineage and outlives lost executors."""
    path = f"{shared_folder(rows.sparkSession)}/presswork/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shared_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="presswork-")
    return found.rstrip("/")
