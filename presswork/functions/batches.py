"""How much of whole texts goes to Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A setting with Spark's default, and what it becomes where a session has that: rows of an Arrow batch.
BOUNDS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512"),)


def bounded(spark: SparkSession | None = None) -> None:
    """Bounds the batches of the session, so that what a Python worker holds doesn't grow with a table's partitions."""
    spark = spark or SparkSession.getActiveSession()
    for name, default, bound in BOUNDS if spark else ():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, bound)
