"""What the training-data operators share: written tables in the shared folder, chunks of columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and all runs on this machine (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="presswork-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/presswork/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: it cuts the lineage and outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bounds of an Arrow batch, each where the session has Spark's default: so whole texts come in batches of about 1 MB
#: (one text at least), whose buffers executors take from their pool of 4 MB chunks.
BATCH = {"maxRecordsPerBatch": ("10000", "1024"), "maxBytesPerBatch": ("67108864b", "1048576b")}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its executor hold of whole texts at a time."""
    for name, (default, bound) in BATCH.items():
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, bound)


_KEPT: list = []


def kept(cached):
    """A cache that a worker keeps from task to task, until a task of another function comes."""
    _KEPT.append(cached)
    return cached


def let_go() -> None:
    for cached in _KEPT:
        cached.cache_clear()


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False):
    """The function for mapInArrow, which gives back freed memory at the end of a task, since workers stay for later
    ones, and at its begin what others of them kept, unless it is one that keeps something."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            let_go()
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def long_list(values: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    """A list column from one array for each row."""
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


#: Parts that the rows of one root are dealt to.
SALT = 16


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) of the connected components of an edge table; root is the least node.

    Every round points each node at the least root among its own and its neighbours' and then jumps to that
    root's root; rounds are written to the shared folder, so their number is the logarithm of a path's length
    and none depends on the lineage of another. No edge goes to the driver, only the count of changes.
    """
    both = edges.select(F.col(left).alias("x"), F.col(right).alias("y"))
    both = written(both.union(both.select("y", "x")).distinct(), "edges")
    state = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "roots")
    while True:
        near = (
            both.join(state.select(F.col("node").alias("y"), "root"), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        step = state.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = written(step, "steps")
        # a root's own new root: one jump along the pointers; a large component's rows are dealt out by salt
        jump = step.select("root").distinct().join(step.select(F.col("node").alias("root"), F.col("root").alias("further")), "root")
        jump = jump.select("root", "further", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        salted = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
        new = written(
            salted.join(jump, ["root", "salt"], "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")),
            "roots",
        )
        if not new.filter("root <> old").limit(1).count():
            return new.select("node", "root")
        state = new.select("node", "root")
