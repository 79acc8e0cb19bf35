"""Where intermediate tables go, and how large a side may be to be broadcast."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension up to this many rows and bytes (of its rows as JSON) may be broadcast.
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 32_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a test, a notebook on one
    machine) gets a folder under its own warehouse directory.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/promptledger/{label}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` writes inside when the block ends.

    Whatever reads them must have been written by then, too.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, computes the plan
    exactly once, and lets later steps prune columns.
    """
    path = scratch_path(df.sparkSession, label)
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after measuring; an unhinted frame when it is longer or wider."""
    sized = df.limit(limit + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n"))
    rows, size = sized.agg(F.count("*"), F.sum("n")).first()
    if rows <= limit and (size or 0) <= MAX_BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters cannot duplicate.

    A filter on an ordinary computed column is pushed below its projection,
    where the whole expression is evaluated a second time (and below an
    exchange, in fewer tasks).  Filters do not pass the output of a generator,
    so the value is produced by exploding a one-element array.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
