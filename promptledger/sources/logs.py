"""Guard-event and history logs as day-partitioned JSON tables.

A log is written in one of two layouts.  Without batches, ``day=<d>`` folders are
appended to.  With them, each batch has ``batch=<id>/day=<d>`` folders of its own and
a row in the table ``_commits`` once they are complete: a batch that is written
again replaces itself, and readers see committed batches only.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import GUARD_EVENT_SCHEMA, HISTORY_SCHEMA
from ..storage import broadcast_if_small, exists

CORRUPT = "_corrupt"


def _day_of(timestamp: Column) -> Column:
    return F.to_date(timestamp.cast("timestamp"))


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}/_commits"


def _committed(df: DataFrame, path: str) -> DataFrame:
    """The rows of committed batches, for a log that is written in batches."""
    spark = df.sparkSession
    done = spark.read.schema("batch string").parquet(f"{_commits(path)}/*").distinct()
    return df.join(broadcast_if_small(done), "batch", "left_semi").drop("batch")


def _read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    in_batches = exists(spark, _commits(path))
    df = (
        spark.read.schema(f"{schema}, {CORRUPT} string, {'batch string, ' if in_batches else ''}day date")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return _committed(df, path) if in_batches else df


def newest_days(spark: SparkSession, path: str, max_days: int) -> list[dt.date]:
    """The newest ``max_days`` day partitions.

    Listing files as ``binaryFile`` without their content opens none of them:
    one row per file, of which only the partition value is kept.
    """
    files = spark.read.format("binaryFile").load(path)
    if exists(spark, _commits(path)):
        files = _committed(files.select(F.col("batch").cast("string").alias("batch"), "day"), path)
    rows = files.select(F.col("day").cast("date").alias("day")).distinct().orderBy(F.desc("day")).limit(max_days)
    return [r["day"] for r in rows.collect()]


def read_guard_events(spark: SparkSession, path: str, max_days: int | None = None) -> DataFrame:
    """Event log; unreadable lines are kept with their text in ``_corrupt``.

    Blank lines are ignored.  With ``max_days`` only the newest day partitions
    are scanned.
    """
    df = _read_json(spark, path, GUARD_EVENT_SCHEMA)
    if max_days is not None:
        df = df.where(F.col("day").isin(newest_days(spark, path, max_days)))
    return df


def _unreadable() -> Column:
    # A JSON scan has to read some column besides the corrupt one, so the test
    # names the timestamp too; no timestamp is a NUL.
    return F.col(CORRUPT).isNotNull() | F.coalesce(F.col("timestamp") == "\x00", F.lit(False))


def good_lines(df: DataFrame) -> DataFrame:
    return df.where(~_unreadable()).drop(CORRUPT)


def corrupt_lines(df: DataFrame) -> DataFrame:
    """The lines that could not be read, as text."""
    return df.where(_unreadable()).select(CORRUPT, "day")


def read_history(spark: SparkSession, path: str, day: str | dt.date | None = None) -> DataFrame:
    """Usage records, malformed lines skipped, optionally of one UTC day (S3)."""
    df = _read_json(spark, path, HISTORY_SCHEMA)
    if day is not None:
        # Files are laid out by day, so this prunes partitions.
        df = df.where(F.col("day") == F.lit(str(day)).cast("date"))
    return good_lines(df)


def _write_by_day(df: DataFrame, path: str, day: Column, batch: str | None) -> None:
    # Rebalancing gives each day a few well-filled files; adaptive execution
    # splits a busy day over many writers instead of sending it to one.
    spread = df.withColumn("day", day).hint("rebalance", "day")
    if batch is None:
        spread.write.partitionBy("day").mode("append").json(path)
        return
    # Read back as a partition value, an id must not look like a number in another form.
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", batch):
        raise ValueError(f"batch ids are letters, digits, - and _ behind a letter, not {batch!r}")
    spread.write.partitionBy("day").mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")
    done = df.sparkSession.range(1).select(F.lit(batch).alias("batch")).coalesce(1)
    done.write.mode("overwrite").parquet(f"{_commits(path)}/{batch}")


def write_guard_events(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append events to the day-partitioned log (S4); with ``batch``, a re-run adds nothing."""
    _write_by_day(df, path, _day_of(F.col("timestamp")), batch)


def write_history(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append usage records to the day-partitioned history (S5); ``batch`` as above."""
    _write_by_day(df, path, _day_of(F.col("timestamp")), batch)
