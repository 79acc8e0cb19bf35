"""Running values over ordered keys that survive one key holding most rows.

A plain window sorts a whole key in one task.  Here rows are first cut into
range partitions ("chunks") of the (key, order) sequence, so a large key spans
many chunks; a running value is the value within the chunk plus what earlier
chunks of the same key carry over.  Only keys that cross a chunk border carry
anything, so the carry table has at most about one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

CHUNK = "_chunk"


def cut_into_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None
) -> DataFrame:
    """Add ``_chunk`` and store the result.

    Range bounds are sampled, so the chunk numbers are written out once and
    only ever read back; ``order`` must be unique within a key.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order)
    return materialize(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    per_chunk: Column,
    across: Callable[[Column], Column],
    within: Callable[[Column], Column],
    inclusive: bool,
) -> DataFrame:
    """A running value over chunks.

    ``per_chunk`` sums a chunk up, ``across`` runs over the chunks before it.
    What a chunk inherits is put into it as one more row ahead of its first, so
    no join is needed and null keys behave like any other.
    """
    df = df.withColumn("_v", value)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, CHUNK)
        .agg(per_chunk.alias("_t"))
        .withColumn("_v", across(F.col("_t")).over(earlier))
        .where(F.col("_v").isNotNull())
        .drop("_t")
        .withColumn("_own", F.lit(False))
    )
    both = df.withColumn("_own", F.lit(True)).unionByName(carry, allowMissingColumns=True)
    rows = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy("_own", *order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return both.withColumn(name, within(F.col("_v")).over(rows)).where("_own").drop("_v", "_own")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, inclusive: bool = False
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key (and this row if ``inclusive``)."""
    value = value.cast("long")
    out = _running(df, keys, order, value, name, F.sum("_v"), F.sum, F.sum, inclusive)
    return out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Largest ``value`` up to and including this row; nulls are skipped."""
    return _running(df, keys, order, value, name, F.max("_v"), F.max, F.max, True)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``value`` of the row before this one in its key; null on the first row."""
    newest = F.max_by("_v", F.struct(*order))
    out = _running(df, keys, order, F.struct(value.alias("v")), name, newest, F.last, F.last, False)
    return out.withColumn(name, F.col(name)["v"])
