"""What the corpus operators share: reading tables, shared intermediate tables, word rules."""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ASCII white space of every word and line rule: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
NON_WORD = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
BATCH_BYTES = 4_000_000
MAX_BROADCAST_ROWS = 1_000_000  # of one to three longs each: some tens of MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names.

    Only a session without that setting, as in a test, uses its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder: later reads need no executor that made it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_few(df: DataFrame) -> DataFrame:
    """For ``written``: the rows of a stage of many tasks that leaves little, in as few files as Spark's adaptive sizes ask for.

    On a local file system each new file costs its executor a child process or two (``chmod``).
    """
    return df.hint("rebalance")


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that nothing refers to any more.

    It does so when the driver's collector meets them, which a driver with little to do may put off for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """Broadcast after counting; a plain frame, joined by shuffling, beyond the bound."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame from ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def in_small_batches(steps: Callable) -> Callable:
    """For steps on a DataFrame, their first argument, that run their jobs themselves: what goes to Python goes in batches of ``BATCH_BYTES``.

    Outside of its heap Spark holds a batch as Arrow vectors and again as the bytes that it sends, both grown by doubling.
    """

    @functools.wraps(steps)
    def run(df: DataFrame, *args, **kwargs):
        conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(name)
        conf.set(name, BATCH_BYTES)
        try:
            return steps(df, *args, **kwargs)
        finally:
            conf.set(name, before)

    return run


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The maximal runs without ASCII white space; none for a null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, NON_WORD))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller ones, so that what Python holds of them at once stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def clear_of(names: Iterable[str], prefix: str) -> str:
    """``prefix``, lengthened until no column name starts with it."""
    lowered = [n.lower() for n in names]
    while any(n.startswith(prefix.lower()) for n in lowered):
        prefix = "_" + prefix
    return prefix


def free_name(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it while a column has that name."""
    lowered = {n.lower() for n in names}
    while wanted.lower() in lowered:
        wanted = "_" + wanted
    return wanted
