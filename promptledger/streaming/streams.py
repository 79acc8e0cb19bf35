"""The same operators over streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, DateType, DecimalType, LongType, StructField, StructType

from ..functions.catalogue import DEFAULT_DETECTORS, Detector
from ..functions.prices import Price
from ..functions.tokens import messages_to_text
from ..operators.budget import budget_gate
from ..operators.govern import score_requests, verdicts
from ..operators.guards import agent_policy, input_guard, output_guard
from ..schemas import GUARD_EVENT_SCHEMA, HISTORY_SCHEMA, MONEY, VIOLATIONS
from ..sources.logs import CORRUPT
from ..storage import broadcast_if_small, compute_once, delete, exists, materialize, scratch_scope


# All that is there, then stop.  A stream that runs on takes {"processingTime": "5 seconds"}.
ONCE = {"availableNow": True}


def stream_guard_events(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Continuous read of the event log; bad lines carry ``_corrupt``."""
    return _stream_json(spark, path, GUARD_EVENT_SCHEMA, max_files)


def stream_history(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Continuous read of the usage history."""
    return _stream_json(spark, path, HISTORY_SCHEMA, max_files)


def _stream_json(spark: SparkSession, path: str, schema: str, max_files: int) -> DataFrame:
    return (
        spark.readStream.schema(f"{schema}, {CORRUPT} string, day date")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream with a watermark has dropped as too late, over its recorded batches."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def _watermarked(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    return df if lateness is None else df.withWatermark(ts, lateness)


def stream_daily_usage(
    df: DataFrame, ts: str = "ts", cost: str = "cost_usd", lateness: str | None = "1 day"
) -> DataFrame:
    """Running checks and spend per UTC day (R1); a day closes once the watermark passes it.

    A live tail needs the watermark to let go of old days.  A backfill reads
    files in no particular order of time: there pass ``lateness=None``, so that
    no row can be late; the state is one row per day.
    """
    return (
        _watermarked(df, ts, lateness)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("checks"),
            F.sum(F.when(F.col(cost) > 0, F.col(cost)).otherwise(F.lit(0))).cast(MONEY).alias("spend"),
        )
        .select(F.to_date("w.start").alias("day"), "checks", "spend")
    )


def stream_usage_by_tool(df: DataFrame, ts: str = "timestamp", lateness: str | None = "1 day") -> DataFrame:
    """Usage per UTC day and tool, continuously (R2); ``lateness`` as above."""
    return (
        _watermarked(df, ts, lateness)
        .groupBy(F.window(ts, "1 day").alias("w"), F.coalesce("tool", F.lit("Unknown")).alias("tool"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum(F.coalesce("cost_usd", F.lit(0))).cast(MONEY).alias("cost"),
            F.sum(F.coalesce("tokens", F.lit(0).cast("long"))).alias("tokens"),
            F.count_if(F.coalesce("blocked", F.lit(False))).alias("blocked"),
        )
        .select(F.to_date("w.start").alias("day"), "tool", "requests", "cost", "tokens", "blocked")
    )


def stream_traffic_stats(events: DataFrame) -> DataFrame:
    """Totals per kind of event and per violation type, continuously.

    State is one row per event kind and violation type.
    """
    meta = F.col("metadata")
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(F.lit("event").alias("kind"), F.coalesce("event", F.lit("unknown")).alias("name"), F.lit(True).alias("whole")))
    types = F.transform(
        F.coalesce("violations", F.array().cast(VIOLATIONS)),
        lambda v: F.struct(F.lit("violation").alias("kind"), F.coalesce(v["type"], F.lit("unknown")).alias("name"), F.lit(False).alias("whole")),
    )
    rows = events.select(
        F.explode(F.concat(whole, types)).alias("k"),
        F.coalesce(meta["estimated_cost_usd"].cast(MONEY), F.lit(0).cast(MONEY)).alias("cost"),
        F.coalesce(meta["input_tokens"], zero).alias("i"),
        F.coalesce(meta["output_tokens"], zero).alias("o"),
    )

    def on_events(c: str) -> Column:
        return F.when(F.col("k.whole"), F.col(c)).otherwise(F.lit(0))

    return rows.groupBy(F.col("k.kind").alias("kind"), F.col("k.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(on_events("cost")).cast(MONEY).alias("cost"),
        F.sum(on_events("i")).cast("long").alias("input_tokens"),
        F.sum(on_events("o")).cast("long").alias("output_tokens"),
    )


def stream_guard(df: DataFrame, policies: DataFrame | None = None,
                 detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    """Input and output guard on a stream of requests, no state."""
    staged = agent_policy(df, policies).withColumn("_text", messages_to_text("messages"))
    policy = F.col("policy")
    return (
        compute_once(staged, "guard", input_guard("_text", policy, detectors))
        .withColumn("output_violations", F.when(F.col("guard.allowed"), output_guard("answer", policy, detectors)))
        .drop("_text", "policy")
    )


def run_to_table(
    df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), fmt: str = "parquet", trigger: Mapping[str, object] | None = None
) -> StreamingQuery:
    """Append a stateless or closed-window stream to files, once per input.

    ``trigger`` has the arguments of Spark's trigger; without it the stream takes what is there and stops.
    """
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**(trigger or ONCE)).start(path)


def stream_event_sink(events: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Append events to the day-partitioned log exactly once."""
    return run_to_table(
        events.withColumn("day", F.to_date(F.col("timestamp").cast("timestamp"))), path, checkpoint, ["day"], "json", trigger
    )


def run_to_snapshots(
    df: DataFrame, path: str, checkpoint: str, mode: str = "complete", trigger: Mapping[str, object] | None = None, keys: Sequence[str] = ()
) -> StreamingQuery:
    """Keep the result of an aggregate, batch by batch, under ``batch=<n>``.

    Each batch stands for all before it: a ``complete`` one is the whole
    result; one of ``update`` is merged with the batch before by ``keys``.  Batches
    before the last but one are deleted, so the folder holds two at most, and a
    retried batch still finds the one before it.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/batch={number - 1}"
        if mode == "update" and exists(spark, before):
            old = spark.read.schema(batch.schema).parquet(before)
            batch = old.join(batch.select(*keys), list(keys), "left_anti").select(*batch.columns).unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        delete(spark, f"{path}/batch={number - 2}")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or ONCE))
        .start()
    )


def latest_snapshot(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The result as of the newest batch; ``keys`` are those of a row."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max("batch")).first()[0]
    return df.where(F.col("batch") == newest).drop("batch")


class BudgetStream:
    """The daily budget gate over micro-batches (R5), equal to the batch gate however late rows come.

    A row that arrives late stands before rows that are already decided, and may
    change what is left for them.  So the ledger keeps every decided row (without
    its texts) under ``ledger/batch=<n>/day=<d>``.  A micro-batch reads the days it
    has rows of; what comes before its first row of a day is an opening balance,
    what comes behind is decided anew together with the new rows by the
    parallel gate.  New rows and rows whose decision has changed are written as
    batch ``n`` of the ledger and of ``verdicts``; the newest one of a request
    holds.  On rows in order nothing is decided twice, and of earlier rows only
    sums are taken.

    A retried batch reads the batches before it only and overwrites its own
    folders.  Request ids are unique, as everywhere.

    ``keep_days`` makes a day final when a later one by more days has
    been seen: its decisions no longer change, and a row that still
    arrives for it is decided behind all its rows (``late``).  By default days stay open.
    """

    def __init__(self, spark: SparkSession, root: str, policies: DataFrame | None = None,
                 prices: DataFrame | Sequence[Price] | None = None, keep_days: int | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.policies, self.prices, self.keep_days = policies, prices, keep_days

    def _known(self, number: int, schema: StructType) -> DataFrame | None:
        """The newest ledger row of each request as of the batch before ``number``."""
        path = f"{self.root}/ledger"
        if not exists(self.spark, path):
            return None
        names = [f.name for f in schema.fields if f.name != "day"]
        stored = StructType([*(f for f in schema.fields if f.name != "day"), StructField("batch", LongType()), StructField("day", DateType())])
        rows = self.spark.read.schema(stored).parquet(path).where(F.col("batch") < number)
        newest = F.max_by(F.struct(*names), "batch").alias("r")
        return rows.groupBy("day", F.col("request_id").alias("_request")).agg(newest).select("r.*", "day")

    def process(self, batch: DataFrame, number: int) -> None:
        with scratch_scope(self.spark):
            self._process(batch, number)

    def _process(self, batch: DataFrame, number: int) -> None:
        scored = materialize(score_requests(batch, self.policies, self.prices), "stream-scored").withColumn("day", F.to_date("ts"))
        decision = StructType([
            StructField("over_budget", BooleanType()), StructField("spend_before", DecimalType(18, 6)), StructField("late", BooleanType())
        ])
        known = self._known(number, StructType([*scored.schema.fields, *decision.fields]))
        at = F.struct("ts", "request_id")
        opening, again, final = None, None, F.lit(False)
        if known is not None:
            if self.keep_days is not None:
                days = known.select("day").unionByName(scored.select("day"))
                newest = days.agg(F.max("day")).first()[0]
                final = F.coalesce(F.col("day") < F.date_sub(F.lit(newest), self.keep_days), F.lit(False))
            # One row for each day that the batch has rows of.
            touched = materialize(scored.groupBy(F.col("day").alias("_day")).agg(F.min(at).alias("_first")), "stream-days")
            known = materialize(known.join(broadcast_if_small(touched), F.col("day").eqNullSafe(F.col("_day"))).drop("_day"), "stream-known")
            behind = ~final & (at > F.col("_first"))
            spent = F.when(F.col("over_budget"), F.lit(0).cast(MONEY)).otherwise(F.col("full_cost"))
            opening = known.where(~behind).groupBy("day").agg(F.sum(spent).cast(MONEY).alias("spend"))
            again = known.where(behind).drop("_first").withColumnsRenamed({"over_budget": "_over", "spend_before": "_before"})
        rows = scored.withColumn("late", final)
        if again is not None:
            rows = rows.unionByName(again, allowMissingColumns=True)
        else:
            rows = rows.withColumns({"_over": F.lit(None).cast("boolean"), "_before": F.lit(None).cast("decimal(18,6)")})
        decided = budget_gate(
            rows, "day", "request_id", "ts", F.col("estimate"), F.col("full_cost"), F.col("daily_budget"), opening
        )
        now = rows.join(decided, "request_id")
        same = F.col("over_budget").eqNullSafe(F.col("_over")) & F.col("spend_before").eqNullSafe(F.col("_before"))
        changed = now.where(F.col("_over").isNull() | ~same).withColumn("correction", F.col("_over").isNotNull())
        changed = materialize(changed.drop("_over", "_before"), "stream-decided")
        ledger = changed.drop("correction").withColumn("spend_before", F.col("spend_before").cast("decimal(18,6)"))
        ledger.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/ledger/batch={number}")
        told = verdicts(changed, ["late", "correction"])
        told.write.mode("overwrite").parquet(f"{self.root}/verdicts/batch={number}")

    def start(self, requests: DataFrame, checkpoint: str, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
        return (
            requests.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(self.process)
            .trigger(**(trigger or ONCE))
            .start()
        )

    def verdicts(self) -> DataFrame:
        """Every verdict and every correction, with the ``batch`` that gave it."""
        return self.spark.read.parquet(f"{self.root}/verdicts")

    def decisions(self) -> DataFrame:
        """The verdict of each request that holds now."""
        rows = self.verdicts()
        newest = F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("r")
        return rows.groupBy(F.col("request_id").alias("_request")).agg(newest).select("r.*")


def stream_budget_gate(
    requests: DataFrame, root: str, checkpoint: str, policies: DataFrame | None = None, prices: DataFrame | Sequence[Price] | None = None,
    keep_days: int | None = None, trigger: Mapping[str, object] | None = None,
) -> tuple[BudgetStream, StreamingQuery]:
    """Start the streaming budget gate over a stream of requests (R5); ``trigger`` as in ``run_to_table``."""
    gate = BudgetStream(requests.sparkSession, root, policies, prices, keep_days)
    return gate, gate.start(requests, checkpoint, trigger)
