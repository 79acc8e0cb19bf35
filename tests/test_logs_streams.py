from __future__ import annotations

import json
import os
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from promptledger import storage
from promptledger.operators import govern, guards, reports
from promptledger.plans import queries, views
from promptledger.schemas import REQUEST_SCHEMA
from promptledger.sources import logs
from promptledger.streaming import streams
from tests.test_guards import request

SF = "/root/testdata/sf0.001"


def event(ts, kind="allowed", **extra):
    return json.dumps({"timestamp": ts, "event": kind, "agent_id": "a", "session_id": None, "violations": [], "metadata": {}, **extra})


def test_event_log_keeps_good_lines_and_routes_bad_ones(spark, tmp_path):
    for day, lines in {
        "2024-01-01": [event("2024-01-01T10:00:00+00:00"), "", "  ", "{broken", event("2024-01-01T11:00:00+00:00", "blocked")],
        "2024-01-02": [event("2024-01-02T10:00:00+00:00", "optimizer_guidance", metadata={"message": "m"}), "not json"],
        "2024-01-03": [event("2024-01-03T00:00:00+00:00", violations=[{"type": "secret", "metadata": {"pii_type": "secret", "confidence": 0.95}}])],
    }.items():
        folder = tmp_path / f"day={day}"
        folder.mkdir()
        (folder / "log.jsonl").write_text("\n".join(lines) + "\n")
    log = logs.read_guard_events(spark, str(tmp_path))
    assert logs.good_lines(log).count() == 4
    assert sorted(r[0] for r in logs.corrupt_lines(log).collect()) == ["not json", "{broken"]
    newest = logs.read_guard_events(spark, str(tmp_path), max_days=2)
    assert {str(r.day) for r in logs.good_lines(newest).collect()} == {"2024-01-02", "2024-01-03"}
    assert "PartitionFilters: [day" in newest._jdf.queryExecution().executedPlan().toString()
    stats = reports.traffic_stats(logs.good_lines(log)).first()
    assert (stats.total_requests, stats.blocked, stats.allowed, stats.block_rate_pct) == (4, 1, 2, 25.0)
    meta = logs.good_lines(log).where("size(violations) > 0").first().violations[0].metadata
    assert meta == {"pii_type": "secret", "confidence": "0.95"}


def test_governed_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([request(n, "hello " * n, minutes=700 * n) for n in range(1, 5)], REQUEST_SCHEMA)
    governed = govern.govern_requests(df)
    events, path = govern.governed_events(governed), str(tmp_path / "events")
    logs.write_guard_events(events, path)
    logs.write_guard_events(events.limit(1), path)
    back = logs.good_lines(logs.read_guard_events(spark, path))
    assert back.count() == 5
    assert sorted(r.timestamp for r in back.collect())[-1] == sorted(r.timestamp for r in events.collect())[-1]
    history = str(tmp_path / "history")
    logs.write_history(govern.history_records(governed), history)
    assert logs.read_history(spark, history).count() == 4
    assert logs.read_history(spark, history, "2024-03-02").count() == 2


def tail(spark, df, tmp_path, name, keys, mode):
    out = str(tmp_path / name)
    streams.run_to_snapshots(df, out, str(tmp_path / f"{name}-check"), mode, keys=keys).awaitTermination()
    return streams.latest_snapshot(spark, out, keys)


def test_streams_equal_batch(spark, tmp_path):
    path = str(tmp_path / "history")
    lines = queries._history_lines(spark, SF)
    logs.write_history(lines, path)

    def live():
        rows = logs.good_lines(streams.stream_history(spark, path, max_files=9))
        return rows.withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "cost_usd": F.col("cost_usd").cast("decimal(18,6)")})

    batch = reports.daily_usage(lines.withColumn("cost_usd", F.col("cost_usd").cast("decimal(18,6)")), "timestamp")
    got = tail(spark, streams.stream_daily_usage(live(), "timestamp", lateness="40 days"), tmp_path, "daily", ["day"], "update")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}
    tools = tail(spark, streams.stream_usage_by_tool(live(), lateness=None), tmp_path, "tools", ["day", "tool"], "update")
    total = tools.groupBy("tool").agg(F.sum("requests"), F.sum("cost"), F.sum("tokens"), F.sum("blocked"))
    want = reports.usage_by_tool(lines.withColumn("cost_usd", F.col("cost_usd").cast("decimal(18,6)")))
    assert {tuple(r) for r in total.collect()} == {tuple(r) for r in want.collect()}


def test_late_rows_never_change_closed_days(spark, tmp_path):
    """One file per micro-batch; the second holds a day the watermark has passed."""
    def put(name, days):
        rows = [(datetime(2024, 1, d), Decimal("1.0")) for d in days]
        spark.createDataFrame(rows, "ts timestamp, cost_usd decimal(18,6)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        rows = spark.readStream.schema("ts timestamp, cost_usd decimal(18,6)").parquet(str(tmp_path / "in"))
        streams.run_to_table(streams.stream_daily_usage(rows), out, check).awaitTermination()

    for days in ([1, 1, 2], [9], [1, 9], [20]):
        put("x", days)
        drain()
    got = {str(r.day): r.checks for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01"] == 2 and got["2024-01-09"] == 2


def test_stateless_guard_stream(spark, tmp_path):
    requests = views.requests(spark, SF)
    requests.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    streams.run_to_table(streams.stream_guard(live).select("request_id", "guard.allowed"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in streams.stream_guard(requests).select("request_id", "guard.allowed").collect()}
    assert got == want and len(got) > 10


@pytest.mark.parametrize("batches", [3])
def test_budget_stream_equals_batch(spark, tmp_path, batches):
    policies = guards.policies_frame(spark, [{"agent_id": "default", "cost": {"daily_budget": "0.010000"}}])
    rows = [request(n, "hello " * (n % 7 + 1), minutes=200 * n, tokens=30 + n % 5) for n in range(1, 31)]
    source, root, check = str(tmp_path / "in"), str(tmp_path / "gate"), str(tmp_path / "check")
    size = len(rows) // batches
    gate = None
    for b in range(batches):
        spark.createDataFrame(rows[b * size:(b + 1) * size], REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(REQUEST_SCHEMA).parquet(source)
        gate, running = streams.stream_budget_gate(live, root, check, policies)
        running.awaitTermination()
    got = {(r.request_id, r.blocked, r.spend_before) for r in gate.decisions().collect()}
    batch = govern.govern_requests(spark.createDataFrame(rows, REQUEST_SCHEMA), policies)
    want = {(r.request_id, r.blocked, r.spend_before) for r in batch.collect()}
    assert got == want and any(b for _, b, _ in got)
    assert not gate.verdicts().where("correction or late").count()


def backlog(spark, tmp_path, rows, order, files, **options):
    """Rows in a given order, one file and one micro-batch after the other, each with its own query."""
    policies = guards.policies_frame(spark, [{"agent_id": "default", "cost": {"daily_budget": "0.010000"}}])
    source, root, check = str(tmp_path / "in"), str(tmp_path / "gate"), str(tmp_path / "check")
    size = -(-len(order) // files)
    for b in range(files):
        part = [rows[k] for k in order[b * size:(b + 1) * size]]
        spark.createDataFrame(part, REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(REQUEST_SCHEMA).parquet(source)
        gate, running = streams.stream_budget_gate(live, root, check, policies, **options)
        running.awaitTermination()
    batch = govern.govern_requests(spark.createDataFrame(rows, REQUEST_SCHEMA), policies)
    return gate, {r.request_id: (r.blocked, r.spend_before) for r in batch.collect()}


def test_late_rows_are_decided_as_in_batch(spark, tmp_path):
    rows = [request(n, "hello " * (n % 7 + 1), minutes=130 * n, tokens=30 + n % 5) for n in range(1, 31)]
    order = random.Random(3).sample(range(30), 30)
    scratch = storage.scratch_root(spark) + "/promptledger"
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    gate, want = backlog(spark, tmp_path, rows, order, 4)
    assert {r.request_id: (r.blocked, r.spend_before) for r in gate.decisions().collect()} == want
    told = gate.verdicts().collect()
    assert any(r.correction and r.blocked for r in told) and not any(r.late for r in told)
    # A retried batch changes nothing, and no intermediate table of a batch stays.
    policies_again = spark.createDataFrame([rows[k] for k in order[24:]], REQUEST_SCHEMA)
    gate.process(policies_again, 3)
    assert {r.request_id: (r.blocked, r.spend_before) for r in gate.decisions().collect()} == want
    left = set(os.listdir(scratch)) - before
    assert not [x for x in left if x.startswith("stream-")]


def test_rows_of_final_days_are_decided_behind_them(spark, tmp_path):
    rows = [request(n, "hello", minutes=600 * n, tokens=30) for n in range(1, 13)]
    gate, want = backlog(spark, tmp_path, rows, [*range(1, 12), 0], 12, keep_days=1)
    got = {r.request_id: r for r in gate.decisions().collect()}
    assert set(got) == set(want)
    assert got[rows[0][0]].late and not any(r.late for k, r in got.items() if k != rows[0][0])
    assert not any(r.correction for r in got.values())


def test_update_snapshots_keep_two_folders(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for n in range(5):
        rows = [(datetime(2024, 1, 1 + d), Decimal("1.0")) for d in range(n + 1)]
        spark.createDataFrame(rows, "ts timestamp, cost_usd decimal(18,6)").coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema("ts timestamp, cost_usd decimal(18,6)").parquet(source)
        usage = streams.stream_daily_usage(live, lateness="30 days")
        streams.run_to_snapshots(usage, out, check, "update", keys=["day"]).awaitTermination()
    got = {r.day.day: r.checks for r in streams.latest_snapshot(spark, out, ["day"]).collect()}
    assert got == {1: 5, 2: 4, 3: 3, 4: 2, 5: 1}
    assert len([x for x in os.listdir(out) if x.startswith("batch=")]) <= 2


def test_a_stream_runs_on_with_a_trigger(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(n):
        spark.createDataFrame([(datetime(2024, 1, n), Decimal("1.0"))], "ts timestamp, cost_usd decimal(18,6)").coalesce(1).write.mode("append").parquet(source)

    put(1)
    live = spark.readStream.schema("ts timestamp, cost_usd decimal(18,6)").parquet(source)
    running = streams.run_to_snapshots(
        streams.stream_daily_usage(live, lateness="30 days"), out, str(tmp_path / "check"), "update", {"processingTime": "1 second"}, ["day"]
    )
    try:
        running.processAllAvailable()
        put(2)
        running.processAllAvailable()
        assert running.isActive
    finally:
        running.stop()
    assert {r.day.day for r in streams.latest_snapshot(spark, out, ["day"]).collect()} == {1, 2}


def test_a_batch_written_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    events = queries._history_events(spark, SF)
    n = events.count()
    for batch in ("one", "one", "two"):
        logs.write_guard_events(events, path, batch)
    # A batch that broke off before its commit is not there for readers.
    events.withColumn("day", F.to_date(F.col("timestamp").cast("timestamp"))).write.partitionBy("day").json(f"{path}/batch=three")
    assert logs.good_lines(logs.read_guard_events(spark, path)).count() == 2 * n
    days = [r[0] for r in events.select(F.to_date(F.col("timestamp").cast("timestamp")).alias("d")).distinct().orderBy(F.desc("d")).limit(2).collect()]
    assert logs.newest_days(spark, path, 2) == days
    with pytest.raises(ValueError):
        logs.write_guard_events(events, path, "../x")


def test_traffic_stream_and_sink(spark, tmp_path):
    events = queries._history_events(spark, SF)
    path = str(tmp_path / "log")
    logs.write_guard_events(events, path)
    live = logs.good_lines(streams.stream_guard_events(spark, path)).drop("day")
    got = tail(spark, streams.stream_traffic_stats(live), tmp_path, "stats", ["kind", "name"], "complete")
    kinds = {(r.kind, r.name): r.n for r in got.collect()}
    stats = reports.traffic_stats(events).first()
    assert kinds["event", "blocked"] == stats.blocked and kinds["event", "allowed"] == stats.allowed
    live = logs.good_lines(streams.stream_guard_events(spark, path)).drop("day")
    streams.stream_event_sink(live, str(tmp_path / "sink"), str(tmp_path / "sink-check")).awaitTermination()
    assert logs.good_lines(logs.read_guard_events(spark, str(tmp_path / "sink"))).count() == events.count()
    # A second run finds nothing new.
    live = logs.good_lines(streams.stream_guard_events(spark, path)).drop("day")
    streams.stream_event_sink(live, str(tmp_path / "sink"), str(tmp_path / "sink-check")).awaitTermination()
    assert logs.good_lines(logs.read_guard_events(spark, str(tmp_path / "sink"))).count() == events.count()


def test_parts_of_a_large_table_are_several_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([request(n, "hello", minutes=n, tokens=30) for n in range(1, 121)], REQUEST_SCHEMA)
    assert queries._write_parts(rows, str(tmp_path / "one")) == 1
    monkeypatch.setattr(queries, "REQUESTS_PER_FILE", 20)
    files = queries._write_parts(rows, str(tmp_path / "in"))
    assert files == 2
    got = spark.read.parquet(str(tmp_path / "in")).selectExpr("request_id", "pmod(xxhash64(request_id), 3) part", "_metadata.file_name file").collect()
    assert sorted(r.request_id for r in got) == sorted(r.request_id for r in rows.select("request_id").collect())
    held = {(r.file, r.part) for r in got}
    assert len(held) == len({f for f, _ in held}) == 3 * files
