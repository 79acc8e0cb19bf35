"""Usage and traffic reports (A1-A13).  All of them are partial-then-final aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MONEY


def _money(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def _on_day(df: DataFrame, day: str | dt.date, ts: str) -> DataFrame:
    """Rows of one UTC day.

    A range on the raw timestamp reaches a columnar scan; a log partitioned by
    ``day`` is pruned to that partition as well.
    """
    start = F.lit(str(day)).cast("timestamp")
    stamp = F.col(ts).cast("timestamp") if df.schema[ts].dataType.simpleString() == "string" else F.col(ts)
    rows = df.where((stamp >= start) & (stamp < start + F.expr("INTERVAL 1 DAY")))
    return rows.where(F.col("day") == F.lit(str(day)).cast("date")) if "day" in df.columns else rows


def daily_usage(df: DataFrame, ts: str = "ts", cost: str = "cost_usd") -> DataFrame:
    """Checks and spend per UTC day; blocked requests are checks without spend (A1)."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("checks"),
        _money(F.when(F.col(cost) > 0, F.col(cost))).alias("spend"),
    )


def daily_spend(df: DataFrame, day: str | dt.date, ts: str = "ts", cost: str = "cost_usd") -> DataFrame:
    """Spend of one day as a single row, 0 when there is none (A2)."""
    return _on_day(df, day, ts).where(F.col(cost) > 0).agg(_money(cost).alias("spend"))


def today_utc() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


def usage_by_tool(
    df: DataFrame, day: str | dt.date | None = None, today: bool = False, ts: str = "timestamp"
) -> DataFrame:
    """Requests, cost, tokens and blocked per tool, for one day or all time (A3, A5)."""
    if today:
        day = today_utc()
    if day is not None:
        df = _on_day(df, day, ts)
    return df.groupBy(F.coalesce("tool", F.lit("Unknown")).alias("tool")).agg(
        F.count(F.lit(1)).alias("requests"),
        _money("cost_usd").alias("cost"),
        F.coalesce(F.sum("tokens"), F.lit(0).cast("long")).alias("tokens"),
        F.count_if(F.coalesce("blocked", F.lit(False))).alias("blocked"),
    )


def block_reasons(df: DataFrame) -> DataFrame:
    """Blocked requests per tool and reason; no reason is ``Unknown`` (A4)."""
    reason = F.coalesce(F.nullif("block_reason", F.lit("")), F.lit("Unknown"))
    return (
        df.where("blocked")
        .groupBy(F.coalesce("tool", F.lit("Unknown")).alias("tool"), reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def block_reasons_map(df: DataFrame) -> DataFrame:
    """The same with one map per tool; reasons are few violation type names."""
    pairs = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return block_reasons(df).groupBy("tool").agg(F.map_from_entries(pairs).alias("reasons"))


def traffic_stats(events: DataFrame) -> DataFrame:
    """Totals over a guard-event log as one row."""
    meta = F.col("metadata")
    total = F.count(F.lit(1))
    blocked = F.count_if(F.col("event") == "blocked")
    rate = F.round(blocked.cast("decimal(18,0)") * 100 / total.cast("decimal(18,0)"), 1)
    cost = F.sum(meta["estimated_cost_usd"].cast(MONEY))
    zero = F.lit(0).cast("long")
    return events.agg(
        total.alias("total_requests"),
        blocked.alias("blocked"),
        F.count_if(F.col("event") == "allowed").alias("allowed"),
        F.coalesce(rate.cast("double"), F.lit(0.0)).alias("block_rate_pct"),
        F.coalesce(cost, F.lit(0)).cast(MONEY).alias("total_cost_usd"),
        F.coalesce(F.sum(meta["input_tokens"]), zero).alias("total_input_tokens"),
        F.coalesce(F.sum(meta["output_tokens"]), zero).alias("total_output_tokens"),
    )


def violations_by_type(events: DataFrame) -> DataFrame:
    """Violations per type, most common first."""
    kinds = events.select(F.explode("violations").alias("v")).select(F.coalesce("v.type", F.lit("unknown")).alias("type"))
    return kinds.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def violation_share(events: DataFrame) -> DataFrame:
    """Each type's count as a percentage of the largest."""
    counts = violations_by_type(events)
    # One row per violation type, so the unpartitioned window is small.
    largest = F.max("n").over(Window.partitionBy())
    share = F.floor((F.col("n") * 200 + largest) / (largest * 2)).cast("long")
    return counts.select("type", "n", share.alias("pct"))


def recent_events(events: DataFrame, n: int = 50, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Newest ``n`` events (A8): a top-n per task, then one merge."""
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return events.orderBy(*order).limit(n)


def tail_events(
    events: DataFrame, n: int = 50, day: str | dt.date | None = None, ts: str = "timestamp", tie: str | None = None
) -> DataFrame:
    """Last ``n`` events of a UTC day (default today) in order."""
    rows = _on_day(events, day or today_utc(), ts)
    return recent_events(rows, n, ts, tie).orderBy(ts, *([tie] if tie else []))


def token_totals(events: DataFrame) -> DataFrame:
    """Token and cost totals of the whole log (A10)."""
    meta = F.col("metadata")
    zero = F.lit(0).cast("long")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    return events.agg(
        total(F.coalesce(meta["original_input_tokens"], meta["input_tokens"])).alias("original_input_tokens"),
        total(meta["input_tokens"]).alias("input_tokens"),
        total(meta["saved_tokens"]).alias("saved_tokens"),
        total(meta["output_tokens"]).alias("output_tokens"),
        F.coalesce(F.sum(meta["estimated_cost_usd"].cast(MONEY)), F.lit(0)).cast(MONEY).alias("cost"),
    )


def session_spend(df: DataFrame, cost: str = "cost_usd") -> DataFrame:
    """Spend per session over admitted requests."""
    rows = df.where(~F.col("blocked") & F.col("session_id").isNotNull() & (F.col("session_id") != ""))
    return rows.groupBy("session_id").agg(_money(cost).alias("spend"))


def cost_report(df: DataFrame, agent: str, compat: bool = False, cost: str = "cost_usd") -> DataFrame:
    """Sessions and total of one agent as a single row.

    ``compat`` counts every agent's sessions.  Spend per session is
    ``session_spend`` over the same rows, which stays a table: a map of all
    sessions in one row would not scale.
    """
    rows = df if compat else df.where(F.col("agent_id") == agent)
    return session_spend(rows, cost).agg(
        F.count(F.lit(1)).alias("sessions"), _money("spend").alias("total_cost")
    ).select(F.lit(agent).alias("agent_id"), "sessions", "total_cost")
