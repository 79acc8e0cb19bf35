"""Controls that policies declare (X1-X11); X3 is ``budget.auto_downgrade``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS, col, fold_case
from ..storage import broadcast_if_small, materialize
from .budget import budget_gate
from .ordered import cut_into_chunks, previous_value, running_max, running_sum


def session_limit_gate(df: DataFrame, row_id: str, ts: str, estimate: Column, cost: Column, limit: Column,
                       session: str = "session_id", **options) -> DataFrame:
    """The budget gate with one ledger per session (X1); rows without a session are not limited and admitted."""
    named = F.coalesce(F.col(session).cast("string") != "", F.lit(False))
    gated = budget_gate(df.where(named), session, row_id, ts, estimate, cost, limit, **options)
    free = df.where(~named).select(
        row_id, F.lit(0).cast("decimal(18,6)").alias("spend_before"), F.lit(False).alias("over_budget")
    )
    return gated.unionByName(free)


def monthly_budget_gate(df: DataFrame, row_id: str, ts: str, estimate: Column, cost: Column, budget: Column,
                        **options) -> DataFrame:
    """The budget gate with one ledger per UTC month."""
    month = F.trunc(F.to_date(ts), "month")
    return budget_gate(df, month, row_id, ts, estimate, cost, budget, **options)


def word_set(text: Column) -> Column:
    words = F.split(F.translate(fold_case(text), WS_CHARS, " " * len(WS_CHARS)), " ")
    return F.array_distinct(F.array_remove(words, ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def detect_loops(
    df: DataFrame,
    session: str = "session_id",
    order: str = "turn",
    text: str = "text",
    max_retries: int = 3,
    threshold: float = 0.90,
    chunks: int | None = None,
) -> DataFrame:
    """Consecutive near-identical prompts within a session.

    ``repeats`` counts how many prompts in a row, up to this one, were at least
    ``threshold`` similar (word sets) to the prompt before; ``looping`` when
    that exceeds ``max_retries``.  ``order`` must be unique within a session.
    """
    keys, by = [session], [order]
    words = df.select(session, order, word_set(F.col(text)).alias("_words"))
    rows = cut_into_chunks(words, keys, by, chunks)
    paired = previous_value(rows, keys, by, F.col("_words"), "_prev")
    similar = F.coalesce(jaccard(F.col("_words"), F.col("_prev")) >= threshold, F.lit(False))
    slim = materialize(paired.select(session, order, "_chunk", similar.alias("_similar")), "similar")
    numbered = running_sum(slim, keys, by, F.lit(1), "_n", inclusive=True)
    broken = running_max(numbered, keys, by, F.when(~F.col("_similar"), F.col("_n")), "_break")
    repeats = (F.col("_n") - F.col("_break")).cast("long")
    return broken.select(session, order, repeats.alias("repeats"), (repeats > max_retries).alias("looping"))


def tool_access(df: DataFrame, policies: DataFrame, agent: str = "agent_id", tool: str = "tool") -> DataFrame:
    """May the agent call the tool? (X5) Deny wins; a non-empty allow list is exclusive.

    ``policies`` rows: ``agent_id, tool, allowed, denied``.
    """
    per_tool = policies.groupBy(F.col("agent_id").alias("_agent"), F.col("tool").alias("_tool")).agg(
        F.bool_or(F.coalesce("denied", F.lit(False))).alias("_denied"),
        F.bool_or(F.coalesce("allowed", F.lit(False))).alias("_allowed"),
    )
    exclusive = per_tool.where("_allowed").select(F.col("_agent").alias("_listed")).distinct()
    joined = df.join(
        broadcast_if_small(per_tool), (F.col(agent) == F.col("_agent")) & (F.col(tool) == F.col("_tool")), "left"
    ).join(broadcast_if_small(exclusive), F.col(agent) == F.col("_listed"), "left")
    denied = F.coalesce("_denied", F.lit(False))
    allowed = F.col("_listed").isNull() | F.coalesce("_allowed", F.lit(False))
    return joined.withColumn("permitted", ~denied & allowed).drop("_agent", "_tool", "_denied", "_allowed", "_listed")


def rate_limit(
    df: DataFrame,
    limits: DataFrame,
    session: str = "session_id",
    tool: str = "tool",
    ts: str = "ts",
    row_id: str = "event_id",
    agent: str | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Number each call within its session, minute or hour, and check the wait since the last.

    ``limits`` rows: ``tool, max_calls, per, cooldown_seconds`` and, when
    ``agent`` names the calls' agent column, ``agent_id``.  A tool may have
    several limits.  Returns ``row_id, per, max_calls, call_number, over_limit,
    cooling_down``, one row per call and limit.
    """
    who = ["_agent", "_tool"] if agent else ["_tool"]
    rule = ["max_calls", "per", "cooldown_seconds"]
    source = {"_agent": "agent_id", "_tool": "tool"}
    side = limits.select(*(F.col(source[w]).alias(w) for w in who), *rule).distinct()
    calls = df.select(
        *([F.col(agent).alias("_agent")] if agent else []), F.col(tool).alias("_tool"), F.col(session).alias("_session"),
        F.col(ts).cast("timestamp").alias("_ts"), F.col(row_id).alias("_id"),
    )
    calls = calls.join(broadcast_if_small(side.select(*who).distinct()), who, "left_semi")
    # The wait does not depend on a limit, so it is taken before calls meet limits.
    own = [*who, "_session"]
    waited = previous_value(cut_into_chunks(calls, own, ["_ts", "_id"], chunks), own, ["_ts", "_id"], F.col("_ts"), "_last")
    bucket = (
        F.when(F.col("per") == "minute", F.date_trunc("minute", "_ts"))
        .when(F.col("per") == "hour", F.date_trunc("hour", "_ts"))
        .otherwise(F.lit(0).cast("timestamp"))
    )
    limited = waited.join(broadcast_if_small(side), who).withColumn("_bucket", bucket)
    counted = running_sum(limited, [*own, *rule, "_bucket"], ["_ts", "_id"], F.lit(1), "call_number", inclusive=True)
    gap = F.unix_micros("_ts") - F.unix_micros("_last")
    return counted.select(
        F.col("_id").alias(row_id),
        "per",
        "max_calls",
        F.col("call_number").cast("long").alias("call_number"),
        (F.col("call_number") > F.col("max_calls")).alias("over_limit"),
        F.coalesce(gap < F.col("cooldown_seconds").cast("long") * 1000000, F.lit(False)).alias("cooling_down"),
    )


def validate_args(
    df: DataFrame, rules: DataFrame, tool: str = "tool", args: str = "args_json", row_id: str = "event_id", agent: str | None = None
) -> DataFrame:
    """Arguments that break a rule (X7): ``row_id, arg, problem``.

    ``rules`` rows: ``tool, arg, type (string|int|enum), pattern, values`` and,
    when ``agent`` names the calls' agent column, ``agent_id``.  An argument
    that is absent is not checked.
    """
    own = [F.col("agent_id").alias("_agent")] if agent else []
    side = broadcast_if_small(rules.select(*own, F.col("tool").alias("_tool"), F.col("arg").alias("_arg"), "type", "pattern", "values"))
    given = df.select(
        F.col(row_id).alias("_id"), *([F.col(agent).alias("_agent")] if agent else []), F.col(tool).alias("_tool"),
        F.explode(F.from_json(args, "map<string,string>")).alias("_arg", "_value"),
    )
    joined = given.join(side, ["_agent", "_tool", "_arg"] if agent else ["_tool", "_arg"])
    value = F.col("_value")
    problem = (
        F.when((F.col("type") == "int") & ~value.rlike(r"^[+-]?[0-9]+$"), F.lit("not an integer"))
        .when((F.col("type") == "enum") & ~F.array_contains(F.coalesce("values", F.array().cast("array<string>")), value), F.lit("not an allowed value"))
        .when(F.col("pattern").isNotNull() & ~F.expr("_value rlike concat('^(?:', pattern, ')')"), F.lit("pattern mismatch"))
    )
    return joined.select(F.col("_id").alias(row_id), F.col("_arg").alias("arg"), problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )


def competitor_mentions(text: Column | str, terms: Column | Sequence[str]) -> Column:
    """Listed terms that occur in a text, ignoring case."""
    folded = fold_case(col(text))
    listed = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    found = F.filter(listed, lambda t: F.contains(folded, fold_case(t)))
    return F.coalesce(found, F.array().cast("array<string>"))


def filter_log_level(events: DataFrame, level: str = "ALL") -> DataFrame:
    """Keep all events, those with violations, or those with a severe one."""
    if level == "ALL":
        return events
    if level == "VIOLATIONS_ONLY":
        return events.where(F.size("violations") > 0)
    if level == "HIGH_SEVERITY":
        return events.where(F.exists("violations", lambda v: v["severity"].isin("high", "critical")))
    raise ValueError(f"unknown log level {level!r}")


def within_retention(df: DataFrame, retention_days: int = 30, today: dt.date | None = None, day: str = "day") -> DataFrame:
    """Rows of the newest ``retention_days`` days; on a day-partitioned table this prunes files."""
    today = today or dt.datetime.now(dt.timezone.utc).date()
    oldest = today - dt.timedelta(days=retention_days)
    return df.where(F.col(day) > F.lit(str(oldest)).cast("date"))


def apply_retention(spark: SparkSession, path: str, retention_days: int = 30, today: dt.date | None = None) -> list[str]:
    """Delete the expired ``day=`` folders of a log and nothing else (X10); returns their days."""
    today = today or dt.datetime.now(dt.timezone.utc).date()
    oldest = today - dt.timedelta(days=retention_days)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("day="):
            try:
                day = dt.date.fromisoformat(name.removeprefix("day="))
            except ValueError:
                continue  # not a day of ours, e.g. the folder of rows without one
            if day <= oldest:
                files.delete(status.getPath(), True)
                gone.append(str(day))
    return sorted(gone)


def warn_token_pct(tokens: Column | str, policy: Column) -> Column:
    """True when tokens reach the policy's share of its input limit (X11)."""
    limit = policy["cost"]["max_input_tokens"]
    share = F.round(policy["optimizer"]["warn_at_token_pct"].cast("decimal(10,6)"), 6)
    return F.coalesce(col(tokens).cast("decimal(18,0)") >= limit * share, F.lit(False))
