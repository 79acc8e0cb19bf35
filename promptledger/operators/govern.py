"""The whole verdict over a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import DEFAULT_DETECTORS, Detector
from ..functions.prices import Price, estimate_cost, resolve_price
from ..functions.tokens import Tokenizer, count_tokens, messages_to_text
from ..functions.tools import identify_tool
from ..schemas import EVENT_METADATA, MONEY, VIOLATIONS
from ..storage import materialize
from .budget import FOLD_ROWS, budget_gate
from .guards import (
    agent_policy,
    apply_redaction,
    block_reason,
    budget_violations,
    input_guard,
    output_guard,
    resolve_model,
    token_limit_violations,
)
from .shrink import shrink_requests
from .turn_guard import can_compose, guard_requests

BLOCK_MESSAGE = "This request was blocked by policy."


def score_requests(
    df: DataFrame,
    policies: DataFrame | None = None,
    prices: DataFrame | Sequence[Price] | None = None,
    detectors: Sequence[Detector] = DEFAULT_DETECTORS,
    rule: str = "longest_prefix",
    redaction: str = "message",
    carry: Sequence[str] = (),
    by_turn: bool = False,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Everything about a request that does not depend on other requests.

    One pass over the wide columns without a shuffle: policy, model, price,
    shrinking, token limit, input guard, output guard, cost.  A row over its
    token limit is not scanned.  The result is slim: message texts are dropped
    unless named in ``carry`` (``messages`` are those that would be sent,
    ``answer`` the recorded answer).  With ``by_turn`` the shrunk requests are
    stored and every different message is scanned once (``turn_guard``); that
    needs unique request ids, and does not redact messages.  ``tokenizer`` counts
    the tokens of messages and answers instead of the word estimate.
    """
    staged = resolve_model(agent_policy(df, policies))
    staged = shrink_requests(resolve_price(staged, prices, rule=rule), tokenizer=tokenizer)
    policy = F.col("policy")
    staged = staged.withColumn("limit_violations", token_limit_violations(F.col("input_tokens"), policy))
    over_limit = F.size("limit_violations") > 0
    if by_turn:
        staged = guard_requests(materialize(staged, "shrunk"), "request_id", detectors, ~over_limit)
    else:
        guard = input_guard("_text", policy, detectors)
        staged = staged.withColumn("_text", messages_to_text("messages")).withColumn("guard", F.when(~over_limit, guard))
    passed = ~over_limit & F.col("guard.allowed")
    out_tokens = F.coalesce("answer_tokens", count_tokens("answer", "model", tokenizer))
    none = F.array().cast(VIOLATIONS)
    staged = (
        staged.withColumn("passed", passed)
        .withColumn("output_violations", F.when(F.col("passed"), output_guard("answer", policy, detectors)).otherwise(none))
        .withColumn("output_tokens", F.when(F.col("passed"), out_tokens).otherwise(F.lit(0).cast("long")))
        .withColumn("billed_tokens", F.coalesce("answer_input_tokens", "input_tokens"))
        .withColumn("estimate", estimate_cost("input_tokens", F.lit(0), "price"))
    )
    full = estimate_cost("billed_tokens", "output_tokens", "price")
    staged = staged.withColumn("full_cost", F.when(F.col("passed"), full).otherwise(F.lit(0).cast(MONEY)))
    if "messages" in carry:
        redacted = apply_redaction("messages", policy, F.col("guard.processed_text"), redaction, detectors)
        sent = F.when(F.col("guard.processed_text").isNotNull(), redacted).otherwise(F.col("messages"))
        staged = staged.withColumn("messages", sent)
    keep = [
        "request_id", "ts", "agent_id", "session_id", "user_agent", "provider", "model",
        "original_tokens", "input_tokens", "billed_tokens", "saved_tokens", "savings_pct", "cost_saved", "actions",
        "guidance", "limit_violations", "output_violations", "output_tokens", "passed", "estimate", "full_cost",
    ]
    return staged.select(
        *keep,
        F.coalesce("guard.violations", none).alias("input_violations"),
        F.col("policy.cost.daily_budget").alias("daily_budget"),
        F.col("policy.optimizer.enabled").alias("optimized"),
        *carry,
    )


def govern_requests(
    df: DataFrame,
    policies: DataFrame | None = None,
    prices: DataFrame | Sequence[Price] | None = None,
    detectors: Sequence[Detector] = DEFAULT_DETECTORS,
    rule: str = "longest_prefix",
    redaction: str = "message",
    carry: Sequence[str] = (),
    opening: DataFrame | None = None,
    fold_rows: int = FOLD_ROWS,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Verdict, tokens and cost of every request.

    The scored table is written once; the daily ledger, one per UTC day across
    all agents, then works on five narrow columns of it.
    """
    by_turn = "messages" not in carry and can_compose(detectors)
    scored = materialize(score_requests(df, policies, prices, detectors, rule, redaction, carry, by_turn, tokenizer), "scored")
    decided = budget_gate(
        scored, F.to_date("ts"), "request_id", "ts",
        F.col("estimate"), F.col("full_cost"), F.col("daily_budget"), opening, fold_rows,
    )
    return verdicts(scored.join(decided, "request_id", "left"), carry)


def verdicts(joined: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Final columns from scored rows joined with the ledger's decision."""
    over = F.coalesce("over_budget", F.lit(False))
    limits = F.concat("limit_violations", budget_violations(over, F.col("spend_before"), F.col("daily_budget")))
    limited = F.size("_limits") > 0
    blocked = limited | ~F.col("passed")
    flagged = F.filter(F.concat("input_violations", "output_violations"), lambda v: v["action"] == "flagged")
    violations = F.when(limited, F.col("_limits")).when(F.col("blocked"), F.col("input_violations")).otherwise(flagged)
    zero = F.lit(0).cast("long")
    out = (
        joined.withColumn("_limits", limits)
        .withColumn("blocked", blocked)
        .withColumn("violations", violations.cast(VIOLATIONS))
        .withColumn("output_tokens", F.when(F.col("blocked"), zero).otherwise(F.col("output_tokens")))
        .withColumn("input_tokens", F.when(F.col("blocked"), F.col("input_tokens")).otherwise(F.col("billed_tokens")))
        .withColumn("cost_usd", F.when(F.col("blocked"), F.lit(0).cast(MONEY)).otherwise(F.col("full_cost")))
    )
    keep = [
        "request_id", "ts", "agent_id", "session_id", "user_agent", "provider", "model", "blocked", "violations",
        "original_tokens", "input_tokens", "saved_tokens", "savings_pct", "cost_saved", "actions", "guidance",
        "optimized", "output_tokens", "cost_usd", "spend_before",
    ]
    content = [F.when(F.col("blocked"), F.lit(BLOCK_MESSAGE)).otherwise(F.col("answer")).alias("content")] if "answer" in carry else []
    return out.select(*keep, *[c for c in carry if c != "answer"], *content)


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def governed_events(df: DataFrame) -> DataFrame:
    """Log lines of governed requests, advice included."""
    # Without an optimizer there is nothing to compare with.
    original = F.when(F.col("optimized"), F.col("original_tokens"))
    saved = F.when(F.col("optimized"), F.col("saved_tokens"))
    meta = F.struct(
        F.col("model"),
        F.col("input_tokens"),
        F.col("output_tokens"),
        F.col("cost_usd").cast("double").alias("estimated_cost_usd"),
        original.alias("original_input_tokens"),
        saved.alias("saved_tokens"),
        F.lit(None).cast("string").alias("message"),
    ).cast(EVENT_METADATA)
    verdict = F.struct(
        F.when(F.col("blocked"), F.lit("blocked")).otherwise(F.lit("allowed")).alias("event"),
        F.col("violations"),
        meta.alias("metadata"),
    )

    def advice(text: Column) -> Column:
        empty = F.struct(
            *[F.lit(None).cast("string" if n == "model" else "double" if n.endswith("usd") else "long").alias(n)
              for n in ("model", "input_tokens", "output_tokens", "estimated_cost_usd", "original_input_tokens", "saved_tokens")],
            text.alias("message"),
        ).cast(EVENT_METADATA)
        return F.struct(
            F.lit("optimizer_guidance").alias("event"), F.array().cast(VIOLATIONS).alias("violations"), empty.alias("metadata")
        )

    kind = f"array<struct<event:string,violations:{VIOLATIONS},metadata:{EVENT_METADATA}>>"
    entries = F.concat(F.transform("guidance", advice).cast(kind), F.array(verdict).cast(kind))
    return df.select("ts", "agent_id", "session_id", F.explode(entries).alias("e")).select(
        _iso(F.col("ts")).alias("timestamp"), "e.event", "agent_id", "session_id", "e.violations", "e.metadata"
    )


def history_records(df: DataFrame) -> DataFrame:
    """Usage records of governed requests, one each."""
    return df.select(
        _iso(F.col("ts")).alias("timestamp"),
        identify_tool("user_agent").alias("tool"),
        F.col("cost_usd").cast("double").alias("cost_usd"),
        (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        "blocked",
        block_reason(F.col("blocked"), F.col("violations")).alias("block_reason"),
    )
