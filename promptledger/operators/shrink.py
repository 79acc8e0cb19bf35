"""Shrinking chat requests (O1-O9), applied in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import estimate_cost
from ..functions.text import col, is_blank
from ..functions.tokens import Tokenizer, count_message_tokens
from ..schemas import MESSAGES, MONEY
from ..storage import compute_once, materialize
from .token_counts import with_message_tokens

BREVITY_PROMPT = (
    "Answer briefly and precisely. Give the code or facts asked for with short reasons, "
    "no greetings, no filler, no closing summary."
)

# Action names, and the sizes beyond which advice is given.
ACTIONS = (
    "remove_empty_messages", "deduplicate_system_prompts", "whitespace_normalization",
    "history_trim", "terse_mode_enabled",
)
LARGE_INPUT_TOKENS = 4000
LONG_CONVERSATION = 10


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def with_defaults(messages: Column | str) -> Column:
    return F.transform(
        col(messages),
        lambda m: _message(F.coalesce(m["role"], F.lit("user")), F.coalesce(m["content"], F.lit(""))),
    ).cast(MESSAGES)


def _is_system(m: Column) -> Column:
    return m["role"] == "system"


def remove_empty_messages(messages: Column | str) -> Column:
    return F.filter(col(messages), lambda m: ~is_blank(m["content"]))


def merge_system_prompts(messages: Column | str) -> Column:
    messages = col(messages)
    systems = F.filter(messages, _is_system)
    joined = F.array_join(F.transform(systems, lambda m: m["content"]), "\n\n")
    merged = F.concat(
        F.array(_message(F.lit("system"), joined)).cast(MESSAGES), F.filter(messages, lambda m: ~_is_system(m))
    )
    return F.when(F.size(systems) > 1, merged).otherwise(messages)


def _tidy(c: Column) -> Column:
    # Both replacements are skipped unless their match can exist.
    fewer = F.when(c.contains("\n\n\n"), F.regexp_replace(c, r"\n{3,}", "\n\n")).otherwise(c)
    loose = c.contains(" \n") | c.contains("\t\n") | c.endswith(" ") | c.endswith("\t")
    # d: only \n ends a line, as in Python
    return F.when(loose, F.regexp_replace(fewer, r"(?md)[ \t]+$", "")).otherwise(fewer)


def normalize_whitespace(messages: Column | str) -> Column:
    return F.transform(col(messages), lambda m: _message(m["role"], _tidy(m["content"]))).cast(MESSAGES)


def trim_history(messages: Column | str, limit: Column | int) -> Column:
    messages = col(messages)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    others = F.filter(messages, lambda m: ~_is_system(m))
    applies = limit.isNotNull() & (limit > 0) & (F.size(others) > limit)
    kept = F.concat(F.filter(messages, _is_system), F.slice(others, -limit, limit))
    return F.when(applies, kept).otherwise(messages)


def inject_brevity_prompt(messages: Column | str, text: str = BREVITY_PROMPT) -> Column:
    messages = col(messages)
    position = F.array_position(F.transform(messages, _is_system), F.lit(True)) - 1
    appended = F.transform(
        messages,
        lambda m, i: _message(
            m["role"],
            F.when(i == position, F.concat(m["content"], F.lit("\n\n" + text))).otherwise(m["content"]),
        ),
    ).cast(MESSAGES)
    fresh = F.concat(F.array(_message(F.lit("system"), F.lit(text))).cast(MESSAGES), messages)
    return F.when(F.exists(messages, _is_system), appended).otherwise(fresh)


def request_guidance(original_tokens: Column, message_count: Column, history_limit: Column) -> Column:
    """Advice about large inputs and long conversations."""
    large = F.when(
        original_tokens > LARGE_INPUT_TOKENS,
        F.concat(
            F.lit("Input is large ("), original_tokens.cast("string"),
            F.lit(" tokens). Convert raw documents to Markdown first; that can save up to 70% of the tokens."),
        ),
    )
    long = F.when(
        (F.coalesce(history_limit, F.lit(0)) == 0) & (message_count > LONG_CONVERSATION),
        F.lit("Conversation is getting long. Set max_history_messages in the policy to trim older turns."),
    )
    return F.filter(F.array(large, long), lambda a: a.isNotNull())


def shrink_requests(
    df: DataFrame, brevity_prompt: str = BREVITY_PROMPT, tokenizer: Tokenizer | None = None, key: str = "request_id"
) -> DataFrame:
    """Shrink ``messages`` under each row's ``policy``.

    Needs the ``policy`` and ``price`` columns; adds ``original_tokens``,
    ``input_tokens``, ``saved_tokens``, ``savings_pct``, ``cost_saved``,
    ``actions`` and ``guidance`` and replaces ``messages``.  Each step is its
    own projection, so none is evaluated twice; there is no shuffle.
    """
    o = F.col("policy.optimizer")
    non_empty = F.coalesce(F.size("messages"), F.lit(0)) > 0
    active = o["enabled"] & non_empty
    if tokenizer is None:
        counted = compute_once(df, "original_tokens", count_message_tokens("messages"))
    else:
        counted = with_message_tokens(materialize(df, "requests"), "original_tokens", tokenizer, key)
    step = (
        counted.withColumn("_active", active)
        .withColumn("_m0", F.when(F.col("_active"), with_defaults("messages")).otherwise(F.col("messages")))
    )

    def apply(frame: DataFrame, n: int, switch: Column, changed: Column) -> DataFrame:
        before = F.col(f"_m{n - 1}")
        return frame.withColumn(f"_m{n}", F.when(F.col("_active") & switch, changed).otherwise(before))

    step = apply(step, 1, o["remove_empty_messages"], remove_empty_messages("_m0"))
    step = apply(step, 2, o["deduplicate_system_prompts"], merge_system_prompts("_m1"))
    step = apply(step, 3, o["whitespace_normalization"], normalize_whitespace("_m2"))
    limit = o["max_history_messages"]
    step = apply(step, 4, F.lit(True), trim_history("_m3", limit))
    step = apply(step, 5, o["terse_mode"], inject_brevity_prompt("_m4", brevity_prompt))

    systems = F.size(F.filter("_m1", _is_system))
    others = F.size(F.filter("_m3", lambda m: ~_is_system(m)))
    fired = (
        F.size("_m1") < F.size("_m0"),
        o["deduplicate_system_prompts"] & (systems > 1),
        F.col("_m3") != F.col("_m2"),
        F.coalesce((limit > 0) & (others > limit), F.lit(False)),
        o["terse_mode"],
    )
    named = F.array(*[F.when(F.col("_active") & f, F.lit(a)) for a, f in zip(ACTIONS, fired)])
    unchanged = F.col("_m5").eqNullSafe(F.col("messages"))
    if tokenizer is None:
        step = step.withColumn(
            "input_tokens",
            F.when(unchanged, F.col("original_tokens")).otherwise(count_message_tokens("_m5")),
        )
    else:
        step = with_message_tokens(materialize(step, "shrunk"), "input_tokens", tokenizer, key, "_m5")
    saved = F.col("original_tokens") - F.col("input_tokens")
    ratio = saved.cast("decimal(18,0)") / F.col("original_tokens").cast("decimal(18,0)")
    step = (
        step.withColumn("actions", F.filter(named, lambda a: a.isNotNull()))
        .withColumn("saved_tokens", saved)
        .withColumn(
            "savings_pct",
            F.when(F.col("original_tokens") > 0, F.round(ratio, 6).cast("double")).otherwise(F.lit(0.0)),
        )
        .withColumn(
            "cost_saved",
            F.when(saved > 0, estimate_cost(saved, F.lit(0), F.col("price"))).otherwise(F.lit(0).cast(MONEY)),
        )
        .withColumn(
            "guidance",
            F.when(
                F.col("_active"), request_guidance(F.col("original_tokens"), F.size("messages"), limit)
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    return step.withColumn("messages", F.col("_m5")).drop("_active", *[f"_m{n}" for n in range(6)])


def savings_report(df: DataFrame) -> DataFrame:
    """Totals of shrunk requests per agent and action; ``all`` counts each request once."""
    tagged = df.select(
        "agent_id", "original_tokens", "input_tokens", "cost_saved",
        F.explode(F.concat(F.array(F.lit("all")), "actions")).alias("action"),
    )
    return tagged.groupBy("agent_id", "action").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum(F.col("original_tokens") - F.col("input_tokens")).alias("saved_tokens"),
        F.sum("cost_saved").cast(MONEY).alias("cost_saved"),
    )
