"""Policies, guards and verdict helpers."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalogue import DEFAULT_DETECTORS, SECRET, Detector
from ..functions.detection import detect_jailbreak, detect_pii, redact
from ..functions.text import col, let
from ..schemas import FINDINGS, MESSAGES, POLICY, POLICY_DEFAULTS, POLICY_GROUPS, POLICY_SCHEMA, VIOLATIONS
from ..storage import broadcast_if_small

DEFAULT_AGENT = "default"

# Provider -> model used when neither request nor policy names one.
PROVIDER_MODELS = {
    "openai": "gpt-4o-mini",
    "gemini": "gemini-2.0-flash",
    "anthropic": "claude-3-5-haiku-latest",
}

# Policy action -> what a finding's action is called.
ACTION_NAMES = {"block": "blocked", "flag": "flagged", "redact": "redacted"}


def policies_frame(spark: SparkSession, policies: Sequence[Mapping]) -> DataFrame:
    """Policy rows from nested dictionaries; whatever is left out stays null."""
    lines = [(json.dumps(p, default=str),) for p in policies]
    raw = spark.createDataFrame(lines, "line string")
    return raw.select(F.from_json("line", POLICY_SCHEMA).alias("p")).select("p.*")


def _with_group_defaults(group: str) -> Column:
    default = F.from_json(F.lit(json.dumps(POLICY_DEFAULTS[group])), POLICY_GROUPS[group])
    return F.struct(
        *[F.coalesce(F.col(group)[name], default[name]).alias(name) for name in POLICY_DEFAULTS[group]]
    ).alias(group)


def normalize_policies(policies: DataFrame) -> DataFrame:
    """``agent_id, policy`` with built-in defaults filled in."""
    return policies.select("agent_id", F.struct(*[_with_group_defaults(g) for g in POLICY_GROUPS]).cast(POLICY).alias("policy"))


def builtin_policy() -> Column:
    return F.from_json(F.lit(json.dumps(POLICY_DEFAULTS)), POLICY)


def agent_policy(df: DataFrame, policies: DataFrame | None = None, agent: str = "agent_id") -> DataFrame:
    """Add each row's ``policy``: its agent's, else the ``default`` row, else built-in (G1)."""
    if policies is None:
        return df.withColumn("policy", builtin_policy())
    ready = normalize_policies(policies)
    row = ready.where(F.col("agent_id") == DEFAULT_AGENT).select(F.to_json("policy", {"ignoreNullFields": "false"})).take(1)
    fallback = F.from_json(F.lit(row[0][0]), POLICY) if row else builtin_policy()
    # One row per agent, always the same one, so that a request is never doubled.
    whole = F.to_json("policy", {"ignoreNullFields": "false"})
    side = ready.select(F.col("agent_id").alias("_agent"), whole.alias("_json")).groupBy("_agent").agg(F.min("_json").alias("_json"))
    side = broadcast_if_small(side.select("_agent", F.from_json("_json", POLICY).alias("policy")))
    joined = df.join(side, F.col(agent) == F.col("_agent"), "left").drop("_agent")
    return joined.withColumn("policy", F.coalesce("policy", fallback))


def resolve_model(df: DataFrame) -> DataFrame:
    """Fill ``provider`` and ``model`` from request, policy, then provider default."""
    asked = F.when(F.col("provider") != "", F.lower("provider"))
    provider = F.coalesce(asked, F.col("policy.llm.provider"), F.lit("openai"))
    defaults = F
    for name, model in PROVIDER_MODELS.items():
        defaults = defaults.when(provider == name, F.lit(model))
    wanted = F.when(F.col("model") != "", F.col("model"))
    chosen = F.when(F.col("policy.llm.default_model") != "", F.col("policy.llm.default_model"))
    return df.withColumns({"provider": provider, "model": F.coalesce(wanted, chosen, defaults)})


def violation(type_: Column, severity: Column, detail: Column, action: Column, metadata: Mapping[str, Column]) -> Column:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        type_.alias("type"),
        severity.alias("severity"),
        detail.alias("detail"),
        action.alias("action"),
        F.create_map(*pairs).alias("metadata"),
    )


def no_violations() -> Column:
    return F.array().cast(VIOLATIONS)


def input_guard(text: Column | str, policy: Column, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> Column:
    """Scan a request text under its policy.

    Struct of ``allowed``, ``violations``, ``findings`` and ``processed_text``
    (the redacted text when the policy redacts and nothing blocks).
    """
    text = col(text)
    found = detect_pii(text, policy["input_guard"]["detect_entities"], detectors)
    return judged(detect_jailbreak(text), found, policy, lambda findings: redact(text, findings))


def judged(
    jailbreak: Column, findings: Column, policy: Column, redacted: Callable[[Column], Column] | None = None
) -> Column:
    """The verdict on what was found in an input: the struct of ``input_guard``.

    Without ``redacted``, which makes the processed text of the findings, that text is null.
    """
    config = policy["input_guard"]
    action = F
    for name, called in ACTION_NAMES.items():
        action = action.when(config["scanner_action"] == name, F.lit(called))
    action = action.otherwise(F.lit("blocked"))

    def from_jailbreak(j: Column) -> Column:
        return F.when(
            j["flag"],
            F.array(
                violation(
                    F.lit("jailbreak"),
                    F.lit("critical"),
                    F.concat(F.lit("Jailbreak pattern detected ("), j["category"], F.lit(")")),
                    F.lit("blocked"),
                    {"category": j["category"], "pattern": j["pattern"]},
                )
            ).cast(VIOLATIONS),
        ).otherwise(no_violations())

    def from_finding(f: Column) -> Column:
        secret = f["entity"] == SECRET
        severity = (
            F.when(secret & (f["confidence"] < 0.9), F.lit("medium"))
            .when(secret, F.lit("critical"))
            .otherwise(F.lit("high"))
        )
        return violation(
            F.when(secret, F.lit("secret")).otherwise(F.lit("pii")),
            severity,
            F.concat(F.lit("Detected "), f["entity"], F.lit(" in input")),
            action,
            {"pii_type": f["entity"], "confidence": f["confidence"]},
        )

    hit = F.when(config["jailbreak_detection"], let(jailbreak, from_jailbreak)).otherwise(no_violations())
    found = F.when(config["scanner_enabled"], findings).otherwise(F.array().cast(FINDINGS))

    def judge(ctx: Column) -> Column:
        processed = F.lit(None).cast("string") if redacted is None else redacted(ctx["findings"])
        return let(
            F.concat(ctx["jb"], F.transform(ctx["findings"], from_finding).cast(VIOLATIONS)),
            lambda v: let(
                F.exists(v, lambda x: x["action"] == "blocked"),
                lambda blocked: F.struct(
                    (~blocked).alias("allowed"),
                    v.alias("violations"),
                    ctx["findings"].alias("findings"),
                    F.when((config["scanner_action"] == "redact") & (F.size(v) > 0) & ~blocked, processed).alias("processed_text"),
                ),
            ),
        )

    return let(F.struct(hit.alias("jb"), found.alias("findings")), judge)


def output_guard(answer: Column | str, policy: Column, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> Column:
    """Violations of an answer: everything is flagged, nothing blocks."""

    def from_finding(f: Column) -> Column:
        secret = f["entity"] == SECRET
        return violation(
            F.when(secret, F.lit("secret")).otherwise(F.lit("output_pii")),
            F.when(secret, F.lit("critical")).otherwise(F.lit("high")),
            F.concat(F.lit("Detected "), f["entity"], F.lit(" in model output")),
            F.lit("flagged"),
            {"pii_type": f["entity"]},
        )

    found = F.transform(detect_pii(col(answer), None, detectors), from_finding).cast(VIOLATIONS)
    return F.when(policy["output_guard"]["scanner_enabled"], found).otherwise(no_violations())


def token_limit_violations(tokens: Column, policy: Column) -> Column:
    """At most one blocking violation."""
    limit = policy["cost"]["max_input_tokens"]
    one = violation(
        F.lit("token_limit"),
        F.lit("high"),
        F.concat(F.lit("Input tokens ("), tokens.cast("string"), F.lit(") exceed limit ("), limit.cast("string"), F.lit(")")),
        F.lit("blocked"),
        {"input_tokens": tokens, "limit": limit},
    )
    return F.when(tokens > limit, F.array(one).cast(VIOLATIONS)).otherwise(no_violations())


def budget_violations(over: Column, spend: Column, budget: Column) -> Column:
    one = violation(
        F.lit("budget_exceeded"),
        F.lit("critical"),
        F.format_string(
            "Daily budget of $%.2f exceeded. Current spend: $%.2f.", budget.cast("double"), spend.cast("double")
        ),
        F.lit("blocked"),
        {"current_spend": spend, "budget": budget},
    )
    return F.when(over, F.array(one).cast(VIOLATIONS)).otherwise(no_violations())


def apply_redaction(
    messages: Column | str,
    policy: Column,
    processed_text: Column | None = None,
    scope: str = "message",
    detectors: Sequence[Detector] = DEFAULT_DETECTORS,
) -> Column:
    """Messages as they would be sent.

    ``message`` redacts every message.  ``compat`` puts the redacted text of
    all messages into the last user message and leaves the others alone.
    """
    messages = col(messages)
    if scope == "message":
        entities = policy["input_guard"]["detect_entities"]
        return F.transform(
            messages,
            lambda m: F.struct(
                m["role"].alias("role"),
                redact(m["content"], detect_pii(m["content"], entities, detectors)).alias("content"),
            ),
        ).cast(MESSAGES)
    if scope != "compat":
        raise ValueError(f"unknown redaction scope {scope!r}")
    users = F.transform(messages, lambda m: m["role"] == "user")
    last = F.array_max(F.filter(F.transform(users, lambda u, i: F.when(u, i)), lambda i: i.isNotNull()))
    return let(
        last,
        lambda n: F.transform(
            messages,
            lambda m, i: F.struct(
                m["role"].alias("role"), F.when(i == n, processed_text).otherwise(m["content"]).alias("content")
            ),
        ).cast(MESSAGES),
    )


def block_reason(blocked: Column, violations: Column) -> Column:
    """Type of the first violation of a blocked row."""
    return F.when(blocked, F.get(violations, F.lit(0))["type"])


def block_summary(violations: Column) -> Column:
    """Sorted distinct types, and the first three details."""
    return F.struct(
        F.array_join(F.array_sort(F.array_distinct(F.transform(violations, lambda v: v["type"]))), ", ").alias("types"),
        F.array_join(F.slice(F.transform(violations, lambda v: v["detail"]), 1, 3), "; ").alias("details"),
    )
