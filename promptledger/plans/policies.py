"""Policy, tool and limit rows used by the registered queries and their oracles."""

from __future__ import annotations

POLICIES = (
    {
        "agent_id": "support",
        "input_guard": {"detect_entities": ["email", "secret", "ssn"], "scanner_action": "redact"},
        "cost": {"daily_budget": "0.150000"},
        "optimizer": {"max_history_messages": 3},
    },
    {
        "agent_id": "research",
        "llm": {"provider": "anthropic", "default_model": "claude-3-5-sonnet-latest"},
        "input_guard": {"detect_entities": [], "scanner_action": "flag"},
        "cost": {"daily_budget": "0.250000", "max_input_tokens": 900},
        "optimizer": {"terse_mode": True},
    },
    {"agent_id": "default", "cost": {"daily_budget": "0.200000"}},
)

# The same rows, flat, for SQL: agent, provider, default model, entities, action,
# budget, input limit, history limit, brevity.
POLICY_ROWS = (
    ("support", "openai", None, ["email", "secret", "ssn"], "redact", "0.15", None, 3, False),
    ("research", "anthropic", "claude-3-5-sonnet-latest", [], "flag", "0.25", 900, None, True),
    ("default", "openai", None, ["secret"], "block", "0.20", None, None, False),
)

TOOL_POLICIES = (
    ("support", "view", True, False),
    ("support", "click", True, False),
    ("support", "error", True, True),
    ("research", "purchase", False, True),
)

# Agent, tool, calls, per, seconds to wait.
RATE_LIMITS = (
    ("support", "view", 5, "session", 0),
    ("support", "view", 1, "hour", 600),
    ("research", "view", 3, "hour", 0),
    ("research", "click", 1, "hour", 3600),
    ("research", "click", 2, "session", 60),
    ("default", "purchase", 1, "minute", 86400),
)

ARG_RULES = (
    ("support", "view", "k", "int", None, None),
    ("support", "click", "k", "string", "^[1-4][0-9]$", None),
    ("research", "click", "k", "string", "^[5-9]", None),
    ("research", "purchase", "k", "enum", None, ["1", "2", "3", "5", "8", "13", "21", "34", "55", "89"]),
    ("default", "signup", "k", "string", "7", None),
)

COMPETITORS = ("Ungen", "ÉTION", "the")

# What-if and gate budgets over events, in dollars per day.
EVENT_BUDGET = "5.000000"
WHAT_IF_BUDGETS = ("2.500000", "5.000000", "1000.000000")
