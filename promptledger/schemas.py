"""Table layouts.  Operators take and return frames with these columns."""

from __future__ import annotations

MONEY = "decimal(18,6)"

MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"

FINDING = (
    "struct<entity:string,detector:string,text:string,start:int,end:int,confidence:double>"
)
FINDINGS = f"array<{FINDING}>"

JAILBREAK = "struct<flag:boolean,confidence:double,pattern:string,category:string>"

VIOLATION = (
    "struct<type:string,severity:string,detail:string,action:string,metadata:map<string,string>>"
)
VIOLATIONS = f"array<{VIOLATION}>"

PRICE_SCHEMA = "model string, ordinal int, in_per_1k decimal(12,9), out_per_1k decimal(12,9)"

REQUEST_SCHEMA = (
    f"request_id string, ts timestamp, agent_id string, session_id string, user_agent string, "
    f"provider string, model string, messages {MESSAGES}, answer string, "
    f"answer_input_tokens long, answer_tokens long"
)

# One log line; ``_corrupt`` receives lines that are not JSON objects.
EVENT_METADATA = (
    "struct<model:string,input_tokens:long,output_tokens:long,estimated_cost_usd:double,"
    "original_input_tokens:long,saved_tokens:long,message:string>"
)
GUARD_EVENT_SCHEMA = (
    f"timestamp string, event string, agent_id string, session_id string, "
    f"violations {VIOLATIONS}, metadata {EVENT_METADATA}"
)

HISTORY_SCHEMA = (
    "timestamp string, tool string, cost_usd double, tokens long, blocked boolean, block_reason string"
)

# Per-agent policy.  Every group may be null, every field inside it too.
POLICY_GROUPS = {
    "llm": "struct<provider:string,default_model:string>",
    "input_guard": (
        "struct<scanner_enabled:boolean,detect_entities:array<string>,scanner_action:string,"
        "jailbreak_detection:boolean>"
    ),
    "output_guard": "struct<scanner_enabled:boolean,competitor_block:array<string>>",
    "cost": (
        "struct<daily_budget:decimal(18,6),monthly_budget:decimal(18,6),"
        "per_session_limit:decimal(18,6),max_input_tokens:int>"
    ),
    "optimizer": (
        "struct<enabled:boolean,whitespace_normalization:boolean,max_history_messages:int,"
        "deduplicate_system_prompts:boolean,remove_empty_messages:boolean,"
        "warn_at_token_pct:double,terse_mode:boolean>"
    ),
}
POLICY_SCHEMA = "agent_id string, " + ", ".join(f"{k} {v}" for k, v in POLICY_GROUPS.items())
POLICY = "struct<" + ",".join(f"{k}:{v}" for k, v in POLICY_GROUPS.items()) + ">"

# Defaults of a policy that leaves things out.
POLICY_DEFAULTS = {
    "llm": {"provider": "openai", "default_model": None},
    "input_guard": {
        "scanner_enabled": True,
        "detect_entities": ["secret"],
        "scanner_action": "block",
        "jailbreak_detection": True,
    },
    "output_guard": {"scanner_enabled": True, "competitor_block": []},
    "cost": {
        "daily_budget": "10.000000",
        "monthly_budget": None,
        "per_session_limit": "0.500000",
        "max_input_tokens": None,
    },
    "optimizer": {
        "enabled": True,
        "whitespace_normalization": True,
        "max_history_messages": None,
        "deduplicate_system_prompts": True,
        "remove_empty_messages": True,
        "warn_at_token_pct": 0.80,
        "terse_mode": False,
    },
}
