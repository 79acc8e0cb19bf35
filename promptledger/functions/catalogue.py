"""The detector and jailbreak catalogues: rows of data, not code.

A detector row says which entity a pattern finds.  ``needles`` are plain
strings of which at least one occurs in every text the pattern can match (after
case folding where the pattern ignores case); ``digit_run`` says that every
match holds four decimal digits in a row.  Both only save time: rows that fail such a cheap test
are never handed to the regex engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .text import WS

HIGH = "high"
GENERIC = "generic"
PLAIN = "plain"

MAX_DETECTORS = 512


@dataclass(frozen=True)
class Detector:
    entity: str
    detector: str
    pattern: str
    tier: str = PLAIN
    confidence: float = 0.9
    ignore_case: bool = False
    needles: tuple[str, ...] = ()
    digit_run: bool = False
    border: tuple[str, ...] | None = None

    @property
    def regex(self) -> str:
        """Pattern with Unicode classes on, as Python's ``re`` has them."""
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


@dataclass(frozen=True)
class JailbreakPattern:
    category: str
    pattern: str
    needle: str
    border: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        # d: only \n ends a line for "."
        return "(?idU)" + self.pattern.replace(r"\s", f"[{WS}]")


# Entity names in their canonical order.
ENTITIES = ("ssn", "credit_card", "email", "phone", "aadhaar", "pan", "upi_id", "passport", "secret")
SECRET = "secret"

S = f"[{WS}]"
DASH_OR_SPACE = f"[-{WS}]?"

# Groups of digits with one separator between them; digits in groups of a fixed size.
_BETWEEN_DIGITS = (r"(?U)[\p{Nd})]\z", r"(?U)\A[\p{Nd}(]")

# Patterns for personal data, confidence 0.9.
PERSONAL: tuple[Detector, ...] = (
    Detector("ssn", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", digit_run=True, needles=("-",), border=()),
    Detector("credit_card", "credit_card", rf"\b(?:\d{{4}}{DASH_OR_SPACE}){{3}}\d{{4}}\b", digit_run=True, border=_BETWEEN_DIGITS),
    Detector("email", "email", r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}\b", needles=("@",), border=()),
    Detector(
        "phone",
        "phone",
        rf"(?:\+91{DASH_OR_SPACE})?\d{{5}}{DASH_OR_SPACE}\d{{5}}"
        rf"|(?:\+1{DASH_OR_SPACE})?(?:\(\d{{3}}\)|\d{{3}}){DASH_OR_SPACE}\d{{3}}{DASH_OR_SPACE}\d{{4}}",
        digit_run=True,
        border=_BETWEEN_DIGITS,
    ),
    Detector("aadhaar", "aadhaar", rf"\b[0-9]{{4}}{S}?[0-9]{{4}}{S}?[0-9]{{4}}\b", digit_run=True, border=_BETWEEN_DIGITS),
    Detector("pan", "pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", digit_run=True, border=()),
    Detector("upi_id", "upi_id", r"\b[\w.\-]+@[a-zA-Z0-9]{2,64}\b(?!\.\w)", ignore_case=True, needles=("@",), border=()),
    Detector("passport", "passport", r"\b[A-Z]\d{7}\b", digit_run=True, border=()),
)

# Credentials known by their prefix, confidence 0.95.
CREDENTIALS: tuple[Detector, ...] = tuple(
    Detector(
        SECRET, name, pattern, HIGH, 0.95, needles=tuple(needles.split()),
        # A name, blanks and the sign of an assignment; the others hold no blank at all.
        border=(rf"(?:{'|'.join(needles.split())}){S}*[=:]?{S}*\z", "") if S in pattern else (),
    )
    for name, needles, pattern in (
        ("openai_api_key", "sk-", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b"),
        ("anthropic_api_key", "sk-ant-", r"\bsk-ant-[A-Za-z0-9_-]{20,}\b"),
        ("aws_access_key", "AKIA", r"\bAKIA[0-9A-Z]{16}\b"),
        (
            "aws_secret_key",
            "aws_secret_access_key AWS_SECRET_ACCESS_KEY",
            rf"(?:aws_secret_access_key|AWS_SECRET_ACCESS_KEY){S}*[=:]{S}*['\"]?([A-Za-z0-9/+=]{{40}})['\"]?",
        ),
        ("gcp_api_key", "AIza", r"\bAIza[0-9A-Za-z_-]{35}\b"),
        ("github_token", "gh", r"\bgh[pousr]_[A-Za-z0-9_]{36,}\b"),
        ("stripe_key", "k_", r"\b[sp]k_(?:live|test)_[A-Za-z0-9]{20,}\b"),
        ("razorpay_key", "rzp_", r"\brzp_(?:live|test)_[A-Za-z0-9]{14,}\b"),
        ("groq_api_key", "gsk_", r"\bgsk_[A-Za-z0-9]{20,}\b"),
        ("slack_token", "xox", r"\bxox[bpoas]-[A-Za-z0-9-]{10,}\b"),
        ("twilio_key", "AC", r"\bAC[a-f0-9]{32}\b"),
        ("huggingface_token", "hf_", r"\bhf_[A-Za-z0-9]{20,}\b"),
    )
)

# Variable names whose assignment counts as a secret.
ASSIGNED_NAMES = (
    "API_KEY", "API_SECRET", "SECRET_KEY", "ACCESS_TOKEN", "AUTH_TOKEN", "PRIVATE_KEY",
    "DATABASE_URL", "DB_PASSWORD", "OPENAI_API_KEY", "ANTHROPIC_API_KEY",
    "STRIPE_SECRET_KEY", "RAZORPAY_KEY_SECRET", "AWS_ACCESS_KEY_ID",
    "AWS_SECRET_ACCESS_KEY", "GOOGLE_API_KEY", "GITHUB_TOKEN",
    "SLACK_TOKEN", "TWILIO_AUTH_TOKEN", "HF_TOKEN",
)

# Generic credentials; they give way to an overlapping known prefix.
GENERIC_CREDENTIALS: tuple[Detector, ...] = (
    Detector(
        SECRET,
        "generic_env_secret",
        rf"(?:{'|'.join(ASSIGNED_NAMES)}){S}*[=:]{S}*['\"]?([A-Za-z0-9_/+=:@.-]{{8,}})['\"]?",
        GENERIC,
        0.70,
        ignore_case=True,
        needles=("_key", "_secret", "_token", "_url", "_password"),
        border=(rf"(?iU)(?:{'|'.join(ASSIGNED_NAMES)}){S}*[=:]?{S}*\z", ""),
    ),
    Detector(
        SECRET, "bearer_token", rf"[Bb]earer{S}+[A-Za-z0-9_.-]{{20,}}", GENERIC, 0.70, needles=("earer",), border=(rf"[Bb]earer{S}*\z", ""),
    ),
    Detector(
        SECRET,
        "private_key_block",
        rf"-----BEGIN{S}+(?:RSA{S}+)?(?:EC{S}+)?PRIVATE{S}+KEY-----",
        GENERIC,
        0.95,
        needles=("-----BEGIN",),
        border=(rf"-----BEGIN(?:{S}+RSA)?(?:{S}+EC)?(?:{S}+PRIVATE)?{S}*\z", ""),
    ),
)

DEFAULT_DETECTORS: tuple[Detector, ...] = PERSONAL + CREDENTIALS + GENERIC_CREDENTIALS

# Category, pattern, a string every match contains.  First hit wins.
JAILBREAKS: tuple[JailbreakPattern, ...] = (
    JailbreakPattern("dan", "do anything now", "do anything now"),
    JailbreakPattern("dan", r"\bDAN\b", "dan"),
    JailbreakPattern("dan", "DAN mode", "dan"),
    JailbreakPattern("dan", "developer mode enabled", "mode"),
    JailbreakPattern("dan", "jailbreak mode", "mode"),
    JailbreakPattern("dan", "you are now in .* mode", "mode"),
    JailbreakPattern("dan", "enable .* mode", "mode"),
    JailbreakPattern("dan", "unrestricted mode", "mode"),
    JailbreakPattern("instruction_override", "ignore (?:all )?(?:previous|prior|above) instructions?", "instruction"),
    JailbreakPattern("instruction_override", "ignore (?:your|the) system prompt", "system prompt"),
    JailbreakPattern("instruction_override", "forget everything (?:you were|you've been) told", "forget"),
    JailbreakPattern("instruction_override", "forget (?:all )?(?:previous|prior) (?:instructions|rules)", "forget"),
    JailbreakPattern("instruction_override", "disregard (?:all )?(?:previous|prior|your) instructions?", "instruction"),
    JailbreakPattern("instruction_override", "override (?:the )?system prompt", "system prompt"),
    JailbreakPattern("instruction_override", r"new instructions\s*:", "instruction", (rf"(?iU)new instructions{S}*\z", rf"\A{S}*:")),
    JailbreakPattern("instruction_override", "do not follow (?:your|the) (?:rules|guidelines|instructions)", "do not follow"),
    JailbreakPattern("instruction_override", "bypass (?:your|all|the) (?:rules|restrictions|filters|safety)", "bypass"),
    JailbreakPattern("instruction_override", "you must ignore (?:all )?(?:previous|safety)", "you must ignore"),
    JailbreakPattern("role_play", "pretend you are an? unrestricted", "pretend you are"),
    JailbreakPattern("role_play", "act as (?:an? )?(?:unrestricted|uncensored|unfiltered)", "act as"),
    JailbreakPattern("role_play", "you are now free from all guidelines", "free from all guidelines"),
    JailbreakPattern("role_play", "roleplay as (?:an? )?(?:evil|malicious|unrestricted)", "roleplay as"),
    JailbreakPattern("role_play", "simulate (?:an? )?(?:AI|assistant) (?:without|with no) (?:rules|restrictions)", "simulate"),
    JailbreakPattern("role_play", "you are (?:no longer|not) bound by", "bound by"),
    JailbreakPattern("role_play", "behave as if you have no (?:rules|restrictions|guidelines)", "behave as if you have no"),
    JailbreakPattern("role_play", "from now on you (?:will|must|should) (?:ignore|disregard)", "from now on you"),
    JailbreakPattern("encoding", "decode this base64", "base64"),
    JailbreakPattern("encoding", "decode (?:the following )?(?:base64|hex|rot13)", "decode"),
    JailbreakPattern("encoding", r"base64\s*(?:encoded|decode)", "base64", (rf"(?iU)base64{S}*\z", rf"(?iU)\A{S}*(?:encoded|decode)")),
    JailbreakPattern("encoding", "execute (?:the )?(?:following )?encoded", "execute"),
    JailbreakPattern("encoding", r"\\x[0-9a-f]{2}", r"\x"),
    JailbreakPattern("extraction", "reveal your system prompt", "system prompt"),
    JailbreakPattern("extraction", "show (?:me )?your (?:system )?instructions", "instruction"),
    JailbreakPattern("extraction", "what are your (?:system )?instructions", "instruction"),
    JailbreakPattern("extraction", "repeat (?:your )?(?:system )?prompt verbatim", "prompt verbatim"),
    JailbreakPattern("extraction", "print (?:your )?(?:initial|system) (?:prompt|instructions)", "print"),
    JailbreakPattern("extraction", "output (?:your )?(?:hidden|system) (?:prompt|instructions)", "output"),
)

DETECTOR_SCHEMA = (
    "entity string, detector string, pattern string, tier string, confidence double, ordinal int"
)


def detectors_frame(spark: SparkSession, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    rows = [(d.entity, d.detector, d.pattern, d.tier, d.confidence, n) for n, d in enumerate(detectors)]
    return spark.createDataFrame(rows, DETECTOR_SCHEMA)


def detectors_from_frame(df: DataFrame) -> list[Detector]:
    """Detector rows as a list; they become constants of the plan, so their number is checked."""
    rows = df.select("entity", "detector", "pattern", "tier", "confidence", "ordinal").take(MAX_DETECTORS + 1)
    if len(rows) > MAX_DETECTORS:
        raise ValueError(f"more than {MAX_DETECTORS} detector rows")
    known = {d.detector: d for d in DEFAULT_DETECTORS}
    out = []
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        d = known.get(r["detector"])
        if d and (d.entity, d.pattern) == (r["entity"], r["pattern"]):
            out.append(Detector(d.entity, d.detector, d.pattern, r["tier"], r["confidence"],
                                d.ignore_case, d.needles, d.digit_run, d.border))
        else:
            out.append(Detector(r["entity"], r["detector"], r["pattern"], r["tier"], r["confidence"]))
    return out
