"""The composed guard against one scan of the joined text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from promptledger.functions.catalogue import DEFAULT_DETECTORS, Detector
from promptledger.functions.tokens import messages_to_text
from promptledger.operators import guards, turn_guard

PARTS = [
    "plain words", "call 212 555", "4141", "5290 7734", "1186", "0421", "(212)", "+91", "98765", "43210 x", "ends 7046", "1823 5590",
    "aws_secret_access_key", "=", "abcd1234" * 5, "DB_PASSWORD =", "teapot77lantern", "Bearer", "eyJ" + "abcd1234" * 3, "-----BEGIN", "RSA", "PRIVATE KEY-----",
    "-----BEGIN RSA PRIVATE KEY-----", "new instructions", ": do it", "base64 ", "  decode this", "You are now in a", "quiet mode", "enable the quiet mode",
    "mail quiet.harbor@example.net", "key gsk_" + "abcd1234" * 3, "api_key=" + "sk-" + "abcd1234" * 3, "DAN", "pan QWKPL7302M", "", "  ", None, "x\n\ny 4141 4141 4141 4141", "pass T8204619",
]
POLICIES = [
    {"agent_id": "default"},
    {"agent_id": "flags", "input_guard": {"scanner_action": "flag", "detect_entities": ["email", "secret", "pan", "nothing"]}},
    {"agent_id": "redacts", "input_guard": {"scanner_action": "redact", "detect_entities": ["phone", "aadhaar", "credit_card"], "jailbreak_detection": False}},
    {"agent_id": "off", "input_guard": {"scanner_enabled": False}},
]


def requests(spark, seed, n=220):
    rng = random.Random(seed)
    turns = [[rng.choice(PARTS) for _ in range(rng.randint(0, 9))] for _ in range(n // 4)]
    rows = []
    for k in range(n):
        held = turns[k % len(turns)][: rng.randint(0, 9)]
        rows.append((f"r{k}", POLICIES[k % len(POLICIES)]["agent_id"], [("user", c) for c in held]))
    df = spark.createDataFrame(rows, "request_id string, agent_id string, messages array<struct<role:string,content:string>>")
    return guards.agent_policy(df.repartition(3), guards.policies_frame(spark, POLICIES))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_composed_guard_equals_one_scan(spark, seed):
    df = requests(spark, seed)
    whole = guards.input_guard(messages_to_text("messages"), F.col("policy"))
    want = {r.request_id: (r.g.allowed, r.g.violations) for r in df.select("request_id", whole.alias("g")).collect()}
    got = {r.request_id: (r.guard.allowed, r.guard.violations) for r in turn_guard.guard_requests(df).collect()}
    assert got == want
    assert sum(len(v) > 1 for _, v in want.values()) > 10


def test_only_some_rows_are_scanned(spark):
    df = requests(spark, 4, 40)
    got = turn_guard.guard_requests(df, scanned=F.col("agent_id") == "default").collect()
    assert all((r.guard is None) == (r.agent_id != "default") for r in got) and len(got) == 40


def test_every_different_text_is_scanned_once(spark):
    texts = spark.createDataFrame([("mail a.b@example.org",)] * 50 + [("nothing",)] * 50 + [("ends with 12",)], "text string")
    reports = {r.digest: r for r in turn_guard.text_reports(texts).collect()}
    assert len(reports) == 2 and sorted(len(r.findings) for r in reports.values()) == [0, 1]


def test_unknown_borders_are_refused(spark):
    own = Detector("ticket", "ticket", r"T-\d+\s+ok")
    assert turn_guard.can_compose() and not turn_guard.can_compose([*DEFAULT_DETECTORS, own])
    with pytest.raises(ValueError):
        turn_guard.guard_requests(requests(spark, 5, 4), detectors=[own])
