from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptledger.functions.prices import resolve_price
from promptledger.operators import govern, guards, requests, shrink, token_counts
from promptledger.schemas import MESSAGES


def frame(spark, *lists, **columns):
    rows = [(n, [{"role": r, "content": c} for r, c in m]) for n, m in enumerate(lists)]
    df = spark.createDataFrame(rows, f"id int, messages {MESSAGES}")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()}) if columns else df


def after(spark, step, messages):
    row = frame(spark, messages).select(step(F.col("messages")).alias("m")).first()
    return [(x.role, x.content) for x in row.m]


@pytest.mark.parametrize("block", [2, 5, 256])
def test_conversations_become_requests(spark, monkeypatch, block):
    monkeypatch.setattr(requests, "TURN_BLOCK", block)
    rng = random.Random(block)
    rows = []
    for conv in [*range(12), None]:
        turns = sorted(rng.sample(range(3, 60), rng.randint(1, 30)))
        rows += [(conv, t, rng.choice(["user", "assistant", "system"]), f"c{conv}t{t}") for t in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): ([(m.role, m.content) for m in r.messages], r.answer)
           for r in requests.conversations_to_requests(df).collect()}
    want = {}
    for c, t, role, text in rows:
        if role == "assistant":
            want[(c, t)] = ([(x[2], x[3]) for x in sorted(rows, key=lambda x: x[1]) if x[0] == c and x[1] < t], text)
    assert got == want


def test_explode_and_wrap(spark):
    df = frame(spark, [("user", "a"), ("assistant", "b")])
    rows = requests.requests_to_messages(df, "id").collect()
    assert [(r.pos, r.role, r.content) for r in rows] == [(0, "user", "a"), (1, "assistant", "b")]
    one = requests.single_turn_requests(spark.createDataFrame([("x",)], "t string"), "t").first()
    assert [(m.role, m.content) for m in one.messages] == [("user", "x")]


def test_batch_rows(spark):
    lists = [
        [("system", "one"), ("user", "q"), ("system", " "), ("system", "two"), ("tool", "skip")],
        [("assistant", "a"), ("user", "")], [("system", "only")], [(None, None)],
    ]
    df = frame(spark, *lists, model="m")
    split = {r.id: (r.system, [(t.role, t.content) for t in r.turns], json.loads(r.body))
             for r in requests.batch_request_rows(df).collect()}
    assert split[0][:2] == ("one\n\ntwo", [("user", "q")])
    assert split[1][:2] == (None, [("user", "(context)"), ("assistant", "a"), ("user", "")])
    assert split[2][:2] == ("only", [("user", "")])
    assert split[3][:2] == (None, [("user", "")])
    assert split[0][2]["max_tokens"] == 1024 and split[0][2]["system"] == "one\n\ntwo" and "system" not in split[1][2]
    model = {r.id: (r.system, [(t.role, t.content) for t in r.turns]) for r in requests.batch_request_rows(df, "role_model").collect()}
    assert model[0] == ("one\n \ntwo", [("user", "q")])
    assert model[1] == (None, [("model", "a")])
    assert model[2] == ("only", [("user", "")])
    with pytest.raises(ValueError):
        requests.batch_request_rows(df, "other")


def test_empty_messages_go(spark):
    assert after(spark, shrink.remove_empty_messages, [("user", " "), ("user", "x"), ("assistant", "\n")]) == [("user", "x")]


def test_system_prompts_merge_first(spark):
    got = after(spark, shrink.merge_system_prompts, [("system", "S1"), ("user", "hi"), ("system", "S2")])
    assert got == [("system", "S1\n\nS2"), ("user", "hi")]
    same = [("user", "a"), ("system", "S"), ("user", "b")]
    assert after(spark, shrink.merge_system_prompts, same) == same


@pytest.mark.parametrize("text,want", [
    ("Hello\n\n\n\nWorld!   \n", "Hello\n\nWorld!\n"), ("a \t\nb\t", "a\nb"), ("a \r\nb", "a \r\nb"),
    ("x\n \n\n\ny ", "x\n\n\ny"), ("keep", "keep"), ("", ""), (" \n", "\n"),
])
def test_whitespace(spark, text, want):
    assert after(spark, shrink.normalize_whitespace, [("user", text)]) == [("user", want)]


def test_history_limit(spark):
    m = [("user", "1"), ("system", "s"), ("assistant", "2"), ("user", "3")]
    assert after(spark, lambda x: shrink.trim_history(x, 2), m) == [("system", "s"), ("assistant", "2"), ("user", "3")]
    assert after(spark, lambda x: shrink.trim_history(x, 3), m) == m
    assert after(spark, lambda x: shrink.trim_history(x, 0), m) == m
    assert after(spark, lambda x: shrink.trim_history(x, F.lit(None).cast("int")), m) == m


def test_brevity_prompt(spark):
    def step(m):
        return shrink.inject_brevity_prompt(m, "SHORT")

    assert after(spark, step, [("user", "q")]) == [("system", "SHORT"), ("user", "q")]
    assert after(spark, step, [("user", "q"), ("system", "a"), ("system", "b")]) == [("user", "q"), ("system", "a\n\nSHORT"), ("system", "b")]


def shrunk(spark, lists, optimizer):
    df = frame(spark, *lists, agent_id="x", model="gpt-4")
    policies = guards.policies_frame(spark, [{"agent_id": "x", "optimizer": optimizer}])
    rows = shrink.shrink_requests(resolve_price(guards.agent_policy(df, policies))).collect()
    return {r.id: r for r in rows}


def test_whole_shrinking(spark):
    long = " ".join(["word"] * 5000)
    lists = [
        [("system", "a"), ("user", " "), ("system", "b"), ("user", "x\n\n\n\ny  "), ("assistant", "z"), ("user", "end")],
        [("user", long)], [], [("user", "hi")] * 12,
    ]
    got = shrunk(spark, lists, {"max_history_messages": 2, "terse_mode": True})
    assert got[0].actions == list(shrink.ACTIONS)
    assert got[0].saved_tokens == got[0].original_tokens - got[0].input_tokens
    assert [m.role for m in got[0].messages] == ["system", "assistant", "user"]
    assert got[2].actions == [] and (got[2].original_tokens, got[2].input_tokens, got[2].savings_pct) == (0, 0, 0.0)
    assert len(got[1].guidance) == 1 and "6507 tokens" in got[1].guidance[0]
    assert got[3].guidance == [] and "history_trim" in got[3].actions
    plain = shrunk(spark, lists, {})
    assert len(plain[3].guidance) == 1 and plain[3].actions == []
    assert plain[1].savings_pct == 0.0 and plain[0].cost_saved > 0
    off = shrunk(spark, lists, {"enabled": False, "terse_mode": True})
    assert off[0].actions == [] and off[0].guidance == [] and len(off[0].messages) == 6
    only = shrunk(spark, lists, {"remove_empty_messages": False, "deduplicate_system_prompts": False})
    assert only[0].actions == ["whitespace_normalization"]


def test_savings_report(spark):
    df = frame(spark, [("user", "a  b   "), ("user", "")], [("user", "x")], agent_id="x", model="gpt-4")
    rows = shrink.savings_report(shrink.shrink_requests(resolve_price(guards.agent_policy(df)))).collect()
    got = {r.action: (r.requests, r.saved_tokens) for r in rows}
    assert got["all"] == (2, 6) and got["remove_empty_messages"] == (1, 6)


def test_a_tokenizer_counts_through_the_whole_request(spark):
    @F.pandas_udf("long")
    def quarters(texts: pd.Series) -> pd.Series:
        # The tokenizer fails on texts that begin with "fail".
        return ((texts.str.len() + 3) // 4).where(~texts.str.startswith("fail"))

    rows = [
        ("a", "gpt-4o", [("user", "hello world"), ("assistant", "")], "twelve chars"),
        ("b", "claude-3-5-haiku-latest", [("user", "hello world")], "twelve chars"),
        ("c", "gpt-4o", [("user", "fail on two words"), (None, None)], "x"),
        ("d", "gpt-4o", [], "x"),
    ]
    df = spark.createDataFrame(rows, "request_id string, model string, messages array<struct<role:string,content:string>>, answer string")
    got = {r.request_id: r.n for r in token_counts.with_message_tokens(df, "n", quarters).collect()}
    # role 1, overhead 4, 2 for the request; an empty text counts 1 as by the estimate.
    assert got == {"a": (1 + 3 + 4) + (1 + 1 + 4) + 2, "b": 1 + 2 + 4 + 2, "c": (1 + 5 + 4) + 4 + 2, "d": 0}
    full = df.selectExpr(
        "*", "timestamp'2024-01-01' AS ts", "'x' AS agent_id", "'s' AS session_id", "'u' AS user_agent", "'openai' AS provider",
        "CAST(NULL AS BIGINT) AS answer_tokens", "CAST(NULL AS BIGINT) AS answer_input_tokens",
    )
    done = {r.request_id: r for r in govern.govern_requests(full, tokenizer=quarters).collect()}
    assert (done["a"].original_tokens, done["a"].output_tokens) == (16, 3) and done["b"].original_tokens == 9
    assert done["a"].input_tokens == 10 and done["a"].saved_tokens == 6  # the empty message goes
