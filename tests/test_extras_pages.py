from __future__ import annotations

from datetime import date, datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptledger.operators import extras, guards
from promptledger.sources import pages
from promptledger.sources.pages import convert_pages, html_to_markdown


def test_loops(spark):
    same = "please fix the failing build now"
    rows = [("s", n, same) for n in range(6)] + [("s", 6, "something else entirely"), ("s", 7, same)]
    rows += [("t", n, f"{same} attempt") for n in range(3)] + [(None, 1, same), (None, 2, same)]
    df = spark.createDataFrame(rows, "session_id string, turn long, text string")
    for chunks in (1, 5):
        got = {(r.session_id, r.turn): (r.repeats, r.looping) for r in extras.detect_loops(df, chunks=chunks).collect()}
        assert [got["s", n] for n in range(8)] == [(0, False), (1, False), (2, False), (3, False), (4, True), (5, True), (0, False), (0, False)]
        assert got["t", 2] == (2, False) and got[None, 2] == (1, False)


def test_tool_access(spark):
    policies = spark.createDataFrame(
        [("a", "read", True, False), ("a", "write", True, True), ("b", "drop", False, True)],
        "agent_id string, tool string, allowed boolean, denied boolean")
    calls = spark.createDataFrame([(x, t) for x in "abc" for t in ("read", "write", "drop")], "agent_id string, tool string")
    got = {(r.agent_id, r.tool): r.permitted for r in extras.tool_access(calls, policies).collect()}
    assert [k for k, v in got.items() if not v] and {k for k, v in got.items() if v} == {
        ("a", "read"), ("b", "read"), ("b", "write"), ("c", "read"), ("c", "write"), ("c", "drop")}


def test_rate_limit(spark):
    start = datetime(2024, 1, 1, 10, 59, 50)
    calls = [(n, start + timedelta(seconds=s), "s", t) for n, (s, t) in enumerate([(0, "m"), (5, "m"), (15, "m"), (70, "m"), (0, "h"), (20, "h"), (1, "x")])]
    df = spark.createDataFrame(calls, "event_id int, ts timestamp, session_id string, tool string")
    limits = spark.createDataFrame([("m", 1, "minute", 10), ("h", 5, "hour", 0)], "tool string, max_calls int, per string, cooldown_seconds int")
    got = {r.event_id: (r.call_number, r.over_limit, r.cooling_down) for r in extras.rate_limit(df, limits, chunks=4).collect()}
    assert got == {0: (1, False, False), 1: (2, True, True), 2: (1, False, False), 3: (1, False, False), 4: (1, False, False), 5: (1, False, False)}


def test_two_limits_of_one_tool_and_agents(spark):
    start = datetime(2024, 1, 1, 10, 0, 0)
    calls = [(n, start + timedelta(minutes=m), a, "s") for n, (m, a) in enumerate([(0, "x"), (1, "x"), (70, "x"), (0, "y")])]
    df = spark.createDataFrame(calls, "event_id int, ts timestamp, who string, session_id string").withColumn("tool", F.lit("t"))
    limits = spark.createDataFrame(
        [("x", "t", 1, "minute", 120), ("x", "t", 2, "hour", 30), ("x", "t", 2, "hour", 30), ("y", "t", 9, "session", 0)],
        "agent_id string, tool string, max_calls int, per string, cooldown_seconds int")
    got = {(r.event_id, r.per): (r.call_number, r.over_limit, r.cooling_down) for r in extras.rate_limit(df, limits, agent="who").collect()}
    assert got == {
        (0, "minute"): (1, False, False), (0, "hour"): (1, False, False), (1, "minute"): (1, False, True), (1, "hour"): (2, False, False),
        (2, "minute"): (1, False, False), (2, "hour"): (1, False, False), (3, "session"): (1, False, False)}


def test_args(spark):
    rules = spark.createDataFrame(
        [("t", "n", "int", None, None), ("t", "w", "enum", None, ["a", "b"]), ("t", "p", "string", "ab+", None)],
        "tool string, arg string, type string, pattern string, values array<string>")
    rows = [(1, "t", '{"n": 5, "w": "a", "p": "abbx"}'), (2, "t", '{"n": "x", "w": "c", "p": "xab"}'), (3, "u", '{"n": "x"}'), (4, "t", "{}"), (5, "t", "broken")]
    df = spark.createDataFrame(rows, "event_id int, tool string, args_json string")
    got = {(r.event_id, r.arg): r.problem for r in extras.validate_args(df, rules).collect()}
    assert got == {(2, "n"): "not an integer", (2, "w"): "not an allowed value", (2, "p"): "pattern mismatch"}


def test_mentions_retention_and_warning(spark, tmp_path):
    got = spark.range(1).select(extras.competitor_mentions(F.lit("We like ACME and Éclair"), ["acme", "éCLAIR", "zeta"])).first()[0]
    assert got == ["acme", "éCLAIR"]
    days = spark.createDataFrame([(date(2024, 1, d), d) for d in range(1, 11)], "day date, n int")
    assert extras.within_retention(days, 3, date(2024, 1, 10)).count() == 3
    log = str(tmp_path / "kept")
    days.write.partitionBy("day").json(log)
    (tmp_path / "kept" / "day=odd").mkdir()
    assert extras.apply_retention(spark, log, 3, date(2024, 1, 10)) == [f"2024-01-0{d}" for d in range(1, 8)]
    assert spark.read.json(log).count() == 3 and (tmp_path / "kept" / "day=odd").exists()
    policies = guards.policies_frame(spark, [{"agent_id": "a", "cost": {"max_input_tokens": 10}}])
    df = guards.agent_policy(spark.createDataFrame([("a", 8), ("a", 7), ("b", 99)], "agent_id string, n long"), policies)
    assert [r[0] for r in df.orderBy("n").select(extras.warn_token_pct("n", F.col("policy"))).collect()] == [False, True, False]


@pytest.mark.parametrize("html,want", [
    ("<title>T</title><p>a<br>b</p>", "# T\n\na\nb"), ("<h2>Head</h2><p>x &amp; y</p>", "## Head\n\nx & y"),
    ("<ul><li>one</li><li>two <b>bold</b></li></ul>", "- one\n- two **bold**"), ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ('<p><a href="/u">link</a></p>', "[link](/u)"), ("<script>var t='</p>';</script><nav>menu</nav><!-- c --><p>kept</p>", "kept"),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
    ("<table><tr><td>one<td>two<tr><td>three<td>four</table>", "| one | two |\n| --- | --- |\n| three | four |"),
    ("<table><tr><td>before<table><tr><td>in1</td><td>in2</td></tr></table>after</td><td>x</td></tr></table>", "| before in1 in2 after | x |\n| --- | --- |"),
    ("<div><nav>menu<ul><li>a</div><p>kept</p>", "kept"), ("<table><tr><td>open", "| open |\n| --- |"),
    ("plain", "plain"), ("", ""), ("<p>unclosed <b>bold", "unclosed **bold"),
])
def test_markdown(html, want):
    assert html_to_markdown(html) == want


def test_convert_pages(spark):
    rows = [(1, "<p>é two</p>", "html"), (2, "# as is", "MD"), (3, "x", "exe"), (4, None, "html")]
    df = spark.createDataFrame(rows, "page_id long, html string, kind string")
    got = {r.page_id: r for r in convert_pages(df, format_col="kind").collect()}
    assert (got[1].markdown, got[1].original_size_bytes, got[1].markdown_tokens, got[1].warnings) == ("é two", 13, 2, [])
    assert got[2].markdown == "# as is" and got[2].format_detected == "md"
    assert got[3].markdown is None and got[3].warnings == ["unsupported format exe"] and got[3].markdown_tokens == 0
    assert got[4].warnings == ["no document"]


def test_pages_are_converted_a_few_at_a_time(spark):
    html = "<p>" + "word " * 200 + "</p>"
    batch = pa.RecordBatch.from_pydict(
        {"_id": list(range(1000)), "_text": [html] * 999 + [None], "_format": ["html"] * 1000, "_size": [len(html)] * 1000}
    )
    parts = list(pages._convert(iter([batch])))
    assert max(p.num_rows for p in parts) <= 64 and sum(p.num_rows for p in parts) == 1000
    got = pa.Table.from_batches(parts).to_pylist()
    assert [r["_id"] for r in got] == list(range(1000)) and got[0]["markdown"] == html_to_markdown(html)
    assert got[-1]["markdown"] is None and got[-1]["error"] == "no document"
