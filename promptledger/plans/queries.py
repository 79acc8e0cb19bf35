"""Registered queries: every operator over whole tables, one frame each."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import detection as spans
from ..functions.catalogue import DEFAULT_DETECTORS, PERSONAL, Detector
from ..functions.prices import estimate_cost, model_cost_matrix, price_of, resolve_price
from ..functions.tokens import count_message_tokens, count_tokens, messages_to_text, word_estimate
from ..operators import budget, detect, extras, govern, guards, reports, shrink
from ..operators import requests as req
from ..operators.token_counts import with_message_tokens
from ..schemas import VIOLATIONS
from ..sources import logs, pages
from ..storage import compute_once, materialize, scratch_path
from ..streaming import streams
from . import views
from .policies import (
    ARG_RULES, COMPETITORS, EVENT_BUDGET, POLICIES, RATE_LIMITS, TOOL_POLICIES, WHAT_IF_BUDGETS,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _line(messages: str | Column) -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), " | "))


def _n(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _usd(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _vs(c: str | Column) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(v, lambda x: F.concat_ws("/", x["type"], x["severity"], x["action"])), ",")


def _policies(spark: SparkSession) -> DataFrame:
    return guards.policies_frame(spark, POLICIES)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.resolve_model(guards.agent_policy(views.requests(spark, sf_dir), _policies(spark)))


def _shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shrink.shrink_requests(resolve_price(_routed(spark, sf_dir)))


def _governed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return govern.govern_requests(views.requests(spark, sf_dir), _policies(spark), **options)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return govern.governed_events(_governed(spark, sf_dir))


# --- sources ------------------------------------------------------------------


@query
def conversation_requests(spark, sf_dir):
    return views.requests(spark, sf_dir).select(
        "request_id", _n(F.size("messages")).alias("n_messages"), _line("messages").alias("digest"),
        _n(F.length("answer")).alias("answer_length"),
    )


@query
def request_messages(spark, sf_dir):
    rows = req.requests_to_messages(views.requests(spark, sf_dir))
    return rows.select("request_id", _n("pos").alias("pos"), "role", "content")


@query
def document_requests(spark, sf_dir):
    rows = req.single_turn_requests(views.texts(spark, sf_dir, "documents"), "text")
    return rows.select(
        "doc_id", _n(F.size("messages")).alias("n_messages"), F.col("messages")[0]["role"].alias("role"),
        F.md5(F.col("messages")[0]["content"]).alias("digest"), count_message_tokens("messages").alias("tokens"),
    )


def _batch_rows(spark, sf_dir, style):
    rows = req.batch_request_rows(views.requests(spark, sf_dir), style)
    return rows.select("request_id", "system", _n(F.size("turns")).alias("n_turns"), _line("turns").alias("digest"))


@query
def batch_rows_system_split(spark, sf_dir):
    return _batch_rows(spark, sf_dir, "system_split")


@query
def batch_rows_role_model(spark, sf_dir):
    return _batch_rows(spark, sf_dir, "role_model")


def _history_lines(spark, sf_dir) -> DataFrame:
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
    return views.history(spark, sf_dir).select(
        at.alias("timestamp"), "tool", _usd("cost_usd").alias("cost_usd"), "tokens", "blocked", "block_reason"
    )


def _history_events(spark, sf_dir) -> DataFrame:
    """Event log lines read off the history view; blank reasons become a missing type."""
    h = views.history(spark, sf_dir)
    one = guards.violation(
        F.nullif("block_reason", F.lit("")), F.lit("high"), F.lit("from history"), F.lit("blocked"), {"source": F.lit("history")}
    )
    meta = F.struct(
        F.col("tool").alias("model"), F.col("tokens").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"),
        _usd("cost_usd").alias("estimated_cost_usd"),
    )
    return h.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00").alias("timestamp"),
        F.when(F.col("blocked"), F.lit("blocked")).otherwise(F.lit("allowed")).alias("event"),
        F.lit("default").alias("agent_id"),
        "session_id",
        F.when(F.col("blocked"), F.array(one)).otherwise(F.array().cast(VIOLATIONS)).alias("violations"),
        meta.alias("metadata"),
    )


@query
def recent_log_days(spark, sf_dir):
    path = scratch_path(spark, "events-log")
    logs.write_guard_events(_history_events(spark, sf_dir), path)
    newest = logs.good_lines(logs.read_guard_events(spark, path, max_days=7))
    return newest.groupBy(F.col("day").cast("string").alias("day"), "event").agg(F.count(F.lit(1)).alias("n"))


@query
def history_log_day(spark, sf_dir):
    path = scratch_path(spark, "history-log")
    logs.write_history(_history_lines(spark, sf_dir), path)
    day = logs.read_history(spark, path, "2024-01-05")
    return day.select(
        F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"),
        "tool", "cost_usd", "tokens", "blocked", "block_reason",
    )


@query
def page_markdown(spark, sf_dir):
    return pages.convert_pages(views.texts(spark, sf_dir, "pages"))


@query
def page_words(spark, sf_dir):
    """The letters-only words of each page's Markdown, link and image targets left out."""
    text = F.regexp_replace("markdown", r"\]\([^)]*\)", "] ")
    found = F.regexp_extract_all(text, F.lit("[A-Za-z\u00c0-\u024f]+"), F.lit(0))
    rows = pages.convert_pages(views.texts(spark, sf_dir, "pages"))
    return rows.select("page_id", _n(F.size(found)).alias("n_words"), F.md5(F.array_join(found, " ")).alias("words_md5"))


@query
def added_entity(spark, sf_dir):
    """A detector row that is added and asked for alone."""
    added = (*DEFAULT_DETECTORS, Detector("mail_host", "mail_host", r"mail[0-9]+\.example", "plain", 0.9))
    rows = detect.detect_pii(views.texts(spark, sf_dir, "documents"), ["mail_host"], detectors=added)
    found = F.filter("findings", lambda f: f["entity"] == "mail_host")
    return rows.select("doc_id", _n(F.size("findings")).alias("n"), _n(F.size(found)).alias("n_host"))


# --- tokens and prices --------------------------------------------------------


@query
def word_estimates(spark, sf_dir):
    return views.texts(spark, sf_dir, "documents").select("doc_id", word_estimate("text").alias("tokens"))


@query
def token_counts(spark, sf_dir):
    docs = views.texts(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(F.col("text"))
    return docs.groupBy("lang", "source").agg(F.sum(count_tokens(text, F.lit("gpt-4o"))).alias("tokens"))


@query
def request_tokens(spark, sf_dir):
    return views.requests(spark, sf_dir).select("request_id", count_message_tokens("messages").alias("tokens"))


@F.pandas_udf(LongType())
def _quarters(texts: pd.Series) -> pd.Series:
    """A tokenizer that SQL can repeat: one token for each four characters begun."""
    return (texts.str.len() + 3) // 4


@query
def tokenized_requests(spark, sf_dir):
    rows = materialize(_routed(spark, sf_dir).select("request_id", "model", "messages"), "routed")
    return with_message_tokens(rows, "tokens", _quarters).select("request_id", "tokens")


@query
def request_text(spark, sf_dir):
    return views.requests(spark, sf_dir).select("request_id", F.md5(messages_to_text("messages")).alias("digest"))


@query
def model_prices(spark, sf_dir):
    return _routed(spark, sf_dir).select(
        "request_id", "model", price_of("model")["price_model"].alias("price_model"),
        price_of("model", rule="first")["price_model"].alias("first_model"),
    )


@query
def request_costs(spark, sf_dir):
    priced = resolve_price(_routed(spark, sf_dir))
    return priced.select(
        "request_id", _usd(estimate_cost(count_message_tokens("messages"), count_tokens("answer"))).alias("cost")
    )


@query
def resolved_models(spark, sf_dir):
    return _routed(spark, sf_dir).select("request_id", "provider", "model")


@query
def model_costs(spark, sf_dir):
    rows = views.requests(spark, sf_dir).select(
        count_message_tokens("messages").alias("input_tokens"), count_tokens("answer").alias("output_tokens")
    )
    return model_cost_matrix(rows).select("model", "requests", _usd("total_cost").alias("total_cost"))


@query
def supplier_model_costs(spark, sf_dir):
    """A price for every supplier, joined with the histogram of token pairs."""
    rows = views.requests(spark, sf_dir).select(
        count_message_tokens("messages").alias("input_tokens"), count_tokens("answer").alias("output_tokens")
    )
    key = F.col("s_suppkey")
    per_1k = lambda n: (n.cast("decimal(18,0)") * F.lit("0.000010").cast("decimal(7,6)")).cast("decimal(18,9)")
    offered = views.read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("model-"), key.cast("string")).alias("model"), key.cast("int").alias("ordinal"),
        per_1k(key).alias("in_per_1k"), per_1k(key * 3).alias("out_per_1k"),
    )
    return model_cost_matrix(rows, offered, block=64).select("model", "requests", _usd("total_cost").alias("total_cost"))


# --- shrinking ----------------------------------------------------------------


def _messages_after(spark, sf_dir, step: Callable[[Column], Column]) -> DataFrame:
    rows = views.requests(spark, sf_dir).select("request_id", step(F.col("messages")).alias("m"))
    return rows.select("request_id", _n(F.size("m")).alias("n_messages"), _line("m").alias("digest"))


@query
def non_empty_messages(spark, sf_dir):
    return _messages_after(spark, sf_dir, shrink.remove_empty_messages)


@query
def merged_system_prompts(spark, sf_dir):
    return _messages_after(spark, sf_dir, lambda m: shrink.merge_system_prompts(shrink.remove_empty_messages(m)))


@query
def normalized_whitespace(spark, sf_dir):
    text = F.concat("text", F.lit("\n\n\n"), "text", F.lit("  "))
    messages = shrink.normalize_whitespace(req.single_turn_messages(text))
    return views.texts(spark, sf_dir, "documents").select("doc_id", F.md5(messages[0]["content"]).alias("digest"))


@query
def trimmed_history(spark, sf_dir):
    return _messages_after(spark, sf_dir, lambda m: shrink.trim_history(m, 2))


@query
def brevity_prompts(spark, sf_dir):
    return _messages_after(spark, sf_dir, shrink.inject_brevity_prompt)


@query
def shrunk_requests(spark, sf_dir):
    return _shrunk(spark, sf_dir).select(
        "request_id", "original_tokens", "input_tokens", "saved_tokens", F.array_join("actions", ",").alias("actions"),
        _line("messages").alias("digest"),
    )


@query
def savings_metrics(spark, sf_dir):
    return _shrunk(spark, sf_dir).select("request_id", "savings_pct", _usd("cost_saved").alias("cost_saved"))


@query
def request_guidance(spark, sf_dir):
    rows = req.single_turn_requests(views.texts(spark, sf_dir, "documents"), "text")
    rows = resolve_price(guards.agent_policy(rows.withColumns({"agent_id": F.lit("default"), "model": F.lit("gpt-4o")})))
    advised = shrink.shrink_requests(rows).where(F.size("guidance") > 0)
    return advised.select("doc_id", F.col("original_tokens").alias("tokens"))


@query
def savings_report(spark, sf_dir):
    r = shrink.savings_report(_shrunk(spark, sf_dir))
    return r.withColumn("cost_saved", _usd("cost_saved"))


# --- detection ----------------------------------------------------------------


@query
def text_spans(spark, sf_dir):
    phone = next(d for d in PERSONAL if d.entity == "phone")
    rows = views.planted_documents(spark, sf_dir).select("doc_id", F.explode(spans.find_spans("text", phone.regex)).alias("s"))
    return rows.select("doc_id", "s.text", _n("s.start").alias("span_start"), _n("s.end").alias("span_end"))


@query
def pii_findings(spark, sf_dir):
    rows = detect.detect_pii(views.planted_documents(spark, sf_dir)).where(F.size("findings") > 0)
    label = F.transform("findings", lambda f: F.concat(f["entity"], F.lit("@"), f["start"], F.lit("-"), f["end"]))
    return rows.select("doc_id", _n(F.size("findings")).alias("n"), F.array_join(label, ",").alias("found"))


@query
def secret_findings(spark, sf_dir):
    rows = detect.detect_secrets(views.planted_documents(spark, sf_dir)).select("doc_id", F.explode("findings").alias("f"))
    return rows.select(
        "doc_id", "f.detector", "f.text", _n("f.start").alias("span_start"), _n("f.end").alias("span_end"), "f.confidence"
    )


@query
def documents_with_pii(spark, sf_dir):
    return detect.has_pii(views.planted_documents(spark, sf_dir)).select("doc_id", "has_pii")


@query
def redacted_documents(spark, sf_dir):
    rows = detect.redact(views.planted_documents(spark, sf_dir))
    return rows.select("doc_id", F.md5("redacted").alias("digest"), _n(F.length("redacted")).alias("n_chars"))


@query
def redacted_documents_compat(spark, sf_dir):
    rows = detect.redact(views.planted_documents(spark, sf_dir), overlap="compat")
    return rows.select("doc_id", F.md5("redacted").alias("digest"), _n(F.length("redacted")).alias("n_chars"))


@query
def pii_scan(spark, sf_dir):
    return detect.scan_pii(views.planted_documents(spark, sf_dir)).select("doc_id", "scan.*")


@query
def secret_scan(spark, sf_dir):
    return detect.scan_secrets(views.planted_documents(spark, sf_dir)).select("doc_id", "scan.*")


@query
def jailbreak_scan(spark, sf_dir):
    rows = detect.detect_jailbreak(views.planted_documents(spark, sf_dir))
    return rows.select("doc_id", "jailbreak.category", "jailbreak.pattern")


@query
def findings_table(spark, sf_dir):
    rows = detect.findings_table(views.planted_documents(spark, sf_dir), ["doc_id", "lang"])
    return rows.select(
        "doc_id", "lang", "entity", "detector", "text", _n("start").alias("span_start"), _n("end").alias("span_end"), "confidence"
    )


@query
def findings_report(spark, sf_dir):
    return detect.findings_report(views.planted_documents(spark, sf_dir), ["lang"])


@query
def findings_by_quality(spark, sf_dir):
    # Keys and entities only: the join never carries a text.
    found = detect.detect_pii(views.planted_documents(spark, sf_dir)).where(F.size("findings") > 0)
    slim = found.select("doc_id", F.transform("findings", lambda f: f["entity"]).alias("names"))
    rows = slim.join(views.read(spark, sf_dir, "labels"), "doc_id")
    each = rows.select("quality", "toxic", "names", F.explode(F.array_distinct("names")).alias("entity"))
    hits = F.size(F.filter("names", lambda n: n == F.col("entity")))
    return each.groupBy(_n("quality").alias("quality"), _n("toxic").alias("toxic"), "entity").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(_n(hits)).alias("findings")
    )


@query
def personal_data_by_language(spark, sf_dir):
    return detect.findings_report(views.texts(spark, sf_dir, "documents"), ["lang"])


@query
def scrubbed_corpus(spark, sf_dir):
    rows = detect.scrub_corpus(views.planted_documents(spark, sf_dir))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.sum(_n(F.length("text"))).alias("n_chars")
    )


@query
def clean_corpus(spark, sf_dir):
    return detect.scrub_corpus(views.planted_documents(spark, sf_dir), "block").select("doc_id", "lang", "source")


# --- guards -------------------------------------------------------------------


@query
def agent_policies(spark, sf_dir):
    conv = F.split_part("request_id", F.lit("-"), F.lit(1)).cast("long")
    rows = views.requests(spark, sf_dir).withColumn("agent_id", F.when(conv % 9 == 0, F.lit("unlisted")).otherwise(F.col("agent_id")))
    rows = guards.agent_policy(rows, _policies(spark))
    return rows.select(
        "request_id", _usd("policy.cost.daily_budget").alias("daily_budget"), _n("policy.cost.max_input_tokens").alias("max_input_tokens"),
        F.col("policy.input_guard.scanner_action").alias("scanner_action"),
        F.array_join("policy.input_guard.detect_entities", ",").alias("entities"),
    )


@query
def input_guard(spark, sf_dir):
    rows = _shrunk(spark, sf_dir).withColumn("body", messages_to_text("messages"))
    rows = rows.withColumn("g", guards.input_guard("body", F.col("policy")))
    return rows.select("request_id", "g.allowed", _vs("g.violations").alias("violations"))


@query
def output_guard(spark, sf_dir):
    rows = guards.agent_policy(views.planted_documents(spark, sf_dir))
    rows = compute_once(rows, "v", guards.output_guard("text", F.col("policy"))).where(F.size("v") > 0)
    label = F.transform("v", lambda x: F.concat_ws("/", x["type"], x["severity"]))
    return rows.select("doc_id", F.array_join(label, ",").alias("violations"))


@query
def token_limit_gate(spark, sf_dir):
    rows = _shrunk(spark, sf_dir)
    over = F.size(guards.token_limit_violations(F.col("input_tokens"), F.col("policy"))) > 0
    return rows.select("request_id", "input_tokens", over.alias("blocked"))


def _gate_rows(spark, sf_dir) -> DataFrame:
    cost = F.round(F.col("value") * 1000).cast("long")
    half = (cost - F.pmod(cost, F.lit(2))).cast("decimal(18,0)") / 2
    micro = F.lit("0.000001").cast("decimal(7,6)")
    return views.read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", (cost.cast("decimal(18,0)") * micro).cast("decimal(18,6)").alias("cost"),
        (half.cast("decimal(18,0)") * micro).cast("decimal(18,6)").alias("estimate"),
    )


def _decisions(df: DataFrame) -> DataFrame:
    return df.select("event_id", _usd("spend_before").alias("spend_before"), "over_budget")


def _dollars(amount: str) -> Column:
    return F.lit(amount).cast("decimal(18,6)")


@query
def daily_budget_gate(spark, sf_dir):
    rows = _gate_rows(spark, sf_dir)
    return _decisions(
        budget.budget_gate(rows, F.to_date("ts"), "event_id", "ts", F.col("estimate"), F.col("cost"), _dollars(EVENT_BUDGET))
    )


@query
def large_key_budget_gate(spark, sf_dir):
    """Every day is treated as one that no task can hold: step functions of chunks."""
    rows = _gate_rows(spark, sf_dir)
    return _decisions(
        budget.budget_gate(rows, F.to_date("ts"), "event_id", "ts", F.col("estimate"), F.col("cost"), _dollars(EVENT_BUDGET), fold_rows=0)
    )


@query
def redacted_requests(spark, sf_dir):
    rows = _shrunk(spark, sf_dir).where(F.col("policy.input_guard.scanner_action") == "redact")
    return rows.select("request_id", _line(guards.apply_redaction("messages", F.col("policy"))).alias("digest"))


@query
def governed_requests(spark, sf_dir):
    return _governed(spark, sf_dir).select(
        "request_id", "agent_id", "provider", "model", "blocked", _vs("violations").alias("violations"), "original_tokens",
        "input_tokens", "output_tokens", _usd("cost_usd").alias("cost_usd"), _usd("spend_before").alias("spend_before"),
    )


@query
def governed_events(spark, sf_dir):
    m = F.col("metadata")
    return _log(spark, sf_dir).select(
        "event", F.substring("timestamp", 1, 19).alias("at"), "agent_id", "session_id", _vs("violations").alias("violations"),
        m["input_tokens"].alias("input_tokens"), m["output_tokens"].alias("output_tokens"), m["estimated_cost_usd"].alias("cost"),
        m["original_input_tokens"].alias("original_input_tokens"), m["saved_tokens"].alias("saved_tokens"),
    )


@query
def request_block_reasons(spark, sf_dir):
    rows = _governed(spark, sf_dir).where("blocked")
    return rows.groupBy(guards.block_reason(F.col("blocked"), F.col("violations")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def block_summaries(spark, sf_dir):
    rows = _governed(spark, sf_dir).where("blocked")
    return rows.select("request_id", guards.block_summary(F.col("violations")).alias("s")).select("request_id", "s.types", "s.details")


@query
def client_tools(spark, sf_dir):
    return views.history(spark, sf_dir).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query
def budget_what_if(spark, sf_dir):
    r = budget.budget_what_if(_gate_rows(spark, sf_dir), WHAT_IF_BUDGETS, "event_id", "ts", F.col("estimate"), F.col("cost"))
    return r.select(
        _usd("budget").alias("budget"), F.col("day").cast("string").alias("day"), "admitted", "refused",
        _usd("admitted_spend").alias("admitted_spend"), _usd("refused_spend").alias("refused_spend"),
    )


# --- reports ------------------------------------------------------------------


def _billed(spark, sf_dir) -> DataFrame:
    h = views.history(spark, sf_dir)
    return h.withColumn("cost_usd", F.when(F.col("blocked"), F.lit(0)).otherwise(F.col("cost_usd")).cast("decimal(18,6)"))


@query
def daily_usage(spark, sf_dir):
    r = reports.daily_usage(_billed(spark, sf_dir), "timestamp")
    return r.select(F.col("day").cast("string").alias("day"), "checks", _usd("spend").alias("spend"))


@query
def daily_spend(spark, sf_dir):
    return reports.daily_spend(_billed(spark, sf_dir), "2024-01-07", "timestamp").select(_usd("spend").alias("spend"))


@query
def usage_by_tool(spark, sf_dir):
    return reports.usage_by_tool(views.history(spark, sf_dir)).withColumn("cost", _usd("cost"))


@query
def usage_by_tool_of_day(spark, sf_dir):
    return reports.usage_by_tool(views.history(spark, sf_dir), day="2024-01-07").withColumn("cost", _usd("cost"))


@query
def block_reasons(spark, sf_dir):
    return reports.block_reasons(views.history(spark, sf_dir))


@query
def traffic_stats(spark, sf_dir):
    return reports.traffic_stats(_log(spark, sf_dir)).withColumn("total_cost_usd", _usd("total_cost_usd"))


@query
def violations_by_type(spark, sf_dir):
    return reports.violations_by_type(_log(spark, sf_dir))


@query
def violation_share(spark, sf_dir):
    return reports.violation_share(_log(spark, sf_dir))


@query
def recent_events(spark, sf_dir):
    rows = views.read(spark, sf_dir, "events")
    return reports.recent_events(rows, 50, "ts", "event_id").select("event_id", "event_type")


@query
def tail_events(spark, sf_dir):
    rows = views.read(spark, sf_dir, "events")
    return reports.tail_events(rows, 20, "2024-01-09", "ts", "event_id").select("event_id", "event_type")


@query
def token_totals(spark, sf_dir):
    return reports.token_totals(_log(spark, sf_dir)).withColumn("cost", _usd("cost"))


@query
def session_spend(spark, sf_dir):
    return reports.session_spend(_governed(spark, sf_dir)).withColumn("spend", _usd("spend"))


@query
def cost_report(spark, sf_dir):
    return reports.cost_report(_governed(spark, sf_dir), "support").withColumn("total_cost", _usd("total_cost"))


# --- streams ------------------------------------------------------------------


def _stream(spark, sf_dir, table: str) -> DataFrame:
    schema = views.read(spark, sf_dir, table).schema
    # A streaming file source lists folders or patterns, not single files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}*.parquet")


def _history_stream(spark, sf_dir) -> DataFrame:
    """The history view as a log on disk, tailed."""
    path = scratch_path(spark, "history-log")
    logs.write_history(_history_lines(spark, sf_dir), path)
    rows = logs.good_lines(streams.stream_history(spark, path))
    return rows.withColumns({
        "timestamp": F.col("timestamp").cast("timestamp"), "cost_usd": F.col("cost_usd").cast("decimal(18,6)")
    })


def _event_stream(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "events-log")
    logs.write_guard_events(_history_events(spark, sf_dir), path)
    return logs.good_lines(streams.stream_guard_events(spark, path)).drop("day")


def _snapshot(spark, df: DataFrame, keys: list[str], mode: str = "complete") -> DataFrame:
    out = scratch_path(spark, "snapshots")
    streams.run_to_snapshots(df, out, scratch_path(spark, "checkpoint"), mode, keys=keys).awaitTermination()
    return streams.latest_snapshot(spark, out, keys)


@query
def guard_event_stream(spark, sf_dir):
    out = scratch_path(spark, "tail")
    flat = _event_stream(spark, sf_dir).select("event", F.col("metadata.input_tokens").alias("tokens"))
    streams.run_to_table(flat, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query
def stream_daily_usage(spark, sf_dir):
    rows = streams.stream_daily_usage(_history_stream(spark, sf_dir), "timestamp", lateness=None)
    r = _snapshot(spark, rows, ["day"], "update")
    return r.select(F.col("day").cast("string").alias("day"), "checks", _usd("spend").alias("spend"))


@query
def stream_daily_usage_live(spark, sf_dir):
    """Four runs of days, one micro-batch each, under a watermark of one day; nothing is late."""
    source = scratch_path(spark, "live")
    rows = _history_lines(spark, sf_dir).select(F.col("timestamp").cast("timestamp").alias("ts"), F.col("cost_usd").cast("decimal(18,6)").alias("cost_usd"))
    day = F.to_date("ts")
    first, last = rows.select(F.min(day), F.max(day)).first()
    part = F.floor(F.date_diff(day, F.lit(first)) * 4 / ((last - first).days + 1))
    for k in range(4):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    r = _snapshot(spark, streams.stream_daily_usage(live, lateness="1 day"), ["day"], "update")
    return r.select(F.col("day").cast("string").alias("day"), "checks", _usd("spend").alias("spend"))


@query
def rewritten_event_log(spark, sf_dir):
    """A log in two batches, the first written twice, beside a batch that was never finished."""
    path = scratch_path(spark, "batched-log")
    events = _history_events(spark, sf_dir)
    early = F.pmod(F.xxhash64("timestamp"), F.lit(2)) == 0
    for part, batch in ((events.where(early), "a"), (events.where(~early), "b"), (events.where(early), "a")):
        logs.write_guard_events(part, path, batch)
    events.withColumn("day", F.to_date(F.col("timestamp").cast("timestamp"))).write.partitionBy("day").json(f"{path}/batch=unfinished")
    flat = logs.good_lines(logs.read_guard_events(spark, path)).select("event", F.col("metadata.input_tokens").alias("tokens"))
    return flat.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query
def stream_usage_by_tool(spark, sf_dir):
    rows = streams.stream_usage_by_tool(_history_stream(spark, sf_dir), lateness=None)
    r = _snapshot(spark, rows, ["day", "tool"], "update")
    return r.select(F.col("day").cast("string").alias("day"), "tool", "requests", _usd("cost").alias("cost"), "tokens", "blocked")


@query
def stream_traffic_stats(spark, sf_dir):
    r = _snapshot(spark, streams.stream_traffic_stats(_event_stream(spark, sf_dir)), ["kind", "name"])
    return r.select("kind", "name", "n", _usd("cost").alias("cost"), "input_tokens")


@query
def stream_guard(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents")
    requests = req.single_turn_requests(docs, "text").select(
        "doc_id", "messages", F.lit("default").alias("agent_id"), F.lit("").alias("answer")
    )
    out = scratch_path(spark, "guarded")
    guarded = streams.stream_guard(requests).select("doc_id", "guard.allowed")
    streams.run_to_table(guarded, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_event_sink(spark, sf_dir):
    out = scratch_path(spark, "sink")
    streams.stream_event_sink(_event_stream(spark, sf_dir), out, scratch_path(spark, "checkpoint")).awaitTermination()
    rows = logs.good_lines(logs.read_guard_events(spark, out))
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# Requests of one file: what a task writes and later scores.
REQUESTS_PER_FILE = 1000


def _write_parts(rows: DataFrame, path: str, parts: int = 3) -> int:
    """Deal requests by their ids into parts that are appended one after the other; the number of files of each."""
    files = max(1, -(-rows.count() // (parts * REQUESTS_PER_FILE)))
    part = F.pmod(F.xxhash64("request_id"), F.lit(parts))
    for k in range(parts):
        mine = rows.where(part == k)
        (mine.coalesce(1) if files == 1 else mine.repartition(files)).write.mode("append").parquet(path)
    return files


@query
def stream_budget_gate(spark, sf_dir):
    source = scratch_path(spark, "requests")
    # Three shuffled parts: each is a micro-batch with rows of every day, of
    # which many stand before rows that are decided already.
    rows = materialize(views.requests(spark, sf_dir), "stream-requests")
    files = _write_parts(rows, source)
    requests = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
    gate, running = streams.stream_budget_gate(
        requests, scratch_path(spark, "gate"), scratch_path(spark, "checkpoint"), _policies(spark)
    )
    running.awaitTermination()
    return gate.decisions().select(
        "request_id", "blocked", _vs("violations").alias("violations"), _usd("cost_usd").alias("cost_usd"),
        _usd("spend_before").alias("spend_before"),
    )


# --- declared controls ----------------------------------------------------------


@query
def session_limit_gate(spark, sf_dir):
    """Every tenth user has no session."""
    user = F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string"))
    rows = _gate_rows(spark, sf_dir).withColumn("session_id", user)
    return _decisions(extras.session_limit_gate(rows, "event_id", "ts", F.col("estimate"), F.col("cost"), _dollars("0.500000")))


@query
def monthly_budget_gate(spark, sf_dir):
    return _decisions(
        extras.monthly_budget_gate(_gate_rows(spark, sf_dir), "event_id", "ts", F.col("estimate"), F.col("cost"), _dollars("50.000000"))
    )


@query
def auto_downgrade(spark, sf_dir):
    """Past the threshold a row moves to a model at a quarter of the cost."""
    rows = _gate_rows(spark, sf_dir)
    quarter = (F.floor(F.col("cost") * 250000).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")
    out = budget.auto_downgrade(
        rows, F.to_date("ts"), "event_id", "ts", F.col("cost"), _dollars(EVENT_BUDGET),
        model=F.lit("gpt-4o"), target="gpt-4o-mini", target_cost=quarter,
    )
    return out.withColumn("cost", _usd("cost"))


@query
def prompt_loops(spark, sf_dir):
    """User turns; every fourth conversation repeats each of them five times."""
    users = views.read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    copies = F.when(F.col("conv_id") % 4 == 0, F.sequence(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    rows = users.select("conv_id", "turn", "text", F.explode(copies).alias("r")).select(
        "conv_id", (F.col("turn") * 10 + F.col("r")).alias("turn"),
        F.when(F.col("r") == 0, F.col("text")).otherwise(F.concat("text", F.lit(" again"))).alias("text"),
    )
    return extras.detect_loops(rows, "conv_id", "turn")


@query
def tool_access(spark, sf_dir):
    rows = spark.createDataFrame(list(TOOL_POLICIES), "agent_id string, tool string, allowed boolean, denied boolean")
    agent = F.when(F.col("user_id") % 3 == 0, F.lit("support")).when(F.col("user_id") % 3 == 1, F.lit("research"))
    calls = views.read(spark, sf_dir, "events").select(
        "event_id", agent.otherwise(F.lit("default")).alias("agent_id"), F.col("event_type").alias("tool")
    )
    return extras.tool_access(calls, rows).select("event_id", "permitted")


def _agent_of_user() -> Column:
    return F.when(F.col("user_id") % 3 == 0, "support").when(F.col("user_id") % 3 == 1, "research").otherwise("default")


@query
def rate_limit(spark, sf_dir):
    """Limits differ by agent, and some tools have two."""
    limits = spark.createDataFrame(list(RATE_LIMITS), "agent_id string, tool string, max_calls int, per string, cooldown_seconds int")
    calls = views.read(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), _agent_of_user().alias("agent_id")
    )
    return extras.rate_limit(calls, limits, agent="agent_id").withColumn("max_calls", _n(F.col("max_calls")))


@query
def invalid_args(spark, sf_dir):
    rules = spark.createDataFrame(
        list(ARG_RULES), "agent_id string, tool string, arg string, type string, pattern string, values array<string>"
    )
    calls = views.read(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("tool"), F.col("props").alias("args_json"), _agent_of_user().alias("agent_id")
    )
    return extras.validate_args(calls, rules, agent="agent_id")


@query
def competitor_mentions(spark, sf_dir):
    rows = views.read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return rows.select("conv_id", "turn", _n(F.size(extras.competitor_mentions("text", COMPETITORS))).alias("n_terms"))


@query
def high_severity_events(spark, sf_dir):
    rows = extras.filter_log_level(_governed(spark, sf_dir), "HIGH_SEVERITY")
    severe = F.filter("violations", lambda v: v["severity"].isin("high", "critical"))
    return rows.select("request_id", _n(F.size(severe)).alias("n"))


@query
def retained_events(spark, sf_dir):
    path = scratch_path(spark, "events-log")
    logs.write_guard_events(_history_events(spark, sf_dir), path)
    extras.apply_retention(spark, path, retention_days=9, today=dt.date(2024, 1, 30))
    rows = logs.good_lines(logs.read_guard_events(spark, path))
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def token_warnings(spark, sf_dir):
    rows = _shrunk(spark, sf_dir)
    return rows.select("request_id", extras.warn_token_pct("input_tokens", F.col("policy")).alias("warned"))
