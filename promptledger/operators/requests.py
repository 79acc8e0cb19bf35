"""Chat requests as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, is_blank
from ..schemas import MESSAGES
from ..storage import broadcast_if_small

# Turns gathered into one array by one group.
TURN_BLOCK = 256


def conversations_to_requests(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One request per assistant turn: all earlier turns, and that turn as the answer.

    Turns are gathered per (conversation, block of ``TURN_BLOCK`` turn numbers),
    so no group grows with a long conversation.  When every turn number falls
    into one block, which the smallest and largest one tell, that is all: one
    shuffle.  Otherwise later blocks are prefixed with the blocks before them,
    again keyed by (conversation, block), so a very long conversation is spread
    over as many tasks as it has blocks.  The prefix of a block is a part of
    each of its requests, hence never larger than a result row.
    """
    block = F.floor(F.col(turn) / TURN_BLOCK).cast("long")
    # A struct key equals itself even when the conversation id is null.
    rows = df.select(F.struct(conv).alias("_conv"), block.alias("_block"), F.struct(turn, role, text).alias("_m"))
    blocks = _gather(rows, role, text)
    ends = df.agg(F.min(block).alias("lo"), F.max(block).alias("hi")).first()
    if ends["lo"] == ends["hi"]:
        blocks = blocks.withColumn("_before", F.lit(None).cast(MESSAGES))
    else:
        # Both sides are already laid out by (conversation, block).
        blocks = blocks.join(_prefixes(rows, role, text), ["_conv", "_block"], "left")
    asked = F.filter(
        F.transform("_turns", lambda m, i: F.struct(i.alias("pos"), m.alias("m"))), lambda x: x["m"][role] == "assistant"
    )
    requests = blocks.select("_conv", "_before", "_own", F.explode(asked).alias("_t"))
    own = F.slice("_own", F.lit(1), F.col("_t.pos"))
    return requests.select(
        F.col(f"_conv.{conv}").alias(conv),
        F.col(f"_t.m.{turn}").alias(turn),
        F.when(F.col("_before").isNull(), own).otherwise(F.concat("_before", own)).cast(MESSAGES).alias("messages"),
        F.col(f"_t.m.{text}").alias("answer"),
    )


def _messages(role: str, text: str) -> Column:
    return F.transform("_turns", lambda m: F.struct(m[role].alias("role"), m[text].alias("content"))).cast(MESSAGES)


def _gather(rows: DataFrame, role: str, text: str) -> DataFrame:
    """One row per (conversation, block): its turns in order, and as messages."""
    gathered = rows.groupBy("_conv", "_block").agg(F.array_sort(F.collect_list("_m")).alias("_turns"))
    return gathered.withColumn("_own", _messages(role, text))


def _prefixes(rows: DataFrame, role: str, text: str) -> DataFrame:
    """``_conv, _block, _before``: all messages before a block, for conversations of several blocks."""
    span = rows.groupBy("_conv").agg(F.min("_block").alias("_lo"), F.max("_block").alias("_hi")).where("_hi > _lo")
    # Only the turns of long conversations are gathered again.
    long_rows = rows.join(broadcast_if_small(span.drop("_lo")), "_conv")
    last = long_rows.groupBy("_conv", "_block").agg(
        F.array_sort(F.collect_list("_m")).alias("_turns"), F.first("_hi").alias("_hi")
    )
    later = F.explode(F.sequence(F.col("_block") + 1, F.col("_hi"))).alias("_to")
    copies = last.where(F.col("_block") < F.col("_hi")).select("_conv", "_block", _messages(role, text).alias("_part"), later)
    parts = copies.groupBy("_conv", "_to").agg(F.array_sort(F.collect_list(F.struct("_block", "_part"))).alias("_parts"))
    return parts.select(
        "_conv",
        F.col("_to").alias("_block"),
        F.flatten(F.transform("_parts", lambda p: p["_part"])).alias("_before"),
    )


def requests_to_messages(df: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per message with its position."""
    return df.select(key, F.posexplode("messages").alias("pos", "m")).select(
        key, "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def single_turn_messages(text: Column | str) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), col(text).alias("content"))).cast(MESSAGES)


def single_turn_requests(df: DataFrame, text_col: str) -> DataFrame:
    """A text column as one-message user requests."""
    return df.withColumn("messages", single_turn_messages(text_col))


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def batch_request_rows(df: DataFrame, style: str = "system_split", max_tokens: int = 1024) -> DataFrame:
    """Rows ready for a batch-inference sink (S9, S10): ``system``, ``turns``, ``body``.

    ``system_split`` keeps system text apart, joined by blank lines, and makes
    the first turn a user turn.  ``role_model`` drops empty contents, joins
    system text by newlines and calls the assistant ``model``.
    """
    messages = F.transform(
        F.col("messages"),
        lambda m: _message(F.coalesce(m["role"], F.lit("user")), F.coalesce(m["content"], F.lit(""))),
    )
    blank_user = F.array(_message(F.lit("user"), F.lit(""))).cast(MESSAGES)
    if style == "system_split":
        parts = F.filter(messages, lambda m: (m["role"] == "system") & ~is_blank(m["content"]))
        joined = F.array_join(F.transform(parts, lambda m: m["content"]), "\n\n")
        turns = F.filter(messages, lambda m: m["role"].isin("user", "assistant")).cast(MESSAGES)
        context = F.array(_message(F.lit("user"), F.lit("(context)"))).cast(MESSAGES)
    elif style == "role_model":
        parts = F.filter(messages, lambda m: (m["role"] == "system") & (m["content"] != ""))
        joined = F.array_join(F.transform(parts, lambda m: m["content"]), "\n")
        kept = F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""))
        turns = F.transform(
            kept,
            lambda m: _message(F.when(m["role"] == "assistant", F.lit("model")).otherwise(F.lit("user")), m["content"]),
        ).cast(MESSAGES)
        context = None
    else:
        raise ValueError(f"unknown request style {style!r}")
    staged = df.withColumn("system", F.nullif(joined, F.lit(""))).withColumn("turns", turns)
    shaped = F.when(F.size("turns") == 0, blank_user)
    if context is not None:
        shaped = shaped.when(F.get("turns", F.lit(0))["role"] != "user", F.concat(context, "turns"))
    staged = staged.withColumn("turns", shaped.otherwise(F.col("turns")))
    if style == "system_split":
        body = F.struct(
            F.col("model"), F.lit(max_tokens).alias("max_tokens"), F.col("turns").alias("messages"), F.col("system")
        )
    else:
        body = F.struct(F.col("model"), F.col("turns").alias("contents"), F.col("system").alias("system_instruction"))
    return staged.withColumn("body", F.to_json(body))
