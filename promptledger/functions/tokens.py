"""Token estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, int_div, is_blank, word_count

Tokenizer = Callable[[Column], Column]

# Model families that never use the byte-pair tokenizer.
ESTIMATED_FAMILIES = ("gemini", "claude", "anthropic", "llama", "mistral")


def word_estimate(text: Column | str) -> Column:
    """``max(1, floor(words * 1.3))``; integer form, exact for every count."""
    words = word_count(col(text)).cast("long")
    return F.greatest(F.lit(1).cast("long"), int_div(words * 13, 10))


def uses_estimate(model: Column) -> Column:
    lowered = F.lower(F.coalesce(model, F.lit("")))
    test = F.lit(False)
    for family in ESTIMATED_FAMILIES:
        test = test | lowered.contains(family)
    return test


def _one_text(text: Column, model: Column | None, tokenizer: Tokenizer | None) -> Column:
    if tokenizer is None:
        return word_estimate(text)
    # A tokenizer that yields null has failed on that row: fall back.
    exact = F.coalesce(tokenizer(text).cast("long"), word_estimate(text))
    if model is None:
        return exact
    return F.when(uses_estimate(model), word_estimate(text)).otherwise(exact)


def count_tokens(
    text: Column | str, model: Column | str | None = None, tokenizer: Tokenizer | None = None
) -> Column:
    """Tokens of one text; null and empty count 0.

    ``tokenizer`` may be an Arrow UDF (text -> count).  It is consulted only for
    models outside ``ESTIMATED_FAMILIES``.
    """
    text = col(text)
    model = None if model is None else col(model)
    empty = F.coalesce(F.length(text) == 0, F.lit(True))
    return F.when(empty, F.lit(0).cast("long")).otherwise(_one_text(text, model, tokenizer))


def count_message_tokens(messages: Column | str) -> Column:
    """Tokens of a chat request: role and content of every message, 4 per message, 2 on top."""
    messages = col(messages)
    total = F.aggregate(
        messages,
        F.lit(2).cast("long"),
        lambda acc, m: acc
        + F.when(m["role"].isNull(), F.lit(0).cast("long")).otherwise(word_estimate(m["role"]))
        + F.when(m["content"].isNull(), F.lit(0).cast("long")).otherwise(word_estimate(m["content"]))
        + F.lit(4).cast("long"),
    )
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.lit(0).cast("long")).otherwise(total)


def messages_to_text(messages: Column | str) -> Column:
    """Non-blank contents of all roles joined by a newline."""
    return F.array_join(
        F.filter(F.transform(col(messages), lambda m: m["content"]), lambda c: ~is_blank(c)), "\n"
    )
