"""Token counts of requests by a real tokenizer.

A tokenizer is an Arrow UDF from text to a count.  Requests repeat the turns of
their conversation, so every different message text is tokenised once, and the
counts meet the requests again by digest.  Nothing but digests and counts is
joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import Tokenizer, uses_estimate, word_estimate
from ..storage import materialize


def with_message_tokens(
    df: DataFrame, name: str, tokenizer: Tokenizer, key: str = "request_id", messages: str = "messages", model: str = "model"
) -> DataFrame:
    """``df`` with ``name``: the tokens of each row's ``messages``.

    Roles and the messages' overhead count as in ``count_message_tokens``.
    Models of the estimated families, and texts on which the tokenizer yields
    null, count by the word estimate.  ``df`` is read three times and should be
    a stored table; ``key`` is unique.
    """
    zero = F.lit(0).cast("long")
    m = df.select(F.col(key).alias("_key"), uses_estimate(F.col(model)).alias("_estimated"), F.explode(messages).alias("m"))
    content = F.col("m.content")
    # What needs no tokenizer: the role, the overhead, and texts of estimated families.
    role = F.when(F.col("m.role").isNull(), zero).otherwise(word_estimate(F.col("m.role")))
    text = F.when(content.isNull() | ~F.col("_estimated"), zero).otherwise(word_estimate(content))
    digest = F.when(~F.col("_estimated"), F.md5(content))
    rows = m.select("_key", (role + text + F.lit(4).cast("long")).alias("_n"), digest.alias("_digest"))
    fresh = m.where(~F.col("_estimated") & content.isNotNull()).select(content.alias("_text")).distinct()
    # An empty text has no tokens of its own, and counts like an empty word estimate.
    exact = F.when(F.length("_text") == 0, word_estimate(F.col("_text"))).otherwise(F.coalesce(F.col("_exact"), word_estimate(F.col("_text"))))
    counted = fresh.withColumn("_exact", tokenizer(F.col("_text")).cast("long")).select(F.md5("_text").alias("_digest"), exact.alias("_t"))
    counted = materialize(counted, "token-counts")
    total = (
        rows.join(counted, "_digest", "left").groupBy("_key")
        .agg((F.sum(F.col("_n") + F.coalesce("_t", zero)) + 2).alias("_total"))
    )
    joined = df.join(total, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return joined.withColumn(name, F.coalesce("_total", zero)).drop("_total")
