from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptledger.functions import prices, tokens
from promptledger.functions.text import BLOCK, is_blank, slice_text, text_blocks, word_count
from promptledger.schemas import MESSAGES

TEXTS = [
    "", " ", "one", "two words", " lead and trail ", "tabs\tand\nlines\r\n", "a\x1cb\x1dc\x1ed\x1fe", "nb\xa0sp",
    "thin space　wide", "zero​width", "x " * 999, "é ß 漢字 🙂 ok", "\x85next", None,
]


def estimate(text: str) -> int:
    return max(1, int(len(text.split()) * 1.3))


def test_words_and_tokens_agree_with_python(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "id int, t string")
    rows = df.select(
        "t", word_count(F.col("t")).alias("w"), is_blank(F.col("t")).alias("b"),
        tokens.word_estimate("t").alias("e"), tokens.count_tokens("t").alias("c"),
    ).collect()
    for r in rows:
        assert r.b == (not (r.t or "").strip())
        if r.t is None:
            assert r.c == 0
            continue
        assert r.w == len(r.t.split())
        assert r.e == estimate(r.t)
        assert r.c == (0 if r.t == "" else estimate(r.t))


def test_whitespace_only_text_counts_one(spark):
    assert spark.range(1).select(tokens.count_tokens(F.lit("  \n"))).first()[0] == 1


def test_slices_of_long_text(spark):
    text = "".join(chr(0x61 + i % 26) + ("é" if i % 7 == 0 else "🙂" if i % 11 == 0 else "") for i in range(3 * BLOCK))
    cuts = [(0, 5), (BLOCK - 2, BLOCK + 3), (10, 10), (BLOCK, 2 * BLOCK), (BLOCK - 1, 2 * BLOCK + 1), (len(text) - 4, len(text))]
    df = spark.createDataFrame([(text, s, e) for s, e in cuts], "t string, s int, e int")
    got = df.select("s", "e", slice_text(text_blocks(F.col("t")), F.col("s"), F.col("e")).alias("x")).collect()
    assert [(r.s, r.e, r.x) for r in got] == [(s, e, text[s:e]) for s, e in cuts]


def messages(spark, *lists):
    rows = [(n, [{"role": r, "content": c} for r, c in m] if m is not None else None) for n, m in enumerate(lists)]
    return spark.createDataFrame(rows, f"id int, messages {MESSAGES}")


def test_message_tokens_and_text(spark):
    df = messages(spark, [("user", "one two three"), ("assistant", "")], [], None, [("user", " \n"), ("system", "a"), ("user", "b")])
    got = df.orderBy("id").select(
        tokens.count_message_tokens("messages").alias("n"), tokens.messages_to_text("messages").alias("t")
    ).collect()
    assert got[0].n == 1 + 3 + 4 + 1 + 1 + 4 + 2
    assert got[1].n == 0 and got[2].n == 0
    assert got[3].t == "a\nb"


def test_tokenizer_hook_with_fallback(spark):
    @F.pandas_udf("long")
    def letters(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if "?" in x else len(x)).astype("Int64")

    df = spark.createDataFrame([("abcd", "gpt-4o"), ("abcd", "Claude-3"), ("no?", "gpt-4o"), ("", "gpt-4o")], "t string, m string")
    got = [r[0] for r in df.select(tokens.count_tokens("t", "m", letters)).collect()]
    assert got == [4, 1, 1, 0]


MODELS = ["gpt-4o", "gpt-4o-2024-08-06", "gpt-4o-mini-2024-07-18", "gpt-4-turbo-preview", "gpt-4-0613", "nobody", "gemini-2.0-flash-lite", "", None]


def test_price_rules(spark):
    df = spark.createDataFrame([(m,) for m in MODELS], "model string")
    got = {r[0]: (r[1], r[2]) for r in df.select(
        "model", prices.price_of("model")["price_model"], prices.price_of("model", rule="first")["price_model"]
    ).collect()}
    assert got["gpt-4o-2024-08-06"] == ("gpt-4o", "gpt-4o")
    assert got["gpt-4o-mini-2024-07-18"] == ("gpt-4o-mini", "gpt-4o")
    assert got["gpt-4-turbo-preview"][0] == "gpt-4-turbo"
    assert got["gpt-4-0613"][0] == "gpt-4"
    assert got["gemini-2.0-flash-lite"] == ("gemini-2.0-flash-lite", "gemini-2.0-flash-lite")
    assert got["nobody"] == got[None] == got[""] == ("gpt-4o-mini", "gpt-4o-mini")


@pytest.mark.parametrize("rule", ["longest_prefix", "first"])
def test_long_price_tables_are_joined_with_the_same_result(spark, rule):
    extra = [prices.Price(f"other-{n}", 100 + n, Decimal("0.001"), Decimal("0.002")) for n in range(prices.MAX_INLINE_PRICES)]
    table = prices.prices_frame(spark, list(prices.DEFAULT_PRICES) + extra)
    assert prices.load_prices(table) is None
    df = spark.createDataFrame([(m,) for m in MODELS + ["other-12x"]], "model string")
    joined = prices.resolve_price(df, table, rule=rule).select("model", "price.price_model").collect()
    want = prices.price_of("model", list(prices.DEFAULT_PRICES) + extra, rule)["price_model"]
    inline = df.select("model", want).collect()
    assert sorted(map(tuple, joined), key=repr) == sorted(map(tuple, inline), key=repr)


def test_costs_round_half_up_to_six_places(spark):
    cases = [(0, 0), (1, 0), (1000, 1000), (123457, 89), (7, 13), (10**9, 10**8), (3, 1)]
    for p in prices.DEFAULT_PRICES:
        df = spark.createDataFrame([(p.model, i, o) for i, o in cases], "model string, i long, o long")
        got = prices.resolve_price(df).select("i", "o", prices.estimate_cost("i", "o")).collect()
        for i, o, cost in got:
            exact = (Decimal(i) * p.in_per_1k + Decimal(o) * p.out_per_1k) / 1000
            assert cost == exact.quantize(Decimal("0.000001"), ROUND_HALF_UP)


def test_cost_matrix(spark):
    df = spark.createDataFrame([(1000, 500), (20, 30)], "input_tokens long, output_tokens long")
    got = {r.model: (r.requests, r.total_cost) for r in prices.model_cost_matrix(df).collect()}
    assert len(got) == len(prices.DEFAULT_PRICES)
    assert got["gpt-4"] == (2, Decimal("0.062400"))
    assert got["gemini-2.0-flash-lite"] == (2, Decimal(0))


def test_cost_matrix_of_any_number_of_prices(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 9), rng.randint(0, 4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "input_tokens long, output_tokens long")
    many = [prices.Price(f"m{k}", k, Decimal(k) / 1000, Decimal(3 * k) / 1000) for k in range(2000)]
    got = {r.model: (r.requests, r.total_cost) for r in prices.model_cost_matrix(df, prices.prices_frame(spark, many)).collect()}
    assert len(got) == 2000
    for p in many[::97]:
        each = [((Decimal(i) * p.in_per_1k + Decimal(o) * p.out_per_1k) / 1000).quantize(Decimal("0.000001"), ROUND_HALF_UP) for i, o in rows]
        assert got[p.model] == (300, sum(each))
    few = prices.model_cost_matrix(df, many[:30], block=7)
    assert {r.model: (r.requests, r.total_cost) for r in few.collect()} == {p.model: got[p.model] for p in many[:30]}


def test_jobs_of_a_cost_matrix_do_not_grow_with_the_prices(spark):
    df = spark.createDataFrame([(1000, 500), (20, 30), (20, 30), (7, None)], "input_tokens long, output_tokens long")
    many = [prices.Price(f"m{k // 2}", k, Decimal(k // 2) / 1000, Decimal(k // 2) / 500) for k in range(120)]
    spark.sparkContext.setJobGroup("cost-matrix", "cost matrix")
    try:
        got = prices.model_cost_matrix(df, prices.prices_frame(spark, many), block=2).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cost-matrix"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40  # blocks of two prices, one after the other, were 60
    want = prices.model_cost_matrix(df, many, block=200).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 120
    none = prices.model_cost_matrix(df.limit(0), prices.prices_frame(spark, many), block=2).collect()
    assert {(r.requests, r.total_cost) for r in none} == {(0, Decimal(0))} and len(none) == 120
