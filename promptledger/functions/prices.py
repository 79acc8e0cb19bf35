"""Model prices and cost estimates."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MONEY, PRICE_SCHEMA
from ..storage import broadcast_if_small, materialize
from .text import col, int_div

# A CASE over this many rows is still cheap; beyond it prices are joined.
MAX_INLINE_PRICES = 256


@dataclass(frozen=True)
class Price:
    model: str
    ordinal: int
    in_per_1k: Decimal
    out_per_1k: Decimal


# Model, place in the list, US dollars per 1000 input tokens, per 1000 output tokens.
DEFAULT_PRICES: tuple[Price, ...] = (
    Price("gpt-4o", 0, Decimal("0.005"), Decimal("0.015")),
    Price("gpt-4o-mini", 1, Decimal("0.00015"), Decimal("0.0006")),
    Price("gpt-4-turbo", 2, Decimal("0.01"), Decimal("0.03")),
    Price("gpt-4", 3, Decimal("0.03"), Decimal("0.06")),
    Price("gpt-3.5-turbo", 4, Decimal("0.0005"), Decimal("0.0015")),
    Price("claude-3-5-haiku", 5, Decimal("0.0008"), Decimal("0.004")),
    Price("claude-3-5-sonnet", 6, Decimal("0.003"), Decimal("0.015")),
    Price("claude-3-opus", 7, Decimal("0.015"), Decimal("0.075")),
    Price("claude-3-haiku", 8, Decimal("0.00025"), Decimal("0.00125")),
    Price("gemini-1-5-pro", 9, Decimal("0.00125"), Decimal("0.005")),
    Price("gemini-1-5-flash", 10, Decimal("0.000075"), Decimal("0.0003")),
    Price("gemini-2.0-flash", 11, Decimal("0.0001"), Decimal("0.0004")),
    Price("gemini-2.0-flash-lite", 12, Decimal("0.0"), Decimal("0.0")),
)

# Fixed value: the row used for a model that matches nothing.
FALLBACK_MODEL = "gpt-4o-mini"


def prices_frame(spark: SparkSession, prices: Sequence[Price] = DEFAULT_PRICES) -> DataFrame:
    rows = [(p.model, p.ordinal, p.in_per_1k, p.out_per_1k) for p in prices]
    return spark.createDataFrame(rows, PRICE_SCHEMA)


def load_prices(prices: DataFrame | Sequence[Price] | None) -> list[Price] | None:
    """Price rows for inlining, or None when the frame is too long to inline."""
    if prices is None:
        return list(DEFAULT_PRICES)
    if not isinstance(prices, DataFrame):
        rows = list(prices)
        return rows if len(rows) <= MAX_INLINE_PRICES else None
    rows = prices.select("model", "ordinal", "in_per_1k", "out_per_1k").take(MAX_INLINE_PRICES + 1)
    if len(rows) > MAX_INLINE_PRICES:
        return None
    return [Price(*r) for r in rows]


def _nano(value: Decimal) -> int:
    return int(value * 10**9)


_PRICE = "struct<price_model:string,in_nano:bigint,out_nano:bigint>"


def _price_rows(prices: Sequence[Price]) -> Column:
    """Price rows as an array constant."""
    rows = [
        {"price_model": p.model, "in_nano": _nano(p.in_per_1k), "out_nano": _nano(p.out_per_1k)} for p in prices
    ]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{_PRICE}>")


def price_of(model: Column | str, prices: Sequence[Price] = DEFAULT_PRICES, rule: str = "longest_prefix") -> Column:
    """Price struct of a model, looked up in a constant: no join, no shuffle.

    ``longest_prefix`` tries longer names first, so an exact name always wins.
    ``first`` is exact match, then the first prefix by ``ordinal``.
    """
    model = F.coalesce(col(model), F.lit(""))
    if rule == "longest_prefix":
        ordered = sorted(prices, key=lambda p: (-len(p.model), p.ordinal))
    elif rule == "first":
        ordered = sorted(prices, key=lambda p: p.ordinal)
    else:
        raise ValueError(f"unknown price rule {rule!r}")
    fallback = [p for p in prices if p.model == FALLBACK_MODEL]
    if not fallback:
        raise ValueError(f"the price table needs a {FALLBACK_MODEL} row")
    rows = _price_rows(ordered)
    found = F.get(F.filter(rows, lambda p: F.startswith(model, p["price_model"])), F.lit(0))
    if rule == "first":
        found = F.coalesce(F.get(F.filter(rows, lambda p: p["price_model"] == model), F.lit(0)), found)
    return F.coalesce(found, _price_rows(fallback)[0])


def resolve_price(
    df: DataFrame,
    prices: DataFrame | Sequence[Price] | None = None,
    model: str = "model",
    rule: str = "longest_prefix",
) -> DataFrame:
    """Add the ``price`` struct for each row's model (T5)."""
    rows = load_prices(prices)
    if rows is not None:
        return df.withColumn("price", price_of(model, rows, rule))
    frame = prices if isinstance(prices, DataFrame) else prices_frame(df.sparkSession, prices)
    return _join_prices(df, frame, model, rule)


def _join_prices(df: DataFrame, prices: DataFrame, model: str, rule: str) -> DataFrame:
    """Long price tables: expand each distinct model to its prefixes and equi-join.

    Only distinct models are expanded, so a model holding most rows costs one
    row here.  The way back is a broadcast when the distinct models are few, and
    otherwise an equi-join that adaptive execution splits where it is skewed.
    """
    p = prices.select(
        F.col("model").alias("price_model"),
        F.col("ordinal"),
        (F.col("in_per_1k") * 1000000000).cast("long").alias("in_nano"),
        (F.col("out_per_1k") * 1000000000).cast("long").alias("out_nano"),
    )
    models = df.select(F.coalesce(F.col(model), F.lit("")).alias("_m")).distinct()
    prefixes = models.select(
        "_m", F.explode(F.sequence(F.lit(0), F.length("_m"))).alias("_n")
    ).select("_m", F.expr("left(_m, _n)").alias("price_model"))
    exact = F.col("price_model") == F.col("_m")
    length = F.length("price_model")
    rank = (
        F.struct(length, -F.col("ordinal"))
        if rule == "longest_prefix"
        else F.struct(exact.cast("int"), -F.col("ordinal"))
    )
    price = F.struct("price_model", "in_nano", "out_nano")
    best = (
        prefixes.join(p, "price_model").groupBy("_m").agg(F.max_by(price, rank).alias("price"))
    )
    fallback = prices.where(F.col("model") == FALLBACK_MODEL).select("model", "ordinal", "in_per_1k", "out_per_1k").take(1)
    default = _price_rows([Price(*fallback[0])])[0]
    joined = df.withColumn("_m", F.coalesce(F.col(model), F.lit(""))).join(broadcast_if_small(best), "_m", "left")
    return joined.withColumn("price", F.coalesce("price", default)).drop("_m")


def cost_micros(tokens_in: Column, tokens_out: Column, price: Column) -> Column:
    """Cost in whole micro-dollars, rounded half up, in 64-bit integers."""
    nano = tokens_in.cast("long") * price["in_nano"] + tokens_out.cast("long") * price["out_nano"]
    return int_div(nano + 500000, 1000000)


def micros_to_money(micros: Column) -> Column:
    return (micros.cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).cast(MONEY)


def estimate_cost(tokens_in: Column | str, tokens_out: Column | str, price: Column | str = "price") -> Column:
    """Cost in dollars rounded to six places (T6), as ``decimal(18,6)``."""
    return micros_to_money(cost_micros(col(tokens_in), col(tokens_out), col(price)))


def model_cost_matrix(
    df: DataFrame,
    prices: DataFrame | Sequence[Price] | None = None,
    tokens_in: str = "input_tokens",
    tokens_out: str = "output_tokens",
    block: int = MAX_INLINE_PRICES,
) -> DataFrame:
    """What all requests would cost under every priced model.

    Up to ``block`` prices are one aggregate with a sum per model.  More of them
    are joined with a histogram of the different (input, output) token counts:
    costs are rounded for each request, so a pair's cost counts as often as it
    occurs.  The requests are read once and never multiplied by the models, and
    the number of jobs depends on neither; a price frame stays a table.
    """
    i, o = F.col(tokens_in).cast("long"), F.col(tokens_out).cast("long")
    if prices is not None and not isinstance(prices, DataFrame):
        prices = list(prices)
    short = load_prices(prices)
    if short is not None and len(short) <= block:
        return _cost_rows(df.select(i.alias("i"), o.alias("o"), F.lit(1).alias("n")), short)
    pairs = df.groupBy(i.alias("i"), o.alias("o")).agg(F.count(F.lit(1)).alias("n"))
    # No request at all is a row, too: every model has a total.
    none = df.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(c) for c in ("i", "o", "n")))
    offered = prices if isinstance(prices, DataFrame) else short if prices is None else prices
    return _joined_costs(materialize(pairs.unionByName(none), "token-pairs"), _nano_prices(df.sparkSession, offered))


def _nano_prices(spark: SparkSession, prices: DataFrame | Sequence[Price]) -> DataFrame:
    """``model, price`` of each row, numbered by ``row``: models may repeat."""
    if isinstance(prices, DataFrame):
        nano = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("a price is null"))).otherwise((F.col(c) * 1000000000).cast("long"))
        rows = prices.select("model", nano("in_per_1k").alias("in_nano"), nano("out_per_1k").alias("out_nano"))
    else:
        held = [(p.model, _nano(p.in_per_1k), _nano(p.out_per_1k)) for p in prices]
        rows = spark.createDataFrame(held, "model string, in_nano long, out_nano long")
    rows = rows.select("model", F.struct("in_nano", "out_nano").alias("price"))
    # Few rows of a small file would be one task of the product with the pairs.
    dealt = rows.repartition(spark.sparkContext.defaultParallelism).withColumn("row", F.monotonically_increasing_id())
    return materialize(dealt, "prices")


def _joined_costs(pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per price, as ``_cost_rows``, where the prices are a table."""
    n = F.col("n")
    each = prices.select("row", "price").crossJoin(broadcast_if_small(pairs))
    sums = each.groupBy("row").agg(
        F.sum(n).alias("requests"), F.sum(cost_micros(F.col("i"), F.col("o"), F.col("price")) * n).alias("micros")
    )
    return prices.select("row", "model").join(sums, "row").select("model", "requests", micros_to_money(F.col("micros")).alias("total_cost"))


def _cost_rows(pairs: DataFrame, prices: Sequence[Price]) -> DataFrame:
    """One row per price: sums over ``i, o, n``, where ``n`` requests have ``i`` and ``o`` tokens."""
    i, o, n = F.col("i"), F.col("o"), F.col("n")
    sums = [F.sum(cost_micros(i, o, _price_rows([p])[0]) * n).alias(f"m{k}") for k, p in enumerate(prices)]
    totals = pairs.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("requests"), *sums)
    cells = F.array(
        *[F.struct(F.lit(p.model).alias("model"), F.col(f"m{k}").alias("micros")) for k, p in enumerate(prices)]
    )
    return totals.select("requests", F.explode(cells).alias("c")).select(
        F.col("c.model").alias("model"),
        "requests",
        micros_to_money(F.coalesce("c.micros", F.lit(0).cast("long"))).alias("total_cost"),
    )
