"""Order-dependent budget admission.

A row is refused when the spend so far plus its estimate exceeds its budget; an
admitted row adds its full cost, a refused row adds nothing.  In order within a
key this is a fold.  Keys of at most ``FOLD_ROWS`` rows are folded: rows are
shuffled and sorted by key, and each partition streams through, holding one
number.  A larger key is never handled by one task:

1.  One running sum of all its costs, taken over range partitions (chunks), is
    exact up to the key's first refusal, and settles a key that stays within
    budget.
2.  Spend never falls, so a later row whose limit (budget - estimate) is below
    the spend at that refusal is refused outright.
3.  What is left of each chunk becomes a step function from the spend before
    it to the spend behind it (``spend``).  All chunks are done at once.
4.  The functions are applied in order, one after the other.  They may have as
    many pieces as rows, so this is done twice: first with outlines of bounded
    size, which give every chunk a narrow range that its spend lies in, then
    with the pieces in that range, which give the spend.
5.  Knowing its spend, every chunk is folded by itself.

The number of jobs does not depend on rows, costs or budgets.

Money is counted in whole micro-dollars, so every order of summation agrees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import micros_to_money
from ..storage import broadcast_if_small, materialize
from .ordered import CHUNK, cut_into_chunks, running_sum
from .spend import NO_LIMIT, Outline, Steps, of_rows, outline

FOLD_ROWS = 200_000

_ORDER = ["_ts", "_id"]


def to_micros(money: Column) -> Column:
    return (money.cast("decimal(18,6)") * 1000000).cast("long")


def budget_gate(
    df: DataFrame,
    key: str | Column,
    row_id: str,
    ts: str,
    estimate: Column,
    cost: Column,
    budget: Column,
    opening: DataFrame | None = None,
    fold_rows: int = FOLD_ROWS,
    chunks: int | None = None,
) -> DataFrame:
    """Decide every row; returns ``row_id, spend_before, over_budget``.

    ``estimate``, ``cost`` and ``budget`` are money columns.  A null budget
    never refuses.  Rows whose cost is 0 are judged but do not change the
    spend.  ``opening`` (key, spend) holds what was spent before these rows.
    Rows are ordered by ``ts`` then ``row_id`` within ``key``.
    """
    key = F.col(key) if isinstance(key, str) else key
    slim = df.select(
        key.alias("_key"),
        F.col(ts).alias("_ts"),
        F.col(row_id).alias("_id"),
        F.coalesce(to_micros(cost), F.lit(0).cast("long")).alias("_cost"),
        (to_micros(budget) - F.coalesce(to_micros(estimate), F.lit(0).cast("long"))).alias("_limit"),
        to_micros(budget).alias("_budget"),
    )
    if opening is not None:
        opened = opening.select(F.col(opening.columns[0]).alias("_k"), to_micros(F.col(opening.columns[1])).alias("_spend"))
        slim = slim.join(broadcast_if_small(opened), F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
        slim = slim.withColumn("_spend", F.coalesce("_spend", F.lit(0).cast("long")))
    else:
        slim = slim.withColumn("_spend", F.lit(0).cast("long"))

    # There are at most (rows / fold_rows) large keys.
    large = slim.groupBy(F.col("_key").alias("_k")).count().where(F.col("count") > fold_rows)
    large = materialize(large, "large-keys")
    rows = large.agg(F.sum("count")).first()[0]
    if rows is None:
        decided = _fold(slim)
    else:
        is_large = F.col("_key").eqNullSafe(F.col("_k"))
        large = broadcast_if_small(large.select("_k"))
        # Chunks of bounded size, however many rows there are.
        chunks = chunks or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // FOLD_ROWS))
        decided = _gate_large(slim.join(large, is_large, "left_semi"), chunks).unionByName(
            _fold(slim.join(large, is_large, "left_anti"))
        )
    return decided.select(
        F.col("_id").alias(row_id), micros_to_money(F.col("_before")).alias("spend_before"), F.col("_over").alias("over_budget")
    )


def _gate_large(slim: DataFrame, chunks: int) -> DataFrame:
    """Decide the rows of large keys: ``_id, _before, _over``."""
    rows = cut_into_chunks(slim.withColumnRenamed("_spend", "_open"), ["_key"], _ORDER, chunks)
    # Without any refusal this sum is already the answer.
    summed = running_sum(rows, ["_key"], _ORDER, F.col("_cost"), "_before")
    summed = materialize(summed.withColumn("_before", F.col("_before") + F.col("_open")), "spend")
    refused = F.col("_before") > F.col("_limit")
    first = (
        summed.where(refused & (F.col("_cost") > 0))
        .groupBy(F.col("_key").alias("_k"))
        .agg(F.min(F.struct("_ts", "_id", "_before")).alias("_f"))
    )
    first = materialize(first, "first-refusal")
    if first.isEmpty():
        return summed.select("_id", "_before", F.coalesce(refused, F.lit(False)).alias("_over"))

    at = F.struct("_ts", "_id")
    marked = summed.join(broadcast_if_small(first), F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
    is_early = F.col("_f").isNull() | (at < F.struct(F.col("_f._ts"), F.col("_f._id")))
    unlimited = F.col("_limit").isNull()
    open_rows = marked.where(
        ~is_early & (F.col("_cost") > 0) & (unlimited | (F.col("_limit") >= F.col("_f._before")))
    ).select("_key", *_ORDER, CHUNK, "_cost", "_limit", F.col("_f._before").alias("_spend"))
    late = _settle(materialize(open_rows, "open"))

    # Spend before each row, now that the admitted costs are known.
    late_ids = late.select(F.col("_id").alias("_late"), F.lit(True).alias("_admitted"))
    judged = marked.withColumn("_early", is_early).join(late_ids, F.col("_id") == F.col("_late"), "left").drop("_late")
    spent = F.when(F.col("_early") | F.coalesce("_admitted", F.lit(False)), F.col("_cost")).otherwise(F.lit(0).cast("long"))
    judged = materialize(judged.select("_key", *_ORDER, CHUNK, "_limit", "_open", spent.alias("_spent")), "judged")
    final = running_sum(judged, ["_key"], _ORDER, F.col("_spent"), "_before")
    before = F.col("_before") + F.col("_open")
    return final.select(
        "_id", before.alias("_before"), F.coalesce(before > F.col("_limit"), F.lit(False)).alias("_over")
    )


def _settle(rows: DataFrame) -> DataFrame:
    """Ids of the rows admitted after the first refusal of their key."""
    group = F.to_json(F.struct("_key")).alias("_group")
    ordered = _in_order(rows.select(group, CHUNK, *_ORDER, "_cost", "_limit", "_spend"), ["_group", CHUNK])
    functions = materialize(ordered.mapInArrow(_chunk_functions, _FUNCTIONS), "spend-functions")
    in_order = lambda df: df.repartition("_group").sortWithinPartitions("_group", CHUNK)
    ranges = in_order(functions.drop("start", "add")).mapInArrow(_chunk_ranges, f"_group string, {CHUNK} int, low long, high long")
    narrow = functions.select("_group", CHUNK, "_spend", "start", "add").join(materialize(ranges, "spend-ranges"), ["_group", CHUNK])
    narrow = materialize(narrow.mapInArrow(_narrowed, _NARROW), "spend-pieces")
    known = materialize(in_order(narrow).mapInArrow(_chunk_spends, f"_group string, {CHUNK} int, _at long"), "spend-before")
    placed = rows.withColumn("_group", group).join(known, ["_group", CHUNK]).withColumn("_spend", F.col("_at"))
    return _fold(placed, ["_group", CHUNK]).where(~F.col("_over")).select("_id")


_FUNCTIONS = f"_group string, {CHUNK} int, _spend long, start binary, add binary, bounds binary"
_NARROW = f"_group string, {CHUNK} int, _spend long, start binary, add binary"


def _longs(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.int64)


def _chunk_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (group, chunk) of rows that arrive in order: its step function and the outline of it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current: tuple[str, int, int] | None = None

    def made() -> pa.RecordBatch:
        cost, limit = (np.concatenate(x) for x in zip(*held))
        steps = of_rows(cost, limit, current[2])
        parts = [steps.start.tobytes(), steps.add.tobytes(), np.concatenate(outline(steps)).tobytes()]
        columns = [pa.array([current[0]]), pa.array([current[1]], pa.int32()), pa.array([current[2]]), *(pa.array([p], pa.binary()) for p in parts)]
        return pa.RecordBatch.from_arrays(columns, names=["_group", CHUNK, "_spend", "start", "add", "bounds"])

    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column(CHUNK).to_numpy()
        name = batch.column("_group").to_numpy(zero_copy_only=False)
        spend = batch.column("_spend").to_numpy()
        cost, limit = (batch.column(c).to_numpy().astype(np.int64) for c in ("_cost", "_limit"))
        edges = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (name[1:] != name[:-1])))
        for lo, hi in zip(edges, np.append(edges[1:], len(chunk))):
            key = (name[lo], int(chunk[lo]), int(spend[lo]))
            if key != current:
                if held:
                    yield made()
                held, current = [], key
            held.append((cost[lo:hi], limit[lo:hi]))
    if held:
        yield made()


def _chunk_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The range that the spend before each chunk lies in."""
    group, low, high = None, 0, 0
    for batch in batches:
        lows, highs = [], []
        for name, spend, bounds in zip(*(batch.column(c) for c in ("_group", "_spend", "bounds"))):
            if name.as_py() != group:
                group, low, high = name.as_py(), spend.as_py(), spend.as_py()
            lows.append(low)
            highs.append(high)
            low, high = Outline(*_longs(bounds).reshape(5, -1))(low, high)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_group"), batch.column(CHUNK), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["_group", CHUNK, "low", "high"]
        )


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each function that the range of its chunk meets."""
    for batch in batches:
        parts = [
            Steps(_longs(s), _longs(a)).within(low.as_py(), high.as_py())
            for s, a, low, high in zip(*(batch.column(c) for c in ("start", "add", "low", "high")))
        ]
        columns = [pa.array([p[k].tobytes() for p in parts], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_group", CHUNK, "_spend")), *columns], names=["_group", CHUNK, "_spend", "start", "add"])


def _chunk_spends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spend before each chunk."""
    group, spend = None, 0
    for batch in batches:
        spends = []
        for name, first, start, add in zip(*(batch.column(c) for c in ("_group", "_spend", "start", "add"))):
            if name.as_py() != group:
                group, spend = name.as_py(), first.as_py()
            spends.append(spend)
            spend = Steps(_longs(start), _longs(add))(spend)
        yield pa.RecordBatch.from_arrays([batch.column("_group"), batch.column(CHUNK), pa.array(spends, pa.int64())], names=["_group", CHUNK, "_at"])


def _in_order(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key in one partition, in order; no budget is a limit that no spend can reach."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *_ORDER)
    return ordered.withColumn("_limit", F.coalesce("_limit", F.lit(NO_LIMIT).cast("long")))


def _fold(rows: DataFrame, keys: Sequence[str] = ("_key",)) -> DataFrame:
    """Fold each key in order, starting from ``_spend``: ``_id, _before, _over``."""
    id_type = rows.schema["_id"].dataType.simpleString()
    slim = rows.select(F.to_json(F.struct(*keys)).alias("_group"), *_ORDER, "_cost", "_limit", "_spend")
    ordered = _in_order(slim, ["_group"]).select("_group", "_id", "_cost", "_limit", "_spend")
    return ordered.mapInPandas(_fold_sorted, f"_id {id_type}, _before long, _over boolean")


def _fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by key and order; the only state is the spend of the current key."""
    group, spend = None, 0
    for batch in batches:
        names = batch["_group"].to_numpy()
        cost, limit = batch["_cost"].to_numpy(np.int64), batch["_limit"].to_numpy(np.int64)
        before, over = np.empty(len(batch), np.int64), np.zeros(len(batch), bool)
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(batch) else np.empty(0, int)
        for lo, hi in zip(starts, np.append(starts[1:], len(batch))):
            if names[lo] != group:
                group, spend = names[lo], int(batch["_spend"].iat[lo])
            spend = _fold_run(cost[lo:hi], limit[lo:hi], spend, before[lo:hi], over[lo:hi])
        yield pd.DataFrame({"_id": batch["_id"], "_before": before, "_over": over})


def _fold_run(cost: np.ndarray, limit: np.ndarray, spend: int, before: np.ndarray, over: np.ndarray) -> int:
    """Fill ``before`` and ``over`` for rows of one key; returns the spend after them."""
    before[:] = spend + np.cumsum(cost) - cost
    refused = before > limit
    if not refused.any():
        return int(before[-1] + cost[-1])
    # Exact up to the first refusal; from there row by row.
    first = int(refused.argmax())
    spend = int(before[first])
    for n, (c, top) in enumerate(zip(cost[first:].tolist(), limit[first:].tolist()), first):
        before[n] = spend
        if spend > top:
            over[n] = True
        else:
            spend += c
    return spend


def budget_what_if(
    df: DataFrame,
    budgets: Sequence[str | float],
    row_id: str,
    ts: str,
    estimate: Column,
    cost: Column,
) -> DataFrame:
    """Per day and hypothetical daily budget: requests and spend admitted or refused."""
    scenarios = F.explode(F.array(*[F.lit(str(b)).cast("decimal(18,6)") for b in budgets]))
    rows = df.select(
        F.col(row_id).alias("id"),
        F.col(ts).alias("ts"),
        estimate.cast("decimal(18,6)").alias("estimate"),
        cost.cast("decimal(18,6)").alias("cost"),
        scenarios.alias("budget"),
    ).withColumn("day", F.to_date("ts"))
    rows = materialize(rows.withColumn("case_id", F.concat_ws("|", "id", "budget")), "what-if")
    key = F.struct("day", "budget")
    decided = budget_gate(rows, F.to_json(key), "case_id", "ts", F.col("estimate"), F.col("cost"), F.col("budget"))
    over = F.col("over_budget")
    return (
        rows.join(decided, "case_id")
        .groupBy("budget", "day")
        .agg(
            F.count_if(~over).alias("admitted"),
            F.count_if(over).alias("refused"),
            F.sum(F.when(~over, F.col("cost")).otherwise(F.lit(0))).cast("decimal(18,6)").alias("admitted_spend"),
            F.sum(F.when(over, F.col("cost")).otherwise(F.lit(0))).cast("decimal(18,6)").alias("refused_spend"),
        )
    )


def auto_downgrade(
    df: DataFrame,
    key: str | Column,
    row_id: str,
    ts: str,
    cost: Column,
    budget: Column,
    threshold: float = 0.80,
    model: Column | None = None,
    target: str | Column | None = None,
    target_cost: Column | None = None,
) -> DataFrame:
    """Rows at which the spend so far has reached ``threshold`` x budget (X3): ``row_id, downgraded``.

    With ``target``, the cheaper model, and ``target_cost``, what the row costs
    there, also ``model`` and ``cost`` after the switch.  Costs before that
    point are undiscounted, so the running sum of original costs decides it
    exactly; afterwards the switch stays on.
    """
    key = F.col(key) if isinstance(key, str) else key
    mark = F.ceil(to_micros(budget) * F.lit(str(threshold)).cast("decimal(6,4)")).cast("long")
    slim = df.select(
        key.alias("_key"), F.col(ts).alias("_ts"), F.col(row_id).alias("_id"), to_micros(cost).alias("_cost"), mark.alias("_mark"),
        *([] if target is None else [
            (F.lit(None).cast("string") if model is None else model).alias("_model"),
            (F.lit(target) if isinstance(target, str) else target).alias("_target"), to_micros(target_cost).alias("_target_cost"),
        ]),
    )
    rows = cut_into_chunks(slim, ["_key"], _ORDER)
    summed = running_sum(rows, ["_key"], _ORDER, F.col("_cost"), "_before")
    down = F.coalesce(F.col("_before") >= F.col("_mark"), F.lit(False))
    out = [F.col("_id").alias(row_id), down.alias("downgraded")]
    if target is not None:
        # A target that costs more is never taken.
        cheaper = down & (F.col("_target_cost") <= F.col("_cost"))
        out += [
            F.when(cheaper, F.col("_target")).otherwise(F.col("_model")).alias("model"),
            micros_to_money(F.when(cheaper, F.col("_target_cost")).otherwise(F.col("_cost"))).alias("cost"),
        ]
    return summed.select(*out)
