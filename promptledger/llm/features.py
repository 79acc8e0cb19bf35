"""Shared by the classifiers: the training rule, learning from all labelled rows in shards, calibration.

Models learn in rounds.  In each, a task for every shard of the labelled rows
goes on from the same state, and Spark averages what they moved.  States,
counts and thresholds have a fixed size; rows stay in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, slices, written

HOLD_OUT = 5
# Labels up to this many are broadcast; rows and bytes of text that one task learns from.
LABELS_AT_HAND = 1_000_000
SHARD_ROWS, SHARD_BYTES = 6000, 16_000_000


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0.  False without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rest: int) -> DataFrame:
    """``at, y, rest, text`` of every labelled training row, one for each different label 0 or 1 of its id.

    ``at`` is a hash of id and text; ``rest`` marks the ids, one of that many, that a model is calibrated on and does not
    learn from.  Rows without a text are left out.  Texts are shuffled only where there are more labels than are broadcast.
    """
    slim = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    if slim.count() <= LABELS_AT_HAND:
        slim = F.broadcast(slim)
    rows = docs.select("doc_id", "text").where(~held_out() & F.col("text").isNotNull()).join(slim, F.col("doc_id") == F.col("_id"))
    aside = F.pmod(F.xxhash64(F.lit("rest"), "doc_id"), F.lit(rest)) == 0
    return rows.select(F.xxhash64("doc_id", "text").alias("at"), F.col("_y").cast("int").alias("y"), aside.alias("rest"), "text")


def sharded(rows: DataFrame, encode: Callable[[list[str]], list[bytes]]) -> DataFrame | None:
    """``shard, at, y, rest, x`` of ``labelled`` rows, written by shard; none without rows of both classes to learn from.

    A shard follows from the row's hash, and their number from rows and bytes: what one task learns from is bounded and
    does not depend on the partitions of the documents.
    """
    sizes = rows.where("not rest").groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if len(sizes) < 2:
        return None
    shards = max(1, -(-sum(r["n"] for r in sizes) // SHARD_ROWS), -(-sum(r["bytes"] for r in sizes) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array(encode(batch.column(3).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], names=["at", "y", "rest", "x"])

    encoded = rows.mapInArrow(run, "at long, y int, rest boolean, x binary")
    shard = F.pmod("at", F.lit(shards)).cast("int")
    return written(encoded.select(shard.alias("shard"), "at", "y", "rest", "x").repartitionById(shards, F.col("shard")))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Encoded texts and labels of one shard after the other, in the order of their hashes; a very large one in parts."""
    held: list[tuple] = []
    size = 0

    def piece() -> tuple[list[bytes], np.ndarray]:
        held.sort(key=lambda r: r[1:])
        return [r[3] for r in held], np.array([r[2] for r in held], np.float32)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[0] != held[0][0] or len(held) >= 2 * SHARD_ROWS or size >= 4 * SHARD_BYTES):
                yield piece()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield piece()


def totals(rows: DataFrame, width: int, work: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the sums of their vectors of ``width`` numbers, over what ``work`` gives for the rows of each shard.

    Spark adds them up; what is gathered are the different keys, whatever the number of rows.
    """
    names = [f"v{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for xs, ys in _pieces(batches):
            keys, values = work(xs, ys)
            columns = [pa.array(np.ascontiguousarray(values[:, k], np.float64)) for k in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *columns], names=["key", *names])

    made = rows.select("shard", "at", "y", "x").mapInArrow(run, "key long, " + ", ".join(f"{v} double" for v in names))
    out = made.groupBy("key").agg(*(F.sum(v).alias(v) for v in names)).toArrow()
    del made
    freed(rows.sparkSession)
    return out.column(0).to_numpy(), np.stack([out.column(v).to_numpy() for v in names], axis=1)


def improved(rows: DataFrame, state: np.ndarray, work: Callable[[np.ndarray, list[bytes], np.ndarray], np.ndarray]) -> np.ndarray:
    """``state`` after a round of learning from all rows, every shard beginning with the same one.

    A row of it moves by the mean of its moves, over the shards that moved it and weighted by their rows.
    """

    def moves(xs: list[bytes], ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        move = work(state.copy(), xs, ys).astype(np.float64) - state
        moved = np.flatnonzero(move.any(1))
        return moved, np.column_stack([np.full(len(moved), len(ys)), move[moved] * len(ys)])

    keys, sums = totals(rows, state.shape[1] + 1, moves)
    out = state.copy()
    out[keys] = state[keys] + sums[:, 1:] / sums[:, :1]
    return out


# Logits are counted in steps of 1 / 128 between -32 and 32.
_STEP, _BINS = 128, 8192


def logit_counts(rows: DataFrame, groups: int, work: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many rows of each group and label have a logit in each step; ``work`` gives groups and logits of encoded texts."""

    def count(xs: list[bytes], ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group, logit = work(xs)
        step = np.clip(np.floor(logit * _STEP) + _BINS // 2, 0, _BINS - 1).astype(np.int64)
        keys, n = np.unique((group * 2 + ys.astype(np.int64)) * _BINS + step, return_counts=True)
        return keys, n[:, None]

    keys, n = totals(rows, 1, count)
    out = np.zeros(groups * 2 * _BINS)
    out[keys] = n[:, 0]
    return out.reshape(groups, 2, _BINS)


def step_logits() -> np.ndarray:
    """The logit in the middle of each step."""
    return (np.arange(_BINS) - _BINS // 2 + 0.5) / _STEP


def softened(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def temperature(logit: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The factor that best calibrates logits on rows the network has not learned from; ``n`` counts equal ones."""
    if not len(y) or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [np.average(np.logaddexp(0, np.where(y == 1, -1, 1) * logit * g), weights=n) for g in grid]
    return float(grid[int(np.argmin(loss))])


def scored_batch(batch: pa.RecordBatch, score: np.ndarray, threshold: float) -> pa.RecordBatch:
    """``doc_id, held_out, score, predicted`` for a batch of ``doc_id, held_out, text``."""
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(score.astype(np.float64)), pa.array((score >= threshold).astype(np.int32))],
        names=["doc_id", "held_out", "score", "predicted"],
    )


SCORED = "doc_id long, held_out boolean, score double, predicted int"
