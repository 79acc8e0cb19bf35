"""Inverted lists of hashed tokens, moved as arrays instead of as rows.

A posting is a token and its owner, both 64-bit hashes.  Tasks deal postings to
cells by one of the two and send each cell a few packed arrays; what belongs to
a token, or to an owner, meets in one cell and is sorted there by numpy.  Cells
are as many as the session's shuffle partitions ask for, so that their size
stays the same when both grow.  An owner may come several times with the same
tokens; that counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mixed

CELLS_PER_PARTITION, MOST_CELLS = 2, 4096
# Postings that a task deals at once.
BLOCK = 1 << 20

_KINDS = {"token": np.uint64, "owner": np.int64, "rank": np.int32}


def cells_of(spark: SparkSession) -> int:
    return min(MOST_CELLS, CELLS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    """By the lower half: prefixes are taken by the whole value, so the upper half is not spread evenly."""
    return ((hashes.view(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(cells) >> np.uint64(32)).astype(np.uint16)


def _packed(cell: np.ndarray, cells: int, **arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each cell that gets something: ``cell`` and the bytes of its part of each array."""
    order = np.argsort(cell, kind="stable")
    count = np.bincount(cell, minlength=cells)
    some = np.flatnonzero(count)
    ends = np.concatenate([[0], np.cumsum(count[some])])
    columns = [pa.array(some.astype(np.int32))]
    for x in arrays.values():
        offsets = (ends * x.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(x[order])]))
    return pa.RecordBatch.from_arrays(columns, names=["cell", *arrays])


def _schema(*names: str) -> str:
    return ", ".join(["cell int", *(f"{x} binary" for x in names)])


def _arrays(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(group.column(x).to_pylist()), _KINDS[x]) for x in names]


def dealt(sets: DataFrame) -> DataFrame:
    """Postings by token, of the ``owner`` (long) and ``tokens`` (binary, unsigned 64-bit) of each row."""
    cells = cells_of(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, size = [], [], 0

        def pieces() -> Iterator[pa.RecordBatch]:
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            for k in range(0, len(token), BLOCK):
                part = token[k : k + BLOCK]
                yield _packed(_cell(part, cells), cells, token=part, owner=owner[k : k + BLOCK])

        for batch in batches:
            raw = batch.column(1).to_pylist()
            tokens.append(np.frombuffer(b"".join(raw), np.uint64))
            owners.append(np.repeat(batch.column(0).to_numpy(), np.array([len(x) // 8 for x in raw], np.int64)))
            size += len(tokens[-1])
            if size >= BLOCK:
                yield from pieces()
                tokens, owners, size = [], [], 0
        if size:
            yield from pieces()

    return sets.select("owner", "tokens").mapInArrow(run, _schema("token", "owner"))


def _grouped(blocks: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("cell").applyInArrow(run, schema)


def _shared(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token and owner of the distinct postings of tokens with several owners, in this order, and where tokens begin."""
    token, owner = _arrays(group, "token", "owner")
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
    keep = np.repeat(several, np.diff(np.append(begin, len(token))))
    token, owner = token[keep], owner[keep]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[first], owner[first]
    begin = np.ones(len(token), bool)
    begin[1:] = token[1:] != token[:-1]
    return token, owner, np.flatnonzero(begin)


def shared_counts(postings: DataFrame) -> DataFrame:
    """``owner, shared``: the tokens of each owner that another one has too, of owners with any."""

    def run(group: pa.Table) -> pa.Table:
        owner, count = np.unique(_shared(group)[1], return_counts=True)
        return pa.table({"owner": owner, "shared": count})

    return _grouped(postings, run, "owner long, shared long").groupBy("owner").agg(F.sum("shared").alias("shared"))


def rarest(postings: DataFrame, sizes: DataFrame, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Postings by token of the ``wanted(n)`` rarest tokens of each owner, without those that no other owner has.

    Rarer is what fewer owners have, and among these the smaller hash.  ``sizes`` has ``owner, n``, the number of
    its tokens.
    """
    cells = cells_of(postings.sparkSession)

    def ranked(group: pa.Table) -> pa.Table:
        token, owner, begin = _shared(group)
        count = np.diff(np.append(begin, len(token)))
        return pa.Table.from_batches([_packed(_cell(owner, cells), cells, token=token, owner=owner, rank=np.repeat(count, count).astype(np.int32))])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The size of an owner as a posting of rank 0."""
        for batch in batches:
            owner, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
            yield _packed(_cell(owner, cells), cells, token=n, owner=owner, rank=np.zeros(len(n), np.int32))

    def chosen(group: pa.Table) -> pa.Table:
        token, owner, rank = _arrays(group, "token", "owner", "rank")
        order = np.lexsort((token, rank, owner))
        token, owner, rank = token[order], owner[order], rank[order]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows = np.diff(np.append(begin, len(owner)))
        heads = np.add.reduceat((rank == 0).astype(np.int64), begin)
        n = token[begin].astype(np.int64)
        # What is not here is had by nobody else, and so is rarest of all.
        left = wanted(n) - (n - (rows - heads))
        place = np.arange(len(owner)) - np.repeat(begin + heads, rows)
        keep = (place >= 0) & (place < np.repeat(left, rows))
        token, owner = token[keep], owner[keep]
        return pa.Table.from_batches([_packed(_cell(token, cells), cells, token=token, owner=owner)])

    schema = _schema("token", "owner", "rank")
    both = _grouped(postings, ranked, schema).unionByName(sizes.select("owner", F.col("n").cast("long")).mapInArrow(sized, schema))
    return _grouped(both, chosen, _schema("token", "owner"))


def buckets(postings: DataFrame) -> DataFrame:
    """``sig, owner``: the owners of each token that several have; of tokens with the same owners one is enough.

    ``sig`` is a hash of the owners.
    """

    def run(group: pa.Table) -> pa.Table:
        token, owner, begin = _shared(group)
        if not len(token):
            return pa.table({"sig": owner, "owner": owner})
        count = np.diff(np.append(begin, len(token)))
        sums = np.add.reduceat(mixed(owner.view(np.uint64)), begin)
        sig = mixed(sums + mixed(count.astype(np.uint64)))
        once = np.zeros(len(sig), bool)
        once[np.unique(sig, return_index=True)[1]] = True
        keep = np.repeat(once, count)
        return pa.table({"sig": np.repeat(sig, count)[keep].view(np.int64), "owner": owner[keep]})

    return _grouped(postings, run, "sig long, owner long").distinct()
