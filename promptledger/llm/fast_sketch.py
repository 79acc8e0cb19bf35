"""Near duplicates by fast similarity sketching, banding and exact verification.

A set's sketch has ``BANDS * ROWS`` coordinates.  They are filled in rounds: in
round i every element is hashed anew, to a bin and a value, and a bin keeps the
least (round, value).  As many rounds as there are bins place elements
at random; each round after them fills one bin from all elements, so after
twice as many every coordinate is filled whatever the set's size.  A large set
is done after one or two rounds.  Two sets agree in a coordinate with the
probability of their similarity, and the share of equal coordinates is as
concentrated around it as with independent hashes.

``ROWS`` coordinates form a band.  Sets that are equal in a band share a bucket:
for a similarity of 0.85 a pair shares none of the 64 bands with a probability
of 1.4e-9.  Band keys are brought together as packed arrays (``postings``).
Pairs are confirmed on the full sets (``hubs``), which compares what components
need and no more.

Documents with equal sets are one class and one node; a class has the digest of
its set as its key.  Sets of fewer than six shingles link with equal ones only
and get no sketch.

Defined cases.  A null or empty text, or one without words, has no shingle: it
is its own component, linked with nothing.  A row without an id is not
linked and has no component (null); it is kept.  Rows that repeat an id are
rows of one document: it is linked with whatever one of its texts that has
words is linked with.  An empty table gives an empty result; other columns are not read (``kept_documents``
returns them).  Whole texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .common import clear_of, dropped, slices, written
from .components import components
from .hubs import parity, ties
from .shingles import mixed, shingle_sets

PERCENT = 85
BANDS, ROWS = 64, 8
_U = np.uint64
_EMPTY = _U(2**64 - 1)
_STEP = _U(0x9E3779B97F4A7C15)


def sketches(sets: Sequence[np.ndarray], bins: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``bins`` coordinates for each set of 64-bit elements; no set may be empty."""
    out = np.full((len(sets), bins), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    todo = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    # Elements of all unfinished sets behind one another, and the set of each.
    element, of = np.concatenate([np.zeros(0, _U), *sets]), np.repeat(todo, sizes)
    for k in range(2 * bins):
        if not len(todo):
            break
        h = mixed(element ^ mixed(np.full(1, k + 1, _U) * _STEP))
        value = (_U(k) << _U(32)) | (h & _U(0xFFFFFFFF))
        if k < bins:
            place = of * bins + (((h >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
            free = flat[place] == _EMPTY  # others hold a value of an earlier round, which is less
            np.minimum.at(flat, place[free], value[free])
        else:
            place = of * bins + (k - bins)
            free = flat[place] == _EMPTY
            np.minimum.at(flat, place[free], value[free])
        # Sets leave when their last bin is filled; looking is dear, so not in every round.
        if k < 4 or k % 8 == 0:
            open_ = (out[todo] == _EMPTY).any(axis=1)
            if not open_.all():
                going = np.zeros(len(sets), bool)
                going[todo[open_]] = True
                todo, element, of = todo[open_], element[going[of]], of[going[of]]
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of each sketch."""
    n, bins = sketch.shape
    parts = sketch.reshape(n, bins // rows, rows)
    key = np.arange(1, bins // rows + 1, dtype=_U)[None, :] * np.ones((n, 1), _U)
    for k in range(rows):
        key = mixed(key * _STEP + parts[:, :, k])
    return key


# The smallest set that can link with a different one: i / (i + 1) reaches the similarity.
_LEAST = -(-PERCENT // (100 - PERCENT))


def _digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(tokens.tobytes()).digest()[:8], "little", signed=True)


def _classes(docs: DataFrame) -> DataFrame:
    """``doc, n, node, keys`` of every row: the size and key of its set, and its band keys as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            able = [k for k, s in enumerate(sets) if len(s) >= _LEAST]
            keys = [b""] * len(sets)
            for k, key in zip(able, bands(sketches([sets[k] for k in able])) if able else ()):
                keys[k] = key.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                ],
                names=["doc", "n", "node", "keys"],
            )

    return docs.mapInArrow(run, "doc long, n long, node long, keys binary")


def _sets(docs: DataFrame) -> DataFrame:
    """``node, n, tokens, parity`` of every row: its set as sorted bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.binary()),
                ],
                names=["node", "n", "tokens", "parity"],
            )

    return docs.mapInArrow(run, "node long, n long, tokens binary, parity binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n, component`` of every row of ``docs``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketched = written(_classes(source))
    rows = written(sketched.drop("keys"))
    held = rows.where("doc is not null and node is not null")
    first = written(held.groupBy("node").agg(F.min("doc").alias("first")))

    # Rows of one class have the same band keys, which count once.
    keyed = sketched.where("doc is not null and length(keys) > 0").select(F.col("node").alias("owner"), F.col("keys").alias("tokens"))
    buckets = written(postings.buckets(postings.dealt(keyed)).withColumnRenamed("owner", "node"))
    dropped(sketched)
    able = written(buckets.select("node").distinct().join(first, "node"))
    texts = source.join(able.select(F.col("first").alias("doc")).distinct(), "doc", "left_semi")
    sets = written(_sets(texts).join(able.select("node"), "node", "left_semi"))
    if not sets.groupBy("node").count().where("count > 1").isEmpty():  # rows that repeat an id
        sets = written(sets.dropDuplicates(["node"]))
    pairs = ties(buckets, sets, PERCENT)
    dropped(sets)

    # An id that repeats with other texts ties their classes together.
    ids = held.select("doc", "node")
    several = ids.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    tied = ids.join(several.select("doc", "a"), "doc").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    at = written(components(pairs.unionByName(tied)))
    named = first.join(at, "node", "left").select("node", "first", F.coalesce("component", "node").alias("at"))
    smallest = named.groupBy("at").agg(F.min("first").alias("component"))
    of = named.join(smallest, "at").select("node", "component")
    placed = rows.select("doc", "n", "node").join(of, "node", "left")
    return placed.select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and those without an id."""
    p = clear_of(docs.columns, "_copy_")
    copies = near_duplicates(docs, id_col, text_col).where("doc <> component").select(F.col("doc").alias(p + "doc")).distinct()
    return docs.join(copies, F.col(id_col) == F.col(p + "doc"), "left_anti")


def op12_fast_sketch(docs: DataFrame) -> DataFrame:
    """doc_id, number of distinct shingles, component and whether it is the one that stays, of every document."""
    out = near_duplicates(docs)
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"),
    )
