"""Exact similarity join of documents on word shingles, by prefixes of their rarest tokens.

Tokens are the 64-bit hashes of a document's distinct five-word shingles.  Two
documents link when 100 * intersection >= 75 * union.  Documents with equal
sets are one class; only one of a class takes part.  A class has a ``key``, the
first 64 bits of the digest of its set.

1.  *Which documents can have a partner.*  In the order of hashes take the
    first ``n - ceil(0.75 n) + 1 + n // 20`` tokens of a set of n.  Of two linked
    sets the one whose prefix ends first misses at most ``n - ceil(0.75 n)``
    tokens in the other, so both hold at least ``1 + m // 20`` tokens that more
    than one prefix holds, m the smaller size.  A document with fewer is alone.
2.  *Signatures.*  The order is now by the number of documents left that hold a
    token, the rarest first, and by hash among those of one number.  The first
    ``n - ceil(0.75 n) + 1`` tokens of two linked sets have one in common.  They
    are the signatures; what only one document holds finds nothing, but takes
    its place among them, so near copies meet in few signatures and passages
    that very many documents share are hardly ever one.  Tokens move as packed
    arrays (``postings``).
3.  *Components* come from links within signatures, found and confirmed on the
    full sets by ``hubs``: it compares what can still join two components, not
    all pairs of a signature.
4.  ``links`` is for those who want every link: all pairs of a signature's
    documents of fitting sizes, groups of large signatures dealt over pairs of
    blocks, a parity bitmap of each set bounding the symmetric difference from
    below, and exact intersections.  Its cost grows with the number of links.

Defined cases: a null or empty text has no shingle, its own component, and
links with nothing; documents without an id are in no component (null); rows
that repeat an id must repeat its text, else the id has the links of all its
texts (in ``links`` those of the classes it stands for); an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hubs, postings
from .common import SIMILARITY_PERCENT, clear_of, dropped, freed, in_small_batches, slices, small, written
from .components import components
from .hubs import parity
from .shingles import shingle_sets

# Documents of a block in ``links``.
FREQUENT = 64


def needed(n: int) -> int:
    """Tokens of a set of n that any partner must hold."""
    return -(-3 * n // 4)


def prefix_size(n: int) -> int:
    return n - needed(n) + 1


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Class and key of each set."""
    digests = [hashlib.md5(s.tobytes()).digest() for s in sets]
    return pa.array(digests, pa.binary()), pa.array(np.frombuffer(b"".join(x[:8] for x in digests), np.int64))


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, n, class, key, prefix`` of every row: size, digest, key and filter prefix of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            prefix = [s[: prefix_size(len(s)) + len(s) // 20].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *_digests(sets), pa.array(prefix, pa.binary())],
                names=["doc", "n", "class", "key", "prefix"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc long, n long, class binary, key long, prefix binary")


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, key, n, tokens, parity`` with the sorted tokens as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), _digests(sets)[1], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.binary()),
                ],
                names=["doc", "key", "n", "tokens", "parity"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc long, key long, n long, tokens binary, parity binary")


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for n, m, p, q in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                p, q = (np.frombuffer(x, np.uint8) for x in (p, q))
                if len(p) > len(q):
                    p, q = q, p
                q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0) if len(q) > len(p) else q
                apart = int(np.bitwise_count(p ^ q).sum())
                # 100 i >= 75 (n + m - i)  is  7 (n + m - 2 i) <= n + m.
                keep.append(7 * apart <= n + m)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= 75 * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def side(name: str, *columns: str) -> DataFrame:
        return tokens.select(F.col("doc").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    sized = pairs.join(side("a", "n", "parity"), "a").join(side("b", "n", "parity"), "b")
    sized = sized.where((4 * F.col("n_a") >= 3 * F.col("n_b")) & (4 * F.col("n_b") >= 3 * F.col("n_a")))
    near = written(sized.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(filtered, "a long, b long"))
    full = near.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    return full.select("a", "b", "tokens_a", "tokens_b").mapInArrow(linked, "a long, b long")


class _Candidates(NamedTuple):
    sets: DataFrame  # doc, n, class, key of every row with an id
    classes: DataFrame  # class, n, first, key
    tokens: DataFrame  # of one document of each class that can have a partner
    held: DataFrame  # sig, doc


@in_small_batches
def _candidates(docs: DataFrame, id_col: str, text_col: str) -> _Candidates:
    """Steps 1 and 2."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    id_col, text_col = "id", "text"
    filters = written(_sets(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    sets = written(filters.drop("prefix"))

    # One document of each class of equal sets; an id that repeats is one node all the same.
    classes = written(sets.where("n > 0").groupBy("class", "n").agg(F.min("doc").alias("first"), F.min("key").alias("key")))

    # 1. Documents that can have a partner.
    shared = postings.shared_counts(postings.dealt(filters.where("n > 0").select(F.col("key").alias("owner"), F.col("prefix").alias("tokens"))))
    enough = F.col("shared") >= 1 + F.floor(F.ceil(F.col("n") * 3 / 4) / 20)
    able = written(classes.join(shared, F.col("key") == F.col("owner")).where(enough).select(F.col("first").alias("doc")).distinct())
    dropped(filters)
    freed(docs.sparkSession)
    tokens = written(
        _tokens(docs.join(small(able), F.col(id_col) == F.col("doc"), "left_semi"), id_col, text_col)
    )

    # 2. Signatures.
    owned = tokens.withColumnRenamed("key", "owner")
    rarest = postings.rarest(postings.dealt(owned), owned, prefix_size)
    found = postings.buckets(rarest)
    named = small(owned.select("owner", "doc").distinct())
    return _Candidates(sets, classes, tokens, written(found.join(named, "owner").select("sig", "doc").distinct()))


def _links(found: _Candidates) -> DataFrame:
    """The pairs ``a, b`` of class heads that link, each once."""
    # A document of a signature of k blocks meets each block once: on the left as (own, other), on the right as (other, own).
    blocks = F.ceil(F.count("*") / FREQUENT).cast("int")
    sized = found.held.join(found.held.groupBy("sig").agg(blocks.alias("blocks")), "sig").join(
        found.tokens.select("doc", "n").distinct(), "doc"
    )
    own, every = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = sized.select("sig", F.col("doc").alias("a"), F.col("n").alias("n_a"), own.alias("i"), every.alias("j"))
    right = sized.select("sig", F.col("doc").alias("b"), F.col("n").alias("n_b"), every.alias("i"), own.alias("j"))
    fits = (4 * F.col("n_a") >= 3 * F.col("n_b")) & (4 * F.col("n_b") >= 3 * F.col("n_a"))
    pairs = left.join(right, ["sig", "i", "j"]).where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    return _verified(written(pairs), found.tokens).distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The pairs ``a, b`` of class heads that link, and ``doc, head`` of every document that has a shingle.

    Documents link when their heads are the same or a pair.
    """
    found = _candidates(docs, id_col, text_col)
    return _links(found), _heads(found).distinct()


def _heads(found: _Candidates) -> DataFrame:
    return found.sets.where("n > 0").select("doc", "class").join(found.classes.select("class", F.col("first").alias("head")), "class").select("doc", "head")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n, component, n_links`` of every row of ``docs`` with an id: the other documents that it links with, counted."""
    found = _candidates(docs, id_col, text_col)
    pairs = written(_links(found))
    sizes = written(_heads(found).distinct().groupBy("head").agg(F.count("*").alias("size")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes.withColumnRenamed("head", "b"), "b").groupBy("a").agg(F.sum("size").alias("near")).withColumnRenamed("a", "head")
    counts = sizes.join(near, "head", "left").select("head", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    placed = _placed(found, pairs).join(counts, F.col("first") == F.col("head"), "left")
    return placed.select("doc", "n", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _placed(found: _Candidates, pairs: DataFrame) -> DataFrame:
    """``doc, n, first, component`` of every row; a class has the component of its first document, its smallest."""
    of = components(pairs)
    placed = found.sets.select("doc", "n", "class").join(found.classes.select("class", "first"), "class", "left")
    placed = placed.join(of, F.col("first") == F.col("node"), "left")
    return placed.select("doc", "n", "first", F.coalesce("component", "first", "doc").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n, first, component`` of every row of ``docs`` with an id; ``first`` is the smallest id with an equal set."""
    found = _candidates(docs, id_col, text_col)
    sets = found.tokens.drop("key").withColumnRenamed("doc", "node")
    if not found.tokens.groupBy("doc").count().where("count > 1").isEmpty():  # rows that repeat an id
        sets = written(sets.distinct())
        dropped(found.tokens)
    pairs = hubs.ties(found.held.select("sig", F.col("doc").alias("node")), sets, SIMILARITY_PERCENT)
    dropped(sets)
    return _placed(found, pairs).select("doc", "n", "first", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and those without an id."""
    p = clear_of(docs.columns, "_near_")
    found = near_duplicates(docs, id_col, text_col).where("doc <> component").select(F.col("doc").alias(p + "doc")).distinct()
    return docs.join(found, F.col(id_col) == F.col(p + "doc"), "left_anti")


def op9_ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, number of distinct shingles, component and class of equal sets of every document."""
    out = near_duplicates(docs)
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce("first", "doc").alias("class_id"),
    )
