"""Links that connect what a similarity join would, from buckets of any size and without all pairs of a bucket.

A bucket holds sets that may link: two sets link when
``100 * intersection >= percent * union``.  Wanted are the components of all
links between sets of one bucket, so pairs are compared only where they can
still join two components.

1.  *Spokes.*  Every set of a bucket is compared with the bucket's hub: a set
    that is in very many buckets, this one or one beside it.  Near copies of
    one text have the same hub in nearly all the buckets they share, so there
    are few different pairs.
2.  Buckets whose sets are now in one component are done.  In small ones
    (``FEW``) of the first level with few sets outside their largest component
    (``SMALL``) all pairs of different components are compared: a bounded number
    for each set.  The sets around a hub, of all of its other buckets together,
    are dealt into blocks of about ``CROWD``; a task looks at those of two blocks,
    which it counts out by an inverted list of what they differ from the hub in:
    ``x ^ y = A ^ B`` for ``A = x ^ h``, ``B = y ^ h``.  Only sets whose bitmaps (below)
    leave them a partner of another component are counted.  At later levels so
    are the sets of a bucket of a hub with more than ``MOST_BLOCKS`` blocks.
3.  *Differences.*  In all others take what each set differs from the hub in:
    ``A = x ^ h``, ``B = y ^ h``.  When x and y link and are not both linked with
    the hub, A and B have many elements in common, at least

    * ``|A| - floor((100 - p) / p * |x|)``, since ``|A| + |B| - 2 |A & B| = |x ^ y|``
      is at most that fraction, and ``|B| >= |A & B|``;
    * more than ``p |A| / (100 + p)`` for the one that does link with the hub, as
      the other does not.

    So their prefixes of ``|A| - (least common elements) + 1`` elements share
    one, in an order common to all sets of the hub: first what the hub does not
    hold, each by hash.  Elements of these prefixes are the buckets of the next
    level, where step 1 starts again.  A hub is in none of its own, so levels
    end; edits of near copies are mostly their own, so buckets fall apart fast.

Before whole sets are moved, pairs are looked at by parity bitmaps of a few
bits for each element: where the bitmaps differ in more cells than linked sets
can differ in elements, the sets do not link.  Only sets that are left with a
partner are joined, for the exact comparison.

Every level is written to the shared folder.  Nodes are 64-bit keys of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, in_few, in_small_batches, slices, small, written
from .components import components
from .shingles import mixed

# Sets of a first-level bucket, and those outside of its largest component, up to which all of its pairs are compared.
FEW, SMALL = 64, 6
# Bytes of hubs' sets that are broadcast to the sets around them, after counting.
MAX_HUB_BYTES = 32_000_000
# Sets of a block, and the elements that they and their hub can differ in; a task compares two blocks.
CROWD, CROWD_ELEMENTS = 512, 2_000_000
# Blocks that are compared each with each; a hub with more falls apart by differences.
MOST_BLOCKS = 64


def _set(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint64)


def parity(tokens: np.ndarray) -> bytes:
    """A bit per cell: whether the number of the set's tokens in it is odd.  Cells: a power of two."""
    cells = 64
    while cells < 2 * len(tokens):
        cells *= 2
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (the last axis) in as few as ``size`` bytes: cells that fall together are added."""
    return np.bitwise_xor.reduce(bits.reshape(*bits.shape[:-1], -1, size), axis=-2)


def _bitmaps(sets: DataFrame) -> DataFrame:
    """``node, n, parity`` of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = pa.array([parity(_set(x)) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits], names=["node", "n", "parity"])

    return sets.select("node", F.col("n").cast("long").alias("n"), "tokens").mapInArrow(run, "node long, n long, parity binary")


def _of(sets: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The sets of the nodes in this column of ``rows``."""
    nodes = rows.select(F.col(column).alias("node")).distinct()
    return sets.join(small(nodes), "node", "left_semi")


def _beside_hubs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows``, which have ``node, hub``, with the ``n, tokens`` of the node and the ``hub_tokens``.

    Few rows and small hubs go to where the sets lie; else both are shuffled.
    """
    own = _of(sets, rows, "node").select("node", "n", "tokens").join(small(rows), "node")
    hubs = _of(sets, rows, "hub").select(F.col("node").alias("hub"), F.col("tokens").alias("hub_tokens"))
    size = hubs.agg(F.sum(F.octet_length("hub_tokens").cast("long"))).first()[0] or 0
    return own.join(F.broadcast(hubs) if size <= MAX_HUB_BYTES else hubs, "hub")


def verified(pairs: DataFrame, sets: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets link; ``sets`` has ``node, n, tokens`` with sorted 64-bit elements."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                x, y = (np.frombuffer(z, np.uint8) for z in (x, y))
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep.append((100 + percent) * apart <= (100 - percent) * (n + m))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _set(x), _set(y)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a, b = (bitmaps.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}")) for s in "ab")
    fits = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    sized = pairs.join(a, "a").join(b, "b").where(fits).select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    near = written(sized.mapInArrow(filtered, "a long, b long").distinct())
    a, b = (_of(sets, near, s).select(F.col("node").alias(s), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    full = a.join(small(near), "a").join(b, "b")
    return full.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _differences(spokes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``sig, node``: the prefix of what each node differs from its hub in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sigs, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for node, hub, x, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, h = _set(x), _set(h)
                mine, its = np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)
                a = len(mine) + len(its)
                same = len(x) - len(mine)
                least = max(1, a - (100 - percent) * len(x) // percent)
                if 100 * same >= percent * (len(x) + len(h) - same):
                    least = max(least, percent * a // (100 + percent) + 1)
                prefix = np.append(mine, its)[: max(0, a - least + 1)]
                sigs.append(mixed(prefix ^ mixed(np.array([hub], np.int64).view(np.uint64))))
                nodes.append(np.full(len(prefix), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    joined = _beside_hubs(spokes, sets).select("node", "hub", "tokens", "hub_tokens")
    return joined.mapInArrow(run, "sig long, node long")


def links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` with the components of all links within buckets.

    ``buckets`` has distinct ``sig, node``; a bucket has two nodes at least.
    ``sets`` may have the ``parity`` of its tokens.
    """
    return _searched(buckets, sets, percent)[0]


def ties(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` with the components of ``links``, most of them a node and the smallest of its component: soon done."""
    return _searched(buckets, sets, percent)[1]


@in_small_batches
def _searched(buckets: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    tested: DataFrame | None = None
    found: DataFrame | None = None
    # What ties nodes together: the components so far as stars, and the links found since.
    tied: DataFrame | None = None
    at: DataFrame | None = None
    bitmaps = sets.select("node", "n", "parity") if "parity" in sets.columns else written(_bitmaps(sets))

    def add(more: DataFrame) -> None:
        nonlocal found, tied, at
        if found is None or not more.isEmpty():
            found = more if found is None else found.unionByName(more)
            tied = more if tied is None else tied.unionByName(more)
            at = None

    def compare(pairs: DataFrame) -> None:
        """Add the links among the pairs that were not compared before."""
        nonlocal tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        add(written(verified(pairs, sets, bitmaps, percent)))
        freed(sets.sparkSession)

    first = True
    while True:
        degree = buckets.groupBy("node").agg(F.count("*").alias("degree"))
        fit = F.struct("degree", (-F.col("node")).alias("back"))
        tops = written(buckets.join(degree, "node").groupBy("sig").agg(F.max(fit).alias("top")))
        # The hub of a bucket is the greatest of the buckets that its own greatest set is in.
        lead = buckets.join(tops, "sig").groupBy("node").agg(F.max("top").alias("lead"))
        hubs = tops.select("sig", (-F.col("top.back")).alias("node")).join(lead, "node").select("sig", (-F.col("lead.back")).alias("hub"))
        members = written(buckets.join(hubs, "sig"))
        dropped(tops)
        compare(members.where("node <> hub").select(*_ordered("node", "hub")).distinct())

        if at is None:
            at = written(components(tied))
            tied = at.select(F.col("node").alias("a"), F.col("component").alias("b"))
        sizes = sets.groupBy("node").agg(F.max("n").alias("size"))
        labelled = members.join(sizes, "node").join(at, "node", "left")
        labelled = written(labelled.select("sig", "node", "hub", "size", F.coalesce("component", "node").alias("at")))
        dropped(members)
        parts = labelled.groupBy("sig", "at").agg(F.count("*").alias("n"))
        parts = parts.groupBy("sig").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
        left = written(labelled.join(parts.where("rows > most"), "sig"))
        dropped(labelled)

        done = (F.col("rows") <= FEW) & (F.col("rows") - F.col("most") <= SMALL) if first else F.lit(False)
        few = left.where(done).select("sig", "node", "at")
        if first:
            other = few.select("sig", F.col("node").alias("node2"), F.col("at").alias("at2"))
            compare(few.join(other, "sig").where("at < at2").select(*_ordered("node", "node2")).distinct())

        # What is left of all the buckets of a hub, if its blocks are not too many; else bucket by bucket.
        far = left.where(~done & (F.col("node") != F.col("hub"))).select("sig", "hub", "node", "at", "size")
        far = far.join(sizes.select(F.col("node").alias("hub"), F.col("size").alias("hub_size")), "hub")
        around = written(_blocked(far.drop("sig").distinct(), "hub"))
        add(written(_counted(around.where("fits"), sets, bitmaps, percent, "hub")))
        freed(sets.sparkSession)
        more = written(around.where("not fits").select("hub").distinct())
        if more.isEmpty():
            return found, tied
        many = far.join(more, "hub", "left_semi")
        if not first:
            many = written(_blocked(many, "sig"))
            add(written(_counted(many.where("fits"), sets, bitmaps, percent, "sig")))
            many = many.where("not fits")
        many = written(many.select("hub", "node", "at").distinct())
        dropped(left)
        dropped(around)
        if many.isEmpty():
            return found, tied
        split = written(_differences(many.select("node", "hub"), sets, percent).join(many.select("node", "at").distinct(), "node"))
        # Most elements are in one component only: those go before the others are compared.
        apart = split.groupBy("sig").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo <> hi").select("sig")
        apart = written(in_few(apart))
        freed(sets.sparkSession)
        rows = written(in_few(split.join(apart, "sig").distinct()))
        dropped(split)
        freed(sets.sparkSession)
        buckets, first = written(rows.join(_different_buckets(rows), "sig").select("sig", "node")), False
        dropped(rows)
        dropped(apart)
        freed(sets.sparkSession)
        if buckets.isEmpty():
            return found, tied


def _blocked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``blocks`` that those of a ``key`` are dealt into, and ``fits``: whether these may be compared each with each."""
    elements = F.sum(F.col("size") + F.col("hub_size"))
    blocks = F.ceil(F.greatest(F.count("*") / CROWD, elements / CROWD_ELEMENTS)).cast("int")
    return rows.join(rows.groupBy(key).agg(blocks.alias("blocks")), key).withColumn("fits", F.col("blocks") <= MOST_BLOCKS)


def _different_buckets(rows: DataFrame) -> DataFrame:
    """``sig`` of one of the buckets that hold the same nodes.

    Near copies share hundreds of elements.  Equal sets of nodes have equal
    numbers, ends and sums of hashes.
    """
    h = F.xxhash64("node")
    held = rows.groupBy("sig").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"),
        F.bit_xor(h).alias("xor"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24).cast("decimal(20,0)")).alias("sum"),
    )
    return held.groupBy("lo", "hi", "n", "xor", "sum").agg(F.min("sig").alias("sig")).select("sig")


def _possible(rows: DataFrame, bitmaps: DataFrame, percent: int, key: str) -> DataFrame:
    """``key, i, j, own, node, hub, at``: the ``rows`` that may link with one of another component of their key, by the bitmaps.

    They are dealt into blocks; ``i`` and ``j`` are two of them (or one) that are compared, ``own`` is that of the node.
    """

    def run(group: pa.Table) -> pa.Table:
        at, n, own = (group.column(c).to_numpy() for c in ("at", "n", "own"))
        apart_only = group.column("i")[0] != group.column("j")[0]
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("parity")]
        size = np.array([len(x) for x in raw])
        keep = np.zeros(len(raw), bool)
        for least in np.unique(size):
            # Those of this size against themselves and all that are larger.
            place = np.flatnonzero(size >= least)
            bits = np.stack([folded(raw[k], least) for k in place]).view(np.uint64)
            at_, n_, own_ = at[place], n[place], own[place]
            for i, k in zip(np.flatnonzero(size[place] == least), place[size[place] == least]):
                fits = (at_ != at[k]) & (100 * n_ >= percent * n[k]) & (100 * n[k] >= percent * n_)
                other = np.flatnonzero(fits & (own_ != own[k]) if apart_only else fits)
                apart = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
                near = place[other[(100 + percent) * apart <= (100 - percent) * (n_[other] + n[k])]]
                if len(near):
                    keep[near] = keep[k] = True
        return group.select(["key", "i", "j", "own", "node", "hub", "at"]).filter(pa.array(keep))

    own, other = F.col("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows.select(F.col(key).alias("key"), "node", "hub", "at", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    dealt = dealt.join(bitmaps, "node").select("key", "own", "node", "hub", "at", "n", "parity", other)
    dealt = dealt.select("key", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "own", "node", "hub", "at", "n", "parity")
    return dealt.groupBy("key", "i", "j").applyInArrow(run, "key long, i int, j int, own int, node long, hub long, at long").distinct()


def _gaps(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, node, at, n, gap`` for ``key, node, hub, at``: what each node differs from its hub in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            gaps = [np.setxor1d(_set(x), _set(h), assume_unique=True).tobytes() for x, h in zip(batch.column(4), batch.column(5))]
            columns = [*(batch.column(k) for k in range(4)), pa.array(gaps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "at", "n", "gap"])

    joined = _beside_hubs(rows.select("key", "node", "hub", "at"), sets)
    return joined.select("key", "node", "at", "n", "tokens", "hub_tokens").mapInArrow(run, "key long, node long, at long, n long, gap binary")


def _counted(rows: DataFrame, sets: DataFrame, bitmaps: DataFrame, percent: int, key: str) -> DataFrame:
    """The links ``a, b`` between different components of a ``key``, for ``key, node, hub, at, blocks``.

    All rows of a key have one hub, so two sets differ in what one of them alone differs from the hub in.
    """

    def run(group: pa.Table) -> pa.Table:
        node, at, n, block = (group.column(c).to_numpy() for c in ("node", "at", "n", "own"))
        apart_only = group.column("i")[0] != group.column("j")[0]
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("gap")]
        gap = np.array([len(x) for x in held], np.int64)
        _, element = np.unique(np.concatenate(held), return_inverse=True)
        owner = np.repeat(np.arange(len(held)), gap)[np.argsort(element, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(element))]).astype(np.int64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, own in enumerate(np.split(element, np.cumsum(gap)[:-1])):
            many = begin[own + 1] - begin[own]
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[own], many)
            both = np.bincount(owner[place], minlength=len(held))
            same = (n + n[i] - (gap + gap[i] - 2 * both)) // 2
            linked = (100 * same >= percent * (n + n[i] - same)) & (at > at[i])
            linked = np.flatnonzero(linked & (block != block[i]) if apart_only else linked)
            left.append(np.full(len(linked), node[i]))
            right.append(node[linked])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    left = written(_possible(rows, bitmaps, percent, key))
    gaps = _gaps(left.select("key", "node", "hub", "at").distinct(), sets)
    both = left.select("key", "i", "j", "own", "node").join(gaps, ["key", "node"])
    return both.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()
