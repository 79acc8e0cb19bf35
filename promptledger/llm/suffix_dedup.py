"""Removal of every byte under a long string that occurs earlier, by suffix arrays of shards.

A byte goes when a ``LENGTH``-byte string over it also starts earlier: in a
document of smaller id, or in the same document further left.  Texts are UTF-8
bytes; strings never cross documents and are judged on the input.

1.  *Segments.*  The smallest hash of a ``GRAM``-byte string inside a window of
    ``LENGTH`` bytes is the window's anchor (the leftmost of equals).  Adjacent
    windows with one anchor form a segment.  Equal windows have equal anchors at
    equal places, so only segments of one anchor need to be compared; anchors
    met once are dropped.
2.  *Copies.*  Of segments with equal bytes the first, by document and place,
    stands for all; in the others every window occurs earlier.
3.  *Shards.*  The different segments of an anchor come to one shard of
    bounded size.  Its suffix array is built by induced sorting; neighbours in
    it whose permuted common prefix reaches ``LENGTH`` are equal windows, and all
    but the first of such a run occur earlier.
4.  *Frequent anchors* with more than ``MAX_SEGMENTS`` different segments do not
    fit a shard.  Their windows are grouped one by one by two 64-bit hashes: the
    same rule as for copies, without a bound.

Equality of bytes in 2 and 4 is equality of two independent 64-bit hashes.

Defined cases: a null text is an empty text; texts shorter than ``LENGTH`` keep
all bytes; rows without an id keep all bytes and are never the earlier place;
rows that repeat an id are read as one document, so equal strings at equal
places of them are not earlier; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import mixed
from .suffix_arrays import permuted_prefixes, suffix_array

LENGTH, GRAM = 100, 32
SHARD_BYTES = 3_000_000
MAX_SEGMENTS = SHARD_BYTES // (2 * LENGTH - GRAM + 1)  # what fits a shard at a segment's greatest length
PIECE = 1 << 18  # bytes hashed at once, so that the arrays over them stay in a cache

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
_LETTERS = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) | _U(1) for s in (41, 43)]
_PLACE_BITS = 22

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo 2**64."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for base in _BASES:
            up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 2**64), _U)
            up[0] = down[0] = 1
            _powers.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))
    return _powers


def _string_hash(data: np.ndarray, which: int):
    """A function of starts and ends: the hashes of those strings."""
    up, down = _tables(max(PIECE + (1 << 18), len(data) + 1))[which]
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTERS[which][data] * up[: len(data)], out=sums[1:])
    return lambda s, e: mixed((sums[e] - sums[s]) * down[s] + np.asarray(e - s).astype(_U))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """The first hash of every ``GRAM``-byte string, by slices and in place: ``_string_hash`` of all its places."""
    up, down = _tables(max(PIECE + (1 << 18), len(data) + 1))[0]
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTERS[0][data] * up[: len(data)], out=sums[1:])
    h = sums[GRAM:] - sums[:-GRAM]
    h *= down[: len(h)]
    h += _U(GRAM)
    # What ``mixed`` does.
    t = h >> _U(30)
    h ^= t
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, _U(27), out=t)
    h *= _U(0x94D049BB133111EB)
    h ^= np.right_shift(h, _U(31), out=t)
    return h


def _segments(data: np.ndarray, valid: np.ndarray, contents: bool = True) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first window and number of windows of the segments of ``data``.

    ``valid`` tells which places start a window that lies inside one document.
    Without ``contents`` only the anchor hashes.
    """
    n = len(data) - LENGTH + 1
    if n <= 0 or not valid[:n].any():
        none = np.zeros(0, np.int64)
        return (none, none, none, none) if contents else (none,)
    grams = _gram_hashes(data)
    # The place below the hash: minima are unique and the leftmost of equals.
    low = grams & ~_U((1 << _PLACE_BITS) - 1)
    low |= np.arange(len(grams), dtype=_U)
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[width - have : width - have + n])
    anchor = (low & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    good = np.flatnonzero(valid[:n])
    new = np.concatenate(([True], (anchor[good[1:]] != anchor[good[:-1]]) | (np.diff(good) != 1)))
    first = good[new]
    if not contents:
        return (grams[anchor[first]].view(np.int64),)
    whole_hash = _string_hash(data, 1)
    count = np.diff(np.append(np.flatnonzero(new), len(good)))
    return grams[anchor[first]].view(np.int64), whole_hash(first, first + count + LENGTH - 1).view(np.int64), first, count


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """Texts joined up to a size: first text, end, offset in the first text, bytes.  Long texts come in overlapping pieces."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            for lo in range(0, len(texts[at]) - LENGTH + 1, PIECE):
                yield at, at + 1, lo, texts[at][lo : lo + PIECE + LENGTH - 1]
            at += 1
            continue
        upto, size = at, 0
        while upto < len(texts) and size + len(texts[upto]) <= PIECE:
            size += len(texts[upto])
            upto += 1
        yield at, upto, 0, b"".join(texts[at:upto])
        at = upto


_SEGMENT = "anchor long, content long, doc long, start long, windows int"


def _inside(texts: list[bytes], raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the texts in ``raw``, and which of its places start a window inside one of them."""
    ends = np.cumsum([len(t) for t in texts]) if len(texts) > 1 else np.array([len(raw)])
    valid = np.ones(len(raw), bool)
    for e in ends:
        valid[max(0, e - LENGTH + 1) : e] = False
    return ends, valid


def _anchors(docs: DataFrame) -> DataFrame:
    """``anchor`` of every segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            for lo, hi, _, raw in _groups(texts):
                (anchor,) = _segments(np.frombuffer(raw, np.uint8), _inside(texts[lo:hi], raw)[1], contents=False)
                yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["anchor"])

    return docs.mapInArrow(run, "anchor long")


def _all_segments(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            for lo, hi, offset, raw in _groups(texts):
                data = np.frombuffer(raw, np.uint8)
                ends, valid = _inside(texts[lo:hi], raw)
                anchor, content, first, count = _segments(data, valid)
                which = np.searchsorted(ends, first, side="right")
                begin = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(content), pa.array(ids[lo:hi][which] if len(first) else np.zeros(0, np.int64)),
                     pa.array(first - begin[which] + offset if len(first) else first), pa.array(count.astype(np.int32))],
                    names=["anchor", "content", "doc", "start", "windows"],
                )

    return docs.mapInArrow(run, _SEGMENT)


def _packed(docs: DataFrame) -> DataFrame:
    """``doc, packed``: compressed texts, for the joins that must move them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress((x or "").encode(), 1) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "packed"])

    return docs.mapInArrow(run, "doc long, packed binary")


def _later(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc, lo, hi``: bytes of all but the first of equal segments."""
    met = written(groups.where("n > 1").select("anchor", "content", F.col("first.doc").alias("doc0"), F.col("first.start").alias("start0")))
    return segments.join(met, ["anchor", "content"]).where("doc <> doc0 or start <> start0").select(
        "doc", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("hi")
    )


def _grouped(segments: DataFrame) -> DataFrame:
    return segments.groupBy("anchor", "content", "windows").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))


def _ranges(doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Runs of adjacent windows as byte ranges: doc, lo, hi."""
    if not len(at):
        return [np.zeros(0, np.int64)] * 3
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))
    last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return [doc[new], at[new], at[last] + LENGTH]


def shard_duplicates(doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """Byte ranges of windows that occur earlier in the shard; its segments differ from one another."""
    lengths = np.array([len(x) for x in texts])
    # Bytes count from 2; 1 parts segments, 0 ends the text.
    t = np.concatenate([np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 2, [0]])
    starts = np.cumsum(lengths + 1) - lengths - 1
    t[starts + lengths] = 1
    sa = suffix_array(t)
    common = permuted_prefixes(t, sa, starts, lengths, LENGTH)
    offset = np.concatenate([np.arange(n - LENGTH + 1) for n in lengths])
    own = np.repeat(np.arange(len(texts)), lengths - LENGTH + 1)
    window_at, rank_of = starts[own] + offset, np.full(len(t), np.iinfo(np.int64).max)
    d, s = doc[own], start[own] + offset
    order = np.lexsort((s, d))
    rank = np.empty(len(own), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum((np.diff(d[order]) != 0) | (np.diff(s[order]) != 0))))
    rank_of[window_at] = rank
    # Runs of equal windows in the array.
    new = np.append(True, common[sa[1:]] < LENGTH)
    run = np.cumsum(new) - 1
    lowest = np.minimum.reduceat(rank_of[sa], np.flatnonzero(new))
    low_of = np.empty(len(t), np.int64)
    low_of[sa] = lowest[run]
    again = low_of[window_at] < rank
    return _ranges(d[again], s[again])


def removed_ranges(docs: DataFrame) -> DataFrame:
    """``doc, lo, hi``: byte ranges, overlapping and in any order, that ``docs`` (``doc, text``) loses."""
    every = _all_segments(docs)
    # 1. Anchors met more than once.
    shared = written(_anchors(docs).groupBy("anchor").count().where("count > 1").select("anchor"))
    segments = written(every.join(shared, "anchor", "left_semi"))
    # 2. Copies of one segment.
    groups = written(_grouped(segments))
    ranges = [_later(segments, groups)]
    # 3. Different segments of one anchor.
    several = written(
        groups.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum(F.col("windows") + LENGTH).alias("bytes")).where("contents > 1")
    )
    firsts = groups.join(several, "anchor").select(
        "anchor", F.col("first.doc").alias("doc"), F.col("first.start").alias("start"), "windows", (F.col("contents") > MAX_SEGMENTS).alias("frequent")
    )
    wanted = firsts.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "windows", "frequent")).alias("cuts"))
    cut = written(_cuts(wanted.join(_packed(docs), "doc")))
    total = cut.where("not frequent").agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def in_shard(rows: pa.Table) -> pa.Table:
        doc, start = (np.array(rows.column(c).to_pylist(), np.int64) for c in ("doc", "start"))
        found = shard_duplicates(doc, start, rows.column("bytes").to_pylist())
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["doc", "lo", "hi"])

    sharded = cut.where("not frequent").select("doc", "start", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    ranges.append(sharded.groupBy("shard").applyInArrow(in_shard, "doc long, lo long, hi long"))
    # 4. Frequent anchors, window by window.
    single = written(_single_windows(cut.where("frequent")))
    ranges.append(_later(single, _grouped(single)))
    out = ranges[0]
    for r in ranges[1:]:
        out = out.unionByName(r)
    return out


def _cuts(rows: DataFrame) -> DataFrame:
    """The bytes of each wanted segment: ``anchor, doc, start, frequent, bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, cuts, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = zlib.decompress(packed)
                # A place past the end comes from another row of this id.
                held = [c for c in cuts if c["start"] + c["windows"] + LENGTH - 1 <= len(raw)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c["anchor"] for c in held], pa.int64()), pa.array([doc] * len(held), pa.int64()),
                     pa.array([c["start"] for c in held], pa.int64()), pa.array([c["frequent"] for c in held], pa.bool_()),
                     pa.array([raw[c["start"] : c["start"] + c["windows"] + LENGTH - 1] for c in held], pa.binary())],
                    names=["anchor", "doc", "start", "frequent", "bytes"],
                )

    return rows.select("doc", "cuts", "packed").mapInArrow(run, "anchor long, doc long, start long, frequent boolean, bytes binary")


def _single_windows(cut: DataFrame) -> DataFrame:
    """Each window of the segments as a segment of its own, its hashes being anchor and content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, start, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - LENGTH + 1)
                one, two = (_string_hash(data, k)(at, at + LENGTH).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(np.full(len(at), doc)), pa.array(at + start), pa.array(np.ones(len(at), np.int32))],
                    names=["anchor", "content", "doc", "start", "windows"],
                )

    return cut.select("doc", "start", "bytes").mapInArrow(run, _SEGMENT)


def without(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``raw``, the removed bytes, and the maximal removed runs."""
    kept, at, removed, spans, end = [], 0, 0, 0, -1
    for lo, hi in sorted(ranges):
        hi = min(hi, len(raw))
        if hi <= lo:
            continue
        if lo > end:
            spans += 1
            kept.append(raw[at:lo])
        removed += max(0, hi - max(lo, at))
        at = max(at, hi)
        end = max(end, hi)
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) and their digest."""
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ranges = removed_ranges(source.where("doc is not null")).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, packed, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = zlib.decompress(packed)
                kept, removed, spans = without(raw, [(r["lo"], r["hi"]) for r in found or ()])
                rows.append((doc, len(raw), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            )

    joined = _packed(source).join(ranges, "doc", "left").select("doc", "packed", "ranges")
    return joined.mapInArrow(run, _RESULT)


def op2_suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, removed bytes, removed runs and digest of what remains of every document."""
    return drop_repeated_strings(docs).drop("kept")
