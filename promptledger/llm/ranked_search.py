"""Ranked search of all documents for every item of a query table: hybrid TAAT-DAAT.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII;
only A-Z are lower-cased.  A document of ``n`` terms scores, over the terms of an
item (repeats included), the sum of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``
with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m = 25 + (75 * n * N) div L``.

1.  *Index.*  Tasks read documents and write blocks of an inverted index, one
    row for a block: the documents, their lengths, and the postings (document,
    tf) of the terms that occur in some item.  Only those terms take part in
    any score; N, L and all lengths count every term of every text.
2.  *Statistics.*  N, L and the df of the items' terms are sums over blocks.
3.  *Search* of a block for an item.  Lists are ordered by length.  The shortest
    ones, up to a share of the block's documents, are summed into accumulators,
    a term at a time.  The accumulators are then one more iterator, with bounds
    like those of the long lists, and the block is passed a window of documents
    at a time: a window whose bounds together stay below the item's threshold
    is skipped; in any other one only documents of the essential iterators (those
    without which the threshold cannot be reached) are candidates, and each
    further iterator is looked up only for candidates that can still reach it.
    The threshold is the score of the k-th best document so far, and is carried
    from block to block of a task.  A bound equal to it is never skipped, so
    that ties are decided by the ids.
4.  *Merge.*  Every task gives k documents for an item; the best k of these are
    the result.

The query table is a stated set.  It is taken in parts of about ``ITEM_CHARS``
characters, each of which is one pass over the documents; a task holds one part.

Defined cases.  A null or empty text, or one without a term, is no document for
N and is never returned.  A null id counts in the statistics and is not
returned.  Rows that repeat an id are documents of their own.  Rows that repeat
an item count once; an id with several texts is ranked for each.  An item
without a term, or an empty table on either side, gives no rows.  Other columns
are not read.  Long texts are cut between terms into pieces of 1 MB.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, written

BLOCK_DOCS = 32_768  # at most, and
BLOCK_TERMS = 1_000_000  # occurrences of items' terms, after which a block ends
ITEM_CHARS = 4_000_000  # of the items that are searched in one pass
WINDOW = 2048  # documents
SHORT = 8  # accumulators hold at most about one in so many documents of a block
_PIECE = 1 << 20

# Terms as the contract has them, in bytes: what separates them becomes a blank.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    raw = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE) if len(raw) - at > _PIECE else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Items(NamedTuple):
    """A part of the query table: for each item its id and its terms (numbers from 1) with their repeats."""

    ids: list
    queries: list[tuple[np.ndarray, np.ndarray]]
    number: dict[bytes, int]


def _items(rows: list[tuple]) -> Items:
    number: dict[bytes, int] = {}
    ids, queries = [], []
    for item, text in rows:
        counts = Counter(t for part in terms(text) for t in part)
        for t in counts:
            number.setdefault(t, len(number) + 1)
        if counts:
            ids.append(item)
            queries.append((np.array([number[t] for t in counts], np.int64), np.array(list(counts.values()), np.int64)))
    return Items(ids, queries, number)


def _parts(items: DataFrame, chars: int) -> Iterator[Items]:
    """The distinct items in parts of about ``chars`` characters, collected one after the other."""
    items = items.distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n):
        rows = items if n == 1 else items.where(part == k)
        yield _items(sorted(map(tuple, rows.collect()), key=str))


# -- index -----------------------------------------------------------------

INDEX = "n_docs long, n_terms long, docs array<long>, lengths binary, terms array<int>, held array<int>, places binary, tfs binary"


def index(docs: DataFrame, number: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of an inverted index over the terms of ``number``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        ids, lengths, sizes, found, seen = [], [], [], [], [0, 0]

        def block() -> pa.RecordBatch:
            n = len(ids)
            term = np.array(found, np.int64)
            place = np.repeat(np.arange(n), sizes)
            posting, tf = np.unique(term * max(1, n) + place, return_counts=True)
            term, place = np.divmod(posting, max(1, n))
            own, held = np.unique(term, return_counts=True)
            columns = [
                pa.array([seen[0]]), pa.array([seen[1]]), pa.array([ids], pa.list_(pa.int64())),
                pa.array([np.array(lengths, np.int64).tobytes()], pa.binary()),
                pa.array([own.astype(np.int32)], pa.list_(pa.int32())), pa.array([held.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([place.astype(np.int32).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary()),
            ]
            for x in (ids, lengths, sizes, found):
                x.clear()
            seen[:] = 0, 0
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])

        for batch in slices(batches, 64):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, before = 0, len(found)
                for part in terms(text):
                    n += len(part)
                    found.extend(filter(None, map(get, part)))
                seen[0] += n > 0
                seen[1] += n
                if len(found) > before:
                    ids.append(doc)
                    lengths.append(n)
                    sizes.append(len(found) - before)
                    if len(ids) >= BLOCK_DOCS or len(found) >= BLOCK_TERMS:
                        yield block()
        if seen[0]:
            yield block()

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


def _statistics(blocks: DataFrame, number: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each term number; at most one row for each term of the items is collected."""
    n, total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    held = blocks.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy("t.terms").agg(F.sum("t.held").alias("df"))
    df = np.zeros(len(number) + 1, np.int64)
    for row in held.collect():
        df[row[0]] = row[1]
    return n or 0, total or 0, df


# -- search ----------------------------------------------------------------


class _List(NamedTuple):
    """An iterator over a block: documents in order, what each adds, and for each window where it begins and the most it adds."""

    docs: np.ndarray
    adds: np.ndarray
    begin: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(docs: np.ndarray, adds: np.ndarray, edges: np.ndarray) -> _List:
        begin = np.searchsorted(docs, edges)
        most = np.zeros(len(edges) - 1, np.int64)
        some = np.flatnonzero(begin[1:] > begin[:-1])
        if len(some):
            most[some] = np.maximum.reduceat(adds, begin[some])
        return _List(docs, adds, begin, most)

    def times(self, weight: int) -> _List:
        return _List(self.docs, self.adds * weight, self.begin, self.most * weight)


class Best:
    """The best ``k`` documents of an item so far, equal scores by ascending id."""

    def __init__(self, k: int) -> None:
        self.k, self.docs, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """The least score that can still matter."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.append(self.docs, docs), np.append(self.scores, scores)
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]


class _Block:
    """A block of the index with what each posting adds under weight 1."""

    def __init__(self, row: dict, n: int, total: int) -> None:
        self.known = row["docs"].is_valid().to_numpy(zero_copy_only=False)
        self.ids = row["docs"].fill_null(0).to_numpy()
        m = 25 + (75 * np.frombuffer(row["lengths"], np.int64) * n) // total
        self.places = np.frombuffer(row["places"], np.int32).astype(np.int64)
        tf = np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        self.adds = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.places])
        self.at = {t: k for k, t in enumerate(row["terms"].to_numpy().tolist())}
        self.upto = np.append(0, np.cumsum(row["held"].to_numpy().astype(np.int64)))
        self.edges = np.append(np.arange(0, len(self.ids), WINDOW), len(self.ids))
        self.lists: dict[int, _List] = {}

    def size(self, k: int) -> int:
        return int(self.upto[k + 1] - self.upto[k])

    def postings(self, k: int) -> slice:
        return slice(int(self.upto[k]), int(self.upto[k + 1]))

    def list(self, k: int) -> _List:
        if k not in self.lists:
            self.lists[k] = _List.of(self.places[self.postings(k)], self.adds[self.postings(k)], self.edges)
        return self.lists[k]

    def accumulators(self, short: list[tuple[int, int]]) -> _List:
        """The short lists, summed a term at a time."""
        docs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, weight in short:
            own = self.places[self.postings(k)]
            merged = np.union1d(docs, own)
            total = np.zeros(len(merged), np.int64)
            total[np.searchsorted(merged, docs)] = sums
            total[np.searchsorted(merged, own)] += weight * self.adds[self.postings(k)]
            docs, sums = merged, total
        return _List.of(docs, sums, self.edges)

    def search(self, numbers: np.ndarray, weights: np.ndarray, best: Best) -> None:
        held = sorted(
            ((self.size(k), k, w) for t, w in zip(numbers.tolist(), weights.tolist()) if w > 0 and (k := self.at.get(t)) is not None)
        )
        room, cut = len(self.ids) // SHORT, 0
        while cut < len(held) and held[cut][0] <= room:
            room -= held[cut][0]
            cut += 1
        runs = [self.list(k).times(w) for _, k, w in held[cut:]]
        if cut:
            runs.append(self.accumulators([(k, w) for _, k, w in held[:cut]]))
        if not runs:
            return
        most = np.stack([r.most for r in runs])
        for w in np.flatnonzero(most.sum(axis=0) >= best.threshold):
            if most[:, w].sum() >= best.threshold:  # it has risen since
                self._window(int(w), runs, most[:, w], best)

    def _window(self, w: int, runs: list[_List], most: np.ndarray, best: Best) -> None:
        """One window: candidates of the essential iterators, then the others by falling bounds."""
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        left = np.cumsum(most[order][::-1])[::-1]  # what this iterator and those behind it can add
        threshold = best.threshold
        first, width = int(self.edges[w]), int(self.edges[w + 1] - self.edges[w])
        essential = int(np.searchsorted(-left, -threshold, side="right"))
        score, seen = np.zeros(width, np.int64), np.zeros(width, bool)
        for i in order[:essential]:
            part = slice(runs[i].begin[w], runs[i].begin[w + 1])
            at = runs[i].docs[part] - first
            score[at] += runs[i].adds[part]
            seen[at] = True
        at = np.flatnonzero(seen)
        score = score[at]
        for j in range(essential, len(order)):
            able = score + left[j] >= threshold
            at, score = at[able], score[able]
            if not len(at):
                return
            run = runs[order[j]]
            own = run.docs[run.begin[w] : run.begin[w + 1]] - first
            place = np.minimum(np.searchsorted(own, at), len(own) - 1)
            score = score + np.where(own[place] == at, run.adds[run.begin[w] + place], 0)
        fit = (score >= threshold) & self.known[first + at]
        if fit.any():
            best.offer(self.ids[first + at[fit]], score[fit])


def search(blocks: DataFrame, items: Items, k: int) -> DataFrame:
    """``item, item_id, doc_id, score``: the best ``k`` documents of each task for every item."""
    n, total, df = _statistics(blocks, items.number)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = [(numbers, times * weight[numbers]) for numbers, times in items.queries]
    ids = items.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for batch in slices(batches, 1):
            row = {name: batch.column(name)[0] for name in ("docs", "lengths", "terms", "held", "places", "tfs")}
            if not len(row["docs"].values):
                continue
            row = {name: x.values if isinstance(x, pa.ListScalar) else x.as_py() for name, x in row.items()}
            block = _Block(row, n, total)
            for (numbers, weights), own in zip(queries, best):
                block.search(numbers, weights, own)
        sizes = [len(b.docs) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(best)), sizes)), pa.array([i for i, size in zip(ids, sizes) for _ in range(size)], pa.int64()),
                    pa.array(np.concatenate([b.docs for b in best])), pa.array(np.concatenate([b.scores for b in best])),
                ],
                names=["item", "item_id", "doc_id", "score"],
            )

    return blocks.drop("n_docs", "n_terms").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` documents of every item with a score above 0."""
    items = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    out: DataFrame | None = None
    for part in _parts(items, item_chars):
        blocks = written(index(docs, part.number, id_col, text_col))
        # Written, so that the last step reads many tasks' rows in one of its own, where Spark keeps k of them.
        found = written(search(blocks, part, k))
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        top = found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _found(column: str) -> str:
    return f"unnest(regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}'))"


OP11_SQL = f"""
WITH item_terms AS (
    SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_found('text')} AS term FROM benchmark) GROUP BY ALL
), doc_terms AS (SELECT doc_id, {_found('text')} AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
tfs AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term
), adds AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS add
    FROM tfs JOIN lengths USING (doc_id) JOIN weights USING (term), totals
), scores AS (
    SELECT item_id, doc_id, CAST(sum(times * add) AS BIGINT) AS score FROM item_terms JOIN adds USING (term) GROUP BY ALL HAVING sum(times * add) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
