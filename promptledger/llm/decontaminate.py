"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; shingles are five
consecutive words (a shorter item is one shingle, its whole sequence).  The
similarity of an item and a window of a document is the weighted Jaccard
similarity of their shingles, a shingle weighing as often as it occurs.

1.  A window that shares no shingle with an item has similarity 0 to it, so
    windows are laid where a shingle of some item occurs, as many words long as
    the item: shifted by the place of the shingle in the item, beginning with
    the shingle, and ending with it.  Moving any window right to its first
    shared shingle loses none, so one of the best windows of all starts begins
    with one.  Windows that begin or end with a shared shingle are left out
    where fewer shared places lie in them than a match needs.
2.  Each window and each item gets a 64-bit SimHash of its words.
3.  Fingerprints are cut into six blocks.  Two fingerprints at most 17 bits
    apart differ by at most two bits in some block, so items are indexed under
    every value at most two bits from theirs in each block, and windows look up
    their six values among items of their length: no fingerprint within the
    radius is missed.
    Windows of one text are one entry, and so are items of one text.
4.  The candidates' shingle counts are compared exactly, as intersections of
    numbered shingles (the square of a text's length only where it repeats
    some).  The best window is the most similar one; among equals one laid by the place in the item, then the
    first.

Defined cases: null or empty texts and items match nothing; rows without an id
are never reported and always kept; repeated rows are reported once; an item id
with several texts is reported when one of them is found; a window
that would reach over an end of its document is cut there; an empty benchmark
or an empty document table gives no match; other columns pass through.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY_PERCENT, ascii_lower, clear_of, table, words, written

BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit and width
BLOCK_RADIUS = 2
RADIUS = len(BLOCKS) * (BLOCK_RADIUS + 1) - 1

# Item shingles up to this number are broadcast (three numbers each: some tens
# of MB); more are joined by shuffling.
MAX_BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def _shingles(held: Column, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``width`` words; none if there are fewer."""
    n = F.size(held) - width + 1
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(held, i, width)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def _item_shingles(held: Column) -> Column:
    """As ``_shingles``; the whole sequence where it is shorter than a shingle."""
    return F.when(F.size(held) >= SHINGLE_WORDS, _shingles(held)).when(F.size(held) > 0, F.array(F.xxhash64(held))).otherwise(
        F.array().cast("array<bigint>")
    )


# Puts the two low bits of a number into two 32-bit lanes.
_SPREAD, _LANES = (1 << 31) | 1, (1 << 32) | 1


def _fingerprints(rows: DataFrame, keys: list[str], held: str) -> DataFrame:
    """``keys, simhash``: bit b is set when most words (all with their count) have bit b in their hash.

    Votes are counted in the 32-bit lanes of 32 sums, which no text's words overflow.
    """
    hashed = rows.select(*keys, F.explode(held).alias("word")).select(*keys, F.xxhash64("word").alias("h"))
    pairs = [
        F.sum((F.shiftrightunsigned("h", 2 * k).bitwiseAND(F.lit(3)) * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES))).alias(f"v{k}")
        for k in range(32)
    ]
    votes = hashed.groupBy(*keys).agg(F.count("*").alias("n"), *pairs)

    def bit(b: int) -> Column:
        lane = F.shiftrightunsigned(f"v{b // 2}", 32 * (b % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(2 * lane > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return votes.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), map(bit, range(64))).alias("simhash"))


def _version(held: Column) -> Column:
    """A digest of a sequence of words."""
    return F.unhex(F.md5(F.concat_ws(" ", held)))


def _counted(shingles: Column) -> Column:
    """A multiset as a set, from its sorted elements: the second, third ... of equal ones get hashes of their own.

    Then the sum of the smaller counts is the size of an intersection.
    """
    def place(x: Column, i: Column) -> Column:
        again = i + 1 - F.array_position(shingles, x)
        return F.when(again == 0, x).otherwise(F.xxhash64(x, again))

    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), shingles).otherwise(F.transform(shingles, place))


def _block(b: int) -> Column:
    first, width = BLOCKS[b]
    return F.shiftrightunsigned("simhash", first).bitwiseAND(F.lit((1 << width) - 1))


def _entry(b: int, flip: Column) -> Column:
    return F.struct(F.lit(b).alias("block"), _block(b).bitwiseXOR(flip).alias("value"))


def _index(items: DataFrame) -> DataFrame:
    """Items under every block value at most ``BLOCK_RADIUS`` bits from their own."""
    entries = []
    for b, (_, width) in enumerate(BLOCKS):
        near = [sum(1 << k for k in flip) for r in range(BLOCK_RADIUS + 1) for flip in combinations(range(width), r)]
        flips = F.array(*(F.lit(m).cast("long") for m in near))
        entries.append(F.transform(flips, partial(_entry, b)))
    return items.select("item", "size", F.col("simhash").alias("item_simhash"), F.explode(F.concat(*entries)).alias("e")).select(
        "item", "size", "item_simhash", "e.block", "e.value"
    )


def _dense(seen: DataFrame, percent: int) -> DataFrame:
    """``doc, start, size`` of the windows that begin or end with a shared place and hold enough of them to match.

    ``seen`` has ``doc, size, at``: where shingles of items of that many words occur.  A match has at least
    ``percent`` of its item's shingles in common, each at a place of its own.
    """
    places = seen.groupBy("doc", "size").agg(F.sort_array(F.collect_set("at")).alias("places"))
    wide = F.greatest(F.col("size") - SHINGLE_WORDS, F.lit(0))
    k = F.ceil((wide + 1) * percent / 100).cast("int")
    first, last = F.slice("places", F.lit(1), F.size("places") - k + 1), F.slice("places", k, F.size("places") - k + 1)
    spans = F.when(F.size("places") >= k, F.arrays_zip(first.alias("lo"), last.alias("hi")))
    # ``k`` places in a row within one window: it begins with the first of them, or ends with the last.
    near = places.select("doc", "size", wide.alias("wide"), F.explode(spans).alias("p")).where(F.col("p.hi") - F.col("p.lo") <= F.col("wide"))
    ends = F.array(F.col("p.lo"), F.greatest(F.col("p.hi") - F.col("wide"), F.lit(0)))
    return near.select("doc", F.explode(ends).alias("start"), "size")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", percent: int = SIMILARITY_PERCENT,
) -> DataFrame:
    """``doc, item, start, n_words, similarity, distance``: the best window of every document and item that match."""
    named = (
        benchmark.where(F.col(item_col).isNotNull())
        .select(F.col(item_col).alias("item"), words(ascii_lower(F.col(item_text_col))).alias("held")).where(F.size("held") > 0)
        .withColumn("wanted", _version(F.col("held")))
    )
    names = written(named.select("item", "wanted").distinct())
    # Each different text of items is one item, whatever its ids.
    items = written(
        named.groupBy("wanted").agg(F.first("held").alias("held"))
        .select("wanted", "held", F.size("held").alias("size"), F.array_sort(_item_shingles(F.col("held"))).alias("shingles"))
    )
    laid = items.select("size", F.posexplode(_item_shingles(F.col("held"))).alias("offset", "shingle")).distinct()
    # Items of fewer words than a shingle: their lengths are 1 to 4 at most.
    short = [r["size"] for r in items.where(F.col("size") < SHINGLE_WORDS).select("size").distinct().collect()]

    # 1. Where to lay windows.
    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), words(ascii_lower(F.col(text_col))).alias("held"))
    seen = read.select("doc", F.posexplode(_shingles(F.col("held"))).alias("at", "shingle"))
    for width in short:
        seen = seen.unionByName(read.select("doc", F.posexplode(_shingles(F.col("held"), width)).alias("at", "shingle")))
    start = F.greatest(F.col("at") - F.col("offset"), F.lit(0))
    met = written(seen.join(_small(laid), "shingle").select("doc", start.alias("start"), "size", "at").distinct())
    windows = met.select("doc", "start", "size", F.lit(1).alias("placed")).unionByName(
        _dense(met.select("doc", "size", "at").distinct(), percent).withColumn("placed", F.lit(0))
    )
    windows = written(windows.groupBy("doc", "start", "size").agg(F.max("placed").alias("placed")))
    cut = (
        read.join(_small(windows.withColumnRenamed("doc", "d")), F.col("doc") == F.col("d"))
        .select("doc", "start", "size", "placed", F.slice("held", F.col("start") + 1, F.col("size")).alias("held"))
        .where(F.size("held") > 0)
    )
    cut = written(cut.withColumn("version", _version(F.col("held"))))
    # A text that many windows hold is compared once.
    texts = cut.groupBy("version", "size").agg(F.first("held").alias("held"))
    texts = written(texts.withColumn("shingles", F.array_sort(_item_shingles(F.col("held")))))

    # 2. Fingerprints.
    prints = _fingerprints(texts, ["version", "size"], "held")
    indexed = _index(_fingerprints(items.withColumnRenamed("wanted", "item"), ["item", "size"], "held"))

    # 3. Look up.
    blocks = F.array(*(F.struct(F.lit(b).alias("block"), _block(b).alias("value")) for b in range(len(BLOCKS))))
    asked = prints.select("version", "size", "simhash", F.explode(blocks).alias("e")).select("version", "size", "simhash", "e.block", "e.value")
    distance = F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_simhash")))
    candidates = written(
        asked.join(indexed, ["block", "value", "size"]).where(distance <= RADIUS)
        .select("version", "size", F.col("item").alias("wanted"), distance.alias("distance")).distinct()
    )

    # 4. Verify.
    of_window = texts.select("version", "size", _counted(F.col("shingles")).alias("own"))
    of_item = items.select("wanted", _counted(F.col("shingles")).alias("its"))
    common = F.size(F.array_intersect("own", "its"))
    pairs = candidates.join(of_window, ["version", "size"]).join(_small(of_item), "wanted").select(
        "version", "size", "wanted", "distance", common.alias("common"), (F.size("own") + F.size("its")).alias("both")
    )
    union = F.col("both") - F.col("common")
    matched = written(
        pairs.where(100 * F.col("common") >= percent * union)
        .select("version", "size", "wanted", "distance", (F.col("common") / union).alias("similarity"))
    )
    placed = cut.select("doc", "start", "size", "placed", "version").join(_small(matched), ["version", "size"])
    best = F.max(F.struct("similarity", "placed", (-F.col("start")).alias("s"), "size", (-F.col("distance")).alias("d")))
    return placed.join(names, "wanted").groupBy("doc", "item").agg(best.alias("b")).select(
        "doc", "item", (-F.col("b.s")).alias("start"), F.col("b.size").alias("n_words"), F.col("b.similarity").alias("similarity"),
        (-F.col("b.d")).alias("distance"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    p = clear_of(docs.columns, "_leak_")
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc").alias(p + "doc")).distinct()
    return docs.join(leaks, F.col(id_col) == F.col(p + "doc"), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that match: doc_id, item_id, first word, words and similarity of the best window."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").cast("long").alias("start"),
        F.col("n_words").cast("long").alias("n_words"), "similarity",
    )


OP6_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
item_shingles AS (
  SELECT item_id, len(w) AS size, i - 1 AS o, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc_shingles AS (
  SELECT doc_id, i - 1 AS p, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)
),
windows AS (
  SELECT DISTINCT doc_id, item_id, size, greatest(p - o, 0) AS start FROM doc_shingles JOIN item_shingles USING (s)
),
seen AS (
  SELECT windows.doc_id, item_id, start, s, count(*) AS n FROM windows
  JOIN doc_shingles ON doc_shingles.doc_id = windows.doc_id AND p BETWEEN start AND start + size - 5 GROUP BY ALL
),
wanted AS (SELECT item_id, s, count(*) AS m FROM item_shingles GROUP BY ALL),
common AS (
  SELECT doc_id, item_id, start, sum(least(n, m)) AS c FROM seen JOIN wanted USING (item_id, s) GROUP BY ALL
),
sized AS (
  SELECT doc_id, item_id, start, c, (SELECT sum(m) FROM wanted x WHERE x.item_id = common.item_id) AS all_m,
         (SELECT sum(n) FROM seen y WHERE y.doc_id = common.doc_id AND y.item_id = common.item_id AND y.start = common.start) AS all_n
  FROM common
),
found AS (
  SELECT doc_id, item_id, start, c::DOUBLE / (all_m + all_n - c) AS similarity FROM sized WHERE 100 * c >= 75 * (all_m + all_n - c)
)
SELECT doc_id, item_id, (max({'x': similarity, 's': -start})).x AS similarity,
       -(max({'x': similarity, 's': -start})).s::BIGINT AS start, any_value(size)::BIGINT AS n_words
FROM found JOIN (SELECT item_id, len(w) AS size FROM item) USING (item_id) GROUP BY doc_id, item_id
"""
