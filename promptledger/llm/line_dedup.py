"""Line deduplication across documents.

Lines are exploded with their position, their normalised form is hashed, and
documents are counted per hash.  A key held by enough documents stays only in
the document with the largest id; what is left of each text is put together
again by position.

Defined cases.  A null or empty text is one empty line.  Rows without an id
keep all their lines and count for no key.  Repeated rows of one id are one
document; each row is returned.  A line that occurs several times in the
document that keeps it stays each time.  Other columns pass through, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, clear_of, free_name, written

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    n_lines: str | None = None,
    n_dropped: str | None = None,
) -> DataFrame:
    """``docs`` with the remaining lines in ``text_col``.

    ``n_lines`` and ``n_dropped`` name two added columns: the lines before
    dropping and the dropped ones; underscores come before a name that exists.
    """
    p = clear_of(docs.columns, "_line_")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # Rows that share an id are told apart by their text.
    version = F.xxhash64(F.col(text_col))

    at = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), version.alias("version"), F.posexplode(lines).alias("pos", "line")
    )
    keyed = (
        at.withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "version", "pos", F.unhex(F.md5("key")).alias("key"))
    )
    # Written, since it is read twice and far smaller than the texts.
    keyed = written(keyed)
    # Counted in two steps, (key, document) and key: a line of a third of all
    # documents reaches a task as one partial count per task before it.
    repeated = (
        keyed.groupBy("key", "doc").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_documents)
        .select("key", "keeper")
    )
    # Written, so that both sides of the join below are shuffled for it alone
    # and Spark can split the partition of a very frequent line.
    repeated = written(repeated)
    drops = (
        keyed.join(repeated, "key")
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("doc", "version")
        .agg(F.collect_set("pos").alias("gone"))
        .select(*(F.col(c).alias(p + c) for c in ("doc", "version", "gone")))
    )
    joined = docs.withColumn(p + "own", version).join(
        drops, (F.col(id_col) == F.col(p + "doc")) & (F.col(p + "own") == F.col(p + "version")), "left"
    )
    gone = F.coalesce(F.col(p + "gone"), F.array().cast("array<int>"))
    held = joined.withColumn(p + "lines", lines)
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(p + "lines") - 1), gone)
    kept = F.array_join(F.transform(kept_at, lambda i: F.get(F.col(p + "lines"), i)), "\n")
    out = {c: F.col(c) for c in docs.columns}
    out[text_col] = F.when(F.size(gone) == 0, F.col(text_col)).otherwise(kept)
    if n_lines:
        out[free_name(docs.columns, n_lines)] = F.size(p + "lines").cast("long")
    if n_dropped:
        out[free_name(docs.columns, n_dropped)] = F.size(gone).cast("long")
    return held.select(*(v.alias(k) for k, v in out.items()))


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the remaining text of every document."""
    out = drop_repeated_lines(docs.select("doc_id", "text"), n_lines="n_lines", n_dropped="n_dropped")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, pos, list[pos] AS line,
         translate(trim(list[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents),
       LATERAL (SELECT unnest(range(1, len(list) + 1)) AS pos)
),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(r.keeper <> l.doc_id, false) AS gone
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
