"""Quality rules as a short-circuit cascade.

Every rule is a small function of one document.  A bounded sample of documents
is measured first: what a rule costs and how many documents it rejects.  The
rules then run in descending order of rejections per cost, and a document that
one rule rejects is not shown to the later ones.  The order changes the time,
never the verdict: a document is kept when no rule rejects it.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Defined cases: a null or empty text has
no words and fails the base rule; rows without an id are judged like others;
repeated rows are judged each; other columns pass through; an empty table gives
an empty result and the rules in their written order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of, free_name, slices

SAMPLE_ROWS = 400  # documents measured to order the rules; the order has no effect on results

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


@dataclass
class Text:
    """One document and what the rules share of it."""

    raw: bytes
    words: list[bytes]


def word_chars(t: Text) -> int:
    """Code points inside words."""
    return len(t.raw.decode()) - (len(t.raw) - len(t.raw.translate(None, _SPACES)))


def n_symbols(t: Text) -> int:
    return len(t.raw) - len(t.raw.translate(None, _SYMBOLS))


def n_dup_lines(t: Text) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in t.raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def n_repeat_words(t: Text) -> int:
    """Words inside three-word windows that are found at least twice."""
    n = len(t.words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in t.words), np.int64, n)
    # A pair's number is its place among the text's pairs, so that three words fit a 64-bit key.
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] >= 2
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _mostly_upper(t: Text) -> bool:
    letters = len(t.raw) - len(t.raw.translate(None, _LETTERS))
    upper = len(t.raw) - len(t.raw.translate(None, _UPPER))
    return letters > 0 and 2 * upper > letters


def _copied_lines(t: Text) -> bool:
    lines = sum(1 for x in t.raw.split(b"\n") if x and not x.isspace())
    return lines >= 4 and 2 * n_dup_lines(t) > lines


RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t: 100 * n_symbols(t) > 30 * len(t.words)),
    Rule("upper_case", _mostly_upper),
    Rule("exclamation", lambda t: 100 * t.raw.count(b"!") > 50 * len(t.words)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= word_chars(t) <= 25 * len(t.words)),
    Rule("copied_lines", _copied_lines),
)


@dataclass(frozen=True)
class Measured:
    rule: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def measure(texts: Sequence[str], rules: Sequence[Rule] = RULES) -> list[Measured]:
    """Mean seconds and share of rejections of each rule over ``texts``."""
    parsed = [Text(b, b.split()) for b in (x.encode() for x in texts)]
    out = []
    for rule in rules:
        start = time.perf_counter()
        n = sum(rule.rejects(t) for t in parsed)
        spent = time.perf_counter() - start
        out.append(Measured(rule.name, spent / max(1, len(parsed)), n / max(1, len(parsed))))
    return out


def ordered_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per cost, as measured on at most ``rows`` documents inside one task."""
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).limit(rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        for batch in batches:
            texts += batch.column(0).to_pylist()
        found = measure(texts, rules)
        yield pa.RecordBatch.from_pydict({"rule": [m.rule for m in found], "worth": [m.worth for m in found]})

    worth = {r.rule: r.worth for r in sample.coalesce(1).mapInArrow(judge, "rule string, worth double").collect()}
    return sorted(rules, key=lambda r: -worth.get(r.name, 0.0))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_documents(
    docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, prefix: str = ""
) -> DataFrame:
    """``docs`` with the five counts, ``base_failed`` and ``kept``.

    Names come after ``prefix`` and, where such a column exists, underscores.
    """
    cascade = tuple(r.rejects for r in ordered_rules(docs, text_col, rules))
    at = docs.columns.index(text_col)
    added = [*((c, "long") for c in COUNTS), ("base_failed", "boolean"), ("kept", "boolean")]
    added = [(free_name(docs.columns, prefix + c), k) for c, k in added]
    schema = docs.schema
    for name, kind in added:
        schema = T.StructType([*schema.fields, T.StructField(name, T.LongType() if kind == "long" else T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in added]
            for value in batch.column(at):
                raw = (value.as_py() or "").encode()
                t = Text(raw, raw.split())
                counts = (len(t.words), word_chars(t), n_symbols(t), n_dup_lines(t), n_repeat_words(t))
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                kept = not failed and not any(rejects(t) for rejects in cascade)
                for column, v in zip(columns, (*counts, failed, kept)):
                    column.append(v)
            more = [pa.array(c, pa.bool_() if k == "boolean" else pa.int64()) for c, (_, k) in zip(columns, added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(n for n, _ in added)])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    p = clear_of(docs.columns, "_rule_")
    return judge_documents(docs, text_col, prefix=p).where(F.col(p + "kept")).select(*docs.columns)


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document."""
    return judge_documents(docs.select("doc_id", "text")).drop("text")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
),
triples AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3
),
named AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM triples),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM named),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) AS o(k) WHERE n >= 2 GROUP BY doc_id
),
counts AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS uppers,
         length(regexp_replace(text, '[^!]', '', 'g')) AS shouts
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (100 * n_symbols > 30 * n_words) AND NOT (letters > 0 AND 2 * uppers > letters)
       AND NOT (100 * shouts > 50 * n_words) AND word_chars BETWEEN 2 * n_words AND 25 * n_words
       AND NOT (n_lines >= 4 AND 2 * n_dup_lines > n_lines) AS kept
FROM counts
"""
