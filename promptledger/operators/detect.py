"""Detection over text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detection as fn
from ..functions.catalogue import DEFAULT_DETECTORS, SECRET, Detector
from ..functions.text import let
from ..storage import compute_once


def detect_pii(df: DataFrame, entities: Sequence[str] | None = None, text: str = "text",
               detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    return compute_once(df, "findings", fn.detect_pii(text, entities, detectors))


def detect_secrets(df: DataFrame, text: str = "text", detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    return compute_once(df, "findings", fn.detect_secrets(text, detectors))


def has_pii(df: DataFrame, entities: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    return compute_once(df, "has_pii", fn.has_pii(text, entities))


def redact(df: DataFrame, entities: Sequence[str] | None = None, text: str = "text", overlap: str = "merge",
           detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    """Add ``redacted``; the text itself stays."""
    return compute_once(df, "redacted", fn.redact(text, fn.detect_pii(text, entities, detectors), overlap))


def detect_jailbreak(df: DataFrame, text: str = "text") -> DataFrame:
    return compute_once(df, "jailbreak", fn.detect_jailbreak(text))


def _scan_summary(first: Column, name: Column, severity: Column) -> Column:
    return F.struct(
        first.isNotNull().alias("blocked"),
        F.when(first.isNotNull(), name).otherwise(F.lit("NONE")).alias("type"),
        F.when(first.isNotNull(), severity).otherwise(F.lit("NONE")).alias("severity"),
    )


def scan_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Verdict from the first finding that is no secret."""
    plain = [d for d in DEFAULT_DETECTORS if d.entity != SECRET]
    scan = let(
        fn.first_detector(text, fn.requested_detectors(None, plain)),
        lambda f: _scan_summary(f, F.upper(f["entity"]), F.lit("HIGH")),
    )
    return compute_once(df, "scan", scan)


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Verdict from the first secret."""
    scan = let(
        fn.first_secret(text),
        lambda f: _scan_summary(
            f, F.lit("SECRET_KEY"), F.when(f["confidence"] >= 0.9, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
        ),
    )
    return compute_once(df, "scan", scan)


def findings_table(df: DataFrame, keys: Sequence[str], entities: Sequence[str] | None = None, text: str = "text",
                   detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    """One row per finding."""
    found = df.select(*keys, F.explode(fn.detect_pii(text, entities, detectors)).alias("f"))
    return found.select(*keys, "f.*")


def findings_report(df: DataFrame, by: Sequence[str], key: str = "doc_id", entities: Sequence[str] | None = None,
                    text: str = "text", detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    """Documents and findings per entity and group.

    ``key`` is unique per row, so each row contributes at most one document per
    entity: counting inside the row replaces a distinct count, and the shuffle
    carries only partial sums.
    """
    found = compute_once(df, "f", fn.count_findings(text, entities, detectors)).select(*by, "f")
    names = F.array_distinct(F.transform("f", lambda f: f["entity"]))
    per_row = found.select(*by, "f", F.explode(names).alias("entity"))
    hits = F.aggregate(F.filter("f", lambda f: f["entity"] == F.col("entity")), F.lit(0), lambda a, f: a + f["n"])
    return per_row.groupBy(*by, "entity").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(hits.cast("long")).alias("findings")
    )


def scrub_corpus(df: DataFrame, action: str = "redact", entities: Sequence[str] | None = None, text: str = "text",
                 overlap: str = "merge", detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    """A corpus without its findings.

    ``redact`` replaces them, ``block`` drops the rows, ``flag`` keeps the rows;
    ``flagged`` tells which rows had findings.
    """
    def flag(rows: DataFrame) -> DataFrame:
        return compute_once(rows, "flagged", fn.has_pii(text, entities, detectors))

    if action == "block":
        return flag(df).where(~F.col("flagged"))
    if action == "flag":
        return flag(df)
    if action != "redact":
        raise ValueError(f"unknown action {action!r}")
    found = compute_once(df, "_f", fn.detect_pii(text, entities, detectors))
    return (
        found.withColumn("flagged", F.size("_f") > 0)
        .withColumn(text, fn.redact(text, "_f", overlap))
        .drop("_f")
    )
