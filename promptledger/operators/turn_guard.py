"""The input guard over requests that share their turns.

Every request of a conversation repeats all its earlier turns.  Scanning the
joined text of each request reads a turn once for every later answer.  Here

1.  every different message text is scanned once, whatever the number of
    requests that hold it; texts with nothing to report are dropped, and few
    are left;
2.  the reports meet the requests again by digest, in one narrow join;
3.  a request's verdict is composed: its first jailbreak pattern is the first
    of its texts' first ones, its findings are those of its texts in the order
    in which one scan of the joined text would give them.

That is exact as long as no match reaches across the line feed that joins two
texts.  Each detector says how one could (``border``); a request in which a
text ends and the next begins like that is scanned as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import DEFAULT_DETECTORS, JAILBREAKS, Detector
from ..functions.detection import detect_jailbreak, detect_pii, requested_detectors, requested_findings
from ..functions.text import is_blank, let
from ..functions.tokens import messages_to_text
from ..schemas import FINDINGS, JAILBREAK, VIOLATIONS
from ..storage import broadcast_if_small, materialize
from .guards import judged

GUARD = f"struct<allowed:boolean,violations:{VIOLATIONS}>"
_REPORT = f"struct<pos:int,findings:{FINDINGS},jailbreak:int,ends:int,starts:int>"


def can_compose(detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> bool:
    """Whether it is known of every detector how a match can reach across a line feed."""
    return all(d.border is not None for d in detectors)


def _borders(detectors: Sequence[Detector]) -> list[tuple[str, str]]:
    return sorted({d.border for d in (*detectors, *JAILBREAKS) if d.border})


def _mask(text: Column, patterns: Sequence[str]) -> Column:
    """A bit for each pattern that the text meets; an empty one is met by none here."""
    mask = F.lit(0)
    for k, p in enumerate(patterns):
        if p:
            mask = mask.bitwiseOR(F.when(F.rlike(text, F.lit(p)), F.lit(1 << k)).otherwise(0))
    return mask


def text_reports(texts: DataFrame, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    """``digest, findings, jailbreak, ends, starts`` of each different ``text`` that has anything to report."""
    borders = _borders(detectors)
    order = F.array(*[F.lit(p.pattern) for p in JAILBREAKS])
    text = F.col("text")
    scanned = texts.select("text").distinct().select(
        F.md5("text").alias("digest"),
        # Behind a generator, so that the filter below does not scan again.
        F.explode(F.array(F.struct(
            detect_pii(text, None, detectors).alias("findings"),
            let(detect_jailbreak(text), lambda j: F.when(j["flag"], F.array_position(order, j["pattern"]).cast("int"))).alias("jailbreak"),
            _mask(text, [b for b, _ in borders]).alias("ends"),
            _mask(text, [a for _, a in borders]).alias("starts"),
        ))).alias("r"),
    )
    some = (F.size("r.findings") > 0) | F.col("r.jailbreak").isNotNull() | (F.col("r.ends") > 0) | (F.col("r.starts") > 0)
    return scanned.where(some).select("digest", "r.*")


def _crossed(reports: Column, borders: Sequence[tuple[str, str]]) -> Column:
    """Whether a match may reach from one text of the request into the next."""
    alone = sum(1 << k for k, (_, after) in enumerate(borders) if not after)
    neighbours = F.zip_with(
        reports, F.slice(reports, 2, F.greatest(F.size(reports), F.lit(1))),
        lambda x, y: F.coalesce((y["pos"] == x["pos"] + 1) & (x["ends"].bitwiseAND(y["starts"]) != 0), F.lit(False)),
    )
    return F.exists(reports, lambda r: r["ends"].bitwiseAND(F.lit(alone)) != 0) | F.exists(neighbours, lambda n: n)


def _first_jailbreak(reports: Column) -> Column:
    rows = F.from_json(
        F.lit(json.dumps([{"flag": True, "confidence": 0.85, "pattern": p.pattern, "category": p.category} for p in JAILBREAKS])),
        f"array<{JAILBREAK}>",
    )
    none = F.from_json(F.lit('{"flag": false, "confidence": 0.0}'), JAILBREAK)
    first = F.array_min(F.transform(reports, lambda r: r["jailbreak"]))
    return let(first, lambda n: F.coalesce(F.get(rows, n - 1), none))


def _findings(reports: Column, detectors: Sequence[Detector]) -> Column:
    """The findings of all texts, one detector after the other, each from the first text to the last."""
    order = F.array(*[F.lit(d.detector) for d in requested_detectors(None, detectors)])
    placed = F.flatten(F.transform(
        reports,
        lambda r: F.transform(
            r["findings"],
            lambda f, k: F.struct(
                F.array_position(order, f["detector"]).alias("rank"), r["pos"].alias("pos"), k.alias("k"), f.alias("f")
            ),
        ),
    ))
    return F.transform(F.array_sort(placed), lambda x: x["f"]).cast(FINDINGS)


def guard_requests(
    df: DataFrame, key: str = "request_id", detectors: Sequence[Detector] = DEFAULT_DETECTORS, scanned: Column | None = None
) -> DataFrame:
    """``df`` with ``guard``: ``allowed`` and ``violations`` of ``messages`` under ``policy``.

    The same verdict as ``input_guard`` on the joined text; null where
    ``scanned`` is not true.  ``df`` is read three times and should be a stored
    table; ``key`` is unique (offsets of findings are those in their own text).
    """
    if not can_compose(detectors):
        raise ValueError("a detector does not say how its matches cross a line feed")
    scanned = F.lit(True) if scanned is None else F.coalesce(scanned, F.lit(False))
    borders = _borders(detectors)
    contents = F.filter(F.transform("messages", lambda m: m["content"]), lambda c: ~is_blank(c))
    texts = df.where(scanned).select(F.col(key).alias("_key"), F.posexplode(contents).alias("pos", "text"))
    reports = materialize(text_reports(texts, detectors), "text-reports")
    held = texts.select("_key", "pos", F.md5("text").alias("digest")).join(broadcast_if_small(reports), "digest")
    report = F.struct("pos", "findings", "jailbreak", "ends", "starts").cast(_REPORT)
    gathered = held.groupBy("_key").agg(F.array_sort(F.collect_list(report)).alias("_reports"))
    joined = df.join(gathered, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    reports_of = F.coalesce("_reports", F.array().cast(f"array<{_REPORT}>"))
    policy = F.col("policy")

    # One column after the other: expressions of this depth are resolved one by one.
    entities = policy["input_guard"]["detect_entities"]
    text = messages_to_text("messages")
    staged = (
        joined.withColumn("_reports", reports_of)
        .withColumn("_crossed", scanned & _crossed(F.col("_reports"), borders))
        .withColumn("_text", F.when(F.col("_crossed"), text))
        .withColumn("_found", _findings(F.col("_reports"), detectors))
        .withColumn("_found", requested_findings(F.col("_found"), entities, detectors))
        .withColumn("_found", F.when(F.col("_crossed"), detect_pii("_text", entities, detectors)).otherwise(F.col("_found")))
        .withColumn("_hit", F.when(F.col("_crossed"), detect_jailbreak("_text")).otherwise(_first_jailbreak(F.col("_reports"))))
        .withColumn("_judged", judged(F.col("_hit"), F.col("_found"), policy))
    )
    guard = F.struct(F.col("_judged.allowed").alias("allowed"), F.col("_judged.violations").alias("violations")).cast(GUARD)
    return staged.withColumn("guard", F.when(scanned, guard)).drop("_reports", "_crossed", "_text", "_found", "_hit", "_judged")
