"""Span detection and redaction as column functions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FINDING, FINDINGS, JAILBREAK
from .catalogue import (
    DEFAULT_DETECTORS,
    ENTITIES,
    GENERIC,
    HIGH,
    JAILBREAKS,
    SECRET,
    Detector,
    JailbreakPattern,
)
from .text import col, fold_case, let, running, slice_text, text_blocks

# Four decimal digits in a row, as in every number-shaped detector.
DIGIT_RUN = r"\p{Nd}{4}"

SPANS = "array<struct<text:string,start:int,end:int>>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def find_spans(text: Column | str, pattern: Column | str) -> Column:
    """Every non-overlapping match with its text and code-point offsets.

    The matches and the gaps between them come from two native passes; offsets
    are running sums of their lengths.
    """
    text = col(text)
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def place(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        lengths = F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.length(hit))
        ends = running(lengths, lambda x, y: x + y, F.lit(0))
        found = F.zip_with(
            hits, ends, lambda hit, end: F.struct(hit.alias("text"), (end - F.length(hit)).alias("start"), end.alias("end"))
        )
        return F.when(F.size(hits) > 0, found.cast(SPANS)).otherwise(_empty(SPANS))

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.coalesce(let(hits, place), _empty(SPANS))


_DETECTOR = (
    "struct<entity:string,detector:string,regex:string,tier:string,confidence:double,"
    "needles:array<string>,marks:array<string>,folded:boolean,digit_run:boolean>"
)
_TIERED = "array<struct<finding:" + FINDING + ",tier:string>>"


def _as_rows(detectors: Sequence[Detector]) -> Column:
    """The catalogue as one array constant (folded at planning time)."""
    rows = []
    for d in detectors:
        lettered = any(c.isalpha() for n in d.needles for c in n)
        folded = d.ignore_case and lettered
        marks = sorted({n[0] for n in d.needles}) if folded else []
        rows.append({
            "entity": d.entity, "detector": d.detector, "regex": d.regex, "tier": d.tier,
            "confidence": d.confidence, "needles": list(d.needles), "folded": folded,
            # Punctuation that starts the needles: no need to fold texts without it.
            "marks": [] if any(m.isalpha() for m in marks) else marks,
            "digit_run": d.digit_run,
        })
    return F.from_json(F.lit(json.dumps(rows)), f"array<{_DETECTOR}>")


def _holds_any(text: Column, words: Column) -> Column:
    return (F.size(words) == 0) | F.exists(words, lambda n: F.contains(text, n))


def _candidates(ctx: Column, detectors: Column) -> Column:
    """Detectors whose cheap necessary condition the text meets."""
    text = ctx["text"]
    return F.filter(
        detectors,
        lambda d: (~d["digit_run"] | ctx["digits"])
        & _holds_any(text, d["marks"])
        & F.when(d["folded"], _holds_any(fold_case(text), d["needles"])).otherwise(_holds_any(text, d["needles"])),
    )


def _context(text: Column) -> Column:
    return F.struct(text.alias("text"), text.rlike(DIGIT_RUN).alias("digits"))


def _find(text: Column, detectors: Column) -> Column:
    """Findings of the candidate detectors, one detector after the other.

    The catalogue is data, so one span expression serves all detectors and the
    plan does not grow with their number.
    """

    def each(ctx: Column) -> Column:
        found = F.transform(
            _candidates(ctx, detectors),
            lambda d: F.transform(
                find_spans(ctx["text"], d["regex"]),
                lambda s: F.struct(
                    F.struct(d["entity"], d["detector"], s["text"], s["start"], s["end"], d["confidence"]),
                    d["tier"],
                ),
            ).cast(_TIERED),
        )
        return let(F.flatten(found), _without_covered)

    # The text may itself be an expression: evaluate it once.
    return F.coalesce(let(text, lambda t: let(_context(t), each)), _empty(FINDINGS))


def _without_covered(found: Column) -> Column:
    """Drop generic credentials that overlap a credential known by its prefix.

    One sweep: known ones by their start and generic ones by their end are put
    in one order, along which the farthest end of the known ones runs.  A
    generic one is covered when that end, where it stands, is behind its start.
    (Few steps in one another: the expression is a part of deep ones.)
    """
    high = F.exists(found, lambda x: x["tier"] == HIGH)
    generic = F.exists(found, lambda x: x["tier"] == GENERIC)
    # At the same place a generic end comes before a known start: they only touch.
    events = F.array_sort(
        F.transform(
            found,
            lambda x, i: F.struct(
                F.when(x["tier"] == GENERIC, x["finding"]["end"]).otherwise(x["finding"]["start"]).alias("at"),
                (x["tier"] != GENERIC).cast("int").alias("kind"),
                i.alias("i"),
                F.when(x["tier"] == HIGH, x["finding"]["end"]).otherwise(0).alias("reach"),
                F.when(x["tier"] == GENERIC, x["finding"]["start"]).alias("start"),
            ),
        )
    )

    state = "struct<reach:int,covered:array<int>>"

    def step(acc: Column, e: Column) -> Column:
        covered = F.when(acc["reach"] > e["start"], F.concat(acc["covered"], F.array(e["i"]))).otherwise(acc["covered"])
        return F.struct(F.greatest(acc["reach"], e["reach"]).alias("reach"), covered.alias("covered")).cast(state)

    zero = F.struct(F.lit(0).alias("reach"), F.array().cast("array<int>").alias("covered")).cast(state)
    covered = F.aggregate(events, zero, step, lambda acc: acc["covered"])
    left = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), covered)
    return F.when(generic & high, F.transform(left, lambda i: F.get(found, i)["finding"])).otherwise(
        F.transform(found, lambda x: x["finding"])
    )


def _secret_order(detectors: Sequence[Detector]) -> list[Detector]:
    secrets = [d for d in detectors if d.entity == SECRET]
    return [d for d in secrets if d.tier != GENERIC] + [d for d in secrets if d.tier == GENERIC]


def detect_secrets(text: Column | str, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> Column:
    """Secret findings; a generic one is dropped when it overlaps a known prefix (D3)."""
    return _find(col(text), _as_rows(_secret_order(detectors)))


def all_entities(detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> list[str]:
    """The built-in entities and those that added detectors bring."""
    return list(dict.fromkeys([*ENTITIES, *(d.entity for d in detectors)]))


def known_entities(entities: Sequence[str] | None, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> list[str]:
    """Requested names that exist, in the requested order; nothing left means all."""
    every = all_entities(detectors)
    return [e for e in (entities or ()) if e in every] or every


def requested_detectors(entities: Sequence[str] | None, detectors: Sequence[Detector]) -> list[Detector]:
    """Detectors of the requested entities: secrets first, then as requested."""
    names = known_entities(entities, detectors)
    ordered = _secret_order(detectors) if SECRET in names else []
    for name in names:
        if name != SECRET:
            ordered += [d for d in detectors if d.entity == name]
    return ordered


def detect_pii(
    text: Column | str,
    entities: Sequence[str] | Column | None = None,
    detectors: Sequence[Detector] = DEFAULT_DETECTORS,
) -> Column:
    """Findings of a text: secrets first, then the other entities as requested.

    ``entities`` is a list of names, or an array column when it differs by row.
    """
    text = col(text)
    if not isinstance(entities, Column):
        return _find(text, _as_rows(requested_detectors(entities, detectors)))
    rows = _as_rows(requested_detectors(None, detectors))

    def found(names: Column) -> Column:
        of_names = F.filter(rows, lambda d: F.array_contains(names, d["entity"]))
        return let(_find(text, of_names), lambda f: _as_requested(f, names))

    return let(_names(entities, detectors), found)


def _names(entities: Column, detectors: Sequence[Detector]) -> Column:
    """The requested names that exist; all if none does."""
    every = all_entities(detectors)
    known = F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e.isin(*every))
    return F.when(F.size(known) == 0, F.array(*[F.lit(e) for e in every])).otherwise(known)


def _as_requested(found: Column, names: Column) -> Column:
    """Findings that are in the catalogue's order: secrets first, then as requested."""
    secret = F.filter(found, lambda f: f["entity"] == SECRET)
    others = F.filter(names, lambda e: e != SECRET)
    ordered = F.flatten(F.transform(others, lambda e: F.filter(found, lambda f: f["entity"] == e)))
    return F.when(F.size(found) == 0, found).otherwise(F.concat(secret, ordered))


def requested_findings(found: Column, entities: Column, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> Column:
    """What ``detect_pii`` gives for ``entities``, from all findings in the catalogue's order."""

    def chosen(names: Column) -> Column:
        return let(F.filter(found, lambda f: F.array_contains(names, f["entity"])), lambda f: _as_requested(f, names))

    return let(_names(entities, detectors), chosen)


def first_detector(text: Column | str, detectors: Sequence[Detector]) -> Column:
    """The first of ``detectors`` that matches, as a catalogue row, or null: no spans."""
    rows = _as_rows(detectors)
    return let(
        _context(col(text)),
        lambda ctx: F.get(F.filter(_candidates(ctx, rows), lambda d: F.rlike(ctx["text"], d["regex"])), F.lit(0)),
    )


def first_secret(text: Column | str, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> Column:
    """The detector of the first secret.  Known prefixes come first, so a covered generic one is never it."""
    return first_detector(text, _secret_order(detectors))


def count_findings(
    text: Column | str, entities: Sequence[str] | None = None, detectors: Sequence[Detector] = DEFAULT_DETECTORS
) -> Column:
    """``array<struct<entity, n>>`` of what ``detect_pii`` finds, one entry per detector that matches.

    Matches are counted; spans are found only where a generic credential may be
    covered by one of a known prefix.
    """
    rows = _as_rows(requested_detectors(entities, detectors))

    def counted(ctx: Column) -> Column:
        return F.filter(
            F.transform(
                _candidates(ctx, rows),
                lambda d: F.struct(d["entity"].alias("entity"), F.regexp_count(ctx["text"], d["regex"]).alias("n"), d["tier"].alias("tier")),
            ),
            lambda c: c["n"] > 0,
        )

    def settled(both: Column) -> Column:
        counts = both["counts"]
        meet = F.exists(counts, lambda c: c["tier"] == GENERIC) & F.exists(counts, lambda c: c["tier"] == HIGH)
        plain = F.transform(counts, lambda c: F.struct(c["entity"].alias("entity"), c["n"].cast("int").alias("n")))
        spans = F.transform(_find(both["text"], rows), lambda f: F.struct(f["entity"].alias("entity"), F.lit(1).alias("n")))
        return F.when(meet, spans).otherwise(plain)

    found = let(
        col(text), lambda t: let(F.struct(t.alias("text"), let(_context(t), counted).alias("counts")), settled)
    )
    return F.when(col(text).isNotNull(), found).otherwise(_empty("array<struct<entity:string,n:int>>"))


def has_pii(
    text: Column | str,
    entities: Sequence[str] | None = None,
    detectors: Sequence[Detector] = DEFAULT_DETECTORS,
) -> Column:
    """True when anything is found (D4): gates and ``rlike`` only, no spans."""
    rows = _as_rows(requested_detectors(entities, detectors))
    test = let(
        _context(col(text)),
        lambda ctx: F.exists(_candidates(ctx, rows), lambda d: F.rlike(ctx["text"], d["regex"])),
    )
    return F.coalesce(test, F.lit(False))


def placeholder(entity: Column) -> Column:
    return F.concat(F.lit("["), F.upper(entity), F.lit("_REDACTED]"))


def redact(text: Column | str, findings: Column | str, overlap: str = "merge") -> Column:
    """Replace findings by ``[TYPE_REDACTED]``.

    ``merge`` joins overlapping findings into one placeholder named after the
    longest of them (the earlier finding on a tie).  ``compat`` replaces one
    finding after the other from the right, overlaps included, which can garble
    the text.
    """
    if overlap not in ("merge", "compat"):
        raise ValueError(f"unknown overlap mode {overlap!r}")
    replace = _redact_merge if overlap == "merge" else _redact_compat

    def apply(ctx: Column) -> Column:
        clean = F.coalesce(F.size(ctx["findings"]), F.lit(0)) <= 0
        return F.when(clean, ctx["text"]).otherwise(replace(ctx["text"], ctx["findings"]))

    return let(F.struct(col(text).alias("text"), col(findings).alias("findings")), apply)


_CUT = "struct<add:int,least:int>"


def _redact_compat(text: Column, findings: Column) -> Column:
    """Findings replaced one after the other from the right, each at its original place in the text so far.

    A replacement keeps the text before its start, and what stands behind its
    end.  Where the finding reaches over the start of the one replaced before,
    the end lies in what has been put there, and so many characters of it are
    lost, first of its placeholder, then of what follows.  With ``X`` lost
    characters in front of a placeholder of length ``P`` and the ``g`` original
    characters behind it, ``c + max(0, X - P - g)`` are lost in front of the next
    one to the right, c being what the finding itself reaches over.
    These steps compose, so X is a running value over the findings.
    """
    # Rightmost start first; the position in the list keeps equal starts in order.
    ordered = F.array_sort(
        F.transform(
            findings,
            lambda f, i: F.struct(
                (-f["start"]).alias("back"), i.alias("i"), f["end"].alias("end"), placeholder(f["entity"]).alias("put")
            ),
        )
    )

    def pieces(ctx: Column) -> Column:
        held, n = ctx["held"], ctx["n"]

        def part(f: Column, k: Column) -> Column:
            # Where the finding to the right starts, and what lies between.
            right = F.when(k == 0, n).otherwise(-F.get(held, k - 1)["back"])
            return F.struct(
                f["put"].alias("put"), f["end"].alias("from"), right.alias("upto"),
                (F.length(f["put"]) + F.greatest(right - f["end"], F.lit(0))).alias("size"),
                F.greatest(f["end"] - right, F.lit(0)).alias("over"),
            )

        return F.reverse(F.transform(held, part))  # from left to right

    def joined(ctx: Column) -> Column:
        parts, blocks = ctx["parts"], ctx["blocks"]
        # What is lost in front of the next: x -> max(0, x - size) + over, as a step that composes.
        steps = F.transform(
            parts, lambda p: F.struct((p["over"] - p["size"]).alias("add"), p["over"].alias("least")).cast(_CUT)
        )
        compose = lambda x, y: F.struct(
            (x["add"] + y["add"]).alias("add"), F.greatest(y["least"], x["least"] + y["add"]).alias("least")
        ).cast(_CUT)
        zero = F.struct(F.lit(0).alias("add"), F.lit(-(2**30)).alias("least")).cast(_CUT)

        def shown(lost: Column) -> Column:
            def one(p: Column, k: Column) -> Column:
                x = F.when(k == 0, F.lit(0)).otherwise(let(F.get(lost, k - 1), lambda s: F.greatest(s["least"], s["add"])))
                return let(
                    x,
                    lambda x: F.concat(
                        F.substring(p["put"], x + 1, F.greatest(F.length(p["put"]) - x, F.lit(0))),
                        slice_text(blocks, p["from"] + F.greatest(x - F.length(p["put"]), F.lit(0)), p["upto"]),
                    ),
                )

            return F.array_join(F.transform(parts, one), "")

        return let(running(steps, compose, zero, _CUT), shown)

    def rebuild(ctx: Column) -> Column:
        first = -F.element_at(ctx["held"], -1)["back"]
        body = let(F.struct(pieces(ctx).alias("parts"), ctx["blocks"].alias("blocks")), joined)
        return F.concat(slice_text(ctx["blocks"], F.lit(0), first), body)

    return let(F.struct(ordered.alias("held"), text_blocks(text).alias("blocks"), F.length(text).alias("n")), rebuild)


_CLUSTER = "struct<start:int,end:int,best:int,entity:string>"


def merge_findings(findings: Column | str) -> Column:
    """Overlapping findings joined into ``start, end, best, entity`` clusters, in order.

    A finding opens a cluster when it starts at or behind the end of all before
    it; the cluster is named after its longest finding, the earliest on a tie.
    """
    ordered = F.array_sort(
        F.transform(
            col(findings),
            lambda f, i: F.struct(
                f["start"].alias("start"),
                (f["start"] - f["end"]).alias("shortness"),
                i.alias("i"),
                f["end"].alias("end"),
                f["entity"].alias("entity"),
            ),
        )
    )

    def clusters(ctx: Column) -> Column:
        held, reach = ctx["held"], ctx["reach"]
        opens = F.filter(
            F.sequence(F.lit(0), F.size(held) - 1),
            lambda i: (i == 0) | (F.get(held, i)["start"] >= F.get(reach, i - 1)),
        )

        def joined(firsts: Column) -> Column:
            def one(first: Column, k: Column) -> Column:
                last = F.coalesce(F.get(firsts, k + 1), F.size(held)) - 1
                longest = F.array_min(
                    F.transform(
                        F.slice(held, first + 1, last - first + 1),
                        lambda f: F.struct(f["shortness"].alias("shortness"), f["start"].alias("start"), f["i"].alias("i"), f["entity"].alias("entity")),
                    )
                )
                return let(
                    longest,
                    lambda best: F.struct(
                        F.get(held, first)["start"].alias("start"), F.get(reach, last).alias("end"),
                        (-best["shortness"]).alias("best"), best["entity"].alias("entity"),
                    ).cast(_CLUSTER),
                )

            return F.transform(firsts, one)

        return let(opens, joined)

    def walk(held: Column) -> Column:
        reach = running(F.transform(held, lambda f: f["end"]), lambda x, y: F.greatest(x, y), F.lit(0))
        return let(F.struct(held.alias("held"), reach.alias("reach")), clusters)

    return let(ordered, lambda held: F.when(F.size(held) > 0, walk(held)).otherwise(_empty(f"array<{_CLUSTER}>")))


def _redact_merge(text: Column, findings: Column) -> Column:
    def rebuild(ctx: Column) -> Column:
        clusters, blocks = ctx["clusters"], ctx["blocks"]
        pieces = F.transform(
            clusters,
            lambda c, i: F.concat(
                slice_text(
                    blocks,
                    F.when(i == 0, F.lit(0)).otherwise(F.get(clusters, i - 1)["end"]),
                    c["start"],
                ),
                placeholder(c["entity"]),
            ),
        )
        tail = slice_text(blocks, F.element_at(clusters, -1)["end"], ctx["n"])
        return F.concat(F.array_join(pieces, ""), tail)

    ctx = F.struct(
        merge_findings(findings).alias("clusters"),
        text_blocks(text).alias("blocks"),
        F.length(text).alias("n"),
    )
    return let(ctx, rebuild)


def detect_jailbreak(text: Column | str, patterns: Sequence[JailbreakPattern] = JAILBREAKS) -> Column:
    """First pattern of the ordered list that occurs in the text.

    Each regex runs only on rows whose folded text holds the pattern's needle.
    """

    # Patterns that share a needle share its test; ``n`` keeps the list order.
    groups: dict[str, list[dict]] = {}
    for n, p in enumerate(patterns):
        # A pattern that is its own needle needs no regex.
        regex = "" if p.pattern == p.needle else p.regex
        row = {"n": n, "pattern": p.pattern, "category": p.category, "regex": regex}
        groups.setdefault(p.needle, []).append(row)
    rows = F.from_json(
        F.lit(json.dumps([{"needle": k, "patterns": v} for k, v in groups.items()])),
        "array<struct<needle:string,patterns:array<struct<n:int,pattern:string,category:string,regex:string>>>>",
    )

    def first_hit(ctx: Column) -> Column:
        held = F.filter(rows, lambda g: F.contains(ctx["folded"], g["needle"]))
        hits = F.filter(
            F.flatten(F.transform(held, lambda g: g["patterns"])),
            lambda p: (p["regex"] == "") | F.rlike(ctx["text"], p["regex"]),
        )
        return let(
            F.array_min(hits),
            lambda p: F.struct(
                p.isNotNull().alias("flag"),
                F.when(p.isNotNull(), F.lit(0.85)).otherwise(F.lit(0.0)).alias("confidence"),
                p["pattern"].alias("pattern"),
                p["category"].alias("category"),
            ).cast(JAILBREAK),
        )

    none = F.from_json(F.lit('{"flag": false, "confidence": 0.0}'), JAILBREAK)
    hit = let(
        col(text),
        lambda t: F.when(
            t.isNotNull(), let(F.struct(t.alias("text"), fold_case(t).alias("folded")), first_hit)
        ),
    )
    return F.coalesce(hit, none)
