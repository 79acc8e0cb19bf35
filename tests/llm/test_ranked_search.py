"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from promptledger.llm import ranked_search as ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k=10):
    held = [(d, Counter(split(t))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in held:
            m = 25 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, rows, items, **options):
    df = ranking.ranked(docs(rows, extra=True).repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    text = "A-b_c 12Ä ÄÖ\x00x\x7fy z É'é"
    assert [t.decode() for part in ranking.terms(text) for t in part] == split(text)
    long = "ab cd " * 400_000 + "é" * 3_000_000 + " end"
    parts = list(ranking.terms(long))
    assert len(parts) > 2 and [t.decode() for p in parts for t in p] == split(long)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(0, n, 7)]  # ties
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 25)))) for i in range(20)]
    return rows, items


@pytest.mark.parametrize("seed,chars", [(1, 10**6), (2, 300)])
def test_equals_plain_scoring(spark, docs, seed, chars):
    rows, items = corpus(seed, 400)
    assert run(spark, docs, rows, items, item_chars=chars) == plain(rows, items)


@pytest.mark.parametrize("window,short", [(4, 2), (16, 8), (64, 1), (1, 10**6)])
def test_a_block_equals_plain_scoring(monkeypatch, window, short):
    """The search of one block in this process, where windows and shares are set."""
    monkeypatch.setattr(ranking, "WINDOW", window)
    monkeypatch.setattr(ranking, "SHORT", short)
    rows, items = corpus(window, 300)
    made = ranking._items(items)
    held = [Counter(split(t)) for _, t in rows]
    n, total = len(rows), sum(sum(c.values()) for c in held)
    postings = sorted((made.number[t.encode()], k, c[t]) for k, c in enumerate(held) for t in c if t.encode() in made.number)
    own, counts = np.unique([p[0] for p in postings], return_counts=True)
    block = ranking._Block({
        "docs": pa.array([d for d, _ in rows], pa.int64()), "lengths": np.array([sum(c.values()) for c in held], np.int64).tobytes(),
        "terms": pa.array(own, pa.int32()), "held": pa.array(counts, pa.int32()),
        "places": np.array([p[1] for p in postings], np.int32).tobytes(), "tfs": np.array([p[2] for p in postings], np.int32).tobytes(),
    }, n, total)
    df = Counter(t for c in held for t in c)
    weight = {made.number[t.encode()]: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items() if t.encode() in made.number}
    out = []
    for item, (numbers, times) in zip(made.ids, made.queries):
        best = ranking.Best(10)
        block.search(numbers, np.array([x * weight.get(t, 0) for t, x in zip(numbers.tolist(), times.tolist())]), best)
        out += [(item, r, d, s) for r, (d, s) in enumerate(zip(best.docs.tolist(), best.scores.tolist()), 1)]
    assert sorted(out, key=str) == plain(rows, items)


def test_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, "-- !"), (4, "one two"), (4, "one two"), (None, "one one"), (6, "three " * 30_000 + "one"), (7, "TWO")]
    items = [(1, "One two?"), (1, "One two?"), (2, None), (3, ""), (4, "four"), (5, "three three one"), (6, "..")]
    assert run(spark, docs, rows, items) == plain(rows, sorted(set(items), key=str))


def test_empty(spark, docs):
    assert run(spark, docs, [], [(1, "a")]) == [] and run(spark, docs, [(1, "a")], []) == []
