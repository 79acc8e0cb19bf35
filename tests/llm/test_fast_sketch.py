"""Fast similarity sketching and the links of hubs against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from promptledger.llm import fast_sketch, hubs
from promptledger.llm.queries import QUERIES

from .test_rules_lines_pairs import lower, near_rows, words

SF = "/root/testdata/sf0.001"


def groups(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def shingles(text):
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    ids = {d for d, _ in sets if d is not None}
    named = [(d, s) for d, s in sets if d is not None and s]
    pairs = [
        (a, b) for i, (a, s) in enumerate(named) for b, t in named[:i]
        if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t)
    ]
    at = groups(ids, pairs)
    return sorted(((d, len(s), None if d is None else at[d], d is None or at[d] == d) for d, s in sets), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(docs, seed):
    rows = near_rows(seed)
    assert got(fast_sketch.op12_fast_sketch(docs(rows, extra=True).repartition(4))) == plain(rows)


def test_cases(docs):
    say = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tB"), (6, say), (7, say + " x"), (7, "other text of one id here"), (8, "other text of one id here"),
        (9, say), (9, say), (None, say), (None, None), (10, "word " * 50_000), (11, "word " * 3), (12, "word " * 70_000),
    ]
    assert got(fast_sketch.op12_fast_sketch(docs(rows, extra=True))) == plain(rows)
    kept = fast_sketch.kept_documents(docs(rows, extra=True))
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id)) == [1, 2, 3, 4, 6, 10, 11]


def test_empty(docs):
    assert got(fast_sketch.op12_fast_sketch(docs([]))) == []


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op12_fast_sketch"](spark, SF)) == plain(rows)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    every = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [every[:1], every[:6], every[:7], every[:300], every[30:330], every[:3000], every[500:]]
    out = fast_sketch.sketches(sets)
    assert not (out == fast_sketch._EMPTY).any()
    # A set's sketch does not depend on its batch, nor on the order of its elements.
    for k, s in enumerate(sets):
        assert (fast_sketch.sketches([s[::-1]])[0] == out[k]).all()
    for i, j, similarity in ((1, 2, 6 / 7), (3, 4, 270 / 330), (5, 6, 2500 / 3000), (0, 4, 0)):
        assert abs((out[i] == out[j]).mean() - similarity) < 0.08


def test_bands_find_what_links():
    rng = np.random.default_rng(4)
    missed = 0
    for n in (6, 20, 57, 400):
        pairs = []
        for _ in range(60):
            every = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            i = -(-85 * (n + 1) // 100)  # the least similarity that links
            pairs += [every[: n], np.append(every[: i], every[n : n + max(0, (100 * i) // 85 - n)])]
        keys = fast_sketch.bands(fast_sketch.sketches(pairs))
        missed += sum(not (keys[k] == keys[k + 1]).any() for k in range(0, len(pairs), 2))
    assert missed == 0


@pytest.mark.parametrize("percent,small,seed", [(85, 4, 1), (75, 4, 2)])
def test_hubs_connect_what_all_pairs_connect(spark, monkeypatch, percent, small, seed):
    """Sets around several centres, all of them in one bucket."""
    monkeypatch.setattr(hubs, "SMALL", small)
    monkeypatch.setattr(hubs, "CROWD", 2 * small)
    rnd = random.Random(seed)
    sets = []
    for _ in range(2):
        centre = {rnd.randrange(10**6) for _ in range(60)}
        for _ in range(14):
            s = set(centre)
            for _ in range(rnd.randint(0, 25)):
                s.discard(rnd.choice(sorted(centre)))
                if rnd.random() < 0.5:
                    s.add(rnd.choice(sorted(centre)) if rnd.random() < 0.5 else rnd.randrange(10**6))
            sets.append(frozenset(s))
    sets = sorted(set(sets), key=sorted)
    rows = [(k, len(s), np.sort(np.array(sorted(s), np.uint64)).tobytes()) for k, s in enumerate(sets)]
    frame = spark.createDataFrame([(k, n, bytearray(t)) for k, n, t in rows], "node long, n long, tokens binary")
    buckets = spark.createDataFrame([(1, k) for k in range(len(sets))] + [(2, k) for k in range(0, len(sets), 3)], "sig long, node long")
    found = [tuple(r) for r in hubs.links(buckets, frame, percent).select("a", "b").collect()]
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert set(found) <= linked
    assert groups(range(len(sets)), found) == groups(range(len(sets)), linked)


@pytest.mark.parametrize("percent", [75, 85])
def test_only_sets_that_may_link_are_moved_whole(spark, monkeypatch, percent):
    """Of many unlike sets of one bucket those with a partner are compared on all elements, and are found."""
    monkeypatch.setattr(hubs, "SMALL", 2)
    moved, gaps = [], hubs._gaps

    def counted(rows, *rest):
        moved.append(rows.count())
        return gaps(rows, *rest)

    monkeypatch.setattr(hubs, "_gaps", counted)
    rng = np.random.default_rng(percent)
    sets = [rng.integers(0, 2**63, int(rng.integers(50, 80)), dtype=np.uint64) for _ in range(40)]
    sets += [np.append(s[:-1], rng.integers(0, 2**63, 3, dtype=np.uint64)) for s in sets[:3]]
    frame = spark.createDataFrame([(k, len(s), bytearray(np.sort(s).tobytes())) for k, s in enumerate(sets)], "node long, n long, tokens binary")
    buckets = spark.createDataFrame([(1, k) for k in range(len(sets))], "sig long, node long")
    found = {tuple(r) for r in hubs.links(buckets, frame, percent).select("a", "b").collect()}
    assert found == {(k, 40 + k) for k in range(3)}
    assert sum(moved) <= 6


def test_bitmaps_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        every = rng.integers(0, 2**63, int(rng.integers(1, 400)), dtype=np.uint64)
        x, y = (np.unique(rng.choice(every, int(rng.integers(1, len(every) + 1)))) for _ in "xy")
        p, q = (np.frombuffer(hubs.parity(s), np.uint8) for s in (x, y))
        size = min(len(p), len(q))
        assert np.bitwise_count(hubs.folded(p, size) ^ hubs.folded(q, size)).sum() <= len(np.setxor1d(x, y))
