"""Packed inverted lists, the signatures and buckets made of them, and blocks of hubs."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from promptledger.llm import fast_sketch, hubs, postings
from promptledger.llm import ngram_join as nj


def owned(spark, sets):
    rows = [(owner, len(s), bytearray(np.array(sorted(s), np.uint64).tobytes())) for owner, s in sets]
    return spark.createDataFrame(rows, "owner long, n long, tokens binary")


def some_sets(seed, owners=40):
    """Owners with negative keys too; some come twice, some have one token or none that others have."""
    rnd = random.Random(seed)
    sets = [(rnd.randrange(-(2**63), 2**63), {rnd.choice([rnd.randrange(30), rnd.randrange(2**64)]) for _ in range(rnd.randint(1, 30))}) for _ in range(owners)]
    return sets + sets[:3] + [(7, {2**64 - 1}), (0, {5})]


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_shared_tokens_rarest_first(spark, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    sets = some_sets(block)
    table = owned(spark, sets)
    held = collections.Counter(t for _, s in dict(sets).items() for t in s)
    got = {r.owner: r.shared for r in postings.shared_counts(postings.dealt(table)).collect()}
    want = {o: sum(held[t] > 1 for t in s) for o, s in sets}
    assert got == {o: n for o, n in want.items() if n}

    rarest = postings.rarest(postings.dealt(table), table, nj.prefix_size)
    members = collections.defaultdict(set)
    for o, s in sets:
        for t in sorted(s, key=lambda t: (held[t], t))[: nj.prefix_size(len(s))]:
            members[t].add(o)
    found = collections.defaultdict(set)
    rows = postings.buckets(rarest).collect()
    for r in rows:
        found[r.sig].add(r.owner)
    assert len(rows) == sum(map(len, found.values()))
    assert sorted(map(sorted, found.values())) == sorted(map(list, {tuple(sorted(m)) for m in members.values() if len(m) > 1}))


def test_shared_passages_are_no_signatures(docs):
    """Documents with a passage in common and much of their own meet in no signature; near copies among them still do."""
    passage = [f"p{k}" for k in range(40)]
    rows = [(k, " ".join([*(f"o{k}x{j}" for j in range(60)), *passage])) for k in range(30)]
    assert nj._candidates(docs(rows), "doc_id", "text").held.isEmpty()
    rows.append((99, rows[4][1] + " end"))
    found = nj._candidates(docs(rows), "doc_id", "text")
    assert {r.doc for r in found.held.collect()} == {4, 99}
    assert {r.doc_id: r.component_id for r in nj.op9_ngram_join(docs(rows)).collect()} == {**{k: k for k in range(30)}, 99: 4}


@pytest.mark.parametrize("percent,most,size", [(75, 64, 30), (85, 1, 9)])
def test_sets_around_a_hub_are_compared_by_blocks(spark, monkeypatch, percent, most, size):
    """More sets than a task compares are dealt into blocks; only with more than MOST_BLOCKS of them is there another level."""
    monkeypatch.setattr(hubs, "SMALL", 2)
    monkeypatch.setattr(hubs, "CROWD", 4)
    monkeypatch.setattr(hubs, "MOST_BLOCKS", most)
    levels, differences = [], hubs._differences
    monkeypatch.setattr(hubs, "_differences", lambda *a: levels.append(1) or differences(*a))
    rnd = random.Random(percent)
    centre = [rnd.randrange(10**9) for _ in range(80)]
    sets = []
    for k in range(size):
        s = set(centre)
        for x in rnd.sample(centre, rnd.randint(1, 26)):
            s.discard(x)
            s.add(x + 1 + k % 3 if rnd.random() < 0.5 else rnd.randrange(10**9))
        sets.append(s)
    frame = spark.createDataFrame([(k, len(s), bytearray(np.array(sorted(s), np.uint64).tobytes())) for k, s in enumerate(sets)], "node long, n long, tokens binary")
    buckets = spark.createDataFrame([(1, k) for k in range(len(sets))], "sig long, node long")
    found = {tuple(r) for r in hubs.links(buckets, frame, percent).select("a", "b").collect()}
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}

    def groups(pairs):
        at = list(range(len(sets)))
        for a, b in pairs:
            at = [at[a] if x == at[b] else x for x in at]
        return {frozenset(k for k, x in enumerate(at) if x == y) for y in at}

    assert found <= linked and groups(found) == groups(linked)
    assert bool(levels) == (most == 1)


def test_bands_of_the_same_documents_are_one_bucket(docs, monkeypatch):
    """Near copies share dozens of bands; copies of one class and rows without an id are in none."""
    seen, ties = [], fast_sketch.ties
    monkeypatch.setattr(fast_sketch, "ties", lambda buckets, sets, percent: seen.append((buckets, sets)) or ties(buckets, sets, percent))
    text = [f"t{k}" for k in range(300)]
    rows = [(5, " ".join(text)), (6, " ".join(text)), (8, " ".join([*text, "end"])), (9, " ".join(f"u{k}" for k in range(50))), (None, " ".join(text[1:]))]
    out = fast_sketch.op12_fast_sketch(docs(rows))
    members = collections.defaultdict(set)
    for r in seen[0][0].collect():
        members[r.sig].add(r.node)
    assert len(members) == 1 and all(len(m) == 2 for m in members.values())
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(5, 5), (6, 5), (8, 5), (9, 9), (None, None)}
