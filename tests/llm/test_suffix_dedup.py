from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from promptledger.llm import suffix_arrays as sa
from promptledger.llm import suffix_dedup as sd


def brute(rows, length=sd.LENGTH):
    seen, out = set(), {}
    for doc, text in sorted((d, t or "") for d, t in rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("small", [1024, 0])
def test_suffix_arrays(small, monkeypatch):
    monkeypatch.setattr(sa, "_SMALL", small)
    rnd = random.Random(1)
    for _ in range(400):
        t = np.array([rnd.randint(1, rnd.choice([1, 2, 5, 200])) for _ in range(rnd.randint(0, 50))] + [0])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.suffix_array(t).tolist() == want
        common = sa.permuted_prefixes(t, np.array(want), np.array([0]), np.array([len(t)]), 30)
        for a, b in zip(want, want[1:]):
            x, y = t[a:].tolist(), t[b:].tolist()
            assert common[b] == next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))


def test_hashes_by_slices_are_those_by_places():
    data = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8)
    places = np.arange(len(data) - sd.GRAM + 1)
    assert (sd._gram_hashes(data) == sd._string_hash(data, 0)(places, places + sd.GRAM)).all()


def test_names_that_repeat_are_sorted_without_scans_by_element(monkeypatch):
    """Many near copies of one text: over 1024 names, most of them several times."""
    def by_element(*_):
        raise AssertionError("a scan element by element")

    monkeypatch.setattr(sa, "_induce_elements", by_element)
    rng = np.random.default_rng(7)
    piece = rng.integers(2, 250, 6000)
    t = np.concatenate([*(np.append(np.where(rng.random(6000) < 0.001, 2, piece), 1) for _ in range(4)), [0]])
    raw = bytes(t.astype(np.uint8))
    assert sa.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
    period = np.concatenate([np.tile([3, 2], 4000), [0]])
    assert sa.suffix_array(period).tolist() == [8000, *range(7999, 0, -2), *range(7998, -1, -2)]


def texts():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    base, passage = word(900), word(160)
    rows = [(1, base), (2, base), (3, base[:400] + "ZZ" + base[410:]), (4, None), (5, ""), (6, "a" * 700), (7, "ab" * 400), (8, "a" * 99)]
    rows += [(10 + k, word(80) + passage + word(70)) for k in range(12)]
    rows += [(40, word(300) + base[200:320] + word(20) + base[200:320]), (41, passage[:100]), (42, passage[:99])]
    return rows


def test_brute_force_and_frequent_anchors(docs, monkeypatch):
    rows = texts()
    assert result(sd.op2_suffix_dedup(docs(rows, True))) == brute(rows)
    monkeypatch.setattr(sd, "MAX_SEGMENTS", 2)
    monkeypatch.setattr(sd, "SHARD_BYTES", 1000)
    monkeypatch.setattr(sd, "PIECE", 512)
    assert result(sd.op2_suffix_dedup(docs(rows))) == brute(rows)


def test_rows_without_id_repeated_rows_and_no_rows(docs):
    base = texts()[0][1]
    out = sd.op2_suffix_dedup(docs([(None, base), (1, base), (1, base), (2, base)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == [("1", 0), ("1", 0), ("2", len(base.encode())), ("None", 0)]
    assert sd.op2_suffix_dedup(docs([])).count() == 0


def test_anchors_are_counted_without_contents(spark, monkeypatch):
    """The first pass hashes no contents, and has the anchors of all segments."""
    rnd = np.random.default_rng(3)
    texts = ["".join(map(chr, rnd.integers(97, 123, int(n)))) for n in (0, 99, 100, 101, 500, 4000)] + [None, "é" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").coalesce(1)
    every = sorted(r.anchor for r in sd._all_segments(docs).select("anchor").collect())
    assert every and sorted(r.anchor for r in sd._anchors(docs).collect()) == every
