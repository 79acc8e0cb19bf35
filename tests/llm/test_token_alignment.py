"""Token alignment against two plain loops over the libraries' tokens."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from promptledger.llm import token_alignment as alignment
from promptledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "\n", "a", "The cat sat.\nThe cat sat again, twice.", "a  b   c    d ", "<|endoftext|> and </s> <s> <unk>", "x ▁ y",
    "é\U0001f600ａ 你好", "\x00\x01 tab\tnew\r\n", "a" * 5000, "é" * 3000, "-=" * 900 + " " * 700 + "z", "\n " * 40_000 + "y", "The cat sat.\nThe cat sat again, twice.",
]


def plain(rows):
    """The contract, one token after the other."""
    a_file, b_file = alignment.default_files()
    first = Tokenizer.from_file(a_file)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=b_file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    done, counts = [], {}
    for doc, text in rows:
        whole = b" " + (text or "").encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        b = second.encode(text or "")
        a_bytes = [bytes(byte[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            done.append((doc, 0, 0, [], []))
            continue
        ends = lambda parts: list(np.cumsum([len(p) for p in parts]))
        ea, eb = ends(a_bytes), ends(b_bytes)
        cuts = sorted(set(ea) & set(eb))
        where = lambda e: bisect_left(cuts, e)
        groups = [([], []) for _ in cuts]
        for i, e in zip(a.ids, ea):
            groups[where(e)][0].append(i)
        for i, e in zip(b, eb):
            groups[where(e)][1].append(i)
        linked = [(x, y) for xs, ys in groups for x in xs for y in ys]
        for p in set(linked):
            counts[p] = counts.get(p, 0) + 1
        done.append((doc, len(a.ids), len(b), groups, linked))
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for doc, n_a, n_b, groups, linked in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc, n_a, n_b, len(groups), len(linked), hashlib.sha256(text.encode()).hexdigest() if n_a else "",
            sum(counts[p] == highest[p[0]] for p in linked), sum(counts[p] for p in linked),
        ))
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cases(spark, docs):
    rows = [*enumerate(TEXTS), (3, "a"), (None, "The cat")]
    assert got(alignment.op13_token_alignment(docs(rows, extra=True))) == sorted(plain(rows), key=str)


def test_empty(docs):
    assert got(alignment.op13_token_alignment(docs([]))) == []


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert got(QUERIES["op13_token_alignment"](spark, SF)) == sorted(plain(rows), key=str)


def test_ids_of_a_are_the_librarys():
    vocabularies = alignment.Vocabularies(*alignment.default_files())
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "\t", " the", " THE's", "don't", " é", "ñandú", "ß", "İ", "ⁿ", "º", "1", " 22", ".", ", ", "!?", "\r\n", "\u00a0", "\x85", "\u3000", "\x1c", "_", "'s", " 's", "中", "<|endoftext|>", "a" * 50]
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(40)]
        want = [e.ids for e in vocabularies.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        assert list(vocabularies._ids_of_a(texts)) == want


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_merge_random(lane, monkeypatch):
    monkeypatch.setattr(alignment, "LANE", lane)
    rng = random.Random(lane)
    a_end, b_end, first, want, at = [], [], [], [], 0
    for _ in range(60):
        n = rng.randint(1, 80)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}) for _ in range(2))
        first.append(len(a_end))
        prior = (len(a_end), len(b_end))
        for c in sorted(set(a) & set(b)):
            now = (len(a_end) + a.index(c) + 1, len(b_end) + b.index(c) + 1)
            want.append((prior[0], now[0], prior[1], now[1]))
            prior = now
        a_end += [at + x for x in a]
        b_end += [at + x for x in b]
        at += n
    found = alignment.merge(np.array(a_end), np.array(b_end), np.array(first))
    assert list(zip(*(x.tolist() for x in found))) == want


def test_wide_groups_count_alike(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 4, 40), rng.integers(0, 4, 50)
    groups = alignment.Groups(np.array([0, 3, 20]), np.array([3, 20, 40]), np.array([0, 10, 12]), np.array([10, 12, 50]))

    def summed():
        out = {}
        for g, p, n in zip(*(x.tolist() for x in alignment.links(groups, a, b))):
            out[g, p] = out.get((g, p), 0) + n
        return out

    narrow = summed()
    monkeypatch.setattr(alignment, "WIDE", 10**9)
    assert summed() == narrow and sum(narrow.values()) == 3 * 10 + 17 * 2 + 20 * 38
