from __future__ import annotations

import hashlib
import random

import pytest

from promptledger.llm import sentence_pieces as sp

ODD = ["", None, " ", "  a  b ", "\n\n x\t", "a▁b", "</s><0x41>", "日本\x00x", "😀é", "word." * 3000, "x" * 5000, "foo_(bar),baz.qux 3.14", "no\r\nbreak"]


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Pieces(sp.default_model())


def test_encoding_and_decoding_equal_the_library(vocabulary):
    rnd = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("aeithn s \n\t▁éß日<>|[]/\\0.,_-") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        ids = vocabulary.library.encode(t, add_eos=True)
        assert vocabulary.encode(t) == ids, t
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids), t


def test_any_ids_decode_like_the_library(vocabulary):
    rnd = random.Random(5)
    for _ in range(1500):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(0, 32000)]) for _ in range(6)]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids), ids


def test_differences_from_the_library_are_corrected(vocabulary, monkeypatch):
    v = sp.Pieces(sp.default_model())
    monkeypatch.setattr(v, "_split", lambda text: list(text))
    rows, corrected = v.encode_texts(["the of", "x"])
    assert [r[1] for r in rows] == [" ".join(map(str, v.library.encode(t, add_eos=True))) for t in ("the of", "x")]
    assert corrected[0] == 2


def test_lone_blanks_stay_right_in_later_batches():
    v = sp.Pieces(sp.default_model())
    texts = ["\nx", "\tx", "a ", "a \nb", "a \tb", " ", "\n", "x \n y "]
    want = [[*v.library.encode(t), v.end] for t in texts]
    for _ in range(2):
        rows, corrected = v.encode_texts(texts)
        assert rows == [(len(ids), " ".join(map(str, ids)), v.library.decode(ids)) for ids in want]
        assert corrected == [0] * len(texts)


def test_table(spark, docs, vocabulary):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(0, "again"), (0, "again"), (None, "no id")]
    got = {(r.doc_id, r.ids_sha256, r.n_tokens, r.decoded_sha256, r.n_corrected) for r in sp.op1_sentencepiece(docs(rows, True)).collect()}
    want = set()
    for d, t in rows:
        ids = vocabulary.library.encode(t or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((d, sha(" ".join(map(str, ids))), len(ids), sha(vocabulary.library.decode(ids)), 0))
    assert got == want
    assert sp.op1_sentencepiece(docs([])).count() == 0
    assert "_n_tokens" in sp.encode_documents(docs([(1, "a")], True), sp.default_model()).columns
