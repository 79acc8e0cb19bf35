from __future__ import annotations

import pickle
import random
import zlib

import numpy as np
import pytest

from promptledger.llm import features
from promptledger.llm import quality_model as qm
from promptledger.llm import toxicity_model as tm
from promptledger.llm.features import held_out, temperature

WORDS = "the of and river stone garden window letter morning paper silver market bread cloud story bridge".split()


def corpus(n=500):
    rnd = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 120))]
        bad, rude = k % 4 == 0, k % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if rude:
            words[rnd.randrange(len(words))] = rnd.choice(["vilestork", "vilestone", "grumbler"])
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1, int(rude)))
    return rows, labels


@pytest.fixture
def tables(spark, docs):
    rows, labels = corpus()
    odd = [(9000, None), (9001, ""), (9002, "the river " * 20000), (None, "the river"), (9001, "")]
    return docs(rows + odd, True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def judged(df, labels, k):
    rows = df.collect()
    score = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id < 9000}
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert all(score[x[0]].held_out == (x in held) for x in labels)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(labels) + 5
    return np.mean([score[x[0]].predicted == x[k] for x in held]), rows


def test_quality(tables):
    docs_, labels, plain = tables
    accuracy, rows = judged(qm.score_quality(docs_, *qm.train(docs_, labels)), plain, 1)
    assert accuracy > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity(tables):
    docs_, labels, plain = tables
    accuracy, rows = judged(tm.score_toxicity(docs_, tm.train(docs_, labels)), plain, 2)
    assert accuracy > 0.97
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_no_labels_and_no_rows(spark, docs, tables):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = docs([(1, "a b c"), (2, None)])
    assert {r.score for r in qm.score_quality(some, *qm.train(some, none)).collect()} == {0.5}
    assert {r.score for r in tm.score_toxicity(some, tm.train(some, none)).collect()} == {0.0}
    assert qm.score_quality(docs([]), *qm.train(docs([]), none)).count() == 0


def test_rule_and_parts(spark, docs):
    rows = docs([(k, "x") for k in range(50)] + [(None, "x")]).select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert temperature(np.array([4.0, -4.0, 4.0, -4.0]), np.array([1, 0, 0, 1])) < 0.2
    long = tm._word_lists([" ".join(WORDS * 8000)])
    net = tm.Convolution()
    net.tables[0][:] = np.random.default_rng(0).standard_normal(net.tables[0].shape)
    assert np.allclose(net.logits(long, words=1000), net.logits(long, words=10**6), atol=1e-4)


def test_every_labelled_row_is_learned_from(tables, monkeypatch):
    docs_, labels, plain = tables
    monkeypatch.setattr(features, "SHARD_ROWS", 150)
    rows = features.sharded(features.labelled(docs_, labels, "toxic", 4), tm._encoded)
    held = [x for x in plain if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    kept = rows.select("shard", "at", "rest").collect()
    assert len(kept) == len({r["at"] for r in kept}) == len(plain) - len(held)
    own = sum(not r["rest"] for r in kept)
    assert len({r["shard"] for r in kept}) == -(-own // 150) > 1
    assert judged(qm.score_quality(docs_, *qm.train(docs_, labels)), plain, 1)[0] > 0.97
    assert judged(tm.score_toxicity(docs_, tm.train(docs_, labels)), plain, 2)[0] > 0.95


def test_labelled_texts_of_any_length(spark, docs):
    rows, labels = corpus(60)
    long = docs([(k, " ".join([text] * 400)) for k, text in rows])
    assert min(len(r.text) for r in long.collect()) > 30_000
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert qm.train(long, known)[1] is not None and tm.train(long, known) is not None


def test_pieces_of_a_long_text_learn_alike(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [tm._decoded(x)[1] for x in tm._encoded([" ".join(rng.choice(WORDS, n)) for n in (3, 500, 0, 90)])]
    net, rare = tm.Convolution(), [np.zeros(tm.ROWS + 1, bool)] * 3
    for t in net.tables:
        t[:-1] = rng.standard_normal((tm.ROWS, tm.SIDE))
    whole = net._best(texts, rare)
    monkeypatch.setattr(tm, "WORDS", 50)
    cut = net._best(texts, rare)
    assert np.allclose(whole[0], cut[0], atol=1e-4) and whole[1].shape == cut[1].shape


def test_a_network_travels_whole():
    net = tm.Convolution()
    net.tables[1][[3, 70]] = 1.5
    size = len(pickle.dumps(net))
    assert size < 20_000 and all(np.array_equal(a, b) for a, b in zip(net.tables, pickle.loads(pickle.dumps(net)).tables))
