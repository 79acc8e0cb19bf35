"""The registered corpus queries against SQL, and the pipeline against its parts in plain Python."""

from __future__ import annotations

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from promptledger.llm import queries
from promptledger.llm.sentence_pieces import default_model

from .test_rules_lines_pairs import lower, plain_components, plain_counts, sha, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(row[columns.index(n)] for n in names) for row in cursor.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want


def test_whole_tables(spark, db):
    n = db.execute("SELECT count(*) FROM documents").fetchone()[0]
    for name in ("op1_sentencepiece", "op2_suffix_dedup", "op3_quality_classifier", "op4_toxicity", "op8_pii", "op9_ngram_join"):
        assert queries.QUERIES[name](spark, SF).count() == n, name


def _good(text):
    n_words, chars, symbols, dup, repeat = plain_counts(text)
    lines = sum(1 for x in text.split("\n") if words(x))
    upper, letters = (sum(c.isascii() and f(c) for c in text) for f in (str.isupper, str.isalpha))
    return not (
        n_words < 50 or 100 * repeat > 50 * n_words or 100 * symbols > 30 * n_words or (letters and 2 * upper > letters)
        or 100 * text.count("!") > 50 * n_words or not 2 * n_words <= chars <= 25 * n_words or (lines >= 4 and 2 * dup > lines)
    )


def test_pipeline(spark, db):
    rows = {d: t for d, t in db.execute("SELECT doc_id, text FROM documents").fetchall() if _good(t)}
    holders: dict[str, set] = {}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(d)
    rows = {d: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d) for d, t in rows.items()}
    rows = {d: rows[d] for d, _, c in plain_components(list(rows.items())) if c == d}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for _, item in db.execute("SELECT item_id, text FROM benchmark").fetchall():
        w = words(lower(item))
        wanted = shingles(w)
        for d in [d for d, t in rows.items() if wanted & shingles(words(lower(t)))]:
            held = words(lower(rows[d]))
            if any(
                100 * len(wanted & s) >= 75 * len(wanted | s)
                for s in (shingles(held[k : k + len(w)]) for k in range(len(held)))
            ):
                del rows[d]
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = {d: " ".join(map(str, library.encode(t, add_eos=True))) for d, t in rows.items()}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.ids for r in out.collect()} == want
    assert all(r.decoded_sha256 == sha(r.text) and r.n_chars == len(r.text) for r in out.collect())
    assert len(corpus_pipeline.STAGES) == 5
