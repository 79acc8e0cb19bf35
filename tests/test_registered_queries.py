"""Every registered query with an oracle, compared on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, table
from promptledger.plans.oracles import ORACLES
from promptledger.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
WITHOUT_ORACLE = {"page_markdown"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["sentencepiece", "corpus_pipeline"])
def test_queries_of_the_engine_need_no_optional_part(missing):
    """In a process where the import of ``missing`` fails."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*e.queries())"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert set(QUERIES) <= set(out) and "pipeline" not in out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


def test_queries_without_oracle_give_rows(spark):
    for name in WITHOUT_ORACLE:
        assert entry.queries()[name](spark, SF).count() > 0
