from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from promptledger.operators import ordered


@pytest.mark.parametrize("chunks", [1, 4, 23])
def test_running_values_with_a_hot_key(spark, chunks):
    rng = random.Random(chunks)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i, rng.choice([None, rng.randint(-5, 9)])) for i in range(400)]
    rng.shuffle(rows)
    df = ordered.cut_into_chunks(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o"], chunks)
    assert df.select("_chunk").distinct().count() > chunks // 2
    keys, by = ["k"], ["o"]
    out = ordered.running_sum(df, keys, by, F.coalesce("v", F.lit(0)), "before")
    out = ordered.running_sum(out, keys, by, F.lit(1), "n", inclusive=True)
    out = ordered.running_max(out, keys, by, F.col("v"), "top")
    out = ordered.previous_value(out, keys, by, F.col("v"), "prev")
    got = {(r.k, r.o): (r.before, r.n, r.top, r.prev) for r in out.collect()}
    want, state = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        total, n, top, prev = state.get(k, (0, 0, None, None))
        tops = [x for x in (top, v) if x is not None]
        top2 = max(tops) if tops else None
        want[(k, o)] = (total, n + 1, top2, prev)
        state[k] = (total + (v or 0), n + 1, top2, v)
    assert got == want
