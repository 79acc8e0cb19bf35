from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptledger.operators import budget, extras, spend

SCHEMA = "id string, ts timestamp, grp string, est decimal(18,6), cost decimal(18,6), budget decimal(18,6)"
START = datetime(2024, 1, 1)


def micro(n):
    return Decimal(n) / 1000000


def make(seed, n=600, groups=3, cheap=False):
    rng = random.Random(seed)
    budgets = [micro(20000), micro(35000), micro(60000), None]
    rows = []
    for i in range(n):
        est = rng.choice([0, rng.randint(1, 40), rng.randint(1, 400), rng.randint(1, 4000)])
        cost = rng.choice([est, est + rng.randint(0, 200), 0 if rng.random() < 0.5 else est])
        if cheap and rng.random() < 0.2:
            cost = max(0, est - rng.randint(0, est))
        # One group holds most rows.
        grp = "hot" if rng.random() < 0.7 else rng.choice([f"g{k}" for k in range(groups)] + [None])
        rows.append((f"r{i:05d}", START + timedelta(seconds=rng.randint(0, n // 3)), grp, micro(est), micro(cost),
                     budgets[rng.choices(range(4), [4, 4, 2, 1 if cheap else 0])[0]]))
    return rows


def fold(rows, opening=None):
    spend, out = dict(opening or {}), {}
    for i, ts, grp, est, cost, limit in sorted(rows, key=lambda r: (r[1], r[0])):
        before = spend.get(grp, Decimal(0))
        over = limit is not None and before + est > limit
        out[i] = (before, over)
        spend[grp] = before + (0 if over else cost)
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = budget.budget_gate(df, "grp", "id", "ts", F.col("est"), F.col("cost"), F.col("budget"), **options)
    return {r.id: (r.spend_before, r.over_budget) for r in got.collect()}


@pytest.mark.parametrize("seed,options", [
    (1, {}), (2, {"fold_rows": 0}), (3, {"fold_rows": 0, "chunks": 3}), (4, {"fold_rows": 40, "chunks": 17}),
])
def test_gate_equals_the_sequential_fold(spark, seed, options):
    rows = make(seed)
    assert run(spark, rows, **options) == fold(rows)


def test_costs_below_the_estimate_are_still_exact(spark):
    rows = make(5, n=160, cheap=True)
    assert run(spark, rows, fold_rows=30) == fold(rows)


def test_no_refusal_at_all(spark):
    rows = [r[:5] + (micro(10**9),) for r in make(6, n=100)]
    assert run(spark, rows) == fold(rows)


def test_opening_balance(spark):
    rows = make(7, n=200)
    opening = {"hot": micro(15000), "g1": micro(70000)}
    df = spark.createDataFrame([(k, v) for k, v in opening.items()], "grp string, spend decimal(18,6)")
    assert run(spark, rows, opening=df) == fold(rows, opening)


def test_small_request_passes_after_a_refused_large_one(spark):
    rows = [
        ("a", START, "d", micro(50), micro(80), micro(100)), ("b", START + timedelta(1), "d", micro(60), micro(60), micro(100)),
        ("c", START + timedelta(2), "d", micro(20), micro(20), micro(100)), ("d", START + timedelta(3), "d", micro(1), micro(1), micro(100)),
    ]
    assert [run(spark, rows)[k][1] for k in "abcd"] == [False, True, False, True]


def hard(kind, n):
    """Rows of one key that a budget stops at ever other places."""
    rng = random.Random(n)
    out = []
    for i in range(n):
        est, cost, limit = {
            "powers": lambda: (e := 2 ** rng.randint(0, 15), e, 100000),
            "cheap": lambda: (600, 1, 600 + n // 3),
            "budgets": lambda: (rng.randint(1, 900), rng.randint(1, 900), 300 * rng.randint(1, 1000)),
            "mixed": lambda: (rng.randint(0, 900), rng.randint(0, 50), rng.choice([700, 1200, 1201, None])),
        }[kind]()
        out.append((f"r{i:04d}", START + timedelta(seconds=i), "d", micro(est), micro(cost), None if limit is None else micro(limit)))
    return out


def jobs(spark, label, run_it):
    spark.sparkContext.setJobGroup(label, label)
    out = run_it()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))


@pytest.mark.parametrize("kind", ["powers", "cheap", "budgets", "mixed"])
def test_jobs_do_not_grow(spark, kind):
    counts = []
    for n in (150, 1200):
        rows = hard(kind, n)
        got, count = jobs(spark, f"gate-{kind}-{n}", lambda: run(spark, rows, fold_rows=0, chunks=7))
        assert got == fold(rows)
        counts.append(count)
    assert counts[1] <= counts[0] + 4 and max(counts) < 60


def plain_spend(cost, limit, s):
    for c, top in zip(cost.tolist(), limit.tolist()):
        s += c if s <= top else 0
    return s


@pytest.mark.parametrize("seed", range(6))
def test_step_functions(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(spend, "_BLOCK", [1, 3, 1 << 16][seed % 3])
    n = int(rng.integers(0, 90))
    cost = rng.integers(0, [2, 40, 900][seed % 3], n)
    limit = np.where(rng.random(n) < 0.1, spend.NO_LIMIT, rng.integers(-20, 600, n))
    low = int(rng.integers(0, 50))
    steps = spend.of_rows(cost, limit, low)
    rough = spend.outline(steps, 4)
    for s in range(low, 1500, 7):
        end = plain_spend(cost, limit, s)
        assert steps(s) == end
        assert steps.within(s, s + 5)(s + 3) == plain_spend(cost, limit, s + 3)
        assert rough(s, s)[0] <= end <= rough(s, s)[1]
        lo, hi = rough(s, s + 30)
        assert all(lo <= plain_spend(cost, limit, x) <= hi for x in range(s, s + 31, 3))


def test_step_functions_of_long_runs_stay_small():
    rng = np.random.default_rng(3)
    n = 60_000
    cost = rng.integers(1, 600, n)
    limit = 10**6 - cost - rng.integers(0, 600, n)
    assert len(spend.of_rows(cost, limit, 10**6 - 1200).start) < 2000
    budgets = rng.integers(1, 1001, n) * 10**6
    cost = rng.integers(100, 60_000, n)
    steps = spend.of_rows(cost, budgets - 2 * cost, 0)
    assert len(steps.start) < 3 * n
    assert all(steps(s) == plain_spend(cost, budgets - 2 * cost, s) for s in (0, 123_456, 5 * 10**8))


def test_what_if(spark):
    rows = [r[:5] + (None,) for r in make(10, n=150)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = budget.budget_what_if(df, ["0.010000", "0.030000"], "id", "ts", F.col("est"), F.col("cost")).collect()
    for r in got:
        want = fold([x[:2] + ("d",) + x[3:5] + (r.budget,) for x in rows])
        costs = {x[0]: x[4] for x in rows}
        assert r.refused == sum(o for _, o in want.values())
        assert r.admitted_spend == sum(costs[k] for k, (_, o) in want.items() if not o)


def test_session_and_month(spark):
    rows = make(11, n=150)
    df = spark.createDataFrame(rows, SCHEMA)
    got = extras.session_limit_gate(df, "id", "ts", F.col("est"), F.col("cost"), F.col("budget"), session="grp")
    want = {r[0]: False for r in rows} | {k: v[1] for k, v in fold([r for r in rows if r[2]]).items()}
    assert {r.id: r.over_budget for r in got.collect()} == want
    month = extras.monthly_budget_gate(df, "id", "ts", F.col("est"), F.col("cost"), F.col("budget"))
    want = fold([r[:2] + ("m",) + r[3:] for r in rows])
    assert {r.id: r.over_budget for r in month.collect()} == {k: v[1] for k, v in want.items()}


def test_downgrade_switches_on_and_stays(spark):
    rows = [(f"r{i}", START + timedelta(seconds=i), "d", micro(10), micro(10), micro(100)) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = budget.auto_downgrade(df, "grp", "id", "ts", F.col("cost"), F.col("budget"))
    assert {r.id for r in got.where("downgraded").collect()} == {"r8", "r9", "r10", "r11"}
    moved = budget.auto_downgrade(
        df, "grp", "id", "ts", F.col("cost"), F.col("budget"), model=F.lit("big"), target="small", target_cost=F.col("cost") / 2
    )
    assert {(r.id in ("r8", "r9", "r10", "r11"), r.model, float(r.cost * 1000000)) for r in moved.collect()} == {(True, "small", 5.0), (False, "big", 10.0)}
