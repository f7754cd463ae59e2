import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import portfolio as pf
from barloom.plans.flows import allocate
from barloom.plans.queries_portfolio import lane_returns, risk_state
from barloom.sources import views


def by_loop(weights, floor, cap):
    """Repeated capping written as a loop."""
    w = {k: x for k, x in weights.items() if x >= floor and x > 0}
    if len(w) == 1:
        return {k: min(x, cap, 1.0) for k, x in w.items()}
    total = sum(w.values())
    w = {k: x / total for k, x in w.items()}
    for _ in range(len(w)):
        over = {k for k, x in w.items() if x > cap + 1e-12}
        free = {k: x for k, x in w.items() if x < cap - 1e-12 and k not in over}
        excess = sum(w[k] - cap for k in over)
        if not over:
            break
        w.update({k: cap for k in over})
        if not free:
            break
        base = sum(free.values())
        w.update({k: x + excess * x / base for k, x in free.items()})
    return w


@pytest.mark.parametrize("cap", [0.05, 0.12, 0.4, 1.0])
def test_cap_against_a_loop(spark, cap):
    rng = random.Random(int(cap * 100))
    books = {p: {f"a{i}": rng.choice([0.001, 0.2, rng.random() ** 3]) for i in range(n)} for p, n in enumerate([1, 2, 9, 40])}
    rows = [(p, k, w) for p, ws in books.items() for k, w in ws.items()]
    df = spark.createDataFrame(rows, "portfolio_id long, alpha_id string, weight double")
    got = {(r["portfolio_id"], r["alpha_id"]): r["weight"] for r in pf.cap_and_redistribute(df, 0.002, cap).collect()}
    want = {(p, k): w for p, ws in books.items() for k, w in by_loop(ws, 0.002, cap).items()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9)


def test_inverse_variance_edge_cases(spark):
    rows = [(1, "a", 0.1), (1, "a", -0.1), (1, "b", 0.0), (1, "b", 0.0), (2, "solo", 0.3)]
    got = {(r[0], r[1]): r[2] for r in pf.inverse_variance_weights(spark.createDataFrame(rows, "portfolio_id long, alpha_id string, ret double")).collect()}
    assert got[(2, "solo")] == 1.0 and got[(1, "a")] == pytest.approx(0.5) and got[(1, "b")] == pytest.approx(0.5)


def test_probation_and_budgets(spark):
    w = spark.createDataFrame([(1, "c", 0.5), (1, "m", 0.5)], "portfolio_id long, alpha_id string, weight double")
    a = spark.createDataFrame([(1, "c", "core", 500, 1.0), (1, "m", "moonshot", 10, 1.0)], "portfolio_id long, alpha_id string, lane string, n_trades long, sortino double")
    got = {r["alpha_id"]: r["weight"] for r in pf.apply_lane_budgets(w, a, pf.lane_budgets(a)).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["m"] < 0.06


def test_halted_portfolio_is_flat(spark):
    x = spark.createDataFrame([(1, "A", 0.7), (1, "B", 0.3)], "portfolio_id long, symbol string, weight double")
    s = spark.createDataFrame([(1, 100.0, 100.0, True)], "portfolio_id long, equity double, start_equity double, halted boolean")
    assert {r["weight"] for r in pf.enforce_risk(x, s).collect()} == {0.0}


def test_allocate_sums_to_one(spark, small):
    alphas = views.alpha_stats(spark, small)
    got = allocate(lane_returns(spark, small), alphas, "F", {"core": 0.5, "moonshot": 0.25}, 0.0, 0.5, risk_state(spark, small), 1.0, 1.0)
    sums = got.groupBy("portfolio_id").agg(F.sum("weight").alias("s")).collect()
    assert sums and all(r["s"] == pytest.approx(1.0) or r["s"] == 0.0 for r in sums)
