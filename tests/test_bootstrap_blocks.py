"""The bootstrap of rules in blocks against one draw at a time."""

import hashlib

import pytest
from pyspark.sql import functions as F

from barloom.operators import validation as va


def plain(rule, xs, n_iter, seed):
    """p_bootstrap by loops; None is a missing return, which is drawn all the same."""
    known = [x for x in xs if x is not None]
    mean, hits, drawn = sum(known) / len(known), 0, 0
    for it in range(n_iter):
        total = weight = 0
        for pos, x in enumerate(xs):
            h = hashlib.md5(f"{seed}|{rule}|{pos}|{it // 4}".encode()).hexdigest()
            u = int(h[8 * (it % 4) : 8 * (it % 4) + 8], 16)
            w = sum(u >= s for s in va.POISSON_STEPS)
            total, weight = total + w * (x or 0.0), weight + w
        if weight:
            drawn, hits = drawn + 1, hits + (total / weight - mean >= mean)
    return 1.0 if mean <= 0 else hits / drawn if hits else 1.0 / n_iter


@pytest.mark.parametrize("block", [4096, 16])
def test_blocks_and_missing_returns(spark, monkeypatch, block):
    monkeypatch.setattr(va, "DRAWN", block)
    series = {"a": [0.3, -0.2, 0.5, None] * 9, "b": [0.01 * i - 0.1 for i in range(40)], "c": [0.2, -0.1, 0.4], "d": [-0.5, 0.1, 0.2, -0.4]}
    rows = [(r, "s", i, x) for r, xs in series.items() for i, x in enumerate(xs)]
    t = spark.createDataFrame(rows, "formula_id string, symbol string, at int, pnl double").withColumn("ts", F.timestamp_seconds(F.col("at") * 3600).cast("timestamp_ntz"))
    got = {r.formula_id: r.p_bootstrap for r in va.bootstrap_p(t, 50, 3).collect()}
    assert got == {r: pytest.approx(plain(r, xs, 50, 3)) for r, xs in series.items()}


def test_no_draw_is_a_row(spark, small):
    from barloom.plans.queries_population import _boot_trades

    plan = va.bootstrap_p(_boot_trades(spark, small), 50, 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan
