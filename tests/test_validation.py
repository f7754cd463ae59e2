import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import population as pp
from barloom.operators import redundancy as rd
from barloom.operators import validation as va
from barloom.sources import views


def test_embargo_keeps_train_and_test_apart(spark, small):
    rows = va.purged_folds(views.trades(spark, small), 4, 2).collect()
    by = {}
    for r in rows:
        by.setdefault(r["formula_id"], []).append(r)
    for mine in by.values():
        for f in range(4):
            test = [r["pos"] for r in mine if r["fold"] == f]
            train = {r["pos"] for r in mine if f in r["train_folds"]}
            assert test and not any(p in train for t in test for p in range(t - 2, t + 3))
            assert len(train) == len(mine) - len({p for t in test for p in range(t - 2, t + 3) if 0 <= p < len(mine)})


@pytest.mark.parametrize("step_up,want", [(False, {"c": True, "b": False, "a": False}), (True, {"a": True, "b": True, "c": True})])
def test_bh_flavours_differ(spark, step_up, want):
    df = spark.createDataFrame([("a", 0.04), ("b", 0.02), ("c", 0.042)], "formula_id string, p_value double")
    got = {r["formula_id"]: r["bh_accept"] for r in va.bh_fdr(df, 0.05, step_up=step_up).collect()}
    assert got == want


def test_bh_many_equal_p(spark):
    """A third of all rules share one p-value; ranks still run through the ids."""
    df = spark.range(600).select(F.sha2(F.col("id").cast("string"), 256).alias("formula_id"), F.when(F.col("id") % 3 == 0, 0.2).otherwise(F.col("id") / 600).alias("p_value"))
    rows = va.bh_fdr(df, 0.5).toPandas().sort_values(["p_value", "formula_id"])
    assert list(rows["bh_rank"]) == list(range(1, 601))
    assert list(rows["bh_accept"]) == [p <= i / 600 * 0.5 for i, p in enumerate(rows["p_value"], 1)]


def test_p_value_of_undefined_rule_is_never_accepted(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.001)], "formula_id string, p_value double")
    assert {r["formula_id"]: r["bh_accept"] for r in va.bh_fdr(df, 0.5).collect()} == {"a": False, "b": True}


@pytest.mark.parametrize("patience", [1, 2, 3, 5])
def test_stage_escalation_against_a_loop(spark, patience):
    rng = random.Random(patience)
    cycles = [(i, rng.random(), rng.uniform(0, 40)) for i in range(60)]
    stages, now, history, want = ["s0", "s1", "s2"], 0, [], {}
    for i, density, trades in cycles:
        if density >= 0.4 and trades >= 10:
            history.append(now)
            if history.count(now) >= patience and now < 2:
                now += 1
                history.append(now)
        want[i] = stages[now]
    log = spark.createDataFrame(cycles, "cycle long, survivor_density double, median_trades double")
    got = {r["cycle"]: r["stage"] for r in pp.escalate_stage(log, stages, 0.4, 10, patience).collect()}
    assert got == want


def test_bootstrap_is_small_for_a_strong_rule(spark):
    rows = [("up", "A", i, 1.0 + 0.1 * (i % 5)) for i in range(40)] + [("down", "A", i, -1.0 - 0.1 * (i % 3)) for i in range(40)] + [("few", "A", i, 1.0) for i in range(2)]
    df = spark.createDataFrame(rows, "formula_id string, symbol string, i long, pnl double").withColumn("ts", F.timestamp_seconds("i").cast("timestamp_ntz"))
    got = {r["formula_id"]: r["p_bootstrap"] for r in va.bootstrap_p(df, 50, 3).collect()}
    assert got == {"up": 1 / 50, "down": 1.0, "few": 1.0}


def test_jaccard_counts_against_pairs(spark, small):
    from itertools import combinations

    f = views.formulas(spark, small)
    from barloom.functions.formula import feature_set

    sets = [frozenset(r[0]) for r in f.select(feature_set()).collect()]
    want = {}
    for a, b in combinations(sets, 2):
        j = round(len(a & b) / len(a | b), 9)
        want[j] = want.get(j, 0) + 1
    got = {round(r["jaccard"], 9): r["pairs"] for r in rd.jaccard_counts(f).collect()}
    assert got == want


@pytest.mark.parametrize("size", [0, 1, 25, 60])
def test_jaccard_counts_of_large_sets(spark, size):
    """Feature sets beyond what subsets or factorials could count, repeated rules, sets without a feature, small blocks."""
    from itertools import combinations

    rng = random.Random(size)
    names = [f"f{i}" for i in range(80)]
    sets = [sorted(rng.sample(names, max(0, size - rng.randrange(3)))) for _ in range(50)]
    sets += sets[:20] + [s[1:] for s in sets[:10]]
    text = lambda s: "[" + ",".join(f'["{f}",">",1.0]' for f in s) + "]"
    f = spark.createDataFrame([(text(s),) for s in sets], "formula_json string")
    want = {}
    for a, b in combinations([frozenset(s) for s in sets], 2):
        j = round(len(a & b) / len(a | b), 9) if a | b else 1.0
        want[j] = want.get(j, 0) + 1
    for block in (7, 2048):
        assert {round(r["jaccard"], 9): r["pairs"] for r in rd.jaccard_counts(f, block_sets=block).collect()} == want


def test_connected_chain_and_star(spark):
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x0", f"x{i}") for i in range(1, 9)] + [("y", "y"), (None, "z")]
    got = {r["node"]: r["root"] for r in rd.connected(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | {f"x{i}": "x0" for i in range(9)}
    assert rd.connected(spark.createDataFrame([], "a string, b string")).collect() == []


def test_vif_of_a_copy_is_infinite_and_of_noise_is_small(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0, 1) for _ in range(60)]
    rows = [("f", i, x) for i, x in enumerate(xs, 1)] + [("copy", i, 2 * x + 1) for i, x in enumerate(xs, 1)]
    rows += [("noise", i, rng.gauss(0, 1)) for i in range(1, 61)] + [("short", i, 1.0 * i) for i in range(1, 6)]
    got = {r["alpha_id"]: r["vif"] for r in rd.vif(spark.createDataFrame(rows, "alpha_id string, from_end long, ret double"), ["f"]).collect()}
    assert got["copy"] == float("inf") and 1.0 <= got["noise"] < 1.3 and got["short"] == 1.0


def test_vif_of_many_factors_against_least_squares(spark):
    """Ninety factors, candidates of several lengths, a copy of a mix of factors, missing values nowhere."""
    import numpy as np

    rng = np.random.default_rng(4)
    series = {f"f{i}": rng.normal(size=300 + i) for i in range(90)}
    series |= {"long": rng.normal(size=500), "mid": rng.normal(size=210) + series["f3"][:210], "same": rng.normal(size=210), "brief": rng.normal(size=9)}
    series["mix"] = 3 * series["f1"][:250] - series["f80"][:250] + 0.5
    series["flat"] = np.ones(250)
    rows = [(k, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs, 1)]
    frame = spark.createDataFrame(rows, "alpha_id string, from_end long, ret double")
    names = spark.createDataFrame([(f"f{i}",) for i in range(90)], "alpha_id string")
    got = {r["alpha_id"]: r["vif"] for r in rd.vif(frame, names).collect()}
    assert set(got) == set(series) - {f"f{i}" for i in range(90)}
    assert got["brief"] == 1.0 and got["flat"] == 1.0 and got["mix"] == float("inf")
    for c in ("long", "mid", "same"):
        n = min(300, len(series[c]))
        x = np.column_stack([np.ones(n)] + [series[f"f{i}"][:n] for i in range(90)])
        y = series[c][:n]
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert got[c] == pytest.approx(((y - y.mean()) ** 2).sum() / (left**2).sum(), rel=1e-6)


def test_no_factor_and_no_candidate(spark):
    rows = [("a", i, float(i % 7)) for i in range(1, 40)]
    frame = spark.createDataFrame(rows, "alpha_id string, from_end long, ret double")
    assert [tuple(r) for r in rd.vif(frame, []).collect()] == [("a", 1.0)]
    assert rd.vif(frame, ["a"]).collect() == []
    assert rd.factor_correlation(frame, ["a"], 0.5, at="from_end").collect() == []
    assert [r["allowed"] for r in rd.factor_correlation(frame, [], 0.5, at="from_end").collect()] == [True]
