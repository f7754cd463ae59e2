import json

import pytest
from pyspark.sql import functions as F

from barloom.functions import formula as fm
from barloom.operators import features as ft
from barloom.operators import population as pp
from barloom.operators import signals as sg
from barloom.operators.features import FeatureSpec
from barloom.sources import views
from tests.conftest import bars_frame

COLS = ["a", "b"]


@pytest.mark.parametrize(
    "tree,want",
    [
        (["a", ">", 1.0], [False, True, False]),
        (["a", "!=", 1.0], [False, True, True]),
        (["a", "<", "b"], [False, False, False]),
        ([], [False, False, False]),
        ([1.0, "<", 2.0], [False, False, False]),
        (["zzz", "!=", 1.0], [False, False, False]),
        ([["a", ">=", 1.0], "AND", ["b", "<=", 1.0]], [True, True, False]),
        ([["a", ">", 9.0], "OR", ["b", "==", 0.0]], [False, True, True]),
    ],
)
def test_compile(spark, tree, want):
    """Missing values compare false, except with !=; unknown features are false."""
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (None, 0.0)], "a double, b double")
    assert [r["v"] for r in df.select(fm.compile_formula(tree, COLS).alias("v")).collect()] == want
    assert [r["v"] for r in df.select(fm.compile_formula(json.dumps(tree), COLS).alias("v")).collect()] == want


@pytest.mark.parametrize("tree", [["a", "~", 1.0], ["a", ">"], [["a", ">", 1.0], ">", 2.0], ["a", ">", True]])
def test_bad_shapes_raise(tree):
    with pytest.raises(ValueError):
        fm.compile_formula(tree, COLS)


def test_features_of_a_tree(spark):
    tree = [[["f1", ">", 1.0], "AND", ["f2", "<", 2.0]], "OR", ["f1", ">=", 0.0]]
    df = spark.createDataFrame([(fm.to_json(tree),)], "formula_json string")
    assert sorted(r[0] for r in fm.formula_features(df).collect()) == ["f1", "f1", "f2"]
    assert sorted(r[0] for r in fm.formula_features(df, strict=True).collect()) == ["f1", "f2"]
    assert df.select(fm.formula_complexity()).first()[0] == 5
    assert df.select(fm.feature_set()).first()[0] == ["f1", "f2"]


def test_sanitize(spark):
    rows = ['["a",">",9]', '["a",">",5.0]', '["a","==",1]', '["c",">",1]', "oops", '[["a","<",1],"XOR",["b",">",1]]', '[["a","<",1],"AND",["b",">","x"]]', '["b","<","0.5"]']
    df = spark.createDataFrame([(r,) for r in rows], "formula_json string")
    got = {r["formula_json"] for r in fm.sanitize_formulas(df, ["a", "b", "c"], ["c"]).collect()}
    assert got == {'["a",">",5.0]', '["b","<",0.5]'}


def test_features_are_lagged_once(spark, small):
    """Every lagged feature equals the raw feature of the bar before, also with tiny blocks."""
    from pyspark.sql import Window

    spec = FeatureSpec(zscore=[5], volatility=[4], sma=[3], ema=[6], roc=[2], rsi=[5], parkinson=[3])
    bars = views.bars_1h(spark, small)
    names = spec.names()
    raw = ft.build_features(bars, spec, "1h", lag=False, block_rows=16)
    lagged = ft.build_features(bars, spec, "1h", block_rows=16)
    w = Window.partitionBy("symbol").orderBy("ts")
    want = raw.select("symbol", "ts", *(F.lag(n).over(w).alias(f"w_{n}") for n in names))
    j = lagged.join(want, ["symbol", "ts"])
    assert j.count() == bars.count()
    bad = " or ".join(f"(({n} is null) <> (w_{n} is null) or abs({n} - w_{n}) > 1e-9)" for n in names)
    assert j.where(bad).isEmpty()


def test_rolling_needs_a_full_window(spark):
    got = ft.build_features(bars_frame(spark, [(60 * i, 100 + i) for i in range(5)]), FeatureSpec(sma=[3], zscore=[3]), "1h", lag=False)
    rows = {r["ts"].hour: r for r in got.collect()}
    assert rows[1]["sma_3"] is None and rows[2]["sma_3"] == pytest.approx(101.0)
    flat = ft.build_features(bars_frame(spark, [(60 * i, 7.0) for i in range(5)]), FeatureSpec(zscore=[3]), "1h", lag=False)
    assert all(r["zscore_3"] is None for r in flat.collect())


def test_many_rules_equal_single_rules(spark, small):
    """One packed pass over more than one word gives each rule's own trades, with any block size."""
    bars = views.bars_1h(spark, small)
    spec = FeatureSpec(zscore=[10], roc=[3], clock=False)
    rules = [["zscore_10", ">", i / 30.0 - 1.0] for i in range(70)]
    packed = sg.evaluate_formulas(bars, spec, rules, "1h", 0.001, 0.0005, block_rows=32)
    for i in (0, 62, 63, 69):
        panel = sg.with_signal(ft.build_features(bars, spec, "1h"), rules[i])
        single = sg.trade_returns(sg.signal_edges(panel, ["symbol"], "1h"), ["symbol"], "1h", 0.001, 0.0005)
        mine = packed.where(F.col("formula_id") == fm.tree_id(rules[i]))
        j = mine.select("symbol", "ts", "edge", "pnl").join(single.select("symbol", "ts", F.col("edge").alias("e"), F.col("pnl").alias("p")), ["symbol", "ts"], "full")
        assert j.count() == single.count()
        assert j.where("not (edge <=> e) or abs(pnl - p) > 1e-12").isEmpty()


def test_costs_lower_the_result(spark, small):
    bars, spec = views.bars_1h(spark, small), FeatureSpec(zscore=[10], clock=False)
    mean = lambda fee, slip: sg.evaluate_formula(bars, spec, ["zscore_10", ">", 0.5], "1h", fee, slip).agg(F.avg("pnl")).first()[0]
    assert mean(0.0, 0.0) > mean(0.001, 0.0) > mean(0.001, 0.001)


def test_relaxed_probe_is_not_stricter(spark, small):
    bars, spec = views.bars_1h(spark, small), FeatureSpec(zscore=[10], clock=False)
    evaluate = lambda rules: sg.evaluate_rules(bars, spec, rules, "1h", 0.001, 0.0005)
    rules = sg.formula_table(spark, [["zscore_10", ">", 0.5]])
    score = lambda m: pp.robust_score(evaluate, rules, k=16, mdd_multiple=m).first()["robust_score"]
    assert score(5.0) >= score(1.0)


def test_population_of_one_symbol_first_edge_is_zero(spark):
    panel = bars_frame(spark, [(60 * i, 10 + i) for i in range(4)]).withColumn("signal", F.lit(True))
    assert {r["edge"] for r in sg.signal_edges(panel, ["symbol"], "1h").collect()} == {0}


def test_features_of_ones_own(spark, small):
    """A feature given as a function of the panel is lagged, usable in rules, and sees one bar of context across blocks."""
    from pyspark.sql import Window

    gap = lambda panel: F.col("open") - F.lag("close").over(panel.w)
    spec = FeatureSpec(roc=[3], clock=False, custom={"gap": gap})
    bars = views.bars_1h(spark, small)
    w = Window.partitionBy("symbol").orderBy("ts")
    for rows in (16, 4096):
        got = ft.build_features(bars, spec, "1h", block_rows=rows).select("symbol", "ts", "gap")
        want = bars.withColumn("_gap", F.col("open") - F.lag("close").over(w)).select("symbol", "ts", F.lag("_gap").over(w).alias("want"))
        assert got.join(want, ["symbol", "ts"]).where("not (gap <=> want)").isEmpty()
    trades = sg.evaluate_formula(bars, spec, ["gap", ">", 0.0], "1h", 0.0, 0.0)
    assert not trades.isEmpty()
