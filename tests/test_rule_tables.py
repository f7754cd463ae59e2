"""Rules that arrive as a table: programs, the interpreter against single rules, variants, the gate after validation."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from barloom.functions import formula as fm
from barloom.operators import features as ft
from barloom.operators import population as pp
from barloom.operators import rules as rl
from barloom.operators import signals as sg
from barloom.operators.features import FeatureSpec
from barloom.plans.flows import discover
from barloom.plans.queries_features import RULES
from barloom.sources import views

SPEC = FeatureSpec(zscore=[10], roc=[3], clock=False)


@pytest.mark.parametrize(
    "tree,leaves,steps",
    [
        ([], 0, []),
        (["a", ">", 1.0], 1, [0]),
        ([["a", ">", 1.0], "OR", [["b", "<", 2], "AND", ["c", "!=", "d"]]], 3, [0, 1, 2, rl.AND, rl.OR]),
        ([[["a", ">", 1.0], "AND", ["b", "<", 2]], "OR", ["a", ">", 1.0]], 3, [0, 1, rl.AND, 2, rl.OR]),
    ],
)
def test_program(tree, leaves, steps):
    got = rl.program(tree)
    assert len(got[0]) == leaves and got[1] == steps


@pytest.mark.parametrize("tree", [["a", "~", 1.0], ["a", ">"], [["a", ">", 1.0], ">", 2.0], ["a", ">", True], "a"])
def test_bad_shapes(spark, tree):
    with pytest.raises(ValueError):
        rl.program(tree)
    bad = spark.createDataFrame([("x", json.dumps(tree)), ("y", '["a",">",1]'), ("z", None), ("w", "[")], "formula_id string, formula_json string")
    assert {r.formula_id: r.steps for r in rl.compile_rules(bad).collect()} == {"x": None, "y": [0], "z": None, "w": None}


def test_table_equals_compiled_columns(spark, small):
    """Every rule over blocks and batches of any size gives what its compiled column gives; repeated and bad rows do not matter."""
    bars = views.bars_1h(spark, small)
    trees = [
        ["zscore_10", ">", 0.3], [["roc_3", "<=", 0.1], "AND", ["zscore_10", "!=", 0.0]], ["close", ">", "open"], ["missing", "!=", 1.0], [],
        [1.0, "<", 2.0], [0.2, "<", "roc_3"], [[["zscore_10", ">", 0.2], "AND", ["roc_3", "<", 1.0]], "OR", [["volume", ">=", 2.0], "AND", ["close", "==", "close"]]],
        ["_next_open", ">", 0.0],
    ]
    table = sg.formula_table(spark, trees)
    table = table.union(table).union(spark.createDataFrame([("bad", "[1,2]")], table.schema))
    panel = ft.build_features(bars, SPEC, "1h")
    for block, batch in ((64, 3), (4096, 512)):
        laid = ft.feature_panel(bars, SPEC, "1h", extra_back=1, ahead=1, block_rows=block)
        got = rl.evaluate_rules_on_panel(laid, table, ["open", "close", "volume", *SPEC.names()], 0.001, 0.0005, per_batch=batch).cache()
        assert got.where("formula_id = 'bad'").isEmpty()
        for t in trees:
            one = sg.with_signal(panel.select("symbol", "ts", "open", "close", "volume", *SPEC.names()), t)
            want = sg.trade_returns(sg.signal_edges(one, ["symbol"], "1h"), ["symbol"], "1h", 0.001, 0.0005)
            mine = got.where(F.col("formula_id") == fm.tree_id(t)).drop("formula_id")
            key = lambda r: (r.symbol, r.ts)
            assert sorted(mine.collect(), key=key) == sorted(want.select(mine.columns).collect(), key=key)


def test_no_rules_and_no_bars(spark, small):
    bars = views.bars_1h(spark, small)
    none = sg.formula_table(spark, [["close", ">", 0.0]]).limit(0)
    assert sg.evaluate_rules(bars, SPEC, none, "1h", 0.0, 0.0).collect() == []
    assert sg.evaluate_rules(bars.limit(0), SPEC, sg.formula_table(spark, [["close", ">", 0.0]]), "1h", 0.0, 0.0).collect() == []


def plain_variant(tree, i, delta=0.15, seed=7):
    digest = hashlib.md5(f"{seed}|{fm.tree_id(tree)}|{i}".encode()).hexdigest()
    pick, kind, size = (int(digest[j : j + 8], 16) / 2**32 for j in (0, 8, 16))
    copy = json.loads(fm.to_json(tree))
    found = fm.leaves(copy)
    leaf = found[int(pick * len(found))]
    if kind < 0.8 and not isinstance(leaf[2], str):
        leaf[2] = float(leaf[2]) * (1.0 + (2 * size - 1) * delta)
    else:
        leaf[1] = ">" if leaf[1] == "<" else "<"
    return copy


def test_variants_against_plain(spark):
    got = rl.variants(sg.formula_table(spark, [*RULES, []]), 64, 0.15, 7).collect()
    assert len(got) == 64 * len(RULES)
    by = {(r.formula_id, int(r.variant_id.split("#")[1])): json.loads(r.formula_json) for r in got}
    for t in RULES:
        for i in range(64):
            mine, want = fm.leaves(by[fm.tree_id(t), i]), fm.leaves(plain_variant(t, i))
            assert [x[:2] for x in mine] == [x[:2] for x in want]
            assert [x[2] for x in mine] == [pytest.approx(x[2], rel=1e-12) if not isinstance(x[2], str) else x[2] for x in want]


def test_flow_with_the_last_gate(spark, small):
    """Only survivors are probed, and what the gate adds is a reason."""
    bars = views.bars_1h(spark, small)
    rules = sg.formula_table(spark, [["zscore_10", ">", 0.5], ["roc_3", "<", 0.0], ["close", ">", 1e9]])
    _, plain = discover(bars, SPEC, rules, "1h", 0.0, 0.0, 5, 3, 1.0, 0.0)
    _, gated = discover(bars, SPEC, rules, "1h", 0.0, 0.0, 5, 3, 1.0, 0.0, robust_min=1.01, probes=8)
    before, after = ({r.formula_id: r.rejected_by for r in x.collect()} for x in (plain, gated))
    assert any(v is None for v in before.values()) and before[fm.tree_id(["close", ">", 1e9])] == "min_trades"
    assert after == {k: v or "robust" for k, v in before.items()}
    assert {r.reason for r in pp.rejection_summary(gated, "base").collect()} >= {"robust_stage_base", "min_trades_stage_base"}
