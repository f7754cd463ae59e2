"""Totals of rules against the totals of their trades."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import population as pp
from barloom.operators import rules as rl
from barloom.operators import signals as sg
from barloom.operators.features import FeatureSpec
from barloom.sources import views

SPEC = FeatureSpec(zscore=[10], roc=[3], clock=False)
TREES = [["zscore_10", ">", 0.3], [["roc_3", "<=", 0.1], "AND", ["zscore_10", "!=", 0.0]], ["close", ">", "open"], ["missing", "!=", 1.0], [], ["close", ">", 30.0]]


@pytest.mark.parametrize("source,timeframe", [("bars_user", "6h"), ("bars_1h", "1h")])
def test_totals_equal_those_of_trades(spark, small, source, timeframe):
    """Whatever the size of blocks, stretches and batches, also where a stretch ends within a series."""
    bars, rules = getattr(views, source)(spark, small), sg.formula_table(spark, TREES)
    want = pp._totals_of(lambda r: sg.evaluate_rules(bars, SPEC, r, timeframe, 0.001, 0.0005))(rules)
    want = {r.formula_id: r for r in want.collect()}
    assert len(want) == 4
    for block, stretch, batch in ((16, 40, 2), (4096, 100, 512), (64, 100_000, 3)):
        panel = ft.feature_panel(bars, SPEC, timeframe, extra_back=1, ahead=1, block_rows=block)
        got = rl.rule_totals_on_panel(panel, rules, ["open", "close", *SPEC.names()], 0.001, 0.0005, per_batch=batch, stretch=stretch)
        got = {r.formula_id: r for r in got.collect()}
        assert {k: r.n_trades for k, r in got.items()} == {k: r.n_trades for k, r in want.items()}
        for k, r in got.items():
            assert r["mean"] == pytest.approx(want[k]["mean"], abs=1e-9) and r["mdd"] == pytest.approx(want[k]["mdd"], abs=1e-7)


def test_robust_score_from_totals(spark, small):
    bars, rules = views.bars_user(spark, small), sg.formula_table(spark, TREES[:3])
    plain = pp.robust_score(lambda r: sg.evaluate_rules(bars, SPEC, r, "6h", 0.001, 0.0005), rules, k=8)
    got = pp.robust_score(None, rules, k=8, totals=lambda r: sg.rule_totals(bars, SPEC, r, "6h", 0.001, 0.0005))
    both = got.alias("a").join(plain.alias("b"), "formula_id").where((F.col("a.robust_score") == F.col("b.robust_score")) & (F.col("a.n_trades") == F.col("b.n_trades")))
    assert both.count() == 3
    empty = pp.robust_score(None, rules, k=2, totals=lambda r: sg.rule_totals(bars.limit(0), SPEC, r, "6h", 0.001, 0.0005))
    assert {(r.robust_score, r.n_trades) for r in empty.collect()} == {(0.0, 0)}
