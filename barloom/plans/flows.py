"""The three main flows, composed from the operators: raw bars to accepted bars, bars to surviving rules,
strategies to portfolio weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import OHLCV
from barloom.operators import portfolio as pf
from barloom.operators import population as pp
from barloom.operators import signals as sg
from barloom.operators import validation as va
from barloom.operators.bars import clean_bars
from barloom.operators.features import KEYS, FeatureSpec
from barloom.operators.quality import apply_repairs, flat_fill, validate_bars
from barloom.session import cut_lineage
from barloom.sources.lake import dedupe_bars


def accept_bars(
    bars: DataFrame, repairs: DataFrame, keys: Sequence[str], timeframe: str, gap_cap: float, max_fill: int
) -> tuple[DataFrame, DataFrame]:
    """D-07: (accepted bars, report per series).

    Validate; fill series just above the gap cap with flat bars when that clears them; repair what still has gaps
    within the cap; validate again; keep series that are not degraded.  Reports are one row per series and are
    materialised, so every stage touches only the series it is for.
    """
    key = list(keys)
    cols = [*key, "ts", *OHLCV]
    bars = bars.select(*cols)

    def only(df: DataFrame, flags: DataFrame, cond) -> DataFrame:
        return df.join(flags.where(cond).select(*key), key, "left_semi")

    first = cut_lineage(validate_bars(bars, keys, timeframe, gap_cap))
    fillable = F.col("degraded") & (F.col("gap_ratio") <= gap_cap * 1.05)
    clean = dedupe_bars(clean_bars(bars), keys).select(*cols)
    filled = cut_lineage(flat_fill(only(clean, first, fillable), keys, timeframe, max_fill).select(*cols))
    second = validate_bars(filled, keys, timeframe, gap_cap).select(
        *key, F.col("rows").alias("rows2"), F.col("gaps").alias("gaps2"), F.col("gap_ratio").alias("ratio2"), F.col("degraded").alias("degraded2")
    )
    better = F.coalesce(~F.col("degraded2") & (F.col("rows2") > F.col("rows")), F.lit(False))
    state = first.join(second, key, "left").withColumn("filled", better)
    state = cut_lineage(
        state.select(
            *key, "filled", "dropped", "dupes",
            *(F.when(F.col("filled"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("rows", "rows2"), ("gaps", "gaps2"), ("gap_ratio", "ratio2"), ("degraded", "degraded2"))),
        )
    )
    chosen = only(clean, state, ~F.col("filled")).unionByName(only(filled, state, F.col("filled")))
    repair = (F.col("gaps") > 0) & (~F.col("degraded") | (F.col("gap_ratio") <= gap_cap))
    mended = cut_lineage(apply_repairs(only(chosen, state, repair), only(repairs.select(*cols), state, repair), keys, timeframe))
    third = validate_bars(mended, keys, timeframe, gap_cap).select(
        *key, F.col("rows").alias("rows3"), F.col("gaps").alias("gaps3"), F.col("gap_ratio").alias("ratio3"), F.col("degraded").alias("degraded3")
    )
    report = state.join(third, key, "left").select(
        *key, "filled", F.col("rows3").isNotNull().alias("repaired"), "dropped", "dupes",
        F.coalesce("rows3", "rows").alias("rows"), F.coalesce("gaps3", "gaps").alias("gaps"), F.coalesce("ratio3", "gap_ratio").alias("gap_ratio"),
        (~F.coalesce("degraded3", "degraded")).alias("accepted"),
    )
    report = cut_lineage(report)
    final = only(chosen, state, ~repair).unionByName(mended.select(*cols))
    return only(final, report, F.col("accepted")), report


def discover(
    bars: DataFrame, spec: FeatureSpec, rules: Sequence | DataFrame, timeframe: str, fee: float, slip: float, min_trades: int,
    folds: int, alpha: float, dsr_min_prob: float, keys: Sequence[str] = KEYS, robust_min: float | None = None, probes: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """(trades, every rule with statistics and the gate it failed): features, signals, edges, validation, robustness.

    ``rules`` is a table (``formula_id``, ``formula_json``) or a list.  Trades are materialised once; validation reads
    them several times.  With ``robust_min`` the survivors, and only they, are probed with perturbed variants.
    """
    table = rules if isinstance(rules, DataFrame) else sg.formula_table(bars.sparkSession, rules)
    table = table.select("formula_id", "formula_json")
    evaluate = lambda t: sg.evaluate_rules(bars, spec, t, timeframe, fee, slip, keys)
    trades = cut_lineage(evaluate(table))
    judged = cut_lineage(va.validate_population(trades, table, min_trades, folds, alpha, dsr_min_prob))
    if robust_min is not None:
        left = table.join(judged.where(F.col("rejected_by").isNull()).select("formula_id"), "formula_id", "left_semi")
        totals = lambda t: sg.rule_totals(bars, spec, t, timeframe, fee, slip, keys)
        judged = pp.robust_gate(judged, pp.robust_score(evaluate, left, probes, totals=totals), robust_min)
    stats = pp.formula_stats(trades, table.select("formula_id")).select("formula_id", "mean_pnl", "sharpe")
    return trades, judged.join(stats, "formula_id")


def allocate(
    returns: DataFrame, alphas: DataFrame, regime: str, kelly: dict[str, float], floor: float, cap: float, state: DataFrame,
    max_symbol: float, max_gross: float,
) -> DataFrame:
    """Weight per portfolio and symbol: lane weights, floor and cap, lane budgets, exposure, risk limits."""
    raw = pf.lane_weights(returns, regime, kelly).drop("lane")
    capped = pf.cap_and_redistribute(raw, floor, cap)
    budgeted = pf.apply_lane_budgets(capped, alphas, pf.lane_budgets(alphas)).drop("lane")
    return pf.enforce_risk(pf.symbol_exposure(budgeted, alphas), state, max_symbol, max_gross)
