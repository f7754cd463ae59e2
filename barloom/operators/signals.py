"""Signals, edges and per-edge returns (F-01 ... F-03, C-09, C-15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.formula import compile_formula
from barloom.operators.bars import bar_slot
from barloom.operators.features import KEYS, FeatureSpec, feature_panel
from barloom.operators.ordered import neighbour
from barloom.operators.rules import RULE_BLOCK, evaluate_rules_on_panel, rule_table, rule_totals_on_panel


def signal_edges(df: DataFrame, keys: Sequence[str], timeframe: str, signal: str = "signal") -> DataFrame:
    """F-01: change of a 0/1 signal against the previous bar; 0 on the first bar.  A missing signal is off."""
    on = df.withColumn("_on", F.coalesce(F.col(signal), F.lit(False)).cast("int"))
    seen = neighbour(on, keys, ["ts"], bar_slot("ts", timeframe), {"_was": "_on"})
    return seen.withColumn("edge", F.col("_on") - F.coalesce("_was", "_on")).drop("_on", "_was")


def edge_pnl(edge: Column, close: Column, next_open: Column, fee: float, slip: float) -> dict[str, Column]:
    """Execution price with slippage, cost, and result at the next bar's open, per edge."""
    exec_price = close * (1 + edge * F.lit(slip))
    cost = exec_price * F.lit(fee)
    return {"exec_price": exec_price, "exit_price": next_open, "cost": cost, "pnl": edge * (next_open - exec_price) - cost}


def trade_returns(df: DataFrame, keys: Sequence[str], timeframe: str, fee: float, slip: float, edge: str = "edge") -> DataFrame:
    """F-02: one row per edge; the next open is looked up before edges are filtered, the last bar cannot close."""
    seen = neighbour(df, keys, ["ts"], bar_slot("ts", timeframe), {"_next_open": "open"}, ahead=True)
    parts = edge_pnl(F.col(edge).cast("double"), F.col("close"), F.col("_next_open"), fee, slip)
    rows = seen.where((F.col(edge) != 0) & F.col("_next_open").isNotNull())
    return rows.select(*keys, "ts", edge, *(c.alias(n) for n, c in parts.items())).where(F.col("pnl").isNotNull())


def with_signal(df: DataFrame, tree, name: str = "signal") -> DataFrame:
    """B-04 / C-09: rule as a boolean column of the panel; no join."""
    return df.withColumn(name, compile_formula(tree, df.columns))


def join_signal(df: DataFrame, signals: DataFrame, keys: Sequence[str], name: str = "signal") -> DataFrame:
    """C-09: attach an external signal table; bars without one are off."""
    return df.join(signals, [*keys, "ts"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def evaluate_rules(
    bars: DataFrame, spec: FeatureSpec, rules: DataFrame, timeframe: str, fee: float, slip: float,
    keys: Sequence[str] = KEYS, block_rows: int = RULE_BLOCK,
) -> DataFrame:
    """C-15 / F-03: features, signals, edges and returns of all rules of a table (``formula_id``, ``formula_json``)."""
    panel = feature_panel(bars, spec, timeframe, keys, extra_back=1, ahead=1, block_rows=block_rows)
    return evaluate_rules_on_panel(panel, rules, ["open", "high", "low", "close", "volume", *spec.names()], fee, slip)


def rule_totals(
    bars: DataFrame, spec: FeatureSpec, rules: DataFrame, timeframe: str, fee: float, slip: float,
    keys: Sequence[str] = KEYS, block_rows: int = RULE_BLOCK,
) -> DataFrame:
    """Number, mean and lowest running sum (G-21) of each rule's returns, without a row per trade."""
    panel = feature_panel(bars, spec, timeframe, keys, extra_back=1, ahead=1, block_rows=block_rows)
    return rule_totals_on_panel(panel, rules, ["open", "high", "low", "close", "volume", *spec.names()], fee, slip)


def evaluate_formulas(
    bars: DataFrame, spec: FeatureSpec, trees: Sequence, timeframe: str, fee: float, slip: float,
    keys: Sequence[str] = KEYS, block_rows: int = RULE_BLOCK,
) -> DataFrame:
    """C-15: the same for rules given in code."""
    return evaluate_rules(bars, spec, rule_table(bars.sparkSession, trees), timeframe, fee, slip, keys, block_rows)


def evaluate_formula(bars: DataFrame, spec: FeatureSpec, tree, timeframe: str, fee: float, slip: float, keys=KEYS) -> DataFrame:
    """F-03: trades of one rule."""
    return evaluate_formulas(bars, spec, [tree], timeframe, fee, slip, keys)


formula_table = rule_table
