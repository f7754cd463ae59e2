"""Weights, budgets and position changes (family F, C-17 ... C-20, C-22).

Every table carries group keys (``portfolio_id``), so many portfolios are worked on at once.  Group totals are
partial aggregates joined back, never windows over a whole group, so one very large portfolio stays spread out.
A table that is read for its totals and again for its rows is materialised first (``cut_lineage``): by then it has
one row per strategy, and nothing upstream runs twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.ordered import RANGE, match, ranged, running
from barloom.operators.selection import top_per_group
from barloom.session import cut_lineage, stored

GROUP = ("portfolio_id",)


def _totals(df: DataFrame, keys: Sequence[str], **aggs) -> DataFrame:
    totals = df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return match(df, totals, keys, "left")


def inverse_variance_weights(returns: DataFrame, keys: Sequence[str] = GROUP, id: str = "alpha_id", value: str = "ret") -> DataFrame:
    """F-04: weights proportional to 1 / variance, series padded with zeros to the longest one of the group.

    Padding is arithmetic on count, mean and variance.  A series without variance gets the largest finite inverse.
    """
    s = cut_lineage(
        returns.groupBy(*keys, id).agg(
            F.count(value).alias("n"), F.avg(value).alias("_m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("_v")
        )
    )
    s = _totals(s, keys, _len=F.max("n"))
    square = F.col("n") * (F.col("_v") + F.col("_m") * F.col("_m"))
    total = F.col("n") * F.col("_m")
    var = F.try_divide(square - total * total / F.col("_len"), F.col("_len") - 1)
    var = F.when(F.col("_v") + F.abs(F.col("_m")) == 0, F.lit(0.0)).otherwise(var)
    s = s.select(*keys, id, F.when(var > 0, 1.0 / var).alias("_inv"))
    s = _totals(s, keys, _cols=F.count(F.lit(1)), _top=F.max("_inv"), _sum=F.sum("_inv"), _flat=F.count_if(F.col("_inv").isNull()))
    inv = F.coalesce("_inv", "_top")
    weight = F.try_divide(inv, F.col("_sum") + F.col("_flat") * F.col("_top"))
    even = 1.0 / F.col("_cols")
    return s.select(*keys, id, F.when(F.col("_cols") == 1, F.lit(1.0)).otherwise(F.coalesce(weight, even)).alias("weight"))


def lane_weights(
    returns: DataFrame, regime: str, kelly: dict[str, float], keys: Sequence[str] = GROUP, id: str = "alpha_id", min_trades: int = 5
) -> DataFrame:
    """F-05: inverse-variance weights inside each lane times the lane's Kelly fraction.

    ``returns`` has keys, lane, id, regime, ret.  A lane uses the regime's returns of strategies with more than
    ``min_trades`` of them; a lane with no such strategy uses all returns.
    """
    group = [*keys, "lane"]
    in_regime = F.col("regime") == regime
    n = cut_lineage(returns.groupBy(*group, id).agg(F.count(F.lit(1)).alias("_all"), F.count_if(in_regime).alias("_reg")))
    n = _totals(n, group, _usable=F.count_if(F.col("_reg") > min_trades))
    use_regime = F.col("_usable") > 0
    picked = n.where(F.when(use_regime, F.col("_reg") > min_trades).otherwise(F.col("_all") > min_trades))
    rows = match(returns, picked.select(*group, id, use_regime.alias("_by")), [*group, id]).where(~F.col("_by") | in_regime)
    share = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in kelly.items() for x in kv)), F.col("lane")), F.lit(0.5))
    w = inverse_variance_weights(rows, group, id)
    return w.withColumn("weight", F.col("weight") * share)


def cap_and_redistribute(weights: DataFrame, floor: float, cap: float, keys: Sequence[str] = GROUP, id: str = "alpha_id") -> DataFrame:
    """F-06: drop weights under the floor, normalise, cap, and hand the excess to the rest in proportion.

    Repeated proportional redistribution ends where the capped weights sit at the cap and all others share the
    remainder in their original proportions.  That point is found from running counts and sums over the distinct
    weights in falling order, so it is exact for any portfolio size.  A lone survivor is only capped.
    """
    w = cut_lineage(weights.where((F.col("weight") >= floor) & (F.col("weight") > 0)).select(*keys, id, "weight"))
    w = _totals(w, keys, _n=F.count(F.lit(1)), _sum=F.sum("weight")).withColumn("_v", F.col("weight") / F.col("_sum"))
    distinct = w.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumns({"_down": -F.col("_v"), "_mass": F.col("_v") * F.col("_c")})
    distinct = ranged(distinct, keys, ["_down"])
    ranked = running(distinct, keys, ["_down"], F.col(RANGE), _cum_c=("sum", "_c"), _cum_m=("sum", "_mass"))
    before_c, before_m = F.col("_cum_c") - F.col("_c"), F.col("_cum_m") - F.col("_mass")
    scale = F.when(before_c == 0, F.lit(1.0)).otherwise(F.try_divide(1.0 - before_c * cap, 1.0 - before_m))
    ok = (scale > 0) & (F.col("_v") * scale <= cap + 1e-12)
    point = ranked.withColumns({"_scale": scale, "_ok": ok}).where("_ok").groupBy(*keys).agg(
        F.max("_v").alias("_free"), F.max_by("_scale", "_v").alias("_scale")
    )
    out = match(w, point, keys, "left")
    shared = F.when(F.col("_v") <= F.col("_free"), F.least(F.lit(cap), F.col("_v") * F.col("_scale"))).otherwise(F.lit(cap))
    final = F.when(F.col("_n") == 1, F.least(F.col("weight"), F.lit(cap), F.lit(1.0))).otherwise(shared)
    return out.select(*keys, id, final.alias("weight"))


def _lane_means(alphas: DataFrame, keys: Sequence[str]) -> DataFrame:
    mean = lambda lane: F.coalesce(F.avg(F.when(F.col("lane") == lane, F.col("sortino"))), F.lit(0.0))
    return alphas.groupBy(*keys).agg(mean("core").alias("_c"), mean("moonshot").alias("_m"))


def _budget(b: DataFrame, previous: bool, base, low, high, core_low, core_high, dead_band, slope, max_step) -> DataFrame:
    """``core`` and ``moonshot`` from the lane means ``_c`` and ``_m``, and the last moonshot budget ``_prev``."""
    diff = F.col("_m") - F.col("_c")
    up = F.lit(base) + F.greatest(F.lit(0.0), F.least(F.lit(high - base), diff * slope))
    down = F.lit(base) - F.greatest(F.lit(0.0), F.least(F.lit(base - low), -diff * slope))
    target = F.when(diff > dead_band, up).when(diff < -dead_band, down).otherwise(F.lit(base))
    if previous:
        stepped = F.greatest(F.col("_prev") - max_step, F.least(F.col("_prev") + max_step, target))
        target = F.when(F.col("_prev").isNull(), target).otherwise(stepped)
    moon = F.greatest(F.lit(low), F.least(F.lit(high), target))
    core = F.greatest(F.lit(core_low), F.least(F.lit(core_high), 1.0 - moon))
    return b.withColumns({"core": core, "moonshot": 1.0 - core})


def lane_budgets(
    alphas: DataFrame, keys: Sequence[str] = GROUP, base: float = 0.05, low: float = 0.01, high: float = 0.20,
    core_low: float = 0.85, core_high: float = 0.99, dead_band: float = 0.10, slope: float = 0.05, max_step: float = 0.02,
    previous: DataFrame | None = None,
) -> DataFrame:
    """F-07: budget of the core and moonshot lanes from their mean Sortino ratios.

    Outside the dead band the moonshot budget moves linearly from its base, at most ``max_step`` from the previous
    budget, inside its limits; core gets the rest inside its own limits.
    """
    b = _lane_means(alphas, keys)
    if previous is not None:
        b = match(b, previous.select(*keys, F.col("moonshot").alias("_prev")), keys, "left")
    return _budget(b, previous is not None, base, low, high, core_low, core_high, dead_band, slope, max_step).select(*keys, "core", "moonshot")


def lane_cycle(
    alphas: DataFrame, state: DataFrame | None, keys: Sequence[str] = GROUP, smoothing: float = 0.30, base: float = 0.05,
    low: float = 0.01, high: float = 0.20, core_low: float = 0.85, core_high: float = 0.99, dead_band: float = 0.10,
    slope: float = 0.05, max_step: float = 0.02,
) -> DataFrame:
    """F-07 with memory: the lane state after one more cycle, ``keys, core_sortino, moonshot_sortino, core, moonshot``.

    Lane means are smoothed over cycles (weight ``smoothing`` on the new one, the first taken as it is) before the dead
    band is looked at, and the budget moves at most ``max_step`` from the state's.  ``state`` is the table the last cycle
    gave (None before the first); a key without strategies this cycle keeps its state as it is.
    """
    means = _lane_means(alphas, keys)
    settings = (base, low, high, core_low, core_high, dead_band, slope, max_step)
    if state is None:
        first = _budget(means, False, *settings)
        return first.select(*keys, F.col("_c").alias("core_sortino"), F.col("_m").alias("moonshot_sortino"), "core", "moonshot")
    old = state.select(*keys, F.col("core_sortino").alias("_oc"), F.col("moonshot_sortino").alias("_om"), F.col("core").alias("_ob"), F.col("moonshot").alias("_prev"))
    both = means.withColumn("_now", F.lit(True)).join(old, list(keys), "full")
    mixed = lambda new, past: F.when(F.col("_now").isNull(), F.col(past)).otherwise((1 - smoothing) * F.coalesce(past, new) + smoothing * F.col(new))
    both = both.withColumns({"_c": mixed("_c", "_oc"), "_m": mixed("_m", "_om")})
    moved = _budget(both, True, *settings)
    kept = lambda new, past: F.when(F.col("_now").isNull(), F.col(past)).otherwise(F.col(new))
    return moved.select(
        *keys, F.col("_c").alias("core_sortino"), F.col("_m").alias("moonshot_sortino"), kept("core", "_ob").alias("core"), kept("moonshot", "_prev").alias("moonshot")
    )


def lane_cycles(cycles: Iterable[DataFrame], state: DataFrame | None = None, **settings) -> DataFrame:
    """The lane state after several cycles in order; each cycle's state is a stored table that the next one reads."""
    for alphas in cycles:
        state = stored(lane_cycle(alphas, state, **settings), "lanes")
    return state


def apply_lane_budgets(
    weights: DataFrame, alphas: DataFrame, budgets: DataFrame, keys: Sequence[str] = GROUP, id: str = "alpha_id",
    probation_trades: int = 50, probation_cap: float = 0.03, floor: float = 0.0,
) -> DataFrame:
    """F-08 / C-22: scale lanes down to their budgets, normalise, cap young moonshots, drop dust, normalise again."""
    info = alphas.select(*keys, id, "lane", "n_trades")
    w = match(weights, info, [*keys, id], "left").withColumn("lane", F.coalesce("lane", F.lit("core")))
    w = cut_lineage(w.select(*keys, id, "lane", "n_trades", "weight"))
    lanes = match(w.groupBy(*keys, "lane").agg(F.sum("weight").alias("_lane")), budgets, keys)
    budget = F.when(F.col("lane") == "core", F.col("core")).otherwise(F.col("moonshot"))
    scale = F.when(F.col("_lane") > 0, F.least(F.lit(1.0), budget / F.greatest(F.col("_lane"), F.lit(1e-12)))).otherwise(1.0)
    lanes = cut_lineage(lanes.select(*keys, "lane", scale.alias("_scale"), (scale * F.col("_lane")).alias("_scaled")))
    factor = _totals(lanes, keys, _gross=F.sum("_scaled")).where(F.col("_gross") > 0)
    factor = factor.select(*keys, "lane", (F.col("_scale") / F.col("_gross")).alias("_factor"))
    w = match(w, factor, [*keys, "lane"]).withColumn("weight", F.col("weight") * F.col("_factor"))
    young = (F.col("lane") == "moonshot") & (F.col("n_trades") < probation_trades)
    w = w.withColumn("weight", F.when(young, F.least(F.col("weight"), F.lit(probation_cap))).otherwise(F.col("weight")))
    w = w.withColumn("weight", F.when(F.col("weight") < floor, 0.0).otherwise(F.col("weight")))
    w = _totals(w, keys, _total=F.sum("weight"))
    final = F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(F.col("weight"))
    return w.select(*keys, id, "lane", final.alias("weight"))


def retag_lane(alphas: DataFrame, min_trades: int = 300, min_sharpe: float = 1.0, min_sortino: float = 1.2, max_mdd: float = 0.25) -> DataFrame:
    """F-09: proven moonshots become core; ``retagged`` marks them."""
    proven = (
        (F.col("lane") == "moonshot") & (F.col("n_trades") >= min_trades) & (F.col("sharpe") >= min_sharpe)
        & (F.col("sortino") >= min_sortino) & (F.col("mdd") <= max_mdd)
    )
    return alphas.withColumns({"retagged": proven, "lane": F.when(proven, "core").otherwise(F.col("lane"))})


def ensemble_members(alphas: DataFrame, min_members: int = 3, max_members: int = 10, keys: Sequence[str] = GROUP, id: str = "alpha_id") -> DataFrame:
    """F-10: the best core strategies by Sortino; groups with too few core strategies have no ensemble."""
    core = alphas.where(F.col("lane") == "core")
    enough = core.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_members).drop("_n")
    top = top_per_group(core, keys, [F.desc("sortino"), F.asc(id)], max_members)
    return top.join(enough, list(keys), "left_semi")


def sharpe_weights(members: DataFrame, keys: Sequence[str] = GROUP, id: str = "alpha_id") -> DataFrame:
    """F-11: weights proportional to positive Sharpe ratios; equal weights when there are none."""
    pos = F.greatest(F.col("sharpe"), F.lit(0.0))
    m = _totals(members, keys, _n=F.count(F.lit(1)), _sum=F.sum(pos))
    w = F.when(F.col("_sum") > 0, pos / F.col("_sum")).otherwise(1.0 / F.col("_n"))
    return m.select(*keys, id, w.alias("weight"))


def equal_weights(members: DataFrame, keys: Sequence[str] = GROUP, id: str = "alpha_id") -> DataFrame:
    """F-11: 1 / n per group."""
    m = _totals(members, keys, _n=F.count(F.lit(1)))
    return m.select(*keys, id, (1.0 / F.col("_n")).alias("weight"))


def symbol_exposure(weights: DataFrame, alphas: DataFrame, keys: Sequence[str] = GROUP, id: str = "alpha_id") -> DataFrame:
    """C-17: weight per first universe symbol of the strategies; strategies without a universe drop out."""
    first = alphas.select(*keys, id, F.try_element_at("universe", F.lit(1)).alias("symbol")).where(F.col("symbol").isNotNull())
    return match(weights, first, [*keys, id]).groupBy(*keys, "symbol").agg(F.sum("weight").alias("weight"))


def enforce_risk(
    exposure: DataFrame, state: DataFrame, max_symbol: float = 1.0, max_gross: float = 1.0, trigger: float = 0.15, scalar: float = 0.5,
    keys: Sequence[str] = GROUP, renormalize: bool = True,
) -> DataFrame:
    """F-12: symbol cap, gross cap, drawdown scalar; all zero when halted.

    ``state`` has keys, equity, start_equity, halted.  The final normalisation undoes the gross and drawdown scaling;
    ``renormalize=False`` keeps them.
    """
    w = cut_lineage(exposure.select(*keys, "symbol", F.least(F.col("weight"), F.lit(max_symbol)).alias("weight")))
    w = match(_totals(w, keys, _gross=F.sum("weight")), state, keys)
    if renormalize:
        # every factor is common to the group, so after normalising only the capped proportions remain
        w = w.where(F.col("halted") | (F.col("_gross") > 0))
        scaled = F.coalesce(F.try_divide("weight", "_gross"), F.lit(0.0))
    else:
        gross = F.when(F.col("_gross") > max_gross, F.lit(max_gross) / F.col("_gross")).otherwise(1.0)
        down = F.when(F.col("equity") < F.coalesce("start_equity", "equity") * (1.0 - trigger), F.lit(scalar)).otherwise(1.0)
        scaled = F.col("weight") * gross * down
    return w.select(*keys, "symbol", F.when(F.col("halted"), 0.0).otherwise(scaled).alias("weight"))


def mark_to_market(positions: DataFrame, prices: DataFrame, cash: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """F-13: cash plus holdings at current prices; an unpriced holding counts as zero."""
    held = positions.join(prices, "symbol", "left").groupBy(*keys).agg(
        F.sum(F.col("amount") * F.coalesce("price", F.lit(0.0))).alias("holdings")
    )
    return match(cash, held, keys, "left").select(*keys, (F.col("cash") + F.coalesce("holdings", F.lit(0.0))).alias("equity"))


def position_targets(positions: DataFrame, targets: DataFrame, prices: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """C-18: every held or wanted symbol with amount, target weight and price, absent ones as zero."""
    j = positions.join(targets, [*keys, "symbol"], "full_outer").join(prices, "symbol", "left")
    zero = F.lit(0.0)
    return j.select(
        *keys, "symbol", F.coalesce("amount", zero).alias("amount"), F.coalesce("weight", zero).alias("weight"), F.coalesce("price", zero).alias("price")
    )


def rebalance_deltas(
    book: DataFrame, equity: DataFrame, min_notional: float = 0.0, max_notional: float | None = None, keys: Sequence[str] = GROUP
) -> DataFrame:
    """F-14: dollar change and side per symbol, without unpriced symbols and changes outside the notional limits."""
    j = match(book.where(F.col("price") > 0), equity, keys)
    delta = F.col("equity") * F.col("weight") - F.col("amount") * F.col("price")
    j = j.withColumn("delta_usd", delta).where(F.abs("delta_usd") >= F.greatest(F.lit(1e-6), F.lit(float(min_notional))))
    if max_notional is not None:
        j = j.where(F.abs("delta_usd") <= max_notional)
    return j.select(*keys, "symbol", "delta_usd", F.when(F.col("delta_usd") > 0, "buy").otherwise("sell").alias("side"))


def slippage_p90(fills: DataFrame, order: str = "ts", keys: Sequence[str] = ("symbol",), last: int = 400, min_ok: int = 20) -> DataFrame:
    """F-15: 90th percentile of slippage among the successful of the newest ``last`` probes, with at least ``min_ok``."""
    recent = top_per_group(fills, keys, [F.desc(order)], last).where((F.col("ok") == 1) & F.col("slip_bps").isNotNull())
    return recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("slip_bps", 0.9).alias("slip_p90")).where(F.col("n") >= min_ok)


def effective_slippage(df: DataFrame, overrides: DataFrame, default: float) -> DataFrame:
    """C-19: slippage fraction per symbol - a non-negative override in basis points, else the default."""
    o = overrides.select("symbol", F.when(F.col("bps") >= 0, F.col("bps") / 10000.0).alias("_o"))
    return df.join(o, "symbol", "left").withColumn("slippage", F.coalesce("_o", F.lit(default))).drop("_o")


def tier_lookup(df: DataFrame, equity: str, tiers: dict[float, float], default: float, name: str = "max_order") -> DataFrame:
    """C-20: value of the highest threshold not above equity.  Tiers are settings, so a CASE replaces the range join."""
    picked = F.lit(float(default))
    for threshold in sorted(tiers):
        picked = F.when(F.col(equity) >= threshold, F.lit(float(tiers[threshold]))).otherwise(picked)
    return df.withColumn(name, picked)
