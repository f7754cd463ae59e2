"""Significance of rules from their realised returns (G-02, G-09 ... G-18, G-21).

A rule's returns are read in (symbol, time) order; a rule may hold any share of all rows because positions and
running sums are computed slot by slot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.stats import binomial_p_two_sided, deflated_sharpe_p, t_test_p
from barloom.operators.ordered import beside, exact_positions, match, positions, running, time_slot
from barloom.session import cut_lineage

ORDER = ("symbol", "ts")
ID = ("formula_id",)


def trade_slot(days: int = 30, order: str = "item") -> Column:
    """Slot of a trade row: its symbol and time span, or the time span alone for order='time'."""
    span = time_slot("ts", days * 86400)
    return F.struct(F.col("symbol"), span.alias("span")) if order == "item" else span


def _order(order: str) -> list[str]:
    return list(ORDER) if order == "item" else ["ts", "symbol"]


def trade_positions(trades: DataFrame, keys: Sequence[str] = ID, order: str = "item") -> DataFrame:
    """0-based position of every return in its rule, and the rule's count."""
    n = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return match(positions(trades, keys, _order(order), trade_slot(order=order), "_pos"), n, keys, "left").withColumn(
        "pos", F.col("_pos") - 1
    ).drop("_pos")


def cumulative(trades: DataFrame, keys: Sequence[str] = ID, value: str = "pnl", order: str = "item") -> DataFrame:
    return running(trades, keys, _order(order), trade_slot(order=order), cum=("sum", value))


def cum_min_drawdown(trades: DataFrame, keys: Sequence[str] = ID, value: str = "pnl") -> DataFrame:
    """G-21: size of the lowest cumulative result."""
    return cumulative(trades, keys, value).groupBy(*keys).agg(F.abs(F.min("cum")).alias("mdd"))


def performance_summary(trades: DataFrame, keys: Sequence[str] = ID, value: str = "pnl") -> DataFrame:
    """G-02: count, Sharpe, Sortino (downside deviation of min(x, 0)), win rate and deepest fall of the running sum.

    The returns themselves stay in the trade table in long form; a record never carries an unbounded array.
    """
    cum = cumulative(trades, keys, value)
    peaks = running(cum, keys, _order("item"), trade_slot(), peak=("max", "cum"))
    x = F.col(value)
    fall = F.greatest(F.col("peak"), F.lit(0.0)) - F.col("cum")
    return peaks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.coalesce(F.try_divide(F.avg(x), F.stddev_samp(x)), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.try_divide(F.avg(x), F.stddev_samp(F.least(x, F.lit(0.0)))), F.lit(0.0)).alias("sortino"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.max(fall).alias("mdd"),
    )


def _fold_bounds(k: int) -> dict[str, Column]:
    size = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return {"_size": size, "fold": F.least(F.floor(F.col("pos") / size), F.lit(k - 1)).cast("int")}


def _outside(fold: Column, k: int, embargo: int) -> Column:
    """Position is outside the fold widened by the embargo: usable for training."""
    start = fold * F.col("_size")
    end = F.when(fold == k - 1, F.col("n")).otherwise(F.least(F.col("n"), (fold + 1) * F.col("_size")))
    return (F.col("pos") < F.greatest(F.lit(0), start - embargo)) | (F.col("pos") >= F.least(F.col("n"), end + embargo))


def purged_folds(trades: DataFrame, k: int, embargo: int, keys: Sequence[str] = ID, order: str = "item") -> DataFrame:
    """G-09: test fold of every row and the folds it may train for.

    Fold edges follow from position and count, so membership is arithmetic per row instead of a join with bounds.
    """
    rows = trade_positions(trades, keys, order).withColumns(_fold_bounds(k))
    train = F.filter(F.array(*(F.lit(i) for i in range(k))), lambda f: _outside(f, k, embargo))
    return rows.withColumn("train_folds", train).drop("_size")


def cpcv_folds(trades: DataFrame, k: int, embargo: int, keys: Sequence[str] = ID, order: str = "item") -> DataFrame:
    """G-10: every pair of folds as test set - one row per row and split, with its role (test, train, purged)."""
    rows = trade_positions(trades, keys, order).withColumns(_fold_bounds(k))
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    roles = []
    for i, (a, b) in enumerate(pairs):
        role = (
            F.when(F.col("fold").isin(a, b), "test")
            .when(_outside(F.lit(a), k, embargo) & _outside(F.lit(b), k, embargo), "train")
            .otherwise("purged")
        )
        roles.append(F.struct(F.lit(i).alias("split"), F.lit(a).alias("fold_a"), F.lit(b).alias("fold_b"), role.alias("role")))
    return rows.select("*", F.inline(F.array(*roles))).drop("_size")


def _moments(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")]


def cv_stats(
    trades: DataFrame,
    k: int,
    keys: Sequence[str] = ID,
    value: str = "pnl",
    order: str = "item",
    min_trades_for_ttest: int = 5,
    bootstrap: DataFrame | None = None,
    bootstrap_below: int | None = None,
) -> DataFrame:
    """G-11 / G-12: mean one-sided p, mean and Sharpe over test folds with two or more returns.

    Without such a fold (or with fewer rows than folds) the whole sample is used: a binomial test on wins below
    ``min_trades_for_ttest`` rows, else the bootstrap p-value when a table of them is given, else a t-test.
    ``bootstrap_below`` extends the bootstrap to all rules with fewer trades.
    """
    rows = trade_positions(trades, keys, order).withColumns(_fold_bounds(k))
    folds = rows.groupBy(*keys, "fold").agg(*_moments(value))
    p = t_test_p(F.col("mean"), F.col("std"), F.col("n"))
    usable = folds.where(F.col("n") >= 2).withColumns(
        {"_p": p, "_sr": F.when(F.col("std") > 0, F.col("mean") / F.col("std")).otherwise(0.0)}
    )
    over_folds = usable.groupBy(*keys).agg(
        F.when(F.count_if(F.col("_p").isNull()) == 0, F.avg("_p")).alias("_p_cv"),
        F.avg("mean").alias("_mean_cv"),
        F.avg("_sr").alias("_sr_cv"),
        F.count(F.lit(1)).alias("folds_used"),
    )
    whole = trades.groupBy(*keys).agg(*_moments(value), F.count_if(F.col(value) > 0).alias("wins"))
    full_t = t_test_p(F.col("mean"), F.col("std"), F.col("n"))
    out = match(whole, over_folds, keys, "left")
    if bootstrap is not None:
        out = match(out, bootstrap.select(*keys, F.col("p_bootstrap").alias("_p_boot")), keys, "left")
    else:
        out = out.withColumn("_p_boot", F.lit(None).cast("double"))
    fallback = F.col("_mean_cv").isNull() | (F.col("n") < k)
    p_whole = (
        F.when(F.col("n") < min_trades_for_ttest, binomial_p_two_sided(F.col("wins"), F.col("n")))
        .when((F.col("n") >= k) & F.col("_p_boot").isNotNull(), F.col("_p_boot"))
        .otherwise(full_t)
    )
    p_value = F.when(fallback, p_whole).otherwise(F.col("_p_cv"))
    if bootstrap_below is not None:
        p_value = F.when((F.col("n") < bootstrap_below) & F.col("_p_boot").isNotNull(), F.col("_p_boot")).otherwise(p_value)
    spread = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return out.select(
        *keys,
        p_value.alias("p_value"),
        F.when(fallback, F.col("mean")).otherwise(F.col("_mean_cv")).alias("mean_oos"),
        F.when(fallback, F.col("mean") / spread).otherwise(F.col("_sr_cv")).alias("sharpe_oos"),
        F.col("n").alias("total_trades"),
        fallback.alias("is_fallback"),
    )


def win_test(trades: DataFrame, keys: Sequence[str] = ID, value: str = "pnl") -> DataFrame:
    """G-13: two-sided binomial test of the share of winning trades."""
    c = trades.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("wins"))
    return c.withColumn("p_binomial", binomial_p_two_sided(F.col("wins"), F.col("n")))


#: Returns of a rule that one row of ``bootstrap_p`` draws for.
DRAWN = 4096
#: Chances of at most 0, 1, .. 6 events of a Poisson variable of mean 1, in units of 2 ** -32.
POISSON_STEPS = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * (1 << 32)) for k in range(7))


def bootstrap_p(trades: DataFrame, n_iter: int, seed: int, keys: Sequence[str] = ID, value: str = "pnl", order: str = "item") -> DataFrame:
    """G-14: share of resampled, centred means that reach the observed mean.

    Each return enters each resample with a Poisson(1) weight, drawn from word i % 4 of md5(seed|rule|position|i div 4);
    resample sizes therefore vary around the rule's own.  No draw is a row: a block of a rule's returns makes its
    weights and weighted sums as arrays.  A rule within one block gives the number of its resamples and of those that
    reach the mean, a longer one its sums by block and resample.  An empty resample is left out.
    """
    ranked = trade_positions(trades, keys, order).select(*keys, "pos", "n", F.col(value).alias("_x"))
    stats = trades.groupBy(*keys).agg(*_moments(value))
    text = F.concat_ws("|", F.lit(str(seed)), *keys).alias("_text")
    blocks = ranked.groupBy(*keys, F.floor(F.col("pos") / DRAWN).alias("_block")).agg(
        F.collect_list(F.struct("pos", "_x")).alias("_rows"), (F.max("n") <= DRAWN).alias("_whole")
    )
    blocks = match(blocks, stats.select(*keys, "mean"), keys).select(*keys, text, "_whole", "mean", "_rows")
    schema = T.StructType([*(trades.schema[k] for k in keys), *T.StructType.fromDDL("_it int, _s double, _w long").fields])

    def run(arrow):
        import hashlib

        import numpy as np
        import pyarrow as pa

        md5, words = hashlib.md5, [b"|%d" % g for g in range((n_iter + 3) // 4)]
        steps = np.array(POISSON_STEPS, np.uint32)
        for batch in arrow:
            rows_ = batch.column("_rows")
            for i in range(batch.num_rows):
                rows, text = rows_.slice(i, 1).flatten(), batch.column("_text")[i].as_py()
                pos, x = rows.field("pos").to_numpy(), rows.field("_x").to_numpy(zero_copy_only=False)
                sums, weights = np.zeros(n_iter), np.zeros(n_iter, np.int64)
                for a in range(0, len(pos), 256):
                    starts = [f"{text}|{p}".encode() for p in pos[a : a + 256]]
                    digests = b"".join([md5(p + g).digest() for p in starts for g in words])
                    u = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(starts), -1)[:, :n_iter]
                    w = np.zeros(u.shape, np.uint8)
                    for step in steps:
                        w += u >= step
                    part, known = x[a : a + 256], ~np.isnan(x[a : a + 256])
                    sums += part[known] @ w[known].astype(np.float64)
                    weights += w.sum(axis=0, dtype=np.int64)
                if batch.column("_whole")[i].as_py():
                    mean, drawn = batch.column("mean")[i].as_py(), weights > 0
                    hits = sums[drawn] / weights[drawn] - mean >= mean if mean is not None else drawn[:0]
                    out = [pa.array([-1], pa.int32()), pa.array([float(hits.sum())]), pa.array([int(drawn.sum())])]
                else:
                    out = [pa.array(np.arange(n_iter, dtype=np.int32)), pa.array(sums), pa.array(weights)]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(k)[i], len(out[0])) for k in keys), *out], names=schema.names)

    summed = blocks.mapInArrow(run, schema).groupBy(*keys, "_it").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w"))
    means = match(summed, stats, keys)
    whole = F.col("_it") < 0
    hit = F.when(whole, F.col("_s")).otherwise((F.try_divide("_s", "_w") - F.col("mean") >= F.col("mean")).cast("double"))
    drawn = F.when(whole, F.col("_w")).otherwise((F.col("_w") > 0).cast("long"))
    tail = F.try_divide(F.sum(hit), F.sum(drawn))
    p = means.groupBy(*keys).agg(tail.alias("_tail"), F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"))
    raw = F.when(F.col("mean") > 0, F.col("_tail")).otherwise(1.0)
    value_p = F.when((F.col("n") < 3) | (F.col("std") == 0), 1.0).when(raw > 0, raw).otherwise(1.0 / n_iter)
    return p.select(*keys, F.least(F.lit(1.0), value_p).alias("p_bootstrap"))


def sparse_bootstrap(
    trades: DataFrame, k: int, n_iter: int, seed: int, keys: Sequence[str] = ID, value: str = "pnl", order: str = "item",
    min_trades_for_ttest: int = 5, below: int | None = None,
) -> DataFrame:
    """G-12: bootstrap p-values of those rules alone whose verdict rests on them, for ``cv_stats`` and ``validate_population``.

    These are rules with enough returns for ``k`` folds of which none holds two, and all with fewer than ``below``
    returns.  They are chosen by their counts before a single draw is made.
    """
    counts = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fold = F.expr(f"_n div {k}")
    thin = (F.col("_n") >= max(k, min_trades_for_ttest)) & (fold < 2) & (F.col("_n") - (k - 1) * fold < 2)
    wanted = counts.where(thin if below is None else thin | (F.col("_n") < below))
    return bootstrap_p(trades.join(wanted, list(keys), "left_semi"), n_iter, seed, keys, value, order)


def bh_fdr(
    df: DataFrame, alpha: float, keys: Sequence[str] = (), p: str = "p_value", tie: str = "formula_id", step_up: bool = False
) -> DataFrame:
    """G-15: accept flags at false-discovery level ``alpha`` and the largest accepted p per key.

    Default: each rank is held against its own threshold.  ``step_up=True``: every rank up to the largest passing
    one is accepted.  Ranks are exact but distributed: rules are dealt into ranges of p and id, so even a third of all
    rules with the same p is spread out.
    """
    ranked = exact_positions(df, keys, [F.asc_nulls_last(p), F.asc(tie)], "bh_rank")
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    ranked = match(ranked, totals, keys, "left")
    passes = F.coalesce(F.col(p) <= F.col("bh_rank") / F.col("_m") * F.lit(float(alpha)), F.lit(False))
    ranked = ranked.withColumn("_pass", passes)
    last = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_pass"), F.col("bh_rank"))).alias("_last"), F.coalesce(F.max(F.when(F.col("_pass"), F.col(p))), F.lit(0.0)).alias("bh_threshold")
    )
    out = match(ranked, last, keys, "left")
    accept = F.coalesce(F.col("bh_rank") <= F.col("_last"), F.lit(False)) if step_up else F.col("_pass")
    return out.withColumn("bh_accept", accept).drop("_m", "_pass", "_last")


def deflated_sharpe(trades: DataFrame, trials: int | DataFrame, keys: Sequence[str] = ID, value: str = "pnl", benchmark: float = 0.0) -> DataFrame:
    """G-16: probability that a rule's Sharpe ratio beats the luckiest of all rules tried."""
    m = trades.groupBy(*keys).agg(*_moments(value))
    if isinstance(trials, int):
        m = m.withColumn("_trials", F.lit(trials))
    else:
        m = m.transform(beside, trials.select(F.col(trials.columns[0]).alias("_trials")))
    p = deflated_sharpe_p(F.col("mean"), F.col("std"), F.col("n"), F.col("_trials"), benchmark)
    return m.select(*keys, p.alias("dsr_prob"))


def pbo(per_symbol: DataFrame, splits: int, min_symbols: int, seed: int) -> DataFrame:
    """G-17: share of random symbol halves in which the best rule of one half ranks below the median of the other.

    ``per_symbol`` has formula_id, symbol, mean_ret.  Halves come from the rank of md5(seed|split|symbol).  The
    winner's rank is a count of better rules, so no split is sorted by rule.
    """
    symbols = per_symbol.select("symbol").distinct()
    shape = symbols.agg(F.count(F.lit(1)).alias("_n_sym")).transform(
        beside, per_symbol.agg(F.countDistinct("formula_id").alias("_n_form"))
    )
    draws = symbols.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("split").cast("string"), "symbol"))
    draws = draws.withColumn("_key", key)
    prefix = F.substring("_key", 1, 3)
    ranked = positions(draws, ["split"], ["_key", "symbol"], prefix, "_r").transform(beside, shape)
    halves = ranked.select(
        "split", "symbol", (F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n_sym") / 2))).alias("in_sample")
    )
    means = (
        per_symbol.join(halves, "symbol")
        .groupBy("split", "formula_id")
        .agg(
            F.avg(F.when(F.col("in_sample"), F.col("mean_ret"))).alias("is_mean"),
            F.avg(F.when(~F.col("in_sample"), F.col("mean_ret"))).alias("oos_mean"),
        )
    )
    best = means.groupBy("split").agg(
        F.count("is_mean").alias("_n_is"),
        F.count("oos_mean").alias("_n_oos"),
        F.max(F.when(F.col("is_mean").isNotNull(), F.col("is_mean"))).alias("_top"),
    )
    winner = means.join(best, "split").where(F.col("is_mean") == F.col("_top")).groupBy("split").agg(
        F.min_by(F.struct("oos_mean", "_n_is", "_n_oos"), "formula_id").alias("_w"), F.min("formula_id").alias("_id")
    ).select("split", F.col("_w.oos_mean").alias("_w_oos"), "_w._n_is", "_w._n_oos", "_id")
    ahead = (F.col("oos_mean") > F.col("_w_oos")) | ((F.col("oos_mean") == F.col("_w_oos")) & (F.col("formula_id") < F.col("_id")))
    placed = means.join(winner, "split").groupBy("split", "_w_oos", "_n_is", "_n_oos").agg(F.count_if(ahead).alias("_pos"))
    valid = placed.where((F.col("_n_is") >= 2) & (F.col("_n_oos") >= 2) & F.col("_w_oos").isNotNull())
    share = valid.agg(
        F.count(F.lit(1)).alias("valid_splits"), F.count_if(F.col("_pos") / (F.col("_n_oos") - 1) > 0.5).alias("overfit_splits")
    )
    enough = (F.col("_n_sym") >= max(2, min_symbols)) & (F.col("_n_form") >= 2) & (F.col("valid_splits") > 0)
    value = F.when(enough, F.try_divide(F.col("overfit_splits").cast("double"), F.col("valid_splits"))).otherwise(0.0)
    return share.transform(beside, shape).select("valid_splits", "overfit_splits", value.alias("pbo"))


def pbo_gate(candidates: DataFrame, pbo_row: DataFrame, cap: float) -> DataFrame:
    """G-38: no candidate passes when the probability of overfitting is above the cap."""
    ok = pbo_row.where(F.col("pbo") <= cap).select("pbo")
    return candidates.transform(beside, ok).drop("pbo")


def validate_population(
    trades: DataFrame, formulas: DataFrame, min_trades: int, k: int, alpha: float, dsr_min_prob: float,
    bench: float = 0.0, bootstrap: DataFrame | None = None, use_dsr: bool = True, bootstrap_below: int | None = None,
) -> DataFrame:
    """G-18: every rule with its statistics and the first gate it fails (min_trades, fdr, dsr), NULL for survivors.

    False-discovery ranks run over the rules that reach ``min_trades`` only; the number of trials is all rules.
    The per-rule table is materialised once because ranking reads it several times.
    """
    n = trades.groupBy("formula_id").agg(F.count(F.lit(1)).alias("n_trades"))
    rules = formulas.join(n, "formula_id", "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0)).cast("long"))
    enough = trades.join(n.where(F.col("n_trades") >= min_trades), "formula_id", "left_semi")
    cv = cut_lineage(cv_stats(enough, k, bootstrap=bootstrap, bootstrap_below=bootstrap_below).select("formula_id", "p_value", "mean_oos", "sharpe_oos"))
    trials = formulas.agg(F.count(F.lit(1)).alias("trials"))
    dsr = deflated_sharpe(enough, trials, benchmark=bench)
    tested = bh_fdr(cv, alpha).join(dsr, "formula_id")
    reason = (
        F.when(F.col("n_trades") < min_trades, "min_trades")
        .when(~F.col("bh_accept"), "fdr")
        .when(F.lit(use_dsr) & (F.col("dsr_prob") < dsr_min_prob), "dsr")
    )
    return rules.join(tested, "formula_id", "left").withColumn("rejected_by", reason).drop("bh_rank", "bh_threshold")
