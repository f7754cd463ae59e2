"""Statistics, gates and selection over rule populations and strategy registries (family G)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.formula import formula_complexity, formula_features
from barloom.operators.ordered import beside, blocked, exact_positions, match, positions, quantiles, running
from barloom.operators.rules import variants
from barloom.operators.selection import top_bottom, top_per_group
from barloom.session import cut_lineage


def formula_stats(trades: DataFrame, formulas: DataFrame, above_least: bool = False) -> DataFrame:
    """G-01: trades, mean and mean-over-deviation per rule; no spread gives 0, no trades gives -1.

    ``above_least`` takes the deviation of what lies above a rule's smallest return: returns that hardly differ keep
    their digits then, whatever the order of sums.  It reads the trades twice.
    """
    pnl = F.col("pnl")
    if above_least:
        trades = trades.join(trades.groupBy("formula_id").agg(F.min("pnl").alias("_least")), "formula_id")
        pnl = pnl - F.col("_least")
    s = trades.groupBy("formula_id").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg("pnl").alias("mean_pnl"), F.stddev_samp(pnl).alias("std_pnl")
    )
    sharpe = F.when(F.col("n_trades").isNull(), F.lit(-1.0)).when(F.col("std_pnl") == 0, F.lit(0.0)).otherwise(
        F.try_divide("mean_pnl", "std_pnl")
    )
    return formulas.join(s, "formula_id", "left").withColumns(
        {"sharpe": sharpe, "n_trades": F.coalesce("n_trades", F.lit(0)).cast("long")}
    )


def _per_key(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return match(df, other, keys)


def population_diag(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G-04: share of rules without trades; median and 90th percentile of trades and Sharpe of the others."""
    head = stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pop"), F.round(F.avg((F.col("n_trades") == 0).cast("double")), 4).alias("zero_trade_pct")
    )
    traded = stats.where(F.col("n_trades") > 0).withColumn("n_trades", F.col("n_trades").cast("double"))
    t = quantiles(traded, keys, "n_trades", {"trades_median": 0.5, "trades_p90": 0.9})
    s = quantiles(traded, keys, "sharpe", {"sharpe_median": 0.5, "sharpe_p90": 0.9})
    return _per_key(_per_key(head, t, keys), s, keys)


def population_extremes(stats: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """G-04: the k best and k worst rules by Sharpe."""
    return top_bottom(stats.where(F.col("n_trades") > 0), keys, "sharpe", "formula_id", k)


def is_degenerate(stats: DataFrame, n_features: int, keys: Sequence[str] = ()) -> DataFrame:
    """G-05: too many rules without trades for the size of the population and feature set."""
    share = F.avg((F.col("n_trades") == 0).cast("double"))
    limit = F.least(F.lit(0.85), 0.5 + 0.02 * F.count(F.lit(1)) / max(1, n_features))
    return stats.groupBy(*keys).agg(
        F.round(share, 4).alias("degenerate_pct"), limit.alias("limit"), (share >= limit).alias("degenerate")
    )


def gate_diagnostic(validated: DataFrame) -> DataFrame:
    """G-06: accepted share of the population and median trades of the accepted."""
    density = validated.agg(F.avg(F.col("rejected_by").isNull().cast("double")).alias("survivor_density"))
    accepted = validated.where(F.col("rejected_by").isNull()).withColumn("n_trades", F.col("n_trades").cast("double"))
    return density.transform(beside, quantiles(accepted, [], "n_trades", {"median_trades": 0.5}))


def apply_stage(base: DataFrame, stages: DataFrame, stage: str = "stage") -> DataFrame:
    """B-16: gates of the current stage over the base gates; the trade floor never drops."""
    s = stages.select(
        F.col("stage").alias(stage), F.col("fdr_alpha").alias("_a"), F.col("dsr_min_prob").alias("_d"), F.col("min_trades").alias("_m")
    )
    return base.join(s, stage, "left").select(
        *[c for c in base.columns if c not in ("fdr_alpha", "dsr_min_prob", "min_trades")],
        F.coalesce("_a", "fdr_alpha").alias("fdr_alpha"),
        F.coalesce("_d", "dsr_min_prob").alias("dsr_min_prob"),
        F.greatest(F.col("min_trades"), F.coalesce("_m", F.lit(0))).alias("min_trades"),
    )


def escalate_stage(
    log: DataFrame, stages: Sequence[str], density_min: float, trades_min: float, patience: int, keys: Sequence[str] = ()
) -> DataFrame:
    """G-07: stage after every cycle.

    A stage is left after ``patience`` qualifying cycles; entering a stage already counts as one, so later stages
    need one fewer.  Only the running count of qualifying cycles is needed.
    """
    meets = (F.col("survivor_density") >= density_min) & (F.col("median_trades") >= trades_min)
    log = log.withColumn("meets", meets)
    log = running(log, keys, ["cycle"], F.floor(F.col("cycle") / 4096), _met=("sum", F.col("meets").cast("long")))
    later = 1 + F.floor((F.col("_met") - patience) / max(1, patience - 1))
    index = F.when(F.col("_met") < patience, F.lit(0)).otherwise(F.least(later, F.lit(len(stages) - 1))).cast("int")
    names = F.array(*(F.lit(s) for s in stages))
    return log.withColumn("stage", F.element_at(names, index + 1)).drop("_met")


def rejection_summary(validated: DataFrame, stage: str, keep: int = 25) -> DataFrame:
    """G-19: rejected rules per reason and stage, with up to ``keep`` ids."""
    rejected = validated.where(F.col("rejected_by").isNotNull()).select(
        F.concat(F.col("rejected_by"), F.lit(f"_stage_{stage}")).alias("reason"), "formula_id"
    )
    counts = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))
    sample = top_per_group(rejected, ["reason"], [F.asc("formula_id")], keep)
    ids = sample.groupBy("reason").agg(F.sort_array(F.collect_list("formula_id")).alias("sample_ids"))
    return counts.join(ids, "reason")


def dominant_rejection(summary: DataFrame, min_share: float = 0.7) -> DataFrame:
    """G-33: the most frequent reason and its share; flagged when it reaches ``min_share``."""
    return summary.agg(
        F.max_by("reason", F.struct("rejected", "reason")).alias("reason"),
        (F.max("rejected") / F.sum("rejected")).alias("share"),
    ).withColumn("dominant", F.col("share") >= min_share)


def _totals_of(evaluate):
    """The totals of ``robust_score`` from a function that gives trades."""
    from barloom.operators.validation import cum_min_drawdown

    def totals(rules: DataFrame) -> DataFrame:
        trades = cut_lineage(evaluate(rules))
        stats = trades.groupBy("formula_id").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("pnl").alias("mean"))
        return stats.join(cum_min_drawdown(trades), "formula_id")

    return totals


def robust_score(
    evaluate, rules: DataFrame, k: int = 64, delta: float = 0.15, seed: int = 7, mdd_multiple: float = 1.25, totals=None
) -> DataFrame:
    """G-20: share of perturbed variants that keep the sign of the mean and stay within a multiple of the drawdown.

    ``evaluate`` maps a table of rules to their trades; all variants of all rules are rows of one such table and are
    evaluated in one pass.  Variants without trades count against the rule; a rule without trades has score 0.
    ``totals``, where given, is used instead: it maps the table to ``formula_id, n_trades, mean, mdd`` and spares a
    row per trade of every variant.
    """
    made = cut_lineage(variants(rules, k, delta, seed))
    own = rules.select("formula_id", "formula_json")
    stats = cut_lineage((totals or _totals_of(evaluate))(own.union(made.select(F.col("variant_id").alias("formula_id"), "formula_json"))))
    base = stats.select("formula_id", F.col("mean").alias("base_mean"), F.col("mdd").alias("base_mdd"), "n_trades")
    probe = stats.select(F.col("formula_id").alias("variant_id"), "mean", "mdd")
    same_sign = (F.col("base_mean") >= 0) == (F.col("mean") >= 0)
    ok = F.coalesce(same_sign & (F.col("mdd") <= F.col("base_mdd") * mdd_multiple), F.lit(False))
    links = own.select("formula_id").distinct().join(made.select("formula_id", "variant_id"), "formula_id", "left")
    return (
        links.join(base, "formula_id", "left").join(probe, "variant_id", "left")
        .groupBy("formula_id")
        .agg(
            (F.count_if(ok) / F.lit(float(k))).alias("robust_score"), F.first("base_mean").alias("base_mean"),
            F.first("base_mdd").alias("base_mdd"), F.coalesce(F.first("n_trades"), F.lit(0)).alias("n_trades"),
        )
    )


def robust_gate(judged: DataFrame, scores: DataFrame, least: float = 0.55) -> DataFrame:
    """G-20 as the gate after validation: survivors below ``least`` are rejected as ``robust``.

    A survivor without a score was not probed and passes, as one does where there is nothing to probe it on.
    """
    probed = judged.join(scores.select("formula_id", "robust_score"), "formula_id", "left")
    fails = F.col("rejected_by").isNull() & F.coalesce(F.col("robust_score") < least, F.lit(False))
    return probed.withColumn("rejected_by", F.when(fails, "robust").otherwise(F.col("rejected_by")))


def feature_long(panel: DataFrame, features: Sequence[str], ids: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    return panel.select(*ids, *features).unpivot(list(ids), list(features), "feature", "value")


def feature_stats(
    long: DataFrame, min_ratio: float = 0.30, min_var: float = 1e-6, sample: int = 50,
    order: Sequence[str] = ("symbol", "ts"), reference_compat: bool = False,
) -> DataFrame:
    """G-22: share of values present, then variance and quantiles of a systematic sample, and the keep flag.

    The sample has fewer than ``2 * sample`` values per feature, so its quantiles are cheap.  ``reference_compat``
    takes the share after nulls are dropped, which makes it 1.
    """
    from barloom.operators.bars import systematic_sample

    presence = long.groupBy("feature").agg((F.count("value") / F.count(F.lit(1))).alias("non_null_ratio"))
    picked = systematic_sample(long, ["feature"], "value", list(order), sample)
    q = F.percentile("value", F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9))))
    s = picked.groupBy("feature").agg(
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"), F.min("value").alias("min"), q.alias("_q"), F.max("value").alias("max")
    )
    out = presence.join(s, "feature", "left")
    share = F.lit(1.0) if reference_compat else F.col("non_null_ratio")
    keep = F.coalesce((share >= min_ratio) & (F.col("variance") >= min_var), F.lit(False))
    return out.select(
        "feature", share.alias("non_null_ratio"), "variance", "min",
        *(F.col("_q")[i].alias(n) for i, n in enumerate(("q10", "q25", "median", "q75", "q90"))), "max", keep.alias("keep"),
    )


def feature_continuity(log: DataFrame, patience: int, threshold: float) -> DataFrame:
    """G-23: share of cycles a feature was active, and whether it is suppressed for low continuity."""
    ratio = F.avg(F.col("active").cast("double"))
    cycles = F.count(F.lit(1))
    return log.groupBy("feature").agg(
        cycles.alias("cycles"), ratio.alias("continuity"), ((cycles >= patience) & (ratio < threshold)).alias("suppress")
    )


def affected_formulas(formulas: DataFrame, suppressed: DataFrame, fraction: float, no: str = "formula_no") -> DataFrame:
    """G-24: rules that use a suppressed feature; the first share of them is flagged for replacement."""
    hit = formula_features(formulas, keep=[no]).join(suppressed.select("feature"), "feature", "left_semi").select(no).distinct()
    ranked = positions(hit, [], [no], F.floor(F.col(no) / 65536), "_pos")
    total = hit.agg(F.count(F.lit(1)).alias("_n"))
    limit = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)))
    return ranked.transform(beside, total).select(no, (F.col("_pos") <= limit).alias("replace"))


def top_survivors(survivors: DataFrame, k: int, order: str = "found_no", score: str = "sharpe", key: str = "alpha_id") -> DataFrame:
    """G-25: last record per id, then the k best by score."""
    rest = [c for c in survivors.columns if c != key]
    last = survivors.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    return last.orderBy(F.desc(F.coalesce(score, F.lit(0.0))), key).limit(k)


def exclude_existing(df: DataFrame, seen: DataFrame, key: str = "formula_id") -> DataFrame:
    """C-16: without rows whose key is already known."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def promote(
    survivors: DataFrame, active: DataFrame, min_trades: int, per_cycle: int, per_day: int, used_today: int,
    formula: str = "formula_json", tie: str = "alpha_id",
) -> DataFrame:
    """G-26: best new rules by Sortino within the caps; a rule already active, or a second copy, is skipped."""
    fresh = exclude_existing(survivors, active, formula).where(F.col("n_trades") >= min_trades)
    rest = [c for c in fresh.columns if c != formula]
    best = fresh.groupBy(formula).agg(F.max_by(F.struct(*rest), F.struct(F.col("sortino"), F.col(tie))).alias("_r"))
    room = max(0, min(per_cycle, per_day - used_today))
    return best.select(formula, "_r.*").orderBy(F.desc("sortino"), F.desc(tie)).limit(room)


def promotion_gate(
    df: DataFrame, min_trades: int = 0, min_sortino: float = 0.0, min_sharpe: float = 0.0, min_win_rate: float = 0.0,
    max_mdd: float = 1.0, buffer: float = 1.0,
) -> Column:
    """B-14: missing statistics count as 0, a missing drawdown as 1."""
    zero = F.lit(0.0)
    return (
        (F.coalesce("n_trades", F.lit(0)) >= min_trades)
        & (F.coalesce("sortino", zero) >= min_sortino * buffer)
        & (F.coalesce("sharpe", zero) >= min_sharpe * buffer)
        & (F.coalesce("win_rate", zero) >= min_win_rate)
        & (F.coalesce("mdd", F.lit(1.0)) <= max_mdd)
    )


def prune_stale(df: DataFrame, min_trades: int = 30) -> DataFrame:
    """G-37: without strategies that had their chance and have a negative Sharpe ratio."""
    return df.where(~((F.col("n_trades") >= min_trades) & (F.col("sharpe") < 0)))


def registry_hygiene(records: DataFrame, returns: DataFrame, gate: Column | None, max_trim: int = 5) -> DataFrame:
    """G-27: status of every record - duplicate, dropped by the gates, trimmed, or clean - and its kept returns.

    ``records`` has record_no, alpha_id, n_trades and statistics; ``returns`` is long (record_no, pos, ret), so
    zero padding is detected with one aggregate and no array is built.
    """
    first = records.groupBy("alpha_id").agg(F.min("record_no").alias("_first"))
    pad = returns.join(records.select("record_no", "n_trades"), "record_no").groupBy("record_no").agg(
        F.count(F.lit(1)).alias("n_returns"),
        F.count_if(F.col("pos") > F.col("n_trades")).alias("_extra"),
        F.count_if((F.col("pos") > F.col("n_trades")) & (F.coalesce("ret", F.lit(0.0)) != 0)).alias("_live"),
    )
    j = records.join(first, "alpha_id").join(pad, "record_no", "left")
    extra = F.coalesce("_extra", F.lit(0))
    trim = (F.col("n_trades") > 0) & (extra > 0) & (F.col("_live") == 0) & (extra <= max_trim)
    dup = F.col("record_no") != F.col("_first")
    ok = F.lit(True) if gate is None else gate
    status = F.when(dup, "duplicate").when(~ok, "gated").otherwise("kept")
    return j.select(
        *records.columns, status.alias("status"), (~dup & F.coalesce(trim, F.lit(False))).alias("trimmed"),
        (F.coalesce("n_returns", F.lit(0)) - F.when(F.coalesce(trim, F.lit(False)), extra).otherwise(0)).alias("kept_returns"),
    )


def hygiene_counters(status: DataFrame) -> DataFrame:
    """G-27: what a hygiene pass changed."""
    return status.agg(
        F.count_if(F.col("status") == "duplicate").alias("dupes_removed"), F.count_if("trimmed").alias("trimmed"),
        F.count_if(F.col("status") == "gated").alias("dropped_gates"), F.count_if(F.col("status") == "kept").alias("final"),
    )


def rank_population(
    df: DataFrame, weights: dict[str, float], penalty: float, elite: float = 0.10, formula: str = "formula_json"
) -> DataFrame:
    """G-29: weighted fitness less a penalty per tree node; exact rank and elite flag."""
    raw = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    scored = df.withColumn("fitness", raw).withColumn("penalised", F.col("fitness") - formula_complexity(formula) * penalty)
    ranked = exact_positions(scored, [], [F.desc("penalised"), F.asc(formula)], "rank")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(elite)))
    return ranked.transform(beside, total).withColumn("elite", F.col("rank") <= keep).drop("_n")


def stagnation_flags(log: DataFrame, window: int, delta: float, keys: Sequence[str] = (), best: str = "best_fitness") -> DataFrame:
    """G-30: best fitness not above its value window-1 cycles ago plus delta, once the window is full."""
    panel = blocked(log, keys, ["cycle"], F.floor(F.col("cycle") / 4096), back=window - 1)
    old = F.lag(best, window - 1).over(panel.w)
    return panel.with_columns({"stagnant": F.coalesce(F.col(best) <= old + delta, F.lit(False))}).home()


def feature_leaderboard(df: DataFrame, fitness: str, min_count: int, top: int) -> DataFrame:
    """G-31: features by average fitness of the rules that use them."""
    used = formula_features(df, keep=[fitness], strict=False)
    return (
        used.groupBy("feature").agg(F.count(F.lit(1)).alias("uses"), F.avg(fitness).alias("avg_fitness"))
        .where(F.col("uses") >= min_count)
        .orderBy(F.desc("avg_fitness"), "feature").limit(top)
    )


def seed_features(alphas: DataFrame, formula: str = "formula_json", score: str = "sortino", tie: str = "alpha_id") -> DataFrame:
    """G-34: distinct features of the top tenth of strategies."""
    ranked = exact_positions(alphas, [], [F.desc(score), F.asc(tie)], "_pos")
    total = alphas.agg(F.count(F.lit(1)).alias("_n"))
    top = ranked.transform(beside, total).where(F.col("_pos") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    return formula_features(top, formula, strict=True).distinct()


def history_union(logs: dict[str, DataFrame], seconds: str = "ts") -> DataFrame:
    """G-35: logs in one timeline, with their kind and a readable time."""
    parts = [d.withColumn("type", F.lit(kind)) for kind, d in logs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("time", F.timestamp_seconds(seconds).cast("timestamp_ntz")).orderBy(F.desc(seconds))


def fitness_penalties(
    summary: DataFrame, by_symbol: DataFrame, drawdown_scale: float = 0.40, concentration_scale: float = 0.25,
    variance_scale: float = 0.15,
) -> DataFrame:
    """G-33: Sharpe less penalties for drawdown, for result concentrated in one symbol, and for spread across symbols."""
    spread = by_symbol.groupBy("formula_id").agg(
        F.try_divide(F.max(F.abs(F.col("total"))), F.sum(F.abs(F.col("total")))).alias("concentration"),
        F.coalesce(F.var_samp("mean_ret"), F.lit(0.0)).alias("symbol_variance"),
    )
    j = summary.join(spread, "formula_id")
    cost = (
        F.col("mdd") * drawdown_scale + F.coalesce("concentration", F.lit(0.0)) * concentration_scale
        + F.col("symbol_variance") * variance_scale
    )
    return j.withColumn("fitness", F.col("sharpe") - cost)


def candidate_table(survivors: DataFrame, now, ttl_hours: int = 48) -> DataFrame:
    """B-19: survivors as candidates with an expiry time."""
    return survivors.withColumn("expires_at", F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(ttl_hours)))


def live_candidates(candidates: DataFrame, now) -> DataFrame:
    return candidates.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))


def survivor_report(df: DataFrame, formula: str = "formula_json") -> DataFrame:
    """B-18: display columns, best first; long rules are shortened."""
    text = F.when(F.length(formula) > 160, F.concat(F.substring(formula, 1, 157), F.lit("..."))).otherwise(F.col(formula))
    return df.select(
        F.substring("alpha_id", 1, 8).alias("id"), F.round(F.coalesce("sharpe", F.lit(0.0)), 6).alias("score"),
        F.coalesce("n_trades", F.lit(0)).alias("trades"), F.substring(text, 1, 120).alias("formula_preview"),
    ).orderBy(F.desc("score"), "id")


def alpha_report(df: DataFrame) -> DataFrame:
    """B-20: nested strategy records (performance map by regime) as a flat table."""
    p = F.try_element_at("performance", F.lit("all"))
    zero = F.lit(0.0)
    return df.select(
        F.substring("alpha_id", 1, 8).alias("id"), "lane", F.try_element_at("universe", F.lit(1)).alias("symbol"),
        F.coalesce(p["n_trades"], F.lit(0)).alias("trades"), F.coalesce(p["sharpe"], zero).alias("sharpe"),
        F.coalesce(p["sortino"], zero).alias("sortino"), F.coalesce(p["win_rate"], zero).alias("win_rate"), F.coalesce(p["mdd"], zero).alias("mdd"),
    )
