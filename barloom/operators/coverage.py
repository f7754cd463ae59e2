"""Coverage records, gates and backfill decisions (A-11, A-12, D-09 ... D-16).

All of it is grouped aggregation over counts; raw bars are only ever counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import BARS_PER_DAY, TIMEFRAME_MS
from barloom.operators.ordered import beside, order_statistic

KEY = ("venue", "timeframe", "symbol")


def parse_double_json(df: DataFrame, schema: str, key: str = "key", payload: str = "payload") -> DataFrame:
    """A-11: split ``venue:timeframe:symbol`` keys and read payloads that may be JSON text inside JSON text.

    Anything that is not an object in the end is dropped.
    """
    inner = F.get_json_object(F.concat(F.lit('{"x":'), F.col(payload), F.lit("}")), "$.x")
    parts = F.split(F.col(key), ":", 3)
    meta = F.from_json(F.when(F.ltrim(inner).startswith("{"), inner), schema)
    return (
        df.where(F.size(parts) == 3)
        .select(parts[0].alias("venue"), parts[1].alias("timeframe"), parts[2].alias("symbol"), meta.alias("_m"))
        .where(F.col("_m").isNotNull())
        .select(*KEY, "_m.*")
    )


def parse_requests(df: DataFrame, item: str = "item") -> DataFrame:
    """A-12: distinct non-empty ``canonical`` of queue items, JSON objects or single-quoted literals."""
    literal = F.regexp_extract(F.col(item), r"'canonical'\s*:\s*'([^']*)'", 1)
    name = F.coalesce(F.get_json_object(item, "$.canonical"), F.nullif(literal, F.lit("")))
    return df.select(name.alias("symbol")).where(F.length(F.trim("symbol")) > 0).distinct()


def bar_counts(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def reindex_coverage(counts: DataFrame, recorded: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """D-09: where more rows exist than recorded, replace the record by a complete one."""
    j = recorded.join(counts, list(keys), "full_outer")
    newer = F.coalesce(F.col("rows"), F.lit(0)) > F.coalesce(F.col("actual"), F.lit(0))
    return j.select(
        *keys,
        F.when(newer, F.col("rows")).otherwise(F.col("expected")).alias("expected"),
        F.when(newer, F.col("rows")).otherwise(F.col("actual")).alias("actual"),
        F.when(newer, F.lit(1.0)).otherwise(F.col("coverage")).alias("coverage"),
        newer.alias("reindexed"),
    )


def best_coverage(recorded: DataFrame, bars: DataFrame, order: Sequence[str] = ("venue",)) -> DataFrame:
    """D-10: per symbol the record with most bars over the venues (first in ``order`` on a tie) and total rows."""
    rest = [c for c in recorded.columns if c not in ("symbol", *order)]
    best = recorded.groupBy("symbol").agg(F.max("actual").alias("_top"))
    tied = recorded.join(best, "symbol").where(F.col("actual").eqNullSafe(F.col("_top")))
    chosen = tied.groupBy("symbol").agg(F.min(F.struct(*order, *rest)).alias("_r")).select("symbol", "_r.*")
    totals = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_rows"))
    effective = F.greatest(F.coalesce("actual", F.lit(0)), F.coalesce("total_rows", F.lit(0)))
    return chosen.join(totals, "symbol", "left").select(
        "symbol", *order, *rest, F.coalesce("total_rows", F.lit(0)).alias("total_rows"), effective.alias("bars")
    )


def target_bars(timeframe: str, floor: int, days: int = 0) -> int:
    """Bars a symbol needs: the floor, or the bars of ``days`` days when more."""
    return max(floor, days * BARS_PER_DAY.get(timeframe, 0) if days else floor)


def coverage_gate(best: DataFrame, min_coverage: float, target: int, min_symbols: int, quorum: float = 0.75) -> DataFrame:
    """D-11 / D-12: one row - who is eligible, whether research may start, and the spread of bar counts."""
    enough = F.col("bars") >= target
    g = best.agg(
        F.count(F.lit(1)).alias("symbols_seen"),
        F.count_if((F.col("coverage") >= min_coverage) & enough).alias("symbols_eligible"),
        F.count_if(enough).alias("symbols_at_target"),
        F.min("bars").alias("bars_min"),
        F.max("bars").alias("bars_max"),
    )
    median = order_statistic(best, [], "bars", lambda n: F.floor(n / 2), "bars_median")
    by_quorum = (F.col("symbols_seen") >= min_symbols) & (
        F.coalesce(F.try_divide("symbols_at_target", "symbols_seen"), F.lit(0.0)) >= quorum
    )
    return g.transform(beside, median).select(
        "symbols_seen",
        "symbols_eligible",
        "symbols_at_target",
        "bars_min",
        "bars_median",
        "bars_max",
        by_quorum.alias("by_quorum"),
        (by_quorum | (F.col("symbols_eligible") >= min_symbols)).alias("gate_ok"),
        F.coalesce(F.col("bars_min") < target * 0.5, F.lit(False)).alias("underfilled"),
    )


def select_timeframe(bars: DataFrame, prefer: Sequence[str], min_bars: int, min_panel: int) -> DataFrame:
    """D-13: the first preferred timeframe in which enough symbols have enough bars."""
    rank = F.array_position(F.array(*(F.lit(p) for p in prefer)), F.col("timeframe"))
    per_tf = (
        bars.groupBy("timeframe", "symbol")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_bars)
        .groupBy("timeframe")
        .agg(F.count(F.lit(1)).alias("eligible"))
        .where((F.col("eligible") >= min_panel) & (rank > 0))
    )
    return per_tf.agg(F.min_by("timeframe", rank).alias("timeframe"), F.min_by("eligible", rank).alias("eligible"))


def accept_ratio(attempts: DataFrame, advance_at: float = 0.7) -> DataFrame:
    """D-14: share of accepted series per timeframe, and whether its backfill stage may advance."""
    ratio = F.avg(F.col("accepted").cast("double"))
    return attempts.groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("accepted").alias("accepted"),
        ratio.alias("accept_ratio"),
        (ratio >= advance_at).alias("advance"),
    )


def backfill_progress(counts: DataFrame, targets: dict[str, int], min_symbols: int) -> DataFrame:
    """D-15: symbols at target per timeframe, and whether every timeframe has enough of them."""
    goal = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    at = F.col("rows") >= F.try_element_at(goal, F.col("timeframe"))
    per_symbol = counts.where(F.col("timeframe").isin(list(targets))).groupBy("timeframe", "symbol").agg(
        F.max("rows").alias("rows")
    )
    per_tf = per_symbol.groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(at).alias("symbols_at_target"), F.min("rows").alias("rows_min"),
        F.max("rows").alias("rows_max"),
    ).withColumn("met", F.col("symbols_at_target") >= min_symbols)
    all_met = per_tf.agg((F.count_if("met") == len(targets)).alias("all_met"))
    return per_tf.transform(beside, all_met)


def backfill_start(counts: DataFrame, timeframe: str, target_days: int, min_coverage: float, now) -> DataFrame:
    """D-16: rewind a shallow series to the start of its target horizon when its checkpoint is clearly later.

    ``counts`` has one row per series with its stored ``rows`` and checkpoint ``last_ts``.
    """
    expected = target_days * 86_400_000 // TIMEFRAME_MS[timeframe]
    deep = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(target_days))
    slack = F.make_dt_interval(secs=F.lit(TIMEFRAME_MS[timeframe] // 1000 * 10))
    ratio = F.col("rows") / F.lit(float(expected))
    rewind = F.col("last_ts").isNull() | ((ratio < min_coverage) & (deep < F.col("last_ts") - slack))
    return counts.select(
        *[c for c in counts.columns if c not in ("rows", "last_ts")],
        ratio.alias("depth_ratio"),
        F.coalesce(rewind, F.lit(False)).alias("rewound"),
        F.when(rewind, deep).otherwise(F.col("last_ts")).alias("since"),
    )
