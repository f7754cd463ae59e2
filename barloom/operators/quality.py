"""Gap, repeat and fill rules for bar series (D-03 ... D-08).

Neighbouring bars are found slot by slot (see ``ordered``), so one long series is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import OHLCV, numeric, tf_seconds
from barloom.operators.bars import bar_slot
from barloom.operators.ordered import epoch_us, neighbour, running
from barloom.sources.lake import dedupe_bars, require_columns

_OHLC = OHLCV[:4]


def _ms(c: str):
    return F.floor(epoch_us(c) / 1000)


def validate_bars(df: DataFrame, keys: Sequence[str], timeframe: str, max_gap_pct: float | None = None) -> DataFrame:
    """D-03: one report row per series.

    Non-numeric rows are dropped, repeats counted, gaps counted where two bars are more than 1.5 bar lengths apart
    (series of more than three bars only).  A gap ratio within ``max_gap_pct`` clears the degraded flag.
    """
    require_columns(df)
    ok = F.col("ts").isNotNull()
    for c in OHLCV:
        ok = ok & numeric(c).isNotNull()
    tagged = df.select(*keys, "ts", ok.alias("_ok"))
    stamps = tagged.groupBy(*keys, "ts").agg(
        F.count_if("_ok").alias("_good"), F.count_if(~F.col("_ok")).alias("_bad")
    )
    bad = stamps.groupBy(*keys).agg(F.sum("_bad").alias("dropped"))
    good = stamps.where(F.col("_good") > 0).drop("_bad")
    seen = neighbour(good, keys, ["ts"], bar_slot("ts", timeframe), {"_prev": "ts"})
    gap = (_ms("ts") - _ms("_prev") > int(tf_seconds(timeframe) * 1500)).cast("long")
    counts = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum("_good") - F.count(F.lit(1))).alias("dupes"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("_gaps"),
    )
    gaps = F.when(F.col("rows") > 3, F.col("_gaps")).otherwise(0)
    out = bad.join(counts, list(keys), "left").select(
        *keys,
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "dropped",
        F.coalesce("dupes", F.lit(0)).alias("dupes"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
    )
    gap_ratio = F.when(F.col("gaps") > 0, F.col("gaps") / F.greatest(F.lit(1), F.col("rows") + F.col("gaps") - 1))
    out = out.withColumn("gap_ratio", F.coalesce(gap_ratio, F.lit(0.0)))
    degraded = (F.col("dropped") > 0) | (F.col("gaps") > 0)
    if max_gap_pct is not None:
        degraded = degraded & ~((F.col("gaps") > 0) & (F.col("gap_ratio") <= max_gap_pct))
    return out.withColumn("degraded", degraded)


def find_gaps(df: DataFrame, keys: Sequence[str], timeframe: str) -> DataFrame:
    """D-04: spans between neighbouring bars more than 1.5 bar lengths apart, with the bars missing inside."""
    tf_ms = tf_seconds(timeframe) * 1000
    seen = neighbour(df.select(*keys, "ts").distinct(), keys, ["ts"], bar_slot("ts", timeframe), {"gap_start": "ts"})
    width = _ms("ts") - _ms("gap_start")
    return seen.where(width > int(tf_ms * 1.5)).select(
        *keys,
        "gap_start",
        F.col("ts").alias("gap_end"),
        (F.floor(width / tf_ms) - 1).cast("long").alias("missing_bars"),
    )


def apply_repairs(bars: DataFrame, repairs: DataFrame, keys: Sequence[str], timeframe: str) -> DataFrame:
    """D-05: add late rows that lie strictly inside a gap, then dedupe; stored bars win.

    Each repair row looks up the stored bar before and after it (an as-of scan over the union of both tables), so
    no gap/repair pairs are formed.
    """
    tf_us = tf_seconds(timeframe) * 1_000_000
    slot = bar_slot("ts", timeframe)
    stored = dedupe_bars(bars, keys).withColumn("_stored", F.lit(1))
    late = dedupe_bars(repairs, keys).select(*[c for c in stored.columns if c in repairs.columns]).withColumn("_stored", F.lit(0))
    both = stored.unionByName(late, allowMissingColumns=True).withColumns(
        {"_bar_ts": F.when(F.col("_stored") == 1, F.col("ts")), "_rev": -epoch_us("ts"), "_after_first": 1 - F.col("_stored")}
    )
    both = running(both, keys, ["ts", "_after_first"], slot, _before=("last", "_bar_ts"))
    both = running(both, keys, ["_rev", "_after_first"], -slot, _after=("last", "_bar_ts"))
    us, lo, hi = epoch_us("ts"), epoch_us("_before"), epoch_us("_after")
    fills = (F.floor((hi - lo) / 1000) > int(tf_us * 1.5) // 1000) & (us >= lo + tf_us) & (us <= hi - tf_us)
    kept = both.where((F.col("_stored") == 1) | F.coalesce(fills, F.lit(False)))
    return kept.withColumn("repaired", F.col("_stored") == 0).select(*bars.columns, "repaired")


def flat_fill(df: DataFrame, keys: Sequence[str], timeframe: str, max_fill: int) -> DataFrame:
    """D-06: complete the grid with flat zero-volume bars unless a series would need more than ``max_fill`` of them.

    Missing bars are generated from the gap that holds them, never from one whole-series sequence; rows off the
    series' grid are left out of filled series.
    """
    tf_us = tf_seconds(timeframe) * 1_000_000
    base = dedupe_bars(df, keys).select(*keys, "ts", *OHLCV)
    span = base.groupBy(*keys).agg(F.min("ts").alias("_start"))
    gridded = base.join(span, list(keys)).withColumn(
        "_on", F.pmod(epoch_us("ts") - epoch_us("_start"), F.lit(tf_us)) == 0
    ).drop("_start")
    on_grid = gridded.where("_on").drop("_on")
    prev = neighbour(on_grid, keys, ["ts"], bar_slot("ts", timeframe), {"_pts": "ts", **{f"_p{c}": c for c in _OHLC}})
    gaps = prev.withColumn("_miss", (epoch_us("ts") - epoch_us("_pts")) / tf_us - 1).where(F.col("_miss") >= 1)
    totals = gaps.groupBy(*keys).agg((F.sum("_miss") > max_fill).alias("_abort"))
    fillable = gaps.join(totals, list(keys)).where(~F.col("_abort"))
    step = F.lit(tf_us)
    filled = fillable.select(
        *keys,
        F.explode(F.sequence(epoch_us("_pts") + step, epoch_us("ts") - step, step)).alias("_us"),
        *(F.col(f"_p{c}").alias(c) for c in _OHLC),
    ).select(
        *keys, F.timestamp_micros("_us").cast("timestamp_ntz").alias("ts"), *_OHLC, F.lit(0.0).alias("volume")
    )
    kept = gridded.join(totals, list(keys), "left").where(F.col("_on") | F.coalesce("_abort", F.lit(False)))
    return kept.select(*keys, "ts", *OHLCV).unionByName(filled).withColumn(
        "synthetic_zero_volume", F.col("volume") == 0
    )


def coverage_report(df: DataFrame, keys: Sequence[str], timeframe: str, since) -> DataFrame:
    """D-08: expected bars from ``since`` to the end of the newest bar against bars present, and gaps."""
    tf_us = tf_seconds(timeframe) * 1_000_000
    report = validate_bars(df, keys, timeframe)
    last = df.groupBy(*keys).agg(F.max("ts").alias("_last"))
    span = epoch_us("_last") + tf_us - epoch_us(F.lit(since).cast("timestamp_ntz"))
    expected = F.greatest(F.lit(1), F.ceil(span / tf_us)).cast("long")
    return report.join(last, list(keys)).select(
        *keys,
        expected.alias("expected"),
        F.col("rows").alias("actual"),
        F.round(F.col("rows") / expected, 4).alias("coverage"),
        "gaps",
        F.round("gap_ratio", 4).alias("gap_ratio"),
        (~F.col("degraded")).alias("accepted"),
    )
