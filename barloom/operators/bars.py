"""Cleaning, auditing, sampling and resampling of bars (B-01 ... B-03, B-08 ... B-11, B-15, D-01, D-02)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import OHLCV, TIMEFRAME_MS, ceil_to, floor_to, md5_u32, numeric, tf_seconds
from barloom.operators.ordered import beside, epoch_us, exact_positions, time_slot
from barloom.operators.selection import top_per_group
from barloom.sources.lake import dedupe_bars, keep_first

SLOT_BARS = 1 << 16


def bar_slot(ts: str | Column, timeframe: str, bars: int = SLOT_BARS) -> Column:
    """Time slot that holds at most ``bars`` distinct grid bars of one series."""
    return time_slot(ts, tf_seconds(timeframe) * bars)


def clean_bars(df: DataFrame, columns: Sequence[str] = OHLCV) -> DataFrame:
    """B-01: numeric columns, infinities and NaN to NULL, rows with a missing price or volume dropped."""
    return df.withColumns({c: numeric(c) for c in columns}).dropna(subset=list(columns))


def drop_open_bar(df: DataFrame, keys: Sequence[str], timeframe: str, now) -> DataFrame:
    """B-02: without the newest bar of a series when it is not closed at ``now`` and not the only one."""
    last = df.groupBy(*keys).agg(F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_rows"))
    age = epoch_us(F.lit(now).cast("timestamp_ntz")) - epoch_us("ts")
    still_open = (F.col("ts") == F.col("_last")) & (F.col("_rows") > 1) & (age < tf_seconds(timeframe) * 1_000_000)
    return df.join(last, list(keys)).where(~still_open).drop("_last", "_rows")


def alignment_audit(df: DataFrame, keys: Sequence[str], timeframe: str, now, rows: int = 5000) -> DataFrame:
    """B-03: grid check of the newest ``rows`` distinct bars per series.

    The rank filter is pushed below the shuffle as a group limit, so a long series sends at most ``rows`` bars per
    task.
    """
    dur = tf_seconds(timeframe)
    stamps = df.select(*keys, "ts").distinct()
    newest = stamps.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    ).where(F.col("_r") <= rows)
    off = F.pmod(F.floor(epoch_us("ts") / 1_000_000), F.lit(dur)) != 0
    age = F.floor(epoch_us(F.lit(now).cast("timestamp_ntz")) / 1_000_000) - F.floor(epoch_us(F.max("ts")) / 1_000_000)
    return newest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.max("ts").alias("last_bar"),
        age.alias("last_bar_age_s"),
        (age < dur).alias("open_bar_flag"),
        F.coalesce(F.sum(off.cast("long")), F.lit(0)).alias("misaligned"),
        F.array_join(F.slice(F.sort_array(F.collect_list(F.when(off, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))), 1, 5), ", ").alias("examples"),
    )


def bars_in_days(timeframe: str, days: int) -> int:
    """Bars of ``days`` days, by whole bars per day."""
    return days * (86_400_000 // TIMEFRAME_MS[timeframe])


def tail_bars(df: DataFrame, keys: Sequence[str], timeframe: str, n: int) -> DataFrame:
    """B-08: the newest ``n`` bars of every series; every task passes on its newest ``n`` of a series at most."""
    return top_per_group(df, keys, [F.desc("ts")], n, "_from_end").drop("_from_end")


def filter_universe(df: DataFrame, symbol: str | None = None, suffix: str | None = None) -> DataFrame:
    """B-09: one symbol, or all symbols with a suffix such as ``_USD_SPOT``."""
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    if suffix is not None:
        df = df.where(F.col("symbol").endswith(suffix))
    return df


def sample_panel(df: DataFrame, k: int, seed: int) -> DataFrame:
    """B-10: k symbols drawn by a hash of symbol and seed."""
    draw = md5_u32(F.concat_ws("|", F.lit(str(seed)), "symbol"))
    picked = df.select("symbol").distinct().orderBy(draw, "symbol").limit(k)
    return df.join(picked, "symbol", "left_semi")


def systematic_sample(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], k: int = 50
) -> DataFrame:
    """B-11: every (n div k)-th non-null value per key, starting with the first."""
    ranked = exact_positions(df.where(F.col(value).isNotNull()), keys, order, "_pos")
    n = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(n, list(keys)) if keys else ranked.transform(beside, n)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return joined.where(F.pmod(F.col("_pos") - 1, step) == 0).drop("_n", "_pos")


def tail_window(df: DataFrame, cutoff, hours: int) -> DataFrame:
    """B-15: bars of the last ``hours`` hours up to a cutoff; a range predicate the scan can use."""
    end = F.lit(cutoff).cast("timestamp_ntz")
    return df.where((F.col("ts") >= end - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("ts") <= end))


def resample_bars(
    df: DataFrame, keys: Sequence[str], to: str, closed: str = "right", label: str = "right", flag: bool = True
) -> DataFrame:
    """D-01: coarser bars - first open, highest high, lowest low, last close, summed volume.

    Only one grouped aggregate with map-side combining; bins are arithmetic on the timestamp.
    """
    width = tf_seconds(to)
    end = ceil_to("ts", width) if closed == "right" else floor_to("ts", width) + F.make_dt_interval(secs=F.lit(width))
    edge = end if label == "right" else end - F.make_dt_interval(secs=F.lit(width))
    out = df.groupBy(*keys, edge.alias("_bin")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts"))).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"),
        F.sum("volume").alias("volume"),
    )
    out = out.dropna(subset=["open", "high", "low", "close"]).withColumnRenamed("_bin", "ts")
    out = out.select(*keys, "ts", *OHLCV)
    return out.withColumn("is_synthetic", F.lit(True)) if flag else out


def merge_native(native: DataFrame, synthetic: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-02: union of native and resampled bars; a native bar wins over a synthetic one of the same time."""
    native = native.withColumn("is_synthetic", F.lit(False)) if "is_synthetic" not in native.columns else native
    both = native.unionByName(synthetic, allowMissingColumns=True)
    return keep_first(both, [*keys, "ts"], ["is_synthetic", *OHLCV])


def improvement(native: DataFrame, merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-02: bars gained per series by merging, and whether the series improved."""
    before = native.groupBy(*keys).agg(F.count(F.lit(1)).alias("native_rows"))
    after = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("merged_rows"))
    native_rows = F.coalesce(F.col("native_rows"), F.lit(0))
    return after.join(before, list(keys), "left").select(
        *keys,
        native_rows.alias("native_rows"),
        "merged_rows",
        (F.col("merged_rows") > native_rows).alias("improved"),
    )
