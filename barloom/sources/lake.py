"""Bar lake: parquet partitioned by venue, timeframe, year and month (A-01 ... A-05, A-13, A-15, A-16)."""

from __future__ import annotations

import time
from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import OHLCV, tf_seconds
from barloom.session import stored

KEY = ("venue", "timeframe", "symbol")
PARTITIONS = ("venue", "timeframe", "year", "month")
BAR_COLUMNS = ("ts", *OHLCV)
#: When a row was written, microseconds: of rows of one key the newest counts.
WRITTEN = "written_us"


def require_columns(df: DataFrame, columns: Collection[str] = BAR_COLUMNS) -> DataFrame:
    """A-16: fail before any work when a required column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """I-06: one row per key, the smallest in ``order``; combines before the shuffle, so a hot key is cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def dedupe_bars(df: DataFrame, keys: Sequence[str], order: Sequence[str] = OHLCV) -> DataFrame:
    """One bar per (keys, ts)."""
    return keep_first(df, [*keys, "ts"], [c for c in order if c in df.columns])


def _listing(df: DataFrame, months: int) -> list[tuple]:
    """Newest ``months`` (year, month) partitions per key, from the columns of the path and the symbol alone."""
    parts = df.select(*KEY, "year", "month").distinct()
    w = Window.partitionBy(*KEY).orderBy(F.desc("year"), F.desc("month"))
    return parts.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= months)


def read_bars(
    spark: SparkSession,
    path: str,
    venue: str | None = None,
    timeframe: str | None = None,
    symbols: Collection[str] | None = None,
    limit_months: int | None = None,
) -> DataFrame:
    """A-01 / A-02: deduplicated bars, with venue and timeframe as partition filters.

    ``limit_months`` keeps the newest months of every series: a first pass over path columns and the symbol column
    finds the oldest month any series needs (one literal, so older folders are never opened), a semi-join then
    trims each series to its own months.
    """
    df = spark.read.parquet(path)
    if venue is not None:
        df = df.where(F.col("venue") == venue)
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if limit_months is not None:
        wanted = _listing(df, limit_months)
        oldest = wanted.agg(F.min(F.col("year") * 100 + F.col("month"))).first()[0]
        df = df.where(F.col("year") * 100 + F.col("month") >= F.lit(oldest or 0))
        df = df.join(wanted, [*KEY, "year", "month"], "left_semi")
    return newest_bars(df).drop("year", "month")


def available_symbols(spark: SparkSession, path: str, timeframe: str | None = None, venue: str | None = None) -> DataFrame:
    """A-03: distinct symbols with data, sorted."""
    df = spark.read.parquet(path)
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe)
    if venue is not None:
        df = df.where(F.col("venue") == venue)
    return df.select("symbol").distinct().orderBy("symbol")


def newest_bars(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One bar per (keys, ts): the one written last; among bars of one write the smallest in value."""
    if WRITTEN not in df.columns:
        return dedupe_bars(df, keys)
    aged = df.withColumn("_age", -F.col(WRITTEN))
    return keep_first(aged, [*keys, "ts"], ["_age", *OHLCV]).drop("_age", WRITTEN)


def _append(rows: DataFrame, path: str) -> None:
    """Add files of the size Spark is advised to write, sorted so that their statistics prune on symbol and time."""
    laid = rows.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "symbol", "ts")
    laid.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def write_bars(df: DataFrame, path: str) -> DataFrame:
    """A-04: merge bars into the lake and return the newest bar per series written.

    A write adds files with its own rows only, each with the time of the write; a stored bar with the same key is
    replaced because readers take the newest.  No stored file is read or touched, so whoever reads meanwhile sees a bar
    as it was or as it is, and never a month half replaced; a write that is repeated changes nothing for them.
    """
    spark, now = df.sparkSession, time.time_ns() // 1000
    require_columns(df, (*KEY, *BAR_COLUMNS))
    fresh = df.select(*KEY, *BAR_COLUMNS, *[c for c in df.columns if c == "is_synthetic"])
    unique = keep_first(fresh, [*KEY, "ts"], list(OHLCV))
    _append(unique.withColumns({"year": F.year("ts"), "month": F.month("ts"), WRITTEN: F.lit(now)}), path)
    return bar_tails(spark.read.parquet(path).where(F.col(WRITTEN) == now))


def lake_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of the lake with their month and size."""
    rows = spark.read.parquet(path).select(*PARTITIONS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy(*PARTITIONS, "file").agg(F.max("bytes").alias("bytes"))


def compact(spark: SparkSession, path: str, target_bytes: int = 128 << 20) -> DataFrame:
    """A-04: rewrite months that have more files than their bytes call for; gives the files that are no longer needed.

    The new files hold the newest bar of every key with the time it was written, so readers may see old and new files
    together.  The old ones can go (:func:`drop_files`) once no reader that started before is left.  Rows that arrive
    while months are rewritten are in files of their own and stay.
    """
    files = stored(lake_files(spark, path), "files")
    months = files.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    months = months.where(F.col("n") > F.ceil(F.col("bytes") / F.lit(target_bytes))).select(*PARTITIONS)
    rows = spark.read.parquet(path).join(months, list(PARTITIONS), "left_semi")
    kept = keep_first(rows.withColumn("_age", -F.col(WRITTEN)), [*KEY, "ts"], ["_age", *OHLCV]).drop("_age")
    _append(kept, path)
    return files.join(months, list(PARTITIONS), "left_semi").select("file")


def drop_files(files: DataFrame) -> int:
    """Delete files by path; returns their number."""
    spark, n = files.sparkSession, 0
    for row in files.toLocalIterator():
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row.file))
        n += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False))
    return n


def bar_tails(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """A-15: newest bar per series; reads keys and time only."""
    return df.groupBy(*keys).agg(F.max("ts").alias("last_ts"))


def partition_quality(df: DataFrame, timeframe: str, keys: Sequence[str] = KEY) -> DataFrame:
    """A-05: rows, repeats, gaps and newest bar per series and month.

    Repeats collapse in the (key, ts) aggregate; gaps need the previous bar of the same month, found by a window
    whose group is one series-month: at most a month of grid bars.
    """
    grouped = df.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"year": F.year("ts"), "month": F.month("ts")}
    )
    w = Window.partitionBy(*keys, "year", "month").orderBy("ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    step = us - F.lag(us).over(w)
    return (
        grouped.withColumn("_gap", (step > tf_seconds(timeframe) * 1_500_000).cast("long"))
        .groupBy(*keys, "year", "month")
        .agg(
            F.sum("_n").alias("rows"),
            (F.sum("_n") - F.count(F.lit(1))).alias("dupes"),
            F.coalesce(F.sum("_gap"), F.lit(0)).alias("gaps"),
            F.max("ts").alias("last_ts"),
        )
    )


def expired_partitions(partitions: DataFrame, retention_days: dict[str, int], now) -> DataFrame:
    """A-13: month partitions whose first day is before the cutoff of their timeframe."""
    policy = F.create_map(*(F.lit(x) for kv in retention_days.items() for x in kv))
    days = F.try_element_at(policy, F.col("timeframe"))
    first = F.make_timestamp_ntz(F.col("year"), F.col("month"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return partitions.where(days.isNotNull() & (first < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days)))
