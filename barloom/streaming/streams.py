"""Structured Streaming forms of the incremental operators (K-01 ... K-09).

Sources are append-only bar or event files.  Keyed state is Spark's own, or a small table of the last two batches.
Event time is a timestamp column; late rows are dropped behind the watermark or, for repairs, merged by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barloom.functions.scalars import OHLCV, tf_seconds
from barloom.operators.ordered import positions, running_ema
from barloom.operators.quality import apply_repairs
from barloom.session import work_dir
from barloom.sources.lake import write_bars

def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """File source with a fixed schema; new files are picked up by the next trigger."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def run_to_files(df: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Process everything available, append to parquet, return the files as a batch table."""
    checkpoint = checkpoint or work_dir(df.sparkSession, "ckpt")
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> None:
    """Process everything available, handing each micro-batch to ``fn``."""
    checkpoint = checkpoint or work_dir(df.sparkSession, "ckpt")
    query = (
        df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_bars(bars: DataFrame, lake: str, checkpoint: str | None = None) -> None:
    """K-01: land arriving bars in the lake.

    Progress is the stream checkpoint.  A batch writes its own rows and nothing else; a replayed one writes them again,
    which readers do not notice because bars are keyed by series and time.  Months are compacted apart from the stream.
    """
    run_batches(bars, lambda batch, _: write_bars(batch, lake), checkpoint)


def with_event_time(df: DataFrame, delay: str, ts: str = "ts", name: str = "event_time", shift_us: int = 0) -> DataFrame:
    """Zoned event-time column with a watermark; ``shift_us`` moves right-closed bins into place."""
    t = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(shift_us))
    return df.withColumn(name, t).withWatermark(name, delay)


def stream_dedupe(df: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """K-02: drop re-delivered rows that arrive within the delay; state is dropped behind the watermark."""
    return with_event_time(df, delay).dropDuplicatesWithinWatermark(list(keys)).drop("event_time")


def stream_resample(df: DataFrame, keys: Sequence[str], to: str, delay: str) -> DataFrame:
    """K-03: right-closed coarser bars, emitted once their window is behind the watermark."""
    timed = with_event_time(df, delay, shift_us=1)
    out = timed.groupBy(*keys, F.window("event_time", f"{tf_seconds(to)} seconds").alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )
    return out.select(*keys, F.col("_w.end").cast("timestamp_ntz").alias("ts"), *OHLCV)


def stream_closed_bars(df: DataFrame, keys: Sequence[str], to: str, delay: str) -> DataFrame:
    """K-09: left-labelled bars from finer rows; an open bar is never emitted because its window is still live."""
    timed = with_event_time(df, delay)
    out = timed.groupBy(*keys, F.window("event_time", f"{tf_seconds(to)} seconds").alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )
    return out.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("ts"), *OHLCV)


def stream_repairs(late: DataFrame, stored: Callable[[], DataFrame], keys: Sequence[str], timeframe: str, sink: str, checkpoint: str | None = None) -> None:
    """K-04: late rows fill gaps of stored bars.

    ``stored`` re-reads the stored bars for every batch; only rows that fall strictly inside a gap are kept, one
    output folder per batch id, so a replayed batch overwrites its own result.
    """

    def fill(batch: DataFrame, batch_id: int) -> None:
        fixed = apply_repairs(stored(), batch, keys, timeframe).where("repaired").drop("repaired")
        fixed.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={batch_id}")

    run_batches(late, fill, checkpoint)


def stream_counters(df: DataFrame, keys: Sequence[str], sink: str, checkpoint: str | None = None) -> DataFrame:
    """K-06: running counts per key in update mode; readers take the newest update of a key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/id={batch_id}")

    run_batches(counts, save, checkpoint, mode="update")
    updates = df.sparkSession.read.parquet(sink)
    return updates.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def _forget(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _stored(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before saved; a replayed batch finds the same again."""
    return spark.read.parquet(f"{path}/batch={batch_id - 1}") if batch_id else None


#: Microseconds (some 70 years) added to event times before they become watermarks, which start at zero and drop what is
#: not above it; times from 1900 to 2190 can be counted.
FORWARD_US = 2_208_988_801_000_000


class _Misses(StatefulProcessor):
    """Misses in a row per key: attempts wait until the watermark has passed them and are then counted in event order."""

    def __init__(self, threshold: int, ttl_us: int):
        self.threshold, self.ttl_us = threshold, ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "misses long, until long")
        self.waiting = handle.getListState("waiting", "us long, event_id long, missed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(us), int(e), bool(m)) for frame in rows for us, e, m in frame[["us", "event_id", "missed"]].itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer((max(us for us, _, _ in new) + FORWARD_US) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999 - FORWARD_US
        held = sorted(tuple(r) for r in self.waiting.get())
        ready, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        misses, until = tuple(self.count.get()) if self.count.exists() else (0, 0)
        out = []
        for us, event_id, missed in ready:
            suppressed = us < until
            if not suppressed:
                misses = misses + 1 if missed else 0
                if misses >= self.threshold:
                    misses, until = 0, us + self.ttl_us
            out.append((*key, event_id, suppressed, misses))
        # a key without misses whose suppression is over is as good as new
        if misses == 0 and until <= passed:
            self.count.clear()
        else:
            self.count.update((misses, until))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["venue", "symbol", "event_id", "suppressed", "misses"])

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state in RocksDB, as ``transformWithState`` needs it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def stream_suppress(
    attempts: DataFrame, sink: str, threshold: int = 3, ttl_seconds: int = 21_600, checkpoint: str | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """K-05: per attempt, whether its (venue, symbol) was suppressed and the misses counted after it.

    A success clears the counter; at ``threshold`` misses in a row the pair is suppressed for the TTL.
    ``attempts`` has venue, symbol, us (event time), event_id, missed.  Attempts wait in Spark's keyed state until the
    watermark has passed them, so files may overlap in time in any way within a batch, and across batches by ``delay``
    (what is not above the watermark of the batches before is dropped).  State is two numbers and the waiting attempts of a pair, and is cleared
    when a pair has no misses left and its suppression is over.
    """
    fields = "venue string, symbol string, event_id long, suppressed boolean, misses long"
    timed = attempts.withColumn("event_time", F.timestamp_micros(F.col("us") + FORWARD_US)).withWatermark("event_time", delay)
    counted = timed.groupBy("venue", "symbol").transformWithStateInPandas(
        statefulProcessor=_Misses(threshold, ttl_seconds * 1_000_000), outputStructType=fields, outputMode="Append", timeMode="EventTime"
    )
    with _rocks(attempts.sparkSession):
        return run_to_files(counted, sink, checkpoint)


def stream_ema(values: DataFrame, alpha: float, sink: str, checkpoint: str | None = None, slot_seconds: int = 86_400) -> DataFrame:
    """K-08: recursive average per symbol, carried across batches as one number per symbol.

    ``values`` has symbol, us (event time), x.  Each micro-batch is put in event order by exact positions and averaged
    in runs, so files may overlap in time in any way and no symbol is one task; batches follow each other.
    """
    start = -(1 << 62)

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("symbol", "us", "x")
        held = _stored(batch.sparkSession, f"{sink}/carry", batch_id)
        if held is not None:
            rows = rows.unionByName(held.select("symbol", F.lit(start).cast("long").alias("us"), F.col("ema").alias("x")))
        slot = F.floor(F.col("us") / F.lit(slot_seconds * 1_000_000)).cast("long")
        done = running_ema(positions(rows, ["symbol"], ["us", "x"], slot), ["symbol"], "pos", {"ema": ("x", alpha)})
        done.select("symbol", "us", "pos", "ema").write.mode("overwrite").parquet(f"{sink}/all/batch={batch_id}")
        done = batch.sparkSession.read.parquet(f"{sink}/all/batch={batch_id}")
        done.groupBy("symbol").agg(F.max_by("ema", "pos").alias("ema")).write.mode("overwrite").parquet(f"{sink}/carry/batch={batch_id}")
        # a replay needs what the batch before carried, and nothing older
        _forget(batch.sparkSession, f"{sink}/carry/batch={batch_id - 2}")

    run_batches(values, save, checkpoint)
    read = values.sparkSession.read.schema("symbol string, us long, pos long, ema double").parquet(f"{sink}/all")
    return read.where(F.col("us") > start).select("symbol", "us", "ema")
