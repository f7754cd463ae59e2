"""Keyed streams: files that overlap in time within a batch, and state carried over batches."""

import random

from pyspark.sql import functions as F

from barloom.session import work_dir
from barloom.streaming import streams as ss


def _events(spark, n=24_000):
    rng = random.Random(8)
    rows = [("v", "a" if i % 10 else "b", 1_000_000 * i, i, rng.random() < 0.6, rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "venue string, symbol string, us long, event_id long, missed boolean, x double")


def _plain(rows, threshold, ttl, alpha):
    state, ema, flags, averages = {}, {}, {}, {}
    for venue, symbol, us, event_id, missed, x in rows:
        misses, until = state.get(symbol, (0, 0))
        quiet = us < until
        if not quiet:
            misses = misses + 1 if missed else 0
            if misses >= threshold:
                misses, until = 0, us + ttl * 1_000_000
        state[symbol] = (misses, until)
        flags[event_id] = (quiet, misses)
        ema[symbol] = x if symbol not in ema else alpha * x + (1 - alpha) * ema[symbol]
        averages[us] = ema[symbol]
    return flags, averages


def test_event_order_within_and_across_batches(spark):
    rows, frame = _events(spark)
    flags, averages = _plain(rows, 3, 25, 0.2)
    scattered, cut = work_dir(spark, "one"), work_dir(spark, "two")
    frame.repartition(4, "event_id").write.parquet(scattered)
    for part in range(2):  # two batches in time order, each of overlapping files
        frame.where((F.col("event_id") >= 12_000) == bool(part)).repartition(3, "event_id").write.mode("append").parquet(cut)
    for folder, files in ((scattered, None), (cut, 3)):
        stream = ss.read_stream(spark, folder, frame.schema, files_per_batch=files)
        got = ss.stream_suppress(stream, work_dir(spark, "suppress"), 3, 25).collect()
        assert {r.event_id: (r.suppressed, r.misses) for r in got} == flags
        got = ss.stream_ema(stream.select("symbol", "us", "x"), 0.2, work_dir(spark, "ema")).collect()
        assert len(got) == len(rows) and all(abs(r.ema - averages[r.us]) < 1e-9 for r in got)
