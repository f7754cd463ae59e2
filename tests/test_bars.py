import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as ob
from barloom.operators import quality as oq
from barloom.plans.flows import accept_bars
from barloom.session import work_dir
from barloom.sources import lake
from tests.conftest import bars_frame

K = ["symbol"]


def hours(spark, keep, symbol="A"):
    return bars_frame(spark, [(60 * h, 100 + h) for h in keep], symbol)


def test_gap_rules(spark):
    clean = oq.validate_bars(hours(spark, range(10)), K, "1h", 0.05).first()
    assert (clean["rows"], clean["gaps"], clean["degraded"]) == (10, 0, False)
    holed = hours(spark, [0, 1, 2, 5, 6, 7, 8, 9])
    r = oq.validate_bars(holed, K, "1h", 0.05).first()
    assert (r["gaps"], r["degraded"]) == (1, True) and r["gap_ratio"] == pytest.approx(1 / 8)
    assert oq.validate_bars(holed, K, "1h", 0.2).first()["degraded"] is False
    assert oq.validate_bars(hours(spark, [0, 5, 9]), K, "1h").first()["gaps"] == 0
    twice = oq.validate_bars(holed.unionByName(holed), K, "1h", 0.2).first()
    assert (twice["rows"], twice["dupes"]) == (8, 8)


def test_non_numeric_rows_degrade(spark):
    df = hours(spark, range(6)).withColumn("close", F.when(F.hour("ts") == 3, F.lit(float("nan"))).otherwise(F.col("close")))
    r = oq.validate_bars(df, K, "1h").first()
    assert (r["dropped"], r["rows"], r["degraded"]) == (1, 5, True)


def test_missing_column_fails(spark):
    with pytest.raises(ValueError, match="volume"):
        oq.validate_bars(hours(spark, range(3)).drop("volume"), K, "1h")


def test_flat_fill_and_abort(spark):
    df = hours(spark, [0, 1, 4])
    got = {r["ts"].hour: r for r in oq.flat_fill(df, K, "1h", 2).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[3]["close"] == 101.0 and got[3]["synthetic_zero_volume"]
    assert oq.flat_fill(df, K, "1h", 1).count() == 3


def test_repairs_only_inside_gaps(spark):
    late = bars_frame(spark, [(60, 1.0), (120, 2.0), (150, 2.5), (180, 3.0), (240, 4.0), (600, 9.0)])
    got = {r["ts"]: r for r in oq.apply_repairs(hours(spark, [0, 1, 4, 5]), late, K, "1h").collect()}
    added = sorted(t.hour * 60 + t.minute for t, r in got.items() if r["repaired"])
    assert added == [120, 150, 180] and len(got) == 7


def test_right_closed_bins(spark):
    df = bars_frame(spark, [(0, 1.0), (15, 2.0), (60, 3.0), (61, 4.0)])
    got = {r["ts"].hour: r for r in ob.resample_bars(df, K, "1h").collect()}
    assert sorted(got) == [0, 1, 2]
    assert (got[1]["open"], got[1]["close"], got[1]["volume"]) == (2.0, 3.0, 2.0)


def test_open_bar_goes_unless_alone(spark):
    now = "2024-01-01 03:30:00"
    assert ob.drop_open_bar(hours(spark, range(4)), K, "1h", now).count() == 3
    assert ob.drop_open_bar(hours(spark, [3]), K, "1h", now).count() == 1
    assert ob.drop_open_bar(hours(spark, range(3)), K, "1h", now).count() == 3


def test_lake_merges_instead_of_replacing(spark):
    path = work_dir(spark, "lake")
    tag = lambda d: d.withColumns({"venue": F.lit("v"), "timeframe": F.lit("1h")})
    lake.write_bars(tag(hours(spark, range(0, 5))), path)
    tails = lake.write_bars(tag(hours(spark, range(3, 8)).withColumn("close", F.lit(1.0))), path)
    got = {r["ts"].hour: r["close"] for r in lake.read_bars(spark, path, "v", "1h").collect()}
    assert sorted(got) == list(range(8)) and got[2] == 102.0 and got[4] == 1.0
    assert tails.first()["last_ts"] == dt.datetime(2024, 1, 1, 7)


def test_lake_writes_only_add_and_compaction_keeps_the_newest(spark):
    path = work_dir(spark, "lake")
    tag = lambda d: d.withColumns({"venue": F.lit("v"), "timeframe": F.lit("1h")})
    files = lambda: {r.file for r in lake.lake_files(spark, path).collect()}
    read = lambda: sorted((r["symbol"], r["ts"], r["close"]) for r in lake.read_bars(spark, path).collect())
    lake.write_bars(tag(hours(spark, range(0, 60))), path)
    before = files()
    for k in range(3):
        lake.write_bars(tag(hours(spark, range(10 * k, 10 * k + 20)).withColumn("close", F.lit(1000.0 + k))), path)
    again = tag(hours(spark, range(20, 40)).withColumn("close", F.lit(1002.0)))
    lake.write_bars(again, path)  # a batch that is replayed
    assert before < files()
    want = read()
    assert len(want) == 60 and [c for _, t, c in want if t.day == 1 and t.hour == 15] == [1001.0]
    old = lake.compact(spark, path)
    assert read() == want  # old and new files side by side
    assert lake.drop_files(old) >= 5 and read() == want
    assert spark.read.parquet(path).count() == 60 and len(files()) == 1
    assert lake.compact(spark, path).collect() == [] and read() == want


def test_partition_filters_reach_the_scan(spark):
    path = work_dir(spark, "lake")
    lake.write_bars(hours(spark, range(3)).withColumns({"venue": F.lit("v"), "timeframe": F.lit("1h")}), path)
    plan = lake.read_bars(spark, path, "v", "1h", ["A"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(venue" in plan and "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,A)]" in plan


def test_accept_bars_ladder(spark):
    """good: clean; filled: cleared by flat bars; mended: gap within the cap, repaired; bad: beyond the cap."""
    good = hours(spark, range(20), "good")
    filled = hours(spark, [h for h in range(20) if h not in (4, 9)], "filled")
    mended = hours(spark, [h for h in range(20) if h != 7], "mended")
    bad = hours(spark, range(0, 40, 2), "bad")
    late = bars_frame(spark, [(7 * 60, 5.0)], "mended")
    bars, report = accept_bars(good.unionByName(filled).unionByName(mended).unionByName(bad), late, K, "1h", 0.101, 5)
    got = {r["symbol"]: r for r in report.collect()}
    assert {s for s, r in got.items() if r["accepted"]} == {"good", "filled", "mended"}
    assert got["mended"]["gaps"] == 0 and got["mended"]["repaired"] and got["filled"]["filled"] and not got["bad"]["filled"]
    n = {r["symbol"]: r["n"] for r in bars.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert n == {"good": 20, "filled": 20, "mended": 20}
