"""Block layout against plain windows, with one key that holds most rows and blocks far smaller than it."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import ordered as o


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 'hot' has 70 % of the rows; times are irregular; values repeat."""
    h = F.xxhash64("id")
    return (
        spark.range(3000)
        .select(
            "id",
            F.when(F.pmod(h, F.lit(10)) < 7, "hot").otherwise(F.concat(F.lit("k"), F.pmod(h, F.lit(5)))).alias("key"),
            F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * F.col("id") * 900_000).cast("timestamp_ntz").alias("ts"),
            (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(97)) / 10.0 - 4.0).alias("x"),
        )
        .cache()
    )


W = lambda: Window.partitionBy("key").orderBy("ts")


def test_positions(skewed):
    got = o.positions(skewed, ["key"], ["ts"], o.time_slot("ts", 3600))
    assert got.count() == 3000
    assert got.withColumn("want", F.row_number().over(W())).where("want <> pos").isEmpty()


def test_positions_in_ranges_of_the_data(spark):
    """Half of all rows tie and the others lie within one percent; one key holds most rows, one is null."""
    rows = [(i, "hot" if i % 10 else None if i % 20 else "few", 1.0 if i % 2 else 1.0 + i % 97 / 9700) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, key string, x double").repartition(8)
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in ([], ["key"]):
            order = [F.desc("x"), F.asc("id")]
            placed = o.ranged(df, keys, order)
            sizes = [r["count"] for r in placed.groupBy(o.RANGE).count().collect()]
            assert len(sizes) == 8 and max(sizes) < 2 * 6000 / 8
            got = o.exact_positions(df, keys, order)
            want = got.withColumn("want", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            assert got.count() == 6000 and want.where("want <> pos").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)
    assert o.exact_positions(df.limit(0), ["key"], ["id"]).count() == 0


@pytest.mark.parametrize("rows", [7, 64, 100000])
def test_blocked_windows(skewed, rows):
    panel = o.blocked(skewed, ["key"], ["ts"], o.time_slot("ts", 3600), back=30, ahead=2, block_rows=rows)
    got = panel.with_columns(
        {"a": F.avg("x").over(panel.rows(30)), "b": F.lag("x", 30).over(panel.w), "c": F.lead("x", 2).over(panel.w)}
    ).home()
    want = got.withColumns(
        {"a2": F.avg("x").over(W().rowsBetween(-29, 0)), "b2": F.lag("x", 30).over(W()), "c2": F.lead("x", 2).over(W())}
    )
    assert got.count() == 3000
    assert want.where("abs(a - a2) > 1e-12 or not (b <=> b2) or not (c <=> c2)").isEmpty()


def test_running(skewed):
    nullable = skewed.withColumn("y", F.when(F.col("x") > 2, F.col("x")))
    got = o.running(
        nullable, ["key"], ["ts"], o.time_slot("ts", 7200), s=("sum", "x"), n=("count", "y"), lo=("min", "x"), hi=("max", "y"), l=("last", "y")
    )
    w = W().rowsBetween(Window.unboundedPreceding, 0)
    want = got.withColumns(
        {"s2": F.sum("x").over(w), "n2": F.count("y").over(w), "lo2": F.min("x").over(w), "hi2": F.max("y").over(w), "l2": F.last("y", True).over(w)}
    )
    bad = "abs(s - s2) > 1e-9 or n <> n2 or lo <> lo2 or not (hi <=> hi2) or not (l <=> l2)"
    assert want.where(bad).isEmpty()


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(skewed, ahead):
    got = o.neighbour(skewed, ["key"], ["ts"], o.time_slot("ts", 600), {"near": "x"}, ahead)
    want = got.withColumn("want", (F.lead if ahead else F.lag)("x").over(W()))
    assert want.where("not (near <=> want)").isEmpty()


@pytest.mark.parametrize("span", [1, 2, 9, 400])
def test_running_ema(skewed, span):
    ranked = o.positions(skewed, ["key"], ["ts"], o.time_slot("ts", 3600))
    got = o.running_ema(ranked, ["key"], "pos", {"y": ("x", 2 / (span + 1))}, block_rows=3).toPandas().sort_values(["key", "ts"])
    want = got.groupby("key")["x"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
    assert len(got) == 3000 and (got["y"] - want).abs().max() < 1e-10


def test_quantiles(skewed):
    got = o.quantiles(skewed, ["key"], "x", {"a": 0.1, "m": 0.5, "z": 0.99}).toPandas().set_index("key")
    want = skewed.toPandas().groupby("key")["x"].quantile([0.1, 0.5, 0.99]).unstack()
    for name, q in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
        pd.testing.assert_series_equal(got[name].sort_index(), want[q].sort_index(), check_names=False)


def test_upper_median(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 1.0, 3.0, 3.0)], "v double")
    assert o.order_statistic(df, [], "v", lambda n: F.floor(n / 2), "m").first()["m"] == 3.0


def test_large_side_is_shuffled_once(spark, small):
    """Even without broadcasting, the rows themselves cross the network once; only slot totals move besides."""
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in saved:
            spark.conf.set(k, "-1")
        ev = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts", "value")
        got = o.positions(ev, ["user_id"], ["ts"], o.time_slot("ts", 86400))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    carrying = [line for line in plan.splitlines() if "FileScan parquet" in line and "value" in line.split("Batched")[0]]
    assert len(carrying) == 1 and plan.count("Exchange hashpartitioning") == 4
