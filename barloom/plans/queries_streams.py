"""Streaming queries, run over everything available and read back from their sinks (family K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import floor_to, rounded
from barloom.plans.oracle_views import with_views
from barloom.plans.queries_bars import R_BARS, price_columns
from barloom.plans.registry import query
from barloom.session import work_dir
from barloom.sources import lake, views
from barloom.streaming import streams as ss

SYM = ["symbol"]


def events(spark, folder):
    schema = views.table(spark, folder, "events").schema
    return ss.read_stream(spark, folder, schema, "events.parquet")


def scattered_events(spark, folder, files: int = 4):
    """The events as a stream of files whose times overlap."""
    path = work_dir(spark, "events")
    table = views.table(spark, folder, "events")
    table.repartition(files, "event_id").write.parquet(path)
    return ss.read_stream(spark, path, table.schema)


def tick_bars(ev):
    """Each event as a one-tick bar at its own time."""
    v = F.col("value")
    return ev.select(
        F.col("event_type").alias("symbol"), "ts", v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), v.alias("volume"), "event_id"
    )


@query("K01_stream_bars", with_views("", "SELECT symbol, ts, " + R_BARS + " FROM b", b="SELECT event_type AS symbol, ts, first(value ORDER BY value NULLS FIRST) AS open, open AS high, open AS low, open AS close, 1.0::DOUBLE AS volume FROM events GROUP BY ALL"))
def _(spark, folder):
    """The lake keeps one bar of a symbol and time: of one write the smallest in value."""
    path = work_dir(spark, "lake")
    bars = tick_bars(events(spark, folder)).select(
        F.lit("v0").alias("venue"), F.lit("tick").alias("timeframe"), "symbol", "ts", "open", "high", "low", "close", F.lit(1.0).alias("volume")
    )
    ss.stream_bars(bars, path)
    return lake.read_bars(spark, path).select("symbol", "ts", *price_columns())


@query("K02_stream_dedupe", "SELECT DISTINCT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS ts FROM events")
def _(spark, folder):
    rows = events(spark, folder).select(F.col("event_type").alias("symbol"), floor_to("ts", 3600).alias("ts"))
    return ss.run_to_files(ss.stream_dedupe(rows, ["symbol", "ts"], "60 days"), work_dir(spark, "dedupe"))


RS = (
    "SELECT event_type AS symbol, CASE WHEN epoch_us(ts) % 3600000000 = 0 THEN ts ELSE time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' END AS ts, "
    "arg_min(value, e.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, e.ts) AS close, sum(value) AS volume FROM events e GROUP BY event_type, 2"
)


@query("K03_stream_resample", with_views("", f"SELECT symbol, ts, {R_BARS} FROM rs WHERE ts <= (SELECT date_trunc('millisecond', max(ts) - INTERVAL '1 microsecond') - INTERVAL '1 hour' FROM events)", rs=RS))
def _(spark, folder):
    out = ss.stream_resample(tick_bars(events(spark, folder)), SYM, "1h", "1 hour")
    return ss.run_to_files(out, work_dir(spark, "resample")).select("symbol", "ts", *price_columns())


@query("K09_stream_closed_bars", with_views("bars_1h", f"SELECT symbol, ts, {R_BARS} FROM bars_1h WHERE ts + INTERVAL '1 hour' <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '10 minutes' FROM events)"))
def _(spark, folder):
    out = ss.stream_closed_bars(tick_bars(events(spark, folder)), SYM, "1h", "10 minutes")
    return ss.run_to_files(out, work_dir(spark, "closed")).select("symbol", "ts", *price_columns())


@query(
    "K04_stream_repairs",
    with_views(
        "bars_venue",
        "SELECT symbol, ts, round(close,6) AS close FROM late s WHERE EXISTS (SELECT 1 FROM g WHERE s.symbol=g.symbol AND s.ts >= g.a + INTERVAL '1 hour' AND s.ts <= g.b - INTERVAL '1 hour')",
        base="SELECT * FROM bars_venue WHERE venue='v0'",
        late="SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS ts, min(value) AS close FROM events WHERE user_id % 2 = 1 GROUP BY 1,2",
        g="SELECT * FROM (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS a, ts AS b FROM base) WHERE epoch(b)-epoch(a) > 5400",
    ),
)
def _(spark, folder):
    stored = lambda: views.bars_venue(spark, folder).where(F.col("venue") == "v0").drop("venue")
    late = tick_bars(events(spark, folder).where(F.col("user_id") % 2 == 1)).withColumn("ts", floor_to("ts", 3600)).drop("event_id")
    sink = work_dir(spark, "repairs")
    ss.stream_repairs(late, stored, SYM, "1h", sink)
    return spark.read.parquet(sink).select("symbol", "ts", rounded("close").alias("close"))


SUPPRESS = (
    "SELECT k, n, event_id, us < 0 AS suppressed, CASE WHEN missed THEN 1 ELSE 0 END::BIGINT AS misses, 0::BIGINT AS until FROM num WHERE n = 1 UNION ALL "
    "SELECT s.k, s.n, s.event_id, s.us < e.until, CASE WHEN s.us < e.until THEN e.misses WHEN NOT s.missed THEN 0 WHEN e.misses + 1 >= 3 THEN 0 ELSE e.misses + 1 END, "
    "CASE WHEN s.us >= e.until AND s.missed AND e.misses + 1 >= 3 THEN s.us + 21600000000 ELSE e.until END FROM st e JOIN num s ON s.k = e.k AND s.n = e.n + 1"
)


@query(
    "K05_stream_suppress",
    with_views(
        "", "SELECT split_part(k,'/',1) AS venue, split_part(k,'/',2) AS symbol, event_id, suppressed, misses FROM st",
        num="SELECT 'v' || (user_id % 2) || '/' || event_type AS k, event_id, epoch_us(ts) AS us, value < 60 AS missed, row_number() OVER (PARTITION BY user_id % 2, event_type ORDER BY ts) AS n FROM events",
        st=SUPPRESS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, folder):
    a = scattered_events(spark, folder).select(
        F.concat(F.lit("v"), F.col("user_id") % 2).alias("venue"), F.col("event_type").alias("symbol"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (F.col("value") < 60).alias("missed"),
    )
    return ss.stream_suppress(a, work_dir(spark, "suppress"), 3, 21_600)


@query("K06_stream_counters", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1")
def _(spark, folder):
    rows = events(spark, folder).select(F.col("event_type").alias("symbol"))
    return ss.stream_counters(rows, SYM, work_dir(spark, "counters"))


@query(
    "K08_stream_ema",
    with_views(
        "", "SELECT num.symbol, us, round(y,6) AS ema FROM ema JOIN num USING (symbol, n)",
        num="SELECT event_type AS symbol, epoch_us(ts) AS us, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events",
        ema="SELECT symbol, n, x AS y FROM num WHERE n = 1 UNION ALL SELECT s.symbol, s.n, s.x*0.2::DOUBLE + e.y*0.8::DOUBLE FROM ema e JOIN num s ON s.symbol=e.symbol AND s.n=e.n+1",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, folder):
    v = scattered_events(spark, folder).select(F.col("event_type").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("x"))
    return ss.stream_ema(v, 0.2, work_dir(spark, "ema")).withColumn("ema", rounded("ema"))
