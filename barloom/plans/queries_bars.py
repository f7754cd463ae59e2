"""Queries over the bar lake, bar quality and coverage (families A, B, D, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import formula as fm
from barloom.functions.scalars import rounded
from barloom.operators import bars as ob
from barloom.operators import coverage as oc
from barloom.operators import quality as oq
from barloom.operators.ordered import time_slot
from barloom.plans.oracle_views import with_views
from barloom.plans.registry import query
from barloom.session import work_dir
from barloom.sources import lake, snapshots, views

NOW = "2024-01-30 23:30:00"
SINCE = "2024-01-01 00:00:00"
SYM = ["symbol"]
VS = ["venue", "symbol"]
PRICES = ("open", "high", "low", "close")


def price_columns(*names):
    return [rounded(n).alias(n) for n in names or (*PRICES, "volume")]


R_BARS = ", ".join(f"round({c}, 6) AS {c}" for c in (*PRICES, "volume"))
GAP_S = "5400"  # 1.5 hours


def lake_bars(spark, folder):
    """Hourly venue bars plus six-hour bars resampled from them."""
    hourly = views.bars_venue(spark, folder).withColumn("timeframe", F.lit("1h"))
    coarse = ob.resample_bars(hourly, VS, "6h", "left", "left", flag=False).withColumn("timeframe", F.lit("6h"))
    return hourly.unionByName(coarse)


SIX = (
    "SELECT venue, symbol, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open, "
    "max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars_venue GROUP BY 1,2,3"
)
LAKE = {
    "six": SIX,
    "lake": "SELECT *, '1h' AS timeframe FROM bars_venue UNION ALL BY NAME SELECT *, '6h' AS timeframe FROM six",
}


def stored_lake(spark, folder):
    """Write the lake twice (the second write overlaps the first) and return its path."""
    path = work_dir(spark, "lake")
    bars = lake_bars(spark, folder)
    lake.write_bars(bars.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")), path)
    lake.write_bars(bars.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")), path)
    return path


@query("A01_read_bars", with_views("bars_venue", f"SELECT symbol, ts, {R_BARS} FROM lake WHERE venue='v0' AND timeframe='1h'", **LAKE))
def _(spark, folder):
    got = lake.read_bars(spark, stored_lake(spark, folder), venue="v0", timeframe="1h")
    return got.select("symbol", "ts", *price_columns())


@query("A02_newest_months", with_views("bars_user", f"SELECT symbol, ts, {R_BARS} FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY year(ts) DESC, month(ts) DESC) AS r FROM b) WHERE r <= 2", b="SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1,2"))
def _(spark, folder):
    o = views.table(spark, folder, "orders")
    bars = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    path = work_dir(spark, "lake")
    lake.write_bars(bars.withColumns({"venue": F.lit("v0"), "timeframe": F.lit("1d")}), path)
    got = lake.read_bars(spark, path, venue="v0", timeframe="1d", limit_months=2)
    return got.select("symbol", "ts", *price_columns())


@query("A03_available_symbols", with_views("venue_ticks", "SELECT DISTINCT symbol FROM venue_ticks WHERE venue='v1'"))
def _(spark, folder):
    return lake.available_symbols(spark, stored_lake(spark, folder), "1h", "v1")


@query("A04_write_bars", with_views("bars_venue", "SELECT venue, timeframe, symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM lake GROUP BY ALL", **LAKE))
def _(spark, folder):
    return _lake_counts(lake.read_bars(spark, stored_lake(spark, folder)))


def _lake_counts(got):
    return got.groupBy("venue", "timeframe", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("A04_compact", with_views("bars_venue", "SELECT venue, timeframe, symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM lake GROUP BY ALL", **LAKE))
def _(spark, folder):
    """The files themselves, after months of several writes were rewritten and what they replace is gone."""
    path = stored_lake(spark, folder)
    lake.drop_files(lake.compact(spark, path))
    return _lake_counts(spark.read.parquet(path))


@query(
    "A05_partition_quality",
    with_views(
        "hour_rows",
        "SELECT symbol, year(ts) AS year, month(ts) AS month, sum(n)::BIGINT AS rows, (sum(n)-count(*))::BIGINT AS dupes, "
        f"coalesce(sum(CASE WHEN epoch(ts)-epoch(p) > {GAP_S} THEN 1 ELSE 0 END),0)::BIGINT AS gaps, max(ts) AS last_ts FROM "
        "(SELECT *, lag(ts) OVER (PARTITION BY symbol, year(ts), month(ts) ORDER BY ts) AS p FROM "
        "(SELECT symbol, ts, count(*) AS n FROM hour_rows GROUP BY 1,2)) GROUP BY 1,2,3",
    ),
)
def _(spark, folder):
    return lake.partition_quality(views.hour_rows(spark, folder), "1h", SYM)


@query(
    "A06_normalize_ohlcv",
    "SELECT event_type AS symbol, time_bucket(INTERVAL '1 millisecond', ts, TIMESTAMP '1970-01-01') AS ts, value AS open, value AS high, value AS low, value AS close, "
    "CASE WHEN user_id % 5 = 1 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS volume FROM events WHERE user_id % 5 NOT IN (2, 3)",
)
def _(spark, folder):
    ev = views.table(spark, folder, "events")
    v = F.col("value").cast("string")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string")
    kind = F.col("user_id") % 5
    raw = (
        F.when(kind == 1, F.array(ms, v, v, v, v))
        .when(kind == 2, F.array(ms, v, v))
        .when(kind == 3, F.array(ms, v, F.lit("n/a"), v, v, F.lit("1.5")))
        .otherwise(F.array(ms, v, v, v, v, F.lit("1.5")))
    )
    return snapshots.normalize_ohlcv(ev.select(F.col("event_type").alias("symbol"), raw.alias("row")), "row", ["symbol"])


@query("A07_write_snapshot", "SELECT count(*) AS rows, count(DISTINCT event_type) AS symbols, (min(epoch_us(ts))//1000000)::BIGINT AS first_ts FROM events")
def _(spark, folder):
    path = work_dir(spark, "snap")
    snapshots.write_snapshot(_snapshot_rows(spark, folder), path)
    got = snapshots.read_snapshots(spark, path)
    return got.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("ts").alias("first_ts")
    )


def _snapshot_rows(spark, folder):
    """One row per instrument and snapshot time (hour)."""
    return views.table(spark, folder, "events").select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts"),
        F.concat(F.lit("v"), F.col("user_id") % 2).alias("venue"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
        F.col("event_id").alias("rank"),
    )


@query("A08_read_snapshots", "SELECT (epoch_us(ts)//1000000)::BIGINT AS ts, 'v' || (user_id % 2) AS venue, event_type AS symbol, value AS price, event_id AS rank FROM events")
def _(spark, folder):
    path = work_dir(spark, "snap")
    snapshots.write_snapshot(_snapshot_rows(spark, folder), path)
    return snapshots.read_snapshots(spark, path)


@query("A09_latest_snapshot", "SELECT 'v' || (user_id % 2) AS venue, event_type AS symbol, (epoch_us(ts)//1000000)::BIGINT AS ts, value AS price, event_id AS rank FROM events QUALIFY row_number() OVER (PARTITION BY 'v' || (user_id % 2) ORDER BY (epoch_us(ts)//1000000) DESC, event_id DESC) = 1")
def _(spark, folder):
    return snapshots.latest_snapshot(_snapshot_rows(spark, folder), ["venue"], ["ts", "rank"])


@query("A10_snapshot_alphas", with_views("alpha_stats", "SELECT lane, count(*) AS alphas, sum(n_trades)::BIGINT AS trades FROM alpha_stats GROUP BY lane"))
def _(spark, folder):
    path = snapshots.snapshot_alphas(views.alpha_stats(spark, folder), work_dir(spark, "registry"), NOW)
    got = spark.read.json(path)
    return got.groupBy("lane").agg(F.count(F.lit(1)).alias("alphas"), F.sum("n_trades").alias("trades"))


@query("A11_parse_double_json", with_views("coverage", "SELECT venue, timeframe, symbol, expected, actual, coverage FROM coverage"))
def _(spark, folder):
    return oc.parse_double_json(views.coverage_json(spark, folder), "expected long, actual long, coverage double")


@query("A12_parse_requests", "SELECT DISTINCT upper(p_brand) || '_USD_SPOT' AS symbol FROM part WHERE p_size % 4 <> 3")
def _(spark, folder):
    name = F.concat(F.upper("p_brand"), F.lit("_USD_SPOT"))
    k = F.col("p_size") % 4
    item = (
        F.when(k == 0, F.to_json(F.struct(name.alias("canonical"))))
        .when(k == 1, F.concat(F.lit("{'canonical': '"), name, F.lit("', 'prio': 1}")))
        .when(k == 2, F.to_json(F.struct(F.lit(1).alias("n"), name.alias("canonical"))))
        .otherwise(F.lit('{"canonical": ""}'))
    )
    return oc.parse_requests(views.table(spark, folder, "part").select(item.alias("item")))


@query("A13_expired_partitions", "SELECT DISTINCT o_orderpriority AS symbol, CASE WHEN o_orderstatus='F' THEN '1h' ELSE '1d' END AS timeframe, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders WHERE make_date(year(o_orderdate), month(o_orderdate), 1) < TIMESTAMP '2001-06-15 12:00:00' - (CASE WHEN o_orderstatus='F' THEN INTERVAL 365 DAY ELSE INTERVAL 1825 DAY END)")
def _(spark, folder):
    tf = F.when(F.col("o_orderstatus") == "F", "1h").otherwise("1d")
    parts = views.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"), tf.alias("timeframe"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
    ).distinct()
    return lake.expired_partitions(parts, {"1h": 365, "1d": 1825}, "2001-06-15 12:00:00")


@query("A14_equity_curve", with_views("equity", "SELECT ts, sum(pnl_cents) OVER (ORDER BY ts)::BIGINT AS equity_cents FROM equity"))
def _(spark, folder):
    return snapshots.equity_curve(views.equity(spark, folder), "pnl_cents", "equity_cents")


@query("A15_bar_tails", with_views("bars_venue", "SELECT venue, timeframe, symbol, max(ts) AS last_ts FROM lake GROUP BY ALL", **LAKE))
def _(spark, folder):
    return lake.bar_tails(lake_bars(spark, folder))


@query("A16_require_columns", with_views("bars_1h", "SELECT symbol, count(*) AS rows FROM bars_1h GROUP BY 1"))
def _(spark, folder):
    return lake.require_columns(views.bars_1h(spark, folder)).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "B01_clean_bars",
    "SELECT event_type AS symbol, ts, value AS open, value AS high, value AS low, value AS close, 1.0::DOUBLE AS volume FROM events WHERE user_id % 7 NOT IN (3, 4, 5)",
)
def _(spark, folder):
    ev = views.table(spark, folder, "events")
    k = F.col("user_id") % 7
    v = F.col("value").cast("string")
    close = F.when(k == 3, "bad").when(k == 4, "Infinity").when(k == 5, "NaN").otherwise(v)
    raw = ev.select(F.col("event_type").alias("symbol"), "ts", v.alias("open"), v.alias("high"), v.alias("low"), close.alias("close"), F.lit("1").alias("volume"))
    return ob.clean_bars(raw)


@query(
    "B02_drop_open_bar",
    with_views("bars_1h", f"SELECT symbol, ts, round(close,6) AS close FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS l, count(*) OVER (PARTITION BY symbol) AS n FROM bars_1h) WHERE NOT (ts = l AND n > 1 AND epoch(TIMESTAMP '{NOW}') - epoch(ts) < 3600)"),
)
def _(spark, folder):
    return ob.drop_open_bar(views.bars_1h(spark, folder), SYM, "1h", NOW).select("symbol", "ts", rounded("close").alias("close"))


@query(
    "B03_alignment_audit",
    with_views(
        "user_ticks",
        "SELECT symbol, count(*) AS rows_checked, max(ts) AS last_bar, (epoch_us(TIMESTAMP '2024-01-30 23:30:00')//1000000 - epoch_us(max(ts))//1000000)::BIGINT AS last_bar_age_s, "
        "(epoch_us(TIMESTAMP '2024-01-30 23:30:00')//1000000 - epoch_us(max(ts))//1000000) < 3600 AS open_bar_flag, count(*) FILTER (WHERE off) AS misaligned, "
        "coalesce(array_to_string(list_slice(list(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') ORDER BY ts) FILTER (WHERE off), 1, 5), ', '), '') AS examples FROM (SELECT *, (epoch_us(ts)//1000000) % 3600 <> 0 AS off, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM "
        "(SELECT DISTINCT symbol, CASE WHEN minute(ts) < 30 THEN date_trunc('hour', ts) ELSE date_trunc('minute', ts) END AS ts FROM user_ticks)) WHERE r <= 5000 GROUP BY symbol",
    ),
)
def _(spark, folder):
    ev = views.table(spark, folder, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    step = F.when(F.minute("ts") < 30, 3_600_000_000).otherwise(60_000_000)
    grid = ev.select(F.col("user_id").cast("string").alias("symbol"), F.timestamp_micros(us - us % step).cast("timestamp_ntz").alias("ts"))
    return ob.alignment_audit(grid, SYM, "1h", NOW)


FEATURES = ["return_1p", "zscore_20", "volatility_10", "roc_5"]


@query(
    "B05_sanitize_formulas",
    "WITH p AS (SELECT *, ['return_1p','zscore_20','volatility_10','roc_5','legacy_x'] AS f FROM part), q AS (SELECT p_size, f[p_partkey % 5 + 1] AS fa, "
    "f[(p_partkey//5) % 5 + 1] AS fb, greatest(-5.0, least(5.0, (p_size-25)/2.0::DOUBLE))::DOUBLE AS va, least(5.0, p_size/8.0::DOUBLE)::DOUBLE AS vb FROM p WHERE p_size % 3 < 2), "
    "c AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN '[\"' || fa || '\",\">\",' || CAST(va AS VARCHAR) || ']' ELSE '[[\"' || fa || '\",\">\",' || CAST(va AS VARCHAR) || "
    "'],\"AND\",[\"' || fb || '\",\"<\",' || CAST(vb AS VARCHAR) || ']]' END AS formula_json, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 3 END AS nodes FROM q "
    "WHERE fa NOT IN ('legacy_x','roc_5') AND (p_size % 3 = 0 OR fb NOT IN ('legacy_x','roc_5'))) SELECT formula_json, nodes, sha256(formula_json) AS formula_id FROM c",
)
def _(spark, folder):
    return fm.sanitize_formulas(views.formulas(spark, folder), FEATURES, suppressed=["roc_5"])


@query("B06_formula_features", with_views("formulas", "SELECT formula_no, unnest(regexp_extract_all(formula_json, '\\[\"([^\"]+)\",\"(?:<=|>=|==|!=|<|>)\"', 1)) AS feature FROM formulas"))
def _(spark, folder):
    return fm.formula_features(views.formulas(spark, folder), keep=["formula_no"])


@query("B07_formula_complexity", with_views("formulas", "SELECT formula_no, (length(formula_json) - length(replace(formula_json,'[','')))::INTEGER AS nodes FROM formulas"))
def _(spark, folder):
    return views.formulas(spark, folder).select("formula_no", fm.formula_complexity().alias("nodes"))


@query("B08_tail_bars", with_views("bars_user", "SELECT symbol, ts, round(close,6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars_user) WHERE r <= 20"))
def _(spark, folder):
    n = ob.bars_in_days("6h", 5)
    return ob.tail_bars(views.bars_user(spark, folder), SYM, "6h", n).select("symbol", "ts", rounded("close").alias("close"))


@query("B09_filter_universe", with_views("markets", "SELECT DISTINCT base || '_' || quote || '_SPOT' AS symbol FROM markets WHERE quote='USD'"))
def _(spark, folder):
    m = views.markets(spark, folder).select(F.concat_ws("_", "base", "quote", F.lit("SPOT")).alias("symbol"))
    return ob.filter_universe(m, suffix="_USD_SPOT").distinct()


@query("B10_sample_panel", with_views("bars_user", "SELECT symbol, ts, round(close,6) AS close FROM bars_user SEMI JOIN (SELECT symbol FROM (SELECT DISTINCT symbol FROM bars_user) ORDER BY ('0x' || substr(md5('7|' || symbol),1,8))::BIGINT, symbol LIMIT 10) USING (symbol)"))
def _(spark, folder):
    return ob.sample_panel(views.bars_user(spark, folder), 10, 7).select("symbol", "ts", rounded("close").alias("close"))


@query("B11_systematic_sample", with_views("bars_user", "SELECT symbol, ts, round(close,6) AS close FROM (SELECT *, row_number() OVER (ORDER BY symbol, ts) - 1 AS r, count(*) OVER () AS n FROM bars_user) WHERE r % greatest(1, n//50) = 0"))
def _(spark, folder):
    got = ob.systematic_sample(views.bars_user(spark, folder), [], "close", ["symbol", "ts"])
    return got.select("symbol", "ts", rounded("close").alias("close"))


@query("B15_tail_window", with_views("bars_1h", "SELECT symbol, ts, round(close,6) AS close FROM bars_1h WHERE ts >= TIMESTAMP '2024-01-27 22:30:00' AND ts <= TIMESTAMP '2024-01-30 22:30:00'"))
def _(spark, folder):
    return ob.tail_window(views.bars_1h(spark, folder), "2024-01-30 22:30:00", 72).select("symbol", "ts", rounded("close").alias("close"))


RIGHT_CLOSED = (
    "SELECT symbol, CASE WHEN epoch_us(ts) % 14400000000 = 0 THEN ts ELSE time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL '4 hours' END AS ts, "
    "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, true AS is_synthetic FROM bars_1h GROUP BY 1,2"
).replace("GROUP BY 1,2", "GROUP BY symbol, 2")


@query("D01_resample_bars", with_views("bars_1h", f"SELECT symbol, ts, {R_BARS}, is_synthetic FROM r", r=RIGHT_CLOSED))
def _(spark, folder):
    got = ob.resample_bars(views.bars_1h(spark, folder), SYM, "4h")
    return got.select("symbol", "ts", *price_columns(), "is_synthetic")


def _native_and_synthetic(spark, folder):
    bars = views.bars_1h(spark, folder)
    native = ob.resample_bars(bars.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), SYM, "4h", "left", "left", flag=False)
    return native, ob.resample_bars(bars, SYM, "4h")


NATIVE = {
    "r": RIGHT_CLOSED,
    "native": (
        "SELECT symbol, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high, "
        "min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, false AS is_synthetic FROM bars_1h WHERE ts < TIMESTAMP '2024-01-15' GROUP BY symbol, 2"
    ),
    "merged": (
        "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY is_synthetic) AS k FROM "
        "(SELECT * FROM native UNION ALL BY NAME SELECT * FROM r)) WHERE k = 1"
    ),
}


@query("D02_merge_native", with_views("bars_1h", f"SELECT symbol, ts, {R_BARS}, is_synthetic FROM merged", **NATIVE))
def _(spark, folder):
    native, synthetic = _native_and_synthetic(spark, folder)
    return ob.merge_native(native, synthetic, SYM).select("symbol", "ts", *price_columns(), "is_synthetic")


@query("D02_improvement", with_views("bars_1h", "SELECT symbol, native_rows, merged_rows, merged_rows > native_rows AS improved FROM (SELECT symbol, count(*) AS merged_rows FROM merged GROUP BY 1) JOIN (SELECT symbol, count(*) AS native_rows FROM native GROUP BY 1) USING (symbol)", **NATIVE))
def _(spark, folder):
    native, synthetic = _native_and_synthetic(spark, folder)
    return ob.improvement(native, ob.merge_native(native, synthetic, SYM), SYM)


def validate_sql(source: str, keys: str, cap: float, gap_s: str = GAP_S) -> str:
    return (
        f"SELECT {keys}, rows, 0::BIGINT AS dropped, dupes, gaps, round(gap_ratio,6) AS gap_ratio, gaps > 0 AND NOT gap_ratio <= {cap} AS degraded FROM "
        f"(SELECT *, CASE WHEN gaps > 0 THEN gaps / greatest(1, rows+gaps-1)::DOUBLE ELSE 0 END AS gap_ratio FROM (SELECT {keys}, count(*) AS rows, (sum(n)-count(*))::BIGINT AS dupes, "
        f"(CASE WHEN count(*) > 3 THEN count(*) FILTER (WHERE epoch(ts)-epoch(p) > {gap_s}) ELSE 0 END)::BIGINT AS gaps FROM (SELECT *, lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) AS p FROM "
        f"(SELECT {keys}, ts, count(*) AS n FROM {source} GROUP BY {keys}, ts)) GROUP BY {keys}))"
    )


@query("D03_validate_bars", with_views("hour_rows", validate_sql("hour_rows", "symbol", 0.05)))
def _(spark, folder):
    return oq.validate_bars(views.hour_rows(spark, folder), SYM, "1h", 0.05).withColumn("gap_ratio", rounded("gap_ratio"))


GAPS = "SELECT * FROM (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap_start, ts AS gap_end FROM bars_user) WHERE epoch(gap_end)-epoch(gap_start) > 32400"


@query("D04_find_gaps", with_views("bars_user", "SELECT *, (floor((epoch(gap_end)-epoch(gap_start))/21600)-1)::BIGINT AS missing_bars FROM g", g=GAPS))
def _(spark, folder):
    return oq.find_gaps(views.bars_user(spark, folder), SYM, "6h")


@query(
    "D05_apply_repairs",
    with_views(
        "bars_venue",
        "SELECT symbol, ts, round(close,6) AS close, false AS repaired FROM base UNION ALL SELECT s.symbol, s.ts, round(s.close,6), true FROM late s JOIN g ON s.symbol=g.symbol AND s.ts >= g.a + INTERVAL '1 hour' AND s.ts <= g.b - INTERVAL '1 hour'",
        base="SELECT * FROM bars_venue WHERE venue='v0'",
        late="SELECT * FROM bars_venue WHERE venue='v1'",
        g="SELECT * FROM (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS a, ts AS b FROM base) WHERE epoch(b)-epoch(a) > 5400",
    ),
)
def _(spark, folder):
    b = views.bars_venue(spark, folder)
    base, late = (b.where(F.col("venue") == v).drop("venue") for v in ("v0", "v1"))
    return oq.apply_repairs(base, late, SYM, "1h").select("symbol", "ts", rounded("close").alias("close"), "repaired")


@query(
    "D06_flat_fill",
    with_views(
        "bars_user",
        "SELECT symbol, ts, round(close,6) AS close, round(volume,6) AS volume, volume = 0 AS synthetic_zero_volume FROM (SELECT symbol, ts, close, volume FROM bars_user UNION ALL "
        "SELECT b.symbol, g.gap_start + INTERVAL '6 hours' * u.i, b.close, 0 FROM g JOIN ok USING (symbol) JOIN bars_user b ON b.symbol=g.symbol AND b.ts=g.gap_start, "
        "unnest(range(1, ((epoch(g.gap_end)-epoch(g.gap_start))/21600)::BIGINT)) AS u(i))",
        g=GAPS,
        ok="SELECT symbol FROM g GROUP BY 1 HAVING sum((epoch(gap_end)-epoch(gap_start))/21600-1) <= 70",
    ),
)
def _(spark, folder):
    got = oq.flat_fill(views.bars_user(spark, folder), SYM, "6h", 70)
    return got.select("symbol", "ts", rounded("close").alias("close"), rounded("volume").alias("volume"), "synthetic_zero_volume")


@query("D08_coverage_report", with_views("bars_venue", "SELECT venue, symbol, expected, rows AS actual, round(rows/expected::DOUBLE,4) AS coverage, gaps, round(gap_ratio,4) AS gap_ratio, NOT degraded AS accepted FROM v JOIN (SELECT venue, symbol, greatest(1, ceil((epoch(max(ts))+3600-epoch(TIMESTAMP '2024-01-01'))/3600))::BIGINT AS expected FROM bars_venue GROUP BY 1,2) USING (venue, symbol)", v=validate_sql("bars_venue", "venue, symbol", -1)))
def _(spark, folder):
    return oq.coverage_report(views.bars_venue(spark, folder), VS, "1h", SINCE)


ACCEPT = {
    "base": "SELECT DISTINCT venue, symbol, ts FROM bars_venue",
    "f1": validate_sql("bars_venue", "venue, symbol", 0.18),
    "fb": "SELECT base.* FROM base JOIN f1 USING (venue, symbol) WHERE degraded AND gap_ratio <= 0.189",
    "fg": "SELECT * FROM (SELECT venue, symbol, lag(ts) OVER (PARTITION BY venue, symbol ORDER BY ts) AS a, ts AS b FROM fb) WHERE epoch(b)-epoch(a) >= 7200",
    "ft": "SELECT venue, symbol FROM fg GROUP BY 1,2 HAVING sum((epoch(b)-epoch(a))/3600-1) <= 2000",
    "filled_bars": "SELECT * FROM fb UNION ALL SELECT venue, symbol, a + INTERVAL '1 hour' * u.i FROM fg JOIN ft USING (venue, symbol), unnest(range(1, ((epoch(b)-epoch(a))/3600)::BIGINT)) AS u(i)",
    "f2": validate_sql("filled_bars", "venue, symbol", 0.18),
    "st": "SELECT venue, symbol, f AS filled, dropped, dupes, CASE WHEN f THEN rows2 ELSE rows END AS rows, CASE WHEN f THEN gaps2 ELSE gaps END AS gaps, CASE WHEN f THEN ratio2 ELSE gap_ratio END AS gap_ratio, CASE WHEN f THEN degraded2 ELSE degraded END AS degraded FROM "
    "(SELECT *, coalesce(NOT degraded2 AND rows2 > rows, false) AS f FROM f1 LEFT JOIN (SELECT venue, symbol, rows AS rows2, gaps AS gaps2, gap_ratio AS ratio2, degraded AS degraded2 FROM f2) USING (venue, symbol))",
    "chosen": "SELECT base.* FROM base JOIN st USING (venue, symbol) WHERE NOT filled UNION ALL SELECT b.* FROM filled_bars b JOIN st USING (venue, symbol) WHERE filled",
    "rp": "SELECT venue, symbol FROM st WHERE gaps > 0 AND (NOT degraded OR gap_ratio <= 0.18)",
    "cg": "SELECT * FROM (SELECT venue, symbol, lag(ts) OVER (PARTITION BY venue, symbol ORDER BY ts) AS a, ts AS b FROM chosen JOIN rp USING (venue, symbol)) WHERE epoch(b)-epoch(a) > 5400",
    "mended": "SELECT venue, symbol, ts FROM chosen JOIN rp USING (venue, symbol) UNION SELECT l.venue, l.symbol, l.ts FROM (SELECT 'v0' AS venue, symbol, ts FROM bars_venue WHERE venue='v1') l JOIN cg USING (venue, symbol) WHERE l.ts >= a + INTERVAL '1 hour' AND l.ts <= b - INTERVAL '1 hour'",
    "f3": validate_sql("mended", "venue, symbol", 0.18),
    "rep": "SELECT venue, symbol, filled, rows3 IS NOT NULL AS repaired, dropped, dupes, coalesce(rows3, rows) AS rows, coalesce(gaps3, gaps) AS gaps, coalesce(ratio3, gap_ratio) AS gap_ratio, NOT coalesce(degraded3, degraded) AS accepted FROM st "
    "LEFT JOIN (SELECT venue, symbol, rows AS rows3, gaps AS gaps3, gap_ratio AS ratio3, degraded AS degraded3 FROM f3) USING (venue, symbol)",
    "fin": "SELECT chosen.* FROM chosen ANTI JOIN rp USING (venue, symbol) UNION ALL SELECT * FROM mended",
    "kept": "SELECT venue, symbol, count(*) AS kept_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM fin JOIN rep USING (venue, symbol) WHERE accepted GROUP BY 1,2",
}


@query("D07_accept_bars", with_views("bars_venue", "SELECT rep.*, kept_rows, first_ts, last_ts FROM rep LEFT JOIN kept USING (venue, symbol)", **ACCEPT))
def _(spark, folder):
    """Accepted series and their reports; repairs come from the other venue."""
    from barloom.plans.flows import accept_bars

    b = views.bars_venue(spark, folder)
    late = b.where(F.col("venue") == "v1").withColumn("venue", F.lit("v0"))
    bars, report = accept_bars(b, late, VS, "1h", 0.18, 2000)
    n = bars.groupBy(*VS).agg(F.count(F.lit(1)).alias("kept_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return report.join(n, VS, "left").withColumn("gap_ratio", rounded("gap_ratio"))


def _venue_1h(spark, folder):
    return views.bars_venue(spark, folder).withColumn("timeframe", F.lit("1h"))


COUNTS = "SELECT venue, '1h' AS timeframe, symbol, count(*) AS rows FROM bars_venue GROUP BY 1,2,3"


@query("D09_reindex_coverage", with_views("coverage", "SELECT venue, timeframe, symbol, CASE WHEN n THEN rows ELSE expected END AS expected, CASE WHEN n THEN rows ELSE actual END AS actual, CASE WHEN n THEN 1.0::DOUBLE ELSE coverage END AS coverage, n AS reindexed FROM (SELECT *, coalesce(rows,0) > coalesce(actual,0) AS n FROM coverage FULL JOIN counts USING (venue, timeframe, symbol))", counts=COUNTS))
def _(spark, folder):
    return oc.reindex_coverage(oc.bar_counts(_venue_1h(spark, folder)), views.coverage(spark, folder))


BEST = (
    "SELECT c.symbol, venue, timeframe, expected, actual, coverage, total_rows, greatest(actual, total_rows) AS bars FROM "
    "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY actual DESC, venue) AS k FROM coverage) c JOIN "
    "(SELECT symbol, count(*) AS total_rows FROM bars_venue GROUP BY 1) t USING (symbol) WHERE k = 1"
)


@query("D10_best_coverage", with_views("coverage", "SELECT * FROM best", best=BEST))
def _(spark, folder):
    return oc.best_coverage(views.coverage(spark, folder), views.bars_venue(spark, folder))


GATE = (
    "SELECT count(*) AS symbols_seen, count(*) FILTER (WHERE coverage >= {cov} AND bars >= {t}) AS symbols_eligible, count(*) FILTER (WHERE bars >= {t}) AS symbols_at_target, "
    "min(bars) AS bars_min, list_sort(list(bars))[count(*)//2+1] AS bars_median, max(bars) AS bars_max, count(*) >= 3 AND count(*) FILTER (WHERE bars >= {t})/count(*)::DOUBLE >= 0.75 AS by_quorum, "
    "(count(*) >= 3 AND count(*) FILTER (WHERE bars >= {t})/count(*)::DOUBLE >= 0.75) OR count(*) FILTER (WHERE coverage >= {cov} AND bars >= {t}) >= 3 AS gate_ok, min(bars) < {t}*0.5 AS underfilled FROM best"
)


@query("D11_coverage_gate", with_views("coverage", GATE.format(cov=0.3, t=1080), best=BEST))
def _(spark, folder):
    best = oc.best_coverage(views.coverage(spark, folder), views.bars_venue(spark, folder))
    return oc.coverage_gate(best, 0.3, oc.target_bars("1h", 200, 45), 3)


USER_COV = "SELECT symbol, round(count(*)/120.0::DOUBLE,4) AS coverage, count(*) AS bars FROM bars_user GROUP BY 1"


@query("D12_panel_coverage", with_views("bars_user", GATE.format(cov=0.4, t=50), best=USER_COV))
def _(spark, folder):
    best = views.bars_user(spark, folder).groupBy("symbol").agg(
        F.round(F.count(F.lit(1)) / 120, 4).alias("coverage"), F.count(F.lit(1)).alias("bars")
    )
    return oc.coverage_gate(best, 0.4, 50, 3)


@query("D13_select_timeframe", with_views("bars_venue", "SELECT arg_min(timeframe, pref) AS timeframe, arg_min(eligible, pref) AS eligible FROM (SELECT timeframe, count(*) AS eligible, list_position(['1d','6h','1h'], timeframe) AS pref FROM (SELECT timeframe, symbol, count(*) AS n FROM lake GROUP BY 1,2) WHERE n >= 100 GROUP BY 1) WHERE eligible >= 4", **LAKE))
def _(spark, folder):
    return oc.select_timeframe(lake_bars(spark, folder), ["1d", "6h", "1h"], 100, 4)


@query("D14_accept_ratio", with_views("bars_user", "SELECT timeframe, count(*) AS attempts, count(*) FILTER (WHERE ok) AS accepted, round(avg(ok::INT),6) AS accept_ratio, avg(ok::INT) >= 0.7 AS advance FROM (SELECT CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN '1h' ELSE '6h' END AS timeframe, NOT degraded AS ok FROM v) GROUP BY 1", v=validate_sql("bars_user", "symbol", 0.33, "32400")))
def _(spark, folder):
    rep = oq.validate_bars(views.bars_user(spark, folder), SYM, "6h", 0.33)
    tf = F.when(F.col("symbol").cast("long") % 2 == 0, "1h").otherwise("6h")
    return oc.accept_ratio(rep.select(tf.alias("timeframe"), (~F.col("degraded")).alias("accepted"))).withColumn(
        "accept_ratio", rounded("accept_ratio")
    )


@query("D15_backfill_progress", with_views("bars_venue", "SELECT *, bool_and(met) OVER () AND count(*) OVER () = 2 AS all_met FROM (SELECT timeframe, count(*) AS symbols, count(*) FILTER (WHERE rows >= t) AS symbols_at_target, min(rows) AS rows_min, max(rows) AS rows_max, count(*) FILTER (WHERE rows >= t) >= 3 AS met FROM (SELECT timeframe, symbol, max(rows) AS rows, any_value(CASE timeframe WHEN '1h' THEN 500 ELSE 110 END) AS t FROM (SELECT venue, timeframe, symbol, count(*) AS rows FROM lake GROUP BY 1,2,3) GROUP BY 1,2) GROUP BY 1)", **LAKE))
def _(spark, folder):
    return oc.backfill_progress(oc.bar_counts(lake_bars(spark, folder)), {"1h": 500, "6h": 110}, 3)


@query("D16_backfill_start", with_views("bars_user", "SELECT symbol, round(rows/240.0::DOUBLE,6) AS depth_ratio, rw AS rewound, CASE WHEN rw THEN TIMESTAMP '2023-12-01 23:30:00' ELSE last_ts END AS since FROM (SELECT *, rows/240.0::DOUBLE < 0.21 AND TIMESTAMP '2023-12-01 23:30:00' < last_ts - INTERVAL '60 hours' AS rw FROM (SELECT symbol, count(*) AS rows, max(ts) AS last_ts FROM bars_user GROUP BY 1))"))
def _(spark, folder):
    c = views.bars_user(spark, folder).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("last_ts"))
    return oc.backfill_start(c, "6h", 60, 0.21, NOW).withColumn("depth_ratio", rounded("depth_ratio"))


@query("I01_sorted_panel", with_views("bars_user", "SELECT symbol, ts, round(close,6) AS close FROM bars_user ORDER BY symbol, ts"))
def _(spark, folder):
    """Global order by range partitioning: no single-task sort."""
    return views.bars_user(spark, folder).orderBy("symbol", "ts").select("symbol", "ts", rounded("close").alias("close"))


@query("I02_priority_order", with_views("bars_user", "SELECT symbol, coalesce(nullif(coalesce(list_position(['7','3','11'], symbol),0),0), 10000)::BIGINT AS priority FROM bars_user GROUP BY symbol"))
def _(spark, folder):
    rank = F.array_position(F.array(F.lit("7"), F.lit("3"), F.lit("11")), F.col("symbol"))
    s = views.bars_user(spark, folder).select("symbol").distinct()
    return s.withColumn("priority", F.coalesce(F.nullif(rank, F.lit(0).cast("long")), F.lit(10000).cast("long"))).orderBy("priority", "symbol")


@query("I04_top_k", with_views("ticks", "SELECT event_id, price FROM ticks ORDER BY price DESC, event_id LIMIT 25"))
def _(spark, folder):
    return views.ticks(spark, folder).select("event_id", "price").orderBy(F.desc("price"), "event_id").limit(25)


@query("I05_top_bottom_per_group", with_views("ticks", "SELECT symbol, 'top' AS side, event_id, price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY price DESC, event_id) <= 3 UNION ALL SELECT symbol, 'bottom', event_id, price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY price, event_id) <= 3"))
def _(spark, folder):
    from barloom.operators.selection import top_bottom

    return top_bottom(views.ticks(spark, folder), ["symbol"], "price", "event_id", 3).select("symbol", "side", "event_id", "price")


@query("I06_keep_first", with_views("hour_rows", "SELECT symbol, ts, event_id, close FROM hour_rows QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) = 1"))
def _(spark, folder):
    return lake.keep_first(views.hour_rows(spark, folder).select("symbol", "ts", "event_id", "close"), ["symbol", "ts"], ["event_id"])


@query("I07_unions", with_views("markets", "SELECT base, venue, count(*) AS listings FROM (SELECT base, venue FROM markets UNION ALL SELECT 'B' || s_suppkey, 'v0' FROM supplier) GROUP BY 1,2"))
def _(spark, folder):
    m = views.markets(spark, folder).select("base", "venue")
    s = views.table(spark, folder, "supplier").select(F.concat(F.lit("B"), "s_suppkey").alias("base"), F.lit("v0").alias("venue"))
    return m.unionByName(s).groupBy("base", "venue").agg(F.count(F.lit(1)).alias("listings"))


@query("I08_set_difference", with_views("markets", "SELECT base, 'only_v0' AS kind FROM (SELECT base FROM markets WHERE venue='v0' EXCEPT SELECT base FROM markets WHERE venue='v1') UNION ALL SELECT base, 'both' FROM (SELECT base FROM markets WHERE venue='v0' INTERSECT SELECT base FROM markets WHERE venue='v1')"))
def _(spark, folder):
    m = views.markets(spark, folder)
    a, b = (m.where(F.col("venue") == v).select("base") for v in ("v0", "v1"))
    return a.subtract(b).withColumn("kind", F.lit("only_v0")).unionByName(a.intersect(b).withColumn("kind", F.lit("both")))


