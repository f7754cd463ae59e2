"""Bar, trade, market and strategy tables derived from the star-schema input tables.

Each function takes (spark, folder of parquet files) and returns a DataFrame whose size follows the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import floor_to

FX_QUOTES = ("USD", "USDT", "EUR")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ticks(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id"
    )


def to_bars(df: DataFrame, keys, ts: str, price: str, seconds: int) -> DataFrame:
    """Open/high/low/close/volume bars per key from ticks with unique timestamps."""
    return (
        df.groupBy(*keys, floor_to(ts, seconds).alias("_bin"))
        .agg(
            F.min_by(price, ts).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, ts).alias("close"),
            F.sum(price).alias("volume"),
        )
        .withColumnRenamed("_bin", "ts")
        .select(*keys, "ts", "open", "high", "low", "close", "volume")
    )


def bars_1h(spark, folder) -> DataFrame:
    return to_bars(ticks(spark, folder), ["symbol"], "ts", "price", 3600)


def bars_user(spark, folder) -> DataFrame:
    """Many-symbol panel: one symbol per user, six-hour bars."""
    ev = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("symbol"), "ts", F.col("value").alias("price")
    )
    return to_bars(ev, ["symbol"], "ts", "price", 21600)


def bars_venue(spark, folder) -> DataFrame:
    """Hourly bars per venue and symbol."""
    ev = table(spark, folder, "events").select(
        F.concat(F.lit("v"), F.col("user_id") % 2).alias("venue"),
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
    )
    return to_bars(ev, ["venue", "symbol"], "ts", "price", 3600)


def hour_rows(spark, folder) -> DataFrame:
    """Every tick as a one-hour bar row: many rows share (symbol, ts)."""
    price = F.col("value")
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        floor_to("ts", 3600).alias("ts"),
        price.alias("open"),
        (price * 1.5).alias("high"),
        (price * 0.5).alias("low"),
        price.alias("close"),
        F.lit(1.0).alias("volume"),
        "event_id",
    )


def trades(spark, folder) -> DataFrame:
    """Realised returns per rule (user) and symbol."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("formula_id"),
        F.col("event_type").alias("symbol"),
        "ts",
        ((F.col("value") - 50.0) / 100.0).alias("pnl"),
    )


def alpha_returns(spark, folder) -> DataFrame:
    """Return series per strategy (customer), in order-date order."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("alpha_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("trade_id"),
        ((F.col("o_totalprice") - 250000.0) / 1e6).alias("ret"),
    )


def alpha_dim(spark, folder) -> DataFrame:
    """Strategy attributes: lane, portfolio and first universe symbol."""
    core = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("alpha_id"),
        F.when(core, "core").otherwise("moonshot").alias("lane"),
        F.col("c_nationkey").cast("long").alias("portfolio_id"),
        F.array(
            F.concat(F.lit("S"), F.col("c_custkey") % 40), F.concat(F.lit("S"), F.col("c_custkey") % 7)
        ).alias("universe"),
        F.col("c_acctbal").alias("prior_budget"),
    )


def alpha_stats(spark, folder) -> DataFrame:
    """Count, mean-based Sharpe, downside-based Sortino and win rate per strategy joined to its attributes."""
    r = F.col("ret")
    stats = (
        alpha_returns(spark, folder)
        .groupBy("alpha_id")
        .agg(
            F.count(F.lit(1)).alias("n_trades"),
            F.avg(r).alias("mean_ret"),
            F.stddev_samp(r).alias("std_ret"),
            F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))).alias("down"),
            F.avg((r > 0).cast("double")).alias("win_rate"),
            F.max(F.abs(F.least(r, F.lit(0.0)))).alias("mdd"),
        )
        .select(
            "alpha_id",
            "n_trades",
            F.coalesce(F.try_divide("mean_ret", "std_ret"), F.lit(0.0)).alias("sharpe"),
            F.coalesce(F.try_divide("mean_ret", "down"), F.lit(0.0)).alias("sortino"),
            "win_rate",
            "mdd",
        )
    )
    return alpha_dim(spark, folder).join(stats, "alpha_id")


def markets(spark, folder) -> DataFrame:
    """Market metadata per venue; a third of the bases go by an alias (X.. for B..)."""
    p = table(spark, folder, "part")
    base = F.concat(F.when(F.col("p_type").isin("PROMO", "SMALL"), "X").otherwise("B"), F.floor(F.col("p_partkey") / 2))
    quote = F.element_at(F.array(*(F.lit(q) for q in FX_QUOTES)), (F.col("p_size") % 3 + 1).cast("int"))
    return p.select(
        F.concat(F.lit("v"), F.col("p_size") % 2).alias("venue"),
        F.concat(base, F.lit("/"), quote).alias("venue_symbol"),
        base.alias("base"),
        quote.alias("quote"),
        (F.col("p_type") != "LARGE").alias("spot"),
        (F.col("p_type") == "LARGE").alias("swap"),
        F.col("p_partkey").alias("market_order"),
    )


def tickers(spark, folder) -> DataFrame:
    """One ticker per part listing; volumes come from its line items."""
    traded = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    )
    p = table(spark, folder, "part").join(traded, F.col("p_partkey") == F.col("l_partkey"), "left")
    last = F.col("p_retailprice")
    m = markets(spark, folder).select("market_order", "venue", "venue_symbol")
    t = p.select(
        F.col("p_partkey").alias("market_order"),
        F.when(F.col("p_size") % 7 != 0, last).alias("last"),
        last.alias("close"),
        (last - F.col("p_size") / 100).alias("bid"),
        F.when(F.col("p_size") % 11 != 0, last + F.col("p_size") / 100).alias("ask"),
        F.when(F.col("p_size") % 10 != 0, F.col("qty") * last).alias("quote_volume"),
        F.col("qty").alias("base_volume"),
        F.when(F.col("p_size") % 13 != 0, (F.col("p_size") * 37 % 101 - 40) / 4).alias("percentage"),
    )
    return m.join(t, "market_order")


def fx_ticks(spark, folder) -> DataFrame:
    """Currency ticks in arrival order: USDT/USD, USD/EUR and DAI/USD."""
    k = F.col("c_custkey") % 3
    return table(spark, folder, "customer").select(
        F.when(k == 0, "USDT/USD").when(k == 1, "USD/EUR").otherwise("DAI/USD").alias("venue_symbol"),
        F.when(k == 1, 0.9 + F.col("c_acctbal") / 1e6).otherwise(1.0 + F.col("c_acctbal") / 1e6).alias("last"),
        F.lit(None).cast("double").alias("close"),
        F.col("c_custkey").alias("tick_order"),
    )


#: Rows of line items that one task turns into books, about.
BOOK_ROWS = 1 << 19


def books(spark, folder) -> DataFrame:
    """Order books per supplier as two arrays of (price, size), best level first; the range midpoint splits the sides.

    The rows move once, to as many tasks as their number calls for, so that a task's memory does not grow with the table;
    levels, midpoint and order of a book are made where its rows are.
    """
    items = table(spark, folder, "lineitem")
    tasks = max(1, -(-items.count() // BOOK_ROWS))
    li = items.select(
        F.col("l_suppkey").cast("string").alias("venue_symbol"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"),
        F.col("l_quantity").alias("size"),
    )
    levels = li.repartition(tasks, "venue_symbol").groupBy("venue_symbol", "price").agg(F.sum("size").alias("size"))
    book = levels.groupBy("venue_symbol").agg(F.sort_array(F.collect_list(F.struct("price", "size"))).alias("_all"))
    priced = F.filter("_all", lambda x: x["price"].isNotNull())
    book = book.withColumn("_mid", (F.try_element_at(priced, F.lit(1))["price"] + F.try_element_at(priced, F.lit(-1))["price"]) / 2)
    bid = lambda x: F.coalesce(x["price"] < F.col("_mid"), F.lit(False))
    return book.select(
        "venue_symbol", F.reverse(F.filter("_all", bid)).alias("bids"), F.filter("_all", lambda x: ~bid(x)).alias("asks")
    )


def coverage(spark, folder) -> DataFrame:
    """Recorded coverage per venue and symbol: bars seen in the first 20 days against a 25-day target."""
    b = bars_venue(spark, folder).where(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"))
    return b.groupBy("venue", "symbol").agg(F.count(F.lit(1)).alias("actual")).select(
        "venue",
        F.lit("1h").alias("timeframe"),
        "symbol",
        F.lit(600).cast("long").alias("expected"),
        "actual",
        F.round(F.col("actual") / 600, 4).alias("coverage"),
    )


def coverage_json(spark, folder) -> DataFrame:
    """Key/payload pairs; payloads of venue v1 are encoded twice."""
    once = F.to_json(F.struct("expected", "actual", "coverage"))
    twice = F.concat(F.lit('"'), F.replace(once, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return coverage(spark, folder).select(
        F.concat_ws(":", "venue", "timeframe", "symbol").alias("key"),
        F.when(F.col("venue") == "v1", twice).otherwise(once).alias("payload"),
    )


def formulas(spark, folder) -> DataFrame:
    """One boolean rule tree per part, as JSON text."""
    feats = F.array(*(F.lit(f) for f in ("return_1p", "zscore_20", "volatility_10", "roc_5", "legacy_x")))
    pick = lambda c: F.element_at(feats, (c % 5 + 1).cast("int"))
    leaf = lambda f, op, v: F.concat(F.lit('["'), f, F.lit(f'","{op}",'), v.cast("string"), F.lit("]"))
    k = F.col("p_partkey")
    a = leaf(pick(k), ">", (F.col("p_size") - 25) / F.lit(2.0))
    b = leaf(pick(F.floor(k / 5)), "<", F.col("p_size") / F.lit(8.0))
    c = leaf(pick(F.floor(k / 25)), ">=", F.lit(0.5))
    text = (
        F.when(F.col("p_size") % 3 == 0, a)
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("["), a, F.lit(',"AND",'), b, F.lit("]")))
        .otherwise(
            F.concat(F.lit("[["), a, F.lit(',"AND",'), b, F.lit('],"OR",'), c, F.lit("]"))
        )
    )
    return table(spark, folder, "part").select(k.alias("formula_no"), text.alias("formula_json"))


def cycle_log(spark, folder) -> DataFrame:
    """One row per day: share of events above 50 and median-like activity, as a research cycle log."""
    ev = table(spark, folder, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000)) - F.lit(19723)
    return ev.groupBy(day.cast("long").alias("cycle")).agg(
        F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("survivor_density"),
        (F.count(F.lit(1)) / F.lit(10.0)).alias("median_trades"),
        F.round(F.max("value"), 6).alias("best_fitness"),
    )


def feature_log(spark, folder) -> DataFrame:
    """Per cycle and feature (event type): was the feature active that day."""
    ev = table(spark, folder, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000)) - F.lit(19723)
    return ev.groupBy(day.cast("long").alias("cycle"), F.col("event_type").alias("feature")).agg(
        (F.max("value") > 180).alias("active")
    )


def equity(spark, folder) -> DataFrame:
    """Daily result of all orders around a 250,000 reference, ordered by day."""
    return table(spark, folder, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.sum(F.round((F.col("o_totalprice") - 250000.0) * 100).cast("long")).alias("pnl_cents")
    )
