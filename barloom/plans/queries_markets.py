"""Queries over symbols, venues, the universe screen and order books (families C, H, parts of B and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.operators import markets as mk
from barloom.operators import orderbook as bk
from barloom.operators.ordered import epoch_us
from barloom.plans.oracle_views import with_views
from barloom.plans.queries_bars import LAKE, lake_bars
from barloom.plans.registry import query
from barloom.sources import lake, views

VENUE_QUOTES = {"v1": ["USD", "EUR"]}
ALLOWED = "CASE WHEN venue='v1' THEN ['USD','EUR'] ELSE ['USD','USDC','USDT'] END"
NOW = "2024-01-30 23:30:00"


def aliases(spark, folder):
    """X<k> is an alias of B<k> for every supplier number k."""
    s = views.table(spark, folder, "supplier")
    return s.select(F.concat(F.lit("B"), "s_suppkey").alias("base"), F.concat(F.lit("X"), "s_suppkey").alias("alias"), F.lit(1).alias("alias_pos"))


ALIAS = "SELECT 'B' || s_suppkey AS base, 'X' || s_suppkey AS alias FROM supplier"


def static_map(spark, folder):
    s = views.table(spark, folder, "supplier")
    return s.select(
        F.lit("v0").alias("venue"), F.concat(F.lit("B"), "s_suppkey", F.lit("_USD_SPOT")).alias("canonical"),
        F.concat(F.lit("X"), "s_suppkey", F.lit("/EUR")).alias("venue_symbol"),
    )


def wanted(spark, folder):
    """Every base of the part table, wanted in dollars on both venues."""
    p = views.table(spark, folder, "part").select(F.concat(F.lit("B"), F.floor(F.col("p_partkey") / 2)).alias("base")).distinct()
    return p.select(F.explode(F.array(F.lit("v0"), F.lit("v1"))).alias("venue"), "base", F.lit("USD").alias("quote"))


RESOLVE = {
    "al": ALIAS,
    "req": "SELECT v AS venue, base, base || '_USD_SPOT' AS canonical FROM (SELECT DISTINCT 'B' || (p_partkey//2) AS base FROM part), (SELECT unnest(['v0','v1']) AS v)",
    "spot": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue, venue_symbol ORDER BY market_order) AS k FROM markets WHERE spot) WHERE k = 1",
    "nm": "SELECT r.venue, r.canonical, n.name, n.pos FROM req r JOIN (SELECT DISTINCT base, base AS name, 0 AS pos FROM req UNION ALL SELECT base, alias, 1 FROM al) n USING (base)",
    "c": (
        "SELECT nm.venue, canonical, venue_symbol, 1 AS tier, pos AS a, market_order AS m FROM nm JOIN spot s ON s.venue=nm.venue AND s.venue_symbol = name || '/USD' UNION ALL "
        "SELECT r.venue, canonical, s.venue_symbol, 2, 0, market_order FROM req r JOIN supplier ON r.venue='v0' AND canonical = 'B' || s_suppkey || '_USD_SPOT' JOIN spot s ON s.venue='v0' AND s.venue_symbol = 'X' || s_suppkey || '/EUR' UNION ALL "
        f"SELECT nm.venue, canonical, venue_symbol, 3, 0, market_order FROM nm JOIN spot s ON s.venue=nm.venue AND s.base=name WHERE list_contains({ALLOWED.replace('venue', 's.venue')}, s.quote)"
    ),
    "best": "SELECT venue, canonical, venue_symbol, tier FROM (SELECT *, row_number() OVER (PARTITION BY venue, canonical ORDER BY tier, a, m) AS k FROM c) WHERE k = 1",
}


@query("C01_resolve_symbols", with_views("markets", "SELECT venue, canonical, venue_symbol, coalesce(tier,0) AS tier FROM req LEFT JOIN best USING (venue, canonical)", **RESOLVE))
def _(spark, folder):
    return mk.resolve_symbols(wanted(spark, folder), views.markets(spark, folder), aliases(spark, folder), static_map(spark, folder), VENUE_QUOTES).fillna(0, ["tier"])


@query("C02_normalize_base", with_views("markets", "SELECT market_order, coalesce(al.base, markets.base) AS base FROM markets LEFT JOIN al ON alias = markets.base", al=ALIAS))
def _(spark, folder):
    return mk.normalize_base(views.markets(spark, folder).select("market_order", "base"), aliases(spark, folder))


@query("C03_allowed_quotes", with_views("markets", f"SELECT venue, quote, count(*) AS listings, list_contains({ALLOWED}, quote) AS allowed FROM markets GROUP BY 1,2"))
def _(spark, folder):
    ok = F.array_contains(mk.allowed_quotes("venue", VENUE_QUOTES), F.col("quote"))
    return views.markets(spark, folder).groupBy("venue", "quote", ok.alias("allowed")).agg(F.count(F.lit(1)).alias("listings"))


SNAP = (
    "SELECT venue, canonical, venue_symbol, base, quote, spot FROM (SELECT *, row_number() OVER (PARTITION BY venue, canonical ORDER BY market_order DESC) AS k FROM "
    f"(SELECT m.*, coalesce(al.base, m.base) || '_' || quote || (CASE WHEN spot THEN '_SPOT' ELSE '_DERIV' END) AS canonical FROM markets m LEFT JOIN al ON alias=m.base WHERE NOT spot OR list_contains({ALLOWED}, quote))) WHERE k = 1"
)


@query("C04_catalog_snapshot", with_views("markets", "SELECT * FROM snap", al=ALIAS, snap=SNAP))
def _(spark, folder):
    return mk.catalog_snapshot(views.markets(spark, folder), aliases(spark, folder), VENUE_QUOTES, derivatives=True)


@query("C05_catalog_diff", with_views("markets", "(SELECT venue, canonical, 'added' AS change FROM n WHERE spot AND (venue, canonical) NOT IN (SELECT (venue, canonical) FROM o)) UNION ALL (SELECT venue, canonical, 'removed' FROM o WHERE spot AND (venue, canonical) NOT IN (SELECT (venue, canonical) FROM n))", al=ALIAS, n=SNAP, o="SELECT venue, base || '_' || quote || '_SPOT' AS canonical, spot FROM markets WHERE spot GROUP BY ALL"))
def _(spark, folder):
    m = views.markets(spark, folder)
    old = m.where("spot").select("venue", mk.canonical("base", "quote").alias("canonical"), "spot").distinct()
    return mk.catalog_diff(old, mk.catalog_snapshot(m, aliases(spark, folder), VENUE_QUOTES, derivatives=True))


RATES = {
    "tk": "SELECT venue_symbol, last, close, market_order AS o FROM tickers UNION ALL SELECT venue_symbol, last, close, tick_order + 1000000000000 FROM fx_ticks",
    "fx": (
        "SELECT currency, arg_max(rate, o) AS rate FROM (SELECT CASE WHEN b='USD' THEN a ELSE b END AS currency, CASE WHEN b='USD' THEN p ELSE 1/p END AS rate, o FROM (SELECT split_part(venue_symbol,'/',1) AS a, split_part(venue_symbol,'/',2) AS b, "
        "coalesce(nullif(last,0), nullif(close,0)) AS p, o FROM tk) WHERE p IS NOT NULL AND (a='USD' OR b='USD')) GROUP BY 1 UNION ALL SELECT 'USD', 1.0"
    ),
}


def rates(spark, folder):
    t = views.tickers(spark, folder).select("venue_symbol", "last", "close", F.col("market_order").alias("tick_order"))
    fx = views.fx_ticks(spark, folder).withColumn("tick_order", F.col("tick_order") + 1_000_000_000_000)
    return mk.usd_rates(t.unionByName(fx))


@query("D17_usd_rates", with_views("tickers fx_ticks", "SELECT currency, round(rate,9) AS rate FROM fx", **RATES))
def _(spark, folder):
    return rates(spark, folder).withColumn("rate", rounded("rate", 9))


@query("D17_stable_parity", with_views("tickers fx_ticks", "SELECT currency, round(rate,9) AS rate, round(abs(rate-1),9) AS off_parity FROM fx WHERE currency IN ('USDT','USDC','DAI','FDUSD','TUSD','PYUSD') AND abs(rate-1) > 0.0005", **RATES))
def _(spark, folder):
    return mk.stable_parity(rates(spark, folder), 5.0).select("currency", rounded("rate", 9).alias("rate"), rounded("off_parity", 9).alias("off_parity"))


@query("D18_top_gainers", with_views("tickers", "SELECT DISTINCT upper(split_part(venue_symbol,'/',1)) AS base FROM (SELECT * FROM tickers WHERE percentage IS NOT NULL ORDER BY percentage DESC, venue, venue_symbol, market_order LIMIT 40)"))
def _(spark, folder):
    return mk.top_gainers(views.tickers(spark, folder), 40)


@query("B12_spread_bps", with_views("tickers", "SELECT market_order, round(CASE WHEN bid>0 AND ask>0 THEN 10000*(ask-bid)/(0.5*(bid+ask)) END,6) AS spread_bps, coalesce(bid>0 AND ask>0, false) AS is_quoted FROM tickers"))
def _(spark, folder):
    t = views.tickers(spark, folder).withColumn("s", mk.spread_bps())
    return t.select("market_order", rounded("s").alias("spread_bps"), F.col("s").isNotNull().alias("is_quoted"))


SCREEN = (
    "SELECT base || '_' || quote || '_SPOT' AS symbol, m.venue, m.venue_symbol, base, quote, price, s AS spread_bps, vol AS volume_24h_usd, rate FROM (SELECT *, coalesce(nullif(last,0),nullif(close,0)) AS price, "
    "10000*(ask-bid)/(0.5*(bid+ask)) AS s FROM tickers) t JOIN markets m USING (market_order) JOIN fx ON currency=quote, LATERAL (SELECT coalesce(quote_volume*rate, base_volume*price*rate, 0) AS vol) "
    f"WHERE NOT swap AND list_contains({ALLOWED.replace('venue', 'm.venue')}, quote) AND price >= 900.5 AND s <= 8 AND vol >= 500000"
)


def screened(spark, folder):
    return mk.screen_universe(views.markets(spark, folder), views.tickers(spark, folder), rates(spark, folder), VENUE_QUOTES, 500_000.0, 8.0, 900.5)


@query("B13_screen_universe", with_views("tickers fx_ticks", "SELECT symbol, venue, venue_symbol, base, quote, round(price,9) AS price, round(spread_bps,9) AS spread_bps, round(volume_24h_usd,2) AS volume_24h_usd, round(rate,9) AS rate FROM scr", **RATES, scr=SCREEN))
def _(spark, folder):
    got = screened(spark, folder)
    return got.withColumns({c: rounded(c, 9) for c in ("price", "spread_bps", "rate")} | {"volume_24h_usd": rounded("volume_24h_usd", 2)})


@query("C06_ticker_join", with_views("tickers", "SELECT venue, venue_symbol, market_order, last FROM markets LEFT JOIN (SELECT market_order, last FROM tickers WHERE last IS NOT NULL) USING (market_order)"))
def _(spark, folder):
    t = views.tickers(spark, folder).where(F.col("last").isNotNull()).select("venue", "venue_symbol", "market_order", "last")
    return views.markets(spark, folder).select("venue", "venue_symbol", "market_order").join(t, ["venue", "venue_symbol", "market_order"], "left")


@query("C07_quote_rates", with_views("tickers fx_ticks", "SELECT market_order, quote, round(rate,9) AS rate FROM markets JOIN fx ON currency = quote", **RATES))
def _(spark, folder):
    r = rates(spark, folder).select(F.col("currency").alias("quote"), rounded("rate", 9).alias("rate"))
    return views.markets(spark, folder).select("market_order", "quote").join(r, "quote")


IMPACT = (
    "SELECT venue_symbol, CASE WHEN filled >= need*0.999 AND vwap <= ba*1.25 THEN 10000*(vwap-mid)/mid END AS impact_bps FROM (SELECT venue_symbol, any_value(need) AS need, any_value(ba) AS ba, any_value((bb+ba)/2) AS mid, "
    "sum(take) AS filled, sum(take)/sum(take/price) AS vwap FROM (SELECT *, CASE WHEN prev < need*0.999 THEN least(price*size, need-prev) ELSE 0 END AS take FROM (SELECT l.venue_symbol, level, price, size, bb, ba, need, "
    "coalesce(sum(price*size) OVER (PARTITION BY l.venue_symbol ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS prev FROM book_levels l JOIN best USING (venue_symbol) WHERE side='ask')) GROUP BY 1)"
)


def book_ctes(notional: str):
    return {
        "best": f"SELECT venue_symbol, max(price) FILTER (WHERE side='bid') AS bb, min(price) FILTER (WHERE side='ask') AS ba, {notional} AS need FROM book_levels GROUP BY 1",
        "imp": IMPACT,
    }


@query("H01_book_impact", with_views("book_levels", "SELECT b.venue_symbol, round(impact_bps,4) AS impact_bps FROM best b LEFT JOIN imp USING (venue_symbol)", **book_ctes("60000/1.5")))
def _(spark, folder):
    b = views.books(spark, folder)
    return b.select("venue_symbol", rounded(bk.book_impact_bps("bids", "asks", 60000.0, F.lit(1.5)), 4).alias("impact_bps"))


@query("C08_impact_screen", with_views("book_levels", "SELECT venue_symbol, round(impact_bps,4) AS impact_bps FROM imp WHERE impact_bps <= 9100", **book_ctes("60000/(1.0::DOUBLE+CAST(venue_symbol AS BIGINT) % 10)")))
def _(spark, folder):
    c = views.table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("venue_symbol"), (1.0 + F.col("s_suppkey") % 10).alias("rate"))
    return bk.impact_screen(c, views.books(spark, folder), 60000.0, 9100.0).select("venue_symbol", rounded("impact_bps", 4).alias("impact_bps"))


@query(
    "H02_book_fill",
    with_views(
        "book_levels",
        "SELECT venue_symbol, side, CASE WHEN filled >= qty THEN 1 ELSE 0 END AS ok, round(CASE WHEN filled >= qty THEN cost/filled END,4) AS vwap, round(CASE WHEN filled >= qty THEN mid END,4) AS mid, round(CASE WHEN filled >= qty THEN abs(cost/filled-mid)/mid*10000 END,3) AS slip_bps FROM "
        "(SELECT venue_symbol, CASE side WHEN 'ask' THEN 'buy' ELSE 'sell' END AS side, any_value(qty) AS qty, any_value(mid) AS mid, sum(take) AS filled, sum(take*price) AS cost FROM (SELECT *, greatest(0, least(size, qty - prev)) AS take FROM (SELECT l.venue_symbol, side, level, price, size, (bb+ba)/2 AS mid, "
        "30000/(CASE WHEN side='ask' THEN ba ELSE bb END) AS qty, coalesce(sum(size) OVER (PARTITION BY l.venue_symbol, side ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS prev FROM book_levels l JOIN best USING (venue_symbol))) GROUP BY 1,2)",
        **book_ctes("0"),
    ),
)
def _(spark, folder):
    b = views.books(spark, folder).select("*", F.explode(F.array(F.lit("buy"), F.lit("sell"))).alias("side"))
    f = b.select("venue_symbol", "side", bk.book_fill_vwap("bids", "asks", 30000.0, "side").alias("f"))
    return f.select("venue_symbol", "side", F.col("f.ok").alias("ok"), rounded("f.vwap", 4).alias("vwap"), rounded("f.mid", 4).alias("mid"), rounded("f.slip_bps", 3).alias("slip_bps"))


@query(
    "H03_orderflow_features",
    with_views(
        "book_levels",
        "SELECT venue_symbol, round((ba-bb)/bb*10000,4) AS of_spread_bps, tb+ta AS of_depth, round((tb-ta)/(tb+ta),6)+0.0::DOUBLE AS of_imbalance, round(((bb*ta+ba*tb)/(tb+ta)-(bb+ba)/2)/((bb+ba)/2),6)+0.0::DOUBLE AS of_microprice_dev FROM best JOIN "
        "(SELECT venue_symbol, sum(size) FILTER (WHERE side='bid') AS tb, sum(size) FILTER (WHERE side='ask') AS ta FROM book_levels WHERE level <= 5 GROUP BY 1) USING (venue_symbol)",
        **book_ctes("0"),
    ),
)
def _(spark, folder):
    f = bk.orderflow_features(views.books(spark, folder), 5)
    return f.select("venue_symbol", rounded("of_spread_bps", 4).alias("of_spread_bps"), "of_depth", rounded("of_imbalance").alias("of_imbalance"), rounded("of_microprice_dev").alias("of_microprice_dev"))


@query("H04_top_levels", with_views("book_levels", "SELECT venue_symbol, side, level, price, size FROM book_levels WHERE level <= 3"))
def _(spark, folder):
    b = views.books(spark, folder)
    sides = F.array(*(F.struct(F.lit(s).alias("side"), bk.top_levels(c, 3).alias("levels")) for s, c in (("bid", "bids"), ("ask", "asks"))))
    both = b.select("venue_symbol", F.inline(sides)).select("venue_symbol", "side", F.posexplode("levels"))
    return both.select("venue_symbol", "side", (F.col("pos") + 1).alias("level"), "col.price", "col.size")


@query(
    "B17_resolve_timeframe",
    "SELECT o.venue, o.timeframe, CASE WHEN o.venue = 'P' OR o.timeframe IN ('1m','1h') THEN o.timeframe WHEN o.timeframe = '4h' AND o.venue = 'O' THEN '1h' END AS resolved, n FROM (SELECT o_orderstatus AS venue, CASE (o_orderkey % 4) WHEN 0 THEN '1m' WHEN 1 THEN '1h' WHEN 2 THEN '4h' ELSE '1d' END AS timeframe, count(*) AS n FROM orders GROUP BY 1,2) o",
)
def _(spark, folder):
    tf = F.element_at(F.array(*(F.lit(t) for t in ("1m", "1h", "4h", "1d"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    req = views.table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("venue"), tf.alias("timeframe")).agg(F.count(F.lit(1)).alias("n"))
    supported = spark.createDataFrame([(v, t) for v in ("O", "F") for t in ("1m", "1h")], "venue string, timeframe string")
    alias = spark.createDataFrame([("O", "4h", "1h"), ("F", "4h", "6h")], "venue string, timeframe string, alias string")
    return mk.resolve_timeframe(req, supported, alias)


PLAN = {
    "g": "SELECT DISTINCT upper(split_part(venue_symbol,'/',1)) AS base FROM (SELECT * FROM tickers WHERE percentage IS NOT NULL ORDER BY percentage DESC, venue, venue_symbol, market_order LIMIT 40)",
    "s": "SELECT DISTINCT base || '_USD_SPOT' AS symbol FROM markets",
    "q": "SELECT DISTINCT 'B' || s_suppkey || '_USD_SPOT' AS symbol FROM supplier",
    "pl": (
        "SELECT DISTINCT v AS venue, timeframe, symbol FROM (SELECT symbol, unnest(CASE WHEN EXISTS (SELECT 1 FROM g WHERE starts_with(symbol, base)) THEN ['1m','5m'] ELSE ['1h','1d'] END) AS timeframe FROM s "
        "UNION SELECT symbol, unnest(['1m','5m','1h','1d']) FROM q), (SELECT unnest(['v0','v1']) AS v)"
    ),
}


def plan(spark, folder):
    sym = views.markets(spark, folder).select(F.concat("base", F.lit("_USD_SPOT")).alias("symbol"))
    req = views.table(spark, folder, "supplier").select(F.concat(F.lit("B"), "s_suppkey", F.lit("_USD_SPOT")).alias("symbol"))
    return mk.harvest_plan(sym, mk.top_gainers(views.tickers(spark, folder), 40), ["1h", "1d", "2h"], ["1m", "5m"], ["v0", "v1"], req)


@query("C11_harvest_plan", with_views("tickers", "SELECT * FROM pl", **PLAN))
def _(spark, folder):
    return plan(spark, folder)


@query("C12_filter_available", with_views("tickers", "SELECT * FROM pl WHERE symbol IN (SELECT base || '_USD_SPOT' FROM markets WHERE quote='USD' AND NOT (venue='v1' AND base LIKE 'X%'))", **PLAN))
def _(spark, folder):
    m = views.markets(spark, folder).where(F.col("quote") == "USD").select("venue", F.concat("base", F.lit("_USD_SPOT")).alias("symbol"))
    suppressed = m.where((F.col("venue") == "v1") & F.col("symbol").startswith("X"))
    return mk.filter_available(plan(spark, folder), suppressed, m)


@query("C13_missing_in_target", with_views("bars_venue", "SELECT venue, symbol, a AS source_rows, b AS target_rows, b = 0 AS bootstrap FROM (SELECT venue, symbol, count(*) FILTER (WHERE timeframe='1h') AS a, count(*) FILTER (WHERE timeframe='6h') AS b FROM lk GROUP BY 1,2) WHERE (a > 0 AND b = 0) OR (b > 0 AND b < 100)", **LAKE, lk="SELECT * FROM lake WHERE NOT (symbol='view' AND timeframe='6h') AND NOT (symbol='click' AND ts > TIMESTAMP '2024-01-20')"))
def _(spark, folder):
    b = lake_bars(spark, folder)
    b = b.where(~((F.col("symbol") == "view") & (F.col("timeframe") == "6h")) & ~((F.col("symbol") == "click") & (F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz"))))
    return mk.missing_in_target(b, "1h", "6h", 100)


@query("C14_reconcile_checkpoints", with_views("bars_venue", "SELECT venue, timeframe, symbol, c AS old_ms, t - w AS new_ms, (t-c)//w AS lag_bars FROM (SELECT venue, timeframe, symbol, epoch_ms(max(ts)) AS t, epoch_ms(max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-28')) AS c, CASE timeframe WHEN '1h' THEN 3600000 ELSE 21600000 END AS w FROM lake GROUP BY 1,2,3) WHERE t > c AND (t-c)//w BETWEEN 11 AND 71", **LAKE))
def _(spark, folder):
    b = lake_bars(spark, folder)
    old = lake.bar_tails(b.where(F.col("ts") < F.lit("2024-01-28").cast("timestamp_ntz")))
    ck = old.select("venue", "timeframe", "symbol", F.floor(epoch_us("last_ts") / 1000).alias("checkpoint_ms"))
    return mk.reconcile_checkpoints(ck, lake.bar_tails(b), 11, 71)


@query("C21_news_scores", "SELECT upper(event_type) AS ticker, ts, round(value/500,6) AS score FROM events WHERE ts >= TIMESTAMP '2024-01-30 17:30:00' AND value/500 >= 0.02 AND event_type IN ('click','view','error')")
def _(spark, folder):
    news = views.table(spark, folder, "events").select("ts", F.array("event_type").alias("tickers"), (F.col("value") / 500).alias("score"))
    ask = views.table(spark, folder, "events").select(F.col("event_type").alias("ticker")).distinct().where(F.col("ticker").isin("click", "view", "error"))
    return mk.news_scores(news, ask, NOW, 6, 0.02).withColumn("score", rounded("score"))


@query("J_scalar_functions", "SELECT o_orderkey, upper(o_orderpriority) || '_USD_SPOT' AS canonical, split_part(o_orderpriority,'-',2) AS word, year(o_orderdate) AS y, month(o_orderdate) AS m, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate,'%Y-%m-%d') AS day, o_orderpriority LIKE '1%' AS urgent, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders")
def _(spark, folder):
    o = views.table(spark, folder, "orders")
    return o.select(
        "o_orderkey", mk.canonical("o_orderpriority", F.lit("usd")).alias("canonical"), F.split("o_orderpriority", "-", 2)[1].alias("word"),
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").startswith("1").alias("urgent"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"),
    )
