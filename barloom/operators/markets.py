"""Symbols, venues, currency rates and the universe screen (B-12, B-13, B-17, C-01 ... C-08, C-11 ... C-14, C-21, D-17, D-18)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import TIMEFRAME_MS, canonical, col
from barloom.sources.lake import keep_first

# Quote currencies accepted where a venue has no list of its own, and the dollar-pegged coins.
GLOBAL_QUOTES = ("USD", "USDC", "USDT")
STABLECOINS = ("USDT", "USDC", "DAI", "FDUSD", "TUSD", "PYUSD")


def _text_map(values: Mapping[str, Sequence[str]]) -> Column:
    """Settings (a few venues, a few names each) as a literal map."""
    if not values:
        return F.lit(None).cast("map<string,array<string>>")
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.array(*(F.lit(q) for q in v)))))


def allowed_quotes(venue: str | Column, by_venue: Mapping[str, Sequence[str]], everywhere: Sequence[str] = GLOBAL_QUOTES) -> Column:
    """C-03: a venue's own quote list, else the global one."""
    fallback = F.array(*(F.lit(q) for q in everywhere))
    return F.coalesce(F.try_element_at(_text_map(by_venue), col(venue)), fallback) if by_venue else fallback


def normalize_base(df: DataFrame, aliases: DataFrame, base: str = "base") -> DataFrame:
    """C-02: replace a known alias by its canonical base; ``aliases`` has base and alias."""
    known = aliases.groupBy(F.upper("alias").alias("_alias")).agg(F.max(F.upper("base")).alias("_canon"))
    joined = df.join(known, F.upper(base) == F.col("_alias"), "left")
    return joined.withColumn(base, F.coalesce("_canon", F.upper(base))).drop("_alias", "_canon")


def resolve_symbols(
    requests: DataFrame, markets: DataFrame, aliases: DataFrame, static_map: DataFrame,
    quotes_by_venue: Mapping[str, Sequence[str]], quotes: Sequence[str] = GLOBAL_QUOTES,
) -> DataFrame:
    """C-01: venue symbol of (venue, base, quote), spot only; NULL when nothing fits.

    Tier 1 the exact pair under the base or one of its aliases, tier 2 the static map, tier 3 the first listed
    market of the base in an allowed quote.  Every tier is an equi-join; the best tier wins in one aggregate.
    """
    req = requests.select("venue", F.upper("base").alias("base"), F.upper("quote").alias("quote")).distinct()
    req = req.withColumn("canonical", canonical("base", "quote"))
    spot = keep_first(
        markets.where(F.coalesce("spot", F.lit(True))).select("venue", "venue_symbol", "base", "quote", "market_order"),
        ["venue", "venue_symbol"], ["market_order"],
    )
    named = aliases.select(F.upper("base").alias("base"), F.upper("alias").alias("name"), F.col("alias_pos").cast("int").alias("name_pos"))
    own = req.select("base").distinct().select("base", F.col("base").alias("name"), F.lit(0).alias("name_pos"))
    names = req.join(own.unionByName(named), "base")
    rank = lambda t, a, m: F.struct(F.lit(t).alias("tier"), a.alias("a"), m.alias("m"))
    key = ["venue", "canonical"]
    found = spot.select("venue", "venue_symbol", "market_order")
    tier1 = names.withColumn("venue_symbol", F.concat_ws("/", "name", "quote")).join(found, ["venue", "venue_symbol"]).select(
        *key, "venue_symbol", rank(1, F.col("name_pos"), F.col("market_order")).alias("r")
    )
    tier2 = req.join(static_map, key).join(found, ["venue", "venue_symbol"]).select(
        *key, "venue_symbol", rank(2, F.lit(0), F.col("market_order")).alias("r")
    )
    listed = spot.where(F.array_contains(allowed_quotes("venue", quotes_by_venue, quotes), F.upper("quote")))
    tier3 = names.join(listed.select("venue", F.upper("base").alias("name"), "venue_symbol", "market_order"), ["venue", "name"]).select(
        *key, "venue_symbol", rank(3, F.lit(0), F.col("market_order")).alias("r")
    )
    best = tier1.unionByName(tier2).unionByName(tier3).groupBy(*key).agg(
        F.min_by("venue_symbol", "r").alias("venue_symbol"), F.min("r.tier").alias("tier")
    )
    return req.select(*key).join(best, key, "left")


def catalog_snapshot(
    markets: DataFrame, aliases: DataFrame, quotes_by_venue: Mapping[str, Sequence[str]], quotes: Sequence[str] = GLOBAL_QUOTES,
    derivatives: bool = False,
) -> DataFrame:
    """C-04: listed markets by canonical key; the last listing of a key wins."""
    m = markets.where(F.coalesce("spot", F.lit(False)) | F.lit(derivatives))
    m = m.where((F.length("base") > 0) & (F.length("quote") > 0)).withColumns({"base": F.upper("base"), "quote": F.upper("quote")})
    m = m.where(~F.col("spot") | F.array_contains(allowed_quotes("venue", quotes_by_venue, quotes), F.col("quote")))
    m = normalize_base(m.withColumn("_listed", F.col("base")), aliases, "_listed")
    kind = F.when(F.col("spot"), "SPOT").otherwise("DERIV")
    m = m.withColumn("canonical", canonical("_listed", "quote", kind))
    last = F.max_by(F.struct("venue_symbol", "base", "quote", "spot"), "market_order").alias("_m")
    return m.groupBy("venue", "canonical").agg(last).select("venue", "canonical", "_m.*")


def catalog_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """C-05: spot listings that appeared and disappeared."""
    key = ["venue", "canonical"]
    added = current.where("spot").select(*key).join(previous.select(*key), key, "left_anti").withColumn("change", F.lit("added"))
    gone = previous.where("spot").select(*key).join(current.select(*key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(gone)


def last_price() -> Column:
    """Last trade, or close when there is none."""
    return F.coalesce(F.nullif("last", F.lit(0.0)), F.nullif("close", F.lit(0.0)))


def usd_rates(ticks: DataFrame, order: str = "tick_order") -> DataFrame:
    """D-17: dollars per currency from X/USD and USD/X ticks; the latest tick wins; USD itself is 1."""
    pair = F.split("venue_symbol", "/")
    t = ticks.select(pair[0].alias("a"), pair[1].alias("b"), last_price().alias("p"), F.col(order).alias("_o")).where(F.col("p").isNotNull())
    quoted = t.where((F.col("b") == "USD") | (F.col("a") == "USD")).select(
        F.when(F.col("b") == "USD", F.col("a")).otherwise(F.col("b")).alias("currency"),
        F.when(F.col("b") == "USD", F.col("p")).otherwise(1.0 / F.col("p")).alias("rate"), "_o",
    )
    latest = quoted.where(F.col("currency") != "USD").groupBy("currency").agg(F.max_by("rate", "_o").alias("rate"))
    usd = ticks.sparkSession.createDataFrame([("USD", 1.0)], "currency string, rate double")
    return latest.unionByName(usd)


def stable_parity(rates: DataFrame, warn_bps: float = 100.0, coins: Sequence[str] = STABLECOINS) -> DataFrame:
    """D-17: dollar-pegged currencies further from 1 than the tolerance."""
    off = F.abs(F.col("rate") - 1.0)
    return rates.where(F.col("currency").isin(list(coins)) & (off > warn_bps / 10000.0)).select("currency", "rate", off.alias("off_parity"))


def top_gainers(tickers: DataFrame, n: int) -> DataFrame:
    """D-18: distinct bases among the n tickers that rose most (the limit comes before the distinct)."""
    t = tickers.where(F.col("venue_symbol").contains("/") & F.col("percentage").isNotNull())
    top = t.orderBy(F.desc("percentage"), "venue", "venue_symbol", "market_order").limit(n)
    return top.select(F.upper(F.split("venue_symbol", "/")[0]).alias("base")).distinct()


def spread_bps(bid: str | Column = "bid", ask: str | Column = "ask") -> Column:
    """B-12: quoted spread over mid in basis points; NULL when a side is missing or not positive."""
    b, a = col(bid), col(ask)
    return F.when((b > 0) & (a > 0), 10000.0 * (a - b) / (0.5 * (b + a)))


def screen_universe(
    markets: DataFrame, tickers: DataFrame, rates: DataFrame, quotes_by_venue: Mapping[str, Sequence[str]],
    min_volume_usd: float, max_spread_bps: float, min_price: float = 0.0, quotes: Sequence[str] = GLOBAL_QUOTES,
    derivatives: bool = False, stable: Sequence[str] = STABLECOINS, exclude_stable_pairs: bool = True,
) -> DataFrame:
    """B-13 (with C-06, C-07): tradable instruments with price, dollar volume and spread.

    Market-only predicates are applied before the joins; tickers join on (venue, venue_symbol, listing), rates on
    the quote currency.
    """
    m = markets.where(F.col("venue_symbol").contains("/"))
    if not derivatives:
        m = m.where(~F.coalesce("swap", F.lit(False)))
    m = m.where(F.array_contains(allowed_quotes("venue", quotes_by_venue, quotes), F.col("quote")))
    if exclude_stable_pairs:
        m = m.where(~(F.col("base").isin(list(stable)) & F.col("quote").isin(list(stable))))
    t = tickers.select("venue", "venue_symbol", "market_order", last_price().alias("price"), "bid", "ask", "quote_volume", "base_volume")
    j = m.join(t.where(F.col("price") >= min_price), ["venue", "venue_symbol", "market_order"]).join(
        rates.select(F.col("currency").alias("quote"), "rate"), "quote"
    )
    volume = F.coalesce(F.col("quote_volume") * F.col("rate"), F.col("base_volume") * F.col("price") * F.col("rate"), F.lit(0.0))
    j = j.withColumns({"volume_24h_usd": volume, "spread_bps": spread_bps()})
    return j.where((F.col("volume_24h_usd") >= min_volume_usd) & (F.col("spread_bps") <= max_spread_bps)).select(
        canonical("base", "quote").alias("symbol"), "venue", "venue_symbol", "base", "quote", "price", "spread_bps", "volume_24h_usd", "rate"
    )


def resolve_timeframe(requests: DataFrame, supported: DataFrame, alias: DataFrame) -> DataFrame:
    """B-17: the timeframe itself when the venue has it, else its alias when the venue has that, else NULL.

    Venues without any entry in ``supported`` keep the requested timeframe.
    """
    known = supported.select("venue").distinct().withColumn("_known", F.lit(True))
    native = supported.select("venue", "timeframe", F.lit(True).alias("_native")).distinct()
    via = alias.select("venue", "timeframe", "alias").join(
        supported.select("venue", F.col("timeframe").alias("alias")).distinct(), ["venue", "alias"]
    ).groupBy("venue", "timeframe").agg(F.min("alias").alias("alias"))
    j = requests.join(known, "venue", "left").join(native, ["venue", "timeframe"], "left").join(via, ["venue", "timeframe"], "left")
    keep = F.col("_known").isNull() | F.coalesce("_native", F.lit(False))
    return j.withColumn("resolved", F.when(keep, F.col("timeframe")).otherwise(F.col("alias"))).drop("_known", "_native", "alias")


def has_prefix(df: DataFrame, prefixes: DataFrame, text: str, prefix: str, name: str) -> DataFrame:
    """Flag rows whose text starts with any of the prefixes: an equi-join on the text's own prefixes, no theta join."""
    starts = df.select(text).distinct().select(
        text, F.explode(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(F.col(text), F.lit(1), i))).alias("_p")
    )
    hits = starts.join(prefixes.select(F.col(prefix).alias("_p")).distinct(), "_p", "left_semi").select(text).distinct()
    return df.join(hits.withColumn(name, F.lit(True)), text, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def harvest_plan(
    symbols: DataFrame, gainers: DataFrame, core: Sequence[str], moonshot: Sequence[str], venues: Sequence[str], requested: DataFrame | None = None
) -> DataFrame:
    """C-11: (venue, timeframe, symbol) to fetch - lane timeframes per symbol, every timeframe for requested ones."""
    every = sorted({t for t in (*core, *moonshot) if t in TIMEFRAME_MS})
    tagged = has_prefix(symbols.select("symbol").distinct(), gainers, "symbol", "base", "_moon")
    lit = lambda xs: F.array(*(F.lit(x) for x in xs if x in TIMEFRAME_MS))
    plan = tagged.select("symbol", F.explode(F.when(F.col("_moon"), lit(moonshot)).otherwise(lit(core))).alias("timeframe"))
    if requested is not None:
        plan = plan.unionByName(requested.select("symbol", F.explode(lit(every)).alias("timeframe")))
    return plan.distinct().select(F.explode(F.array(*(F.lit(v) for v in venues))).alias("venue"), "timeframe", "symbol")


def filter_available(plan: DataFrame, suppressed: DataFrame, resolved: DataFrame) -> DataFrame:
    """C-12: plan rows whose symbol at least one venue resolves and does not suppress."""
    usable = resolved.select("venue", "symbol").join(suppressed.select("venue", "symbol"), ["venue", "symbol"], "left_anti")
    return plan.join(usable.select("symbol").distinct(), "symbol", "left_semi")


def missing_in_target(bars: DataFrame, source: str, target: str, min_rows: int) -> DataFrame:
    """C-13: series with source bars whose target timeframe is absent or has fewer than ``min_rows`` bars."""
    key = ["venue", "symbol"]
    counts = bars.where(F.col("timeframe").isin(source, target)).groupBy(*key).agg(
        F.count_if(F.col("timeframe") == source).alias("source_rows"), F.count_if(F.col("timeframe") == target).alias("target_rows")
    )
    shallow = F.col("target_rows") < min_rows
    return counts.where(((F.col("source_rows") > 0) & (F.col("target_rows") == 0)) | ((F.col("target_rows") > 0) & shallow)).withColumn(
        "bootstrap", F.col("target_rows") == 0
    )


def reconcile_checkpoints(checkpoints: DataFrame, tails: DataFrame, min_lag_bars: int, max_forward_bars: int) -> DataFrame:
    """C-14: move lagging checkpoints (milliseconds) to one bar before the stored tail; never backwards."""
    key = ["venue", "timeframe", "symbol"]
    width = F.create_map(*(F.lit(x) for kv in TIMEFRAME_MS.items() for x in kv))
    tail_ms = F.unix_millis(F.col("last_ts").cast("timestamp"))
    tf_ms = F.try_element_at(width, F.col("timeframe")).cast("long")
    j = checkpoints.join(tails, key).withColumns({"_tail": tail_ms, "_tf": tf_ms})
    lag = F.floor((F.col("_tail") - F.col("checkpoint_ms")) / F.col("_tf"))
    return j.withColumn("lag_bars", lag).where(
        F.col("_tf").isNotNull() & (F.col("_tail") > F.col("checkpoint_ms")) & F.col("lag_bars").between(min_lag_bars, max_forward_bars)
    ).select(*key, F.col("checkpoint_ms").alias("old_ms"), (F.col("_tail") - F.col("_tf")).alias("new_ms"), "lag_bars")


def news_scores(news: DataFrame, tickers: DataFrame, now, window_hours: float = 6, min_score: float = -1.0) -> DataFrame:
    """C-21: scored items per requested ticker inside the time window."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(float(window_hours * 3600)))
    recent = news.where((F.col("ts") >= cutoff) & (F.col("score") >= min_score))
    return recent.select(F.explode("tickers").alias("ticker"), "ts", "score").withColumn("ticker", F.upper("ticker")).join(
        tickers.select(F.upper("ticker").alias("ticker")).distinct(), "ticker", "left_semi"
    )
