"""The derived tables of ``barloom.sources.views`` written once more as SQL, for the result checks."""

_BIN = "time_bucket(INTERVAL {step}, ts, TIMESTAMP '1970-01-01')"


def _bars(keys: str, source: str, step: str) -> str:
    return (
        f"SELECT {keys}, {_BIN.format(step=step)} AS ts, arg_min(price, ts) AS open, max(price) AS high, "
        f"min(price) AS low, arg_max(price, ts) AS close, sum(price) AS volume "
        f"FROM {source} GROUP BY {keys}, {_BIN.format(step=step)}"
    )


DAY = "(CAST(floor(epoch(ts)/86400) AS BIGINT) - 19723)"

VIEWS = {
    "ticks": "SELECT event_type AS symbol, ts, value AS price, event_id FROM events",
    "bars_1h": _bars("symbol", "ticks", "'1 hour'"),
    "user_ticks": "SELECT CAST(user_id AS VARCHAR) AS symbol, ts, value AS price FROM events",
    "bars_user": _bars("symbol", "user_ticks", "'6 hours'"),
    "venue_ticks": "SELECT 'v' || (user_id % 2) AS venue, event_type AS symbol, ts, value AS price FROM events",
    "bars_venue": _bars("venue, symbol", "venue_ticks", "'1 hour'"),
    "hour_rows": (
        "SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS ts, value AS open, "
        "value*1.5::DOUBLE AS high, value*0.5::DOUBLE AS low, value AS close, 1.0::DOUBLE AS volume, event_id FROM events"
    ),
    "trades": (
        "SELECT CAST(user_id AS VARCHAR) AS formula_id, event_type AS symbol, ts, (value - 50.0)/100.0 AS pnl FROM events"
    ),
    "alpha_returns": (
        "SELECT CAST(o_custkey AS VARCHAR) AS alpha_id, o_orderdate AS ts, o_orderkey AS trade_id, "
        "(o_totalprice - 250000.0)/1e6 AS ret FROM orders"
    ),
    "alpha_dim": (
        "SELECT CAST(c_custkey AS VARCHAR) AS alpha_id, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'core' "
        "ELSE 'moonshot' END AS lane, CAST(c_nationkey AS BIGINT) AS portfolio_id, "
        "['S' || (c_custkey % 40), 'S' || (c_custkey % 7)] AS universe, c_acctbal AS prior_budget FROM customer"
    ),
    "alpha_stats": (
        "SELECT d.*, s.n_trades, coalesce(s.m / nullif(s.sd,0), 0) AS sharpe, coalesce(s.m / nullif(s.down,0), 0) AS sortino, "
        "s.win_rate, s.mdd FROM alpha_dim d JOIN (SELECT alpha_id, count(*) AS n_trades, avg(ret) AS m, stddev_samp(ret) AS sd, "
        "sqrt(avg(pow(least(ret,0.0),2))) AS down, avg(CASE WHEN ret>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate, "
        "max(abs(least(ret,0.0))) AS mdd FROM alpha_returns GROUP BY alpha_id) s USING (alpha_id)"
    ),
    "markets": (
        "SELECT 'v' || (p_size % 2) AS venue, base || '/' || quote AS venue_symbol, base, quote, p_type <> 'LARGE' AS spot, "
        "p_type = 'LARGE' AS swap, p_partkey AS market_order FROM (SELECT *, (CASE WHEN p_type IN ('PROMO','SMALL') THEN 'X' "
        "ELSE 'B' END) || (p_partkey // 2) AS base, ['USD','USDT','EUR'][p_size % 3 + 1] AS quote FROM part)"
    ),
    "tickers": (
        "SELECT market_order, venue, venue_symbol, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS last, "
        "p_retailprice AS close, p_retailprice - p_size/100.0::DOUBLE AS bid, CASE WHEN p_size % 11 <> 0 THEN "
        "p_retailprice + p_size/100.0::DOUBLE END AS ask, CASE WHEN p_size % 10 <> 0 THEN qty*p_retailprice END AS quote_volume, "
        "qty AS base_volume, CASE WHEN p_size % 13 <> 0 THEN (p_size*37 % 101 - 40)/4.0::DOUBLE END AS percentage "
        "FROM markets JOIN part ON p_partkey = market_order LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS qty "
        "FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"
    ),
    "fx_ticks": (
        "SELECT CASE c_custkey % 3 WHEN 0 THEN 'USDT/USD' WHEN 1 THEN 'USD/EUR' ELSE 'DAI/USD' END AS venue_symbol, "
        "CASE WHEN c_custkey % 3 = 1 THEN 0.9 + c_acctbal/1e6 ELSE 1.0 + c_acctbal/1e6 END AS last, "
        "NULL::DOUBLE AS close, c_custkey AS tick_order FROM customer"
    ),
    "book_prices": (
        "SELECT CAST(l_suppkey AS VARCHAR) AS venue_symbol, floor(l_extendedprice/l_quantity*100)/100 AS price, "
        "l_quantity AS size FROM lineitem"
    ),
    "book_levels": (
        "SELECT venue_symbol, side, level, price, size FROM (SELECT *, row_number() OVER (PARTITION BY venue_symbol, side "
        "ORDER BY CASE WHEN side='bid' THEN -price ELSE price END) AS level FROM (SELECT a.venue_symbol, a.price, a.size, "
        "CASE WHEN a.price < m.mid THEN 'bid' ELSE 'ask' END AS side FROM (SELECT venue_symbol, price, sum(size) AS size "
        "FROM book_prices GROUP BY 1,2) a JOIN (SELECT venue_symbol, (min(price)+max(price))/2 AS mid FROM book_prices "
        "GROUP BY 1) m USING (venue_symbol)))"
    ),
    "coverage": (
        "SELECT venue, '1h' AS timeframe, symbol, 600::BIGINT AS expected, count(*) AS actual, "
        "round(count(*)/600.0::DOUBLE, 4) AS coverage FROM bars_venue WHERE ts < TIMESTAMP '2024-01-21' GROUP BY venue, symbol"
    ),
    "formulas": (
        "SELECT p_partkey AS formula_no, CASE p_size % 3 WHEN 0 THEN a WHEN 1 THEN '[' || a || ',\"AND\",' || b || ']' "
        "ELSE '[[' || a || ',\"AND\",' || b || '],\"OR\",' || c || ']' END AS formula_json FROM (SELECT *, "
        "'[\"' || f[p_partkey % 5 + 1] || '\",\">\",' || CAST((p_size-25)/2.0::DOUBLE AS VARCHAR) || ']' AS a, "
        "'[\"' || f[(p_partkey//5) % 5 + 1] || '\",\"<\",' || CAST(p_size/8.0::DOUBLE AS VARCHAR) || ']' AS b, "
        "'[\"' || f[(p_partkey//25) % 5 + 1] || '\",\">=\",0.5]' AS c FROM (SELECT *, "
        "['return_1p','zscore_20','volatility_10','roc_5','legacy_x'] AS f FROM part))"
    ),
    "cycle_log": (
        f"SELECT {DAY} AS cycle, round(avg(CASE WHEN value>50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS survivor_density, "
        f"count(*)/10.0::DOUBLE AS median_trades, round(max(value),6) AS best_fitness FROM events GROUP BY 1"
    ),
    "feature_log": f"SELECT {DAY} AS cycle, event_type AS feature, max(value) > 180 AS active FROM events GROUP BY 1,2",
    "equity": (
        "SELECT o_orderdate AS ts, sum(CAST(round((o_totalprice-250000.0)*100) AS BIGINT))::BIGINT AS pnl_cents "
        "FROM orders GROUP BY 1"
    ),
}

NEEDS = {
    "bars_1h": ["ticks"],
    "bars_user": ["user_ticks"],
    "bars_venue": ["venue_ticks"],
    "alpha_stats": ["alpha_dim", "alpha_returns"],
    "tickers": ["markets"],
    "book_levels": ["book_prices"],
    "coverage": ["bars_venue"],
}


def with_views(names: str, body: str, **extra: str) -> str:
    """``WITH`` chain of the named views, then ``extra`` CTEs in order, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({s})" for n, s in extra.items()]
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
