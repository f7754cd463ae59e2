"""Queries over features, signals and trade returns (families E, parts of B, C, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.formula import tree_id, with_formula_id
from barloom.functions.scalars import rounded
from barloom.operators import features as ft
from barloom.operators import population as pp
from barloom.operators import signals as sg
from barloom.operators.features import FeatureSpec
from barloom.operators.ordered import blocked, time_slot
from barloom.operators.bars import bar_slot
from barloom.plans.oracle_views import with_views
from barloom.plans.registry import query
from barloom.sources import views

FEE, SLIP = 0.001, 0.0005
SYM = ["symbol"]


def over(n: int, end: int = 0) -> str:
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 - end} PRECEDING AND {last})"


def full(x: str, n: int, agg: str) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {agg} {over(n)} END"


LAG = "OVER (PARTITION BY symbol ORDER BY ts)"


def base(source: str) -> str:
    """Bars with one-bar return, scaled squared range and the changes RSI needs."""
    prev = f"lag(close) {LAG}"
    return (
        f"SELECT *, close/nullif({prev},0) - 1 AS return_1p, pow(ln(high/nullif(low,0)),2)/(4*ln(2)) AS range2, "
        f"greatest(close-{prev},0.0) + 0*{prev} AS gain, greatest({prev}-close,0.0) + 0*{prev} AS loss FROM {source}"
    )


SQL = {
    "return_1p": "return_1p",
    "zscore_20": f"(close - {full('close', 20, 'avg(close)')}) / nullif({full('close', 20, 'stddev_samp(close)')}, 0)",
    "volatility_10": f"{full('return_1p', 10, 'stddev_samp(return_1p)')} * sqrt(10)",
    "volatility_20": f"{full('return_1p', 20, 'stddev_samp(return_1p)')} * sqrt(20)",
    "parkinson_vol_10": f"sqrt({full('range2', 10, 'avg(range2)')})",
    "sma_5": full("close", 5, "avg(close)"),
    "sma_20": full("close", 20, "avg(close)"),
    "roc_5": f"close / nullif(lag(close, 5) {LAG}, 0) - 1",
    "momentum_10p": f"close / nullif(lag(close, 10) {LAG}, 0) - 1",
    "rsi_14": f"100 - 100/(1 + ({full('gain', 14, 'avg(gain)')}) / nullif({full('loss', 14, 'avg(loss)')}, 0))",
    "close_vs_sma_50": f"close / ({full('close', 50, 'avg(close)')})",
    "close_vs_sma_50_excess": f"close / ({full('close', 50, 'avg(close)')}) - 1",
    "hod_sin": "sin(2*pi()*hour(ts)/24.0::DOUBLE)",
    "hod_cos": "cos(2*pi()*hour(ts)/24.0::DOUBLE)",
    "round_proximity": (
        "-least(abs(log10(greatest(close,1e-9)) - floor(log10(greatest(close,1e-9)))), "
        "abs(1 - (log10(greatest(close,1e-9)) - floor(log10(greatest(close,1e-9))))))"
    ),
}


def raw_sql(names, source: str = "base") -> str:
    return f"SELECT symbol, ts, open, high, low, close, volume, {', '.join(f'{SQL[n]} AS {n}' for n in names)} FROM {source}"


def lag_sql(names, source: str = "raw") -> str:
    cols = ", ".join(f"lag({n}) {LAG} AS {n}" for n in names)
    return f"SELECT symbol, ts, open, high, low, close, volume, {cols} FROM {source}"


def show(names, source: str) -> str:
    return f"SELECT symbol, ts, {', '.join(f'round({n}, 6) + 0.0::DOUBLE AS {n}' for n in names)} FROM {source}"


def register_feature(key: str, names: list[str], view: str, timeframe: str, spec: FeatureSpec) -> None:
    sql = with_views(view, show(names, "raw"), base=base(view), raw=raw_sql(names))

    @query(key, sql)
    def _(spark, folder):
        got = ft.build_features(getattr(views, view)(spark, folder), spec, timeframe, lag=False)
        return got.select("symbol", "ts", *(rounded(n).alias(n) for n in names))


for _key, _names, _spec in (
    ("E01_return_1p", ["return_1p"], FeatureSpec()),
    ("E02_zscore", ["zscore_20"], FeatureSpec(zscore=[20])),
    ("E03_volatility", ["volatility_10", "volatility_20"], FeatureSpec(volatility=[10, 20])),
    ("E04_parkinson_vol", ["parkinson_vol_10"], FeatureSpec(parkinson=[10])),
    ("E05_sma", ["sma_5", "sma_20"], FeatureSpec(sma=[5, 20])),
    ("E07_roc", ["roc_5"], FeatureSpec(roc=[5])),
    ("E08_hour_of_day", ["hod_sin", "hod_cos"], FeatureSpec()),
    ("E09_round_proximity", ["round_proximity"], FeatureSpec()),
    ("E15_rsi", ["rsi_14"], FeatureSpec(rsi=[14])),
    ("E16_close_vs_sma", ["close_vs_sma_50", "close_vs_sma_50_excess"], FeatureSpec(close_vs_sma=[50])),
):
    register_feature(_key, _names, "bars_1h", "1h", _spec)


def ema_sql(value: str, span: int, source: str) -> str:
    """Recursive average as a recursive CTE over the row number."""
    a = 2.0 / (span + 1)
    return (
        f"SELECT symbol, n, x AS y FROM {source} WHERE n = 1 UNION ALL "
        f"SELECT s.symbol, s.n, s.x * {a}::DOUBLE + e.y * (1 - {a}::DOUBLE) FROM ema e JOIN {source} s ON s.symbol = e.symbol AND s.n = e.n + 1"
    )


def with_ema(view: str, value: str, span: int, body: str) -> str:
    sql = with_views(view, body, num=f"SELECT symbol, ts, close, volume, {value} AS x, row_number() {LAG} AS n FROM {view}", ema=ema_sql(value, span, "num"))
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("E06_ema", with_ema("bars_1h", "close", 10, "SELECT symbol, ts, round(y,6) AS ema_10 FROM ema JOIN num USING (symbol, n)"))
def _(spark, folder):
    got = ft.build_features(views.bars_1h(spark, folder), FeatureSpec(ema=[10]), "1h", lag=False)
    return got.select("symbol", "ts", rounded("ema_10").alias("ema_10"))


@query("E17_volume_ema_ratio", with_ema("bars_1h", "volume", 20, "SELECT symbol, ts, round(volume/y,6) AS volume_ema_ratio_20 FROM ema JOIN num USING (symbol, n)"))
def _(spark, folder):
    got = ft.build_features(views.bars_1h(spark, folder), FeatureSpec(volume_ema_ratio=[20]), "1h", lag=False)
    return got.select("symbol", "ts", rounded("volume_ema_ratio_20").alias("volume_ema_ratio_20"))


MARKET = "SELECT b.*, quantile_cont(return_1p, 0.5) OVER (PARTITION BY ts) AS market_return FROM base b"


@query("C10_market_return", with_views("bars_1h", "SELECT ts, round(quantile_cont(return_1p, 0.5),6)+0.0::DOUBLE AS market_return FROM base GROUP BY ts", base=base("bars_1h")))
def _(spark, folder):
    got = ft.build_features(views.bars_1h(spark, folder), FeatureSpec(clock=False), "1h", lag=False)
    return ft.market_return(got).select("ts", rounded("market_return").alias("market_return"))


@query(
    "E10_market_beta",
    with_views("bars_1h", f"SELECT symbol, ts, round(CASE WHEN count(return_1p + market_return) {over(20)} = 20 THEN covar_samp(return_1p, market_return) {over(20)} / nullif(var_samp(market_return) {over(20)},0) END, 6)+0.0::DOUBLE AS beta_20 FROM m", base=base("bars_1h"), m=MARKET),
)
def _(spark, folder):
    got = ft.build_features(views.bars_1h(spark, folder), FeatureSpec(market_beta=[20], clock=False), "1h", lag=False)
    return got.select("symbol", "ts", rounded("beta_20").alias("beta_20"))


LAGGED = ["return_1p", "zscore_20", "volatility_10", "sma_5", "roc_5"]


@query("E11_lag_features", with_views("bars_1h", show(LAGGED, "lagged"), base=base("bars_1h"), raw=raw_sql(LAGGED), lagged=lag_sql(LAGGED)))
def _(spark, folder):
    spec = FeatureSpec(zscore=[20], volatility=[10], sma=[5], roc=[5], clock=False)
    got = ft.build_features(views.bars_1h(spark, folder), spec, "1h")
    return got.select("symbol", "ts", *(rounded(n).alias(n) for n in LAGGED))


ALL_BUILTIN = list(SQL)
ALL_SPEC = FeatureSpec(
    zscore=[20], volatility=[10, 20], parkinson=[10], sma=[5, 20], roc=[5], rsi=[14], close_vs_sma=[50],
    momentum=[10],
)


@query("E12_build_features", with_views("bars_user", show(ALL_BUILTIN, "lagged"), base=base("bars_user"), raw=raw_sql(ALL_BUILTIN), lagged=lag_sql(ALL_BUILTIN)))
def _(spark, folder):
    got = ft.build_features(views.bars_user(spark, folder), ALL_SPEC, "6h")
    return got.select("symbol", "ts", *(rounded(n).alias(n) for n in ALL_BUILTIN))


@query("E14_momentum", with_views("bars_1h", show(["momentum_10p"], "lagged"), base=base("bars_1h"), raw=raw_sql(["momentum_10p"]), lagged=lag_sql(["momentum_10p"])))
def _(spark, folder):
    got = ft.build_features(views.bars_1h(spark, folder), FeatureSpec(momentum=[10], clock=False), "1h")
    return got.select("symbol", "ts", rounded("momentum_10p").alias("momentum_10p"))


@query("E13_lagged_zscore", with_views("bars_1h", f"SELECT symbol, ts, round(CASE WHEN count(close) {over(40, -1)} >= 10 THEN (close - avg(close) {over(40, -1)})/nullif(stddev_samp(close) {over(40, -1)},0) END,6)+0.0::DOUBLE AS z FROM bars_1h"))
def _(spark, folder):
    panel = blocked(views.bars_1h(spark, folder), SYM, ["ts"], bar_slot("ts", "1h"), back=40)
    return panel.with_columns({"z": ft.lagged_zscore(panel, "close", 40)}).home().select("symbol", "ts", rounded("z").alias("z"))


BENCH = {
    "base": base("bars_1h"),
    "b": "SELECT ts, close AS bench_close, return_1p AS bench_return FROM base WHERE symbol='view'",
    "j": "SELECT base.*, bench_return FROM base LEFT JOIN b USING (ts)",
}


@query(
    "E18_benchmark",
    with_views(
        "bars_1h",
        f"SELECT symbol, ts, round(CASE WHEN count(return_1p+bench_return) {over(20)} = 20 THEN covar_samp(return_1p, bench_return) {over(20)}/nullif(stddev_samp(return_1p) {over(20)}*stddev_samp(bench_return) {over(20)},0) END,6)+0.0::DOUBLE AS bench_corr_20, "
        f"round(CASE WHEN count(return_1p+bench_return) {over(20)} = 20 THEN covar_samp(return_1p, bench_return) {over(20)}/nullif(var_samp(bench_return) {over(20)},0) END,6)+0.0::DOUBLE AS bench_beta_20 FROM j",
        **BENCH,
    ),
)
def _(spark, folder):
    spec = FeatureSpec(benchmark="view", bench_corr=[20], bench_beta=[20], clock=False)
    got = ft.build_features(views.bars_1h(spark, folder), spec, "1h", lag=False)
    return got.select("symbol", "ts", *(rounded(n).alias(n) for n in ("bench_corr_20", "bench_beta_20")))


@query("E19_pair_ratio", with_views("bars_1h", "SELECT ts, round(a.close/b.close,6) AS pair_ratio FROM bars_1h a JOIN bars_1h b USING (ts) WHERE a.symbol='click' AND b.symbol='view'"))
def _(spark, folder):
    return ft.pair_ratio(views.bars_1h(spark, folder), "click", "view").withColumn("pair_ratio", rounded("pair_ratio"))


VOL = (
    "SELECT symbol, CASE WHEN count(r) = 20 THEN stddev_samp(r) END AS vol, arg_max(close, ts) AS last_close FROM "
    f"(SELECT *, ln(close/lag(close) {LAG}) AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars_user) WHERE k <= 20 GROUP BY 1"
)
# a price of zero gives no return, neither to it nor from it
VOL_OF_RETURNS = VOL.replace(f"ln(close/lag(close) {LAG})", f"ln(nullif(close, 0)/nullif(lag(close) {LAG}, 0))")


@query("E20_latest_vol", with_views("bars_user", "SELECT symbol, round(vol,6) AS vol, round(last_close,6) AS last_close FROM v", v=VOL))
def _(spark, folder):
    got = ft.latest_vol(views.bars_user(spark, folder), 20)
    return got.select("symbol", rounded("vol").alias("vol"), rounded("last_close").alias("last_close"))


@query(
    "E21_vol_target_size",
    with_views(
        "bars_user",
        "SELECT symbol, CASE WHEN vol IS NULL OR vol = 0 THEN 0 ELSE round(least(equity*0.01/(last_close*vol), cap/last_close),6) END AS size FROM "
        "(SELECT *, CASE WHEN equity >= 50000 THEN 900 WHEN equity >= 10000 THEN 400 WHEN equity >= 1000 THEN 150 ELSE 50 END AS cap FROM (SELECT *, last_close*500 AS equity FROM v))",
        v=VOL_OF_RETURNS,
    ),
)
def _(spark, folder):
    from barloom.operators.portfolio import tier_lookup

    vols = ft.latest_vol(views.bars_user(spark, folder), 20).withColumn("equity", F.col("last_close") * 500)
    capped = tier_lookup(vols, "equity", {1000: 150.0, 10000: 400.0, 50000: 900.0}, 50.0, "max_order")
    return ft.vol_target_size(capped, "equity", "max_order").select("symbol", rounded("size").alias("size"))


@query("E22_adaptive_stop", with_views("bars_user", f"SELECT symbol, any_value(n)-1 AS n_returns, round(greatest(0.05, least(5.0, 2.0*stddev_samp(r))),6) AS stop_pct FROM (SELECT *, close/nullif(lag(close) {LAG}, 0) - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars_user) WHERE k <= 24 AND n > 11 GROUP BY symbol"))
def _(spark, folder):
    got = ft.adaptive_stop(views.bars_user(spark, folder), 24, 2.0, 0.05, 5.0)
    return got.withColumn("stop_pct", rounded("stop_pct"))


@query("E23_drawdown", with_views("equity", "SELECT ts, round(equity/100.0::DOUBLE,2) AS equity, round(peak/100.0::DOUBLE,2) AS peak, round((equity-peak)/peak::DOUBLE,6)+0.0::DOUBLE AS drawdown, round(equity/1e9,6) AS progress FROM (SELECT *, max(equity) OVER (ORDER BY ts) AS peak FROM (SELECT ts, 100000000000 + sum(pnl_cents) OVER (ORDER BY ts) AS equity FROM equity))"))
def _(spark, folder):
    from barloom.sources.snapshots import equity_curve

    curve = equity_curve(views.equity(spark, folder), "pnl_cents").withColumn("equity", F.col("equity") + 100_000_000_000)
    got = ft.drawdown(curve, "equity", 1e9)
    return got.select(
        "ts", F.round(F.col("equity") / 100, 2).alias("equity"), F.round(F.col("peak") / 100, 2).alias("peak"),
        rounded("drawdown").alias("drawdown"), rounded("progress").alias("progress"),
    )


@query(
    "E24_ewma_state",
    with_views(
        "", "SELECT symbol AS lane, ts, round(y,9) AS smoothed FROM ema JOIN num USING (symbol, n)",
        num="SELECT o_orderpriority AS symbol, o_orderdate AS ts, avg(o_totalprice)/1000 AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS n FROM orders GROUP BY 1,2",
        ema="SELECT symbol, n, x AS y FROM num WHERE n = 1 UNION ALL SELECT s.symbol, s.n, s.x*0.3::DOUBLE + e.y*0.7::DOUBLE FROM ema e JOIN num s ON s.symbol=e.symbol AND s.n=e.n+1",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, folder):
    o = views.table(spark, folder, "orders")
    metric = o.groupBy(F.col("o_orderpriority").alias("lane"), F.col("o_orderdate").alias("ts")).agg((F.avg("o_totalprice") / 1000).alias("metric"))
    got = ft.ewma_state(metric, ["lane"], ["ts"], time_slot("ts", 365 * 86400), "metric", 0.3)
    return got.select("lane", "ts", rounded("smoothed", 9).alias("smoothed"))


# ---- rules, edges, trades -------------------------------------------------------------------------------------

RULE_FEATURES = ["return_1p", "zscore_20", "volatility_10", "sma_5", "roc_5"]
RULE_SPEC = FeatureSpec(zscore=[20], volatility=[10], sma=[5], roc=[5], clock=False)
FLAGSHIP = ["zscore_20", ">", 1.0]
RULES = [
    FLAGSHIP,
    ["zscore_20", "<", -0.5],
    [["return_1p", ">", 0.0], "AND", ["zscore_20", "<", 0.5]],
    [["roc_5", "<=", 0.1], "OR", ["volatility_10", ">=", 2.0]],
    [[["zscore_20", ">", 0.2], "AND", ["return_1p", "<", 1.0]], "OR", ["roc_5", ">", 3.0]],
    ["close", ">", "sma_5"],
    ["return_1p", "!=", 0.0],
    ["missing_feature", ">", 0.0],
    [["hour", "==", 1.0], "OR", ["zscore_20", ">", 50.0]],
    [0.5, "<", "return_1p"],
]


def rule_sql(tree, columns) -> str:
    """Independent rendering of a rule as SQL."""
    left, op, right = tree
    if op in ("AND", "OR"):
        return f"({rule_sql(left, columns)} {op} {rule_sql(right, columns)})"
    if any(isinstance(s, str) and s not in columns for s in (left, right)):
        return "false"
    render = [s if isinstance(s, str) else f"{float(s)}::DOUBLE" for s in (left, right)]
    return f"coalesce({render[0]} {op.replace('!=', '<>').replace('==', '=')} {render[1]}, {'true' if op == '!=' else 'false'})"


SQL_COLUMNS = ["open", "high", "low", "close", "volume", *RULE_FEATURES]


def trades_ctes(view: str, rules) -> dict[str, str]:
    sig = " UNION ALL ".join(
        f"SELECT '{tree_id(t)}' AS formula_id, symbol, ts, open, close, ({rule_sql(t, SQL_COLUMNS)})::INT AS sig FROM lagged" for t in rules
    )
    return {
        "base": base(view),
        "raw": raw_sql(RULE_FEATURES),
        "lagged": lag_sql(RULE_FEATURES),
        "sig": sig,
        "edges": "SELECT *, sig - coalesce(lag(sig) OVER w, sig) AS edge, lead(open) OVER w AS exit_price FROM sig WINDOW w AS (PARTITION BY formula_id, symbol ORDER BY ts)",
        "trade": f"SELECT formula_id, symbol, ts, edge, close*(1+edge*{SLIP}::DOUBLE) AS exec_price, exit_price, close*(1+edge*{SLIP}::DOUBLE)*{FEE}::DOUBLE AS cost, "
        f"edge*(exit_price - close*(1+edge*{SLIP}::DOUBLE)) - close*(1+edge*{SLIP}::DOUBLE)*{FEE}::DOUBLE AS pnl FROM edges WHERE edge <> 0 AND exit_price IS NOT NULL",
    }


R_TRADE = ", ".join(f"round({c},10)+0.0::DOUBLE AS {c}" for c in ("exec_price", "exit_price", "cost", "pnl"))


def trade_columns():
    return [rounded(c, 10).alias(c) for c in ("exec_price", "exit_price", "cost", "pnl")]


@query("B04_compile_formula", with_views("bars_1h", " UNION ALL ".join(f"SELECT {i} AS rule, symbol, count(*) FILTER (WHERE {rule_sql(t, SQL_COLUMNS)}) AS signals FROM lagged GROUP BY symbol" for i, t in enumerate(RULES)), **{k: v for k, v in trades_ctes("bars_1h", RULES).items() if k in ("base", "raw", "lagged")}))
def _(spark, folder):
    panel = ft.build_features(views.bars_1h(spark, folder), RULE_SPEC, "1h")
    from barloom.functions.formula import compile_formula

    hits = panel.groupBy("symbol").agg(*(F.count_if(compile_formula(t, SQL_COLUMNS)).alias(f"r{i}") for i, t in enumerate(RULES)))
    return hits.unpivot(["symbol"], [f"r{i}" for i in range(len(RULES))], "name", "signals").select(
        F.substr("name", F.lit(2)).cast("int").alias("rule"), "symbol", "signals"
    )


@query("C09_join_signal", with_views("bars_1h", "SELECT b.symbol, b.ts, coalesce(e.hot, false) AS signal FROM bars_1h b LEFT JOIN (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS ts, true AS hot FROM events WHERE value > 100 GROUP BY ALL) e USING (symbol, ts)"))
def _(spark, folder):
    hot = views.hour_rows(spark, folder).where(F.col("close") > 100).select("symbol", "ts").distinct().withColumn("signal", F.lit(True))
    return sg.join_signal(views.bars_1h(spark, folder), hot, SYM).select("symbol", "ts", "signal")


@query("F01_signal_edges", with_views("bars_1h", "SELECT symbol, ts, edge FROM edges", **trades_ctes("bars_1h", [FLAGSHIP])))
def _(spark, folder):
    panel = sg.with_signal(ft.build_features(views.bars_1h(spark, folder), RULE_SPEC, "1h"), FLAGSHIP)
    return sg.signal_edges(panel, SYM, "1h").select("symbol", "ts", "edge")


@query("F02_trade_returns", with_views("bars_1h", f"SELECT symbol, ts, edge, {R_TRADE} FROM trade", **trades_ctes("bars_1h", [FLAGSHIP])))
def _(spark, folder):
    panel = sg.with_signal(ft.build_features(views.bars_1h(spark, folder), RULE_SPEC, "1h"), FLAGSHIP)
    got = sg.trade_returns(sg.signal_edges(panel, SYM, "1h"), SYM, "1h", FEE, SLIP)
    return got.select("symbol", "ts", "edge", *trade_columns())


@query("F03_evaluate_formula", with_views("bars_user", f"SELECT formula_id, symbol, ts, edge, {R_TRADE} FROM trade", **trades_ctes("bars_user", [RULES[4]])))
def _(spark, folder):
    got = sg.evaluate_formula(views.bars_user(spark, folder), RULE_SPEC, RULES[4], "6h", FEE, SLIP)
    return got.select("formula_id", "symbol", "ts", "edge", *trade_columns())


@query("C15_evaluate_formulas", with_views("bars_user", f"SELECT formula_id, symbol, ts, edge, {R_TRADE} FROM trade", **trades_ctes("bars_user", RULES)))
def _(spark, folder):
    got = sg.evaluate_formulas(views.bars_user(spark, folder), RULE_SPEC, RULES, "6h", FEE, SLIP)
    return got.select("formula_id", "symbol", "ts", "edge", *trade_columns())


def rule_ids_sql(rules) -> str:
    return "SELECT unnest([" + ", ".join(f"'{tree_id(t)}'" for t in rules) + "]) AS formula_id"


STATS_SQL = (
    "SELECT formula_id, coalesce(n,0) AS n_trades, round(m,10)+0.0::DOUBLE AS mean_pnl, round(CASE WHEN n IS NULL THEN -1 WHEN sd = 0 THEN 0 ELSE m/sd END,6)+0.0::DOUBLE AS sharpe FROM ids "
    "LEFT JOIN (SELECT formula_id, count(*) AS n, avg(pnl) AS m, stddev_samp(pnl) AS sd FROM trade GROUP BY 1) USING (formula_id)"
)


@query("G01_formula_stats", with_views("bars_user", STATS_SQL, **trades_ctes("bars_user", RULES), ids=rule_ids_sql(RULES)))
def _(spark, folder):
    trades = sg.evaluate_formulas(views.bars_user(spark, folder), RULE_SPEC, RULES, "6h", FEE, SLIP)
    got = pp.formula_stats(trades, sg.formula_table(spark, RULES))
    return got.select("formula_id", "n_trades", rounded("mean_pnl", 10).alias("mean_pnl"), rounded("sharpe").alias("sharpe"))


FLAGSHIP_SQL = with_views(
    "bars_1h", "SELECT symbol, count(*) AS n_trades, round(avg(pnl),10)+0.0::DOUBLE AS mean_pnl, round(avg(pnl)/stddev_samp(pnl),6)+0.0::DOUBLE AS sharpe FROM trade GROUP BY symbol",
    **trades_ctes("bars_1h", [FLAGSHIP]),
)


@query("flagship_rule_by_symbol", FLAGSHIP_SQL)
def flagship(spark, folder):
    """Bars, lagged features, one rule, edges, per-edge results, statistics per symbol."""
    trades = sg.evaluate_formula(views.bars_1h(spark, folder), RULE_SPEC, FLAGSHIP, "1h", FEE, SLIP)
    sharpe = F.try_divide(F.avg("pnl"), F.stddev_samp("pnl"))
    return trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), rounded(F.avg("pnl"), 10).alias("mean_pnl"), rounded(sharpe).alias("sharpe")
    )


def rule_grid(n: int = 100) -> list:
    """n two-leaf rules over the rule features with graded thresholds."""
    out = []
    for i in range(n):
        a, b = RULE_FEATURES[i % 5], RULE_FEATURES[(i // 5) % 5]
        out.append([[a, ">", round(0.1 * (i % 13) - 0.6, 2)], "AND" if i % 2 else "OR", [b, "<", round(0.15 * (i % 11) - 0.5, 2)]])
    return out


GRID = rule_grid()


@query("hundred_rules", with_views("bars_user", STATS_SQL, **trades_ctes("bars_user", GRID), ids=rule_ids_sql(GRID)))
def _(spark, folder):
    """Statistics of a hundred rules evaluated over the many-symbol panel in one pass."""
    trades = sg.evaluate_formulas(views.bars_user(spark, folder), RULE_SPEC, GRID, "6h", FEE, SLIP)
    got = pp.formula_stats(trades, sg.formula_table(spark, GRID))
    return got.select("formula_id", "n_trades", rounded("mean_pnl", 10).alias("mean_pnl"), rounded("sharpe").alias("sharpe"))


# ---- rules that arrive as a table -----------------------------------------------------------------------------

_X = "CASE l.f WHEN " + " WHEN ".join(f"'{f}' THEN {f}" for f in RULE_FEATURES) + " END"
TABLE_CTES = {
    **{k: v for k, v in trades_ctes("bars_1h", RULES).items() if k in ("base", "raw", "lagged")},
    "rules": "SELECT DISTINCT sha256(formula_json) AS formula_id, formula_json FROM formulas",
    "leaf": (
        "SELECT formula_id, i, regexp_extract(x, '\"([a-z_0-9]+)\"', 1) AS f, regexp_extract(x, '\"([<>=]+)\"', 1) AS op, regexp_extract(x, '\",([0-9.-]+)', 1)::DOUBLE AS v FROM "
        "(SELECT formula_id, unnest(regexp_extract_all(formula_json, '\\[\"[^\\]]*\\]')) AS x, generate_subscripts(regexp_extract_all(formula_json, '\\[\"[^\\]]*\\]'), 1) AS i FROM rules)"
    ),
    "held": (
        "SELECT f, op, v, symbol, ts, coalesce(CASE op WHEN '>' THEN x > v WHEN '<' THEN x < v ELSE x >= v END, false) AS yes FROM "
        f"(SELECT l.f, l.op, l.v, b.symbol, b.ts, {_X} AS x FROM (SELECT DISTINCT f, op, v FROM leaf) l, lagged b)"
    ),
    "told": (
        "SELECT l.formula_id, h.symbol, h.ts, max(yes::INT) FILTER (WHERE i = 1) AS a, coalesce(max(yes::INT) FILTER (WHERE i = 2), 1) AS b, coalesce(max(yes::INT) FILTER (WHERE i = 3), 0) AS c "
        "FROM leaf l JOIN held h USING (f, op, v) GROUP BY 1, 2, 3"
    ),
    "sig": "SELECT formula_id, symbol, ts, open, close, greatest(least(a, b), c) AS sig FROM told JOIN lagged USING (symbol, ts)",
    **{k: v for k, v in trades_ctes("bars_1h", RULES).items() if k in ("edges", "trade")},
}


@query(
    "C15_rule_table",
    with_views(
        "bars_1h formulas", "SELECT formula_id, symbol, count(*) AS n_trades, count(*) FILTER (WHERE edge > 0) AS buys, round(sum(pnl),6)+0.0::DOUBLE AS pnl, round(max(exec_price),10) AS highest, min(ts) AS first_ts, max(ts) AS last_ts "
        "FROM trade GROUP BY 1, 2", **TABLE_CTES,
    ),
)
def _(spark, folder):
    """All rules of the table ``formulas`` over the hourly panel."""
    rules = with_formula_id(views.formulas(spark, folder)).select("formula_id", "formula_json")
    trades = sg.evaluate_rules(views.bars_1h(spark, folder), RULE_SPEC, rules, "1h", FEE, SLIP)
    return trades.groupBy("formula_id", "symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("edge") > 0).alias("buys"), rounded(F.sum("pnl"), 6).alias("pnl"),
        F.round(F.max("exec_price"), 10).alias("highest"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query("G01_rule_table_stats", with_views("bars_1h formulas", STATS_SQL.replace("round(m,10)", "round(m,7)"), **TABLE_CTES, ids="SELECT formula_id FROM rules"))
def _(spark, folder):
    """Statistics of all rules of the table, those that never trade included."""
    rules = with_formula_id(views.formulas(spark, folder)).select("formula_id", "formula_json").distinct()
    trades = sg.evaluate_rules(views.bars_1h(spark, folder), RULE_SPEC, rules, "1h", FEE, SLIP)
    got = pp.formula_stats(trades, rules.select("formula_id"))
    return got.select("formula_id", "n_trades", rounded("mean_pnl", 7).alias("mean_pnl"), rounded("sharpe").alias("sharpe"))
