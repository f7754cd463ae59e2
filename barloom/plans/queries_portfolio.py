"""Queries over weights, budgets and position changes (family F, parts of C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.operators import portfolio as pf
from barloom.plans.oracle_views import with_views
from barloom.plans.registry import query
from barloom.sources import views

def W():
    return rounded("weight", 8).alias("weight")

RW = "round(weight,8)+0.0::DOUBLE AS weight"


def lane_returns(spark, folder):
    """Return rows with portfolio and lane; the order status plays the market regime."""
    o = views.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("alpha_id"), F.col("o_orderstatus").alias("regime"),
        ((F.col("o_totalprice") - 250000.0) / 1e6).alias("ret"),
    )
    return o.join(views.alpha_dim(spark, folder).select("alpha_id", "lane", "portfolio_id"), "alpha_id")


LR = "SELECT CAST(o_custkey AS VARCHAR) AS alpha_id, o_orderstatus AS regime, (o_totalprice-250000.0)/1e6 AS ret, lane, portfolio_id FROM orders JOIN alpha_dim ON alpha_id = CAST(o_custkey AS VARCHAR)"


def inv_var_sql(source: str, group: str) -> str:
    """Zero padding written out: append the missing zeros, then take the plain variance."""
    return (
        f"SELECT {group}, alpha_id, CASE WHEN cols = 1 THEN 1.0 ELSE iv / sum(iv) OVER (PARTITION BY {group}) END AS weight FROM (SELECT *, coalesce(1/nullif(v,0), max(1/nullif(v,0)) OVER (PARTITION BY {group})) AS iv, count(*) OVER (PARTITION BY {group}) AS cols FROM "
        f"(SELECT {group}, alpha_id, var_samp(x) AS v FROM (SELECT {group}, alpha_id, unnest(list_concat(xs, list_resize([]::DOUBLE[], (mx - len(xs))::BIGINT, 0.0::DOUBLE))) AS x FROM "
        f"(SELECT *, max(len(xs)) OVER (PARTITION BY {group}) AS mx FROM (SELECT {group}, alpha_id, list(ret) AS xs FROM {source} GROUP BY {group}, alpha_id))) GROUP BY {group}, alpha_id))"
    )


@query("F04_inverse_variance_weights", with_views("alpha_dim", f"SELECT portfolio_id, alpha_id, {RW} FROM iv", lr=LR, iv=inv_var_sql("lr", "portfolio_id")))
def _(spark, folder):
    return pf.inverse_variance_weights(lane_returns(spark, folder)).select("portfolio_id", "alpha_id", W())


PICK = {
    "lr": LR,
    "n": "SELECT portfolio_id, lane, alpha_id, count(*) AS al, count(*) FILTER (WHERE regime='F') AS rg FROM lr GROUP BY 1,2,3",
    "u": "SELECT portfolio_id, lane, bool_or(rg > 5) AS by_r FROM n GROUP BY 1,2",
    "pk": "SELECT lr.* FROM lr JOIN n USING (portfolio_id, lane, alpha_id) JOIN u USING (portfolio_id, lane) WHERE CASE WHEN by_r THEN rg > 5 AND regime='F' ELSE al > 5 END",
    "iv": inv_var_sql("pk", "portfolio_id, lane"),
    "lw": "SELECT portfolio_id, lane, alpha_id, weight * CASE lane WHEN 'core' THEN 0.5 ELSE 0.25 END AS weight FROM iv",
}


def lane_w(spark, folder):
    return pf.lane_weights(lane_returns(spark, folder), "F", {"core": 0.5, "moonshot": 0.25})


@query("F05_lane_weights", with_views("alpha_dim", f"SELECT portfolio_id, lane, alpha_id, {RW} FROM lw", **PICK))
def _(spark, folder):
    return lane_w(spark, folder).select("portfolio_id", "lane", "alpha_id", W())


CAP = {
    "w0": "SELECT portfolio_id, alpha_id, weight FROM lw WHERE weight >= 0.002 AND weight > 0",
    "w1": "SELECT *, weight/sum(weight) OVER (PARTITION BY portfolio_id) AS v, count(*) OVER (PARTITION BY portfolio_id) AS n FROM w0",
    # repeated capping: over-cap weights go to the cap, the excess to the others in proportion
    "it": (
        "SELECT portfolio_id, alpha_id, v, 0 AS i FROM w1 UNION ALL SELECT portfolio_id, alpha_id, CASE WHEN v >= {c} - 1e-12 THEN least(v, {c}) ELSE v + coalesce(v/nullif(recv,0)*excess,0) END, i+1 FROM "
        "(SELECT *, sum(greatest(v-{c},0)) OVER (PARTITION BY portfolio_id) AS excess, sum(CASE WHEN v < {c}-1e-12 THEN v ELSE 0 END) OVER (PARTITION BY portfolio_id) AS recv FROM it) WHERE i < 60"
    ),
    "cp": "SELECT portfolio_id, alpha_id, CASE WHEN n = 1 THEN least(weight, {c}) ELSE f END AS weight FROM w1 JOIN (SELECT portfolio_id, alpha_id, v AS f FROM it WHERE i = 60) USING (portfolio_id, alpha_id)",
}


def cap_ctes(c: str):
    return {k: s.replace("{c}", c) for k, s in CAP.items()}


@query("F06_cap_and_redistribute", with_views("alpha_dim", f"SELECT portfolio_id, alpha_id, {RW} FROM cp", **PICK, **cap_ctes("0.06")).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, folder):
    return pf.cap_and_redistribute(lane_w(spark, folder), 0.002, 0.06).select("portfolio_id", "alpha_id", W())


BUD = (
    "SELECT portfolio_id, greatest(0.85, least(0.99, 1-m)) AS core, 1-greatest(0.85, least(0.99, 1-m)) AS moonshot FROM (SELECT portfolio_id, greatest(0.01, least(0.20, CASE WHEN d > 0.02 THEN 0.05+greatest(0, least(0.15, d*0.5)) WHEN d < -0.02 THEN 0.05-greatest(0, least(0.04, -d*0.5)) ELSE 0.05 END)) AS m "
    "FROM (SELECT portfolio_id, coalesce(avg(sortino) FILTER (WHERE lane='moonshot'),0) - coalesce(avg(sortino) FILTER (WHERE lane='core'),0) AS d FROM alpha_stats GROUP BY 1))"
)


def budgets(spark, folder, previous=None):
    return pf.lane_budgets(views.alpha_stats(spark, folder), dead_band=0.02, slope=0.5, previous=previous)


@query("F07_lane_budgets", with_views("alpha_stats", "SELECT portfolio_id, round(core,6) AS core, round(moonshot,6) AS moonshot FROM b", b=BUD))
def _(spark, folder):
    return budgets(spark, folder).select("portfolio_id", rounded("core").alias("core"), rounded("moonshot").alias("moonshot"))


@query("F07_lane_budgets_stepped", with_views("alpha_stats", "SELECT portfolio_id, round(1-c,6) AS moonshot FROM (SELECT portfolio_id, greatest(0.85, least(0.99, 1-greatest(0.01, least(0.20, greatest(0.05, least(0.09, t)))))) AS c FROM (SELECT portfolio_id, CASE WHEN d > 0.02 THEN 0.05+greatest(0, least(0.15, d*0.5)) WHEN d < -0.02 THEN 0.05-greatest(0, least(0.04, -d*0.5)) ELSE 0.05 END AS t FROM (SELECT portfolio_id, coalesce(avg(sortino) FILTER (WHERE lane='moonshot'),0) - coalesce(avg(sortino) FILTER (WHERE lane='core'),0) AS d FROM alpha_stats GROUP BY 1)))"))
def _(spark, folder):
    prev = views.alpha_dim(spark, folder).select("portfolio_id", F.lit(0.07).alias("moonshot")).distinct()
    return budgets(spark, folder, prev).select("portfolio_id", rounded("moonshot").alias("moonshot"))


CYCLES = 5
#: Strategies of a cycle: Sortino ratios drift with the cycle, and a portfolio drops out of one.
CYCLE_ROWS = (
    "SELECT c, portfolio_id, lane, sortino * (1 + 0.6 * c * (CASE lane WHEN 'moonshot' THEN 1 ELSE -1 END)) + 0.05 * c AS sortino FROM alpha_stats, range(5) x(c) WHERE NOT (c = 2 AND portfolio_id % 3 = 1)"
)
LANE_STATE = (
    "SELECT p.portfolio_id, -1 AS c, NULL::DOUBLE AS cs, NULL::DOUBLE AS ms, NULL::DOUBLE AS core, NULL::DOUBLE AS moon FROM (SELECT DISTINCT portfolio_id FROM alpha_stats) p UNION ALL "
    "SELECT portfolio_id, c, cs, ms, CASE WHEN nc IS NULL THEN oldcore ELSE k END, CASE WHEN nc IS NULL THEN prev ELSE 1 - k END FROM (SELECT *, greatest(0.85, least(0.99, 1 - greatest(0.01, least(0.20, t)))) AS k FROM "
    "(SELECT *, CASE WHEN prev IS NULL THEN g ELSE greatest(prev-0.02, least(prev+0.02, g)) END AS t FROM (SELECT *, CASE WHEN ms-cs > 0.02 THEN 0.05+greatest(0, least(0.15, (ms-cs)*0.5)) WHEN ms-cs < -0.02 THEN 0.05-greatest(0, least(0.04, (cs-ms)*0.5)) ELSE 0.05 END AS g FROM "
    "(SELECT s.portfolio_id, s.c+1 AS c, m.nc, s.core AS oldcore, s.moon AS prev, CASE WHEN m.nc IS NULL THEN s.cs ELSE 0.7::DOUBLE*coalesce(s.cs, m.nc) + 0.3::DOUBLE*m.nc END AS cs, CASE WHEN m.nc IS NULL THEN s.ms ELSE 0.7::DOUBLE*coalesce(s.ms, m.nm) + 0.3::DOUBLE*m.nm END AS ms "
    "FROM st s LEFT JOIN means m ON m.portfolio_id = s.portfolio_id AND m.c = s.c+1 WHERE s.c < 4))))"
)


@query(
    "F07_lane_cycles",
    with_views(
        "alpha_stats", "SELECT portfolio_id, round(cs,6)+0.0::DOUBLE AS core_sortino, round(ms,6)+0.0::DOUBLE AS moonshot_sortino, round(core,6) AS core, round(moon,6) AS moonshot FROM st WHERE c = 4",
        rows=CYCLE_ROWS, means="SELECT c, portfolio_id, coalesce(avg(sortino) FILTER (WHERE lane='core'),0) AS nc, coalesce(avg(sortino) FILTER (WHERE lane='moonshot'),0) AS nm FROM rows GROUP BY 1,2", st=LANE_STATE,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, folder):
    """State of the lanes after five cycles, each smoothed into the one before."""
    a = views.alpha_stats(spark, folder)

    def cycle(c):
        way = F.when(F.col("lane") == "moonshot", 1).otherwise(-1)
        moved = a.withColumn("sortino", F.col("sortino") * (1 + 0.6 * c * way) + 0.05 * c)
        return moved.where(F.col("portfolio_id") % 3 != 1) if c == 2 else moved

    got = pf.lane_cycles((cycle(c) for c in range(CYCLES)), dead_band=0.02, slope=0.5)
    return got.select("portfolio_id", *(rounded(c).alias(c) for c in ("core_sortino", "moonshot_sortino", "core", "moonshot")))


BUDGETED = {
    "b": BUD,
    "a0": "SELECT lw.portfolio_id, lw.alpha_id, s.lane, s.n_trades, lw.weight FROM lw JOIN alpha_stats s USING (portfolio_id, alpha_id)",
    "a1": "SELECT a0.*, CASE WHEN ls > 0 THEN weight*least(1, bud/greatest(ls,1e-12)) ELSE weight END AS w1 FROM (SELECT a0.*, sum(weight) OVER (PARTITION BY portfolio_id, lane) AS ls, CASE lane WHEN 'core' THEN core ELSE moonshot END AS bud FROM a0 JOIN b USING (portfolio_id)) a0",
    "a2": "SELECT *, w1/sum(w1) OVER (PARTITION BY portfolio_id) AS w2 FROM a1",
    "a3": "SELECT *, CASE WHEN w3 < 0.001 THEN 0 ELSE w3 END AS w4 FROM (SELECT *, CASE WHEN lane='moonshot' AND n_trades < 12 THEN least(w2, 0.02) ELSE w2 END AS w3 FROM a2)",
    "bw": "SELECT portfolio_id, alpha_id, lane, w4/sum(w4) OVER (PARTITION BY portfolio_id) AS weight FROM a3",
}


def budgeted(spark, folder):
    w = lane_w(spark, folder).select("portfolio_id", "alpha_id", "weight")
    return pf.apply_lane_budgets(w, views.alpha_stats(spark, folder), budgets(spark, folder), probation_trades=12, probation_cap=0.02, floor=0.001)


@query("F08_apply_lane_budgets", with_views("alpha_stats", f"SELECT portfolio_id, alpha_id, lane, {RW} FROM bw", **PICK, **BUDGETED))
def _(spark, folder):
    return budgeted(spark, folder).select("portfolio_id", "alpha_id", "lane", W())


@query("F09_retag_lane", with_views("alpha_stats", "SELECT alpha_id, CASE WHEN r THEN 'core' ELSE lane END AS lane, r AS retagged FROM (SELECT *, lane='moonshot' AND n_trades >= 10 AND sharpe >= 0.1 AND sortino >= 0.15 AND mdd <= 0.245 AS r FROM alpha_stats)"))
def _(spark, folder):
    return pf.retag_lane(views.alpha_stats(spark, folder), 10, 0.1, 0.15, 0.245).select("alpha_id", "lane", "retagged")


ENS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY sortino DESC, alpha_id) AS k, count(*) OVER (PARTITION BY portfolio_id) AS n FROM alpha_stats WHERE lane='core') WHERE k <= 10 AND n >= 2"


def ensemble(spark, folder):
    return pf.ensemble_members(views.alpha_stats(spark, folder), 2, 10)


@query("F10_ensemble_members", with_views("alpha_stats", "SELECT portfolio_id, alpha_id, k AS rank FROM e", e=ENS))
def _(spark, folder):
    return ensemble(spark, folder).select("portfolio_id", "alpha_id", "rank")


@query("F11_sharpe_weights", with_views("alpha_stats", "SELECT portfolio_id, alpha_id, round(CASE WHEN sum(greatest(sharpe,0)) OVER w > 0 THEN greatest(sharpe,0)/sum(greatest(sharpe,0)) OVER w ELSE 1.0/count(*) OVER w END,8) AS weight FROM e WINDOW w AS (PARTITION BY portfolio_id)", e=ENS))
def _(spark, folder):
    return pf.sharpe_weights(ensemble(spark, folder)).select("portfolio_id", "alpha_id", W())


@query("F11_equal_weights", with_views("alpha_stats", "SELECT portfolio_id, alpha_id, round(1/count(*) OVER (PARTITION BY portfolio_id)::DOUBLE,8) AS weight FROM e", e=ENS))
def _(spark, folder):
    return pf.equal_weights(ensemble(spark, folder)).select("portfolio_id", "alpha_id", W())


EXPO = "SELECT portfolio_id, universe[1] AS symbol, sum(weight) AS weight FROM lw JOIN alpha_dim USING (portfolio_id, alpha_id) GROUP BY 1,2"


def exposure(spark, folder):
    return pf.symbol_exposure(lane_w(spark, folder).drop("lane"), views.alpha_dim(spark, folder))


@query("C17_symbol_exposure", with_views("alpha_dim", f"SELECT portfolio_id, symbol, {RW} FROM x", **PICK, x=EXPO))
def _(spark, folder):
    return exposure(spark, folder).select("portfolio_id", "symbol", W())


def risk_state(spark, folder):
    """Equity per portfolio (nation) from account balances; every seventh portfolio is halted."""
    c = views.table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("long").alias("portfolio_id")).agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    return c.select("portfolio_id", (F.col("cents") / 100.0).alias("equity"), F.lit(250000.0).alias("start_equity"), (F.col("portfolio_id") % 7 == 3).alias("halted"))


STATE = "SELECT CAST(c_nationkey AS BIGINT) AS portfolio_id, sum(round(c_acctbal*100)::BIGINT)/100.0::DOUBLE AS equity, 250000.0::DOUBLE AS start_equity, c_nationkey % 7 = 3 AS halted FROM customer GROUP BY c_nationkey"
RISK = {
    "x": EXPO, "st": STATE,
    "c1": "SELECT portfolio_id, symbol, least(weight, 0.05) AS w, equity, start_equity, halted FROM x JOIN st USING (portfolio_id)",
    "c2": "SELECT *, w * (CASE WHEN g > 0.6 THEN 0.6/g ELSE 1 END) * (CASE WHEN equity < start_equity*0.85 THEN 0.5 ELSE 1 END) AS w2 FROM (SELECT *, sum(w) OVER (PARTITION BY portfolio_id) AS g FROM c1)",
}


@query("F12_enforce_risk", with_views("alpha_dim", "SELECT portfolio_id, symbol, round(CASE WHEN halted THEN 0 ELSE w2/sum(w2) OVER (PARTITION BY portfolio_id) END,8)+0.0::DOUBLE AS weight FROM c2", **PICK, **RISK))
def _(spark, folder):
    return pf.enforce_risk(exposure(spark, folder), risk_state(spark, folder), 0.05, 0.6).select("portfolio_id", "symbol", W())


@query("F12_enforce_risk_scaled", with_views("alpha_dim", "SELECT portfolio_id, symbol, round(CASE WHEN halted THEN 0 ELSE w2 END,8)+0.0::DOUBLE AS weight FROM c2", **PICK, **RISK))
def _(spark, folder):
    return pf.enforce_risk(exposure(spark, folder), risk_state(spark, folder), 0.05, 0.6, renormalize=False).select("portfolio_id", "symbol", W())


def positions(spark, folder):
    """Holdings per portfolio and symbol from order counts."""
    o = views.table(spark, folder, "orders").join(views.alpha_dim(spark, folder), F.col("o_custkey").cast("string") == F.col("alpha_id"))
    return o.groupBy("portfolio_id", F.element_at("universe", 2).alias("symbol")).agg(F.count(F.lit(1)).cast("double").alias("amount"))


def prices(spark, folder):
    p = views.table(spark, folder, "part")
    return p.groupBy(F.concat(F.lit("S"), F.col("p_partkey") % 30).alias("symbol")).agg(F.max("p_retailprice").alias("price"))


HELD = {
    "pos": "SELECT portfolio_id, universe[2] AS symbol, count(*)::DOUBLE AS amount FROM orders JOIN alpha_dim ON alpha_id = CAST(o_custkey AS VARCHAR) GROUP BY 1,2",
    "px": "SELECT 'S' || (p_partkey % 30) AS symbol, max(p_retailprice) AS price FROM part GROUP BY 1",
}


@query("F13_mark_to_market", with_views("alpha_dim", "SELECT portfolio_id, round(equity + coalesce(h,0),4) AS equity FROM st LEFT JOIN (SELECT portfolio_id, sum(amount*coalesce(price,0)) AS h FROM pos LEFT JOIN px USING (symbol) GROUP BY 1) USING (portfolio_id)", **HELD, st=STATE))
def _(spark, folder):
    cash = risk_state(spark, folder).select("portfolio_id", F.col("equity").alias("cash"))
    got = pf.mark_to_market(positions(spark, folder), prices(spark, folder), cash)
    return got.select("portfolio_id", rounded("equity", 4).alias("equity"))


BOOK = "SELECT portfolio_id, symbol, coalesce(amount,0) AS amount, coalesce(weight,0) AS weight, coalesce(price,0) AS price FROM pos FULL JOIN x USING (portfolio_id, symbol) LEFT JOIN px USING (symbol)"


@query("C18_position_targets", with_views("alpha_dim", f"SELECT portfolio_id, symbol, amount, {RW}, price FROM bk", **PICK, x=EXPO, **HELD, bk=BOOK))
def _(spark, folder):
    got = pf.position_targets(positions(spark, folder), exposure(spark, folder), prices(spark, folder))
    return got.select("portfolio_id", "symbol", "amount", W(), "price")


@query("F14_rebalance_deltas", with_views("alpha_dim", "SELECT portfolio_id, symbol, round(d,4) AS delta_usd, CASE WHEN d>0 THEN 'buy' ELSE 'sell' END AS side FROM (SELECT portfolio_id, symbol, equity*weight - amount*price AS d FROM bk JOIN st USING (portfolio_id) WHERE price > 0) WHERE abs(d) >= 10 AND abs(d) <= 50000", **PICK, x=EXPO, **HELD, bk=BOOK, st=STATE))
def _(spark, folder):
    book = pf.position_targets(positions(spark, folder), exposure(spark, folder), prices(spark, folder))
    got = pf.rebalance_deltas(book, risk_state(spark, folder).select("portfolio_id", "equity"), 10.0, 50000.0)
    return got.withColumn("delta_usd", rounded("delta_usd", 4))


FILLS = "SELECT 'S' || (l_suppkey % 20) AS symbol, l_orderkey*100000000 + l_partkey*10000 + CAST(round(l_extendedprice) AS BIGINT) AS seq, CASE WHEN l_returnflag='R' THEN 0 ELSE 1 END AS ok, l_discount*100 + l_tax*100 + l_quantity/100 AS slip_bps FROM lineitem"


def fills(spark, folder):
    li = views.table(spark, folder, "lineitem")
    seq = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.round("l_extendedprice").cast("long")
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey") % 20).alias("symbol"), seq.alias("seq"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("ok"),
        (F.col("l_discount") * 100 + F.col("l_tax") * 100 + F.col("l_quantity") / 100).alias("slip_bps"),
    )


SLIP = "SELECT symbol, count(*) AS n, quantile_cont(slip_bps,0.9) AS slip_p90 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS k FROM f) WHERE k <= 400 AND ok = 1 GROUP BY 1 HAVING count(*) >= 20"


@query("F15_slippage_p90", with_views("", "SELECT symbol, n, round(slip_p90,6) AS slip_p90 FROM s", f=FILLS, s=SLIP))
def _(spark, folder):
    return pf.slippage_p90(fills(spark, folder), "seq").withColumn("slip_p90", rounded("slip_p90"))


@query("C19_effective_slippage", with_views("alpha_dim", "SELECT portfolio_id, pos.symbol, round(coalesce(slip_p90/10000, 0.0005),8) AS slippage FROM pos LEFT JOIN s USING (symbol)", **HELD, f=FILLS, s=SLIP))
def _(spark, folder):
    over = pf.slippage_p90(fills(spark, folder), "seq").select("symbol", F.col("slip_p90").alias("bps"))
    got = pf.effective_slippage(positions(spark, folder), over, 0.0005)
    return got.select("portfolio_id", "symbol", rounded("slippage", 8).alias("slippage"))


@query("C20_tier_lookup", "SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 900.0 WHEN c_acctbal >= 1000 THEN 400.0 WHEN c_acctbal >= 0 THEN 150.0 ELSE 25.0 END::DOUBLE AS max_order FROM customer")
def _(spark, folder):
    c = views.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return pf.tier_lookup(c, "c_acctbal", {0: 150.0, 1000: 400.0, 5000: 900.0}, 25.0).drop("c_acctbal")


@query("C22_lane_totals", with_views("alpha_stats", "SELECT portfolio_id, lane, round(sum(weight),8)+0.0::DOUBLE AS weight FROM bw GROUP BY 1,2", **PICK, **BUDGETED))
def _(spark, folder):
    return budgeted(spark, folder).groupBy("portfolio_id", "lane").agg(F.sum("weight").alias("weight")).select("portfolio_id", "lane", W())
