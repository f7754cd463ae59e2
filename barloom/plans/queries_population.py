"""Queries over rule populations, validation and registries (family G, parts of B and C)."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from barloom.functions import formula as fm
from barloom.functions.formula import tree_id
from barloom.functions import stats as st
from barloom.functions.scalars import rounded
from barloom.operators import population as pp
from barloom.operators import redundancy as rd
from barloom.operators import signals as sg
from barloom.operators import validation as va
from barloom.operators.features import build_features
from barloom.operators.ordered import positions, time_slot
from barloom.plans.oracle_views import with_views
from barloom.plans.queries_features import FEE, RULE_FEATURES, RULE_SPEC, RULES, SLIP, SQL_COLUMNS, TABLE_CTES, base, lag_sql, raw_sql, trades_ctes
from barloom.plans.registry import query
from barloom.session import cut_lineage, stored
from barloom.sources import views

K, EMB = 5, 3


P_VALUES = ("p_value", "dsr_prob", "p_binomial", "p_bootstrap")


def r(*names, digits: int = 10):
    """Rounded columns; p-values come from different series on the two sides and are compared at six digits."""
    return ", ".join(f"round({n},{6 if n in P_VALUES else digits})+0.0::DOUBLE AS {n}" for n in names)


def rc(*names, digits: int = 10):
    return [rounded(n, 6 if n in P_VALUES else digits).alias(n) for n in names]


def t_p_sql(m: str, s: str, n: str) -> str:
    """One-sided t-test p-value from gamma-function terms (independent of the recurrence used on the Spark side)."""
    nu, t = f"({n}-1)", f"(({m})/(({s})/sqrt({n}::DOUBLE)))"
    th = f"atan(abs({t})/sqrt({nu}::DOUBLE))"
    even = (
        f"sin({th})*list_sum(list_transform(range(0, {nu}//2), lambda j: pow(cos({th}), 2*j)*exp(lgamma(j+0.5)-lgamma(j+1.0)-lgamma(0.5))))"
    )
    odd = (
        f"(2/pi())*({th} + sin({th})*coalesce(list_sum(list_transform(range(0, ({nu}-1)//2), lambda j: pow(cos({th}), 2*j+1)*exp(lgamma(j+1.0)+lgamma(1.5)-lgamma(j+1.5)))),0))"
    )
    two = f"(CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"
    return (
        f"CASE WHEN {n} < 2 THEN NULL WHEN {s} = 0 THEN (CASE WHEN {m} > 0 THEN 0.0 WHEN {m} < 0 THEN 1.0 END) "
        f"WHEN {m} > 0 THEN (1-{two})/2 ELSE 1-(1-{two})/2 END"
    )


def phi_sql(x: str) -> str:
    """Normal distribution function by its alternating series; wide arguments are clamped to 0 and 1."""
    return (
        f"CASE WHEN {x} < -6 THEN 0.0 WHEN {x} > 6 THEN 1.0 ELSE 0.5 + list_sum(list_transform(range(0, 120), "
        f"lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)*sign({x})*exp((2*k+1)*ln(greatest(abs({x}),1e-300)) - k*ln(2.0) - lgamma(k+1.0))/(2*k+1)))/sqrt(2*pi()) END"
    )


@query(
    "G02_performance_summary",
    with_views(
        "trades",
        f"SELECT formula_id, count(*) AS n_trades, {r('sharpe','sortino','win_rate','mdd').replace('round(sharpe','round(avg(pnl)/stddev_samp(pnl)').replace('round(sortino','round(avg(pnl)/stddev_samp(least(pnl,0.0))').replace('round(win_rate','round(avg((pnl>0)::INT)').replace('round(mdd','round(max(greatest(peak,0)-cum)')} FROM "
        "(SELECT *, max(cum) OVER (PARTITION BY formula_id ORDER BY symbol, ts) AS peak FROM (SELECT *, sum(pnl) OVER (PARTITION BY formula_id ORDER BY symbol, ts) AS cum FROM trades)) GROUP BY 1",
    ),
)
def _(spark, folder):
    got = va.performance_summary(views.trades(spark, folder))
    return got.select("formula_id", "n_trades", *rc("sharpe", "sortino", "win_rate", "mdd"))


@query("G03_ids", with_views("formulas", "SELECT formula_no, sha256(formula_json) AS formula_id, sha256(formula_json || ':' || 'AB' || ':1h') AS alpha_id FROM formulas"))
def _(spark, folder):
    f = fm.with_formula_id(views.formulas(spark, folder))
    universe = F.array(F.lit("B"), F.lit("A"))
    return f.select("formula_no", "formula_id", fm.alpha_id(F.col("formula_json"), universe, F.lit("1h")).alias("alpha_id"))


USER_STATS = "SELECT formula_id, count(*) AS n_trades, avg(pnl)/stddev_samp(pnl) AS sharpe FROM trades WHERE pnl > 1.2 GROUP BY 1"
ALL_STATS = "SELECT formula_id, coalesce(n_trades,0) AS n_trades, coalesce(sharpe, CASE WHEN n_trades IS NULL THEN -1 END) AS sharpe FROM (SELECT DISTINCT formula_id FROM trades) LEFT JOIN us USING (formula_id)"


def _user_stats(spark, folder, floor=1.2, above_least=False):
    t = views.trades(spark, folder)
    return pp.formula_stats(t.where(F.col("pnl") > floor), t.select("formula_id").distinct(), above_least)


@query("G04_population_diag", with_views("trades", "SELECT count(*) AS pop, round(avg((n_trades=0)::INT),4) AS zero_trade_pct, quantile_cont(n_trades::DOUBLE,0.5) FILTER (WHERE n_trades>0) AS trades_median, round(quantile_cont(n_trades::DOUBLE,0.9) FILTER (WHERE n_trades>0),10) AS trades_p90, round(quantile_cont(sharpe,0.5) FILTER (WHERE n_trades>0),10) AS sharpe_median, round(quantile_cont(sharpe,0.9) FILTER (WHERE n_trades>0),10) AS sharpe_p90 FROM s", us=USER_STATS, s=ALL_STATS))
def _(spark, folder):
    got = pp.population_diag(_user_stats(spark, folder))
    return got.select("pop", "zero_trade_pct", *rc("trades_median", "trades_p90", "sharpe_median", "sharpe_p90"))


#: The same of the documented rule: no spread gives 0 (a quotient by zero is infinite in SQL), deviations above the smallest return.
SPREAD = "SELECT formula_id, count(*) AS n_trades, avg(pnl) AS m, stddev_samp(pnl - least) AS sd FROM (SELECT *, min(pnl) OVER (PARTITION BY formula_id) AS least FROM trades WHERE pnl > 1.2) GROUP BY 1"
SPREAD_STATS = "SELECT formula_id, n_trades, CASE WHEN sd = 0 THEN 0.0 ELSE m/sd END AS sharpe FROM sp"


@query("G04_population_extremes", with_views("trades", "SELECT side, formula_id, round(sharpe,10) AS sharpe FROM (SELECT 'top' AS side, * FROM s WHERE n_trades>0 AND sharpe IS NOT NULL ORDER BY round(sharpe,10) DESC, formula_id LIMIT 3) UNION ALL SELECT 'bottom', formula_id, round(sharpe,10) FROM (SELECT * FROM s WHERE n_trades>0 AND sharpe IS NOT NULL ORDER BY round(sharpe,10), formula_id LIMIT 3)", sp=SPREAD, us=SPREAD_STATS, s=ALL_STATS))
def _(spark, folder):
    """Sharpe ratios equal in ten digits are a tie, which the rule's id decides: sums run in any order."""
    s = _user_stats(spark, folder, above_least=True).where(F.col("sharpe").isNotNull()).withColumn("sharpe", rounded("sharpe", 10))
    return pp.population_extremes(s, []).select("side", "formula_id", "sharpe")


@query("G05_is_degenerate", with_views("trades", "SELECT round(avg((n_trades=0)::INT),4) AS degenerate_pct, least(0.85, 0.5+0.02*count(*)/400.0::DOUBLE) AS \"limit\", avg((n_trades=0)::INT) >= least(0.85, 0.5+0.02*count(*)/400.0::DOUBLE) AS degenerate FROM s", us=USER_STATS, s=ALL_STATS))
def _(spark, folder):
    return pp.is_degenerate(_user_stats(spark, folder), 400)


POS = "SELECT *, row_number() OVER (PARTITION BY formula_id ORDER BY symbol, ts) - 1 AS pos, count(*) OVER (PARTITION BY formula_id) AS n FROM trades"
FOLDS = f"SELECT *, least(pos // greatest(1, n//{K}), {K-1}) AS fold, greatest(1, n//{K}) AS size FROM p"


def outside_sql(f: str) -> str:
    end = f"(CASE WHEN {f}={K-1} THEN n ELSE least(n, ({f}+1)*size) END)"
    return f"(pos < greatest(0, {f}*size-{EMB}) OR pos >= least(n, {end}+{EMB}))"


@query("G09_purged_folds", with_views("trades", f"SELECT formula_id, symbol, ts, pos, fold, list_filter([0,1,2,3,4], lambda f: {outside_sql('f')}) AS train_folds FROM fo", p=POS, fo=FOLDS))
def _(spark, folder):
    return va.purged_folds(views.trades(spark, folder), K, EMB).select("formula_id", "symbol", "ts", "pos", "fold", "train_folds")


@query("G10_cpcv_folds", with_views("trades", f"SELECT formula_id, split, role, count(*) AS rows FROM (SELECT formula_id, s.split, CASE WHEN fold IN (s.a, s.b) THEN 'test' WHEN {outside_sql('s.a')} AND {outside_sql('s.b')} THEN 'train' ELSE 'purged' END AS role FROM fo, sp s) GROUP BY 1,2,3", p=POS, fo=FOLDS, sp="SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM range(5) x(a), range(5) y(b) WHERE a < b"))
def _(spark, folder):
    got = va.cpcv_folds(views.trades(spark, folder), K, EMB)
    return got.groupBy("formula_id", "split", "role").agg(F.count(F.lit(1)).alias("rows"))


FOLD_STATS = "SELECT formula_id, fold, count(*) AS n, avg(pnl) AS m, stddev_samp(pnl) AS s FROM fo GROUP BY 1,2"
FOLD_P = f"SELECT *, {t_p_sql('m', 's', 'n')} AS p FROM fs WHERE n >= 2"
CV = "SELECT formula_id, CASE WHEN count(*) FILTER (WHERE p IS NULL)=0 THEN avg(p) END AS p_value, avg(m) AS mean_oos, avg(CASE WHEN s>0 THEN m/s ELSE 0 END) AS sharpe_oos FROM fp GROUP BY 1"
CV_CTES = {"p": POS, "fo": FOLDS, "fs": FOLD_STATS, "fp": FOLD_P, "cv": CV}


@query("G11_cv_stats", with_views("trades", f"SELECT formula_id, {r('p_value','mean_oos','sharpe_oos')}, n AS total_trades, false AS is_fallback FROM cv JOIN (SELECT formula_id, count(*) AS n FROM trades GROUP BY 1) USING (formula_id)", **CV_CTES))
def _(spark, folder):
    got = va.cv_stats(views.trades(spark, folder), K)
    return got.select("formula_id", *rc("p_value", "mean_oos", "sharpe_oos"), "total_trades", "is_fallback")


SPARSE = "SELECT formula_id, count(*) AS n, avg(pnl) AS m, stddev_samp(pnl) AS s, count(*) FILTER (WHERE pnl > 0) AS w FROM sp GROUP BY 1"
BINOM = (
    "least(1.0, list_sum(list_transform(list_filter(range(0, n+1), lambda k: abs(k - n/2.0) >= abs(w - n/2.0)), lambda k: exp(lgamma(n+1.0)-lgamma(k+1.0)-lgamma(n-k+1.0) - n*ln(2.0)))))"
)


@query("G12_sparse_fallback", with_views("trades", f"SELECT formula_id, round(CASE WHEN n < 5 THEN {BINOM} ELSE {t_p_sql('m','s','n')} END,6)+0.0::DOUBLE AS p_value, round(m,10)+0.0::DOUBLE AS mean_oos, n AS total_trades, true AS is_fallback FROM x", sp="SELECT * FROM trades", x=SPARSE))
def _(spark, folder):
    """Fold count above the number of returns: every rule takes the whole-sample branch."""
    got = va.cv_stats(views.trades(spark, folder), 100_000)
    return got.select("formula_id", *rc("p_value", "mean_oos"), "total_trades", "is_fallback")


@query("G13_binomial_p", with_views("trades", f"SELECT formula_id, n, w AS wins, round({BINOM},6) AS p_binomial FROM x", sp="SELECT * FROM trades", x=SPARSE))
def _(spark, folder):
    return va.win_test(views.trades(spark, folder)).select("formula_id", "n", "wins", *rc("p_binomial"))


STEPS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * (1 << 32)) for k in range(7)]


def boot_sql(rule: str, n_iter: int) -> str:
    """p_bootstrap per rule over events, ``rule`` the SQL that names it."""
    weight = " + ".join(f"(u >= {s})::INT" for s in STEPS)
    return (
        f"WITH t AS (SELECT {rule} AS formula_id, row_number() OVER (PARTITION BY {rule} ORDER BY event_type, ts) - 1 AS pos, (value-20.0)/100.0 AS pnl FROM events), "
        "h AS (SELECT formula_id, pnl, g, md5('11|' || formula_id || '|' || pos || '|' || g) AS h FROM t, range("
        f"{(n_iter + 3) // 4}) x(g)), d AS (SELECT formula_id, g*4+j AS it, pnl, ('0x' || substr(h, 1+8*j, 8))::BIGINT AS u FROM h, range(4) y(j)), "
        f"m AS (SELECT formula_id, it, sum(pnl*w)/nullif(sum(w),0) AS bm FROM (SELECT *, {weight} AS w FROM d) WHERE it < {n_iter} GROUP BY 1,2), "
        "o AS (SELECT formula_id, count(*) AS n, avg(pnl) AS mean, stddev_samp(pnl) AS sd FROM t GROUP BY 1) SELECT formula_id, round(CASE WHEN any_value(o.n)<3 OR any_value(sd)=0 THEN 1 WHEN any_value(mean)<=0 THEN 1 "
        f"WHEN avg((bm-mean>=mean)::INT)>0 THEN avg((bm-mean>=mean)::INT) ELSE 1/{n_iter}.0::DOUBLE END,6) AS p_bootstrap FROM m JOIN o USING (formula_id) GROUP BY 1"
    )


def _boot_trades(spark, folder, rule="user_id"):
    return views.table(spark, folder, "events").select(
        F.col(rule).cast("string").alias("formula_id"), F.col("event_type").alias("symbol"), "ts",
        ((F.col("value") - 20.0) / 100.0).alias("pnl"),
    )


@query("G14_bootstrap_p", boot_sql("CAST(user_id AS VARCHAR)", 500))
def _(spark, folder):
    return va.bootstrap_p(_boot_trades(spark, folder), 500, 11).select("formula_id", *rc("p_bootstrap"))


@query("G14_bootstrap_p_large", boot_sql("event_type", 500))
def _(spark, folder):
    """The same for few rules of thousands of returns each."""
    return va.bootstrap_p(_boot_trades(spark, folder, "event_type"), 500, 11).select("formula_id", *rc("p_bootstrap"))


THIN, RESAMPLES = 66, 500
BT = "SELECT CAST(user_id AS VARCHAR) AS formula_id, event_type AS symbol, ts, (value-20.0)/100.0 AS pnl FROM events"
THIN_CV = {
    "bt": BT, "p": POS.replace("FROM trades", "FROM bt"), "fo": FOLDS, "fs": FOLD_STATS, "fp": FOLD_P, "cv": CV, "boot": boot_sql("CAST(user_id AS VARCHAR)", RESAMPLES),
    "num": "SELECT formula_id, count(*) AS n FROM bt GROUP BY 1",
    "cvb": f"SELECT formula_id, n, CASE WHEN n < {THIN} THEN p_bootstrap ELSE p_value END AS p_value, mean_oos, sharpe_oos FROM cv JOIN num USING (formula_id) JOIN boot USING (formula_id)",
}


@query("G12_sparse_bootstrap", with_views("", f"SELECT formula_id, {r('p_value','mean_oos','sharpe_oos')}, n AS total_trades FROM cvb", **THIN_CV))
def _(spark, folder):
    """Rules of few returns are judged by the bootstrap, the others by their folds; only the former are resampled."""
    t = _boot_trades(spark, folder)
    got = va.cv_stats(t, K, bootstrap=va.sparse_bootstrap(t, K, RESAMPLES, 11, below=THIN), bootstrap_below=THIN)
    return got.select("formula_id", *rc("p_value", "mean_oos", "sharpe_oos"), "total_trades")


@query(
    "G18_validate_with_bootstrap",
    with_views(
        "", "SELECT formula_id, n AS n_trades, round(p_value,6)+0.0::DOUBLE AS p_value, coalesce(ok,false) AS bh_accept, CASE WHEN n < 40 THEN 'min_trades' WHEN NOT ok THEN 'fdr' END AS rejected_by FROM num LEFT JOIN bh USING (formula_id)",
        **THIN_CV, bh="SELECT formula_id, p_value, p_value <= row_number() OVER (ORDER BY p_value, formula_id)/count(*) OVER ()::DOUBLE*0.1 AS ok FROM cvb WHERE n >= 40",
    ),
)
def _(spark, folder):
    t = _boot_trades(spark, folder)
    got = va.validate_population(
        t, t.select("formula_id").distinct(), 40, K, 0.1, 0.0, bootstrap=va.sparse_bootstrap(t, K, RESAMPLES, 11, below=THIN), use_dsr=False, bootstrap_below=THIN
    )
    return got.select("formula_id", "n_trades", *rc("p_value"), F.coalesce("bh_accept", F.lit(False)).alias("bh_accept"), "rejected_by")


LARGE = "SELECT event_type AS formula_id, count(*) AS n, count(*) FILTER (WHERE value > 20) AS w FROM events GROUP BY 1"


@query("G13_binomial_p_large", f"SELECT formula_id, n, w AS wins, round({BINOM},6) AS p_binomial FROM ({LARGE})")
def _(spark, folder):
    """Rules of thousands of trades: the same exact test."""
    return va.win_test(_boot_trades(spark, folder, "event_type")).select("formula_id", "n", "wins", *rc("p_binomial"))


# thousandths, halves upwards: the mean's last bits, which depend on the order of a sum, are rounded off before
PVALS = "SELECT formula_id, symbol, floor(round(least(1.0, abs(avg(pnl))*3)*1000, 6) + 0.5::DOUBLE)/1000.0::DOUBLE AS p_value FROM trades GROUP BY 1,2"
BH = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p_value, formula_id) AS bh_rank, count(*) OVER (PARTITION BY symbol) AS m FROM pv"


def _pvals(spark, folder):
    t = views.trades(spark, folder)
    p = F.floor(F.round(F.least(F.lit(1.0), F.abs(F.avg("pnl")) * 3) * 1000, 6) + 0.5) / 1000
    return t.groupBy("formula_id", "symbol").agg(p.alias("p_value"))


@query("G15_bh_fdr", with_views("trades", "SELECT formula_id, symbol, p_value, bh_rank, p_value <= bh_rank/m::DOUBLE*0.25 AS bh_accept, coalesce(max(CASE WHEN p_value <= bh_rank/m::DOUBLE*0.25 THEN p_value END) OVER (PARTITION BY symbol), 0) AS bh_threshold FROM b", pv=PVALS, b=BH))
def _(spark, folder):
    return va.bh_fdr(_pvals(spark, folder), 0.25, ["symbol"])


@query("G15_bh_step_up", with_views("trades", "SELECT formula_id, symbol, p_value, bh_rank <= coalesce(max(CASE WHEN p_value <= bh_rank/m::DOUBLE*0.6 THEN bh_rank END) OVER (PARTITION BY symbol), 0) AS bh_accept FROM b", pv=PVALS, b=BH))
def _(spark, folder):
    return va.bh_fdr(_pvals(spark, folder), 0.6, ["symbol"], step_up=True).select("formula_id", "symbol", "p_value", "bh_accept")


def dsr_sql(trials: str, source: str) -> str:
    z = f"((m/s - sqrt(2*ln(greatest(2,{trials})::DOUBLE))/sqrt(greatest(1,n-1)::DOUBLE))*sqrt(greatest(1,n-1)::DOUBLE))"
    return f"SELECT formula_id, CASE WHEN s IS NULL OR s = 0 THEN 0.0 ELSE {phi_sql('z')} END AS dsr_prob FROM (SELECT *, {z} AS z FROM (SELECT formula_id, count(*) AS n, avg(pnl) AS m, stddev_samp(pnl) AS s FROM {source} GROUP BY 1))"


@query("G16_deflated_sharpe", with_views("trades", "SELECT formula_id, round(dsr_prob,6) AS dsr_prob FROM d", up="SELECT formula_id, pnl+0.2 AS pnl FROM trades", d=dsr_sql("10", "up")))
def _(spark, folder):
    t = views.trades(spark, folder).withColumn("pnl", F.col("pnl") + 0.2)
    return va.deflated_sharpe(t, 10).select("formula_id", *rc("dsr_prob"))


PBO = {
    "perf": "SELECT o_orderpriority AS formula_id, CAST(o_custkey % 40 AS VARCHAR) AS symbol, round(avg(o_totalprice),2) AS mean_ret FROM orders GROUP BY 1,2",
    "sy": "SELECT DISTINCT symbol FROM perf",
    "dr": "SELECT split, symbol, row_number() OVER (PARTITION BY split ORDER BY md5('5|' || split || '|' || symbol), symbol) <= greatest(1, (SELECT count(*) FROM sy)//2) AS ins FROM sy, range(25) s(split)",
    "mm": "SELECT split, formula_id, avg(mean_ret) FILTER (WHERE ins) AS ism, avg(mean_ret) FILTER (WHERE NOT ins) AS oos FROM perf JOIN dr USING (symbol) GROUP BY 1,2",
    "rk": "SELECT split, formula_id, oos, row_number() OVER (PARTITION BY split ORDER BY ism DESC NULLS LAST, formula_id) AS ri, row_number() OVER (PARTITION BY split ORDER BY oos DESC NULLS LAST, formula_id)-1 AS ro, count(oos) OVER (PARTITION BY split) AS no, count(ism) OVER (PARTITION BY split) AS ni FROM mm",
}


def _perf(spark, folder):
    return views.table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("formula_id"), (F.col("o_custkey") % 40).cast("string").alias("symbol")
    ).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_ret"))


PBO_ROW = "SELECT count(*) AS valid_splits, count(*) FILTER (WHERE ro/(no-1)::DOUBLE > 0.5) AS overfit_splits, count(*) FILTER (WHERE ro/(no-1)::DOUBLE > 0.5)/count(*)::DOUBLE AS pbo FROM rk WHERE ri = 1 AND ni >= 2 AND no >= 2 AND oos IS NOT NULL"


@query("G17_pbo", with_views("", "SELECT valid_splits, overfit_splits, round(pbo,10) AS pbo FROM x", **PBO, x=PBO_ROW))
def _(spark, folder):
    return va.pbo(_perf(spark, folder), 25, 4, 5).select("valid_splits", "overfit_splits", *rc("pbo"))


@query("G38_pbo_gate", with_views("trades", "SELECT formula_id, count(*) AS n_trades FROM trades WHERE (SELECT pbo FROM x) <= 0.75 GROUP BY 1", **PBO, x=PBO_ROW))
def _(spark, folder):
    c = views.trades(spark, folder).groupBy("formula_id").agg(F.count(F.lit(1)).alias("n_trades"))
    return va.pbo_gate(c, va.pbo(_perf(spark, folder), 25, 4, 5), 0.75)


# trades shifted up so that some rules survive every gate
VT = "SELECT formula_id, symbol, ts, pnl + 0.16 + (CAST(formula_id AS BIGINT) % 10)/100.0 AS pnl FROM trades WHERE CAST(formula_id AS BIGINT) % 9 <> 4 OR pnl > 0.4"
VALID = {
    "vt": VT,
    "cnt": "SELECT formula_id, count(*) AS n_trades FROM vt GROUP BY 1",
    "en": "SELECT vt.* FROM vt JOIN cnt USING (formula_id) WHERE n_trades >= 30",
    "p": POS.replace("FROM trades", "FROM en"), "fo": FOLDS, "fs": FOLD_STATS, "fp": FOLD_P, "cv": CV,
    "bh": "SELECT *, p_value <= row_number() OVER (ORDER BY p_value, formula_id)/count(*) OVER ()::DOUBLE*0.1 AS ok FROM cv",
    "ds": dsr_sql("(SELECT count(*) FROM cnt)", "en"),
    "val": "SELECT formula_id, n_trades, p_value, mean_oos, sharpe_oos, ok AS bh_accept, dsr_prob, CASE WHEN n_trades < 30 THEN 'min_trades' WHEN NOT ok THEN 'fdr' WHEN dsr_prob < 0.6 THEN 'dsr' END AS rejected_by FROM cnt LEFT JOIN bh USING (formula_id) LEFT JOIN ds USING (formula_id)",
}


def _validated(spark, folder):
    t = views.trades(spark, folder)
    u = F.col("formula_id").cast("long")
    t = t.where((u % 9 != 4) | (F.col("pnl") > 0.4)).withColumn("pnl", F.col("pnl") + 0.16 + (u % 10) / 100.0)
    return va.validate_population(t, t.select("formula_id").distinct(), 30, K, 0.1, 0.6)


@query("G18_validate_population", with_views("trades", f"SELECT formula_id, n_trades, {r('p_value','mean_oos','sharpe_oos','dsr_prob')}, coalesce(bh_accept,false) AS bh_accept, rejected_by FROM val", **VALID))
def _(spark, folder):
    got = _validated(spark, folder)
    return got.select("formula_id", "n_trades", *rc("p_value", "mean_oos", "sharpe_oos", "dsr_prob"), F.coalesce("bh_accept", F.lit(False)).alias("bh_accept"), "rejected_by")


@query("G06_gate_diagnostic", with_views("trades", "SELECT round(avg((rejected_by IS NULL)::INT),10) AS survivor_density, quantile_cont(n_trades::DOUBLE,0.5) FILTER (WHERE rejected_by IS NULL) AS median_trades FROM val", **VALID))
def _(spark, folder):
    return pp.gate_diagnostic(cut_lineage(_validated(spark, folder))).select(*rc("survivor_density", "median_trades"))


@query("G19_rejection_summary", with_views("trades", "SELECT rejected_by || '_stage_strict' AS reason, count(*) AS rejected, list_slice(list(formula_id ORDER BY formula_id),1,25) AS sample_ids FROM val WHERE rejected_by IS NOT NULL GROUP BY 1", **VALID))
def _(spark, folder):
    return pp.rejection_summary(cut_lineage(_validated(spark, folder)), "strict")


@query("G33_dominant_rejection", with_views("trades", "SELECT reason, round(share,6) AS share, share >= 0.7 AS dominant FROM (SELECT arg_max(reason, c) AS reason, max(c)/sum(c)::DOUBLE AS share FROM (SELECT rejected_by || '_stage_strict' AS reason, count(*) AS c FROM val WHERE rejected_by IS NOT NULL GROUP BY 1))", **VALID))
def _(spark, folder):
    return pp.dominant_rejection(pp.rejection_summary(cut_lineage(_validated(spark, folder)), "strict")).withColumn("share", rounded("share"))


# the same over all rules of the table ``formulas``, traded on the hourly panel
TABLE_STATS = (
    "SELECT r.formula_id, count(pnl) AS n_trades, CASE WHEN count(pnl) = 0 THEN -1 WHEN stddev_samp(pnl) = 0 THEN 0 ELSE avg(pnl)/stddev_samp(pnl) END AS sharpe FROM rules r LEFT JOIN trade USING (formula_id) GROUP BY 1"
)
RULE_VALID = {
    **TABLE_CTES, "vt": "SELECT formula_id, symbol, ts, pnl FROM trade",
    **{k: v for k, v in VALID.items() if k not in ("vt", "cnt")},
}
RULE_VALID["val"] = VALID["val"].replace("FROM cnt LEFT JOIN", "FROM allrules LEFT JOIN")
RULE_VALID = {
    **{k: v for k, v in RULE_VALID.items() if k in TABLE_CTES or k == "vt"}, "cnt": VALID["cnt"],
    "allrules": "SELECT r.formula_id, coalesce(n_trades, 0) AS n_trades FROM rules r LEFT JOIN cnt USING (formula_id)",
    **{k: v for k, v in RULE_VALID.items() if k not in TABLE_CTES and k != "vt"}, "ds": dsr_sql("(SELECT count(*) FROM rules)", "en"),
}


def _rule_table(spark, folder):
    rules = fm.with_formula_id(views.formulas(spark, folder)).select("formula_id", "formula_json").distinct()
    trades = sg.evaluate_rules(views.bars_1h(spark, folder), RULE_SPEC, rules, "1h", FEE, SLIP)
    return rules, cut_lineage(trades.select("formula_id", "symbol", "ts", "pnl"))


def _rule_stats(spark, folder):
    rules, trades = _rule_table(spark, folder)
    return pp.formula_stats(trades, rules.select("formula_id"))


def _rule_validated(spark, folder):
    rules, trades = _rule_table(spark, folder)
    return va.validate_population(trades, rules.select("formula_id"), 30, K, 0.1, 0.6)


@query("G04_rule_table_diag", with_views("bars_1h formulas", "SELECT count(*) AS pop, round(avg((n_trades=0)::INT),4) AS zero_trade_pct, quantile_cont(n_trades::DOUBLE,0.5) FILTER (WHERE n_trades>0) AS trades_median, round(quantile_cont(n_trades::DOUBLE,0.9) FILTER (WHERE n_trades>0),10) AS trades_p90, round(quantile_cont(sharpe,0.5) FILTER (WHERE n_trades>0),8) AS sharpe_median, round(quantile_cont(sharpe,0.9) FILTER (WHERE n_trades>0),8) AS sharpe_p90 FROM s", **TABLE_CTES, s=TABLE_STATS))
def _(spark, folder):
    got = pp.population_diag(_rule_stats(spark, folder))
    return got.select("pop", "zero_trade_pct", *rc("trades_median", "trades_p90"), *rc("sharpe_median", "sharpe_p90", digits=8))


@query("G05_rule_table_degenerate", with_views("bars_1h formulas", "SELECT round(avg((n_trades=0)::INT),4) AS degenerate_pct, least(0.85, 0.5+0.02*count(*)/400.0::DOUBLE) AS \"limit\", avg((n_trades=0)::INT) >= least(0.85, 0.5+0.02*count(*)/400.0::DOUBLE) AS degenerate FROM s", **TABLE_CTES, s=TABLE_STATS))
def _(spark, folder):
    return pp.is_degenerate(_rule_stats(spark, folder), 400)


@query("G18_rule_table", with_views("bars_1h formulas", f"SELECT formula_id, n_trades, {r('p_value')}, {r('mean_oos','sharpe_oos','dsr_prob',digits=8)}, coalesce(bh_accept,false) AS bh_accept, rejected_by FROM val", **RULE_VALID))
def _(spark, folder):
    """Every rule of the table through all gates."""
    got = _rule_validated(spark, folder)
    return got.select("formula_id", "n_trades", *rc("p_value"), *rc("mean_oos", "sharpe_oos", "dsr_prob", digits=8), F.coalesce("bh_accept", F.lit(False)).alias("bh_accept"), "rejected_by")


@query("G06_rule_table_gate", with_views("bars_1h formulas", "SELECT round(avg((rejected_by IS NULL)::INT),10) AS survivor_density, quantile_cont(n_trades::DOUBLE,0.5) FILTER (WHERE rejected_by IS NULL) AS median_trades FROM val", **RULE_VALID))
def _(spark, folder):
    return pp.gate_diagnostic(cut_lineage(_rule_validated(spark, folder))).select(*rc("survivor_density", "median_trades"))


@query("G19_rule_table_rejections", with_views("bars_1h formulas", "SELECT rejected_by || '_stage_strict' AS reason, count(*) AS rejected, list_slice(list(formula_id ORDER BY formula_id),1,25) AS sample_ids FROM val WHERE rejected_by IS NOT NULL GROUP BY 1", **RULE_VALID))
def _(spark, folder):
    return pp.rejection_summary(cut_lineage(_rule_validated(spark, folder)), "strict")


@query("G33_rule_table_dominant", with_views("bars_1h formulas", "SELECT reason, round(share,6) AS share, share >= 0.7 AS dominant FROM (SELECT arg_max(reason, c) AS reason, max(c)/sum(c)::DOUBLE AS share FROM (SELECT rejected_by || '_stage_strict' AS reason, count(*) AS c FROM val WHERE rejected_by IS NOT NULL GROUP BY 1))", **RULE_VALID))
def _(spark, folder):
    return pp.dominant_rejection(pp.rejection_summary(cut_lineage(_rule_validated(spark, folder)), "strict")).withColumn("share", rounded("share"))


STAGES = ["relaxed", "base", "strict"]


@query("G07_escalate_stage", with_views("cycle_log", "SELECT cycle, survivor_density, median_trades, best_fitness, meets, ['relaxed','base','strict'][CASE WHEN q < 3 THEN 0 ELSE least(2, 1 + (q-3)//2) END + 1] AS stage FROM (SELECT *, sum(meets::INT) OVER (ORDER BY cycle)::BIGINT AS q FROM (SELECT *, survivor_density >= 0.33 AND median_trades >= 2 AS meets FROM cycle_log))"))
def _(spark, folder):
    return pp.escalate_stage(views.cycle_log(spark, folder), STAGES, 0.33, 2.0, 3)


@query("B16_apply_stage", with_views("cycle_log", "SELECT cycle, stage, coalesce(CASE stage WHEN 'relaxed' THEN 0.3 WHEN 'strict' THEN 0.05 END, 0.1)::DOUBLE AS fdr_alpha, coalesce(CASE stage WHEN 'relaxed' THEN 0.4 WHEN 'strict' THEN 0.7 END, 0.6)::DOUBLE AS dsr_min_prob, greatest(20, coalesce(CASE stage WHEN 'relaxed' THEN 10 WHEN 'strict' THEN 60 END,0)) AS min_trades FROM (SELECT cycle, CASE WHEN survivor_density < 0.33 THEN 'relaxed' WHEN median_trades >= 34 THEN 'strict' ELSE 'base' END AS stage FROM cycle_log)"))
def _(spark, folder):
    log = views.cycle_log(spark, folder)
    stage = F.when(F.col("survivor_density") < 0.33, "relaxed").when(F.col("median_trades") >= 34, "strict").otherwise("base")
    gates = log.select("cycle", stage.alias("stage"), F.lit(0.1).alias("fdr_alpha"), F.lit(0.6).alias("dsr_min_prob"), F.lit(20).alias("min_trades"))
    stages = spark.createDataFrame([("relaxed", 0.3, 0.4, 10), ("strict", 0.05, 0.7, 60)], "stage string, fdr_alpha double, dsr_min_prob double, min_trades int")
    return pp.apply_stage(gates, stages)


VARIANTS, DELTA = 64, 0.15


def probe_sql(tree, columns, leaf) -> str:
    """A rule with its leaf number ``d.leaf`` changed by the draw ``d``; ``leaf`` counts leaves from the left."""
    left, op, right = tree
    if op in ("AND", "OR"):
        return f"({probe_sql(left, columns, leaf)} {op} {probe_sql(right, columns, leaf)})"
    n = next(leaf)
    if any(isinstance(s, str) and s not in columns for s in (left, right)):
        return "false"

    def compared(o, value):
        side = left if isinstance(left, str) else f"{float(left)}::DOUBLE"
        return f"coalesce({side} {o.replace('!=', '<>').replace('==', '=')} {value}, {'true' if o == '!=' else 'false'})"

    told = right if isinstance(right, str) else f"{float(right)}::DOUBLE"
    flipped = compared(">" if op == "<" else "<", told)
    moved = flipped if isinstance(right, str) else f"CASE WHEN d.kind < 0.8 THEN {compared(op, f'{told}*(1+(2*d.size-1)*{DELTA}::DOUBLE)')} ELSE {flipped} END"
    return f"CASE WHEN d.leaf = {n} THEN {moved} ELSE {compared(op, told)} END"


def _leaf_count(tree) -> int:
    return _leaf_count(tree[0]) + _leaf_count(tree[2]) if isinstance(tree[0], list) else 1


def probe_ctes(rules) -> dict[str, str]:
    """Trades of every rule and of its variants, drawn and changed in SQL."""
    word = lambda at: f"('0x' || substr(h, {at}, 8))::BIGINT / 4294967296.0::DOUBLE"
    ids = ", ".join(f"('{tree_id(t)}', {_leaf_count(t)})" for t in rules)
    known = trades_ctes("bars_user", rules)
    varied = " UNION ALL ".join(
        f"SELECT d.id || '#' || d.i AS formula_id, symbol, ts, open, close, ({probe_sql(t, SQL_COLUMNS, itertools.count())})::INT AS sig FROM lagged, draw d WHERE d.id = '{tree_id(t)}'" for t in rules
    )
    return {
        **{k: known[k] for k in ("base", "raw", "lagged")},
        "draw": f"SELECT id, i, floor({word(1)}*n)::INT AS leaf, {word(9)} AS kind, {word(17)} AS size FROM (SELECT id, i, n, md5('7|' || id || '|' || i) AS h FROM (VALUES {ids}) AS t(id, n), range({VARIANTS}) x(i))",
        "sig": f"{known['sig']} UNION ALL {varied}",
        **{k: known[k] for k in ("edges", "trade")},
        "ps": "SELECT formula_id, avg(pnl) AS m, count(*) AS n, abs(min(cum)) AS mdd FROM (SELECT *, sum(pnl) OVER (PARTITION BY formula_id ORDER BY symbol, ts) AS cum FROM trade) GROUP BY 1",
        "probed": (
            f"SELECT l.id AS formula_id, count(*) FILTER (WHERE coalesce((b.m >= 0) = (v.m >= 0) AND v.mdd <= b.mdd*1.25, false))/{VARIANTS}.0::DOUBLE AS robust_score, any_value(b.m) AS base_mean, any_value(b.mdd) AS base_mdd, coalesce(any_value(b.n),0) AS n_trades "
            "FROM draw l LEFT JOIN ps b ON b.formula_id = l.id LEFT JOIN ps v ON v.formula_id = l.id || '#' || l.i GROUP BY 1"
        ),
    }


PROBE_CTES = probe_ctes(RULES)


def _probe_totals(spark, folder):
    bars = views.bars_user(spark, folder)
    return lambda rules: sg.rule_totals(bars, RULE_SPEC, rules, "6h", FEE, SLIP)


@query("G20_robust_score", with_views("bars_user", "SELECT formula_id, round(robust_score,10) AS robust_score, round(base_mean,10) AS base_mean, round(base_mdd,5) AS base_mdd, n_trades FROM probed", **PROBE_CTES))
def _(spark, folder):
    """All rules with 64 variants each."""
    got = pp.robust_score(None, sg.formula_table(spark, RULES), k=VARIANTS, totals=_probe_totals(spark, folder))
    return got.select("formula_id", *rc("robust_score", "base_mean"), rounded("base_mdd", 5).alias("base_mdd"), "n_trades")


GATED = (
    "SELECT formula_id, rejected_by, robust_score FROM (SELECT formula_id, CASE WHEN n < 30 THEN 'min_trades' WHEN robust_score < 0.55 THEN 'robust' END AS rejected_by, CASE WHEN n >= 30 THEN robust_score END AS robust_score "
    "FROM (SELECT p.*, p.n_trades AS n FROM probed p))"
)


def _gated(spark, folder):
    """Rules judged by their number of trades alone, then by robustness: the second gate on all of the first's survivors."""
    rules, totals = sg.formula_table(spark, RULES), _probe_totals(spark, folder)
    n = totals(rules).select("formula_id", "n_trades")
    judged = rules.join(n, "formula_id", "left").select("formula_id", F.when(F.coalesce("n_trades", F.lit(0)) < 30, "min_trades").alias("rejected_by"))
    judged = cut_lineage(judged)
    left = rules.join(judged.where(F.col("rejected_by").isNull()), "formula_id", "left_semi")
    return pp.robust_gate(judged, pp.robust_score(None, left, k=VARIANTS, totals=totals), 0.55)


@query("G18_robust_gate", with_views("bars_user", "SELECT formula_id, rejected_by, round(robust_score,10) AS robust_score FROM gated", **PROBE_CTES, gated=GATED))
def _(spark, folder):
    return _gated(spark, folder).select("formula_id", "rejected_by", *rc("robust_score"))


@query("G19_robust_rejections", with_views("bars_user", "SELECT rejected_by || '_stage_base' AS reason, count(*) AS rejected, list_slice(list(formula_id ORDER BY formula_id),1,25) AS sample_ids FROM gated WHERE rejected_by IS NOT NULL GROUP BY 1", **PROBE_CTES, gated=GATED))
def _(spark, folder):
    return pp.rejection_summary(cut_lineage(_gated(spark, folder)), "base")


@query("G21_cum_min_drawdown", with_views("trades", "SELECT formula_id, round(abs(min(cum)),10) AS mdd FROM (SELECT *, sum(pnl) OVER (PARTITION BY formula_id ORDER BY symbol, ts) AS cum FROM trades) GROUP BY 1"))
def _(spark, folder):
    return va.cum_min_drawdown(views.trades(spark, folder)).select("formula_id", *rc("mdd"))


LONG = " UNION ALL ".join(f"SELECT symbol, ts, '{f}' AS feature, {f} AS value FROM lagged" for f in RULE_FEATURES)


@query(
    "G22_feature_stats",
    with_views(
        "bars_user",
        f"SELECT feature, {r('non_null_ratio','variance','min','q10','q25','median','q75','q90','max')}, non_null_ratio >= 0.3 AND variance >= 1e-6 AS keep FROM (SELECT feature, coalesce(var_samp(value),0) AS variance, min(value) AS min, quantile_cont(value,0.1) AS q10, "
        "quantile_cont(value,0.25) AS q25, quantile_cont(value,0.5) AS median, quantile_cont(value,0.75) AS q75, quantile_cont(value,0.9) AS q90, max(value) AS max FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY symbol, ts)-1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM l WHERE value IS NOT NULL) "
        "WHERE k % greatest(1, n//50) = 0 GROUP BY 1) JOIN (SELECT feature, count(value)/count(*)::DOUBLE AS non_null_ratio FROM l GROUP BY 1) USING (feature)",
        base=base("bars_user"), raw=raw_sql(RULE_FEATURES), lagged=lag_sql(RULE_FEATURES), l=LONG,
    ),
)
def _(spark, folder):
    panel = build_features(views.bars_user(spark, folder), RULE_SPEC, "6h")
    got = pp.feature_stats(pp.feature_long(panel, RULE_FEATURES))
    return got.select("feature", *rc("non_null_ratio", "variance", "min", "q10", "q25", "median", "q75", "q90", "max"), "keep")


CONT = "SELECT feature, count(*) AS cycles, avg(active::INT) AS continuity, count(*) >= 5 AND avg(active::INT) < 0.4 AS suppress FROM feature_log GROUP BY 1"


@query("G23_feature_continuity", with_views("feature_log", "SELECT feature, cycles, round(continuity,6) AS continuity, suppress FROM c", c=CONT))
def _(spark, folder):
    return pp.feature_continuity(views.feature_log(spark, folder), 5, 0.4).withColumn("continuity", rounded("continuity"))


@query("G24_affected_formulas", with_views("formulas", "SELECT formula_no, row_number() OVER (ORDER BY formula_no) <= greatest(1, floor(count(*) OVER ()*0.3)) AS replace FROM formulas WHERE formula_json LIKE '%\"legacy_x\"%' OR formula_json LIKE '%\"roc_5\"%'"))
def _(spark, folder):
    bad = spark.createDataFrame([("legacy_x",), ("roc_5",)], "feature string")
    return pp.affected_formulas(views.formulas(spark, folder), bad, 0.3)


SURV = "SELECT CAST(o_custkey AS VARCHAR) AS alpha_id, o_orderkey AS found_no, round(o_totalprice/1000, 7) AS sharpe FROM orders"


@query("G25_top_survivors", with_views("", "SELECT alpha_id, found_no, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY alpha_id ORDER BY found_no DESC) AS k FROM s) WHERE k=1 ORDER BY sharpe DESC, alpha_id LIMIT 10", s=SURV))
def _(spark, folder):
    s = views.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("alpha_id"), F.col("o_orderkey").alias("found_no"), F.round(F.col("o_totalprice") / 1000, 7).alias("sharpe")
    )
    return pp.top_survivors(s, 10)


CAND = (
    "SELECT s.alpha_id, f.formula_json, s.n_trades, round(s.sortino,6) AS sortino, round(s.sharpe,6) AS sharpe, s.lane, s.universe, round(s.win_rate,6) AS win_rate, round(s.mdd,6) AS mdd, s.portfolio_id FROM alpha_stats s JOIN formulas f ON f.formula_no = CAST(s.alpha_id AS BIGINT)"
)


def _candidates(spark, folder):
    s = views.alpha_stats(spark, folder)
    f = views.formulas(spark, folder).withColumn("alpha_id", F.col("formula_no").cast("string"))
    return s.join(f, "alpha_id").select("alpha_id", "formula_json", "n_trades", *rc("sortino", "sharpe", digits=6), "lane", "universe", *rc("win_rate", "mdd", digits=6), "portfolio_id")


@query("G26_promote", with_views("alpha_stats formulas", "SELECT alpha_id, formula_json, sortino FROM (SELECT *, row_number() OVER (PARTITION BY formula_json ORDER BY sortino DESC, alpha_id DESC) AS k FROM c WHERE n_trades >= 8 AND formula_json NOT IN (SELECT formula_json FROM c WHERE portfolio_id = 3)) WHERE k = 1 ORDER BY sortino DESC, alpha_id DESC LIMIT 7", c=CAND))
def _(spark, folder):
    c = _candidates(spark, folder)
    active = c.where(F.col("portfolio_id") == 3).select("formula_json")
    return pp.promote(c, active, 8, 10, 12, 5).select("alpha_id", "formula_json", "sortino")


@query("C16_exclude_existing", with_views("alpha_stats formulas", "SELECT alpha_id, sha256(formula_json) AS formula_id FROM c WHERE formula_json NOT IN (SELECT formula_json FROM c WHERE lane='core')", c=CAND))
def _(spark, folder):
    c = fm.with_formula_id(_candidates(spark, folder))
    return pp.exclude_existing(c, c.where(F.col("lane") == "core")).select("alpha_id", "formula_id")


@query("B14_promotion_gate", with_views("alpha_stats formulas", "SELECT alpha_id FROM c WHERE n_trades >= 9 AND sortino >= -0.05*1.1 AND sharpe >= -0.05*1.1 AND win_rate >= 0.35 AND mdd <= 0.249", c=CAND))
def _(spark, folder):
    c = _candidates(spark, folder)
    return c.where(pp.promotion_gate(c, 9, -0.05, -0.05, 0.35, 0.249, 1.1)).select("alpha_id")


@query("G37_prune_stale", with_views("alpha_stats formulas", "SELECT alpha_id, n_trades, sharpe FROM c WHERE NOT (n_trades >= 10 AND sharpe < 0)", c=CAND))
def _(spark, folder):
    return pp.prune_stale(_candidates(spark, folder), 10).select("alpha_id", "n_trades", "sharpe")


RET = "SELECT alpha_id, ret, row_number() OVER (PARTITION BY alpha_id ORDER BY ts, trade_id) AS pos, count(*) OVER (PARTITION BY alpha_id) AS n FROM alpha_returns"
REC = (
    "SELECT CAST(alpha_id AS BIGINT) AS record_no, alpha_id, greatest(1, n_trades - CAST(alpha_id AS BIGINT) % 8) AS n_trades, round(sharpe,6) AS sharpe, round(sortino,6) AS sortino, round(win_rate,6) AS win_rate, round(mdd,6) AS mdd FROM alpha_stats UNION ALL "
    "SELECT CAST(alpha_id AS BIGINT) + 1000000000, alpha_id, n_trades, 0, 0, 0, 0 FROM alpha_stats WHERE portfolio_id < 6"
)
RRET = (
    "SELECT CAST(r.alpha_id AS BIGINT) AS record_no, pos, CASE WHEN pos > q.n_trades AND CAST(r.alpha_id AS BIGINT) % 5 < 3 THEN 0.0 ELSE ret END AS ret FROM rets r JOIN rec q ON q.record_no = CAST(r.alpha_id AS BIGINT)"
)
HYG = (
    "SELECT rec.*, CASE WHEN record_no <> f THEN 'duplicate' WHEN NOT (n_trades >= 5 AND sharpe >= -0.1 AND mdd <= 1) THEN 'gated' ELSE 'kept' END AS status, "
    "record_no = f AND coalesce(n_trades > 0 AND ex > 0 AND live = 0 AND ex <= 5, false) AS trimmed, coalesce(nr,0) - CASE WHEN coalesce(n_trades > 0 AND ex > 0 AND live = 0 AND ex <= 5, false) THEN ex ELSE 0 END AS kept_returns "
    "FROM rec JOIN (SELECT alpha_id, min(record_no) AS f FROM rec GROUP BY 1) USING (alpha_id) LEFT JOIN (SELECT record_no, count(*) AS nr, count(*) FILTER (WHERE pos > n_trades) AS ex, count(*) FILTER (WHERE pos > n_trades AND ret <> 0) AS live FROM rr JOIN rec USING (record_no) GROUP BY 1) USING (record_no)"
)
HYG_CTES = {"rets": RET, "rec": REC, "rr": RRET, "h": HYG}


def _hygiene(spark, folder):
    s = views.alpha_stats(spark, folder)
    no = F.col("alpha_id").cast("long")
    zero = F.lit(0.0)
    rec = s.select(no.alias("record_no"), "alpha_id", F.greatest(F.lit(1), F.col("n_trades") - no % 8).alias("n_trades"), *rc("sharpe", "sortino", "win_rate", "mdd", digits=6)).unionByName(
        s.where(F.col("portfolio_id") < 6).select((no + 1_000_000_000).alias("record_no"), "alpha_id", "n_trades", zero.alias("sharpe"), zero.alias("sortino"), zero.alias("win_rate"), zero.alias("mdd"))
    )
    ranked = positions(views.alpha_returns(spark, folder), ["alpha_id"], ["ts", "trade_id"], time_slot("ts", 365 * 86400))
    own = rec.select("record_no", F.col("n_trades").alias("_n"))
    rets = ranked.withColumn("record_no", no).join(own, "record_no").select(
        "record_no", "pos", F.when((F.col("pos") > F.col("_n")) & (no % 5 < 3), 0.0).otherwise(F.col("ret")).alias("ret")
    )
    return pp.registry_hygiene(rec, rets, pp.promotion_gate(rec, 5, -9.0, -0.1, 0.0, 1.0))


@query("G27_registry_hygiene", with_views("alpha_stats", "SELECT * FROM h", **HYG_CTES))
def _(spark, folder):
    return _hygiene(spark, folder)


@query("G27_hygiene_counters", with_views("alpha_stats", "SELECT count(*) FILTER (WHERE status='duplicate') AS dupes_removed, count(*) FILTER (WHERE trimmed) AS trimmed, count(*) FILTER (WHERE status='gated') AS dropped_gates, count(*) FILTER (WHERE status='kept') AS final FROM h", **HYG_CTES))
def _(spark, folder):
    return pp.hygiene_counters(_hygiene(spark, folder))


TAIL = "SELECT alpha_id, ret, row_number() OVER (PARTITION BY alpha_id ORDER BY ts DESC, trade_id DESC) AS k, count(*) OVER (PARTITION BY alpha_id) AS n FROM tr"
PRIO = "SELECT o_orderpriority || '/' || o_orderstatus AS alpha_id, o_orderdate AS ts, o_orderkey AS trade_id, (o_totalprice - 250000.0)/1e6 AS ret FROM orders"


def _priority_returns(spark, folder):
    return views.table(spark, folder, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("alpha_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("trade_id"),
        ((F.col("o_totalprice") - 250000.0) / 1e6).alias("ret"),
    )


def _from_end(spark, folder):
    back = -time_slot("ts", 365 * 86400)
    return positions(_priority_returns(spark, folder), ["alpha_id"], [F.desc("ts"), F.desc("trade_id")], back, "from_end")


F1, F2 = "1-URGENT/F", "2-HIGH/O"


@query(
    "G28_vif",
    with_views(
        "", "SELECT alpha_id, CASE WHEN n < 10 THEN 1.0 ELSE round(1/(1-least(greatest((ya*ya+yb*yb-2*ya*yb*ab)/(1-ab*ab),0),0.999999)),6) END AS vif FROM (SELECT c.alpha_id, any_value(least(c.n, mf)) AS n, corr(c.ret, a.ret) AS ya, corr(c.ret, b.ret) AS yb, corr(a.ret, b.ret) AS ab "
        "FROM t c, (SELECT min(n) AS mf FROM t WHERE alpha_id IN ('1-URGENT/F','2-HIGH/O')) JOIN t a ON a.alpha_id='1-URGENT/F' AND a.k=c.k JOIN t b ON b.alpha_id='2-HIGH/O' AND b.k=c.k WHERE c.alpha_id NOT IN ('1-URGENT/F','2-HIGH/O') AND c.k <= least(c.n, mf) GROUP BY 1)",
        tr=PRIO, t=TAIL,
    ),
)
def _(spark, folder):
    return rd.vif(_from_end(spark, folder), [F1, F2]).withColumn("vif", rounded("vif"))


@query(
    "G36_factor_correlation",
    with_views(
        "", "SELECT alpha_id, round(mx,6) AS max_corr, coalesce(mx <= 0.05, true) AS allowed FROM (SELECT alpha_id, greatest(abs(max(c) FILTER (WHERE f='1-URGENT/F')), abs(max(c) FILTER (WHERE f='2-HIGH/O'))) AS mx FROM (SELECT x.alpha_id, y.alpha_id AS f, corr(x.ret, y.ret) AS c FROM d x JOIN d y USING (ts) WHERE y.alpha_id IN ('1-URGENT/F','2-HIGH/O') AND x.alpha_id NOT IN ('1-URGENT/F','2-HIGH/O') GROUP BY 1,2 HAVING count(*) >= 3) GROUP BY 1)",
        tr=PRIO, d="SELECT alpha_id, ts, sum(ret) AS ret FROM tr GROUP BY 1,2",
    ),
)
def _(spark, folder):
    return rd.factor_correlation(_priority_returns(spark, folder), [F1, F2], 0.05).withColumn("max_corr", rounded("max_corr"))


MEASURES = {"q": "(l_quantity - 25.5)/25.0", "p": "(l_extendedprice - 38000.0)/25000.0", "d": "(l_discount - 0.05)*20.0", "t": "(l_tax - 0.04)*25.0"}
HELD, GROUPS = 66, 18
LINES = (
    "SELECT l_partkey % 18 AS g, row_number() OVER (PARTITION BY l_partkey % 18 ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice, l_quantity, l_discount, l_tax) AS k, "
    + ", ".join(f"({sql})::DOUBLE AS {m}" for m, sql in MEASURES.items()) + " FROM lineitem"
)
SERIES = " UNION ALL ".join(f"SELECT '{m}' || lpad(g::VARCHAR, 2, '0') AS alpha_id, k, {m} AS ret FROM lines" for m in MEASURES)


def _line_series(spark, folder):
    """72 series, four measures of the line items of 18 groups of parts, with positions from the end."""
    li = views.table(spark, folder, "lineitem").withColumn("g", F.col("l_partkey") % GROUPS)
    order = [F.desc("l_orderkey"), F.desc("l_linenumber"), "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    ranked = positions(li, ["g"], order, -F.floor(F.col("l_orderkey") / 65536), "from_end")
    wide = ranked.select("g", "from_end", *(F.expr(sql).cast("double").alias(m) for m, sql in MEASURES.items()))
    long = wide.unpivot(["g", "from_end"], list(MEASURES), "m", "ret").select(F.concat("m", F.lpad(F.col("g").cast("string"), 2, "0")).alias("alpha_id"), "from_end", "ret")
    return stored(long, "series")  # read several times


# elimination of all factors from the matrix of a candidate, which is its last row: what is left of it over what it was
ELIMINATE = "list_transform(m, lambda row, r: CASE WHEN r > i THEN list_transform(row, lambda x, c: x - row[i]/m[i][i]*m[i][c]) ELSE row END)"
MANY = {
    "lines": LINES, "s": SERIES,
    "ids": f"SELECT alpha_id, count(*) AS n, row_number() OVER (ORDER BY alpha_id) - 1 AS f FROM s GROUP BY 1",
    "held": f"SELECT alpha_id, f FROM ids WHERE f < {HELD}",
    "cand": f"SELECT alpha_id, least(n, (SELECT min(n) FROM ids WHERE f < {HELD})) AS n FROM ids WHERE f >= {HELD}",
    "cut": "SELECT c.alpha_id AS cand, s.k, coalesce(h.f, 1000) AS f, s.ret FROM cand c JOIN s ON s.k <= c.n LEFT JOIN held h ON h.alpha_id = s.alpha_id WHERE h.f IS NOT NULL OR s.alpha_id = c.alpha_id",
    "cov": "SELECT a.cand, a.f, b.f AS g, covar_pop(a.ret, b.ret) AS c FROM cut a JOIN cut b USING (cand, k) GROUP BY 1, 2, 3",
    "mat": "SELECT cand, list(row ORDER BY f) AS m FROM (SELECT cand, f, list(c ORDER BY g) AS row FROM cov GROUP BY 1, 2) GROUP BY 1",
    "el": f"SELECT cand, 1 AS i, m, m[{HELD + 1}][{HELD + 1}] AS v FROM mat UNION ALL SELECT cand, i + 1, {ELIMINATE}, v FROM el WHERE i <= {HELD}",
}


@query(
    "G28_vif_many_factors",
    "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in MANY.items())
    + f" SELECT cand AS alpha_id, round(v / m[{HELD + 1}][{HELD + 1}], 5) AS vif FROM el WHERE i = {HELD + 1}",
)
def _(spark, folder):
    """Six series against 66 factors."""
    series = _line_series(spark, folder)
    names = series.select("alpha_id").distinct().orderBy("alpha_id").limit(HELD)
    return rd.vif(series, names).withColumn("vif", rounded("vif", 5))


@query(
    "G36_many_factors",
    with_views(
        "", f"SELECT alpha_id, round(max(abs(c)),6) AS max_corr, coalesce(max(abs(c)) <= 0.1, true) AS allowed FROM (SELECT x.alpha_id, y.alpha_id AS o, corr(x.ret, y.ret) AS c FROM s x JOIN ids i ON i.alpha_id = x.alpha_id AND i.f >= {HELD} JOIN s y USING (k) JOIN held h ON h.alpha_id = y.alpha_id GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1",
        **{n: MANY[n] for n in ("lines", "s", "ids", "held")},
    ),
)
def _(spark, folder):
    series = _line_series(spark, folder)
    names = series.select("alpha_id").distinct().orderBy("alpha_id").limit(HELD)
    return rd.factor_correlation(series, names, 0.1, at="from_end").withColumn("max_corr", rounded("max_corr"))


RANK = "SELECT alpha_id, formula_json, sharpe*0.7::DOUBLE + win_rate*0.3::DOUBLE AS fitness, sharpe*0.7::DOUBLE + win_rate*0.3::DOUBLE - (length(formula_json)-length(replace(formula_json,'[','')))*0.001::DOUBLE AS penalised FROM (SELECT *, row_number() OVER (PARTITION BY formula_json ORDER BY alpha_id) AS k FROM c) WHERE k = 1"


@query("G29_rank_population", with_views("alpha_stats formulas", "SELECT alpha_id, formula_json, round(fitness,9)+0.0::DOUBLE AS fitness, round(penalised,9)+0.0::DOUBLE AS penalised, row_number() OVER (ORDER BY penalised DESC, formula_json) AS rank, row_number() OVER (ORDER BY penalised DESC, formula_json) <= greatest(1, floor(count(*) OVER ()*0.1)) AS elite FROM x", c=CAND, x=RANK))
def _(spark, folder):
    from barloom.sources.lake import keep_first

    c = keep_first(_candidates(spark, folder).select("alpha_id", "formula_json", "sharpe", "win_rate"), ["formula_json"], ["alpha_id"])
    got = pp.rank_population(c, {"sharpe": 0.7, "win_rate": 0.3}, 0.001)
    return got.select("alpha_id", "formula_json", *rc("fitness", "penalised", digits=9), "rank", "elite")


@query("G30_stagnation_flags", with_views("cycle_log", "SELECT cycle, best_fitness, coalesce(best_fitness <= lag(best_fitness, 7) OVER (ORDER BY cycle) + 0.02, false) AS stagnant FROM cycle_log"))
def _(spark, folder):
    return pp.stagnation_flags(views.cycle_log(spark, folder), 8, 0.02).select("cycle", "best_fitness", "stagnant")


LEAVES = "unnest(regexp_extract_all(formula_json, '\\[\"([^\"]+)\",\"(?:<=|>=|==|!=|<|>)\"', 1))"


@query("G31_feature_leaderboard", with_views("alpha_stats formulas", f"SELECT feature, count(*) AS uses, round(avg(sharpe),6)+0.0::DOUBLE AS avg_fitness FROM (SELECT sharpe, {LEAVES} AS feature FROM c) GROUP BY 1 HAVING count(*) >= 10 ORDER BY avg(sharpe) DESC LIMIT 3", c=CAND))
def _(spark, folder):
    got = pp.feature_leaderboard(_candidates(spark, folder), "sharpe", 10, 3)
    return got.withColumn("avg_fitness", rounded("avg_fitness"))


FSETS = f"SELECT formula_no, list_sort(list(DISTINCT feature)) AS fs FROM (SELECT formula_no, {LEAVES} AS feature FROM formulas) GROUP BY 1"
JAC = "len(list_intersect(a.fs, b.fs))/len(list_distinct(list_concat(a.fs, b.fs)))::DOUBLE"


SET_COUNTS = "SELECT fs, count(*) AS c FROM f GROUP BY 1"
PAIRS = f"SELECT j, sum(n)::BIGINT AS pairs FROM (SELECT {JAC} AS j, a.c*b.c AS n FROM s a JOIN s b ON a.fs < b.fs UNION ALL SELECT 1.0::DOUBLE, c*(c-1)//2 FROM s) WHERE n > 0 GROUP BY 1"


@query("G32_jaccard_counts", with_views("formulas", "SELECT round(j,6) AS jaccard, pairs FROM x", f=FSETS, s=SET_COUNTS, x=PAIRS))
def _(spark, folder):
    return rd.jaccard_counts(views.formulas(spark, folder)).withColumn("jaccard", rounded("jaccard"))


@query("G32_formula_diversity", with_views("formulas", "SELECT round(m,10) AS median_jaccard, n AS pairs, round(1-m,10) AS diversity FROM (SELECT sum(pairs)::BIGINT AS n, (min(j) FILTER (WHERE last > (tot-1)//2) + min(j) FILTER (WHERE last > ceil((tot-1)/2.0)))/2 AS m FROM (SELECT *, sum(pairs) OVER (ORDER BY j) AS last, sum(pairs) OVER () AS tot FROM x))", f=FSETS, s=SET_COUNTS, x=PAIRS))
def _(spark, folder):
    got = rd.formula_diversity(views.formulas(spark, folder))
    return got.select(*rc("median_jaccard"), "pairs", *rc("diversity"))


@query(
    "G32_species",
    with_views(
        "formulas", "SELECT label, count(*) AS sets, sum(rules)::BIGINT AS rules FROM (SELECT r.a, min(r.b) AS label, any_value(t.c) AS rules FROM reach r JOIN t ON t.id = r.a GROUP BY r.a) GROUP BY 1",
        f=FSETS, t="SELECT array_to_string(fs, chr(1)) AS id, fs, count(*) AS c FROM f GROUP BY 1,2",
        e="SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON len(list_intersect(a.fs, b.fs))/len(list_distinct(list_concat(a.fs, b.fs)))::DOUBLE >= 0.6",
        reach="SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, folder):
    return rd.cluster_sizes(rd.species(views.formulas(spark, folder), 0.6))


@query(
    "G33_fitness_penalties",
    with_views(
        "trades",
        "SELECT formula_id, round(sharpe - (mdd*0.4 + coalesce(conc,0)*0.25 + coalesce(vr,0)*0.15),10)+0.0::DOUBLE AS fitness FROM (SELECT formula_id, avg(pnl)/stddev_samp(pnl) AS sharpe, max(greatest(peak,0)-cum) AS mdd FROM (SELECT *, max(cum) OVER (PARTITION BY formula_id ORDER BY symbol, ts) AS peak FROM "
        "(SELECT *, sum(pnl) OVER (PARTITION BY formula_id ORDER BY symbol, ts) AS cum FROM trades)) GROUP BY 1) JOIN (SELECT formula_id, max(abs(t))/sum(abs(t)) AS conc, var_samp(m) AS vr FROM (SELECT formula_id, symbol, sum(pnl) AS t, avg(pnl) AS m FROM trades GROUP BY 1,2) GROUP BY 1) USING (formula_id)",
    ),
)
def _(spark, folder):
    t = views.trades(spark, folder)
    by = t.groupBy("formula_id", "symbol").agg(F.sum("pnl").alias("total"), F.avg("pnl").alias("mean_ret"))
    return pp.fitness_penalties(va.performance_summary(t), by).select("formula_id", *rc("fitness"))


@query("G34_seed_features", with_views("alpha_stats formulas", "SELECT DISTINCT unnest(regexp_extract_all(formula_json, '\\[\"([^\"]+)\",\"(?:<|>)\"', 1)) AS feature FROM (SELECT * FROM c ORDER BY sortino DESC, alpha_id LIMIT (SELECT greatest(1, count(*)//10) FROM c))", c=CAND))
def _(spark, folder):
    return pp.seed_features(_candidates(spark, folder))


@query("G35_history_union", "SELECT event_id, CASE WHEN event_type IN ('click','view') THEN 'proposal' ELSE 'injection' END AS type, (epoch_us(ts)//1000000)::BIGINT AS ts, time_bucket(INTERVAL '1 second', ts, TIMESTAMP '1970-01-01') AS time FROM events")
def _(spark, folder):
    ev = views.table(spark, folder, "events")
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts")
    is_p = F.col("event_type").isin("click", "view")
    return pp.history_union({"proposal": ev.where(is_p).select("event_id", sec), "injection": ev.where(~is_p).select("event_id", sec)})


@query("B18_survivor_report", with_views("alpha_stats formulas", "SELECT substr(alpha_id,1,8) AS id, sharpe AS score, n_trades AS trades, substr(CASE WHEN length(formula_json)>160 THEN substr(formula_json,1,157)||'...' ELSE formula_json END,1,120) AS formula_preview FROM c", c=CAND))
def _(spark, folder):
    return pp.survivor_report(_candidates(spark, folder))


@query("B19_candidate_table", with_views("alpha_stats formulas", "SELECT alpha_id, sharpe, found_at + INTERVAL '48 hours' AS expires_at FROM (SELECT *, TIMESTAMP '2024-01-01' AS found_at FROM c) WHERE found_at + INTERVAL '48 hours' > TIMESTAMP '2024-01-02 12:00:00'", c=CAND))
def _(spark, folder):
    c = pp.candidate_table(_candidates(spark, folder), "2024-01-01 00:00:00")
    return pp.live_candidates(c, "2024-01-02 12:00:00").select("alpha_id", "sharpe", "expires_at")


@query("B20_alpha_report", with_views("alpha_stats formulas", "SELECT substr(alpha_id,1,8) AS id, lane, universe[1] AS symbol, CASE WHEN portfolio_id<3 THEN 0 ELSE n_trades END AS trades, CASE WHEN portfolio_id<3 THEN 0 ELSE sharpe END AS sharpe, CASE WHEN portfolio_id<3 THEN 0 ELSE sortino END AS sortino, CASE WHEN portfolio_id<3 THEN 0 ELSE win_rate END AS win_rate, CASE WHEN portfolio_id<3 THEN 0 ELSE mdd END AS mdd FROM c", c=CAND))
def _(spark, folder):
    c = _candidates(spark, folder)
    regime = F.when(F.col("portfolio_id") < 3, "bull").otherwise("all")
    return pp.alpha_report(c.withColumn("performance", F.create_map(regime, F.struct("n_trades", "sharpe", "sortino", "win_rate", "mdd"))))


@query("J_normal_and_t", with_views("trades", f"SELECT formula_id, round({phi_sql('z')},6) AS phi, round({t_p_sql('m','s','n')},6) AS p FROM (SELECT *, m/s*3 AS z FROM (SELECT formula_id, count(*) AS n, avg(pnl) AS m, stddev_samp(pnl) AS s FROM trades GROUP BY 1))"))
def _(spark, folder):
    """Distribution functions on aggregated rows."""
    g = views.trades(spark, folder).groupBy("formula_id").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"))
    z = F.col("m") / F.col("s") * 3
    return g.select("formula_id", rounded(st.norm_cdf(z)).alias("phi"), rounded(st.t_test_p(F.col("m"), F.col("s"), F.col("n"))).alias("p"))
