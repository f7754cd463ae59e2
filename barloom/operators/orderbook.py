"""Order-book operators on arrays of (price, size) levels (H-01 ... H-04, C-08).

A book is one row of levels, best first; the operators fold its arrays inside the row and need no shuffle.  ``depth``
limits an operator to that many levels where its source promises no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import col


def top_levels(levels: str | Column, n: int) -> Column:
    """H-04: the best ``n`` levels."""
    return F.slice(col(levels), 1, n)


def _best(levels: Column) -> Column:
    return F.try_element_at(levels, F.lit(1))["price"]


def _fill(levels: Column, need: Column, enough: Column, cost_of) -> Column:
    """Walk levels until ``enough`` of ``need`` is taken; ``cost_of`` gives a level's size in the unit of ``need``."""
    start = F.struct(F.lit(0.0).alias("taken"), F.lit(0.0).alias("other"))

    def step(acc, lvl):
        take = F.least(cost_of(lvl), need - acc["taken"])
        use = (acc["taken"] < enough) & (take > 0)
        other = take / lvl["price"]
        return F.struct(
            F.when(use, acc["taken"] + take).otherwise(acc["taken"]).alias("taken"),
            F.when(use, acc["other"] + other).otherwise(acc["other"]).alias("other"),
        )

    return F.aggregate(levels, start, step)


def _to_depth(levels: str | Column, depth: int | None) -> Column:
    return col(levels) if depth is None else top_levels(levels, depth)


def book_impact_bps(bids: str | Column, asks: str | Column, notional_usd, usd_per_quote, depth: int | None = None) -> Column:
    """H-01: cost of buying a dollar notional, volume-weighted price over mid in basis points.

    Levels of size zero are passed over.  NULL when a side is empty, less than 99.9 % can be filled, or the price runs over 1.25 times the best ask.
    """
    b, a = _to_depth(bids, depth), _to_depth(asks, depth)
    need = F.lit(notional_usd) / F.greatest(col(usd_per_quote), F.lit(1e-12))
    fill = _fill(a, need, need * 0.999, lambda x: x["price"] * x["size"])
    vwap = F.try_divide(fill["taken"], fill["other"])
    mid = 0.5 * (_best(b) + _best(a))
    ok = (F.size(b) > 0) & (F.size(a) > 0) & (_best(b) > 0) & (_best(a) > 0) & (fill["taken"] >= need * 0.999) & (vwap <= _best(a) * 1.25)
    return F.when(ok, 10000.0 * (vwap - mid) / mid)


def book_fill_vwap(bids: str | Column, asks: str | Column, notional_usd, side: str | Column, depth: int | None = None) -> Column:
    """H-02: fill of a dollar notional at the best price's quantity, either side: (ok, vwap, mid, slip_bps)."""
    b, a, s = _to_depth(bids, depth), _to_depth(asks, depth), col(side)
    buy = s == "buy"
    book = F.when(buy, a).otherwise(b)
    mid = 0.5 * (_best(b) + _best(a))
    qty = F.lit(notional_usd) / F.greatest(F.when(buy, _best(a)).otherwise(_best(b)), F.lit(1e-12))
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def step(acc, lvl):
        take = F.greatest(F.least(lvl["size"], qty - acc["filled"]), F.lit(0.0))
        return F.struct((acc["filled"] + take).alias("filled"), (acc["cost"] + take * lvl["price"]).alias("cost"))

    fill = F.aggregate(book, start, step)
    ok = (F.size(b) > 0) & (F.size(a) > 0) & (fill["filled"] >= qty)
    vwap = F.try_divide(fill["cost"], fill["filled"])
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(
        ok.cast("int").alias("ok"), F.when(ok, vwap).alias("vwap"), F.when(ok, mid).alias("mid"),
        F.when(ok, F.abs(vwap - mid) / mid * 10000.0).alias("slip_bps"),
    )


def orderflow_features(df: DataFrame, n: int = 5, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """H-03: spread over best bid, depth, imbalance and microprice deviation of the top ``n`` levels.

    An empty side gives a NULL spread and zeros.
    """
    b, a = col(bids), col(asks)
    total = lambda x: F.aggregate(F.transform(top_levels(x, n), lambda v: v["size"]), F.lit(0.0), lambda s, v: s + v)
    df = df.withColumns({"_bb": _best(b), "_ba": _best(a), "_tb": total(b), "_ta": total(a)})
    full = (F.size(b) > 0) & (F.size(a) > 0)
    depth = F.col("_tb") + F.col("_ta")
    mid = 0.5 * (F.col("_bb") + F.col("_ba"))
    micro = F.when(depth > 0, (F.col("_bb") * F.col("_ta") + F.col("_ba") * F.col("_tb")) / depth).otherwise(mid)
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "of_spread_bps": F.when(full & (F.col("_bb") > 0), (F.col("_ba") - F.col("_bb")) / F.col("_bb") * 10000.0),
            "of_depth": F.when(full, depth).otherwise(zero),
            "of_imbalance": F.when(full & (depth > 0), (F.col("_tb") - F.col("_ta")) / depth).otherwise(zero),
            "of_microprice_dev": F.when(full & (mid > 0), (micro - mid) / mid).otherwise(zero),
        }
    ).drop("_bb", "_ba", "_tb", "_ta")


def impact_screen(candidates: DataFrame, books: DataFrame, order_usd: float, max_impact_bps: float, keys=("venue_symbol",)) -> DataFrame:
    """C-08: candidates whose book can take the order within the impact cap."""
    j = candidates.join(books, list(keys))
    return j.withColumn("impact_bps", book_impact_bps("bids", "asks", order_usd, "rate")).where(F.col("impact_bps") <= max_impact_bps).drop("bids", "asks")
