"""Order books against plain Python, in any number of tasks."""

import pytest

from barloom.sources import views


def plain(rows):
    books = {}
    for supplier, price, size in rows:
        levels = books.setdefault(supplier, {})
        levels[price] = levels.get(price, 0.0) + size
    out = {}
    for supplier, levels in books.items():
        mid = (min(levels) + max(levels)) / 2
        out[supplier] = (
            sorted(((p, s) for p, s in levels.items() if p < mid), reverse=True), sorted((p, s) for p, s in levels.items() if p >= mid)
        )
    return out


@pytest.mark.parametrize("rows", [1 << 19, 500])
def test_books(spark, small, monkeypatch, rows):
    monkeypatch.setattr(views, "BOOK_ROWS", rows)
    items = views.table(spark, small, "lineitem").selectExpr("cast(l_suppkey as string)", "floor(l_extendedprice / l_quantity * 100) / 100", "l_quantity").collect()
    made = views.books(spark, small)
    assert {r.venue_symbol: ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in made.collect()} == plain(items)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Window" not in plan and "Join" not in plan
