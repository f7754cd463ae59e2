"""Filter audit against all orders applied one by one in plain Python."""

import re
from itertools import permutations
from math import factorial

import pytest

from barloom.llm import audit

from .helpers import matches_sql

DOCS = "doc_id long, text string, source string, part int, mask string, n int"
LABELS = "doc_id long, quality int, toxic int, source string"


def plain(docs, labels):
    first = {}
    for i, t, s in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))

    def failed(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        found += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        return found + "E" * (i is not None and i > first[t])

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows, shapley = {}, {}
    for part in {s or "" for _, _, s in docs}:
        members = [(i, failed(i, t or "")) for i, t, s in docs if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            alive = members
            for step, f in enumerate(order, 1):
                gone = [m for m in alive if f in m[1]]
                alive = [m for m in alive if f not in m[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                rows[part, order, step] = [
                    len(alive), len(gone), sum(f in m[1] for m in members) - len(gone), sum(m[1] == f for m in members),
                    sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def test_query_matches_sql(spark):
    matches_sql(spark, "op11_filter_audit")


def test_every_order_against_plain(spark):
    long_, dull = " ".join(f"w{i}" for i in range(210)), "a b " * 150
    docs = [(1, long_, "x"), (2, long_, "y"), (2, long_, "y"), (3, long_ + " #", "x"), (4, dull, "x"), (5, dull, None), (6, "", ""), (7, None, None)]
    docs += [(None, long_, "x"), (None, None, "y"), (8, "ALL CAPS & more", "x"), (1, dull, "y"), (9, "\xa0 \t\n", "x"), (9, "\xa0 \t\n", "x")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (5, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, "junk", 3) for d in docs], DOCS)
    told = spark.createDataFrame([(*x, "other") for x in labels], LABELS)
    got = audit.filter_audit(frame, told).collect()
    want = plain(docs, labels)
    assert len(got) == len(want) == 3 * 120 * 5
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_no_rows_and_no_labels(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.filter_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "few words", "s", 0, "", 0)], DOCS)
    got = audit.filter_audit(one, labels).collect()
    assert len(got) == 600 and {r.shapley for r in got} == {0, 120} and {r.good_lost for r in got} == {0}


def test_edges_are_used_by_as_many_orders_as_there_are():
    for n in range(1, 7):
        for state, _, used in audit.lattice(n):
            k = state.bit_count()
            assert used == factorial(k) * factorial(n - k - 1)
    with pytest.raises(ValueError):
        audit.lattice(9)


def test_set_order(spark):
    after = (("C", "A"), ("B", "A"))
    edges = audit.lattice(4, ((2, 0), (1, 0)))
    listed = audit.orders(edges, "ABCD")
    allowed = {"".join(o) for o in permutations("ABCD") if o.index("A") > o.index("B") and o.index("A") > o.index("C")}
    assert {o for o, *_ in listed} == allowed and len(listed) == 4 * len(allowed)
    for s, i, used in edges:
        assert used == sum((s, i) == row[2:] for row in listed)
    states = spark.createDataFrame([(None, 3, 5, 1, 0), (None, 3, 2, 0, 0), (None, None, 4, 0, 0), (None, 8, 1, 0, 1)], "part string, mask int, n long, good long, toxic long")
    rows = audit.steps(spark, audit.audit(states, "ABCD", after), "ABCD", after).collect()
    assert len(rows) == 4 * len(allowed) and {r.part for r in rows} == {None}
    by = {(r.filter_order, r.step): r for r in rows}
    assert by["BCAD", 1].removed == 7 and by["BCAD", 3].removed == 0 and by["BCAD", 3].redundant == 7 and by["BCAD", 4].kept == 4
    assert by["BCAD", 1].shapley == 7 * len(allowed) and by["BCAD", 4].toxic_lost == 1
