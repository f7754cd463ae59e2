"""Hits, items and removal against plain Python; the query against SQL."""

import hashlib
import re

from barloom.llm import decontaminate as d

from .helpers import matches_sql


def plain(text, items, n=10):
    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, names = tokens(text), set(), set()
    for name, t in items:
        v = tokens(t)
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                names.add("null" if name is None else str(name))
    return len(w), hit, sorted(names)


def test_query_matches_sql(spark):
    matches_sql(spark, "op7_benchmark_decontamination", "/root/testdata/sf0.001")


def test_against_plain_with_both_joins(spark, monkeypatch):
    base = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(base)), (2, "Short ITEM"), (10, "Été déjà vu, x"), (None, " ".join(base[5:20])), (3, None), (4, " !! "), (1, " ".join(base)), (5, "one")]
    rows = [
        (1, "lead " + "-".join(base[3:18]).upper() + "! tail"), (2, None), (3, ""), (4, "?!"), (5, "short\nitem and short item"), (5, "other text"),
        (6, "x " * 4000 + " ".join(base) + " y" * 4000), (7, " ".join(base[:9])), (None, "été déjà vu x"), (None, "été déjà vu x"), (8, "Été déjà vu x"), (9, "w1 " * 50), (10, "One. two"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS print", "2 AS size", "'a' AS words")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS doc_id")
    for limit in (2_000_000, 0):
        monkeypatch.setattr(d, "BROADCAST_WINDOWS", limit)
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.report(docs, bench).collect())
        want = []
        for i, t in rows:
            n, hit, names = plain(t, items)
            want.append((str(i), n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
        assert got == sorted(want)
    kept = d.drop_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, t in rows if not plain(t, items)[1])
    cut = {(r.doc_id): r.text for r in d.drop_spans(docs.filter("doc_id IN (1, 2, 7)"), bench).collect()}
    assert cut == {1: "lead tail", 2: None, 7: " ".join(base[:9])}
    assert d.report(docs.limit(0), bench).count() == 0
    clean = d.report(docs, bench.limit(0))
    assert clean.count() == len(rows) and clean.filter("contaminated").count() == 0
