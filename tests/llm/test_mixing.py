"""Targets and thresholds against a plain water fill and sorted prefix sums."""

import hashlib
from collections import defaultdict

from barloom.llm import mixing

from .helpers import matches_sql


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    full, total = set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_query_matches_sql(spark):
    matches_sql(spark, "op8_mix_sources")


def test_mix_against_plain(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "abc"[i % 3] if i % 10 else None) for i in range(400)]
    rows += [(1000 + i, "w w", "tiny") for i in range(3)] + [(2000, None, "none"), (2001, "", "none"), (None, "a b c", "a"), (5, "w " * 9, "b"), (5, "w " * 9, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target")
    got = mixing.plan_mix(docs).collect()
    sizes, parts = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for i, t, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        parts[s][h] += n
    want = plain_targets(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= max(parts[s].values()) / 2 + 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())


def test_larger_budget_selects_a_superset(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i % 2 else "b") for i in range(300)], "doc_id long, text string, source string")
    some = {r.doc_id for r in mixing.plan_mix(docs, weights=(1, 3)).filter("source = 'a' AND copies > 0").collect()}
    more = {r.doc_id for r in mixing.plan_mix(docs, weights=(1, 2)).filter("source = 'a' AND copies > 0").collect()}
    assert some < more


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert mixing.plan_mix(docs.limit(0)).count() == 0
    assert [(r.target, r.copies) for r in mixing.plan_mix(docs).collect()] == [(0.0, 0)] * 2
    assert mixing.mix(docs).count() == 0
