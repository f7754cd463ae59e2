"""Near duplicates by exact similarity against all pairs in plain Python."""

import random

import corpus_pipeline
import numpy as np
import pytest
from barloom.llm import similar, simhash
from barloom.llm.common import table

from .helpers import SMALL


def plain_kept(rows, shingle=5, percent=80):
    def held(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = {i: held(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            one, two = sets[i], sets[j]
            if 100 * len(one & two) >= percent * len(one | two):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i for i in ids if root(i) == i}


@pytest.mark.parametrize("often", [1, 4])
def test_all_near_copies_and_no_others_go(spark, monkeypatch, often):
    monkeypatch.setattr(similar, "OFTEN", often)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(60):
        w = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 6, 40, 120]))
        rows.append(w + passage * (rng.random() < 0.5))
    for w in list(rows[:40]):  # copies at all distances around the bound, and copies of these
        for _ in range(rng.randint(0, 4)):
            w = list(w)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(w)
    rows = list(enumerate([" ".join(w) for w in rows] + [None, "", "  "]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == want
    # two bits of three-word fingerprints leave many of them
    assert simhash.keep_one(docs).count() > len(want)


def test_pairs_of_a_group_of_near_copies_grow_with_its_members(spark, monkeypatch):
    """Copies of one text with two words changed: many pairs of them reach the bound, most do not."""
    rng, seen, plain_possible = random.Random(4), [], similar._possible

    def watched(pairs, *args):
        seen.append(pairs.count())
        return plain_possible(pairs, *args)

    monkeypatch.setattr(similar, "_possible", watched)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(150), 2):
            w[k] = f"x{i}k{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == plain_kept(rows)
    assert sum(seen) <= 40 * len(rows)  # all pairs are 79,800


def test_near_copies_meet_their_middle_first(spark, monkeypatch):
    """Copies of one text with one to four words changed: nearly all are close to the text, few to each other."""
    rng, seen, plain_possible = random.Random(7), [], similar._possible

    def watched(pairs, *args):
        seen.append(pairs.count())
        return plain_possible(pairs, *args)

    monkeypatch.setattr(similar, "_possible", watched)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 4)):
            w[k] = f"x{i}k{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == plain_kept(rows)
    assert sum(seen) <= 10 * len(rows)  # all pairs are 79,800


def test_common_shingles_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    """A line of each row is common, however few rows a task has."""
    rows = [(i, f"a line that all of them have x{i} y{i} z{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = [similar._common(d, "doc_id", "text", 5) for d in (docs.coalesce(1), docs.repartition(400))]
    monkeypatch.setattr(similar, "spread", lambda df, *keys: df.repartition(200))
    dealt.append(similar._common(docs, "doc_id", "text", 5))
    assert len(dealt[0][0]) == 3  # of seven words
    for shingles, n in dealt[1:]:
        assert shingles.tolist() == dealt[0][0].tolist() and n.tolist() == dealt[0][1].tolist()


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "A b", "d"), (5, "a B", "e"), (5, "a B", "e"), (6, "x y z " * 60_000, None), (None, "only one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert similar.keep_one(docs.filter("doc_id IS NOT NULL")).count() == 4
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_maps_never_rule_out_a_pair_that_reaches_the_bound():
    rng = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(400):
        size = int(rng.choice([0, 1, 5, 63, 64, 65, 130, 1000]))
        one = np.unique(rng.integers(-(1 << 63), 1 << 63, size))
        kept = one[rng.random(len(one)) < rng.choice([0.5, 0.8, 0.9, 1.0])]
        two = np.unique(np.concatenate([kept, rng.integers(-(1 << 63), 1 << 63, int(size * rng.choice([0, 0.05, 0.2])))])).astype(np.int64)
        shared, joint = len(np.intersect1d(one, two)), len(np.union1d(one, two))
        (may,) = similar.may_reach(np.array([len(one)]), np.array([len(two)]), [similar.set_map(one)], [similar.set_map(two)], 80)
        assert may or 100 * shared < 80 * joint
        ruled_out += not may
    assert ruled_out > 50


def test_one_key_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text of its own")], "doc_id long, text string")
    assert sorted(similar.keep_one(docs).collect()) == [(1, "a b c d e f"), (5, "quite another text of its own")]


def test_clashing_columns_and_no_rows(spark):
    rows = [(1, "one two three four five six", "n", 1, "p"), (2, "one two three four five six", None, 2, "q"), (3, None, "n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, size int, print string")
    assert sorted(similar.keep_one(docs).collect(), key=lambda r: r.doc_id) == [rows[0], rows[2]]
    assert similar.keep_one(docs.filter("false")).collect() == []


def test_stage_drops_near_copies(spark):
    docs = table(spark, SMALL, "documents")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SMALL).collect()}
    assert got == plain_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_rows_kept_are_not_broadcast(spark):
    kept = similar.keep_one(table(spark, SMALL, "documents"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
