"""Neighbours against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ann
from barloom.llm.queries import QUERIES


def brute(rows, asked, k=5):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=np.float64)
    norm = np.sqrt((m * m).sum(axis=1))
    out = {}
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        s = m @ m[at] / (norm * norm[at])
        out[q] = [(int(ids[j]), s[j]) for j in sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-round(s[j], 12), ids[j]))[:k]]
    return out


def recall_of(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_recall(spark, folder):
    rows = duckdb.execute(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    got = by_query(QUERIES["op10_nearest_neighbours"](spark, folder).collect())
    assert recall_of(got, want) >= 0.9
    scores = {(q, i): s for q, w in brute(rows, list(want), len(rows)).items() for i, s in w}
    for q, near in got.items():
        assert len(near) == 5 and all(abs(s - scores[q, i]) < 1e-12 for i, s in near)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 6)).round(3)
    rows = [(i, base[i % 40].tolist()) for i in range(80)] + [(i, base[0].tolist()) for i in range(100, 140)]
    rows += [(200, None), (250, [0.0] * 6), (300, [1.0, None] + [0.0] * 4), (350, [float("nan")] + [1.0] * 5), (400, [float("inf")] + [1.0] * 5), (450, [1.0, 2.0]), (None, base[3].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS vec", "2 AS key", "3 AS leaf")
    got = by_query(ann.nearest(vectors, vectors["vec_id"] % 10 == 0, recall=1.0).collect())
    fine = [(i, v) for i, v in rows if i is not None and i < 200]
    want = brute(fine, [i for i, _ in fine if i % 10 == 0])
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert ann.nearest(vectors.limit(0), vectors["vec_id"] % 10 == 0).count() == 0
    few = vectors.filter("vec_id IN (0, 1, 2)")
    assert {q: len(w) for q, w in by_query(ann.nearest(few, few["vec_id"] % 10 == 0).collect()).items()} == {0: 2}


def test_ties_go_to_the_smaller_key(spark):
    # 40 directions alike and others near them: all cosines of the first are exactly 1
    rows = [(i, [3.0 * 2.0**i, 4.0 * 2.0**i]) for i in range(41)] + [(100 + i, [3.0, 4.0 + i]) for i in range(1, 200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").orderBy(F.desc("vec_id"))
    for recall in (0.94, 1.0):
        got = by_query(ann.nearest(vectors, F.col("vec_id") == 0, recall=recall, per_leaf=16).collect())
        assert got == {0: [(i, 1.0) for i in range(1, 6)]}


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(5)
    short, long_ = ([(start + i, rng.normal(size=n).tolist()) for i in range(30)] for start, n in ((0, 3), (1000, 4)))
    vectors = spark.createDataFrame(short + long_ + [(5000, [1.0])], "vec_id long, embedding array<double>")
    got = by_query(ann.nearest(vectors, F.col("vec_id") % 10 == 0, recall=1.0).collect())
    want = brute(short, [0, 10, 20]) | brute(long_, [1000, 1010, 1020])
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_walk_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    points = ann._unit(rng.normal(size=(500, 8)))
    tree = ann.build_tree(points, 40)
    order = tree.leaves_by_nearness(points[0], tree.n_leaves)
    assert sorted(order) == list(range(tree.n_leaves)) and tree.n_leaves == 40
    assert set(tree.leaf_of(points)) <= set(order)


def test_blocks_are_not_broadcast(spark, monkeypatch):
    """The walks of one query repeat its vector, so that their file is small and their blocks are not."""
    plans, written = {}, ann.settle

    def settle(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label)

    monkeypatch.setattr(ann, "settle", settle)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    assert ann.nearest(rows, F.col("vec_id") % 50 == 0, per_leaf=20).count() == 40
    assert "SortMergeJoin" in plans["near"] and "Broadcast" not in plans["near"]
