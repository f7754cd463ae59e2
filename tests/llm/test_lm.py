"""Counts and baseline in plain Python, windows, gradients, held-out gain, edge cases."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from barloom.llm import attention as a
from barloom.llm import lm
from barloom.llm.queries import QUERIES
from barloom.llm.subwords import WordEncoder, default_path


def plain(rows):
    def tokens(t):
        return [w.lower() for w in (t or "").encode().split()] + [None]

    out = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, t in rows if not out[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, out[i], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows]


def test_query_counts_and_held_out_gain(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    got = sorted(QUERIES["op5_lm_scores"](spark, folder).collect(), key=lambda r: r.doc_id)
    want = plain(rows)
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:5] for w in want]
    assert all(abs(r.base_score - w[5]) < 1e-6 * abs(w[5]) for r, w in zip(got, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # the baseline gives any unknown word one small price, which a tiny training set makes cheap; hence the larger table
    test = QUERIES["op5_lm_scores"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "A b"), (3, "a  B\n" * 9000), (3, "a  B\n" * 9000), (4, "x y a.b"), (5, "b"), (21, "new words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "true AS train", "2 AS key")
    got = lm.score(docs, default_path()).collect()
    want = plain(rows)
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(str(w[:5]) for w in want)
    assert sorted(round(r.base_score, 6) for r in got) == sorted(round(w[5], 6) for w in want)
    assert lm.score(docs.limit(0), default_path()).count() == 0
    held = lm.score(docs.filter("doc_id IS NULL"), default_path()).collect()
    assert held[0].train_tokens == 0 and math.isfinite(held[0].score)


def test_words_without_ids(spark):
    bare = ["\u00a0", "\u3000", "\u2003\u00a0", "\u0085"]
    rows = [(1, "one \u00a0 two \u3000"), (2, "\u3000"), (3, "\u2003\u00a0 one"), (4, "two \u0085"), (21, "\u00a0 one"), (None, "\u3000\u3000")]
    assert not any(WordEncoder(default_path()).word_ids(bare))
    for part in (rows, rows[1:2]):
        got = lm.score(spark.createDataFrame(part, "doc_id long, text string"), default_path()).collect()
        assert sorted(str(tuple(r)[:5]) for r in got) == sorted(str(w[:5]) for w in plain(part))
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_all_whole_training_texts_train_the_network(spark, monkeypatch):
    seen, plain_round = [], lm._round

    def watched(*args):
        made = plain_round(*args)
        seen.append(made)
        return made

    monkeypatch.setattr(lm, "_round", watched)
    monkeypatch.setattr(lm, "BLOCK_CHARS", 20_000)
    rows = [(i, f"a{i % 7} b c " * 4) for i in range(1500)] + [(5000, "one two three four five " * 2000)]
    lm.score(spark.createDataFrame(rows, "doc_id long, text string"), default_path()).collect()
    assert seen[1][1] == plain(rows)[0][4]  # words and ends of all training texts; each begins with one first id
    assert all(np.isfinite(w).all() for w in seen[1][0].values())
    assert any((seen[0][0][k] != w).any() for k, w in seen[1][0].items())


def small_model(seed=0, window=8):
    rng = np.random.default_rng(seed)
    size, n = 30, 12
    counts = rng.integers(1, 50, size).astype(float)
    v = a.Vocabulary.from_counts(counts, counts, rng.integers(0, 9, (n + 2, n + 2)).astype(float), np.argsort(-counts)[:n], 6, 3)
    return v, {k: w.astype("f8") for k, w in a.fresh(v, 6, window).items()}, rng


def test_words_of_the_tree_sum_to_one():
    v, _, _ = small_model()
    rows = np.exp(v.inside)
    assert np.allclose(rows.sum(axis=1), 1) and abs(v.begins.sum() - 1) < 1e-9
    assert np.allclose(np.bincount(v.classes, np.exp(v.within), minlength=v.n_classes), 1)


@pytest.mark.parametrize("sizes", [(0, 1, 5, 8, 9, 23), (40,), (0,)])
def test_each_first_id_is_scored_once_with_a_causal_window(sizes):
    v, p, rng = small_model()
    cuts = np.cumsum([0, *sizes])
    ids, first = rng.integers(0, 30, cuts[-1]), rng.random(cuts[-1]) < 0.6
    tree = np.log(rng.random(cuts[-1]) * 0.5 + 0.01)
    got = a.log_probabilities(p, v, ids, tree, first, cuts[:-1], cuts[1:], 6, batch=2)
    assert np.array_equal(got[~first], tree[~first])
    starts, n, since = a.windows(cuts[:-1], cuts[1:], 8, 6)
    scored = Counter(i for s, m, b in zip(starts, n, since) for i in range(s + b, s + m))
    assert scored == Counter(range(cuts[-1]))
    for i in np.flatnonzero(first)[:5]:
        changed = ids.copy()
        changed[i + 1 :] = 0
        again = a.log_probabilities(p, v, changed, tree, first, cuts[:-1], cuts[1:], 6)
        assert abs(again[i] - got[i]) < 1e-6


def test_gradients():
    v, p, rng = small_model()
    inputs, ids = rng.integers(0, 14, (3, 8)), rng.integers(0, 30, (3, 8))
    tree, marked = np.log(rng.random((3, 8))), rng.random((3, 8)) < 0.7
    p["gate"] += 0.3

    def loss():
        u, _ = a._attend(p, inputs)
        at = np.flatnonzero(marked.ravel())
        return -a._mixed(p, v, u[at], tree.ravel()[at], ids.ravel()[at])[0].mean()

    grads = a._gradients(p, v, inputs, ids, tree, marked)
    for name, w in p.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 4)]:
            keep, step = w[at], 1e-4
            w[at] = keep + step
            up = loss()
            w[at] = keep - step
            down = loss()
            w[at] = keep
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, (name, at)


def test_every_id_and_word_end_is_scored_by_attention():
    v, p, rng = small_model()
    p = {k: w + 0.1 * rng.normal(size=w.shape) for k, w in p.items()}
    cuts = np.cumsum([0, 1, 5, 0, 9, 23])
    ids, first = rng.integers(0, 30, cuts[-1]), rng.random(cuts[-1]) < 0.5
    first[cuts[:-1][np.diff(cuts) > 0]] = True
    tree, closing = (np.log(rng.random(cuts[-1]) * 0.5 + 0.01) for _ in range(2))
    closing[~first] = np.nan
    closing[cuts[:-1][np.diff(cuts) > 0]] = np.nan

    def scored(ids, tree, closing):
        return a.log_probabilities(p, v, ids, tree, first, cuts[:-1], cuts[1:], 6, batch=2, closing=closing)

    got, ends = scored(ids, tree, closing), np.isfinite(closing)
    alone = scored(ids, tree, None)
    assert (got[~first] != tree[~first]).all() and (got[ends] < alone[ends]).all()
    assert np.array_equal(got[first & ~ends], alone[first & ~ends])
    for i in range(cuts[-1]):  # of what may come before, only this window's ids count; of what comes after, nothing
        changed = ids.copy()
        changed[i + 1 :] = 0
        assert abs(scored(changed, tree, closing)[i] - got[i]) < 1e-6
        # the ways on from inside a word, its end among them, sum to one
        if not first[i]:
            shares = np.exp(rng.normal(size=31))
            shares /= shares.sum()
            total = 0.0
            for k in range(30):
                other, told = ids.copy(), tree.copy()
                other[i], told[i] = k, np.log(shares[k])
                total += np.exp(scored(other, told, closing)[i])
            start = cuts[np.searchsorted(cuts, i, "right") - 1]
            if i - start >= 8:
                continue
            u, _ = a._attend(p, a._inputs(v, ids, cuts[:-1], cuts[1:])[None, start : i + 1])
            stop, _ = a._priced(p, "_in", u[-1:], np.log(shares[30:]), np.array([v.n_goes - 1]), np.zeros(1))
            assert abs(total + np.exp(stop[0]) - 1) < 1e-6


def test_gradients_inside_words():
    v, p, rng = small_model()
    inputs, ids = rng.integers(0, 14, (3, 8)), rng.integers(0, 30, (3, 8))
    tree, marked = np.log(rng.random((3, 8))), rng.random((3, 8)) < 0.5
    p["gate_in"] += 0.3
    at = np.arange(1, 24, 2)
    more = at, rng.integers(0, v.n_goes, len(at)), np.log(rng.random(len(at))), np.log(rng.random(len(at)))

    def loss():
        u, _ = a._attend(p, inputs)
        on = np.flatnonzero(marked.ravel())
        one = a._mixed(p, v, u[on], tree.ravel()[on], ids.ravel()[on])[0].sum()
        return -(one + a._priced(p, "_in", u[at], more[3], more[1], more[2])[0].sum()) / len(on)

    grads = a._gradients(p, v, inputs, ids, tree, marked, more)
    for name, w in p.items():
        for place in list(np.ndindex(w.shape))[:: max(1, w.size // 4)]:
            keep, step = w[place], 1e-4
            w[place] = keep + step
            up = loss()
            w[place] = keep - step
            down = loss()
            w[place] = keep
            assert abs((up - down) / (2 * step) - grads[name][place]) < 2e-3, (name, place)


def test_ends_of_words_are_told_before_the_next_id():
    ids = [np.array(i, "<u4").tobytes() for i in ([5, 6], [], [7], [1])]
    tree = [np.array(t, "<f4").tobytes() for t in ([-1, -2, -3], [-4], [-5, -6], [-7, -8])]
    flat, go, stop, first, cuts, index, bounds, closing = lm._flat(np.array([0, 1, 2, 0]), np.array([0, 3, 3, 4]), ids, tree)
    assert flat.tolist() == [5, 6, 7, 1, 1, 5, 6, 1] and cuts.tolist() == [0, 4, 5, 8]
    assert first.tolist() == [True, False, True, True, True, True, False, True]
    assert np.array_equal(closing, [np.nan, np.nan, -3, -6, np.nan, np.nan, np.nan, -3], equal_nan=True)
    assert stop.tolist() == [0, -4, 0, -8, -8, 0, -8]


@pytest.mark.parametrize("n", [1, 2, 9, 10, 40, 129, 130])
def test_a_class_costs_two_short_rows_of_logits(n):
    branch, place, shared, places = a.branches(n)
    assert len({*zip(branch.tolist(), place.tolist())}) == n and (place < max(places, 1)).all()
    assert branch.max() + 1 + places <= 2 * n**0.5 + a.ALONE + 3
    rng = np.random.default_rng(n)
    start = np.log(rng.dirichlet(np.ones(n)))
    head = {k: w.astype("f8") for k, w in a._head(start, 6, rng, "").items()} | {"gate": np.zeros(6), "gate_bias": np.full(1, 40.0)}

    def shares(u):
        return np.exp(a._priced(head, "", u, np.full(n, -50.0), np.arange(n), np.zeros(n))[0])

    assert np.allclose(shares(np.zeros((n, 6))), np.exp(start), atol=1e-6)
    assert abs(shares(np.repeat(np.tanh(rng.normal(size=(1, 6))), n, axis=0)).sum() - 1) < 1e-6


def test_states_by_place_are_those_of_attention_by_position():
    _, p, rng = small_model()
    p = {k: w + 0.1 * rng.normal(size=w.shape) for k, w in p.items()}
    inputs = rng.integers(0, 14, (5, 8))
    x = p["embed"][inputs]
    logits = (x @ p["q"]) @ (x @ p["k"]).transpose(0, 2, 1) / 6**0.5
    gap = np.arange(8)[:, None] - np.arange(8)
    raised = np.where(gap >= 0, np.exp(logits + p["near"][np.maximum(gap, 0)]), 0)
    want = np.tanh((x + raised / raised.sum(axis=2, keepdims=True) @ (x @ p["v"]) @ p["o"]) @ p["w"] + p["b"])
    assert np.allclose(a._attend(p, inputs)[0].reshape(want.shape), want)
    assert np.allclose(a._attend(p, inputs, a._told(p, slice(None)), 3)[0].reshape(5, 5, 6), want[:, 3:])
    p["q"] *= 400  # logits too large to be raised as they are
    assert np.isfinite(a._attend(p, inputs)[0]).all()


def test_blocks_are_dealt_over_as_many_tasks(spark):
    rows, blocks = lm._blocks(spark.createDataFrame([(i, "a b " * 50) for i in range(200)], "doc_id long, text string"), "doc_id", "text")
    assert blocks == 1
    dealt = lm._together(rows, rows, 120).applyInArrow(lambda x, y: x.select(["block"]), "block int")
    assert dealt.rdd.getNumPartitions() == 120


def test_beginnings_and_answers_are_not_broadcast(spark, monkeypatch):
    """A word becomes a row for each of its beginnings, and Spark takes it for one."""
    plans, written = {}, lm.settle

    def settle(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label)

    monkeypatch.setattr(lm, "settle", settle)
    monkeypatch.setattr(lm, "_fitted", lambda rows, answers, blocks, vocabulary: a.fresh(vocabulary, lm.WIDTH, lm.WINDOW))
    lm.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), default_path())
    for label in ("tree", "answers"):
        assert "SortMergeJoin" in plans[label] and "Broadcast" not in plans[label]
