"""Prompts, completions and spans; the query against SQL."""

from barloom.llm import preferences as p

from .helpers import matches_sql


def test_query_matches_sql(spark):
    matches_sql(spark, "op2_preference_pairs")


def test_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (0, 3, "assistant", "ok"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (None, 0, "user", "x"),
        (6, 5, None, None), (6, 4, "user", "u"), (7, 1, "user", "u"), (7, 2, None, ""), (7, 3, "assistant", "é" * 5000), (8, 0, "user", "a"), (8, 0, "user", "a"), (9, 0, "user", "a"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pair_id", "2 AS side")
    got = {r.pair_id: r for r in p.format_neighbours(turns).collect()}
    assert sorted(got) == [0, 1, 3, 4]
    r = got[0]
    assert (r.n_common, r.prompt, r.rejected) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nbad<|end|>\n")
    assert [r.chosen[int(a) : int(b)] for a, b in (s.split("-") for s in r.chosen_spans.split(","))] == ["good<|end|>\n", "ok<|end|>\n"]
    assert (got[1].n_common, got[1].chosen, got[1].rejected, got[1].chosen_spans) == (1, "", "", "")
    assert got[3].n_common == 2 and got[3].chosen == "" and got[3].rejected_spans == f"14-{14 + 5000 + 8}"
    assert (got[4].n_common, got[4].chosen, got[4].rejected) == (1, "<|user|>\na<|end|>\n", "")
    sides = spark.createDataFrame([("p", 1, 0), ("p", 0, 1), ("q", 9, 0), ("q", 77, 1)], "pair_id string, conv_id long, side int")
    named = p.format_pairs(turns, sides).collect()
    assert [(r.pair_id, r.chosen_id, r.rejected, r.chosen) for r in named] == [("p", 1, got[0].chosen, got[0].rejected)]
    assert p.format_neighbours(turns.limit(0)).count() == 0
