"""Removed words against plain Python."""

import hashlib
import random

import duckdb
import pytest

from barloom.llm import substrings as s
from barloom.llm.queries import QUERIES

from .helpers import SMALL


def plain(rows, length=20):
    """{(key, text): (n_words, removed positions)}; rows sorted in key order, null last."""
    seen, out = set(), {}
    for k, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            if g in seen:
                gone |= set(range(i, i + length))
            seen.add(g)
        out[(k, t)] = (w, gone)
    return out


def digest(w, gone):
    return hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def test_query_matches_plain(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    want = {k: (len(w), len(gone), digest(w, gone)) for (k, _), (w, gone) in plain(rows).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_substring_dedup"](spark, SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [256, 2])
def test_planted_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(s, "HOT_ANCHOR", hot)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    shared = [some(n) for n in (19, 20, 21, 60)]
    rows = [(i, "\n ".join(some(rng.randint(0, 40)) + rng.choice(shared) + some(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, "a " * 200), (101, "a " * 30), (102, "a b c " * 40), (103, rows[0][1]), (104, "short copy"), (105, "short copy"), (103, rows[0][1])]
    rows += [(None, rows[1][1]), (None, " ".join(shared[3])), (106, None), (107, ""), (50, " ".join(shared[3] + ["x"])), (108, " ".join(some(5000) + shared[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS print", "'z' AS row", "2 AS ord")
    want = plain(rows)
    got = s.repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(k), len(want[k, t][0]), len(want[k, t][1]), digest(*want[k, t])) for k, t in rows)
    for r in got:
        assert sum(p["to"] - p["from"] for p in r.spans) == r.n_removed and hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert s.repeats(docs.limit(0)).count() == 0
