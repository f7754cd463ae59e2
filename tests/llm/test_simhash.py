"""Fingerprints, links and components against all pairs in plain Python."""

import random

import duckdb
import pytest
import xxhash

from barloom.llm import simhash
from barloom.llm.graph import components
from barloom.llm.queries import QUERIES

from .helpers import SMALL as FOLDER



def plain_print(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    spans = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_query_matches_all_pairs(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    prints = {i: plain_print(t) for i, t in rows}
    want = plain_components(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_near_dedup"](spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in want}


@pytest.mark.parametrize("bits,width,paired", [(2, 2, 64), (1, 2, 64), (2, 4, 64), (2, 8, 64), (2, 2, 2), (1, 2, 2)])
def test_links_connect_the_same_components(spark, monkeypatch, bits, width, paired):
    monkeypatch.setattr(simhash, "PAIRED_CELL", paired)
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63, 3 << 62]
    for p in list(prints[:30]):
        for flips in (1, 2, 3):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(frame, bits, width).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in edges)
    want = plain_components({s: s & mask for s in signed}, bits)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {s: got.get(s, s) for s in signed} == want


def test_edge_cases(spark):
    many = "x y z " * 60_000
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (None, "A b", "d"), (5, "a B", "e"), (5, "a B", "e"), (6, many, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (None, 5), (5, 5), (5, 5), (6, 6)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 5, 6]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (201, 201), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def test_exploded_sides_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Spark takes each of these short rows for one row, though it becomes some 60."""
    plans = []

    def settle(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "settle", settle)
    prints = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63),) for i in range(50)] + [(1 << i,) for i in range(40)], "fp long")
    prints.write.parquet(f"{tmp_path}/prints")
    for bits in (1, 2):
        made = simhash.links(spark.read.parquet(f"{tmp_path}/prints"), bits)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        assert made.count()
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
