"""Merkle manifest against a plain tree over sorted rows."""

import hashlib
import zlib

from pyspark.sql import functions as F

from barloom.llm import manifest

from .helpers import matches_sql

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string, proof int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fanout):
    """Root, and for every node its siblings, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place - place % fanout :][:fanout]
            proofs[i].append((place % fanout, run[: place % fanout] + run[place % fanout + 1 :]))
            at[i] = place // fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0] if nodes else None, proofs


def plain(groups, fanout):
    """``{group: [(leaf, subroot, root, proof)]}`` from leaves in order."""
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree(groups[g], fanout) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names], fanout)
    return {g: [(x, trees[g][0], root, p + tops[i]) for x, p in zip(groups[g], trees[g][1])] for i, g in enumerate(names)}


def test_query_matches_sql(spark):
    matches_sql(spark, "op13_merkle_manifest")


def test_every_size_against_plain(spark):
    # blocks of 4 and of 9 leaves: one block, full powers, one more, and sizes between
    for fanout, height, sizes in ((2, 2, (1, 2, 3, 4, 5, 8, 9, 16, 17, 23, 33)), (3, 1, (1, 3, 4, 27, 28, 40)), (2, 0, (1, 2, 5))):
        groups = {f"g{n}" if n != 3 else None: [h(f"{n}/{i}") for i in range(n)] for n in sizes}
        rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)]
        frame = spark.createDataFrame(rows, "grp string, row long, leaf string").orderBy("leaf")
        got = manifest.prove(frame, "row", "leaf", "grp", fanout=fanout, height=height)
        got = got.withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).collect()
        want = {(g, i): w for g, ws in plain(groups, fanout).items() for i, w in enumerate(ws)}
        assert len(got) == len(want)
        for r in got:
            assert (r.leaf, r.subroot, r.root, [(p.place, p.others) for p in r.proof]) == want[r.grp, r.row]
            assert r.folded == r.root


def test_documents_against_plain(spark):
    rows = [(i, f"s{i % 3}", "de" if i % 5 else None, i, f"Text {i}") for i in range(40)] + [(7, None, "fr", None, None), (8, "", "", 0, "")]
    rows += [(None, "s", "de", 1, "ABC"), (3, "s", "de", 1, "Tie"), (3, "s", "de", 1, "Tie"), (3, "s", "de", 1, "other"), (-5, "s", "É", 1, "é" * 9000)]
    got = manifest.verified_documents(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append((leaf(r), r))
    want = []
    for g, proved in plain({g: [x for x, _ in xs] for g, xs in groups.items()}, 8).items():
        for (x, r), (_, subroot, root, proof) in zip(groups[g], proved):
            node = x
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                node = leaf((*r[:4], lowered))
            for place, others in proof:
                node = h(*others[:place], node, *others[place:])
            want.append((r[0], x, subroot, root, h(*(o for _, os in proof for o in os)), node, node == root))
    key = lambda t: (t[0] is not None, *t[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {w[6] for w in want} == {True, False}


def test_one_row_and_no_rows(spark):
    assert manifest.verified_documents(spark.createDataFrame([], DOCS)).collect() == []
    (r,) = manifest.verified_documents(spark.createDataFrame([(1, None, None, None, None, 0, "", 0)], DOCS)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified


def test_exchange_alone(spark):
    for n in (1, 2, 9, 26, 27, 30, 81):
        nodes = [h(str(i)) for i in range(n)]
        frame = spark.createDataFrame([("g", i, n, x) for i, x in enumerate(nodes)], "grp string, lane long, lanes long, node string")
        root, proofs = plain_tree(nodes, 3)
        got = {r.lane: (r.node, [(p.place, p.others) for p in r.proof]) for r in manifest.butterfly(frame, 3).collect()}
        assert got == {i: (root, proofs[i]) for i in range(n)}
