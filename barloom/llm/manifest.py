"""Merkle trees over a table by a butterfly exchange of subtree roots.

Leaves of a group are numbered in key order and cut into aligned blocks of a power of the fanout; a block hashes its own
subtree.  Then, round by round, the blocks that differ in one digit of their number swap the roots of the subtrees they
lie in.  Each hashes the parent for itself, although its partners do the same, and keeps what it received: these are its
siblings of that level.  After the last round every block knows the root and the upper part of its leaves' proofs, so
nothing has to be sent down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import drop_tables, settle

#: Children of a node, and levels inside a block (so 4,096 leaves a block).
FANOUT, HEIGHT = 8, 4
#: The letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOF = "array<struct<place int, others array<string>>>"


def leaf_digest(*fields) -> F.Column:
    """SHA-256 (lowercase hex) of the fields in order: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    told = [F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in told]), 256)


def fold(leaf, proof) -> F.Column:
    """The root that follows from a leaf and its proof, level by level."""

    def up(node, level):
        before = F.array_join(F.slice(level["others"], F.lit(1), level["place"]), "")
        after = F.array_join(F.slice(level["others"], level["place"] + 1, F.size(level["others"])), "")
        return F.sha2(F.concat(before, node, after), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof) -> F.Column:
    """SHA-256 of all siblings of a proof, from leaf to root and left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: level["others"])), ""), 256)


def subtree(digests: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """Levels of nodes above the digests, they first: ``height`` levels more, or until one node remains."""
    levels = [digests]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return levels


def _numbered(rows: DataFrame) -> DataFrame:
    """``grp, row`` and the row's ``pos`` in its group, in order of ``row`` (its first field null first).

    Rows are dealt into ranges of group and order, so a group may fill any number of tasks; the number in the range is
    counted on from the sizes of the ranges before, a small table.
    """
    order = [F.col("grp").asc_nulls_first(), F.col("row.key").asc_nulls_first(), F.col("row.leaf"), F.col("row.tie")]
    id_ = F.monotonically_increasing_id()  # after the sort: the partition in the upper bits, the place in it in the lower 33
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", id_)
    ranged = ranged.select("grp", "row", F.shiftright("id", 33).alias("part"), (F.col("id").bitwiseAND((1 << 33) - 1)).alias("at"))
    ranged = settle(ranged, "ranged")
    sizes = ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("grp").alias("of"), F.col("part").alias("here"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    sizes = settle(sizes, "ranges")
    met = (ranged["part"] == sizes["here"]) & ranged["grp"].eqNullSafe(sizes["of"])
    placed = ranged.join(sizes, met).select("grp", "row", (F.col("at") + F.col("shift")).alias("pos"))
    placed.sources = (ranged, sizes)
    return placed


def _block_nodes(blocks: DataFrame, fanout: int, height: int) -> DataFrame:
    """``grp, lane, lanes, node``: the root of each block's subtree."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes = [
                subtree(leaves, fanout, height if lanes > 1 else None)[-1][0]
                for lanes, leaves in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.string())], names=["grp", "lane", "lanes", "node"])

    schema = T.StructType([blocks.schema["grp"]] + T.StructType.fromDDL("lane long, lanes long, node string").fields)
    return blocks.select("grp", "lane", "lanes", F.col("rows.leaf").alias("leaves")).mapInArrow(run, schema)


def butterfly(state: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``grp, lane, node, proof`` from ``grp, lane, lanes, node``: the group's root and the siblings on the way to it.

    ``lane`` numbers a group's nodes from 0, ``lanes`` is how many there are.  In round r the lanes that agree in all
    digits but the r-th meet, ``fanout`` of them, however large the group.  A group that is no power of the fanout is
    filled up with lanes that hold nothing, at most as many as it has, so that everyone has somebody to meet in each
    subtree; they learn roots from the first meeting on and pass them on.  Groups of one lane keep their node.
    """
    most, rounds = state.agg(F.max("lanes")).first()[0] or 0, 0
    while fanout**rounds < most:
        rounds += 1
    width = F.greatest(F.lit(0), *[F.when(F.col("lanes") >= fanout**r, fanout**r).otherwise(0) for r in range(rounds + 1)])
    empty = F.array().cast(PROOF)
    held = state.select("grp", "lane", "lanes", "node", empty.alias("proof"))
    filled = (F.ceil(F.col("lanes") / width) * width).cast("long")
    short = state.filter("lane = 0").withColumn("filled", filled).filter("filled > lanes")
    lane = F.explode(F.expr("sequence(lanes, filled - 1)")).alias("lane")
    held = held.union(short.select("grp", lane, "lanes", F.lit(None).cast("string").alias("node"), empty.alias("proof")))
    for r in range(rounds):
        step = fanout**r
        held = held.withColumn("active", F.col("lanes") > step)
        digit = F.when(F.col("active"), F.expr(f"lane div {step} % {fanout}")).otherwise(0)
        held = held.withColumn("digit", digit.cast("int")).withColumn("cell", F.col("lane") - F.col("digit") * step)
        member = F.struct("digit", "lane", "node", "proof")
        met = held.groupBy("grp", "lanes", "active", "cell").agg(F.sort_array(F.collect_list(member)).alias("all"))
        roots = F.transform(F.filter("all", lambda m: m["node"].isNotNull()), lambda m: m["node"])
        met = met.withColumn("roots", roots).select("grp", "lanes", "active", "roots", F.explode("all").alias("m"))
        own = F.col("m.digit")
        others = F.concat(F.slice("roots", F.lit(1), own), F.slice("roots", own + 2, F.greatest(F.size("roots") - own - 1, F.lit(0))))
        level = F.array(F.struct(own.alias("place"), others.alias("others")))
        parent = F.when(F.size("roots") > 0, F.sha2(F.array_join("roots", ""), 256))
        held = met.select(
            "grp", F.col("m.lane").alias("lane"), "lanes", F.when(F.col("active"), parent).otherwise(F.col("m.node")).alias("node"),
            F.when(F.col("active") & F.col("m.node").isNotNull(), F.concat("m.proof", level)).otherwise(F.col("m.proof")).alias("proof"),
        )
    return held.filter("lane < lanes").select("grp", "lane", "node", "proof")


def _leaf_proofs(blocks: DataFrame, fanout: int, height: int) -> DataFrame:
    """Rows of the blocks with their group's ``subroot``, ``root`` and the whole ``proof``."""
    row = blocks.schema["rows"].dataType.elementType
    fields = [blocks.schema["grp"], *row.fields] + T.StructType.fromDDL(f"subroot string, root string, proof {PROOF}").fields
    schema = T.StructType(fields)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists, uppers = batch.column("rows"), batch.column("upper").to_pylist()
            for b in range(batch.num_rows):
                rows = lists.slice(b, 1).flatten()
                n, lanes = len(rows), batch.column("lanes")[b].as_py()
                levels = subtree(rows.field("leaf").to_pylist(), fanout, height if lanes > 1 else None)[:-1]
                stock, base, places, firsts, counts = [], 0, [], [], []
                at = np.arange(n)
                for level in levels:
                    start = at - at % fanout
                    places.append(at % fanout)
                    firsts.append(base + start)
                    counts.append(np.minimum(fanout, len(level) - start) - 1)
                    stock += level
                    base, at = base + len(level), at // fanout
                for level in uppers[b]:
                    size = len(level["others"])
                    # others only: the place itself is put in, so that these levels are read like the ones below
                    stock += level["others"][: level["place"]] + [""] + level["others"][level["place"] :]
                    places.append(np.full(n, level["place"]))
                    firsts.append(np.full(n, base))
                    counts.append(np.full(n, size))
                    base += size + 1
                depth = len(places)
                if depth:
                    place, first, count = (np.stack(x, axis=1).reshape(-1) for x in (places, firsts, counts))
                    ends = np.concatenate([[0], np.cumsum(count)])
                    step = np.arange(ends[-1]) - np.repeat(ends[:-1], count)
                    taken = np.repeat(first, count) + step + (step >= np.repeat(place, count))
                    others = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(stock, pa.string()).take(pa.array(taken)))
                    levels_ = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), others], names=["place", "others"])
                    proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depth), levels_)
                else:
                    proof = pa.array([[]] * n, pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])))
                told = [pa.array([batch.column(c)[b].as_py()] * n, batch.schema.field(c).type) for c in ("grp", "subroot", "root")]
                columns = [told[0], *rows.flatten(), told[1], told[2], proof]
                for k in range(0, n, 512):
                    yield pa.RecordBatch.from_arrays([c.slice(k, 512) for c in columns], names=schema.names)

    return blocks.select("grp", "lanes", "rows", "upper", "subroot", "root").mapInArrow(run, schema)


def prove(leaves: DataFrame, key: str, leaf: str, group: str, carried: Sequence[str] = (), fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``group, key, carried..., leaf, subroot, root, proof`` for every row of ``leaves``.

    Within a group leaves ascend by key, null first, and rows of equal keys by digest.  Every ``fanout`` consecutive
    nodes become one until one remains, the group's subroot (a single leaf is its own); subroots, ordered by group, null
    first, become the root in the same way.  A proof lists, level by level, the place among the run's nodes and the
    others.  Repeated rows are leaves of their own.  An empty table gives no rows.  No group is gathered: tasks hold a
    block of ``fanout ** height`` leaves or ``fanout`` nodes; only the list of groups is numbered in one.
    """
    members = F.struct(F.col(key).alias("key"), F.col(leaf).alias("leaf"), F.rand(5).alias("tie"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])
    rows = settle(leaves.select(F.col(group).alias("grp"), members.alias("row")), "leaves")
    placed = _numbered(rows)
    size = fanout**height
    blocks = placed.groupBy("grp", F.expr(f"pos div {size}").alias("lane")).agg(F.sort_array(F.collect_list(F.struct("pos", "row"))).alias("rows"))
    rows_ = F.transform("rows", lambda r: F.struct(r["row"]["key"].alias("key"), r["row"]["leaf"].alias("leaf"), *[r["row"][f"c{i}"].alias(f"c{i}") for i in range(len(carried))]))
    blocks = settle(blocks.select("grp", "lane", rows_.alias("rows")), "blocks")
    drop_tables(rows, *placed.sources)
    held = blocks.groupBy("grp").agg(F.count("*").alias("lanes")).select(F.col("grp").alias("of"), "lanes")
    blocks = blocks.join(held, blocks["grp"].eqNullSafe(held["of"])).select("grp", "lane", "lanes", "rows")
    lower = settle(butterfly(_block_nodes(blocks, fanout, height), fanout), "lanes")
    # one row per group from here on
    tops = lower.filter("lane = 0").select(F.col("grp").alias("of"), "node")
    ranked = tops.withColumn("lane", F.row_number().over(Window.orderBy(F.col("of").asc_nulls_first())).cast("long") - 1)
    ranked = settle(ranked.withColumn("lanes", F.count("*").over(Window.partitionBy())), "groups")
    upper = butterfly(ranked.select(F.lit(0).alias("grp"), "lane", "lanes", "node"), fanout)
    upper = upper.select(F.col("lane").alias("rank"), F.col("node").alias("root"), F.col("proof").alias("last"))
    upper = settle(ranked.join(upper, ranked["lane"] == upper["rank"]).select("of", F.col("node").alias("subroot"), "root", "last"), "roots")
    known = lower.join(upper, lower["grp"].eqNullSafe(upper["of"])).select("of", F.col("lane").alias("here"), "subroot", "root", F.concat("proof", "last").alias("upper"))
    known = settle(known, "known")
    drop_tables(lower, ranked, upper)
    whole = blocks.join(known, blocks["grp"].eqNullSafe(known["of"]) & (blocks["lane"] == known["here"]))
    found = _leaf_proofs(whole, fanout, height)
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(carried)]
    return found.select(F.col("grp").alias(group), F.col("key").alias(key), *names, F.col("leaf").alias(leaf), "subroot", "root", "proof")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), claims: dict | None = None) -> DataFrame:
    """Leaf, roots and proof of every row; ``claims`` are digests under other names that are carried along.

    Any field may be null; null and empty texts have different leaves.  Columns that are not named are not read.
    """
    claims = claims or {}
    told = [F.col(key).alias("__key"), F.col(group).alias("__group"), leaf_digest(*fields).alias("__leaf"), *[c.alias(f"__claim{i}") for i, c in enumerate(claims.values())]]
    found = prove(docs.select(*told), "__key", "__leaf", "__group", [f"__claim{i}" for i in range(len(claims))])
    names = [F.col(f"__claim{i}").alias(c) for i, c in enumerate(claims)]
    return found.select(F.col("__group").alias(group), F.col("__key").alias(key), F.col("__leaf").alias("leaf"), *names, "subroot", "root", "proof")


def tampered(key: str = "doc_id", text: str = "text", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text")) -> F.Column:
    """The leaf of a row whose text was lower-cased, for rows whose key's CRC-32 is divisible by 3, else null."""
    chosen = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    changed = [F.translate(text, UPPER, LOWER) if f == text else F.col(f) for f in fields]
    return F.when(chosen, leaf_digest(*changed))


def verified_documents(docs: DataFrame) -> DataFrame:
    """Every document's place in the manifest, and whether its row as found still folds to the root."""
    found = manifest(docs, claims={"claim": tampered()})
    folded = found.withColumn("folded_root", fold(F.coalesce("claim", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


MANIFEST_SQL = r"""
WITH RECURSIVE told AS (
  SELECT *, coalesce(strlen(text) || ':' || text, '-') AS t, coalesce(strlen(source) || ':' || source, '-') AS s,
    coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS d,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(d || s || l || n || t) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(d || s || l || n || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS claim
  FROM told
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, pos // 8
), groups AS (
  SELECT lang, level AS top, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS k FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS level, rank AS pos, k AS n, subroot AS node FROM groups
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY pos // 8
), runs AS (
  SELECT lang, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM tree WHERE n > 1 GROUP BY lang, level, pos // 8
), upper_runs AS (
  SELECT level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM upper WHERE n > 1 GROUP BY level, pos // 8
), folded AS (
  SELECT doc_id, p.lang, pos, leaf, coalesce(claim, leaf) AS node, '' AS siblings, 0 AS level, g.top, g.rank, g.subroot
  FROM placed p JOIN groups g ON g.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT doc_id, f.lang, f.pos // 8, leaf,
    sha256(array_to_string(nodes[1:f.pos % 8], '') || node || array_to_string(nodes[f.pos % 8 + 2:], '')),
    siblings || array_to_string(nodes[1:f.pos % 8], '') || array_to_string(nodes[f.pos % 8 + 2:], ''), f.level + 1, top, rank, subroot
  FROM folded f JOIN runs r ON r.lang IS NOT DISTINCT FROM f.lang AND r.level = f.level AND r.run = f.pos // 8 WHERE f.level < top
), lower_done AS (
  SELECT doc_id, leaf, subroot, rank AS pos, node, siblings, 0 AS level FROM folded WHERE level = top
), climbed AS (
  SELECT * FROM lower_done
  UNION ALL
  SELECT doc_id, leaf, subroot, c.pos // 8,
    sha256(array_to_string(nodes[1:c.pos % 8], '') || node || array_to_string(nodes[c.pos % 8 + 2:], '')),
    siblings || array_to_string(nodes[1:c.pos % 8], '') || array_to_string(nodes[c.pos % 8 + 2:], ''), c.level + 1
  FROM climbed c JOIN upper_runs r ON r.level = c.level AND r.run = c.pos // 8
), root AS (SELECT node AS root, level AS top FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root, node = root AS verified
FROM climbed, root WHERE level = top
"""
