"""Near duplicates by exact Jaccard similarity of word shingles: SimHash grid, prefix filter, verified pairs, components.

No number of fingerprint bits is lossless for a bound on similarity, so the grid only finds what lies close; the prefix
filter finds all the rest.  Put every set of shingles in one common order.  Two sets whose similarity reaches the bound share a shingle among the
first ``n - ceil(bound * n) + 1`` of each, so only these prefixes are joined, each with a few hubs at a time, and no pair
is lost.  Common shingles come last in the order, which keeps boilerplate out of the prefixes; which ones count as common changes the work only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import simhash
from barloom.llm.common import drop_tables, settle, shuffled_join, spread, words
from barloom.llm.graph import components

#: Shingles put last in the order, and how many of the rows looked at must hold one for it to be a candidate, whatever
#: tasks they lie in; one row in ``LOOKED`` is looked at.  None of them changes a result.
COMMON, OFTEN, LOOKED = 50_000, 4, 16
#: Fewest bits of a set's map; a larger set has at least one bit a shingle.
LEAST_BITS = 64
#: Nodes of a prefix shingle that all others are compared with in the second round, and how many times more have had
#: their turn after each further one.  Neither changes a result.
HUBS, GROWTH = 8, 4


def shingle_set(text: str | None, shingle: int = 5):
    """Sorted different 64-bit hashes of the lower-cased (A-Z) word shingles; a shorter text is one shingle, no words none."""
    import numpy as np
    import xxhash

    tokens = [w.lower() for w in words(text)]
    if not tokens:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    width = min(shingle, len(tokens))
    made = np.full(len(tokens) - width + 1, width, np.uint64)
    for k in range(width):
        made = (made ^ (made >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[k : k + len(made)]
    made = (made ^ (made >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((made ^ (made >> np.uint64(32))).view(np.int64))


def _common(docs: DataFrame, key: str, text: str, shingle: int):
    """Sorted hashes of shingles that many rows hold, with their counts."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column(0).slice(at, 1000)]
                held, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    looked = docs.filter(F.pmod(F.xxhash64(key, text), F.lit(LOOKED)) == 0).select(text)
    found = spread(looked).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    rows = found.orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def set_print(held) -> int:
    """SimHash of a set of shingle hashes as a signed 64-bit number; an empty set gives 0."""
    import numpy as np

    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(held), 1 << 17):
        part = held[at : at + (1 << 17)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(held), bitorder="little").view("<i8")[0])


def set_map(held) -> bytes:
    """Bit map of a set of shingle hashes, a power of two of bits and at least one for each: bit ``hash mod bits`` is set."""
    import numpy as np

    size = max(LEAST_BITS, 1 << (len(held) - 1).bit_length() if len(held) else 1)
    bits = np.zeros(size, np.uint8)
    bits[(held.view(np.uint64) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_reach(m, n, one: list, two: list, percent: int):
    """For sets of ``m`` and ``n`` shingles with these maps: whether they can share enough.

    A bit that one map alone has is a shingle the other set lacks.  Maps of different lengths are compared at the
    shorter one, to which the longer folds.
    """
    import numpy as np

    lengths = np.array([(len(x), len(y)) for x, y in zip(one, two)], np.int64).reshape(-1, 2)
    keep = np.zeros(len(m), bool)
    for first, second in np.unique(lengths, axis=0).tolist():
        at = np.flatnonzero((lengths[:, 0] == first) & (lengths[:, 1] == second))
        x, y = (np.frombuffer(b"".join(maps[i] for i in at), "<u8").reshape(len(at), -1) for maps in (one, two))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
        only, other = (np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64) for a, b in ((x, y), (y, x)))
        shared = np.minimum(m[at] - only, n[at] - other)
        keep[at] = 100 * shared >= percent * (m[at] + n[at] - shared)
    return keep


def _prefixes(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """``key, print, node, size, own, fp, map, prefix`` per row; rows with equal sets have the same node, rows of one text the same print.

    ``own`` is how many thousandths of the set's shingles are none of the common ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, key, text, shingle))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        common, counts = shared.value
        for batch in batches:
            node, size, own, fp, maps, prefix = [], [], [], [], [], []
            for t in batch.column(2):
                held = shingle_set(t.as_py(), shingle)
                n = len(held)
                node.append(xxhash.xxh64_intdigest(held.tobytes()))
                size.append(n)
                fp.append(set_print(held))
                maps.append(set_map(held))
                known = 0
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, held), len(common) - 1)
                    often = np.where(common[at] == held, counts[at], 0)
                    known = np.count_nonzero(often)
                    held = held[np.lexsort((held, often))]
                own.append(1000 * (n - known) // max(n, 1))
                prefix.append(held[: n - -(-percent * n // 100) + 1])
            columns = [*batch.columns[:2], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(own, pa.int32()), pa.array(fp, pa.int64()), pa.array(maps, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "print", "node", "size", "own", "fp", "map", "prefix"])

    schema = T.StructType([docs.schema[key]] + T.StructType.fromDDL("print long, node long, size int, own int, fp long, map binary, prefix array<long>").fields)
    return spread(docs.select(key, text_print(text).alias("print"), text), key).mapInArrow(run, schema)


def text_print(text: str) -> F.Column:
    """A 64-bit hash of the text that tells rows of one key apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sets(docs: DataFrame, keys: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``node, held``: whole sets of the rows with these keys, each node once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                held = [shingle_set(t.as_py(), shingle) for t in batch.column(0).slice(at, 200)]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in held], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(held, pa.list_(pa.int64()))], names=["node", "held"])

    keys = keys.select(F.col(key).alias("__wanted")).distinct()
    rows = docs.join(keys, docs[key].eqNullSafe(keys["__wanted"]), "left_semi").select(text)
    return rows.mapInArrow(run, "node long, held array<long>").groupBy("node").agg(F.first("held").alias("held"))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may reach the bound, by the maps of their sets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m, n = (part.column(c).to_numpy().astype(np.int64) for c in ("m", "n"))
                keep = may_reach(m, n, part.column("one").to_pylist(), part.column("two").to_pylist(), percent)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("map").alias("one"))
    two = nodes.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("map").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "one", "two").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose similarity reaches the bound."""
    found = settle(pairs.distinct(), "pairs")
    pairs = settle(_possible(found, nodes, percent), "possible")
    drop_tables(found)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = settle(_sets(docs, nodes.join(wanted, "node").select(F.col("least.key").alias(key)), key, text, shingle), "sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("held").alias("two")), "b")
    # the smaller node of a pair is often the same: only these sets move again
    heads = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    both = both.join(heads.select(F.col("node").alias("a"), F.col("held").alias("one")), "a")
    shared = F.size(F.array_intersect("one", "two")).cast("long")
    found = settle(both.filter(100 * shared >= percent * (F.size("one") + F.size("two") - shared)).select("a", "b"), "links")
    drop_tables(pairs, sets)
    return found


def _merged(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of a component once these verified pairs are added: only roots meet in the new edges."""
    one, two = (roots.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("a", "r"), ("b", "s")))
    edges = pairs.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("r", "a").alias("a"), F.coalesce("s", "b").alias("b"))
    more = components(edges)
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    merged = settle(moved.union(more.join(roots, "node", "left_anti").select("node", "root")), "merged")
    drop_tables(roots, more)
    return merged


def _apart(listed: DataFrame) -> DataFrame:
    """The rows whose shingle is held by more than one component."""
    open_ = listed.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("shingle")
    return listed.join(open_, "shingle")


def roots_of(nodes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """``node, root`` of every node whose set reaches ``percent`` of similarity with another, linked over such pairs.

    Nodes whose SimHash fingerprints differ in two bits at most, found by the popcount grid, are compared first.  Where
    the nodes that share a prefix shingle are not one component yet, each is compared with the one of them that has the
    least of its own, then with about ``HUBS`` more, then with more in each round, until all have met or are one
    component.  So a round's pairs are the rows it has left, a stated number of times.  A large group of near copies is
    made of common shingles and what was changed in each: the least changed one lies in their middle, within the bound of
    copies that are not within it of each other, so the group falls together in the first rounds and costs what it has
    members; only what stays apart is compared one by one.  Two sets that reach the bound
    do so from the first shingle they share, so a shingle brings together only nodes that have enough left after it.
    Every pair is verified by its whole sets; tables are dropped as soon as the next one is written.
    """
    check = (nodes, docs, key, text, shingle, percent)
    firsts = settle(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    one, two = (firsts.select(F.col("fp").alias(f), F.col("node").alias(n)) for f, n in (("a", "x"), ("b", "y")))
    close = shuffled_join(shuffled_join(simhash.links(nodes.select("fp")), one, "a"), two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.select("fp", F.col("node").alias("b")).join(firsts.select("fp", F.col("node").alias("a")), "fp").filter("a != b").select("a", "b")
    near = _verified(close.union(same), *check)
    roots = components(near)
    drop_tables(firsts, near)
    known = shuffled_join(nodes, roots, "node", "left").select("node", "size", "own", "prefix", F.coalesce("root", "node").alias("root"))
    listed = known.select(F.posexplode("prefix").alias("at", "shingle"), "node", "size", "own", "root").withColumn("after", F.expr("size - at - 1")).drop("at")
    heads = listed.groupBy("shingle").agg(F.min(F.struct("own", "node", "size", "after", "root")).alias("hub"), F.min("root").alias("least"), F.max("root").alias("most"))
    heads = heads.filter("least < most").select("shingle", F.col("hub.node").alias("hub"), F.col("hub.size").alias("other"), F.col("hub.after").alias("rest"), F.col("hub.root").alias("apart"))
    met = settle(listed.drop("own").join(heads, "shingle"), "met")
    # lengths that can reach the bound, and enough shingles from this one on
    may = f"root != apart AND 100 * least(size, other) >= {percent} * greatest(size, other) AND {100 + percent}L * (1 + least(after, rest)) >= {percent}L * (size + other)"
    found = _verified(met.filter(may).select(F.col("hub").alias("a"), F.col("node").alias("b")), *check)
    # the hub has met everyone
    left, done, hubs = met.filter("node != hub").select("shingle", "node", "size", "after"), (met, found), HUBS
    roots = _merged(roots, found)
    counts = left.groupBy("shingle").agg(F.count("*").alias("n"))
    # nodes are hashes: of n, about h have a turn below h, whichever they are
    left = left.join(counts, "shingle").withColumn("turn", F.expr("(node / 18446744073709551616D + 0.5D) * n")).drop("n")
    while True:
        open_ = settle(_apart(left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))), "open")
        drop_tables(*done)
        if open_.isEmpty():
            drop_tables(open_)
            return roots
        heads = open_.filter(F.col("turn") < hubs).select("shingle", F.col("node").alias("hub"), F.col("size").alias("other"), F.col("after").alias("rest"), F.col("root").alias("apart"))
        found = _verified(open_.join(heads, "shingle").filter(f"hub < node AND {may}").select(F.col("hub").alias("a"), F.col("node").alias("b")), *check)
        left, done = open_.filter(F.col("turn") >= hubs).drop("root"), (open_, found)
        roots, hubs = _merged(roots, found), hubs * GROWTH


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Only the row with the smallest key of each component of texts that share ``percent`` of their shingles, all columns kept.

    Null and empty texts are copies of each other.  Rows of one key are told apart by their texts; of rows that share
    key and text every one stays if one does.  Rows with a null key stay only if their component has no other key (then
    those of one text do).  Columns other than key and text may have any name.  An empty table gives no rows.
    """
    rows = _prefixes(docs, key, text, shingle, percent)
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "print")
    same = [F.first(c).alias(c) for c in ("size", "own", "fp", "map", "prefix")]
    nodes = rows.groupBy("node").agg(F.min(row).alias("least"), *same)
    nodes = settle(nodes, "nodes")
    roots = roots_of(nodes, docs, key, text, shingle, percent)
    named = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("__key"), F.col("least.print").alias("__print"))
    kept = settle(kept.distinct(), "kept")
    drop_tables(nodes, roots)
    return shuffled_join(docs, kept, docs[key].eqNullSafe(kept["__key"]) & (text_print(text) == kept["__print"]), "left_semi")
