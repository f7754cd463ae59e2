"""Nearest neighbours by cosine: a hierarchical k-means tree searched best bin first, leaf visits set by measured recall.

The tree is fitted on a bounded sample and small enough to broadcast; every different vector is then filed under its
leaf.  A query walks the tree through a priority queue of bounds and visits the nearest leaves.  How many is found by
widening the visits of sample queries, whose true neighbours are known, until their recall reaches the goal.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import settle, shuffled_join, spread

#: Cosines this close are ties until they are computed from the original vectors.
TIED = 1e-12
#: Bounds of the fit: vectors sampled for the tree, and queries whose neighbours are found by brute force.
SAMPLE, PROBES = 65_536, 256
#: Vectors of a leaf that one block holds; more make further blocks.
BLOCK = 1024
_INDEX = T.StructType([T.StructField("vec", T.LongType()), T.StructField("leaf", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


@dataclass
class Tree:
    """Nodes by number: unit centre, children (empty for a leaf) and leaf number (-1 inside)."""

    centres: object
    children: list
    leaf: object
    n_leaves: int

    def leaves_by_nearness(self, vector, most: int) -> list[int]:
        """Leaves in the order of a best-first walk: always open the node whose centre is nearest."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
                continue
            kids = self.children[node]
            for score, kid in zip((self.centres[kids] @ vector).tolist(), kids):
                heapq.heappush(queue, (-score, kid))
        return found

    def leaf_of(self, vectors):
        """The leaf a vector is filed under: down the tree by the nearest child."""
        import numpy as np

        node = np.zeros(len(vectors), dtype=np.int64)
        while True:
            inside = np.flatnonzero(self.leaf[node] < 0)
            if not len(inside):
                return self.leaf[node]
            for parent in np.unique(node[inside]):
                rows = inside[node[inside] == parent]
                kids = np.array(self.children[parent])
                node[rows] = kids[(vectors[rows] @ self.centres[kids].T).argmax(axis=1)]


def build_tree(vectors, n_leaves: int, branch: int = 8, rounds: int = 8, seed: int = 7) -> Tree:
    """Spherical k-means applied again and again to the largest node until there are ``n_leaves`` leaves."""
    import numpy as np

    rng = np.random.default_rng(seed)
    width = vectors.shape[1] if vectors.ndim == 2 else 0
    centres, children, rows = [np.zeros(width)], [[]], {0: np.arange(len(vectors))}
    queue, leaves = [(-len(vectors), 0)], 1
    while queue and leaves < n_leaves:
        size, node = heapq.heappop(queue)
        own = rows[node]
        k = min(branch, len(own), n_leaves - leaves + 1)
        if -size < 2 or k < 2:
            continue
        points = vectors[own]
        middle = points[rng.choice(len(own), k, replace=False)]
        for _ in range(rounds):
            to = (points @ middle.T).argmax(axis=1)
            for c in range(k):
                total = points[to == c].sum(axis=0)
                norm = np.linalg.norm(total)
                if norm > 0:
                    middle[c] = total / norm
        to = (points @ middle.T).argmax(axis=1)
        used = np.unique(to)
        if len(used) < 2:
            continue
        leaves += len(used) - 1
        del rows[node]
        for c in used.tolist():
            kid = len(centres)
            centres.append(middle[c])
            children.append([])
            children[node].append(kid)
            rows[kid] = own[to == c]
            heapq.heappush(queue, (-len(rows[kid]), kid))
    leaf, n = np.full(len(centres), -1), 0
    for node, kids in enumerate(children):
        if not kids:
            leaf[node], n = n, n + 1
    return Tree(np.array(centres), children, leaf, n)


def usable(embedding) -> F.Column:
    """True for a vector without null, NaN or infinite components that is not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0)


def _matrix(column):
    import numpy as np

    flat = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def _unit(m):
    import numpy as np

    top = np.abs(m).max(axis=1, keepdims=True) if m.size else np.ones((len(m), 1))
    m = m / top
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _best(scores, ids, k: int):
    """For each row of scores the ids of its ``k`` largest, and of all within :data:`TIED` of the last of them."""
    import numpy as np

    if scores.shape[1] > k:
        last = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        ids = np.asarray(ids)
        return [(ids[at].tolist(), s[at].tolist()) for at, s in ((np.flatnonzero(s >= t - TIED), s) for s, t in zip(scores, last))]
    return [(list(ids), s.tolist()) for s in scores]


def _nearest_of(held: list, k: int) -> list:
    """The ``k`` smallest ``(distance, id)`` and all within :data:`TIED` of the last of them."""
    first = heapq.nsmallest(k, held)
    if len(first) < k:
        return first
    return [x for x in held if x[0] <= first[-1][0] + TIED]


def distinct_vectors(vectors: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Different vectors as ``vec, embedding``, and ``vec, key`` for the ``k + 1`` smallest keys of each.

    No answer needs more: a query's own key and ``k`` others.  Copies, however many, are thus cut before the shuffle.
    """
    order = Window.partitionBy("embedding").orderBy(F.col("key").asc_nulls_last())
    ranked = vectors.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    ranked = settle(ranked.withColumn("vec", F.xxhash64("embedding")), "vectors")
    return ranked.filter("n = 1").select("vec", "embedding"), ranked.select("vec", "embedding", "key")


def _taken(points: DataFrame, total: int, most: int, seed: int) -> DataFrame:
    """Every n-th vector by hash, about ``most`` at most."""
    return points.filter(F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(max(1, -(-total // most)))) == 0)


def fit(points: DataFrame, per_leaf: int = 96, branch: int = 8, seed: int = 7) -> Tree:
    """A tree on about :data:`SAMPLE` different vectors at most, taken by hash; leaves grow with the table up to half the sample."""
    import numpy as np

    total = points.count()
    sample = _taken(points, total, SAMPLE, seed).select("embedding").toPandas()["embedding"]
    vectors = _unit(np.array(sample.tolist(), dtype=np.float64)) if len(sample) else np.zeros((0, 1))
    return build_tree(vectors, max(1, min(total // per_leaf, SAMPLE // 2, len(vectors))), branch, seed=seed)


def _true_neighbours(points: DataFrame, probes, k: int) -> DataFrame:
    """Brute force for the probes (``vec`` and unit vectors, bounded): ``probe, vec, leaf`` of the ``k`` nearest others."""
    ids, units = probes

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = np.asarray(batch.column(0))
            leaf = np.asarray(batch.column(1))
            scores = units @ _unit(_matrix(batch.column(2))).T
            scores[ids[:, None] == own[None, :]] = -2.0
            best = _best(scores, np.arange(len(own)), k)
            rows = [(p, own[j], leaf[j], s) for p, (at, score) in zip(ids.tolist(), best) for j, s in zip(at, score) if s > -2.0]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["probe", "vec", "leaf", "score"])

    near = points.select("vec", "leaf", "embedding").mapInArrow(run, "probe long, vec long, leaf int, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec")
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def calibrate(filed: DataFrame, tree: Tree, k: int, recall: float, seed: int = 11) -> int:
    """The fewest leaf visits at which :data:`PROBES` sample queries find ``recall`` of their true neighbours."""
    import numpy as np

    chosen = _taken(filed, filed.count(), PROBES, seed).select("vec", "embedding").toPandas()
    if not len(chosen):
        return 1
    ids = chosen["vec"].to_numpy()
    units = _unit(np.array(chosen["embedding"].tolist(), dtype=np.float64))
    wanted = {}
    for r in _true_neighbours(filed, (ids, units), k).collect():  # at most PROBES * k rows
        wanted.setdefault(r.probe, []).append(r.leaf)
    ranks = []
    for i, u in zip(ids.tolist(), units):
        rank = {leaf: n + 1 for n, leaf in enumerate(tree.leaves_by_nearness(u, tree.n_leaves))}
        ranks += [rank[leaf] for leaf in wanted.get(i, [])]
    if not ranks:
        return 1
    ranks, visits = np.array(ranks), 1
    while (ranks <= visits).mean() < recall:
        visits += 1
    return visits


def nearest(vectors: DataFrame, queries, k: int = 5, key: str = "vec_id", embedding: str = "embedding", recall: float = 0.94, per_leaf: int = 96) -> DataFrame:
    """``query_id, rank, key, score``: each query's ``k`` nearest other rows by cosine, ties to the smaller key.

    ``queries`` is a Boolean column of ``vectors``.  Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do queries of them or with a null key.  A cosine needs vectors of one length: each length has a
    tree of its own, and queries meet the vectors of theirs (a handful of lengths at most; each is a search of its own).
    Keys are taken to be unique; of rows that repeat a key with one vector one counts.  Vectors that tie with the last
    one kept are all kept until they are scored exactly.  Fewer candidates give fewer rows; an empty table gives none.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("embedding"), queries.alias("query"))
    rows = rows.filter(usable(F.col("embedding")) & F.col("key").isNotNull()).distinct()
    sizes = sorted(r[0] for r in rows.groupBy(F.size("embedding").alias("size")).count().collect())
    parts = [_nearest(rows.filter(F.size("embedding") == size), k, key, recall, per_leaf) for size in sizes or [0]]
    return reduce(DataFrame.unionByName, parts)


def _nearest(rows: DataFrame, k: int, key: str, recall: float, per_leaf: int) -> DataFrame:
    """:func:`nearest` among vectors of one length: ``key, embedding, query``."""
    points, members = distinct_vectors(rows.select("key", "embedding"), "key", k)
    tree = fit(points, per_leaf)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def file(batches):
        import pyarrow as pa

        for batch in batches:
            leaf = shared.value.leaf_of(_unit(_matrix(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf, pa.int32()), batch.column(1)], names=_INDEX.names)

    filed = settle(spread(points.select("vec", "embedding")).mapInArrow(file, _INDEX), "leaves")
    visits = calibrate(filed, tree, k, recall)

    def visit(batches):
        import pyarrow as pa

        for batch in batches:
            units = _unit(_matrix(batch.column(1)))
            leaves = [shared.value.leaves_by_nearness(u, visits) for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves, pa.list_(pa.int32()))], names=["vec", "embedding", "leaves"])

    asked = rows.filter("query").select(F.xxhash64("embedding").alias("vec"), "embedding", "key")
    walks = asked.select("vec", "embedding").distinct().mapInArrow(visit, "vec long, embedding array<double>, leaves array<int>")
    # blocks of queries meet blocks of vectors, so the join has few rows and the products are matrix products
    walked = walks.select("vec", "embedding", F.explode("leaves").alias("leaf"))
    packed = F.collect_list(F.struct("vec", "embedding"))

    def blocked(rows, name):
        counts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        parts = shuffled_join(rows, counts, "leaf").groupBy("leaf", F.pmod("vec", "blocks").alias("block"))
        return parts.agg(packed.alias(name)).drop("block")

    left, right = blocked(settle(walked, "walks"), "asked"), blocked(filed, "held")
    blocks = shuffled_join(left, right, "leaf").select("asked.vec", "asked.embedding", F.col("held.vec").alias("vec2"), F.col("held.embedding").alias("embedding2"))

    def score(batches):
        import numpy as np
        import pyarrow as pa

        def pack():
            rows = [(q, vec, near) for q, held in best.items() for near, vec in _nearest_of(held, k + 1)]
            columns = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([-n for n in columns[2]], pa.float64())], names=["asker", "vec", "near"])

        # a task keeps the best of each query it meets, so that the shuffle carries few rows
        best: dict[int, list] = {}
        kept: dict[int, int] = {}
        for batch in batches:
            for q, qe, v, ve in zip(*(batch.column(i) for i in range(4))):
                one, two = (_unit(np.array(x.as_py(), dtype=np.float64)) for x in (qe, ve))
                for i, (ids, scores) in zip(q.as_py(), _best(one @ two.T, v.as_py(), k + 1)):
                    held = best.setdefault(i, [])
                    held += [(-s, j) for s, j in zip(scores, ids)]
                    if len(held) > kept.get(i, 0) + 16 * (k + 1):
                        best[i] = _nearest_of(held, k + 1)
                        kept[i] = len(best[i])
            if len(best) > 50_000:
                yield pack()
                best, kept = {}, {}
        yield pack()

    found = settle(blocks.mapInArrow(score, "asker long, vec long, near double").distinct(), "near")
    best = Window.partitionBy("asker").orderBy(F.desc("near"), "vec")
    ranked = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    last = ranked.groupBy(F.col("asker").alias("of")).agg(F.min("near").alias("last"))
    # all that tie with the last are scored exactly before keys decide
    found = found.join(last, found["asker"] == last["of"]).filter(F.col("near") >= F.col("last") - TIED).select("asker", "vec", "near")
    # back to rows: every key that shares a found vector, scored on the original vectors
    other = members.select("vec", F.col("embedding").alias("other"), F.col("key").alias("id"))
    pairs = shuffled_join(shuffled_join(found, other, "vec"), asked.select(F.col("vec").alias("asker"), F.col("key").alias("query_id"), "embedding"), "asker")
    pairs = pairs.filter("id != query_id")
    ranked = pairs.withColumn("score", _cosine(F.col("embedding"), F.col("other")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _cosine(a, b):
    """Cosine in double precision."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
