"""How much a strategy repeats others: variance inflation, factor correlation, rule diversity (G-28, G-32, G-36)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.formula import feature_set
from barloom.operators.ordered import beside, neighbour
from barloom.session import cut_lineage, stored

#: Candidates that one task solves against the factors of one level.
SOLVED = 4096
#: Candidates that meet all factors over a span of positions at a time.
MET = 256
#: Returns that one task of ``factor_correlation`` holds, about.
DEALT = 1 << 19


def _factor_names(returns: DataFrame, factors: Sequence[str] | DataFrame, key: str) -> DataFrame:
    """``key, _i``: the factor series numbered from 0; one row per factor."""
    if not isinstance(factors, DataFrame):
        kind = returns.schema[key].dataType.simpleString()
        factors = returns.sparkSession.createDataFrame([(f,) for f in factors], f"{key} string").select(F.col(key).cast(kind))
    names = factors.select(key).distinct()
    return cut_lineage(names.withColumn("_i", F.row_number().over(Window.orderBy(key)) - 1))


def _levels(lengths: DataFrame, top: str, span: int) -> DataFrame:
    """``_kb, _level``: for every span of positions the levels that its positions count for, the smallest that reaches each."""
    levels = lengths.select(F.col(top).alias("_level")).distinct()
    before = neighbour(levels, [], ["_level"], F.floor(F.col("_level") / 65536), {"_prev": "_level"})
    spans = F.sequence(F.floor(F.coalesce("_prev", F.lit(0)) / span), F.floor((F.col("_level") - 1) / span))
    return before.select(F.explode(spans).alias("_kb"), "_level")


def _products(v, f):
    """Number, sums and sum of products of the rows of ``v`` with those of ``f`` over the places where both have a value."""
    here, there = ~np.isnan(v), ~np.isnan(f)
    m, o, v, f = here.astype(float), there.astype(float), np.where(here, v, 0.0), np.where(there, f, 0.0)
    return m @ o.T, v @ o.T, m @ f.T, v @ f.T


def _span_products(held: DataFrame, own: DataFrame, levels: DataFrame, key: str, factors: int, span: int, parts: int) -> DataFrame:
    """Sums of products by span of positions: of two factors by level (``key`` is null), of a series with each factor.

    A group holds one span of all factors and of a part of the other series, as two matrices.
    """
    kb = F.floor((F.col("_k") - 1) / span).alias("_kb")
    rows = held.select(kb, "_i", "_k", "_f")
    rows = rows.union(levels.select("_kb", F.lit(-1), F.col("_level"), F.lit(None).cast("double")))
    rows = rows.select("_kb", F.col("_i").cast("int").alias("_i"), F.col("_k").cast("long").alias("_k"), "_f", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    others = own.select(kb, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_part"), key, F.col("_k").cast("long").alias("_k"), "_v")
    schema = T.StructType([own.schema[key], *T.StructType.fromDDL("_level long, _i int, _j int, _n double, _x double, _y double, _xy double").fields])
    schema[key].nullable = True

    def multiply(left, right):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        i, k = left.column("_i").to_numpy(), left.column("_k").to_numpy()
        made = []
        if (i >= 0).any():
            start = (k[i >= 0][0] - 1) // span * span
            f = np.full((factors, span), np.nan)
            f[i[i >= 0], k[i >= 0] - 1 - start] = left.column("_f").to_numpy()[i >= 0]
            cuts = np.sort(k[i < 0])
            if left.column("_part")[0].as_py() == 0:
                one, two = np.triu_indices(factors)
                edges = [0, *np.clip(cuts - start, 0, span)]
                for level, a, b in zip(cuts, edges, edges[1:]):
                    sums = [x[one, two] for x in _products(f[:, a:b], f[:, a:b])]
                    none = pa.nulls(len(one), target.field(key).type)
                    made.append([none, np.full(len(one), level), one.astype(np.int32), two.astype(np.int32), *sums])
            if right.num_rows:
                ids = right.column(key).combine_chunks().dictionary_encode()
                v = np.full((len(ids.dictionary), span), np.nan)
                v[ids.indices.to_numpy(), right.column("_k").to_numpy() - 1 - start] = right.column("_v").to_numpy()
                sums = [x.ravel() for x in _products(v, f)]
                who, which = (x.ravel() for x in np.indices((len(v), factors)))
                made.append([ids.dictionary.take(pa.array(who)), pa.nulls(len(who), pa.int64()), which.astype(np.int32), pa.nulls(len(who), pa.int32()), *sums])
        tables = [pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=target.names).cast(target) for cols in made]
        return pa.concat_tables(tables) if tables else target.empty_table()

    return rows.groupBy("_kb", "_part").cogroup(others.groupBy("_kb", "_part")).applyInArrow(multiply, schema)


_COV = "try_divide(_xy, _n) - try_divide(_x, _n) * try_divide(_y, _n)"


def vif(
    returns: DataFrame, factors: Sequence[str] | DataFrame, key: str = "alpha_id", value: str = "ret", at: str = "from_end", min_rows: int = 10
) -> DataFrame:
    """G-28: 1 / (1 - R^2) of every other series on the factor series, over the common tail.

    ``at`` is the 1-based position from the end without holes, so tails align without looking ahead; missing values
    leave the products they are part of.  ``factors`` is a list or a table of keys, of any number.  No product is a row:
    spans of positions become matrices, and only sums leave them, of a candidate with each factor and of two factors by
    tail length, for each tail length that a candidate has; the latter are running sums over the lengths below.
    The normal equations of one length are then solved for blocks of its candidates, however many share it.
    """
    names = _factor_names(returns, factors, key)
    totals = returns.groupBy(key).agg(F.count(F.lit(1)).alias("_len"), F.avg(value).alias("_mean")).join(names, key, "left")
    shortest = totals.where(F.col("_i").isNotNull()).agg(F.min("_len").alias("_min_f"))
    rows = F.when(F.col("_i").isNull(), F.least("_len", "_min_f")).alias("_rows")
    # a row per series, stored so that its size is known and the returns need not move to meet it
    info = stored(totals.transform(beside, shortest).select(key, "_i", "_mean", rows), "series")
    rest = info.where(F.col("_i").isNull()).select(key, "_rows")
    scored = rest.where(F.col("_rows") >= min_rows)
    # series are shifted by their means first: sums of products then keep their digits
    moved = returns.join(info, key).select(key, "_i", "_rows", F.col(at).alias("_k"), (F.col(value) - F.col("_mean")).alias("_v"))
    size = names.count()
    span = max(64, min(4096, (1 << 20) // max(1, size)))
    parts = max(1, -(-scored.count() // MET))
    top = scored.agg(F.max("_rows").alias("_top"))
    held = moved.where(F.col("_i").isNotNull()).transform(beside, top).where(F.col("_k") <= F.col("_top")).select("_i", "_k", F.col("_v").alias("_f"))
    own = moved.where(F.col("_i").isNull() & (F.col("_rows") >= min_rows) & (F.col("_k") <= F.col("_rows")))
    products = _span_products(held, own.select(key, "_k", "_v"), _levels(scored, "_rows", span), key, size, span, parts)
    sums = [F.sum(c).alias(c) for c in ("_n", "_x", "_y", "_xy")]
    products = stored(products.where("_n > 0 OR _level IS NOT NULL").groupBy(key, "_level", "_i", "_j").agg(*sums), "products")
    upto = Window.partitionBy("_i", "_j").orderBy("_level").rowsBetween(Window.unboundedPreceding, 0)
    pairs = products.where(F.col("_level").isNotNull()).select("_level", "_i", "_j", *(F.sum(c).over(upto).alias(c) for c in ("_n", "_x", "_y", "_xy")))
    matrix = pairs.select("_level", "_i", "_j", F.expr(_COV).alias("_c"))

    spread_ = own.groupBy(key).agg(F.var_pop("_v").alias("_var"))
    met = products.where(F.col("_level").isNull()).join(scored, key)
    wanted = met.groupBy(key, "_rows").agg(F.collect_list(F.struct("_i", F.expr(_COV).alias("_c"))).alias("_with")).join(spread_, key)
    blocks = scored.groupBy(F.col("_rows").alias("_level")).agg(F.ceil(F.count(F.lit(1)) / SOLVED).cast("long").alias("_blocks"))
    wanted = wanted.withColumnRenamed("_rows", "_level").join(blocks, "_level").withColumn("_block", F.pmod(F.xxhash64(key), "_blocks"))
    matrix = matrix.join(blocks, "_level").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    kind = returns.schema[key]

    def solve(left, right):
        import pyarrow as pa

        i, j, c = (left.column(n).to_numpy() for n in ("_i", "_j", "_c"))
        size = int(j.max()) + 1 if len(j) else 0
        m = np.zeros((size, size))
        m[i, j] = m[j, i] = np.nan_to_num(c)
        b = np.zeros((size, right.num_rows))
        for n, row in enumerate(right.column("_with").to_pylist()):
            for x in row:
                b[x["_i"], n] = x["_c"] or 0.0
        beta = np.linalg.lstsq(m, b, rcond=None)[0] if size and right.num_rows else b
        var = right.column("_var").to_numpy()
        fit = (beta * b).sum(axis=0)
        r2 = np.clip(np.divide(fit, var, out=np.zeros(len(var)), where=var > 0), 0.0, 0.999999)
        out = np.where(var > 0, np.where(r2 >= 0.999999, np.inf, 1.0 / (1.0 - r2)), 1.0)
        return pa.table({key: right.column(key), "vif": pa.array(out)})

    schema = T.StructType([kind, T.StructField("vif", T.DoubleType())])
    left = matrix.select("_level", "_block", "_i", "_j", "_c").groupBy("_level", "_block")
    right = wanted.select("_level", "_block", key, "_var", "_with").groupBy("_level", "_block")
    solved = left.cogroup(right).applyInArrow(solve, schema)
    return rest.select(key).join(solved, key, "left").select(key, F.coalesce("vif", F.lit(1.0)).alias("vif"))


def factor_correlation(
    returns: DataFrame, factors: Sequence[str] | DataFrame, cap: float, key: str = "alpha_id", at: str = "ts", value: str = "ret", min_rows: int = 3
) -> DataFrame:
    """G-36: largest absolute correlation of every series with the factor series on common dates, and a cap flag.

    Candidates meet the factors (the strategies already held, a list or a table of any number), never each other; a
    candidate's day becomes one row per factor of that day, and these are summed before they move.
    """
    names = stored(_factor_names(returns, factors, key), "factors")
    # dates are dealt once, to as many tasks as there are rows for; sums and meetings of a date are made where it is
    tasks = max(1, -(-returns.count() // DEALT))
    daily = returns.select(key, at, value).repartition(tasks, at).groupBy(key, at).agg(F.sum(value).alias(value))
    held = daily.join(names, key).select("_i", F.col(at), F.col(value).alias("_f"))
    others = daily.join(names, key, "left_anti")
    met = others.join(held, at).where(F.col("_f").isNotNull())
    corr = F.try_divide(F.covar_samp(value, "_f"), F.stddev_samp(value) * F.stddev_samp(F.when(F.col(value).isNotNull(), F.col("_f"))))
    each = met.groupBy(key, "_i").agg(F.abs(F.when(F.count(F.lit(1)) >= min_rows, corr)).alias("_c"))
    scored = each.groupBy(key).agg(F.max("_c").alias("max_corr"))
    return others.select(key).distinct().join(scored, key, "left").withColumn("allowed", F.coalesce(F.col("max_corr") <= cap, F.lit(True)))


def jaccard_counts(formulas: DataFrame, formula: str = "formula_json", block_sets: int = 2048) -> DataFrame:
    """G-32: number of rule pairs per Jaccard similarity of their feature sets, exactly, whatever their sizes.

    Equal sets are counted first.  Different sets are dealt into blocks; two blocks become matrices of zeros and ones
    over the features that occur in them, whose product holds all intersection sizes, and only the number of pairs per
    pair of sizes leaves the task.  No pair of rules or sets is ever a row.
    """
    sets = formulas.select(feature_set(formula).alias("fs")).groupBy("fs").agg(F.count(F.lit(1)).alias("c"))
    sets = cut_lineage(sets)
    blocks = max(1, -(-sets.count() // block_sets))
    packed = sets.groupBy(F.pmod(F.xxhash64("fs"), F.lit(blocks)).alias("block")).agg(F.collect_list("fs").alias("sets"), F.collect_list("c").alias("cs"))
    packed = cut_lineage(packed)
    partner = F.explode(F.sequence(F.col("block"), F.lit(blocks - 1).cast("long"))).alias("other")
    left = packed.select("block", "sets", "cs", partner)
    right = packed.select(F.col("block").alias("other"), F.col("sets").alias("sets2"), F.col("cs").alias("cs2"))

    def run(batches):
        import pyarrow as pa

        def matrix(sets, place):
            m = np.zeros((len(sets), max(1, len(place))), np.float32)
            for i, fs in enumerate(sets):
                m[i, [place[f] for f in fs]] = 1.0
            return m

        for batch in batches:
            for r in batch.to_pylist():
                place: dict[str, int] = {}
                for fs in (*r["sets"], *r["sets2"]):
                    for f in fs:
                        place.setdefault(f, len(place))
                one, two = matrix(r["sets"], place), matrix(r["sets2"], place)
                shared = (one @ two.T).astype(np.int64)
                a, b = one.sum(axis=1).astype(np.int64), two.sum(axis=1).astype(np.int64)
                union = a[:, None] + b[None, :] - shared
                c, d = np.array(r["cs"], np.int64), np.array(r["cs2"], np.int64)
                pairs = c[:, None] * d[None, :]
                if r["block"] == r["other"]:
                    pairs = np.triu(pairs, 1)
                    pairs[np.diag_indices(len(c))] = c * (c - 1) // 2
                kinds, where = np.unique(shared * (1 << 32) + union, return_inverse=True)
                total = np.zeros(len(kinds), np.int64)
                np.add.at(total, where.ravel(), pairs.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(kinds >> 32), pa.array(kinds & 0xFFFFFFFF), pa.array(total)], names=["shared", "joint", "pairs"])

    met = left.join(right, "other").select("block", "other", "sets", "cs", "sets2", "cs2")
    counted = met.mapInArrow(run, "shared long, joint long, pairs long")
    jac = F.when(F.col("joint") == 0, 1.0).otherwise(F.col("shared") / F.col("joint"))
    return counted.groupBy(jac.alias("jaccard")).agg(F.sum("pairs").alias("pairs")).where(F.col("pairs") > 0)


def formula_diversity(formulas: DataFrame, formula: str = "formula_json") -> DataFrame:
    """G-32: one minus the median pairwise Jaccard similarity."""
    from pyspark.sql import Window

    counts = jaccard_counts(formulas, formula)  # a few rows: one per possible similarity
    w = Window.orderBy("jaccard").rowsBetween(Window.unboundedPreceding, 0)
    total = counts.agg(F.sum("pairs").alias("_total"))
    ranked = counts.withColumn("_last", F.sum("pairs").over(w)).transform(beside, total)
    first, last = F.col("_last") - F.col("pairs"), F.col("_last")
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    pick = lambda r: F.max(F.when((first <= r) & (r < last), F.col("jaccard")))
    return ranked.agg(((pick(lo) + pick(hi)) / 2).alias("median_jaccard"), F.max("_total").alias("pairs")).withColumn(
        "diversity", 1.0 - F.col("median_jaccard")
    )


def similar_sets(formulas: DataFrame, threshold: float, formula: str = "formula_json") -> DataFrame:
    """Pairs of distinct feature sets with Jaccard similarity of at least ``threshold``.

    Exact prefix filter: two such sets must share one of their rarest features, so common features are never
    join keys unless a set has nothing rarer.
    """
    sets = formulas.select(feature_set(formula).alias("fs")).distinct().withColumn("set_id", F.array_join("fs", "\x01"))
    freq = sets.select(F.explode("fs").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    ranked = (
        sets.select("set_id", F.size("fs").alias("size"), F.explode("fs").alias("f")).join(freq, "f")
        .groupBy("set_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("by_rarity"))
    )
    keep = (F.col("size") - F.ceil(F.col("size") * threshold) + 1).cast("int")
    prefix = ranked.select("set_id", "size", F.explode(F.slice("by_rarity", F.lit(1), keep)).alias("p")).select(
        "set_id", "size", F.col("p.f").alias("f")
    )
    left = prefix.withColumnsRenamed({"set_id": "a", "size": "_sa"})
    right = prefix.withColumnsRenamed({"set_id": "b", "size": "_sb"})
    close = (F.least("_sa", "_sb") >= F.greatest("_sa", "_sb") * threshold) & (F.col("a") < F.col("b"))
    pairs = left.join(right, "f").where(close).select("a", "b").distinct()
    text = lambda c: F.split(c, "\x01")
    jac = F.size(F.array_intersect(text("a"), text("b"))) / F.size(F.array_union(text("a"), text("b")))
    return pairs.withColumn("jaccard", jac).where(F.col("jaccard") >= threshold)


def _stars(edges: DataFrame) -> DataFrame:
    """One round on edges ``hi > lo``: every node's larger neighbours, then its smaller ones, move to the least of them."""
    both = edges.union(edges.select("lo", "hi").toDF("hi", "lo"))
    least = both.groupBy("hi").agg(F.min("lo").alias("_m")).select(F.col("hi").alias("node"), F.least("hi", "_m").alias("_m"))
    large = edges.select(F.col("lo").alias("node"), F.col("hi").alias("far")).join(least, "node").select(F.col("far").alias("hi"), F.col("_m").alias("lo"))
    large = large.where("hi > lo").distinct()
    head = large.groupBy("hi").agg(F.min("lo").alias("_m"))
    small = large.join(head, "hi").select(F.col("lo").alias("hi"), F.col("_m").alias("lo")).where("hi > lo")
    return small.union(head.select("hi", F.col("_m").alias("lo"))).distinct()


def connected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node that each node of a pair reaches.

    Alternating large and small stars: rounds grow with the logarithm of the longest chain, every round is joins and
    minima over edges, and its edges are a stored table.
    """
    edges = stored(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, edges = now, stored(_stars(edges), "edges")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def species(formulas: DataFrame, threshold: float, formula: str = "formula_json") -> DataFrame:
    """G-32: cluster of every distinct feature set (smallest member) and its rule count."""
    sets = formulas.select(F.array_join(feature_set(formula), "\x01").alias("set_id")).groupBy("set_id").agg(
        F.count(F.lit(1)).alias("rules")
    )
    sets = cut_lineage(sets)
    roots = connected(similar_sets(formulas, threshold, formula)).select(F.col("node").alias("set_id"), "root")
    return sets.join(roots, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("label"), "rules")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("rules").alias("rules"))


