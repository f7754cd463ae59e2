"""Mixing sources to target weights by hash thresholds: histograms of sizes over hash buckets, no sort of documents.

Each source takes whole rounds of all its documents and, for the rest of its target, those whose hash lies below a
threshold.  The threshold is found from sizes summed by source and hash bucket; only the bucket in which the budget
ends is split further.  A larger budget has a larger threshold, so selections are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import settle, word_count

#: Bits of the row hash (15 hexadecimal digits) and bits read at each step.
HASH_BITS, STEP = 60, 12


def row_hash(key):
    """A 60-bit hash of the key from its md5; a null key hashes like the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, weight, target``: the total size shared by weight, at most ``most`` times a source's size.

    ``sizes`` has one row per source.  Weights repeat along the sources in code point order, null last.  Water filling
    by aggregates alone: the level (target per unit of weight) rises until no further source meets its limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select("source", "source_size", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).alias("weight"))
    ranked = settle(ranked, "sources")
    limit = F.col("source_size") * F.lit(float(most))
    total, level, full = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        met = limit <= F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.sum(F.when(met, 1).otherwise(0)), F.sum(F.when(met, limit).otherwise(0.0)),
            F.sum(F.when(met, 0.0).otherwise(F.col("weight"))),
        ).first()
        if row[0] == full or not row[2]:
            break
        full, level = row[0], (total - row[1]) / row[2]
    target = F.when(F.lit(level) * F.col("weight") < limit, F.lit(level) * F.col("weight")).otherwise(limit)
    return ranked.withColumn("target", target)


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, rounds, below``: whole rounds to take and the hash below which a row is taken once more.

    ``rows`` has ``source, size, hash``; ``goals`` comes from :func:`targets`.  Stops as soon as every boundary bucket
    holds one row, at the latest after all hash bits; rows of equal hash are taken together.  The last bucket is taken
    if that brings its source nearer to its target.
    """
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.withColumn("rounds", rounds.cast("int")).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    state = settle(state.select("source", "rounds", "rest", F.lit(0).cast("long").alias("prefix")), "budget")
    sized, read = rows.filter("size > 0"), 0
    while read < HASH_BITS:
        above, read = HASH_BITS - read, read + STEP
        held = state.select(F.col("source").alias("of"), "prefix")
        inside = sized.join(held, sized["source"].eqNullSafe(held["of"]) & (F.expr(f"hash DIV {1 << above}") == held["prefix"]))
        sums = inside.groupBy("source", F.expr(f"hash DIV {1 << (HASH_BITS - read)}").alias("bucket")).agg(F.sum("size").alias("held"), F.count("*").alias("n"))
        up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("before", F.sum("held").over(up) - F.col("held"))
        run = run.withColumnRenamed("source", "of")
        budget = state.select("source", "rounds", "rest")
        edge = run.join(budget, run["of"].eqNullSafe(budget["source"])).filter("before <= rest AND before + held > rest")
        state = settle(edge.select("source", "rounds", (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("prefix"), "held", "n"), "budget")
        if (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    width = 1 << (HASH_BITS - read)
    if "held" not in state.columns:
        return state.select("source", "rounds", F.lit(0).cast("long").alias("below"))
    nearer = F.col("held") - F.col("rest") < F.col("rest")
    return state.select("source", "rounds", ((F.col("prefix") + F.when(nearer, 1).otherwise(0)) * F.lit(width)).alias("below"))


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``key, source, size, source_size, target, copies`` per row; size is the number of words.

    Null and empty texts have size 0 and are never copied.  A null source is a source of its own.  A source of size 0
    has target 0.  Repeated keys share a hash and are taken together; repeated rows stay rows of their own.  Other
    columns are not read, whatever their names.  An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = settle(rows.withColumn("hash", row_hash(F.col("key"))), "sizes")
    goals = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    cut = thresholds(rows, goals).withColumnRenamed("source", "of")
    told = goals.join(cut, goals["source"].eqNullSafe(cut["of"]), "left")
    told = told.select(F.col("source").alias("of"), "source_size", "target", F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("below", F.lit(0)).alias("below"))
    all_rows = rows.join(told, rows["source"].eqNullSafe(told["of"]))
    copies = F.when(F.col("size") > 0, F.col("rounds") + (F.col("hash") < F.col("below")).cast("int")).otherwise(0)
    return all_rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, all columns kept.

    Rows are matched by key; all rows of one key have one hash, but their sizes may differ, so a row of size 0 goes and
    the others follow their source.
    """
    plan = plan_mix(docs, key, **settings)
    source = settings.get("source", "source")
    taken = plan.filter("copies > 0").select(F.col(key).alias("__key"), F.col(source).alias("__source"), "copies").distinct()
    rows = docs.filter(word_count(F.col(settings.get("text", "text"))) > 0)
    rows = rows.join(taken.withColumnRenamed("copies", "__copies"), rows[key].eqNullSafe(taken["__key"]) & rows[source].eqNullSafe(taken["__source"]))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[rows[c] for c in docs.columns])


MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM rows GROUP BY source
), filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
), goal AS (
  SELECT source, source_size, weight, least(source_size * 3.0::DOUBLE, weight * (
    SELECT min_by(level, source_size / weight) FROM filled WHERE source_size * 3.0::DOUBLE > weight * level)) AS target FROM sizes
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM goal
), groups AS (
  SELECT source, h, sum(size) AS held,
    sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM rows WHERE size > 0 GROUP BY source, h
), cut AS (
  SELECT g.source, g.h, g.before + g.held <= rest OR (g.before <= rest AND g.before + g.held - rest < rest - g.before) AS take
  FROM groups g JOIN (SELECT *, target - rounds * source_size AS rest FROM budget) b ON g.source IS NOT DISTINCT FROM b.source
)
SELECT r.doc_id, r.size, b.source_size, b.target,
  CASE WHEN r.size = 0 THEN 0 ELSE r.size * (b.rounds + CASE WHEN c.take THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM rows r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source
LEFT JOIN cut c ON c.h = r.h AND c.source IS NOT DISTINCT FROM r.source
"""
