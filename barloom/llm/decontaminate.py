"""Benchmark decontamination with built-in functions only: a broadcast hash set of test n-grams, token windows, verified hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle

#: Distinct test windows that are broadcast (8 bytes of hash each); with more, the windows are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Windows in a piece of text.
PIECE = 32
#: A word is a run of digits, letters of either case and characters beyond U+007F.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def token_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(f"({WORD}+)"))


def _windows(size: Column) -> Column:
    """Hash of each run of ``size`` words of the array ``words``."""
    last = F.size("words") - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(size, F.slice(F.col("words"), i + 1, size)))


def test_windows(bench: DataFrame, item: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """Distinct ``hash, size, gram, item`` of the items' windows: ``n`` words, or all of an item that has fewer."""
    items = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), token_words(F.col(text)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(n)))
    grams = items.select("item", "size", "words", F.posexplode(_windows(F.col("size"))).alias("at", "hash"))
    return grams.select("hash", "size", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("gram"), "item").distinct()


def hits(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """One row per contaminated text: ``key, print, spans (array of at, size), items (sorted array)``.

    Test windows are counted first and broadcast only below :data:`BROADCAST_WINDOWS`; otherwise Spark joins by hash
    with a shuffle, whose skew it splits.  A hash that agrees is checked word for word.  ``print`` is the text's hash,
    so that rows which share a key but not a text stay apart.
    """
    grams = settle(test_windows(bench, item, item_text, n), "windows")
    hashes = grams.select("hash").distinct()
    if hashes.count() <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)
    sizes = [r.size_ for r in grams.select(F.col("size").alias("size_")).distinct().collect()]  # at most n numbers
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if len(sizes) == 1:
        rows = slim.withColumn("size", F.lit(sizes[0]))
    else:
        rows = slim.withColumn("size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")))
    rows = rows.select("key", F.xxhash64("text").alias("print"), token_words(F.col("text")).alias("words"), "size")
    # texts are cut into short overlapping pieces first, so that a row of a window stays small however long its text is
    count = F.ceil((F.size("words") - F.col("size") + 1) / F.lit(PIECE)).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    piece = F.transform(numbers, lambda i: F.slice(F.col("words"), i * PIECE + 1, F.col("size") + PIECE - 1))
    rows = rows.select("key", "print", "size", F.posexplode(piece).alias("piece", "words"))
    found = rows.select("key", "print", "size", "piece", "words", F.posexplode(_windows(F.col("size"))).alias("at", "hash")).join(hashes, "hash")
    gram = F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ")
    found = settle(found.select("key", "print", "hash", "size", (F.col("piece") * PIECE + F.col("at")).alias("at"), gram.alias("gram")), "candidates")
    real = settle(found.join(grams.select("hash", "gram", "size").distinct(), ["hash", "gram", "size"], "left_semi").distinct(), "hits")
    spans = real.groupBy("key", "print").agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    met = real.select("key", "print", "hash", "gram", "size").distinct().join(grams, ["hash", "gram", "size"])
    items = met.groupBy("key", "print").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select(F.col("key").alias("k"), F.col("print").alias("p"), "items")
    both = spans.join(items, spans["key"].eqNullSafe(items["k"]) & (spans["print"] == items["p"]))
    return both.select(F.col("key").alias(key), "print", "spans", "items")


def hit_words(spans: Column) -> Column:
    """Distinct word positions covered by the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))


def _beside(docs: DataFrame, found: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """``docs`` joined with hits of the same key and text; the added columns start with two underscores."""
    named = found.select(F.col(key).alias("__key"), F.col("print").alias("__print"), F.col("spans").alias("__spans"), F.col("items").alias("__items"))
    return docs.join(named, docs[key].eqNullSafe(named["__key"]) & (F.xxhash64(docs[text]) == named["__print"]), how)


def report(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` per row.

    A word inside any occurrence of a test window is hit.  Null and empty texts, and texts without words, have none and
    are clean; items without words never match; an item with a null id counts as item ``null``; repeated items count
    once.  Repeated rows stay repeated.  An empty benchmark leaves all rows clean.
    """
    slim = docs.select(key, text)
    counted = slim.select(F.col(key).alias("k"), F.xxhash64(text).alias("p"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{WORD}+")).cast("long").alias("n_words"))
    found = hits(slim, bench, key, text, **settings)
    rows = counted.join(found, counted["k"].eqNullSafe(found[key]) & (counted["p"] == found["print"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size(hit_words(F.col("spans"))), F.lit(0))
    return rows.select(
        F.col("k").alias(key), "n_words", F.when(F.col("spans").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"),
    )


def drop_documents(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows without any hit, all columns kept."""
    return _beside(docs, hits(docs, bench, key, text, **settings), key, text, "left_anti")


def drop_spans(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """All rows; hit words go from the text, each with the other characters that follow it up to the next word."""
    rows = _beside(docs, hits(docs, bench, key, text, **settings), key, text, "left")
    gap = WORD.replace("[^", "[")
    lead = F.regexp_extract(docs[text], f"^({gap}*)", 1)
    parts = F.regexp_extract_all(docs[text], F.lit(f"({WORD}+{gap}*)"))
    hit = hit_words(F.col("__spans"))
    left = F.array_join(F.filter(parts, lambda part, i: ~F.array_contains(hit, i)), "")
    cleaned = F.when(F.col("__spans").isNull(), docs[text]).otherwise(F.concat(lead, left))
    return rows.select(*[cleaned.alias(c) if c == text else docs[c] for c in docs.columns])


REPORT_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i : i + least(len(w), 10) - 1] AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), found AS (
  SELECT doc_id, i, size, item_id FROM (
    SELECT doc_id, i, w[i : i + s.size - 1] AS g, s.size FROM (SELECT DISTINCT size FROM grams) s, (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM texts) t WHERE i + s.size - 1 <= len(w)
  ) JOIN grams USING (g, size)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
