"""Substring dedup by seed and extend: winnowed anchors join documents, matches grow both ways into maximal repeats.

A window is ``length`` consecutive words.  Each window's anchor is the ``gram``-word run of smallest hash inside it, so
equal windows have equal anchors at equal places.  Anchors that occur once seed nothing.  Around the others a match is
extended both ways by hashing each window the anchor stands for; a window seen earlier is a repeat, and windows that
touch merge into maximal repeats.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import settle, shuffles_dropped, words
from barloom.session import work_dir

#: Anchors with more occurrences are compared through minima per window with partial sums instead of sorting a group.
HOT_ANCHOR = 256


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes, n: int):
    """64-bit hashes of all runs of ``n`` word hashes, built from runs of powers of two."""
    import numpy as np

    if len(hashes) < n:
        return hashes[:0]
    odd, total, block, size, done = np.uint64(0x9E3779B97F4A7C15), None, hashes, 1, 0
    while size <= n:
        if n & size:
            total = block if total is None else _mix(total[: len(block) - done] * odd + block[done:])
            done += size
        if 2 * size <= n:
            block = _mix(block[:-size] * odd + block[size:])
        size *= 2
    return total[: len(hashes) - n + 1]


def word_hashes(tokens: list[bytes]):
    """XXH64 of each word."""
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def anchors(hashes, length: int, gram: int):
    """For each window its anchor's place: the last smallest gram hash inside; and the gram hashes."""
    import numpy as np

    grams, span = gram_hashes(hashes, gram), length - gram + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), grams
    views = np.lib.stride_tricks.sliding_window_view(grams, span)[:, ::-1]
    at = np.concatenate([views[i : i + 65536].argmin(axis=1) for i in range(0, len(views), 65536)])
    return np.arange(len(views)) + span - 1 - at, grams


def _texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``key, print, row``, and the texts once, bucketed by row so that later joins move no text."""
    spark, rows = docs.sparkSession, docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("print", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = rows.withColumn("row", F.xxhash64("key", "print"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_dir(spark, "texts")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with shuffles_dropped(spark):
        writer = rows.repartition(buckets, "row").write.bucketBy(buckets, "row").option("compression", "zstd")
        writer.saveAsTable(name, format="parquet", path=path)
    texts = spark.table(name)
    return settle(texts.select("key", "print", "row"), "rows"), texts


def _first_rows(rows: DataFrame) -> DataFrame:
    """One row per different text, the first in key order (null last), with its rank ``ord`` among all texts."""
    least = rows.groupBy("print").agg(F.min(F.struct(F.col("key").isNull().alias("no_key"), "key")).alias("m"))
    first = least.select("m.key", "print", F.xxhash64("m.key", "print").alias("row"))
    order = first.repartitionByRange(F.col("key").asc_nulls_last(), "print").sortWithinPartitions(F.col("key").asc_nulls_last(), "print")
    return settle(order.withColumn("ord", F.monotonically_increasing_id()), "first")


def _per_text(texts: DataFrame, first: DataFrame, more: DataFrame | None, fn, schema) -> DataFrame:
    """``fn(rows)`` over ``ord, text[, extra]`` of each different text once; ``more`` is ``ord, extra``."""
    picked = first.select(F.col("row").alias("r"), F.col("key").alias("k"), F.col("print").alias("p"), "ord")
    if more is not None:
        picked = picked.join(more, "ord")
    same = (texts["row"] == picked["r"]) & texts["key"].eqNullSafe(picked["k"]) & (texts["print"] == picked["p"])
    extra = [c for c in (more.columns if more is not None else []) if c != "ord"]
    joined = texts.join(picked, same).select("ord", "text", *extra).sortWithinPartitions("ord")

    def run(batches):
        import pyarrow as pa

        last, held, size = None, [], 0
        for batch in batches:
            for values in zip(*(batch.column(i) for i in range(batch.num_columns))):
                ord_ = values[0].as_py()
                if ord_ == last:  # a repeated row
                    continue
                last = ord_
                out = fn(ord_, values[1].as_py(), *(v.as_py() for v in values[2:]))
                held += out
                size += len(out)
                if size >= 8192:
                    yield table(pa, held)
                    held, size = [], 0
        yield table(pa, held)

    def table(pa, held):
        columns = list(zip(*held)) if held else [[] for _ in schema.names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds(pa))], names=schema.names)

    def kinds(pa):
        from pyspark.sql.pandas.types import to_arrow_type

        return [to_arrow_type(f.dataType) for f in schema]

    return joined.mapInArrow(run, schema)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 20, gram: int = 8) -> DataFrame:
    """One row per input row: ``key, n_words, n_removed, spans, kept, kept_sha256``.

    A word goes if a window over it also starts earlier: in a row of smaller key (null keys come last, equal keys by
    text hash) or earlier in the same text.  ``spans`` are the maximal runs of removed words (``from``, ``to`` in word
    numbers), ``kept`` the other words joined by one space.  Rows of one text are compared once: the copies of a text
    of ``length`` words or more go wholly, shorter ones stay whole.  Rows that share key and text are one document and
    all get its result.  Null and empty texts have no words.  An empty table gives no rows.
    """
    if not 0 < gram < length:
        raise ValueError("gram lies between 0 and length")
    rows, texts = _texts(docs, key, text)
    first = _first_rows(rows)

    def seeds(ord_, text):
        hashes = word_hashes(words(text))
        at, grams = anchors(hashes, length, gram)
        if not len(at):
            return []
        import numpy as np

        place = np.unique(at)
        return list(zip(grams[place].view(np.int64).tolist(), [ord_] * len(place), place.tolist()))

    fields = {"anchor": T.LongType(), "ord": T.LongType(), "at": T.IntegerType()}
    seeded = settle(_per_text(texts, first, None, seeds, T.StructType([T.StructField(*f) for f in fields.items()])), "seeds")
    # written first: a join that reads both sides from shuffles of its own is one whose large keys Spark splits
    counts = settle(seeded.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    spots = seeded.join(counts, "anchor").select("ord", F.struct("at", (F.col("n") > HOT_ANCHOR).alias("hot")).alias("spot"))
    spots = settle(spots.groupBy("ord").agg(F.collect_list("spot").alias("spots")), "spots")

    def extend(ord_, text, spots):
        import numpy as np

        hashes = word_hashes(words(text))
        at, grams = anchors(hashes, length, gram)
        runs = gram_hashes(hashes, length).view(np.int64)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        ends = dict(zip(at[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(at)])))
        out = []
        for spot in spots:
            i, j = ends[spot["at"]]
            out.append((int(grams[spot["at"]].view(np.int64)), ord_, i, runs[i:j].tolist(), spot["hot"]))
        return out

    fields = {"anchor": T.LongType(), "ord": T.LongType(), "start": T.IntegerType(), "hashes": T.ArrayType(T.LongType()), "hot": T.BooleanType()}
    grown = settle(_per_text(texts, first, spots, extend, T.StructType([T.StructField(*f) for f in fields.items()])), "grown")

    def windows(part):
        each = part.select("anchor", "ord", "start", F.posexplode("hashes").alias("i", "hash"))
        return each.select("anchor", "hash", "ord", (F.col("start") + F.col("i")).alias("at"))

    order = Window.partitionBy("anchor", "hash").orderBy("ord", "at")
    cold = windows(grown.filter("NOT hot").repartition("anchor")).withColumn("n", F.row_number().over(order)).filter("n > 1").select("ord", "at")
    hot = windows(grown.filter("hot"))
    least = settle(hot.groupBy("anchor", "hash").agg(F.min(F.struct("ord", "at")).alias("m"), F.count("*").alias("n")).filter("n > 1"), "earliest")
    hot = hot.join(least, ["anchor", "hash"]).filter(F.struct("ord", "at") > F.col("m")).select("ord", "at")
    starts = cold.union(hot).groupBy("ord").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    starts = settle(starts, "starts")
    told = first.select("ord").join(starts, "ord", "left")

    def cut(ord_, text, starts):
        import numpy as np

        tokens = words(text)
        edges = np.zeros(len(tokens) + 1, dtype=np.int64)
        if starts:
            np.add.at(edges, np.array(starts), 1)
            np.add.at(edges, np.array(starts) + length, -1)
        gone = np.cumsum(edges)[: len(tokens)] > 0
        turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
        kept = b" ".join(w for w, g in zip(tokens, gone.tolist()) if not g)
        spans = [{"from": a, "to": b} for a, b in zip(turns[::2], turns[1::2])]
        return [(ord_, len(tokens), int(gone.sum()), spans, kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest())]

    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    fields = {"ord": T.LongType(), "n_words": T.LongType(), "n_removed": T.LongType(), "spans": T.ArrayType(span), "kept": T.StringType(), "kept_sha256": T.StringType()}
    done = _per_text(texts, first, told, cut, T.StructType([T.StructField(*f) for f in fields.items()]))
    done = done.join(first.select("ord", F.col("key").alias("k"), F.col("print").alias("p")), "ord").drop("ord")
    joined = rows.join(done, rows["print"] == done["p"])
    copy = ~F.col("key").eqNullSafe(F.col("k")) & (F.col("n_words") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to")))
    return joined.select(
        F.col("key").alias(key), "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"), F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
