"""Near duplicates by 64-bit SimHash: segment popcounts as a grid, Manhattan distance as the lower bound, exact check.

Two fingerprints that differ in ``d`` bits have segment popcounts at Manhattan distance ``d`` at most.  Each distinct
fingerprint is therefore put into the grid cell of its popcounts and into the cells one step away; any two within two
bits meet in a cell, which makes the range join an equi-join.  The candidates are then compared bit by bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import join_copies, settle, shuffled_join, spread, words
from barloom.llm.graph import components

#: Cells with more distinct fingerprints than this are linked through exact one-bit neighbours instead of pairs.
PAIRED_CELL = 64
_CHUNK = 1 << 17


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of lower-cased (A-Z) word shingles as a signed 64-bit number; no words give 0."""
    import numpy as np
    import xxhash

    tokens = [w.lower() for w in words(text)]
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[shingle - 1 :] if len(tokens) >= shingle else ends[-1:]
    counts, total, digest = np.zeros(64, dtype=np.int64), len(last), xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), last[at : at + _CHUNK].tolist())
        hashes = np.array([digest(joined[i:j], 42) for i, j in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fp`` per row; null and empty texts have fingerprint 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=[key, "fp"])

    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])
    return spread(docs.select(key, text), key).mapInArrow(run, schema)


def popcount_cell(fp, width: int = 2):
    """Bit counts of ``width``-bit segments, each in its own segment of a long."""
    if width not in (2, 4, 8):
        raise ValueError("width is 2, 4 or 8")

    def mask(pattern):
        return F.lit(int.from_bytes(pattern.to_bytes(8, "big"), "big", signed=True))

    low, high = fp.bitwiseAND(mask(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(mask(0x5555555555555555))
    cell = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    if width >= 4:
        cell = cell.bitwiseAND(mask(0x3333333333333333)) + F.shiftrightunsigned(cell, 2).bitwiseAND(mask(0x3333333333333333))
    if width == 8:
        cell = cell.bitwiseAND(mask(0x0F0F0F0F0F0F0F0F)) + F.shiftrightunsigned(cell, 4).bitwiseAND(mask(0x0F0F0F0F0F0F0F0F))
    return cell


def _one_step(cell: str, width: int) -> str:
    field = f"(shiftrightunsigned({cell}, s * {width}) & {(1 << width) - 1}L)"
    segments = f"sequence(0, {64 // width - 1})"
    up = f"transform(filter({segments}, s -> {field} < {width}), s -> {cell} ^ shiftleft({field} ^ ({field} + 1L), s * {width}))"
    down = f"transform(filter({segments}, s -> {field} > 0), s -> {cell} ^ shiftleft({field} ^ ({field} - 1L), s * {width}))"
    return f"concat(array({cell}), {up}, {down})"


def links(prints: DataFrame, max_bits: int = 2, width: int = 2) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column ``fp``) that connect all within ``max_bits`` of each other.

    ``max_bits`` is 1 or 2: the cells one step away are listed on both sides.  Cells with few fingerprints give all
    pairs that hold; a cell with many gives a star around each exact one-bit neighbour instead, whose members all lie
    within two bits of each other, so that the same components come from linear output (with one bit allowed, the star
    runs from each fingerprint to those one bit away).
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    # each short row becomes some 60: a stated number of partitions is not coalesced, however few bytes there are
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = prints.select("fp").filter("fp IS NOT NULL").distinct().repartition(parts, "fp").withColumn("at", popcount_cell(F.col("fp"), width))
    cells = cells.select("fp", F.explode(F.expr(_one_step("at", width))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    met = settle(shuffled_join(cells, shared, "cell"), "cells")
    few, many = met.filter(F.col("n") <= PAIRED_CELL), met.filter(F.col("n") > PAIRED_CELL).select("fp").distinct()
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    left, right = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    pairs = shuffled_join(left, right, (left["cell"] == right["cell"]) & near).select("a", "b")
    flips = F.expr("transform(sequence(0, 63), s -> fp ^ shiftleft(1L, s))")
    hubs = many.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("hub"))
    if max_bits == 1:
        stars = shuffled_join(hubs, many.select(F.col("fp").alias("hub")), "hub").filter("fp != hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    else:
        first = hubs.groupBy("hub").agg(F.min("fp").alias("first"), F.count("*").alias("n")).filter("n > 1")
        stars = shuffled_join(hubs, first, "hub").filter("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2, width: int = 2) -> DataFrame:
    """One row per input row: ``key``, ``fp`` and ``component_id``, the smallest key reachable over links.

    Rows with equal fingerprints are one node, so copies are counted and never paired.  Null and empty texts share
    fingerprint 0 and are linked like any other.  Repeated rows stay repeated.  A null key is never the smallest unless
    its component has no other (then ``component_id`` is null).  Other columns are not read, whatever their names.
    """
    prints = settle(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(nodes, max_bits, width)).withColumnRenamed("node", "fp")
    linked = shuffled_join(nodes, roots, "fp")
    found = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = join_copies(roots, found, "root").select("fp", "component_id")
    ids = settle(shuffled_join(nodes, found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "ids")
    return join_copies(prints, ids, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Only the row with the smallest key of each component, all columns kept, whatever their names.

    Rows of one key are told apart by their texts; of rows that share key and text every one stays if one does.  Rows
    with a null key stay only if their component has no other key.  An empty table gives no rows.
    """
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), mark.alias("print")).alias("__row"), F.col(text).alias("__text"))
    found = near_duplicates(rows, "__row", "__text", **settings).filter(F.col("__row") == F.col("component_id"))
    kept = found.select(F.col("__row.key").alias("__key"), F.col("__row.print").alias("__print")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["__key"]) & (mark == kept["__print"]), "left_semi")


def hex_print(fp):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
