"""Language-model scores of whole texts: a self-attention model on subword ids, beside a word-count baseline.

Texts are dealt into blocks.  A block asks for its different words only: their counts over all training texts, subword
ids and tree probabilities come from one table of all words, joined by block and not by occurrence.  The tree tells how
often training words that begin with some ids go on with another id or end, and falls back on what follows an id
anywhere; so all training texts are counted.  The network learns from all of them too: each block trains from shared
weights on its whole training texts, and the results are averaged by the number of ids they were trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import attention
from barloom.llm.common import drop_tables, settle, shuffled_join
from barloom.llm.subwords import encoder, pieces

#: Characters of text in a block.
BLOCK_CHARS = 4 << 20
#: Bounds of the network: common ids it tells apart, first ids that are classes of their own, clusters of the others,
#: width, window, ids scored by each window after the first.
COMMON, SINGLE, CLUSTERS, WIDTH, WINDOW, STRIDE = 1024, 96, 32, 32, 32, 24
#: Blocks whose averaged weights all blocks start from; epochs and rate of that round, and of the round over all.
STARTERS, FIRST_ROUND, FULL_ROUND = 4, (2, 0.005), (1, 0.002)
#: Averages are sums of whole numbers of this fraction, so that their order does not matter.
FINE = 1 << 20
END = 1


def held_out(key) -> F.Column:
    """True for rows whose crc32 of the key as text is divisible by 10; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def split_words(texts):
    """Words of an Arrow string column with A-Z lowered: different words, an index per occurrence, row bounds."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    real = np.asarray(pc.binary_length(flat), dtype=np.int64) > 0
    if not real.all():
        flat = flat.filter(pa.array(real))
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64) if len(flat) else np.zeros(0, np.int64), bounds


def _hashes(words: list[str]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)


def _blocks(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """``key, text, train, block`` and the number of blocks."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (~held_out(F.col(key))).alias("train"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_CHARS
    return rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int")), blocks


def _together(rows: DataFrame, answers: DataFrame, blocks: int):
    """Each block's texts with its answers, in as many tasks as there are ``blocks``; with more, shuffle files compress less."""
    tasks = max(blocks, 32)
    texts, table = (d.repartition(tasks, "block").groupBy("block") for d in (rows, answers))
    return texts.cogroup(table)


def _asked(rows: DataFrame) -> DataFrame:
    """``block, hash, word, n``: each block's different words with their counts in training texts; the end is ''."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        words, index, bounds = split_words(group.column("text"))
        train = np.asarray(group.column("train").combine_chunks() if hasattr(group.column("train"), "combine_chunks") else group.column("train"))
        told = np.repeat(train, np.diff(bounds))
        counts = np.bincount(index[told], minlength=len(words))
        n = len(words) + 1
        columns = [pa.array(np.full(n, group.column("block")[0].as_py(), np.int32)), pa.array(_hashes([*words, ""])), pa.array([*words, ""], pa.string()), pa.array(np.append(counts, train.sum()).astype(np.int64))]
        return pa.Table.from_arrays(columns, names=["block", "hash", "word", "n"])

    return rows.groupBy("block").applyInArrow(run, "block int, hash long, word string, n long")


def _encoded(words: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``ids`` (16- or 32-bit little-endian) to the table of all words; the end of a text is id 1."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        coder = encoder(tokenizer)
        for batch in batches:
            words = batch.column(1).to_pylist()
            ids = coder.word_ids(words)
            ids = [np.array([END], "<u4").tobytes() if w == "" else i for w, i in zip(words, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary())], names=["hash", "c", "ids"])

    return words.mapInArrow(run, "hash long, c long, ids binary")


def _pairs(words: DataFrame) -> DataFrame:
    """``a, b, c``: how often id ``b`` follows ``a`` inside words of training texts; -1 is a word's boundary."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw, c = batch.column(2).to_pylist(), np.asarray(batch.column(1), dtype=np.int64)
            size = np.fromiter((len(i) >> 2 for i in raw), dtype=np.int64, count=len(raw))
            ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
            # boundaries before and after each word: -1, ids, -1
            ends = np.cumsum(size)
            framed = np.insert(ids, np.concatenate([ends - size, ends]), -1)
            weight = np.repeat(c, size + 2)
            last = np.cumsum(size + 2) - 1
            keep = np.ones(len(framed), bool)
            keep[last] = False
            at = np.flatnonzero(keep)
            pair = (framed[at] + 1) * (1 << 32) + framed[at + 1] + 1
            both, where = np.unique(pair, return_inverse=True)
            total = np.bincount(where, weight[at], minlength=len(both)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((both >> 32).astype(np.int32) - 1), pa.array((both & 0xFFFFFFFF).astype(np.int32) - 1), pa.array(total)], names=["a", "b", "c"])

    made = words.filter("c > 0").select("hash", "c", "ids").mapInArrow(run, "a int, b int, c long")
    return made.groupBy("a", "b").agg(F.sum("c").alias("c"))


def _vocabulary(pairs: DataFrame, size: int) -> attention.Vocabulary:
    """Counts of at most ``size`` ids and of pairs of the common ones, on the driver."""
    import numpy as np

    counts, first = np.zeros(size), np.zeros(size)
    seen = pairs.filter("b >= 0").groupBy("b").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("a") < 0, F.col("c")).otherwise(0)).alias("f")).toPandas()
    counts[seen["b"].to_numpy()], first[seen["b"].to_numpy()] = seen["c"].to_numpy(), seen["f"].to_numpy()
    order = np.argsort(-counts, kind="stable")[:COMMON]
    places = pairs.sparkSession.createDataFrame([(int(i), n) for n, i in enumerate(order)] + [(-1, COMMON + 1)], "id int, place int")
    one = places.select(F.col("id").alias("a"), F.col("place").alias("x"))
    two = places.select(F.col("id").alias("b"), F.col("place").alias("y"))
    rest = F.lit(COMMON)
    held = pairs.join(F.broadcast(one), "a", "left").join(F.broadcast(two), "b", "left")
    held = held.groupBy(F.coalesce("x", rest).alias("x"), F.coalesce("y", rest).alias("y")).agg(F.sum("c").alias("c")).toPandas()
    table = np.zeros((COMMON + 2, COMMON + 2))
    table[held["x"].to_numpy(), held["y"].to_numpy()] = held["c"].to_numpy()
    return attention.Vocabulary.from_counts(counts, first, table, order, SINGLE, CLUSTERS)


def _treed(words: DataFrame, vocabulary: attention.Vocabulary, total: int) -> DataFrame:
    """``hash, c, ids, tree``: log probability of each id after those before it in the word, then of the word's end.

    What follows an id anywhere weighs as much as there are different ways on from this beginning (Witten and Bell).
    """
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)
    # words without ids (of signs that the tokenizer drops) end at their boundary; all of them share one share of the root
    bare = words.filter(F.length("ids") < 4).agg(F.sum("c")).first()[0] or 0
    steps = F.sequence(F.lit(1), (F.length("ids") / 4).cast("int"))
    begun = words.filter(F.length("ids") >= 4).select("hash", "c", F.explode(steps).alias("k"), "ids")
    begun = begun.select("hash", "c", "k", F.xxhash64(F.expr("substring(ids, 1, 4 * k)")).alias("begin"), F.xxhash64(F.expr("substring(ids, 1, 4 * k - 4)")).alias("parent"))
    sums = settle(begun.groupBy("begin").agg(F.sum("c").alias("held"), F.min("parent").alias("parent")), "beginnings")
    kinds = sums.filter("held > 0").groupBy("parent").agg(F.count("*").alias("kinds"), F.sum("held").alias("longer")).withColumnRenamed("parent", "begin")
    root = kinds.filter(F.col("begin") == F.xxhash64(F.lit(b""))).first()
    root_kinds = (root.kinds if root else 0) + (bare > 0) or 1
    idle = (bare + 0.1) / (total + 0.1 * (len(vocabulary.begins) + 1))
    # different ways to go on, the word's end among them where it was seen
    ways = F.greatest(F.coalesce("kinds", F.lit(0)) + (F.col("held") > F.coalesce("longer", F.lit(0))).cast("int"), F.lit(1))
    known = shuffled_join(sums, kinds, "begin", "left").select("begin", "held", ways.alias("ways"))
    path = shuffled_join(begun.select("hash", "k", "begin"), known, "begin").groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("k", "held", "ways"))).alias("path"))
    none = F.array().cast("array<bigint>")
    joined = shuffled_join(words, path.select("hash", F.col("path.held").alias("held"), F.col("path.ways").cast("array<bigint>").alias("ways")), "hash", "left")
    joined = joined.select("hash", "c", "ids", F.coalesce("held", none).alias("held"), F.coalesce("ways", none).alias("ways"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        v = shared.value
        for batch in batches:
            raw, c = batch.column(2).to_pylist(), np.asarray(batch.column(1), dtype=np.float64)
            size = np.fromiter((len(i) >> 2 for i in raw), dtype=np.int64, count=len(raw))
            ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
            held = np.asarray(batch.column(3).flatten(), dtype=np.float64)
            ends = np.cumsum(size)
            real = size > 0
            begin, last = (ends - size)[real], ends[real] - 1
            place = v.common[ids]
            general = np.zeros(len(ids))
            general[1:] = np.exp(v.inside[place[:-1], place[1:]] + v.rest[ids[1:]])
            general[begin] = v.begins[ids[begin]] * (1 - idle)
            ways = np.asarray(batch.column(4).flatten(), dtype=np.float64)
            before, open_ = np.zeros(len(ids)), np.zeros(len(ids))
            before[1:], open_[1:] = held[:-1], ways[:-1]
            before[begin], open_[begin] = total, root_kinds
            go = np.log((held + open_ * general) / (before + open_))
            stop = np.log((c + root_kinds * idle) / (total + root_kinds))
            stop[real] = np.log((c[real] + ways[last] * np.exp(v.inside[place[last], v.size + 1])) / (held[last] + ways[last]))
            tree = np.insert(go, ends, stop).astype("<f4")
            cuts = np.cumsum(size + 1) * 4
            data = tree.tobytes()
            parts = [data[i:j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(parts, pa.binary())], names=["hash", "c", "ids", "tree"])

    treed = joined.mapInArrow(run, "hash long, c long, ids binary, tree binary")
    treed.sources = (sums,)
    return treed


def _joined(values):
    """Offsets and bytes of binary values, an Arrow array or a list."""
    import numpy as np
    import pyarrow as pa

    values = pa.array(values, pa.binary()) if isinstance(values, list) else values
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return offsets - offsets[0], memoryview(values.buffers()[2] or b"")[offsets[0] : offsets[-1]]


def _flat(words: list[int], bounds, ids, tree):
    """Rows of word numbers, each followed by the end (the last of ``ids``), as ids, tree values, first marks and bounds.

    The end of a word is told in the state before the next id of its row, of which ``closing`` holds the tree's value; the
    values of other ends, of words without ids and behind the last id of a row, are given by word.
    """
    import numpy as np

    (cuts, ids), (_, tree) = _joined(ids), _joined(tree)
    index = np.insert(words, bounds[1:], len(cuts) - 2)
    bounds = bounds + np.arange(len(bounds))
    size, begin = np.diff(cuts) >> 2, cuts[:-1] >> 2
    stock, values = np.frombuffer(ids, "<u4").astype(np.int32), np.frombuffer(tree, "<f4")
    # a word's end is counted with its last id
    ends = begin + np.arange(len(size)) + size
    stop, go = values[ends], np.delete(values, ends)
    length = size[index]
    done = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(begin[index] - done[:-1], length) + np.arange(done[-1])
    first = np.zeros(done[-1], bool)
    first[done[:-1]] = True
    cuts, stop, closing = done[bounds], stop[index], np.full(done[-1] + 1, np.nan, np.float32)
    told = length > 0
    told[bounds[1:] - 1] = False
    closing[done[1:][told]] = stop[told]
    return stock[at], go[at], np.where(told, 0, stop), first, cuts, index, bounds, closing[:-1]


def _looked_up(table):
    """Sorted hashes of a block's words, with the words' counts, ids and tree values."""
    import numpy as np
    import pyarrow as pa

    hashes = np.asarray(table.column("hash").combine_chunks())
    order = np.argsort(hashes)
    ids, tree = (table.column(c).combine_chunks().take(pa.array(order)) for c in ("ids", "tree"))
    return hashes[order], np.asarray(table.column("c").combine_chunks())[order], ids, tree


def _round(rows: DataFrame, answers: DataFrame, blocks: int, vocabulary: attention.Vocabulary, weights: dict, epochs: int, rate: float) -> tuple[dict, int]:
    """Weights after each block has trained from ``weights`` on all of its training texts, averaged by first ids seen, and these ids' number."""
    import numpy as np

    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(texts, table):
        import numpy as np
        import pyarrow as pa

        vocabulary, weights = shared.value
        texts = texts.filter(texts.column("train").combine_chunks())
        n, sums = 0, np.zeros(0, np.int64)
        if texts.num_rows:
            hashes, _, ids, tree = _looked_up(table)
            words, index, bounds = split_words(texts.column("text").combine_chunks())
            place = pa.array(np.searchsorted(hashes, _hashes([*words, ""])))
            flat, go, _, first, cuts, _, _, closing = _flat(index, bounds, ids.take(place), tree.take(place))
            made = attention.train({k: w.copy() for k, w in weights.items()}, vocabulary, flat, go, first, cuts[:-1], cuts[1:], epochs, rate, closing=closing)
            n = int(first.sum())
            sums = np.round(np.concatenate([made[k].ravel() for k in weights]).astype("f8") * FINE).astype(np.int64) * n
        return pa.table({"n": pa.array([n], pa.int64()), "sums": pa.array([sums.tobytes()], pa.binary())})

    def added(batches):
        import numpy as np
        import pyarrow as pa

        n, sums = 0, None
        for batch in batches:
            for m, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if m:
                    n, sums = n + m, np.frombuffer(raw, np.int64) + (0 if sums is None else sums)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])

    kind = "n long, sums binary"
    parts = _together(rows, answers, blocks).applyInArrow(run, kind).mapInArrow(added, kind)
    # one sum a task, then one of each sixteenth of the tasks, so that the driver gets few at any size
    parts = settle(parts.withColumn("part", F.spark_partition_id()), "sums")
    made, parts = parts, parts.repartition(16, "part").select("n", "sums").mapInArrow(added, kind).collect()
    drop_tables(made)
    n = sum(r.n for r in parts)
    if not n:
        return weights, 0
    total, at, out = sum(np.frombuffer(r.sums, np.int64) for r in parts) / (n * FINE), 0, {}
    for k, w in weights.items():
        out[k] = total[at : at + w.size].reshape(w.shape).astype("f4")
        at += w.size
    return out, n


def _fitted(rows: DataFrame, answers: DataFrame, blocks: int, vocabulary: attention.Vocabulary) -> dict:
    """Weights from every training text in whole length, after a first round over a few blocks."""
    weights, few = attention.fresh(vocabulary, WIDTH, WINDOW), F.col("block") < STARTERS
    weights, _ = _round(rows.filter(few), answers.filter(few), min(blocks, STARTERS), vocabulary, weights, *FIRST_ROUND)
    return _round(rows, answers, blocks, vocabulary, weights, *FULL_ROUND)[0]


def score(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Null and empty texts have one token, the end.  With no training texts every count is 0 and both models are uniform
    or nearly so.  Repeated rows stay repeated, and count in training as often as they occur; a null key is held out.
    Other columns are not read, whatever their names.  An empty table gives no rows.
    """
    rows, blocks = _blocks(docs, key, text)
    asked = settle(_asked(rows), "asked")
    words = settle(asked.groupBy("hash").agg(F.min("word").alias("word"), F.sum("n").alias("c")), "words")
    plain, words = words, settle(_encoded(words, tokenizer), "encoded")
    drop_tables(plain)
    row = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    total, different = row[0] or 0, row[1] or 0
    pairs = settle(_pairs(words), "pairs")
    vocabulary = _vocabulary(pairs, encoder(tokenizer).vocabulary)
    coded, treed = words, _treed(words, vocabulary, total)
    words = settle(treed, "tree")
    drop_tables(pairs, coded, *treed.sources)
    answers = settle(shuffled_join(asked.select("block", "hash"), words, "hash"), "answers")
    drop_tables(asked, words)
    weights = _fitted(rows, answers, blocks, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(texts, table):
        import numpy as np
        import pyarrow as pa

        vocabulary, weights = shared.value
        kind = schema_type(pa, texts)
        if texts.num_rows == 0:
            return pa.Table.from_arrays([pa.array([], t) for t in kind], names=names)
        hashes, counts, ids, tree = _looked_up(table)
        out = []
        column = texts.column("text").combine_chunks()
        for a, b in pieces(column, 1 << 20):
            words, index, bounds = split_words(column.slice(a, b - a))
            place = np.searchsorted(hashes, _hashes([*words, ""]))
            c = counts[place]
            value = np.log10((c + 0.1) / (total + 0.1 * (different + 1)))
            place = pa.array(place)
            flat, go, stop, first, cuts, index, bounds, closing = _flat(index, bounds, ids.take(place), tree.take(place))
            logs = attention.log_probabilities(weights, vocabulary, flat, go, first, cuts[:-1], cuts[1:], STRIDE, closing=closing)
            known, base, ended = (np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.float64)])[bounds]) for v in (c[index] > 0, value[index], stop))
            made = np.diff(np.concatenate([[0], np.cumsum(logs)])[cuts]) + ended
            out.append((np.diff(bounds), known, base, made / np.log(10)))
        n_tokens, known, base, made = (np.concatenate(c) for c in zip(*out))
        columns = [
            texts.column("key").combine_chunks(), pa.array(~np.asarray(texts.column("train").combine_chunks())), pa.array(n_tokens), pa.array(known.astype(np.int64)),
            pa.array(np.full(len(base), total, np.int64)), pa.array(base), pa.array(made),
        ]
        return pa.Table.from_arrays(columns, names=names)

    def schema_type(pa, texts):
        return [texts.schema.field("key").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields)
    names = schema.names
    return _together(rows, answers, blocks).applyInArrow(run, schema)

