"""Token ids as length-delimited binary records with a separate offset index.

A record is: payload length (unsigned, 8 bytes, little-endian), its masked checksum (4 bytes), the payload, the
payload's masked checksum (4 bytes).  The payload is the ids as little-endian unsigned numbers, of 16 bits where the
vocabulary allows (the index names the width), else of 32.  A mask turns the CRC-32 by 15 bits and adds a constant, so
that records may themselves hold checksums.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import by_file, file_system, settle, shared_files
from barloom.llm.subwords import encoder, pieces

#: Fixed value of the record format.
MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")


def masked(data: bytes) -> int:
    """Masked CRC-32."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    size = struct.pack("<Q", len(payload))
    return size + _TAIL.pack(masked(size)) + payload + _TAIL.pack(masked(payload))


def unframe(stream) -> bytes | None:
    """The next record's payload, None at the end; a cut or damaged record raises."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("record cut in its head")
    size, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("length checksum differs")
    payload, tail = stream.read(size), stream.read(_TAIL.size)
    if len(payload) < size or len(tail) < _TAIL.size:
        raise ValueError("record cut in its payload")
    if masked(payload) != _TAIL.unpack(tail)[0]:
        raise ValueError("payload checksum differs")
    return payload


def write_records(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """Write the shards and return the committed index: ``key, shard, part, ordinal, offset, bytes, n_tokens, width``.

    Rows are dealt into ranges of the key, so shards are in key order and each is sorted; every task writes one file of
    its own name, and only files of tasks that Spark committed are in the index.  Null keys come first, rows of equal
    keys follow their text's hash; null texts are empty (the end id alone); empty tables have no shards.
    """

    def write(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, coder, stream, at, ordinal = TaskContext.get().partitionId(), encoder(tokenizer), None, 0, 0
        width = 2 if max(coder.vocabulary, end + 1) <= 1 << 16 else 4
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex[:12]}.rec"
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                if stream is None:
                    system, place = file_system(path)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    stream = system.open_output_stream(place, compression=None)
                ids, rows = coder.encode(batch.column(1).slice(a, b - a), end)
                ids = ids.astype(f"<u{width}")
                frames = [frame(ids[i:j].tobytes()) for i, j in zip(rows[:-1], rows[1:])]
                sizes = np.fromiter(map(len, frames), dtype=np.int64, count=len(frames))
                stream.write(b"".join(frames))
                n = len(frames)
                columns = [
                    batch.column(0).slice(a, n), pa.array([path] * n), pa.array(np.full(n, part)), pa.array(np.arange(ordinal, ordinal + n)),
                    pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(np.diff(rows)), pa.array(np.full(n, width)),
                ]
                at, ordinal = at + int(sizes.sum()), ordinal + n
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if stream is not None:
            stream.close()

    schema = T.StructType(
        [docs.schema[key], T.StructField("shard", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("part", "ordinal", "offset", "bytes", "n_tokens", "width")]
    )
    names = schema.names
    rows = docs.select(F.col(key), F.col(text)).repartitionByRange(F.col(key).asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))
    return settle(rows.mapInArrow(write, schema), "index")


def read_records(index: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Read records by the index: ``key, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all records before in key order, from the files' own lengths.  Checksums are verified;
    damage raises.  Each shard is read front to back by one task.
    """

    def read(batches):
        import numpy as np
        import pyarrow as pa

        shard, stream, seen = None, None, 0
        for batch in batches:
            out = []
            for k, path, offset, part, width in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if path != shard:
                    if stream is not None:
                        stream.close()
                    system, place = file_system(path)
                    shard, stream, seen = path, system.open_input_file(place), 0
                if stream.tell() != offset:
                    stream.seek(offset)
                payload = unframe(stream)
                if payload is None:
                    raise ValueError("record missing")
                ids = np.frombuffer(payload, dtype=f"<u{width}")
                out.append((k, part, seen, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids))
                seen += len(ids)
                if len(out) >= 512:
                    yield pack(pa, out, batch.schema.field(0).type)
                    out = []
            yield pack(pa, out, batch.schema.field(0).type)
        if stream is not None:
            stream.close()

    def pack(pa, out, kind):
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate([kind] + [pa.int64()] * 4)]
        if with_ids:
            columns.append(pa.array([r[5].astype("i8") for r in out], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    fields = [index.schema[key]] + [T.StructField(c, T.LongType()) for c in ("part", "seen", "n_tokens", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)
    shards = index.select("part").distinct().count()
    rows = by_file(index.select(key, "shard", "offset", "part", "width"), "part", shards).sortWithinPartitions("part", "offset")
    found = rows.mapInArrow(read, schema)
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    found = found.join(base, "part").withColumn("start", F.col("base") + F.col("seen"))
    return found.select(key, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_shuffled(index: DataFrame, seed: int, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Records in a seeded random order, fetched one by one through the offset index: ``key, ids``."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        opened: dict[str, object] = {}
        for batch in batches:
            ids = []
            for path, offset, width in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if path not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    system, place = file_system(path)
                    opened[path] = system.open_input_file(place)
                opened[path].seek(offset)
                ids.append(np.frombuffer(unframe(opened[path]), dtype=f"<u{width}").astype("i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[key, "ids"])
        for stream in opened.values():
            stream.close()

    schema = T.StructType([index.schema[key], T.StructField("ids", T.ArrayType(T.LongType()))])
    order = F.xxhash64(F.lit(seed), "shard", "offset")
    rows = index.select(key, "shard", "offset", "width", order.alias("__order"))
    rows = rows.repartitionByRange(partitions, "__order") if partitions else rows.repartitionByRange("__order")
    return rows.sortWithinPartitions("__order").select(key, "shard", "offset", "width").mapInArrow(read, schema)


def token_records(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """Write all documents as records in the shared folder and give what reading them back finds."""
    folder = shared_files(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, tokenizer, key, text, end), key)
