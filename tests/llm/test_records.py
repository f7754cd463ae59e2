"""Records: round trip, the tokenizer on whole texts, damage, order."""

import io
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from barloom.llm import records
from barloom.llm.common import shared_files
from barloom.llm.queries import QUERIES
from barloom.llm.subwords import WordEncoder, default_path, pieces

from .helpers import SMALL


def test_query_matches_whole_texts(spark):
    tokenizer, at = Tokenizer.from_file(default_path()), 0
    want = []
    for i, t in duckdb.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(tuple(r) for r in QUERIES["op9_token_records"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want


def test_words_alone_give_the_ids_of_the_text():
    import pyarrow as pa

    texts = ["It's a  TEST\x1cx\x85y\t<|endoftext|> é ́a", None, "", "Ünïcode 日本語 12345 don't!!", " \n", "ΣΑΣ ΑΣ.", "x" * 30_000, "a b　c"]
    tokenizer, encoder = Tokenizer.from_file(default_path()), WordEncoder(default_path())
    column = pa.array(texts)
    for a, b in [(0, len(texts)), (3, 6)]:
        ids, rows = encoder.encode(column.slice(a, b - a), 1)
        got = [ids[i:j].tolist() for i, j in zip(rows[:-1], rows[1:])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts[a:b]]
    assert [list(p) for p in pieces(column, 10)][0] == [0, 1]


def test_edge_cases_and_shuffled_read(spark):
    rows = [(3, "c c"), (None, "n"), (1, None), (3, "b"), (2, ""), (3, "c c"), (9, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "0 AS part")
    index = records.write_records(docs, shared_files(spark, "records"), default_path())
    got = records.read_records(index, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3, 9]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    assert got[1].ids == [1] and all(r.ids[-1] == 1 for r in got)
    one, two = (records.read_shuffled(index, seed).collect() for seed in (1, 2))
    assert [r.doc_id for r in one] != [r.doc_id for r in two]
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 7
    none = records.token_records(docs.limit(0), default_path())
    assert none.count() == 0


def test_damage_is_noticed():
    whole = records.frame(b"abcdefgh")
    assert records.unframe(io.BytesIO(whole)) == b"abcdefgh" and records.unframe(io.BytesIO(b"")) is None
    for broken in [whole[:5], whole[:-1], bytes([whole[0] ^ 1]) + whole[1:], whole[:14] + b"X" + whole[15:]]:
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(broken))
